"""Mixing sources to target weights by hash-threshold histograms (operator 7).

A document has a place between 0 and 2^60 - 1, a hash of its columns and, where rows are equal, of its number among them.
A source that is to give r times its words takes each document floor(r) times, and once more those whose place lies under
a threshold. The threshold is found from sums of words by source and leading bits of the place: the running sum shows the
bucket in which the budget ends, and only that bucket's documents are summed again by their next bits. Nothing is sorted,
and thresholds of nested budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import numbered, row_hashes, stored

#: Bits of one histogram, and histograms until all bits of a place are used.
BITS, LEVELS = 12, 5
#: Copies of one row that a task makes.
COPIES = 10_000


def n_words(text: str = "text") -> Column:
    """Number of runs without 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): `share` times all sizes, dealt by weights that repeat in
    the order of the sources (by code point, null last); a target stops at `most` times its source, and what is over
    goes to the others by weight until none is above.

    The last state is that of one common level: target = least(most * size, level * weight). Sources in the order of
    their most * size / weight stop one after the other, so running sums over that order give the level at once. All
    sources are sorted by one task, three numbers each: meant for up to some ten million of them.
    """
    one = Window.partitionBy(F.lit(0))
    order = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    t = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (order - 1) % len(weights) + 1))
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    before = one.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = share * F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("own", level)
    # the level is that of the first source that it does not stop, and it falls from there on
    t = t.withColumn("level", F.max(F.when(F.col("own") <= F.col("stop"), F.col("own"))).over(one))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def _place() -> Column:
    """From the row's hashes h and g and its number _copy."""
    return F.shiftrightunsigned(F.xxhash64("h", "g", "_copy", F.lit(7)), 64 - BITS * LEVELS)


def _sizes(docs: DataFrame, *more: str) -> DataFrame:
    """*more, source, size, h, g, _copy and place of each document."""
    h, g = row_hashes(docs)
    rows = numbered(docs.select(*(F.col(c) for c in more), "source", n_words().alias("size"), h.alias("h"), g.alias("g")))
    return stored(rows.withColumn("place", _place()), "sizes")


def _times(rows: DataFrame, cuts: DataFrame, most: float) -> DataFrame:
    """rows, which have source and place, with the numbers of their source and how often each is taken."""
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.least(F.col("full") + (F.col("place") < F.col("cut")).cast("long"), F.lit(int(most)))
    return joined.withColumn("times", times).drop("full", "cut", "place")


def thresholds(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """From (source, size, place) a row for each source: _source, source_size, target, full, cut. Documents are taken
    `full` times, and those at a place under `cut` once more."""
    t = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("full", F.floor(ratio))
    t = t.withColumn("left", F.col("target") - F.col("full") * F.col("source_size")).withColumnRenamed("source", "_source")
    state = stored(t.withColumn("prefix", F.lit(0).cast("long")), "targets", 1)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            ends = state.select("_source", "prefix")
            inside = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("place", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).join(state.select("_source", "left"), F.col("source").eqNullSafe(F.col("_source"))).where("upto > left")
        ends = sums.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("under"), "words")).alias("b"))
        joined = state.drop("words").join(ends, F.col("_source").eqNullSafe(F.col("source")), "left")
        # where no bucket exceeds the budget, all places lie under the threshold
        prefix, left = F.coalesce("b.bucket", F.lit(1 << (BITS * (level + 1)))), F.col("left") - F.coalesce("b.under", F.lit(0))
        state = stored(joined.select("_source", "source_size", "target", "full", left.alias("left"), prefix.alias("prefix"), F.col("b.words").alias("words")), "thresholds", 1)
    nearer = F.coalesce(2 * F.col("left") >= F.col("words"), F.lit(False)) & (F.col("left") > 0)
    return state.select("_source", "source_size", "target", "full", (F.col("prefix") + nearer.cast("long")).alias("cut"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, times.

    size is the number of words; taken is times * size, and the taken words of a source differ from its target by at
    most half the words of the documents at the place where the budget ends, one document unless hashes tie; they are taken
    or left, whichever is nearer. Reruns agree, however the table is dealt: places depend on the rows alone.

    Whole texts are counted. A null text has no words and is taken as its place says. A null source is a source of its own,
    the last one. Rows that repeat a doc_id, or have none, are documents of their own, and so are equal rows. Other columns
    only tell rows apart; an empty table gives an empty one.
    """
    rows = _sizes(docs, "doc_id")
    out = _times(rows, thresholds(rows, weights, share, most), most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with each row as often as `mixed` takes it, none to `most` times; the columns stay, and the cases of `mixed`
    hold. Texts are not shuffled while the table of a row per source is small, but for those of equal rows."""
    rows = _sizes(docs)
    cuts = thresholds(rows, weights, share, most).drop("source_size", "target")
    twice = rows.where("_copy > 0").select("h", "g").distinct()
    equal = stored(_times(rows.join(twice, ["h", "g"], "left_semi"), cuts, most).groupBy("h", "g").agg(F.sum("times").alias("times")), "equal-rows", rows.count())
    h, g = row_hashes(docs)
    # the columns travel as one, so that none can clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", h.alias("h"), g.alias("g"), F.lit(0).cast("long").alias("_copy"))
    copies = lambda n: F.explode(F.array_repeat(F.lit(0), n.cast("int")))
    if equal.isEmpty():
        return _times(own.withColumn("place", _place()), cuts, most).withColumn("copy", copies(F.col("times"))).select("row.*")
    single = own.join(equal, ["h", "g"], "left_anti").withColumn("place", _place())
    single = _times(single, cuts, most).withColumn("copy", copies(F.col("times"))).select("row")
    many = own.join(equal.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.any_value("row").alias("row")).join(equal.where("times > 0"), ["h", "g"])
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long")))).repartition("h", "g", "_from")
    many = many.withColumn("copy", copies(F.least(F.lit(COPIES), F.col("times") - F.col("_from")))).select("row")
    return single.unionByName(many).select("row.*")
