"""Removal of globally repeated chunks of lines (operator 6).

Boundaries between lines depend on the lines near them alone, so an inserted line moves no other boundary. A cyclic
rolling hash over the hashes of the last WINDOW lines ends a chunk where it is a multiple of DIVISOR; a long line is a
chunk of its own. Chunks with equal bytes are grouped, and all but the first of a group go. As the first and last chunks
of a passage depend on what surrounds it, runs of lines are looked for as well: from each line and up to each line the
shortest run of RUN_WORDS words, which together cover any passage of so many words, and each short chunk of one line with
its neighbour. Everything is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import numbered, row_hashes, spread_join, stored

WINDOW, DIVISOR = 2, 3
#: Characters from which a line is a chunk of its own, and a repeated chunk of one line goes.
LONG = 200
#: Words from which a repeated run of lines goes whole, wherever chunks end; a line counts as one word at least.
RUN_WORDS = 50
#: What stands for a null doc_id, with the hash of the text.
_LAST = (1 << 63) - 1
#: A run of lines is its first line's number times 2^SPAN and the number of its lines.
SPAN = 31


def _turned(h: Column, bits: int) -> Column:
    return h if not bits else F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def chunks(text: Column, long: int = LONG, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<start: line, n: lines, body: string>> of a text, in order; joined by newlines they are the text."""

    def cut(s: Column) -> Column:
        return F.transform(_cuts(s, long, window, divisor), lambda c: F.struct(c["start"], c["n"], F.array_join(F.slice(s["lines"], c["start"] + 1, c["n"]), "\n").alias("body")))

    return _let(_hashed(text), cut)


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hashed(text: Column, *more: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return F.struct(lines.alias("lines"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), *more)


def _cuts(s: Column, long: int, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<start, n>> of the chunks; s holds lines and h."""

    def begins(i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for k in range(window):
            rolled = rolled.bitwiseXOR(_turned(F.coalesce(F.get(s["h"], i - 1 - k), F.lit(0).cast("long")), k))
        is_long = F.greatest(F.length(F.get(s["lines"], i)), F.length(F.get(s["lines"], i - 1))) >= long
        return (i == 0) | is_long | (F.pmod(rolled, F.lit(divisor)) == 0)

    starts = F.filter(F.sequence(F.lit(0), F.size(s["lines"]) - 1), begins)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s["lines"])))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("n")))


def _removable(c: Column, long: int) -> Column:
    return ((c["n"] > 1) | (F.length(c["body"]) >= long)) & (F.length(F.trim(c["body"])) > 0)


def repeated(docs: DataFrame, long: int = LONG) -> DataFrame:
    """(_id, _text, removed): for each document that loses chunks, their numbers; see _document for its key."""
    own = docs.where("text is not null").select(*_document(), F.posexplode(chunks(F.col("text"), long)).alias("at", "c")).where(_removable(F.col("c"), long))
    key, more = F.xxhash64("c.body"), F.xxhash64(F.lit(1), "c.body")
    # equal bytes meet as keys of an aggregate that first runs within each task, so a common chunk is no hot key
    equal = own.groupBy(key.alias("key"), more.alias("more"), F.col("c.body").alias("body")).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # of different bytes that agreed in all 128 bits none would be touched
    groups = equal.groupBy("key", "more").agg(F.max("first").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("bodies"))
    groups = stored(groups.where("n > 1 and bodies = 1").drop("bodies"), "groups")
    places = own.select("_id", "_text", "at", key.alias("key"), more.alias("more"))
    return _without_first(places, groups, ["key", "more"], "at", lambda at, kept: at == kept, "removed")


def _without_first(places: DataFrame, groups: DataFrame, on: list[str], at: str, same, name: str) -> DataFrame:
    """(_id, _text, name): of each document the places of repeated pieces but for the first place of each piece, by _id,
    then _text, then place, and what is the `same` as that one. groups has the pieces found n > 1 times and their least _id."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = stored(spread_join(places, groups, on, groups, max(total, 1) * 10, ["_id", "_text", at]), "repeated", total)
    kept = rows.where("_id = first").groupBy(*on).agg(F.min(F.struct("_text", at)).alias("kept"))
    rows = spread_join(rows, kept, on, groups.select(*on, "n"), total, ["_id", "_text", at])
    is_kept = (F.col("_id") == F.col("first")) & (F.col("_text") == F.col("kept._text")) & same(F.col(at), F.col("kept")[at])
    return rows.where(~is_kept).groupBy("_id", "_text").agg(F.collect_set(at).alias(name))


def _span(start: Column, n: Column) -> Column:
    return F.shiftleft(start.cast("long"), SPAN) + n


def _start(span: Column) -> Column:
    return F.shiftright(span, SPAN).cast("int")


def _lines(span: Column) -> Column:
    return span.bitwiseAND(F.lit((1 << SPAN) - 1)).cast("int")


def _shortest(weights: Column, words: int) -> Column:
    """array<long>: the shortest run of at least `words` from each line on, where there is one. weights are 1 or more."""

    def ladder(sums: list[Column]) -> Column:
        """sums[k] holds for each line the sum of the 2^k lines from there, or of what is left of them."""
        step = 1 << (len(sums) - 1)
        if 2 * step <= words:
            longer = F.transform(sums[-1], lambda x, i: x + F.coalesce(F.get(sums[-1], i + step), F.lit(0).cast("long")))
            return _let(longer, lambda x: ladder([*sums, x]))
        rungs = F.array(*(F.struct(F.lit(1 << k).alias("step"), x.alias("sums")) for k, x in reversed(list(enumerate(sums)))))
        return _let(rungs, lambda rungs: F.transform(weights, lambda _, i: _descend(rungs, i)))

    def _descend(rungs: Column, i: Column) -> Column:
        def down(at: Column, rung: Column) -> Column:
            ahead = F.coalesce(F.get(rung["sums"], at["at"]), F.lit(0).cast("long"))
            return F.when(ahead < at["need"], F.struct((at["at"] + rung["step"]).alias("at"), (at["need"] - ahead).alias("need"))).otherwise(at)

        last = F.aggregate(rungs, F.struct(i.alias("at"), F.lit(words).cast("long").alias("need")), down, lambda at: at["at"])
        return _let(last, lambda j: F.when(j < F.size(weights), _span(i, j - i + 1)))

    return F.filter(ladder([weights]), lambda x: x.isNotNull())


def runs(text: Column, long: int = LONG, words: int = RUN_WORDS) -> Column:
    """array<struct<span, a, b>> of a text: its shortest runs of `words` words, and each chunk that is one short line
    with a neighbour that is none. a and b are 128 bits of hash of the run's lines; runs of blank lines are left out."""
    lines = F.split(text, "\n", -1)
    counts = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")).cast("long"))

    def of(s: Column) -> Column:
        size, weights = F.size(s["lines"]), F.transform(s["counts"], lambda x: F.greatest(x, F.lit(1).cast("long")))
        ahead = _let(weights, lambda w: _shortest(w, words))
        back = F.transform(_let(F.reverse(weights), lambda w: _shortest(w, words)), lambda x: _span(size - _start(x) - _lines(x), _lines(x)))

        def short(c: Column) -> Column:
            return (c["n"] == 1) & (F.length(F.get(s["lines"], c["start"])) < long)

        def pairs(c: Column) -> Column:
            after = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
            both = F.zip_with(F.slice(c, 1, F.size(after)), after, lambda x, y: F.when(short(x) != short(y), _span(x["start"], x["n"] + y["n"])))
            return F.filter(both, lambda x: x.isNotNull())

        def keyed(x: Column) -> Column:
            a, b = (F.xxhash64(F.slice(s[h], _start(x) + 1, _lines(x))) for h in ("h", "g"))
            return F.struct(x.alias("span"), a.alias("a"), b.alias("b"))

        spans = F.array_distinct(F.concat(ahead, back, _let(_cuts(s, long), pairs)))
        spans = F.filter(spans, lambda x: F.exists(F.slice(s["counts"], _start(x) + 1, _lines(x)), lambda n: n > 0))
        return F.transform(spans, keyed)

    return _let(_hashed(text, F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("g"), counts.alias("counts")), of)


def repeated_runs(docs: DataFrame, long: int = LONG, words: int = RUN_WORDS) -> DataFrame:
    """(_id, _text, spans): for each document the runs that are found before, and there do not overlap them."""
    own = docs.where("text is not null").select(*_document(), F.explode(runs(F.col("text"), long, words)).alias("r"))
    own = stored(own.select("_id", "_text", "r.*"), "all-runs")  # dearer to work out than to read again
    groups = stored(own.groupBy("a", "b").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "run-groups")
    return _without_first(own, groups, ["a", "b"], "span", lambda x, kept: _start(x) < _start(kept) + _lines(kept), "spans")


def _document() -> tuple[Column, Column]:
    """What tells documents apart: doc_id, or the largest long for null, and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64("text").alias("_text")


def deduplicated(docs: DataFrame, long: int = LONG, run_words: int | None = None) -> DataFrame:
    """docs with `text` rid of repeated chunks, and after its columns n_lines, removed_lines and removed_chunks.

    A chunk of several lines, or of one of `long` characters or more, that is found twice or more stays where it is
    found first, by doc_id and place. With `run_words`, so does any run of lines of that many words, and a short chunk of
    one line that is found again with the same longer neighbour; removed_chunks counts chunks that go by themselves. Whole
    texts count, however long. A null text stays null, with no lines; an empty one has one line and stays. Null doc_ids
    come last. Rows that repeat a doc_id are documents of their own where their texts differ, in the order of a hash; rows
    equal in doc_id and text count as one document and lose the same, but of rows with a null doc_id and equal texts one
    alone keeps its chunks. Columns of the names added are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "removed_lines", "removed_chunks")
    lost = repeated(docs, long)
    if run_words:
        lost = lost.join(repeated_runs(docs, long, run_words), ["_id", "_text"], "full")
    else:
        lost = lost.withColumn("spans", F.lit(None).cast("array<long>"))
    lost = stored(lost, "lost").hint("shuffle_hash")  # texts are hashed to it, not sorted
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # no column of docs can clash
    named = docs.where("doc_id is not null").select(row, "text", *_document(), F.lit(False).alias("_again"))
    # equal rows without an id are numbered, and all but one of those with one text are repeats
    h, g = row_hashes(docs)
    bare = numbered(docs.where("doc_id is null").select(row, "text", h.alias("_h"), g.alias("_g")))
    kept = F.min(F.struct("_h", "_g", "_copy"))
    first = bare.groupBy(F.xxhash64("text").alias("_text")).agg(kept.alias("kept"), F.count(F.lit(1)).alias("n"))
    bare = spread_join(bare.withColumn("_text", F.xxhash64("text")).withColumn("_own", F.struct("_h", "_g", "_copy")), first.select("_text", "kept"), ["_text"], first, docs.where("doc_id is null").count(), ["_own"])
    bare = bare.select("row", "text", F.lit(_LAST).alias("_id"), "_text", (F.col("_own") != F.col("kept")).alias("_again"))
    joined = named.unionByName(bare).join(lost, ["_id", "_text"], "left")
    if run_words:
        every = F.transform(runs(F.col("text"), long, run_words), lambda r: r["span"])
        joined = joined.withColumn("spans", F.when(F.col("_again"), every).otherwise(F.col("spans")))
    joined = joined.withColumn("chunks", F.when(F.col("removed").isNotNull() | F.col("_again"), chunks(F.col("text"), long)))
    every = F.filter(F.transform("chunks", lambda c, i: F.when(_removable(c, long), i)), lambda i: i.isNotNull())
    every = F.when(F.size(every) > 0, every)
    joined = joined.withColumn("removed", F.when(F.col("_again"), every).otherwise(F.col("removed")))
    none = F.array().cast("array<int>")
    of_chunks = F.flatten(F.transform("removed", lambda i: _let(F.get("chunks", i), lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    of_runs = F.flatten(F.transform("spans", lambda x: F.sequence(_start(x), _start(x) + _lines(x) - 1)))
    joined = joined.withColumn("gone", F.array_distinct(F.concat(F.coalesce(of_chunks, none), F.coalesce(of_runs, none))))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(F.array_sort(left), lambda i: F.get(lines, i)), "\n")

    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(_let(F.split("text", "\n", -1), rest))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    return joined.select(
        *(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns),
        lines.alias("n_lines"), F.size("gone").cast("long").alias("removed_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("removed_chunks"),
    )
