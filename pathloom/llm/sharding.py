"""Uniform sharding into exact sizes by a hypergeometric communication matrix (operator 9).

Rows lie in parts of bounded size. For the shards' exact sizes, the number of rows that each part sends to each shard is
drawn as a uniform shuffle would draw it. Each part orders its rows by a hash of their own and deals them out by its row
of that matrix; each shard then orders what it got by another hash.

The matrix is an urn's: each place of a part draws a number, a hash of the seed, the part and the place, and the shards
take the numbers of all parts in order, as many each as its size says. How many of a part's numbers a shard takes then
follows the multivariate hypergeometric law, at any size. No number is sorted but those in the few buckets of a histogram
where one shard ends and the next begins. Everything is a DataFrame function, and nothing but counts and the shards' limits
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._common import numbered, row_hashes, stored

#: Rows of a part, and of a piece of a shard, on average; and parts at most.
PART_ROWS, MOST_PARTS = 50_000, 1 << 20
#: Numbers that a task draws.
DRAWS = 1_000_000


def _numbers(parts: DataFrame, seed: int, total: int) -> DataFrame:
    """_part, j and v, the number from 0 to 2^63 - 1 that place j of the part draws."""
    dealt = parts.repartition(max(1, -(-total // DRAWS)), "_part")
    rows = dealt.select("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    return rows.select("_part", "j", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(11), "_part", "j"), 1).alias("v"))


def matrix(parts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(_part, shard, n) from parts (_part, n): how many rows of each part each shard gets, where it gets any. Shards
    differ by at most one row in all, and the counts are distributed as under a uniform shuffle."""
    parts = parts.where("n > 0")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    ends = sorted({sum(sizes[: s + 1]) for s in range(n_shards)} - {0, total})
    numbers = _numbers(parts, seed, total)
    bits = min(16, max(1, total.bit_length() - 10))
    bucket = F.shiftright("v", 63 - bits)
    counts = stored(numbers.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")), "draws", 1 << 16)  # 2^16 rows at most
    upto = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("upto", upto).withColumn("end", F.explode(F.array(*(F.lit(e).cast("long") for e in ends)) if ends else F.array().cast("array<bigint>")))
    last = at.where("end <= upto and end > upto - n").select("b", "end", (F.col("end") - F.col("upto") + F.col("n")).alias("k"))
    last = stored(last, "ends", n_shards)  # a row per shard
    inside = numbers.withColumn("b", bucket).join(F.broadcast(last.select("b").distinct()), "b")
    order = F.row_number().over(Window.partitionBy("b").orderBy("v", "_part", "j"))
    limits = inside.withColumn("k", order).join(F.broadcast(last), ["b", "k"]).select("end", F.struct("v", "_part", "j").alias("limit"))
    held = [r["limit"] for r in limits.orderBy("end").collect()]  # a row per shard
    limits = F.array(*(F.struct(*(F.lit(x).cast(t).alias(c) for c, x, t in zip(("v", "_part", "j"), r, ("long", "int", "long")))) for r in held)) if held else F.array().cast("array<struct<v:bigint,_part:int,j:bigint>>")
    own = F.struct("v", F.col("_part").cast("int").alias("_part"), "j")
    taken = numbers.select("_part", F.size(F.filter(limits, lambda x: x < own)).alias("at"))
    filled = F.array(*(F.lit(s) for s in range(n_shards) if sizes[s])) if total else F.array().cast("array<int>")
    return taken.groupBy("_part", F.get(filled, F.col("at")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def sharded(docs: DataFrame, n_shards: int = 24, seed: int = 9) -> DataFrame:
    """docs with two more columns, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shards differ by at most one row. The places depend on the seed, the rows and their number, not on how the table is
    dealt: a row is told by 128 bits of hashes of all its columns, and of rows equal in all of them each has a number. Equal
    rows are counted and made again, so any number of them is dealt out evenly. Places are found for the hashes alone; then
    the whole rows travel to them once, however long the texts. Null ids and
    nulls in any column count as values like others, and ties of hashes are broken by the number. An empty table gives an
    empty one. Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    key, own = row_hashes(docs)
    # the columns travel as one, so that none can clash
    rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("_key"), own.alias("_own")), "rows")
    places = stored(numbered(rows.select("_key", "_own")), "places")
    total = places.count()
    n_parts = min(MOST_PARTS, max(1, -(-total // PART_ROWS)))
    place = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "_key", "_own", "_copy")
    dealt = places.withColumn("_part", F.pmod(place(1), F.lit(n_parts)).cast("int"))
    parts = stored(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "parts", n_parts)
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ends = matrix(parts, n_shards, seed).withColumn("end", upto)
    ends = ends.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("_ends"))  # an entry per shard
    at = F.row_number().over(Window.partitionBy("_part").orderBy(place(2), "_key", "_own", "_copy"))
    dealt = dealt.withColumn("_at", at).join(ends, "_part")
    # the first shard whose end the row's place does not exceed
    dealt = dealt.withColumn("shard", F.get(F.filter("_ends", lambda e: e["end"] >= F.col("_at")), F.lit(0))["shard"])
    n_pieces = max(1, -(-total // n_shards // PART_ROWS))
    dealt = stored(dealt.withColumn("_turn", place(3)).withColumn("_piece", F.pmod("_turn", F.lit(n_pieces)).cast("int")).drop("_part", "_ends", "_at"), "dealt")
    pieces = dealt.groupBy("shard", "_piece").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("shard", "_piece", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(F.xxhash64("_turn", F.lit(4)), "_key", "_own", "_copy"))
    dealt = dealt.withColumn("_at", at).join(pieces, ["shard", "_piece"]).select("_key", "_own", "_copy", "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"))
    # each row goes to its place, whole; only those that there are more than once need a number for it
    again = stored(places.where("_copy = 1").select("_key", "_own"), "again")
    alone = rows.join(again, ["_key", "_own"], "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    equal = numbered(rows.join(again, ["_key", "_own"], "left_semi"))
    out = alone.unionByName(equal).join(dealt.hint("merge"), ["_key", "_own", "_copy"])  # by a shuffle at any size
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "shard", "slot")


def digest(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, size (bytes of the text and 8) and text_crc32, the columns that shards of documents are told by, and those kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *kept)
