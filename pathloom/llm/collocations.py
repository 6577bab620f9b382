"""Phrases whose words stand together more often than by chance (operator 13).

Texts are cut into pieces, and identical pieces become one row with a multiplicity. Phrases of one word are counted, then
of two to five: a task takes from its pieces those phrases whose first and last words, all but one, are frequent
themselves, adds up their multiplicities, and sends each to the bucket of its hash. There duckdb sums the bucket, on
disk where memory does not do. Which shorter phrases are frequent is told to the tasks by a bit array of bounded size: what it
lets through in error is counted as well and found rare. The counts of a phrase's parts are requested from the buckets
that hold them, by a shuffle, which also brings parts and requests of the same key together.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._common import batch_of, discard, spread_join, stored, tidy
from ._text import U, mix, raw, runs, span_hashes

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of pieces that a task counts at once, and duckdb's memory for a bucket.
FLUSH_BYTES, BUCKET_MEMORY = 8 << 20, "160MB"
#: Bits of the array for each frequent phrase, and bits of it at least and at most.
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 16, 1 << 26
#: Parts into which a language's phrases are dealt before the last ranking.
DEAL = 64

_PIECES = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("n", pa.int64())])
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True


@functools.cache
def _factors() -> np.ndarray:
    return np.random.default_rng(23).integers(0, 1 << 63, LONGEST + 1, dtype=np.uint64) * U(2) + U(1)


def gathered(batches, column: str, limit: int):
    """Tables of about `limit` bytes of `column`, from small batches and parts of large ones; one row at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(at, to - at))
            size, at = size + int(ends[to - 1] - before), to
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in column.chunks])


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts that hold a word, A-Z lowered and words joined by one space, and the texts' numbers."""
    data, limits = raw(column)
    data = _LOWER[data]
    ends = _ENDS[data]
    member = ~(ends | _BLANK[data])
    starts, stops = runs(member, limits)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    owner = np.searchsorted(limits, starts, "right") - 1
    part = np.cumsum(ends)[starts]
    same = (part[1:] == part[:-1]) & (owner[1:] == owner[:-1])
    joint = stops[:-1][same]  # a blank: the byte behind a word that another word of its piece follows
    member[joint], data[joint] = True, 32
    place = np.concatenate(([0], np.cumsum(member)))
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    offsets = np.append(place[starts[first]], place[-1]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[member])), owner[first]


def _pieces(batches):
    for part in gathered(batches, "text", FLUSH_BYTES):
        pieces, owner = split(_one(part.column("text"), pa.large_string()))
        found = pa.table({"lang": _one(part.column("lang"), pa.string()).take(pa.array(owner)), "piece": pieces})
        found = found.group_by(["lang", "piece"]).aggregate([([], "count_all")])
        for batch in found.rename_columns(["lang", "piece", "n"]).cast(_PIECES).to_batches(max_chunksize=20_000):
            yield batch


def _hashes(words: np.ndarray, lang: np.ndarray, size: int) -> np.ndarray:
    """A hash of the language and the `size` words from each place on."""
    n = max(len(words) - size + 1, 0)
    h = lang[:n] * _factors()[LONGEST]
    for k in range(size):
        h = h + words[k : k + n] * _factors()[k]
    return mix(h)


def _among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, out = U(len(bits) * 8 - 1), None
    for turn in (0, 32):
        at = (h >> U(turn)) & mask
        hit = (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1
        out = hit if out is None else out & hit
    return out.astype(bool)


def _spans(column: pa.Array) -> np.ndarray:
    data, limits = raw(column)
    return span_hashes(data, limits[:-1], limits[1:])


def _phrases(size: int, frequent):
    """(lang, phrase, n) of the phrases of `size` words, once for what is counted at once; `frequent` holds the bits of the
    phrases of one word less that are frequent."""

    def phrases(batches):
        bits = np.frombuffer(frequent.value, np.uint8) if frequent is not None else None
        for part in gathered(batches, "piece", FLUSH_BYTES):
            lists = pc.split_pattern(_one(part.column("piece"), pa.large_string()), " ")
            lang = _one(part.column("lang"), pa.string()).dictionary_encode()
            coded = pc.list_flatten(lists).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            tongue = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[piece]
            if bits is None:
                at = np.arange(len(code))
            else:
                words, tongues = _spans(coded.dictionary)[code], _spans(lang.dictionary)[tongue]
                fine = _among(bits, _hashes(words, tongues, size - 1))
                n = max(len(code) - size + 1, 0)
                at = np.flatnonzero(fine[:n] & fine[1 : n + 1] & (piece[:n] == piece[size - 1 :][:n]))
            if not len(at):
                continue
            key = tongue[at]  # numbered one to one, a word at a time
            for k in range(size):
                _, first, key = np.unique((key << 32) | code[at + k], return_index=True, return_inverse=True)
            weight = np.zeros(len(first), np.int64)
            np.add.at(weight, key, part.column("n").to_numpy()[piece[at]])
            chosen = at[first]
            parts = [coded.dictionary.take(pa.array(code[chosen + k])) for k in range(size)]
            joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
            found = pa.table({"lang": lang.dictionary.take(pa.array(tongue[chosen])), "phrase": joined, "n": weight}).cast(_PHRASES)
            yield from found.to_batches(max_chunksize=20_000)

    return phrases


def _summed(least: int, totals: bool):
    """Sums a bucket in duckdb, which goes to disk beyond its memory, and keeps what reaches `least`. With `totals` a row
    without a phrase has the sum of each language."""

    def summed(batches):
        import shutil
        import tempfile

        import duckdb

        folder = tempfile.mkdtemp()
        try:
            with duckdb.connect(f"{folder}/bucket.db", config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": f"{folder}/spill"}) as db:
                rows = pa.RecordBatchReader.from_batches(_PHRASES, (b.cast(_PHRASES) for b in batches))
                db.register("rows", rows)
                db.execute("CREATE TABLE sums AS SELECT lang, phrase, sum(n)::BIGINT AS n FROM rows GROUP BY ALL")
                query = f"SELECT lang, phrase, n FROM sums WHERE n >= {int(least)}"
                if totals:
                    query += " UNION ALL SELECT lang, NULL, sum(n)::BIGINT FROM sums GROUP BY lang"
                for batch in db.sql(query).to_arrow_reader(20_000):
                    yield batch.cast(_PHRASES)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return summed


def _set_bits(size: int, n_bits: int):
    """Which bits the phrases of `size` words set: numbers of 64-bit words and their bits."""

    def set_bits(batches):
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _spans(pc.list_flatten(pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ")))
            tongues = np.repeat(_spans(batch.column("lang").cast(pa.large_string())), size)
            h = _hashes(words, tongues, size)[::size]
            for turn in (0, 32):
                at = (h >> U(turn)) & U(n_bits - 1)
                np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
        values = bits.view("<i8")
        some = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(values[some], pa.int64())], names=["at", "bits"])

    return set_bits


def _bits_of(frequent: DataFrame, size: int, count: int) -> bytes:
    """The bit array of the frequent phrases of `size` words: BITS_EACH bits a phrase, BITS_MOST (8 MB) in all at most."""
    n_bits = min(max(1 << (BITS_EACH * max(count, 1) - 1).bit_length(), BITS_LEAST), BITS_MOST)
    parts = frequent.select("lang", "phrase").mapInArrow(tidy(_set_bits(size, n_bits)), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(n_bits // 64, "<i8")
    found = parts.toPandas()
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.tobytes()


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of up to `longest` words that are found `least` times, and (lang, n) of all
    words. Both are stored tables."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = own.mapInArrow(tidy(_pieces), "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    pieces = stored(pieces, "pieces")
    bits, out, totals = None, None, None
    for size in range(1, longest + 1):
        rows = pieces.mapInArrow(tidy(_phrases(size, bits)), "lang string, phrase string, n long")
        sums = rows.repartition("lang", "phrase").mapInArrow(tidy(_summed(least, size == 1)), "lang string, phrase string, n long")
        sums = stored(sums, f"phrases{size}")
        found = sums.where("phrase is not null")
        if size == 1:
            totals = stored(sums.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n")), "words", 1)
        out = found.withColumn("size", F.lit(size)) if out is None else out.unionByName(found.withColumn("size", F.lit(size)))
        if size < longest:
            if bits is not None:
                bits.unpersist()
            bits = spark.sparkContext.broadcast(_bits_of(found, size, found.count()))
    discard(pieces)
    return out, totals


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words, found a >= least times, is cut in two where floor(1000 * a * n / (l * r)) is least, the
    first such place counting; l and r are the counts of its parts and n all words of the language. A phrase goes where a
    longer one that holds it is as frequent. It then does for one that is longer by one word, as counts only fall with
    length. Ties in score and count are ranked by the phrase's bytes. Products are decimals of 38 digits.

    Whole texts count, those of null are empty, and a null language is `und`. Repeated rows and ids are texts of their own,
    other columns are ignored, and an empty table gives an empty one.
    """
    counts, words = counted(docs, longest, least)
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(parts, start, n), " ")
    inner = phrases.where("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = stored(phrases.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer"), "left")
    rows = left.count()
    langs = left.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    left = spread_join(left, words.withColumnRenamed("n", "words"), ["lang"], langs, rows, ["phrase"])
    asked = left.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = asked.select("lang", "phrase", "a", "words", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        held = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        asked = stored(asked, "asked")
        asked = spread_join(asked, held, ["lang", part], asked.groupBy("lang", part).agg(F.count(F.lit(1)).alias("n")), rows * (longest - 1), ["phrase"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    asked = asked.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)")) * F.col("words").cast("decimal(17,0)")).withColumn("down", wide("l") * wide("r"))
    scored = asked.withColumn("score", F.expr("cast(up div down as bigint)"))
    best = scored.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).orderBy(*order)
    first = best.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
