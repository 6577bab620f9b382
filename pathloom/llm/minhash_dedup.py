"""Near-duplicate documents by HyperMinHash signatures (operator 4).

A signature has REGISTERS registers of 16 bits. The first bits of a shingle's hash choose the register; the smallest
hash of the register is kept as its count of leading zeros and MANTISSA bits after the first one. Each empty register
borrows from the first filled one in a random order of its own, bands of BAND registers are hashed, and documents that
share a band are candidates. A collision-corrected estimate of the Jaccard similarity drops candidates far below the
limit, and what remains is confirmed on the full shingle sets.

A pair at the limit goes unseen where it shares no band, or where its estimate falls MARGIN standard errors short; the
README has the share of simulated pairs for both together.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import batch_of, pieces, row_hashes, spread_join, stored, tidy
from ._components import components
from ._text import U, mix, shingle_sets

REGISTERS, BAND, MANTISSA, SHINGLE = 256, 8, 10, 5
#: Standard errors that an estimate may lie below the limit before a candidate is dropped without a look at the sets.
MARGIN = 4.5
#: Rows of a block's side, and shingles of them, when all members of a band's bucket are compared, and shingles at once.
BLOCK, BLOCK_ITEMS, SLAB = 1024, 1 << 19, 2048

@functools.cache
def _deal() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(11)
    return g.permutation(REGISTERS), g.integers(0, 1 << 63, BAND, dtype=np.uint64) * U(2) + U(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each sorted set of hashes; 0 marks an empty register."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = [len(s) for s in sets]
    if not sum(sizes):
        return out
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    bits = REGISTERS.bit_length() - 1
    register = (h >> U(64 - bits)).astype(np.int64)
    cell = owner * REGISTERS + register
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))  # sets are sorted: the first is the least
    rest = h[first] << U(bits)
    zeros = 53 - np.frexp((rest >> U(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
    out[owner[first], register[first]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


@functools.cache
def _orders() -> np.ndarray:
    """For each register a random order of all others, itself first; the transpose, so that a row is one attempt."""
    g = np.random.default_rng(13)
    own = [np.concatenate(([j], (o := g.permutation(REGISTERS))[o != j])) for j in range(REGISTERS)]
    return np.ascontiguousarray(np.array(own).T)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Band hashes of each row. An empty register takes the value and the number of the first filled one in its own
    order. So two registers of a short text borrow independently, and each agrees between two texts where the first
    register that either has filled holds the same in both: with a chance of about the similarity, at any length."""
    n, m = sig.shape
    source = np.broadcast_to(np.arange(m), (n, m)).copy()
    row, register = np.nonzero((sig == 0) & (sig > 0).any(axis=1)[:, None])
    for attempt in _orders()[1:]:
        if not len(row):
            break
        at = attempt[register]
        found = sig[row, at] > 0
        source[row[found], register[found]] = at[found]
        row, register = row[~found], register[~found]
    value = mix(np.take_along_axis(sig, source, axis=1).astype(np.uint64) * U(m) + source.astype(np.uint64))
    order, factors = _deal()
    v = value[:, order].reshape(n, m // BAND, BAND)
    return mix((v * factors).sum(axis=2, dtype=np.uint64) + np.arange(m // BAND, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of the signatures in rows a and b and the registers they rest on. Different minima share a cell
    with probability about 0.72 / 2^MANTISSA * xy / (x + y)^2 at set sizes x and y; that share is taken off."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    x, y = np.maximum(n_a, 1).astype(float), np.maximum(n_b, 1).astype(float)
    chance = 0.72 / (1 << MANTISSA) * x * y / (x + y) ** 2
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def _passes(a, b, n_a, n_b, limit: float) -> np.ndarray:
    """Rows that may reach the limit. The registers sample the union without replacement, so the error of an estimate
    shrinks as they come to hold all of it; sets of sizes too different cannot reach the limit at all."""
    got, used = estimate(a, b, n_a, n_b)
    n_a, n_b, used = np.asarray(n_a, float), np.asarray(n_b, float), np.maximum(used, 1)
    union = np.maximum((n_a + n_b) / (1 + limit), 2)
    unseen = np.clip((union - used + 1) / (union - 1), 0, 1)
    margin = MARGIN * np.sqrt(limit * (1 - limit) / used * unseen) + 1.5 / used
    return (got >= limit - margin) & (np.minimum(n_a, n_b) >= limit * np.maximum(n_a, n_b) - 1e-9)


def _features(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = shingle_sets(part.column("text"), SHINGLE)
            sig, some = signatures(sets), [len(s) > 0 for s in sets]
            keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if x else None for s, x in zip(sets, some)], pa.binary())
            sigs = pa.array([r.tobytes() if x else None for r, x in zip(sig, some)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), keys, sigs], names=["id", "n_shingles", "set_key", "sig"])


def _banded(batches):
    for batch in batches:
        if batch.num_rows:
            bands = pa.array(list(band_keys(_rows(batch.column("sig")))), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, bands], names=[*batch.schema.names, "bands"])


def _sets(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = shingle_sets(part.column("text"), SHINGLE)
            keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "items"])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _near(limit: float):
    def near(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
                keep = pa.array(_passes(_rows(batch.column("sig_a")), _rows(batch.column("sig_b")), *n, limit))
                yield batch_of(_PAIRS, batch.column("a").filter(keep), batch.column("b").filter(keep))

    return near


def _blocks(batches):
    """The rows of each (key, i, j) that lie together in a sorted partition, as columns."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([r[1:] != r[:-1] for r in rows], axis=0)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(at, to - at)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("key", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _block_members(limit: float):
    """Of each block the members that may link to one of another component, a row each however many such links there are."""

    def block_members(batches):
        for block in _blocks(batches):
            sig = _rows(pa.concat_arrays(block.column("sig").chunks))
            ids, n, part, chunk = (block.column(c).to_numpy() for c in ("node", "n_shingles", "component", "chunk"))
            key, i, j = (block.column(c)[0].as_py() for c in ("key", "i", "j"))
            bands = band_keys(sig)
            earlier = bands[:, : int(np.flatnonzero(bands[0] == key)[0])]
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            may = np.zeros(len(ids), bool)
            for x in left:
                y = right[(part[right] != part[x]) & ((ids[right] > ids[x]) if i == j else True)]
                y = y[~(earlier[y] == earlier[x]).any(axis=1)]  # a pair counts in the first band that it shares
                y = y[_passes(sig[x], sig[y], n[x], n[y], limit)] if len(y) else y
                may[y], may[x] = True, may[x] or len(y) > 0
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(block.column(c).chunks).filter(pa.array(may)) for c in _MEMBERS.names], schema=_MEMBERS)

    return block_members


_MEMBERS = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("chunk", pa.int32()), ("node", pa.int64()), ("component", pa.int64())])


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b. Only items that several sets hold can count; SLAB of them
    at a time are the columns of two matrices of presence, whose product has the shares of all pairs."""
    sets = a + b
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(items, return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[code]
    code, owner = number[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, int(several.sum()), SLAB):
        at, to = np.searchsorted(code, [first, first + SLAB])
        there = np.zeros((len(sets), SLAB), np.float32)  # sums of ones stay far below 2^24
        there[owner[at:to], code[at:to] - first] = 1
        out += (there[: len(a)] @ there[len(a) :].T).astype(np.int64)
    return out


def _block_links(num: int, den: int):
    """The links inside each block, of full sets: a row for each member that links, with the least that it reaches there."""

    def block_links(batches):
        for block in _blocks(batches):
            ids, part, chunk = (block.column(c).to_numpy() for c in ("node", "component", "chunk"))
            sets = [x.values.to_numpy() for x in pa.concat_arrays(block.column("items").chunks)]
            i, j = (block.column(c)[0].as_py() for c in ("i", "j"))
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            if not len(left) or not len(right):
                continue
            both = common([sets[x] for x in left], [sets[x] for x in right])
            n = np.array([len(x) for x in sets], np.int64)
            union = n[left][:, None] + n[right][None, :] - both
            link = (den * both >= num * union) & (part[left][:, None] != part[right][None, :])
            low = ids.copy()  # the least reached so far
            while True:
                old = low.copy()
                big = np.iinfo(np.int64).max
                low[left] = np.minimum(low[left], np.where(link, low[right][None, :], big).min(axis=1))
                low[right] = np.minimum(low[right], np.where(link, low[left][:, None], big).min(axis=0))
                if (old == low).all():
                    break
            yield batch_of(_PAIRS, low[low < ids], ids[low < ids])

    return block_links


def _grouped(texts: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """From (id, text), where id is of any type with an order: (id, n_shingles, set_key) of each row, and (set_key, copies,
    component) of each set, the component being the smallest id of all sets that links join. Rows without an id, and sets
    without shingles, are in the first only."""
    limit, kind = num / den, texts.schema["id"].dataType.simpleString()
    f = stored(texts.mapInArrow(tidy(_features), f"id {kind}, n_shingles long, set_key binary, sig binary"), "features")
    known = f.where("id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    classes = classes.select("set_key", "low", "copies", F.monotonically_increasing_id().alias("node"), "n_shingles", "sig")
    classes = stored(classes.mapInArrow(tidy(_banded), f"set_key binary, low {kind}, copies long, node long, n_shingles long, sig binary, bands array<long>"), "classes")
    rows = classes.select("node", F.explode("bands").alias("key"))
    n_sets = classes.count()
    n_rows = n_sets * (REGISTERS // BAND)
    shared = stored(rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared", n_rows // 2)
    buckets = stored(spread_join(rows, shared, ["key"], shared, n_rows).withColumnRenamed("n", "size"), "buckets", shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n_rows = buckets.count()
    members = stored(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("low", "set_key", "node"), "members", min(n_sets, n_rows))
    # of rows that share an id, those with another set find no member
    lows = members.select(F.col("low").alias("id")).distinct().hint("shuffle_merge")
    found = texts.join(lows, "id", "left_semi").mapInArrow(tidy(_sets), "set_key binary, items array<long>").groupBy("set_key").agg(F.any_value("items").alias("items"))
    sets = stored(found.join(members, "set_key").select("node", "items"), "sets")
    sigs = classes.select("node", F.col("n_shingles").alias("n"), "sig")

    def attached(pairs: DataFrame, values: DataFrame) -> DataFrame:
        """Pairs of a table with the values of both nodes, of which a pivot is in many pairs."""
        out, n = pairs, pairs.count()
        for c in "ba":
            own = values.toDF(c, *(f"{v}_{c}" for v in values.columns[1:]))
            out = spread_join(out, own, [c], pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), n, ["a", "b"])
        return out

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs. Sets are compared by functions of the engine, one row at a time, however long they are."""
        pairs = stored(pairs, name, n_rows)
        pairs = stored(attached(pairs, sigs).select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(tidy(_near(limit)), "a long, b long"), name, pairs.count())
        both, n_a, n_b = F.size(F.array_intersect("items_a", "items_b")), F.size("items_a").cast("long"), F.size("items_b").cast("long")
        out = attached(pairs, sets).where(den * F.least(n_a, n_b) >= num * F.greatest(n_a, n_b)).where(den * both >= num * (n_a + n_b - both))
        return stored(out.select("a", "b"), f"{name}-links", pairs.count())

    def open_buckets(found: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        own = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return stored(spread_join(own, several, ["key"], shared, n_rows, ["node"]), "open", n_rows)

    star = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(star, "star")
    found = components(links.toDF("u", "v"), links.count())
    left = open_buckets(found)
    if not left.isEmpty():
        pick = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(2)), "node", "component")).alias("p"))
        pick = pick.select("key", F.col("p.node").alias("a"), F.col("p.component").alias("other"))
        again = spread_join(left, pick, ["key"], shared, n_rows, ["node"]).where("component <> other")
        links = links.unionByName(confirm(again.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "again"))
        found = components(links.toDF("u", "v"), links.count())
        left = open_buckets(found)
    if not left.isEmpty():
        with_sig = left.join(classes.select("node", "n_shingles", "sig"), "node")
        weight = left.join(classes.select("node", "n_shingles"), "node").groupBy("key").agg(F.sum("n_shingles").alias("items"))
        chunks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
        blocks = spread_join(with_sig, weight, ["key"], shared, n_rows, ["node"]).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
        blocks = blocks.withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o"))
        blocks = blocks.select("key", "i", "j", "chunk", "node", "n_shingles", "component", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        members = stored(blocks.mapInArrow(tidy(_block_members(limit)), "key long, i int, j int, chunk int, node long, component long"), "candidates")
        n_members = members.count()
        full = spread_join(members, sets, ["node"], members.groupBy("node").agg(F.count(F.lit(1)).alias("n")), n_members, ["key", "i", "j"])
        full = full.select("key", "i", "j", "chunk", "node", "component", "items").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        linked = full.mapInArrow(tidy(_block_links(num, den)), "a long, b long").distinct()
        links = links.unionByName(stored(linked, "block-links", n_members))
        found = components(links.toDF("u", "v"), links.count())
    own = stored(found.join(classes.select("node", "low"), "node"), "found", n_sets)
    lows = own.groupBy("component").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("n"))
    named = spread_join(own.select("node", "component"), lows, ["component"], lows, own.count(), ["node"]).select("node", "lowest")
    per_set = classes.select("set_key", "copies", "low", "node").join(named, "node", "left")
    return f, stored(per_set.select("set_key", "copies", F.coalesce("lowest", "low").alias("component")), "components", n_sets)


def _rated(f: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n_shingles, component) of all rows; the component is null where a row can have no links."""
    known = f.where("id is not null and set_key is not null").select("id", "n_shingles", "set_key")
    out = spread_join(known, sets, ["set_key"], sets.select("set_key", F.col("copies").alias("n")), f.count(), ["id"]).select("id", "n_shingles", "component")
    return out.unionByName(f.where("id is null or set_key is null").select("id", "n_shingles"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when the Jaccard similarity of their sets of 5-word shingles is at least num / den; component_id is
    the smallest doc_id reachable. Documents with equal sets form a class, so exact copies never meet in pairs. Within a
    band's bucket each member is compared with one pivot, the smallest first and a random one next, which joins most of a
    group by as many pairs as it has members; only buckets that still hold several components are compared in blocks, in
    all pairs of different components, so no candidate goes unseen; a block gives a row per member, not per pair. Keys of many rows, such as a pivot, a bucket or a set
    that a third of all documents hold, are dealt out to many tasks.

    Whole texts count, however long. A null or wordless text has no shingles and links with nothing. A null doc_id has a
    null component_id, links with nothing and is kept. Rows that repeat a doc_id are documents of their own, each with the
    links of its text; equal rows all come back. Sizes that tie with the limit link. Other columns are ignored; an empty
    table gives an empty one.
    """
    f, sets = _grouped(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), num, den)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return _rated(f, sets).select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, nulls last, and of several such rows the one whose
    hash of all columns is least. Here rows without a doc_id are grouped as well, and of equal rows one stays. Rows without
    words all stay, but for equal ones. The columns stay as they are; an empty table gives an empty one."""
    hashes = row_hashes(docs)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), hashes[0].alias("h"), hashes[1].alias("g"))  # no column of docs can clash
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), hashes[0].alias("h"), hashes[1].alias("g"))
    f, sets = _grouped(docs.select(key.alias("id"), "text"), num, den)
    rated = stored(_rated(f, sets).select("id.h", "id.g", (F.col("component").isNotNull() & (F.col("id") != F.col("component"))).alias("gone")), "rated", f.count())
    twice = stored(rated.where("not gone").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g"), "twice", f.count())
    left = own.join(rated.where("gone").select("h", "g").distinct(), ["h", "g"], "left_anti")
    if not twice.isEmpty():
        once = left.join(twice, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.any_value("row").alias("row"))
        left = left.join(twice, ["h", "g"], "left_anti").unionByName(once.select(*left.columns))
    return left.select("row.*")
