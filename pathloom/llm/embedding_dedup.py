"""Near-duplicate vectors by randomised-rotation binary codes (operator 3).

A unit vector is turned by random rotations, and the signs of the turned coordinates are its code. With the code are
stored the correction factor, the inner product of the turned vector and its code's unit vector, and the turned
coordinates rounded to 16 steps, as four planes of bits. Sums of popcounts of one vector's code with another's planes,
divided by the factor, estimate their cosine without bias, and the factor gives the estimate's error. Runs of code bits
bring pairs together; pairs whose estimate lies further below the limit than the error allows are dropped unseen, and for
the others the vectors are fetched and the cosine is computed again in double precision.

A pair at the limit is lost if it shares no run (MISS) or if its estimate is SIGMAS errors off (about 1e-9).
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import batch_of, spread_join, stored, tidy
from ._components import components
from ._text import U, mix

#: Chance that a pair at the limit shares no run of code bits, and so goes unseen.
MISS = 1e-6
#: Standard errors, at the limit, that an estimate may lie below it.
SIGMAS = 6.0
#: Bits of a code that an estimate rests on at least.
CODE_BITS = 256
#: Members up to which a bucket's pairs are estimated by their codes and looked up one by one. In larger buckets, where
#: nearly all pairs are near the limit, no pair is written: vectors of BLOCK members at a time are compared.
FEW, BLOCK = 48, 1024

_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vec_key", pa.binary()), ("vec", pa.binary())])


def plan(rows: int, limit: float) -> tuple[int, int]:
    """Bits of a run, which grow with the logarithm of the rows, and the number of runs that MISS then asks for."""
    bits = min(40, max(10, math.ceil(math.log2(max(rows, 2))) + 2))
    same = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


@functools.lru_cache(8)
def rotations(dim: int, n_bits: int) -> np.ndarray:
    """Random rotations of `dim` coordinates side by side, n_bits columns at least."""
    g = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(g.standard_normal((dim, dim)))[0] for _ in range(-(-n_bits // dim))], axis=1)


def _vectors(batches):
    """Of each row its numbers as doubles and a hash of them; both null where a row can link with nothing."""
    for batch in batches:
        n, column = batch.num_rows, batch.column("embedding")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten()
        holes = flat.is_null().to_numpy(zero_copy_only=False)
        flat = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        bad = np.concatenate(([0], np.cumsum(holes | ~np.isfinite(flat))))
        known = ~(batch.column("label").is_null().to_numpy(zero_copy_only=False) | batch.column("vec_id").is_null().to_numpy(zero_copy_only=False))
        fit = known & (size > 0) & (bad[at[1:]] == bad[at[:-1]])
        keys, vecs = [None] * n, [None] * n
        for dim in np.unique(size[fit]).tolist():
            rows = np.flatnonzero(fit & (size == dim))
            x = flat[at[rows][:, None] + np.arange(dim)] + 0.0
            with np.errstate(over="ignore"):
                square = np.einsum("ij,ij->i", x, x)
            for i, v in zip(rows[(square > 0) & (square < np.inf)].tolist(), x[(square > 0) & (square < np.inf)]):
                vecs[i] = v.tobytes()
                keys[i] = hashlib.blake2b(vecs[i], digest_size=16).digest()
        yield batch_of(_CODED, batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()))


def encode(x: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n_bits at least, packed), planes (four times CODE_BITS or more, packed) and (factor, lowest, step, sum of
    steps, ones) of the rows of x."""
    dim = x.shape[1]
    own = dim * -(-CODE_BITS // dim)
    turn = rotations(dim, max(n_bits, own))
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    turned = unit @ turn
    code = np.packbits(turned > 0, axis=1)
    r = turned[:, :own] / math.sqrt(own // dim)  # a unit vector of `own` coordinates
    factor = np.abs(r).sum(axis=1) / math.sqrt(own)
    low, high = r.min(axis=1), r.max(axis=1)
    step = np.maximum((high - low) / 15, 1e-12)
    shift = np.random.default_rng(own).random(own)  # rounding up or down by chance leaves no bias
    u = np.clip(np.floor((r - low[:, None]) / step[:, None] + shift), 0, 15).astype(np.uint8)
    planes = np.concatenate([_eights(np.packbits(u >> k & 1, axis=1)) for k in range(4)], axis=1)
    numbers = np.stack([factor, low, step, u.sum(axis=1, dtype=np.int64).astype(float), (r > 0).sum(axis=1).astype(float)], axis=1)
    return code, planes, numbers


def _eights(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as 64-bit numbers."""
    wide = -(-packed.shape[1] // 8) * 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, wide - packed.shape[1])))).view(np.uint64)


def own_words(code: np.ndarray, dim: int) -> np.ndarray:
    """The part of the codes that estimates rest on, as 64-bit numbers."""
    bits = dim * -(-CODE_BITS // dim)
    out = code[:, : -(-bits // 8)].copy()
    out[:, -1] &= np.uint8(0xFF << (-bits % 8) & 0xFF)
    return _eights(out)


def estimate(mine: np.ndarray, planes: np.ndarray, own: np.ndarray, other: np.ndarray, dim: int) -> np.ndarray:
    """Cosines of pairs, a row each, from one's own_words and numbers and the other's planes and numbers."""
    bits, words, dot = dim * -(-CODE_BITS // dim), mine.shape[1], np.zeros(len(mine))
    for k in range(4):
        dot += np.bitwise_count(mine & planes[:, k * words : (k + 1) * words]).sum(axis=1, dtype=np.int64) * float(1 << k)
    factor, ones, low, step, total = own[:, 0], own[:, 4], other[:, 1], other[:, 2], other[:, 3]
    return (2 * step * dot + 2 * low * ones - step * total - bits * low) / (factor * math.sqrt(bits))


def allowance(own: np.ndarray, other: np.ndarray, dim: int, limit: float) -> np.ndarray:
    """How far below the limit the estimate of a pair at it may lie."""
    bits = dim * -(-CODE_BITS // dim)
    factor = np.minimum(own[:, 0], 1)
    spread = (1 - factor**2) / factor**2 * (1 - limit**2) / max(bits - 1, 1)
    return SIGMAS * np.sqrt(spread + other[:, 2] ** 2 / 4 / factor**2) + 1e-9


_CLASSES = pa.schema(
    [("node", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vec_key", pa.binary()), ("low", pa.int64()), ("vec", pa.binary()), ("code", pa.binary()), ("planes", pa.binary()), ("numbers", pa.binary())]
)


def _encoded(n_bits: int):
    def encoded(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                parts = encode(_stack(part.column("vec"), np.float64), n_bits)
                yield batch_of(_CLASSES, *(part.column(c) for c in _CLASSES.names[:7]), *(pa.array([r.tobytes() for r in p], pa.binary()) for p in parts))

    return encoded


def _stack(column, kind) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def run_keys(codes: np.ndarray, bits: int, n_runs: int, label: np.ndarray, dim: int) -> np.ndarray:
    """A bucket key per row and run of bits; label, dimension and run are part of it."""
    flat = np.unpackbits(codes, axis=1)[:, : bits * n_runs].reshape(len(codes), n_runs, bits).astype(np.uint64)
    value = (flat << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    salt = mix(label.astype(np.int64).view(np.uint64) * U(0x9E3779B97F4A7C15) + U(dim))[:, None] + np.arange(n_runs, dtype=np.uint64)
    return mix(value ^ mix(salt)).view(np.int64)


_KEYS = pa.schema([("node", pa.int64()), ("run", pa.int32()), ("key", pa.int64())])


def _keys(bits: int, n_runs: int):
    def keys(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                k = run_keys(_stack(part.column("code"), np.uint8), bits, n_runs, part.column("label").to_numpy(), int(dim))
                yield batch_of(_KEYS, np.repeat(part.column("node").to_numpy(), n_runs), np.tile(np.arange(n_runs, dtype=np.int32), len(k)), k.ravel())

    return keys


def _whole_groups(batches, key: tuple[str, ...], least: int):
    """Record batches of sorted rows, cut only between keys, of `least` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[rows - 1].as_py() for k in key]
        same = np.logical_and.reduce([table.column(k).to_numpy() == v for k, v in zip(key, last)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near_pairs(limit: float, bits: int, n_runs: int):
    """From buckets that lie together in a sorted partition: pairs that may reach the limit, each in the first run that it
    shares. Pairs of many buckets are estimated side by side."""

    def of(batch: pa.RecordBatch, dim: int):
        key = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(starts, len(key)))
        place = np.arange(len(key)) - np.repeat(starts, size)
        later = np.repeat(size, size) - 1 - place  # members after this one
        a = np.repeat(np.arange(len(key)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        node, label, run = batch.column("node").to_numpy(), batch.column("label").to_numpy(), batch.column("run").to_numpy()
        code, planes, numbers = _stack(batch.column("code"), np.uint8), _stack(batch.column("planes"), np.uint64), _stack(batch.column("numbers"), np.float64)
        keys, mine = run_keys(code, bits, n_runs, label, dim), own_words(code, dim)
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            some = estimate(mine[p], planes[q], numbers[p], numbers[q], dim) >= limit - allowance(numbers[p], numbers[q], dim, limit)
            p, q = p[some], q[some]
            first = (keys[p] == keys[q]).argmax(axis=1) == run[p]
            p, q = p[first], q[first]
            yield batch_of(_PAIRS, np.minimum(node[p], node[q]), np.maximum(node[p], node[q]))

    def near_pairs(batches):
        for batch in _whole_groups(batches, ("key",), 4096):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                yield from of(batch if len(np.unique(dims)) == 1 else batch.filter(pa.array(dims == dim)), int(dim))

    return near_pairs


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def linked(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least `limit`: a matrix product says it, but for pairs so near to the
    limit that the order of a sum matters, which `cosines` decides."""
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    got = (a / norm_a[:, None]) @ (b / norm_b[:, None]).T
    out = got >= limit
    i, j = np.nonzero(np.abs(got - limit) < 1e-9)
    out[i, j] = cosines(a[i], b[j]) >= limit
    return out


def _exact(limit: float):
    def exact(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keep = pa.array(cosines(_stack(part.column("vec_a"), np.float64), _stack(part.column("vec_b"), np.float64)) >= limit)
                yield part.select(["a", "b", "copies_a", "copies_b"]).filter(keep)

    return exact


_LINKS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])


def _block_links(limit: float, bits: int, n_runs: int):
    """From blocks that lie together in a sorted partition: for each member its new links' copies and one neighbour."""
    names = ("key", "i", "j", "chunk", "run", "node", "copies", "label", "dim", "vec", "code")

    def of(g: dict) -> pa.RecordBatch | None:
        run, dim = g["run"][0], g["dim"][0]
        ids, copies, chunk = (np.array(g[c], np.int64) for c in ("node", "copies", "chunk"))
        left, right = np.flatnonzero(chunk == g["i"][0]), np.flatnonzero(chunk == g["j"][0])
        if not len(left) or not len(right):
            return None
        x, keys = _stack(g["vec"], np.float64), run_keys(_stack(g["code"], np.uint8), bits, n_runs, np.array(g["label"], np.int64), dim)
        new = linked(x[left], x[right], limit)
        if g["i"][0] == g["j"][0]:
            new &= ids[left][:, None] < ids[right][None, :]
        rows, cols = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
        if not len(rows):
            return None
        sub, p, q = new[np.ix_(rows, cols)], keys[left[rows]], keys[right[cols]]
        for r in range(run):  # a pair counts in the first run that it shares
            sub &= p[:, r][:, None] != q[:, r][None, :]
        n = np.zeros(len(ids), np.int64)
        for own, other, m in ((left[rows], right[cols], sub), (right[cols], left[rows], sub.T)):
            np.add.at(n, own, m.astype(np.int64) @ copies[other])
        label = np.arange(len(ids))  # becomes the first member of each group of linked ones
        li, ri = np.nonzero(sub)
        li, ri = left[rows][li], right[cols][ri]
        while True:
            low = np.minimum(label[li], label[ri])
            before = label.copy()
            np.minimum.at(label, li, low)
            np.minimum.at(label, ri, low)
            label = label[label]
            if (label == before).all():
                break
        some = np.flatnonzero(n)
        return batch_of(_LINKS, ids[some], n[some], ids[label[some]])

    def block_links(batches):
        key, held = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:3] != key:
                    if held and (out := of(held)) is not None:
                        yield out
                    key, held = row[:3], {c: [] for c in names}
                for c, v in zip(names, row):
                    held[c].append(v)
        if held and (out := of(held)) is not None:
            yield out

    return block_links


def near_vectors(vectors: DataFrame, limit: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and length link when their cosine in double precision is at least `limit`, ties included;
    n_links counts the other vectors linked directly, copies included, and component_id is the smallest vec_id reachable.
    Equal vectors of a label form a class that is compared once. A bucket of any size is compared whole, a large one in
    blocks by different tasks that give a row per member and not per pair; a pair that shares several runs of code bits
    counts in the first.

    A vector that is null, empty or zero, holds null or non-finite components, has no label or no vec_id links with
    nothing: its n_links is 0, its component_id its own id, and it is kept. Rows that repeat a vec_id are vectors of their
    own, each with its own links. Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    coded = stored(rows.mapInArrow(tidy(_vectors), "vec_id long, label long, dim int, vec_key binary, vec binary"), "vectors")
    total = coded.count()
    bits, n_runs = plan(total, limit)
    known = coded.where("vec_key is not null")
    classes = known.groupBy("label", "dim", "vec_key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "copies", "label", "dim", "vec_key", "low", "vec")
    classes = stored(classes.mapInArrow(tidy(_encoded(bits * n_runs)), "node long, copies long, label long, dim int, vec_key binary, low long, vec binary, code binary, planes binary, numbers binary"), "classes")
    keys = classes.select("node", "label", "dim", "code").mapInArrow(_keys(bits, n_runs), "node long, run int, key long")
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared", total * n_runs // 2)
    members = stored(spread_join(keys, shared, ["key"], shared, total * n_runs).withColumnRenamed("n", "size"), "members", shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    few = members.where(F.col("size") <= FEW).join(classes.select("node", "label", "dim", "code", "planes", "numbers"), "node")
    few = few.drop("size").repartition("key").sortWithinPartitions("key")
    pairs = stored(few.mapInArrow(tidy(_near_pairs(limit, bits, n_runs)), "a long, b long"), "pairs", members.count() * FEW // 2)
    n_pairs = pairs.count()
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(c), F.col("copies").alias(f"copies_{c}"), F.col("vec").alias(f"vec_{c}"), *(["dim"] if c == "a" else [])), c)
    links = stored(pairs.select("dim", "a", "b", "copies_a", "copies_b", "vec_a", "vec_b").mapInArrow(_exact(limit), "a long, b long, copies_a long, copies_b long"), "links", n_pairs)
    found = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("copies_a").alias("n"), F.col("a").alias("to")))
    many = members.where(F.col("size") > FEW)
    if not many.isEmpty():
        chunks = F.ceil(F.col("size") / BLOCK).cast("int")
        blocks = many.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
        blocks = blocks.select("key", "run", "node", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk").join(classes.select("node", "copies", "label", "dim", "vec", "code"), "node")
        blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = found.unionByName(stored(blocks.mapInArrow(tidy(_block_links(limit, bits, n_runs)), "node long, n long, to long"), "links"))
    n = found.groupBy("node").agg(F.sum("n").alias("n"))
    part = stored(components(found.select(F.col("node").alias("u"), F.col("to").alias("v"))).join(classes.select("node", "low"), "node"), "parts", total)
    lowest = part.groupBy("component").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("n"))
    part = spread_join(part.select("node", "component"), lowest, ["component"], lowest, total, ["node"]).select("node", "lowest")
    per_class = classes.select("label", "vec_key", "node", "low", "copies").join(n, "node", "left").join(part, "node", "left")
    per_class = stored(per_class.select("label", "vec_key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("lowest", "low").alias("component")), "per-class", total)
    own = spread_join(known.select("vec_id", "label", "vec_key"), per_class.drop("copies"), ["label", "vec_key"], per_class.select("label", "vec_key", F.col("copies").alias("n")), total, ["vec_id"])
    out = own.select("vec_id", "n", "component").unionByName(coded.where("vec_key is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
