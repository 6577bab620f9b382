"""Centroid clustering by delta Lloyd rounds (operator 11).

The state is a table of vectors, each with its owner and the distance to it, and the sums and counts of all clusters. A
round compares a vector only with the centroids that changed; a vector whose own centroid is among them is compared with
all. Each vector that then changes its owner takes its components from one sum and adds them to another; these signed
transfers are summed within each task and then over tasks, and the centroids follow from the sums. All arithmetic is on
whole numbers: in doubles or 64 bits where they hold every sum, in Python's numbers beyond.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import batch_of, discard, stored, tidy

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Magnitudes below which products of doubles, and of 64-bit numbers, are exact for vectors of up to 256 components.
DOUBLES, LONGS = 1 << 21, 1 << 26
#: Sums travel as digits to this base, so that any size is summed exactly.
DIGIT = 32

_TRANSFERS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])
_STATE = "vec_id long, v binary, cluster int, was int, distance long"


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite x."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


def _packed(components: int, scale: int):
    """Vectors of finite components as whole numbers: of 32 bits each, or the doubles themselves where these do not do."""
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def packed(batches):
        for batch in batches:
            column = batch.column("embedding")
            fit = pc.fill_null(pc.equal(pc.list_value_length(column), components), False)
            ids, column = batch.column("vec_id").filter(fit), column.filter(fit)
            x = pc.fill_null(pc.list_flatten(column), float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, components)
            fine = np.isfinite(x).all(axis=1)
            x, ids = x[fine], ids.filter(pa.array(fine))
            small = (np.abs(x) < LONGS / scale).all(axis=1)
            whole = np.floor(np.where(small[:, None], x, 0) * scale).astype("<i4")
            yield batch_of(out, ids, [(w if s else d).tobytes() for w, d, s in zip(whole, x.astype("<f8"), small)])

    return packed


def _parts(column: pa.Array, components: int, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the small and of the large vectors of a column."""
    values = column.to_pylist()
    large = np.array([len(v) > 4 * components for v in values], bool)
    small = np.frombuffer(b"".join(v for v, big in zip(values, large) if not big), "<i4").reshape(-1, components).astype(np.int64)
    out = [(np.flatnonzero(~large), small)]
    if large.any():
        rows = [[_whole(x, scale) for x in np.frombuffer(values[i], "<f8")] for i in np.flatnonzero(large)]
        out.append((np.flatnonzero(large), np.array(rows, object)))
    return [(at, x) for at, x in out if len(at)]


def _unpacked(v: bytes, components: int, scale: int) -> list[int]:
    return [int(x) for x in _parts(pa.array([v], pa.binary()), components, scale)[0][1][0]]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of x and of c."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if top < DOUBLES:
        f, g = x.astype(float), c.astype(float)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    kind = np.int64 if top < LONGS else object
    x, c = x.astype(kind), c.astype(kind)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _assigned(centroids: list[list[int]], changed: list[int], components: int, scale: int):
    """Owners after the centroids in `changed` have moved. Of equal distances the smaller number wins."""
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("distance", pa.int64())])
    big = max((abs(x) for c in centroids for x in c), default=0) >= LONGS

    def assigned(batches):
        c = np.array(centroids, object if big else np.int64)
        moved = np.isin(np.arange(len(c)), changed)
        for batch in batches:
            n = batch.num_rows
            was = pc.fill_null(batch.column("cluster"), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            known = batch.column("distance").is_valid().to_numpy(zero_copy_only=False)
            kept = pc.fill_null(batch.column("distance"), 0).to_numpy(zero_copy_only=False)
            owner, distance = was.copy(), [None] * n
            anew = (was < 0) | ~known | moved[was]
            for at, x in _parts(batch.column("v"), components, scale):
                some = anew[at]
                if some.any():
                    d = distances(x[some], c)
                    best = d.argmin(axis=1)
                    owner[at[some]] = best
                    for i, value in zip(at[some].tolist(), d[np.arange(len(best)), best].tolist()):
                        distance[i] = value
                if not some.all():
                    rows = at[~some]
                    own, value = was[rows], kept[rows]
                    if changed:
                        d = distances(x[~some], c[changed])
                        near = d.argmin(axis=1)
                        least, number = d[np.arange(len(near)), near], np.array(changed)[near]
                        take = (least < value) | ((least == value) & (number < own))
                        own, value = np.where(take, number, own), np.where(take, least, value)
                    owner[rows] = own
                    for i, v in zip(rows.tolist(), value.tolist()):
                        distance[i] = v
            yield batch_of(out, batch.column("vec_id"), batch.column("v"), owner.astype(np.int32), pa.array(was, pa.int32(), mask=was < 0), [v if v < 1 << 63 else None for v in distance])

    return assigned


def _digits(value: int) -> list[tuple[int, int]]:
    out, sign, value, place = [], -1 if value < 0 else 1, abs(value), 0
    while value:
        if low := value & ((1 << DIGIT) - 1):
            out.append((place, sign * low))
        value, place = value >> DIGIT, place + 1
    return out


def _transfers(k: int, components: int, scale: int):
    """What a task's moved vectors take from and add to each cluster's count (component -1) and sums."""

    def transfers(batches):
        sums, counts = np.zeros((k, components), object), [0] * k
        for batch in batches:
            sides = [(1, batch.column("cluster")), (-1, batch.column("was"))]
            sides = [(sign, pc.fill_null(owner, -1).to_numpy(zero_copy_only=False)) for sign, owner in sides]
            for at, x in _parts(batch.column("v"), components, scale):
                for sign, owner in sides:
                    for j in np.unique(owner[at][owner[at] >= 0]).tolist():
                        rows = x[owner[at] == j]
                        sums[j] += sign * rows.sum(axis=0).astype(object)
                        counts[j] += sign * len(rows)
        rows = [(j, -1, *d) for j in range(k) for d in _digits(counts[j])]
        rows += [(j, i, *d) for j in range(k) for i in range(components) for d in _digits(int(sums[j, i]))]
        if rows:
            yield batch_of(_TRANSFERS, *zip(*rows))

    return transfers


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `components` components, none of them null or not finite; a component x becomes floor(scale * x).
    The first centroids are the vectors of least sha256 of seed:vec_id; of vectors that share an id, the least bytes come
    first, and null ids come last. Of fewer vectors than `clusters` each is a centroid. Clusters without vectors keep their
    centroid, equal distances go to the smaller number, and repeated rows are vectors of their own.

    Arithmetic is exact at any magnitude. A distance or an inertia that passes 64 bits has no long and is null. Other columns
    are ignored; an empty table gives an empty one. Vectors are never shuffled: each round writes the state anew and deletes
    the one before. To the driver go the first centroids and the transfers' totals, of clusters times components digits each.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = stored(own.mapInArrow(tidy(_packed(components, scale)), "vec_id long, v binary"), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = held.orderBy(place.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = [_unpacked(bytes(r.v), components, scale) for r in first]
    k = len(centroids)
    sums, counts = [[0] * components for _ in range(k)], [0] * k
    changed, names = list(range(k)), ["vec_id", "v", "cluster", "was", "distance"]
    state = held.select("vec_id", "v", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("was", "int"), ("distance", "long"))))
    before = held
    for turn in range(rounds + 1):
        state = stored(state.select(names).mapInArrow(tidy(_assigned(centroids, changed, components, scale)), _STATE), "owners")
        discard(before)
        before = state
        if turn == rounds:
            break
        moved = state.where(~F.col("cluster").eqNullSafe(F.col("was"))).select("v", "cluster", "was")
        parts = moved.mapInArrow(tidy(_transfers(k, components, scale)), "cluster int, component int, digit int, value long")
        totals = parts.groupBy("cluster", "component", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        for r in stored(totals, "transfers", k * (components + 1)).collect():
            value = int(r.value) << DIGIT * r.digit
            if r.component < 0:
                counts[r.cluster] += value
            else:
                sums[r.cluster][r.component] += value
        new = [[s // n for s in row] if n else c for row, n, c in zip(sums, counts, centroids)]
        changed = [j for j in range(k) if new[j] != centroids[j]]
        centroids = new
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: None if r.own is None else int(r.own) for r in state.groupBy("cluster").agg(total.alias("own")).collect()}  # a row per cluster
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    every = None if None in per.values() else sum(per.values())
    rows = [(j, fits(own), fits(every), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, own in per.items()]
    ends = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
