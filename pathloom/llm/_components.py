"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import spread_join, stored


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over links (u, v), for each node that has a link to another.

    Each round maps every node to the least of itself and its neighbours and contracts the links by that map. The order
    is that of the numbers in one round, by which a star around its smallest node is gone at once, and that of a hash in
    the next, by which only the local minima of a random order stay, so that a chain, too, shrinks by a constant share.
    The least neighbour is a partial aggregate, so a hub node does not meet in one task. `rows` says how many links there are
    at most, where that is known. Nulls and loops are dropped; an empty table gives an empty one.
    """
    maps = []
    e = stored(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "links", rows)
    rows = e.count()
    while rows:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if len(maps) % 2:
            best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"), F.count(F.lit(1)).alias("n"))
            to = best.select("u", F.when(F.col("m.h") < F.xxhash64("u"), F.col("m.v")).otherwise(F.col("u")).alias("to"), "n")
        else:
            to = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"), F.count(F.lit(1)).alias("n"))
        to = stored(to, "map", 2 * rows)
        maps.append(to.select("u", "to"))
        for k, c in (("u", "a"), ("v", "b")):  # a hub's links are dealt out
            own = to.select(F.col("u").alias(k), F.col("to").alias(c))
            e = spread_join(e, own, [k], to.select(F.col("u").alias(k), "n"), rows, ["u", "v"])
        e = stored(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "links", rows)
        rows = e.count()
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("u").alias("component")).where(F.lit(False))
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    for m in maps[1:]:
        m = m.select(F.col("u").alias("component"), "to")
        out = out.join(m, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = stored(out, "roots", maps[0].count()) if len(maps) > 1 else out
    low = out.groupBy("component").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    return spread_join(out, low, ["component"], low, out.count(), ["node"]).select("node", F.col("low").alias("component"))
