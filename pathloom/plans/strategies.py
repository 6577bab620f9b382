"""Extension points: estimates, ways to reach, and whole algorithms by name.

An algorithm prepares a map once and then answers problems; a relation says what reaches what directly, connects points to
others and refines a step of it. Callers add their own to the tables below.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S


class Algorithm(Protocol):
    """preprocess: what is kept of a map of cells (x, y). query: (id, cost) of problems (id, source, target)."""

    def preprocess(self, cells: DataFrame) -> dict[str, DataFrame]: ...

    def query(self, prepared: dict[str, DataFrame], problems: DataFrame) -> DataFrame: ...


class Reachability(Protocol):
    """connect: (source, node, cost) of what sources reach directly. refine: the unit steps (id, k, i, x, y) of moves (id, k,
    x1, y1, x2, y2). reachable: (id, reachable) of problems (id, source, target)."""

    def connect(self, arcs: DataFrame, sources: DataFrame) -> DataFrame: ...

    def refine(self, moves: DataFrame) -> DataFrame: ...

    def reachable(self, arcs: DataFrame, problems: DataFrame) -> DataFrame: ...


class Freespace:
    """Reaches a node by a path as long as the octile distance."""

    def connect(self, arcs: DataFrame, sources: DataFrame) -> DataFrame:
        from ..operators.hierarchies import freespace

        return freespace(arcs, sources)

    def refine(self, moves: DataFrame) -> DataFrame:
        from ..operators.paths import refined

        return refined(moves)

    def reachable(self, arcs: DataFrame, problems: DataFrame) -> DataFrame:
        from ..operators.hierarchies import h_reachable

        return h_reachable(problems, arcs)


class _Own:
    """An algorithm of two functions."""

    def __init__(self, preprocess: Callable[[DataFrame], dict[str, DataFrame]], query: Callable[[dict[str, DataFrame], DataFrame], DataFrame]) -> None:
        self.preprocess, self.query = preprocess, query


def _arcs(cells: DataFrame) -> dict[str, DataFrame]:
    from ..operators.paths import numbered
    from .search import scratch

    return {"cells": cells, "arcs": scratch(numbered(cells))}


def _with_subgoals(cells: DataFrame) -> dict[str, DataFrame]:
    from ..operators import grid
    from ..operators.paths import node

    return _arcs(cells) | {"subgoals": grid.subgoals(cells).select(node("x", "y").alias("source"))}


def _astar(prepared: dict[str, DataFrame], problems: DataFrame) -> DataFrame:
    from ..operators.paths import solved

    return solved(problems, prepared["arcs"]).select("id", "cost")


def _jumps(prepared: dict[str, DataFrame], problems: DataFrame) -> DataFrame:
    from ..operators.paths import WIDTH, jump_point_costs

    at = lambda c: (F.col(c) % WIDTH, F.expr(f"{c} div {WIDTH}"))
    p = problems.select("id", at("source")[0].alias("sx"), at("source")[1].alias("sy"), at("target")[0].alias("gx"), at("target")[1].alias("gy"))
    return jump_point_costs(prepared["cells"], p)


def _subgoals(prepared: dict[str, DataFrame], problems: DataFrame) -> DataFrame:
    from ..operators.hierarchies import subgoal_costs

    return subgoal_costs(problems, prepared["subgoals"], prepared["arcs"]).select("id", "cost")


def _clusters(prepared: dict[str, DataFrame], problems: DataFrame) -> DataFrame:
    from ..operators.hierarchies import cluster_costs

    return cluster_costs(problems, prepared["cells"])


#: Estimates of the distance between two points, as columns x1, y1, x2, y2.
HEURISTICS: dict[str, Callable[..., Column]] = {"zero": lambda *at: F.lit(0), "infinite": lambda *at: F.lit(S.INFINITE), "manhattan": S.manhattan, "octile": S.octile, "octile_graph": S.octile_graph, "euclidean": S.euclidean}
ALGORITHMS: dict[str, Algorithm] = {"astar": _Own(_arcs, _astar), "jumps": _Own(_arcs, _jumps), "subgoals": _Own(_with_subgoals, _subgoals), "clusters": _Own(_arcs, _clusters)}
RELATIONS: dict[str, Reachability] = {"freespace": Freespace()}


def compared(problems: DataFrame, cells: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(algorithm, id, cost) of each algorithm on the same problems, where there is a path."""
    out = None
    for name in names or sorted(ALGORITHMS):
        algorithm = ALGORITHMS[name]
        rows = algorithm.query(algorithm.preprocess(cells), problems).where("cost is not null").select(F.lit(name).alias("algorithm"), "id", "cost")
        out = rows if out is None else out.unionByName(rows)
    return out
