"""Distances, geometry and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the square root of two: fixed-point, as a widened float, of one graph library, and of path scores.
ROOT2_FIXED, ROOT2_FLOAT, ROOT2_GRAPH, ROOT2_SCORE = 14142, 1.414213562, 1.414121356, 1.4142
EPSILON = 1e-8


def spans(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return F.abs(x1 - x2), F.abs(y1 - y2)


def manhattan(*at: Column, unit: int = 10000) -> Column:
    dx, dy = spans(*at)
    return (dx + dy) * unit


def octile(*at: Column, straight: int | float = 10000, diagonal: int | float = ROOT2_FIXED) -> Column:
    dx, dy = spans(*at)
    return F.least(dx, dy) * diagonal + (F.greatest(dx, dy) - F.least(dx, dy)) * straight


def octile_graph(*at: Column) -> Column:
    """The longer side and a fixed part of the shorter."""
    dx, dy = spans(*at)
    return F.greatest(dx, dy) + F.least(dx, dy) * (ROOT2_GRAPH - 1)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 for a turn to the left at b, -1 to the right, 0 on a line."""
    c = cross(bx - ax, by - ay, cx - bx, cy - by)
    return F.when(F.abs(c) < EPSILON, 0).when(c > 0, 1).otherwise(-1)


def line_times(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column]:
    """Where lines ab and cd meet, as shares of ab and of cd; null for parallel lines."""
    below = cross(bx - ax, by - ay, dx - cx, dy - cy)
    below = F.when(F.abs(below) >= EPSILON, below)
    return F.try_divide(cross(cx - ax, cy - ay, dx - cx, dy - cy), below), F.try_divide(cross(cx - ax, cy - ay, bx - ax, by - ay), below)


def reflected(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """The mirror image of p over the line ab; null where a = b."""
    wx, wy = bx - ax, by - ay
    t = F.try_divide((px - ax) * wx + (py - ay) * wy, wx * wx + wy * wy)
    return 2 * (ax + t * wx) - px, 2 * (ay + t * wy) - py


def twice_area(points: Column) -> Column:
    """Shoelace sum of an array of structs with x and y."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, nxt, lambda a, b: cross(a["x"], a["y"], b["x"], b["y"])), F.lit(0.0), lambda s, v: s + v)


def round_to_nearest(x: Column, step: float) -> Column:
    """The multiple of step nearest to x; half goes away from zero."""
    return ((x + F.signum(x) * step / 2) / step).cast("long") * step


def unwrapped_seconds(start: Column, end: Column, day: int = 86400) -> Column:
    """Seconds from start to end of day clocks, where an end before the start is on the next day."""
    return F.when(end < start, end - start + day).otherwise(end - start)


def direction(dx: Column, dy: Column) -> Column:
    """One-hot flag of a move's direction: N 1, S 2, E 4, W 8, NE 16, NW 32, SE 64, SW 128, 0 for none."""
    return (
        F.when((dx == 0) & (dy < 0), 1).when((dx == 0) & (dy > 0), 2).when((dx > 0) & (dy == 0), 4).when((dx < 0) & (dy == 0), 8)
        .when((dx > 0) & (dy < 0), 16).when((dx < 0) & (dy < 0), 32).when((dx > 0) & (dy > 0), 64).when((dx < 0) & (dy > 0), 128).otherwise(0)
    )


#: Patterns of map names and the benchmark each stands for; a later rule wins, and a name that none fits has "".
BENCHMARK_RULES = [("^[A-Z]", "sc"), ("^[a-z]+[0-9]+[a-z]*.map", "dao"), ("^[a-z]+_", "da2"), ("maze", "maze"), ("random", "random"), ("room", "room")]


def benchmark_label(name: Column, rules: list[tuple[str, str]] = BENCHMARK_RULES, other: str = "") -> Column:
    out = F.lit(other)
    for pattern, label in rules:
        out = F.when(name.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


#: Empty rows before and after a padded map, and the bits that a padded row is a multiple of.
PADDED_ROWS, PADDED_BITS = 3, 32


def padded_width(width: int) -> int:
    """Columns of a map whose rows have one empty column at least and fill whole words."""
    return width + 1 if (width + 1) % PADDED_BITS == 0 else (width // PADDED_BITS + 1) * PADDED_BITS


def padded_id(cell: Column, width: int) -> Column:
    wide = padded_width(width)
    return cell + PADDED_ROWS * wide + F.floor(cell / width) * (wide - width)


def unpadded_xy(padded: Column, width: int) -> tuple[Column, Column]:
    wide = padded_width(width)
    own = padded - PADDED_ROWS * wide
    return own % wide, F.floor(own / wide)


def linear3(x: Column, y: Column, z: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """The number of a point of a box, z fastest."""
    _, ny, nz = (b - a + 1 for a, b in zip(low, high))
    return ((x - low[0]) * ny + (y - low[1])) * nz + (z - low[2])


def unlinear3(n: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    _, ny, nz = (b - a + 1 for a, b in zip(low, high))
    return F.floor(n / (ny * nz)) + low[0], F.floor(n % (ny * nz) / nz) + low[1], n % nz + low[2]


#: Fixed value: the distance that stands for infinite, a tenth of the largest double.
INFINITE = 1.7976931348623157e307


def rounded_cost(cost: Column) -> Column:
    """A fixed-point cost of 10000 to the unit as tenths, half up."""
    return F.floor((cost + 500) / 1000) / 10


def through_row(rx: Column, ry: Column, row: Column, left: Column, right: Column, tx: Column, ty: Column) -> Column:
    """Length from a root over a point of an interval on a row to a target, which is mirrored if it lies on the root's side:
    straight if that line meets the interval, else over the nearer end."""
    ty = F.when(((ry < row) & (ty < row)) | ((ry > row) & (ty > row)), 2 * row - ty).otherwise(ty)
    up, down = F.abs(ry - row), F.abs(ty - row)
    # where a line through an end meets the target's row; on the interval's own row the root's column decides
    low = F.when(up > 0, left - F.try_divide(down * (rx - left), up)).otherwise(F.when(rx < left, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    high = F.when(up > 0, right + F.try_divide(down * (right - rx), up)).otherwise(F.when(rx > right, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    over = lambda x: euclidean(rx, ry, x, row) + euclidean(x, row, tx, ty)
    return F.when(tx + 1e-7 < low, over(left)).when(tx > high + 1e-7, over(right)).otherwise(euclidean(rx, ry, tx, ty))


def through_edge(rx: Column, ry: Column, lx: Column, ly: Column, qx: Column, qy: Column, gx: Column, gy: Column) -> Column:
    """Length from a root over a point of the edge from l to q to a goal, which is mirrored if it lies on the root's side."""
    ex, ey = qx - lx, qy - ly
    same = (cross(rx - lx, ry - ly, ex, ey) > 0) == (cross(gx - lx, gy - ly, ex, ey) > 0)
    mx, my = reflected(gx, gy, lx, ly, qx, qy)
    hx, hy = F.when(same, mx).otherwise(gx), F.when(same, my).otherwise(gy)
    below = cross(hx - rx, hy - ry, ex, ey)
    share = F.try_divide(cross(hx - lx, hy - ly, rx - lx, ry - ly), F.when(F.abs(below) >= EPSILON, below))
    left, right = euclidean(rx, ry, lx, ly) + euclidean(lx, ly, hx, hy), euclidean(rx, ry, qx, qy) + euclidean(qx, qy, hx, hy)
    at_end = ((rx == lx) & (ry == ly)) | ((rx == qx) & (ry == qy))
    nearer = F.when(euclidean(rx, ry, lx, ly) < euclidean(rx, ry, qx, qy), left).otherwise(right)
    return F.when(at_end, euclidean(rx, ry, gx, gy)).when(share.isNull(), nearer).when(share < -EPSILON, left).when(share > 1 + EPSILON, right).otherwise(euclidean(rx, ry, hx, hy))


def intervals_equal(left: Column, right: Column, row: Column, left2: Column, right2: Column, row2: Column, eps: float = 1e-7) -> Column:
    return (F.abs(left - left2) < eps) & (F.abs(right - right2) < eps) & (row == row2)


def interval_covers(left: Column, right: Column, row: Column, left2: Column, right2: Column, row2: Column) -> Column:
    return intervals_equal(left, right, row, left2, right2, row2) | ((left <= left2) & (right >= right2) & (row == row2))


def interval_contains(left: Column, right: Column, row: Column, x: Column, y: Column, eps: float = 1e-7) -> Column:
    return (y.cast("int") == row) & (x + eps >= left) & (x <= right + eps)
