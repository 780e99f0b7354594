"""Spatial join of points, lines and polygons by quadtree cells.

The square around all geometries is divided by four, and again. A polygon or line is
covered by at most about ``BUDGET`` cells: the largest cell that its border passes is
divided until the budget is spent, so a country costs as many cells as a house. Cells
wholly inside a polygon are marked: a point in one needs no further test. Two geometries
can only meet if a cell of one is, or lies in, a cell of the other, which is an equi-join
on (level, column, row) after each side adds the cells above its own. A point lies in one
cell, so it meets a polygon at most once; other pairs are made distinct, and decided by
segment intersection and ray casting on coordinates in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 16
BUDGET = 64
CELLS_AT_ONCE = 500_000  # segment pairs in memory
SHAPES = 1_000  # shapes covered at once

_KIND = re.compile(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\b", re.I)
_PART = re.compile(r"\(([^()]+)\)")


def parse(wkt: str | None):
    """(kind, parts): 0 points, 1 lines, 2 polygons; a part is an array of points, polygon
    rings closed. None for other text."""
    found = _KIND.match(wkt or "")
    if not found:
        return None
    kind = ("POINT", "LINESTRING", "POLYGON").index(found.group(2).upper())
    parts = []
    for text in _PART.findall(wkt):
        try:
            xy = np.array([[float(v) for v in p.replace("(", " ").split()[:2]] for p in text.split(",")])
        except ValueError:
            return None
        if xy.ndim != 2 or xy.shape[1] != 2:
            return None
        if kind == 2 and (xy[0] != xy[-1]).any():
            xy = np.concatenate([xy, xy[:1]])
        parts.append(xy)
    return (kind, parts) if parts else None


def segments(shape) -> np.ndarray:
    """(n, 4): the segments of a shape; a point is a segment of no length."""
    kind, parts = shape
    if kind == 0:
        xy = np.concatenate(parts)
        return np.concatenate([xy, xy], axis=1)
    return np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) if len(p) > 1 else np.concatenate([p, p], axis=1) for p in parts])


def inside(shape, xy: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings of a polygon (points on the border: either)."""
    s = segments(shape)
    x, y = xy[:, :1], xy[:, 1:]
    straddles = (s[:, 1] > y) != (s[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = x < (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1]) + s[:, 0]
    return (straddles & crosses).sum(axis=1) % 2 == 1


def _side(a, b, c):
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def crossings(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(meet, cross) for each pair of segments: they share a point; they cross inside both."""
    p, q, r, u = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    a, b, c, d = _side(p, q, r), _side(p, q, u), _side(r, u, p), _side(r, u, q)
    boxes = ((np.minimum(p, q) <= np.maximum(r, u)) & (np.minimum(r, u) <= np.maximum(p, q))).all(axis=-1)
    return boxes & (a * b <= 0) & (c * d <= 0), (a * b < 0) & (c * d < 0)


def on_border(shape, xy: np.ndarray) -> np.ndarray:
    return crossings(np.concatenate([xy, xy], axis=1), segments(shape))[0].any(axis=1)


def related(left, right, relation: str) -> bool:
    """``intersects``: a common point; ``within``: every point of left is one of right, and
    not on its border alone; ``contains``: the reverse."""
    if left is None or right is None:
        return False
    if relation == "contains":
        return related(right, left, "within")
    s, t = segments(left), segments(right)
    meet, cross = crossings(s, t)
    if relation == "intersects":
        return bool(meet.any() or (right[0] == 2 and inside(right, s[:1, :2]).any()) or (left[0] == 2 and inside(left, t[:1, :2]).any())
                    or any(inside(right, p[:1]).any() for p in left[1] if right[0] == 2) or any(inside(left, p[:1]).any() for p in right[1] if left[0] == 2))
    if right[0] < 2:
        if left[0] > right[0]:
            return False
        return bool(meet.any(axis=1).all()) and not cross.any()
    if cross.any():
        return False
    points = np.concatenate([s[:, :2], (s[:, :2] + s[:, 2:]) / 2])
    is_in, border = inside(right, points), on_border(right, points)
    if not (is_in | border).all() or (border.all() and left[0] < 2):
        return False
    # a hole of right that lies in a polygon left
    return left[0] < 2 or not any((inside(left, p[:-1]) & ~on_border(left, p[:-1])).any() for p in right[1][1:])


def _pairs(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j): for every group k all i below n[k] with all j below m[k]."""
    group = np.repeat(np.arange(len(n)), n * m)
    at = np.arange(len(group)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return group, at // m[group], at % m[group]


class Shapes:
    """Shapes laid out one after the other: their segments and the first points of their parts."""

    def __init__(self, shapes: list):
        parts = [segments(x) for x in shapes]
        self.s = np.concatenate(parts) if parts else np.zeros((0, 4))
        self.n = np.array([len(x) for x in parts], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.area = np.array([x[0] == 2 for x in shapes], bool)
        firsts = [np.array([p[0] for p in x[1]]) for x in shapes]
        self.first = np.concatenate(firsts) if firsts else np.zeros((0, 2))
        self.n_first = np.array([len(x) for x in firsts], np.int64)
        self.at_first = np.cumsum(self.n_first) - self.n_first

    def hold(self, which: np.ndarray, xy: np.ndarray) -> np.ndarray:
        """Even-odd rule: whether the polygon of each number holds the point of its row."""
        group, j, _ = _pairs(self.n[which], np.ones(len(which), np.int64))
        s, x, y = self.s[self.at[which][group] + j], xy[group, 0], xy[group, 1]
        straddles = (s[:, 1] > y) != (s[:, 3] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = x < (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1]) + s[:, 0]
        return np.bincount(group[straddles & crosses], minlength=len(which)) % 2 == 1


def _begins_in(a: Shapes, i: np.ndarray, b: Shapes, j: np.ndarray) -> np.ndarray:
    """Whether a part of a's shape begins in b's polygon."""
    got = np.zeros(len(i), bool)
    at = np.flatnonzero(b.area[j])
    group, k, _ = _pairs(a.n_first[i[at]], np.ones(len(at), np.int64))
    held = b.hold(j[at][group], a.first[a.at_first[i[at]][group] + k])
    got[at[group[held]]] = True
    return got


def intersecting(a: Shapes, i: np.ndarray, b: Shapes, j: np.ndarray) -> np.ndarray:
    """``related(…, "intersects")`` of a's shapes i with b's shapes j, runs of pairs at a time."""
    out = np.zeros(len(i), bool)
    done = np.cumsum(a.n[i] * b.n[j]) // CELLS_AT_ONCE
    for run in np.split(np.arange(len(i)), np.flatnonzero(np.diff(done)) + 1):
        x, y = i[run], j[run]
        group, k, m = _pairs(a.n[x], b.n[y])
        s, t = a.s[a.at[x][group] + k], b.s[b.at[y][group] + m]
        p, q, r, u = s[:, :2], s[:, 2:], t[:, :2], t[:, 2:]
        meet = ((np.minimum(p, q) <= np.maximum(r, u)) & (np.minimum(r, u) <= np.maximum(p, q))).all(axis=1)
        meet &= (_side(p, q, r) * _side(p, q, u) <= 0) & (_side(r, u, p) * _side(r, u, q) <= 0)
        out[run] = (np.bincount(group[meet], minlength=len(run)) > 0) | _begins_in(a, x, b, y) | _begins_in(b, y, a, x)
    return out


def _meets_box(s: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which segments pass the box of their row (its border counts)."""
    near = ((np.minimum(s[:, 0], s[:, 2]) <= x1) & (np.maximum(s[:, 0], s[:, 2]) >= x0)
            & (np.minimum(s[:, 1], s[:, 3]) <= y1) & (np.maximum(s[:, 1], s[:, 3]) >= y0))
    corners = np.stack([np.stack([x, y], axis=-1) for x in (x0, x1) for y in (y0, y1)], axis=1)
    side = _side(s[:, None, :2], s[:, None, 2:], corners)
    return near & (side.min(axis=1) <= 0) & (side.max(axis=1) >= 0)


def covers(shapes: list, frame: tuple[float, float, float], budget: int = BUDGET, levels: int = LEVELS) -> list[np.ndarray]:
    """(shape, level, column, row, wholly inside), an array each: disjoint cells that hold
    the shapes. All shapes go down level by level; one stops where the next level could
    pass its budget."""
    x0, y0, size = frame
    laid = Shapes(shapes)
    owner, ci, cj = np.arange(len(shapes)), np.zeros(len(shapes), np.int64), np.zeros(len(shapes), np.int64)
    cell, seg = np.repeat(owner, laid.n), np.arange(len(laid.s))  # the segments that each cell may hold
    spent = np.zeros(len(shapes), np.int64)
    out = []
    for level in range(levels + 1):
        side = size / (1 << level)
        x, y = x0 + ci * side, y0 + cj * side
        held = _meets_box(laid.s[seg], x[cell], y[cell], x[cell] + side, y[cell] + side)
        cell, seg = cell[held], seg[held]
        border = np.bincount(cell, minlength=len(owner)) > 0
        free = np.flatnonzero(~border & laid.area[owner])
        free = free[laid.hold(owner[free], np.stack([x[free] + side / 2, y[free] + side / 2], axis=1))]
        spent += np.bincount(owner[free], minlength=len(shapes))
        active = np.bincount(owner[border], minlength=len(shapes))
        divided = border & ((spent + 4 * active <= budget) & (level < levels))[owner]
        for at, inner in ((free, True), (np.flatnonzero(border & ~divided), False)):
            out.append([owner[at], np.full(len(at), level), ci[at], cj[at], np.full(len(at), inner)])
        spent += np.bincount(owner[border & ~divided], minlength=len(shapes))
        # four cells for each divided one
        number = np.cumsum(divided) - 1
        kept = divided[cell]
        cell, seg = number[cell[kept]], seg[kept]
        cell, seg = (4 * cell[:, None] + np.arange(4)).ravel(), np.repeat(seg, 4)
        owner, four = np.repeat(owner[divided], 4), np.tile(np.arange(4), int(divided.sum()))
        ci, cj = 2 * np.repeat(ci[divided], 4) + four // 2, 2 * np.repeat(cj[divided], 4) + four % 2
        if not len(owner):
            break
    return [np.concatenate(c) for c in zip(*out)]


def cover(shape, frame: tuple[float, float, float], budget: int = BUDGET, levels: int = LEVELS) -> list[tuple]:
    """(level, column, row, wholly inside) of disjoint cells that hold the shape."""
    return list(zip(*(c.tolist() for c in covers([shape], frame, budget, levels)[1:])))


CELLS = "id long, level int, ci long, cj long, sure boolean, own boolean"


_POINT = re.compile(r"\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", re.I)
NAMES = ["id", "level", "ci", "cj", "sure", "own"]


def _cells(frame, budget: int, above_at: list[int], deepest: int = LEVELS):
    """Cells of every shape, down to the level ``deepest``, and the cells above them at the
    levels ``above_at``."""
    x0, y0, size = frame
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def points(ids: list[int], xy: np.ndarray):
        at = np.clip(((xy - [x0, y0]) / size * (1 << LEVELS)).astype(np.int64), 0, (1 << LEVELS) - 1)
        for level in sorted({LEVELS, *above_at}):
            own = level == LEVELS
            yield [np.array(ids), np.full(len(ids), level, np.int32), at[:, 0] >> (LEVELS - level), at[:, 1] >> (LEVELS - level),
                   np.zeros(len(ids), bool), np.full(len(ids), own)]

    def others(ids: list[int], shapes: list):
        shape, level, ci, cj, sure = covers(shapes, frame, budget, deepest)
        ids = np.array(ids)
        yield [ids[shape], level, ci, cj, sure, np.ones(len(shape), bool)]
        for k in above_at:
            below = level > k
            up = level[below] - k
            packed = np.unique((shape[below] << 2 * LEVELS) | ((ci[below] >> up) << LEVELS) | (cj[below] >> up))
            no, last = np.zeros(len(packed), bool), (1 << LEVELS) - 1
            yield [ids[packed >> 2 * LEVELS], np.full(len(packed), k), (packed >> LEVELS) & last, packed & last, no, no]

    def run(batches):
        for batch in batches:
            ids, xy, other, shapes = [], [], [], []
            for i, wkt in zip(batch.column("id").to_pylist(), batch.column("wkt").to_pylist()):
                shape = parse(wkt)
                if shape is None:
                    continue
                if _POINT.match(wkt):
                    ids.append(i)
                    xy.append(shape[1][0][0])
                else:
                    other.append(i)
                    shapes.append(shape)
            found = list(points(ids, np.array(xy))) if ids else []
            for at in range(0, len(shapes), SHAPES):
                found += others(other[at:at + SHAPES], shapes[at:at + SHAPES])
            for columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

    return run


def _boxes(batches):
    for batch in batches:
        xy = [np.concatenate(s[1]) for s in map(parse, batch.column("wkt").to_pylist()) if s]
        if xy:
            every = np.concatenate(xy)
            every = every[np.isfinite(every).all(axis=1)]
            if len(every):
                low, high = every.min(axis=0), every.max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (*low, *high)], names=["x0", "y0", "x1", "y1"])


def _decide(relation: str):
    def run(batches):
        for batch in batches:
            known: dict = {}
            sure = batch.column("sure").to_numpy(zero_copy_only=False).astype(bool)
            ask = np.flatnonzero(~sure)
            sides = [batch.column(c).take(pa.array(ask)).to_pylist() for c in ("a", "b")]
            shapes: list = []
            for wkt in dict.fromkeys(sides[0] + sides[1]):
                known[wkt] = len(shapes)
                shapes.append(parse(wkt))
            i, j = (np.array([known[w] for w in side], np.int64) for side in sides)
            if relation == "intersects":
                sure[ask] = intersecting(laid := Shapes(shapes), i, laid, j)
            else:
                sure[ask] = [related(shapes[x], shapes[y], relation) for x, y in zip(i, j)]
            yield batch.select(["l", "r"]).filter(pa.array(sure, pa.bool_()))

    return run


def join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, relation: str = "intersects",
         join_type: str = "inner", budget: int = BUDGET) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` that they are related to. Text that is no
    geometry meets nothing; ``left`` keeps rows without a partner (NULL right columns)."""
    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)

    a, b = numbered(left), numbered(right)
    shapes = [df.select(F.col("__id").alias("id"), F.col(f"`{c}`").cast("string").alias("wkt")) for df, c in ((a, left_geom), (b, right_geom))]
    x0, y0, x1, y1 = shapes[0].unionByName(shapes[1]).mapInArrow(_boxes, "x0 double, y0 double, x1 double, y1 double") \
        .agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    frame = (0.0, 0.0, 1.0) if x0 is None else (x0, y0, max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9))
    # the cells above a shape's own matter at the levels of the other side's own cells
    cb = shapes[1].mapInArrow(_cells(frame, budget, list(range(LEVELS + 1))), CELLS).checkpoint(eager=True)
    levels = sorted(r[0] for r in cb.where("own").select("level").distinct().collect())  # at most LEVELS + 1
    # below the other side's deepest own cell a smaller cell meets nothing else
    ca = shapes[0].mapInArrow(_cells(frame, budget, levels, max(levels, default=LEVELS)), CELLS)
    cell = ["level", "ci", "cj"]
    ca = ca.withColumnsRenamed({"id": "l", "sure": "l_sure", "own": "l_own"})
    cb = cb.withColumnsRenamed({"id": "r", "sure": "r_sure", "own": "r_own"})
    # a point's own cell, or one above it, that is wholly inside a polygon of the other side
    point = F.col("wkt").rlike(r"(?i)\A\s*POINT\b")
    inner = F.col("r_own") & F.col("r_sure") if relation != "contains" else F.lit(False)
    met = ca.join(cb, cell).where(F.col("l_own") | F.col("r_own")).groupBy("l", "r").agg(F.max(inner).alias("inner"))
    met = met.join(shapes[0].select(F.col("id").alias("l"), F.col("wkt").alias("a"), point.alias("is_point")), "l") \
        .join(shapes[1].select(F.col("id").alias("r"), F.col("wkt").alias("b")), "r") \
        .select("l", "r", "a", "b", (F.col("inner") & F.col("is_point")).alias("sure"))
    pairs = met.mapInArrow(_decide(relation), "l long, r long")
    how = "inner" if join_type == "inner" else "left"
    rows = a.toDF(*[f"__l{i}" for i in range(len(left.columns))], "__lid").join(pairs, F.col("__lid") == F.col("l"), how)
    rows = rows.join(b.toDF(*[f"__r{i}" for i in range(len(right.columns))], "__rid"), F.col("r") == F.col("__rid"), how)
    return rows.select(*[F.col(f"__l{i}").alias(c) for i, c in enumerate(left.columns)],
                       *[F.col(f"__r{i}").alias(c) for i, c in enumerate(right.columns)])
