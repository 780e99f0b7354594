"""Exact near pairs of unit vectors by a hierarchy of cells.

All vectors of one length form a cell. A cell of more than ``LEAF`` vectors is split: of
``FANOUT`` of its vectors (pivots) each vector's nearest one is its home. A pair within
distance r whose one vector has home c can only be found if the other one also looks
into c; it does if its distance to c's pivot is at most r more than c's radius, and at
most 2r more than to its own nearest pivot (triangle inequality). So every vector is in
its home and visits the other cells that pass both tests, and cells are split until
their homes fit a block. In a leaf the homes are compared with each other and with the
visitors, one matrix product per block; of the two cells that see a pair the one with
the larger home id reports it.

Where the distance asked for is large, the tests prune little and a split mostly copies
rows. A cell is therefore not split if that would not halve its comparisons, or if its
children would hold more than ``GROWTH`` rows per home. Every vector has one home, so what
a level stores is at most ``GROWTH`` times the table. Unsplit cells stay leaves; those of
more than ``MANY`` homes are compared by pairs of blocks: the work is quadratic there, but
rows are stored once, in blocks that tasks read.

Cells, their pivots and radii are rows of Spark frames; a cell of any size is split by
many tasks, each with a part of the cell's rows and the cell's pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 64
LEAF = 2_048
PART = 16_384  # rows of a cell that one task splits, and visitors of a leaf per block
GROWTH = 64  # rows per home that the children of a split cell may hold
MANY = 4_096  # homes of a leaf that one task compares
BLOCK_BYTES = 4_000_000
SLACK = 1e-7

VISITS = "id long, u array<double>, cell string, home boolean"


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((big > 1e-100) & (big < 1e100), x, x / big)  # where squares would overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _vectors(u: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), u.shape[1]).cast(pa.list_(pa.float64()))


def _normal(batches):
    """Unit vectors, in runs of one length."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column("x")])
        for n in np.unique(sizes):
            part = batch.filter(pa.array(sizes == n))
            u = unit(_matrix(part.column("x")))
            yield pa.RecordBatch.from_arrays([part.column("id"), _vectors(u), pa.array([str(n)] * len(u)), pa.array([True] * len(u))],
                                             names=["id", "u", "cell", "home"])


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (u @ pivots.T), 0.0))


def _reaches(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """(cell, child, radius, n) of the homes among a cell's rows."""
    u, p = _matrix(rows.column("u")), _matrix(pivots.column("p"))
    d = _distances(u, p)
    child = d.argmin(axis=1)
    at, inverse, n = np.unique(child, return_inverse=True, return_counts=True)
    radius = np.zeros(len(at))
    np.maximum.at(radius, inverse, d[np.arange(len(u)), child])
    return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()] * len(at)), "child": pivots.column("child").take(pa.array(at)),
                     "radius": pa.array(radius), "n": pa.array(n)})


def _goes(rows: pa.Table, pivots: pa.Table, r: float):
    """Which rows of a cell go to which children, and at home where."""
    u, p = _matrix(rows.column("u")), _matrix(pivots.column("p"))
    radius = pivots.column("radius").to_numpy()
    d = _distances(u, p)
    nearest = d.argmin(axis=1)
    every = np.arange(len(u))
    goes = (d <= radius + r + SLACK) & (d <= d[every, nearest][:, None] + 2 * r + SLACK)
    home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
    goes[every[home], nearest[home]] = True
    return u, goes, home, nearest


def _moves(r: float):
    """Every row of a cell, at home in one child and visiting others."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows) or not len(pivots):  # the cell stays whole
            return rows.select(["id", "u", "cell", "home"]).slice(0, 0)
        u, goes, home, nearest = _goes(rows, pivots, r)
        row, to = np.nonzero(goes)
        names = [f"{rows.column('cell')[0].as_py()}/{c}" for c in pivots.column("child").to_pylist()]
        return pa.table({"id": rows.column("id").take(pa.array(row)), "u": _vectors(u[row]),
                         "cell": pa.array([names[c] for c in to]), "home": pa.array(home[row] & (nearest[row] == to))})

    return run


def _growth(r: float):
    """(cell, child, moved, own): the rows that a cell's children would hold, and the homes among them."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"cell": pa.array([], pa.string()), "child": pa.array([], pa.int64()), "moved": pa.array([], pa.int64()), "own": pa.array([], pa.int64())})
        _, goes, home, nearest = _goes(rows, pivots, r)
        return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()] * len(pivots)), "child": pivots.column("child"),
                         "moved": pa.array(goes.sum(axis=0)), "own": pa.array(np.bincount(nearest[home], minlength=len(pivots)))})

    return run


def _parts(sizes: DataFrame, count: str) -> DataFrame:
    return sizes.withColumn("parts", F.ceil(F.col(count) / PART).cast("int"))


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the cells in ``sizes`` with the part of the cell that they fall in."""
    return rows.join(sizes.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")


def _copied(small: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows that every part of their cell needs, grouped by it (under names of their own)."""
    small = small.join(sizes.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    own = small.select(*[F.col(c).alias(f"of_{c}" if c in ("cell", "part") else c) for c in small.columns if c != "parts"])
    return own.toDF(*own.columns).groupBy("of_cell", "of_part")


def _split(visits: DataFrame, r: float, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells in ``sizes`` one level down, and the cells that stay whole."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
    pivots = visits.where("home").join(sizes.select("cell"), "cell").withColumn("child", F.row_number().over(order)) \
        .where(F.col("child") <= FANOUT).select("cell", F.col("child").cast("long").alias("child"), F.col("u").alias("p"))
    pivots = pivots.checkpoint(eager=True)
    rows = _dealt(visits, sizes)
    found = rows.where("home").groupBy("cell", "part").cogroup(_copied(pivots, sizes)) \
        .applyInArrow(lambda a, b: _reaches(a, b) if len(a) else EMPTY, "cell string, child long, radius double, n long")
    reach = found.groupBy("cell", "child").agg(F.max("radius").alias("radius"))
    pivots = pivots.join(reach, ["cell", "child"]).select("cell", "child", "p", "radius").checkpoint(eager=True)
    moved = rows.groupBy("cell", "part").cogroup(_copied(pivots, sizes)).applyInArrow(_growth(r), "cell string, child long, moved long, own long") \
        .groupBy("cell", "child").agg(F.sum("moved").cast("double").alias("moved"), F.sum("own").alias("own"))
    grown = moved.groupBy("cell").agg(F.sum("moved").alias("moved"), F.sum(F.col("moved") * F.col("own")).alias("work")).join(sizes, "cell") \
        .withColumn("whole", (F.col("moved") > GROWTH * F.col("homes")) | (F.col("work") > F.col("homes") * F.col("rows") / 2)).checkpoint(eager=True)
    split = grown.where("not whole").select("cell", "parts")
    rows = _dealt(visits, split)
    moved = rows.groupBy("cell", "part").cogroup(_copied(pivots, split)).applyInArrow(_moves(r), VISITS)
    return moved, grown.where("whole").select("cell")


EMPTY = pa.table({"cell": pa.array([], pa.string()), "child": pa.array([], pa.int64()), "radius": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})


def leaves(points: DataFrame, r: float, leaf: int = LEAF) -> DataFrame:
    """(id, u, cell, home): every vector of ``points`` (id, x) in its home leaf and in the
    leaves that it visits."""
    todo = points.mapInArrow(_normal, VISITS).checkpoint(eager=True)
    done: list[DataFrame] = []
    while True:
        sizes = todo.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
        large = _parts(sizes.where(F.col("homes") > leaf), "rows")
        done.append(todo.join(sizes.where(F.col("homes").between(1, leaf)).select("cell"), "cell").select("id", "u", "cell", "home"))
        if not large.limit(1).count():
            break
        below, whole = _split(todo, r, large)
        done.append(todo.join(whole, "cell").select("id", "u", "cell", "home"))
        todo = below.checkpoint(eager=True)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _products(u: np.ndarray, v: np.ndarray, t: float):
    """(rows of u, rows of v, products) of at least ``t``, a block of products at a time."""
    for at in range(0, len(u), LEAF):
        for to in range(0, len(v), LEAF):
            score = u[at:at + LEAF] @ v[to:to + LEAF].T
            x, y = np.nonzero(score >= t)
            yield at + x, to + y, score[x, y]


PAIRS = "i long, j long, score double"


def _compare(t: float):
    def run(homes: pa.Table, others: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(homes) and len(others):
            a, b = homes.column("home_id").to_numpy(), others.column("id").to_numpy()
            for x, y, score in _products(_matrix(homes.column("home_u")), _matrix(others.column("u")), t):
                first = b[y] < a[x]
                found.append((b[y[first]], a[x[first]], score[first]))
        i, j, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"i": pa.array(i), "j": pa.array(j), "score": pa.array(score)})

    return run


def _packed(rows: pa.Table) -> pa.Table:
    """A block of a cell's homes or of its visitors as one row."""
    return pa.table({"cell": rows.column("cell").slice(0, 1), "home": rows.column("home").slice(0, 1), "block": rows.column("block").slice(0, 1),
                     "ids": pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()),
                     "u": pa.array([np.ascontiguousarray(_matrix(rows.column("u"))).tobytes()], pa.binary())})


def _compare_blocks(t: float):
    """Pairs of blocks: homes against themselves, other homes or visitors."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                a, u, b, v = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in
                              (("ids", np.int64), ("u", np.float64), ("of_ids", np.int64), ("of_u", np.float64)))
                homes, same = batch.column("of_home")[k].as_py(), batch.column("same")[k].as_py()
                for x, y, score in _products(u.reshape(len(a), -1), v.reshape(len(b), -1), t):
                    # two blocks of homes meet once, a home and a visitor in both their cells
                    keep = b[y] < a[x] if same or not homes else np.ones(len(x), bool)
                    i, j = a[x[keep]], b[y[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(score[keep])], names=["i", "j", "score"])

    return run


def _block_pairs(visits: DataFrame, sizes: DataFrame, t: float) -> DataFrame:
    """The pairs of the cells in ``sizes`` (of many homes each). Every block is stored once, as
    a row; the pairs of blocks are a cross product whose tasks read two partitions each."""
    n = F.greatest(F.lit(1), F.ceil(F.col("rows") * F.split("cell", "/")[0].cast("long") * 8 / BLOCK_BYTES))
    blocks = sizes.withColumn("blocks", n.cast("int"))
    count = blocks.agg(F.sum("blocks")).first()[0] or 0
    if not count:
        return visits.sparkSession.createDataFrame([], PAIRS)
    dealt = visits.join(blocks.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
    packed = dealt.select("id", "u", "cell", "home", "block").groupBy("cell", "home", "block") \
        .applyInArrow(_packed, "cell string, home boolean, block long, ids binary, u binary") \
        .repartition(count, "cell", "home", "block").checkpoint(eager=True)
    other = packed.select(*[F.col(c).alias(f"of_{c}") for c in packed.columns]).hint("shuffle_replicate_nl")
    # two inequalities: a join on an equality would put all blocks of a cell into one task
    meets = (F.col("cell") <= F.col("of_cell")) & (F.col("cell") >= F.col("of_cell")) & F.col("home") \
        & (~F.col("of_home") | (F.col("of_block") <= F.col("block")))
    met = packed.join(other, meets).select("ids", "u", "of_ids", "of_u", "of_home", (F.col("of_home") & (F.col("of_block") == F.col("block"))).alias("same"))
    return met.mapInArrow(_compare_blocks(t), PAIRS)


def near_pairs(points: DataFrame, t: float, leaf: int = LEAF) -> DataFrame:
    """(i, j, score), i < j: all pairs of ``points`` (id, x; vectors of finite numbers, not
    all zero, ids distinct or null; a null one pairs with nothing) with cosine ``t`` or more."""
    visits = leaves(points.where(F.col("id").isNotNull()), math.sqrt(max(2.0 - 2.0 * t, 0.0)), leaf)
    sizes = _parts(visits.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows")), "rows").checkpoint(eager=True)
    few = sizes.where(F.col("homes") <= MANY)
    homes = _copied(visits.where("home").select(F.col("id").alias("home_id"), F.col("u").alias("home_u"), "cell"), few)
    others = _dealt(visits.select("id", "u", "cell"), few)
    found = homes.cogroup(others.groupBy("cell", "part")).applyInArrow(_compare(t), PAIRS)
    return found.unionByName(_block_pairs(visits, sizes.where(F.col("homes") > MANY), t))


def comparisons(visits: DataFrame) -> int:
    """Vector pairs that the leaves compare."""
    sizes = visits.groupBy("cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum(F.col("h") * F.col("n"))).first()[0] or 0
