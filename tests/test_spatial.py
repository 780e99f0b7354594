import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import geo
from lakeloom.operators import spatial_index as si


def square(x, y, w, h=None):
    h = w if h is None else h
    return f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"


def shapes(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.uniform(0, 100), r.uniform(0, 100)
        kind = r.randint(0, 3)
        if kind == 0:
            out.append(f"POINT({x} {y})")
        elif kind == 1:
            out.append("LINESTRING(" + ", ".join(f"{x + r.uniform(-8, 8)} {y + r.uniform(-8, 8)}" for _ in range(r.randint(2, 4))) + ")")
        elif kind == 2:
            out.append(square(x, y, r.uniform(0.1, 9), r.uniform(0.1, 9)))
        else:
            out.append(f"POLYGON(({x} {y}, {x + 9} {y}, {x + 9} {y + 9}, {x} {y + 9}, {x} {y}), ({x + 2} {y + 2}, {x + 7} {y + 2}, {x + 7} {y + 7}, {x + 2} {y + 7}))")
    return out


@pytest.mark.parametrize("relation", ["intersects", "within", "contains"])
def test_join_equals_all_pairs(spark, relation):
    a, b = shapes(1, 120) + [None, "none", square(-50, -50, 300)], shapes(2, 80) + ["POINT EMPTY", square(10, 10, 60)]
    left = spark.createDataFrame(list(enumerate(a)), "id int, geom string")
    right = spark.createDataFrame(list(enumerate(b)), "id int, geom string").withColumn("l", F.lit("clash"))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if si.related(si.parse(x), si.parse(y), relation)}
    got = geo.join_spatial(left, right, "geom", "geom", relation, budget=24).toDF("i", "g", "j", "h", "c")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    outer = geo.join_spatial(left, right, "geom", "geom", relation, "left").toDF("i", "g", "j", "h", "c")
    assert outer.where("j is null").count() == len(set(range(len(a))) - {i for i, _ in want})


def test_relations():
    p = si.parse
    box, hole = p(square(0, 0, 10)), p("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))")
    assert si.related(p("POINT(5 5)"), box, "within") and not si.related(p("POINT(5 5)"), hole, "intersects")
    assert si.related(p("LINESTRING(-5 5, 15 5)"), box, "intersects") and not si.related(p("LINESTRING(-5 5, 15 5)"), box, "within")
    assert si.related(p("LINESTRING(1 1, 2 2)"), hole, "within") and not si.related(p("LINESTRING(1 5, 9 5)"), hole, "within")
    assert si.related(box, p(square(-1, -1, 20)), "within") and si.related(p(square(-1, -1, 20)), box, "contains")
    assert si.related(p(square(4, 4, 1)), box, "intersects") and not si.related(p(square(4, 4, 1)), hole, "intersects")
    assert si.related(box, p(square(4, 4, 1)), "intersects") and not si.related(p(square(0, 0, 10)), hole, "within")
    assert si.related(p("LINESTRING(0 0, 1 1)"), p("LINESTRING(0 1, 1 0)"), "intersects")
    assert not si.related(p("LINESTRING(0 0, 1 1)"), p("LINESTRING(2 0, 3 1)"), "intersects")
    assert si.related(p("MULTIPOINT((50 50), (5 5))"), box, "intersects")


def test_a_country_costs_as_many_cells_as_a_house():
    frame = (0.0, 0.0, 1000.0)
    for wkt in (square(1, 1, 990), square(5, 5, 0.01), "POLYGON((0 0, 1000 0, 500 999, 0 0))"):
        cells = si.cover(si.parse(wkt), frame)
        assert len(cells) <= si.BUDGET + 4
        covered = sum(4.0 ** -c[0] for c in cells)
        assert covered <= 1.0
        sure = [c for c in cells if c[3]]
        for level, i, j, _ in sure:
            side = 1000.0 / (1 << level)
            corners = np.array([[i * side + d * side * 0.999 + 1e-6, j * side + e * side * 0.999 + 1e-6] for d in (0, 1) for e in (0, 1)])
            assert si.inside(si.parse(wkt), corners).all()
    assert any(c[3] for c in si.cover(si.parse(square(1, 1, 990)), frame))


def test_intersects_a_fixed_shape(spark):
    rows = ["POINT(1 1)", "POINT(50 50)", "LINESTRING(-5 5, 15 5)", square(20, 20, 5), square(-5, -5, 100), None, "x"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, geom string")
    got = {r.id: r.intersects for r in geo.geo_intersects(df, "geom", square(0, 0, 10)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: None, 6: None}
    line = {r.id: r.intersects for r in geo.geo_intersects(df, "geom", "LINESTRING(0 0, 2 2)").collect()}
    assert line[0] is True and line[1] is False and line[4] is True


def test_pairs_are_decided_in_batches(spark, monkeypatch):
    """The join and the fixed target ask for many pairs at a time, with the same answers."""
    wkts = shapes(3, 90) + ["MULTIPOINT((50 50), (5 5))", "LINESTRING(7 7)", square(10, 10, 60)]
    parsed = [si.parse(w) for w in wkts]
    i, j = (x.ravel() for x in np.indices((len(wkts), len(wkts))))
    laid = si.Shapes(parsed)
    want = [si.related(parsed[x], parsed[y], "intersects") for x, y in zip(i, j)]
    assert si.intersecting(laid, i, laid, j).tolist() == want and 0 < sum(want) < len(want)
    monkeypatch.setattr(si, "CELLS_AT_ONCE", 40)
    assert si.intersecting(laid, i, laid, j).tolist() == want
    monkeypatch.setattr(si, "related", None)  # not one by one
    df = spark.createDataFrame([(n, w) for n, w in enumerate(wkts)], "id int, geom string")
    assert geo.geo_intersects(df, "geom", square(0, 0, 10)).where("intersects").count() > 0


def test_cells_of_many_shapes_hold_what_cells_of_one_hold():
    """Cells of a level, all shapes at once; none deeper than asked."""
    frame = (-10.0, -10.0, 130.0)
    parsed = [si.parse(w) for w in shapes(4, 60)]
    shape, level, ci, cj, sure = si.covers(parsed, frame, 24, 5)
    assert level.max() <= 5 and np.bincount(shape).max() <= 24 and set(shape) == set(range(60))
    for n, x in enumerate(parsed):
        own = sorted(zip(level[shape == n], ci[shape == n], cj[shape == n], sure[shape == n]))
        assert own == sorted(si.cover(x, frame, 24, 5))
        xy = np.concatenate(x[1])
        for px, py in xy:
            at = [(px - frame[0]) / frame[2], (py - frame[1]) / frame[2]]
            assert any(a <= at[0] * 2 ** k <= a + 1 and b <= at[1] * 2 ** k <= b + 1 for k, a, b, _ in own)
