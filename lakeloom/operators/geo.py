"""Planar geometry on WKT text: point distance, within-distance, intersection with a
fixed shape and a spatial join by quadtree cells (no geometry library)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import spatial_index

_NUM = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
POINT_RE = rf"^\s*POINT\s*\(\s*{_NUM}\s+{_NUM}\s*\)\s*$"


def point_x(wkt: Column) -> Column:
    return F.regexp_extract(wkt, POINT_RE, 1).try_cast("double")


def point_y(wkt: Column) -> Column:
    return F.regexp_extract(wkt, POINT_RE, 2).try_cast("double")


def parse_polygon(wkt: str) -> list[list[tuple[float, float]]]:
    """All rings of a WKT POLYGON or MULTIPOLYGON literal (driver-side, one literal)."""
    if not re.match(r"\s*(MULTI)?POLYGON\b", wkt, re.I):
        raise ValueError(f"not a POLYGON: {wkt[:60]!r}")
    rings = [[tuple(float(v) for v in p.split()[:2]) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]
    if not rings:
        raise ValueError(f"not a POLYGON: {wkt[:60]!r}")
    return rings


def parse_point(wkt: str) -> tuple[float, float]:
    m = re.match(POINT_RE, wkt, re.I)
    if not m:
        raise ValueError(f"not a POINT: {wkt!r}")
    return float(m.group(1)), float(m.group(2))


def geo_distance(df: DataFrame, geom_column: str, target_wkt: str, output: str = "distance") -> DataFrame:
    """Planar distance from each POINT to a target POINT."""
    tx, ty = parse_point(target_wkt)
    g = F.col(geom_column)
    return df.withColumn(output, F.sqrt(F.pow(point_x(g) - tx, 2) + F.pow(point_y(g) - ty, 2)))


def geo_within_distance(df: DataFrame, geom_column: str, target_wkt: str, distance: float, output: str = "within") -> DataFrame:
    return geo_distance(df, geom_column, target_wkt, "__d").withColumn(output, F.col("__d") <= float(distance)).drop("__d")


def _ray_cast(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over the edges of all rings (an array of arrays of
    struct(x, y), each closed): a hole's edges count like any other, and so do
    the parts of a multipolygon."""

    def crossed(ring):
        edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: (
            ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])))
        return F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(e, F.lit(False)))

    return F.aggregate(rings, F.lit(False), lambda acc, ring: acc != crossed(ring))


def _rings_col(rings: list[list[tuple[float, float]]]) -> Column:
    def one(pts):
        pts = pts if pts[0] == pts[-1] else pts + pts[:1]
        return F.array(*[F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")) for px, py in pts])

    return F.array(*[one(r) for r in rings])


def geo_intersects(df: DataFrame, geom_column: str, target_wkt: str, output: str = "intersects") -> DataFrame:
    """Whether a geometry (point, line, polygon or several) has a point in common with the
    target. Points against a polygon stay JVM-side; only other shapes go to Python."""
    target = spatial_index.parse(target_wkt)
    if target is None:
        raise ValueError(f"not a geometry: {target_wkt[:60]!r}")

    @F.pandas_udf("boolean")
    def meets(wkt: pd.Series) -> pd.Series:
        shapes = [spatial_index.parse(w) for w in wkt]
        at = [i for i, s in enumerate(shapes) if s is not None]
        laid = spatial_index.Shapes([shapes[i] for i in at])
        got = np.full(len(shapes), None, object)
        got[at] = spatial_index.intersecting(laid, np.arange(len(at)), spatial_index.Shapes([target]), np.zeros(len(at), np.int64))
        return pd.Series(got)

    g = F.col(geom_column)
    if target[0] != 2:
        return df.withColumn(output, meets(g))
    is_point = g.rlike(POINT_RE)
    native = _ray_cast(point_x(g), point_y(g), _rings_col(parse_polygon(target_wkt)))
    return df.withColumn(output, F.when(is_point, native).otherwise(meets(F.when(~is_point, g))))


def join_spatial(left: DataFrame, right: DataFrame, left_geom_column: str, right_geom_column: str,
                 relation: str = "intersects", join_type: str = "inner", budget: int = spatial_index.BUDGET) -> DataFrame:
    """Join rows by their geometries (points, lines, polygons, or several of them, on
    either side): ``intersects``, ``within`` or ``contains``. Candidates come from an
    equi-join on quadtree cells, ``budget`` cells a shape whatever its size
    (``spatial_index``). ``left`` keeps rows without a partner (NULL right columns)."""
    if relation not in ("within", "intersects", "contains"):
        raise ValueError(f"join_spatial: unsupported relation {relation!r}")
    return spatial_index.join(left, right, left_geom_column, right_geom_column, relation, join_type, budget)
