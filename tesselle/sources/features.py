"""Map features from JSON elements: lines as columns, polygons from rings.

An element is a way (a list of points) or a relation of members with points of their own.
Reading and line assembly are DataFrame functions; only rings that several members make up go
through an Arrow-batched function.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselle.functions.linework import _ring_area, faces, node_lines, subtract
from tesselle.functions.shapes import _cross, contains, polygon_wkb

_POINTS = "array<struct<lon:double,lat:double>>"
ELEMENT = f"struct<type:string,id:bigint,geometry:{_POINTS},members:array<struct<role:string,geometry:{_POINTS}>>>"
#: Points this close (in degrees or whatever the elements are in) are one.
SNAP = 1e-9


def parsed(elements: DataFrame, column: str = "element") -> DataFrame:
    """``elements`` with the JSON text of ``column`` as a struct ``e`` (null if it can't be read)."""
    return elements.withColumn("e", F.from_json(column, ELEMENT))


def _members(inner: bool | None = None) -> Column:
    """The lines of a relation's members (of the inner ones, of the others, or of all) with two points or more."""
    members = F.coalesce(F.col("e.members"), F.array().cast(f"array<struct<role:string,geometry:{_POINTS}>>"))
    if inner is not None:
        members = F.filter(members, lambda m: (F.coalesce(m["role"], F.lit("")) == "inner") == F.lit(inner))
    return F.filter(F.transform(members, lambda m: m["geometry"]), lambda g: F.size(g) >= 2)


def lines(elements: DataFrame, column: str = "element") -> DataFrame:
    """``(<other columns>, line int, points array<struct<lon, lat>>)``: ways, and the members of relations, of two points or more."""
    rest = [c for c in elements.columns if c != column]
    way = F.filter(F.array("e.geometry"), lambda g: F.size(g) >= 2)
    every = F.when(F.col("e.type") == "way", way).when(F.col("e.type") == "relation", _members())
    return parsed(elements, column).select(*rest, F.posexplode(every).alias("line", "points"))


def chained(parts: list[np.ndarray]) -> list[np.ndarray] | None:
    """The closed rings that lines make up end to end; None if an end is met by more or fewer than two, or
    lines cross."""
    ends: dict[tuple, list[int]] = defaultdict(list)
    closed, open_parts = [], []
    for p in parts:
        (closed if tuple(p[0]) == tuple(p[-1]) else open_parts).append(p)
    for i, p in enumerate(open_parts):
        for end in (p[0], p[-1]):
            ends[tuple(end)].append(i)
    if any(len(v) != 2 for v in ends.values()) or any(len(p) < 4 for p in closed):
        return None
    left = set(range(len(open_parts)))
    while left:
        ring = open_parts[left.pop()]
        while tuple(ring[0]) != tuple(ring[-1]):
            i = next((k for k in ends[tuple(ring[-1])] if k in left), None)
            if i is None:
                return None
            left.discard(i)
            part = open_parts[i]
            ring = np.concatenate([ring, (part if tuple(part[0]) == tuple(ring[-1]) else part[::-1])[1:]])
        closed.append(ring)
    segments = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in closed]) if closed else np.zeros((0, 4))
    points = np.concatenate([r[:-1] for r in closed]) if closed else np.zeros((0, 2))
    if len(np.unique(points, axis=0)) < len(points) or _cross(segments, segments):
        return None
    return closed


def nested(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether a ring lies strictly within another one (rings that don't cross)."""
    return bool(contains([[other]], ring[:, 0], ring[:, 1]).all())


def rings(parts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The areas that lines (arrays of points) close, joined where they meet."""
    if not parts:
        return []
    whole = chained(parts)
    if whole is not None and len(whole) == 1:
        return [[whole[0] if _ring_area(whole[0]) > 0 else whole[0][::-1]]]
    return faces(*node_lines(np.concatenate([np.hstack([p[:-1], p[1:]]) for p in parts]), SNAP))


def areas_of(outer: list[np.ndarray], inner: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The areas that the outer lines close, without those that the inner ones do."""
    holes = [hole[0] for hole in rings(inner)]
    found = rings(outer)
    if not holes:
        return found
    if len(holes) == len(found) == 1 and len(found[0]) == 1 and not _cross(*(np.hstack([r[:-1], r[1:]]) for r in (holes[0], found[0][0]))) and nested(holes[0], found[0][0]):
        return [[found[0][0], holes[0][::-1]]]
    return [part for area in found for part in subtract([area], [[[hole]] for hole in holes])]


def polygons(elements: DataFrame, column: str = "element") -> DataFrame:
    """``(<other columns>, part int, geom binary)``: closed ways, and what relations' outer members
    enclose without their inner ones.  Open ways and rings that don't close have none."""
    rest = [c for c in elements.columns if c != column]
    points = F.col("e.geometry")
    closed = (F.col("e.type") == "way") & (F.size(points) >= 4) & (points[0] == F.element_at(points, -1))
    related = F.col("e.type") == "relation"
    kind = pa.list_(pa.binary())

    def build(outer: pa.Array, inner: pa.Array) -> pa.Array:
        arrays = lambda ways: [np.array([(p["lon"], p["lat"]) for p in way], float) for way in ways or ()]
        return pa.array([[polygon_wkb([[tuple(p) for p in r] for r in area]) for area in areas_of(arrays(o), arrays(i))] for o, i in zip(outer.to_pylist(), inner.to_pylist(), strict=True)], kind)

    outer = F.when(closed, F.array(points)).when(related, _members(False))
    read = parsed(elements, column).withColumns({"_outer": outer, "_inner": F.when(related, _members(True))}).filter("_outer is not null")
    return read.withColumn("_geoms", F.arrow_udf(build, "array<binary>")("_outer", "_inner")).select(*rest, F.posexplode("_geoms").alias("part", "geom"))
