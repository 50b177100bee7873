"""Shattering a study area along linework: noding, faces, slivers.

Lines are cut where they meet, dangling ends fall away, and the faces of what is left are the
tiles.  One study area is one task (a grouped map); areas run side by side.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.functions.shapes import contains, polygon_wkb

#: Points this close are one (in feet); faces smaller than this are slivers and dropped (square feet).
SNAP_FT, SLIVER_SQFT = 1e-6, 100.0

Point = tuple[float, float]


def node_lines(segments: np.ndarray, snap: float = SNAP_FT) -> tuple[np.ndarray, np.ndarray]:
    """Points and edges of segments (n, 4) cut at all their meetings; edges are distinct pairs of point numbers.

    Candidates come from a sweep over x: a segment meets only those that begin before it ends.
    """
    s = segments[np.hypot(segments[:, 2] - segments[:, 0], segments[:, 3] - segments[:, 1]) > snap]
    flip = s[:, 0] > s[:, 2]
    s[flip] = s[flip][:, [2, 3, 0, 1]]
    s = s[np.argsort(s[:, 0], kind="stable")]
    low, high = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    cuts: list[list[np.ndarray]] = [[np.array([0.0, 1.0])] for _ in s]
    until = np.searchsorted(s[:, 0], s[:, 2] + snap, "right")
    for i in range(len(s)):
        k = np.arange(i + 1, until[i])
        k = k[(low[k] <= high[i] + snap) & (high[k] >= low[i] - snap)]
        if not len(k):
            continue
        p, d, q, e = s[i, :2], s[i, 2:] - s[i, :2], s[k, :2], s[k, 2:] - s[k, :2]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        gap = q - p
        size, sizes = math.hypot(*d), np.hypot(e[:, 0], e[:, 1])
        slack, slacks = snap / size, snap / sizes
        skew = np.abs(cross) > 1e-12 * size * sizes
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / cross
            u = (gap[:, 0] * d[1] - gap[:, 1] * d[0]) / cross
        meet = skew & (t >= -slack) & (t <= 1 + slack) & (u >= -slacks) & (u <= 1 + slacks)
        cuts[i].append(np.clip(t[meet], 0, 1))
        for j, v in zip(k[meet].tolist(), np.clip(u[meet], 0, 1).tolist(), strict=True):
            cuts[j].append(np.array([v]))
        # Along one line: each is cut at the ends of the other.
        along = ~skew & (np.abs(d[0] * gap[:, 1] - d[1] * gap[:, 0]) <= snap * size)
        for j in k[along].tolist():
            ends = (s[j].reshape(2, 2) - p) @ d / size**2
            cuts[i].append(ends[(ends > 0) & (ends < 1)])
            back = (s[i].reshape(2, 2) - s[j, :2]) @ (s[j, 2:] - s[j, :2]) / float(((s[j, 2:] - s[j, :2]) ** 2).sum())
            cuts[j].append(back[(back > 0) & (back < 1)])
    number: dict[tuple[int, int], int] = {}
    points: list[Point] = []
    edges: set[tuple[int, int]] = set()

    def at(x: float, y: float) -> int:
        key = (round(x / (snap * 10)), round(y / (snap * 10)))
        for near in ((key[0] + a, key[1] + b) for a in (0, -1, 1) for b in (0, -1, 1)):
            if near in number:
                return number[near]
        number[key] = len(points)
        points.append((x, y))
        return number[key]

    for line, own in zip(s, cuts, strict=True):
        t = np.unique(np.concatenate(own))
        ids = [at(*(line[:2] + v * (line[2:] - line[:2]))) for v in t.tolist()]
        edges.update((min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False) if a != b)
    return np.array(points).reshape(-1, 2), np.array(sorted(edges), np.int64).reshape(-1, 2)


def _ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def faces(points: np.ndarray, edges: np.ndarray) -> list[list[np.ndarray]]:
    """The bounded faces of a plane graph, each a list of closed rings (outer first).

    Walking along half-edges, always leaving a point by the next edge clockwise, goes once
    round each face; rings that come out clockwise are the outsides of parts of the graph,
    and holes of the smallest face around them.
    """
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in edges.tolist():
        near[a].append(b)
        near[b].append(a)
    loose = [v for v, k in near.items() if len(k) == 1]
    while loose:  # dangling ends
        v = loose.pop()
        if len(near[v]) != 1:
            continue
        w = near[v].pop()
        near[w].remove(v)
        if len(near[w]) == 1:
            loose.append(w)
    angle = lambda v, w: math.atan2(points[w, 1] - points[v, 1], points[w, 0] - points[v, 0])
    turn = {}
    for v, k in near.items():
        around = sorted(k, key=lambda w, v=v: angle(v, w))
        for place, w in enumerate(around):
            turn[w, v] = around[place - 1]  # arriving from w, leave by the next one clockwise
    shells, outsides, seen = [], [], set()
    for begin in sorted(turn):
        if begin in seen:
            continue
        ring, (a, b) = [], begin
        while (a, b) not in seen:
            seen.add((a, b))
            ring.append(a)
            a, b = b, turn[a, b]
        ring = points[[*ring, ring[0]]]
        (shells if _ring_area(ring) > 0 else outsides).append(ring)
    shells.sort(key=_ring_area)
    out = [[r] for r in shells]
    for ring in outsides:
        size = -_ring_area(ring)  # a hole's corner lies strictly within the face around it
        probe = ring[0]
        for k, shell in enumerate(shells):
            if _ring_area(shell) > size * (1 + 1e-12) and contains([[shell]], probe[:1], probe[1:])[0]:
                out[k].append(ring)
                break
    return out


def inner_point(rings: list[np.ndarray]) -> Point:
    """A point inside a polygon: the middle of the widest stretch of a level line through it."""
    y = np.unique(rings[0][:, 1])
    best = (-1.0, 0.0, 0.0)
    for level in ((y[1:] + y[:-1]) / 2).tolist():
        xs = sorted(
            x0 + (level - y0) * (x1 - x0) / (y1 - y0) for r in rings for (x0, y0), (x1, y1) in zip(r[:-1].tolist(), r[1:].tolist(), strict=True) if (y0 > level) != (y1 > level)
        )
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            best = max(best, (b - a, (a + b) / 2, level))
    return best[1], best[2]


def shatter(area: list[list[np.ndarray]], segments: np.ndarray, least: float = SLIVER_SQFT) -> list[list[np.ndarray]]:
    """The faces of the linework and the area's own border that lie in the area, without slivers."""
    border = [np.hstack([r[:-1], r[1:]]) for rings in area for r in rings]
    points, edges = node_lines(np.concatenate([*border, segments.reshape(-1, 4)]))
    out = []
    for rings in faces(points, edges):
        size = _ring_area(rings[0]) + sum(_ring_area(r) for r in rings[1:])  # holes run clockwise
        if size >= least:
            x, y = inner_point(rings)
            if contains(area, np.array([x]), np.array([y]))[0]:
                out.append(rings)
    return out


def shatter_areas(areas: DataFrame, lines: DataFrame, least: float = SLIVER_SQFT) -> DataFrame:
    """``(area_id, tile_id, geom binary, sqft)`` from ``areas (area_id, geom)`` and ``lines (area_id, x0, y0, x1, y1)``.

    Tiles are numbered from 0 within an area, by their lowest, then leftmost corner.
    """
    from tesselle.functions.shapes import parse_wkb

    def run(key: tuple, own: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"area_id": [], "tile_id": [], "geom": [], "sqft": []})
        found = shatter(parse_wkb(bytes(own["geom"].iloc[0])), cut[["x0", "y0", "x1", "y1"]].to_numpy(float), least)
        found.sort(key=lambda rings: (rings[0][:, 1].min(), rings[0][:, 0].min()))
        sizes = [_ring_area(r[0]) + sum(_ring_area(h) for h in r[1:]) for r in found]
        return pd.DataFrame({"area_id": [key[0]] * len(found), "tile_id": range(len(found)), "geom": [polygon_wkb([[tuple(p) for p in r] for r in rings]) for rings in found], "sqft": sizes})

    return areas.groupBy("area_id").cogroup(lines.groupBy("area_id")).applyInPandas(run, "area_id long, tile_id long, geom binary, sqft double")


def subtract(area: list[list[np.ndarray]], masks: list[list[list[np.ndarray]]]) -> list[list[np.ndarray]]:
    """What is left of an area without the masks (polygons that may overlap), as faces."""
    lines = [np.hstack([r[:-1], r[1:]]) for mask in masks for rings in mask for r in rings]
    out = []
    for rings in shatter(area, np.concatenate(lines) if lines else np.zeros((0, 4)), 0.0):
        x, y = (np.array([v]) for v in inner_point(rings))
        if not any(contains(mask, x, y)[0] for mask in masks):
            out.append(rings)
    return out


def clip_out(tiles: DataFrame, water: DataFrame, size: float | None = None) -> DataFrame:
    """``(tile_id, piece, geom binary, sqft)``: tiles ``(id, geom, x0, y0, x1, y1)`` without the water
    ``(geom, x0, y0, x1, y1)``.

    Only tiles whose bounds meet some water's are cut (a bucketed join on bounds, then one
    group a tile); the others pass through.  ``size``, the side of the join's lattice cells, is best
    about that of the tiles: outlines travel once for every cell.
    """
    from tesselle.functions.shapes import parse_wkb, wkb_area
    from tesselle.operators.spatial import range_join

    met = range_join(tiles, water, 0.0, size).select("a_id", "a_geom", "b_geom")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = subtract(parse_wkb(bytes(own["a_geom"].iloc[0])), [parse_wkb(bytes(g)) for g in own["b_geom"]])
        sizes = [_ring_area(r[0]) + sum(_ring_area(h) for h in r[1:]) for r in found]
        return pd.DataFrame({"tile_id": [key[0]] * len(found), "piece": range(len(found)), "geom": [polygon_wkb([[tuple(p) for p in r] for r in rings]) for rings in found], "sqft": sizes})

    cut = met.groupBy("a_id").applyInPandas(run, "tile_id long, piece long, geom binary, sqft double")
    dry = tiles.join(met.select("a_id").distinct(), tiles["id"] == F.col("a_id"), "left_anti").select(F.col("id").alias("tile_id"), F.lit(0).cast("long").alias("piece"), "geom", wkb_area("geom").alias("sqft"))
    return cut.unionByName(dry)
