"""Boxes and quadtrees as expressions, and general polygons (WKB) in Arrow-batched functions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quad_split(box: DataFrame) -> DataFrame:
    """Each box ``(x0, y0, x1, y1)`` as its four quarters."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    quarter = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    four = F.array(quarter(x0, y0, mx, my), quarter(mx, y0, x1, my), quarter(x0, my, mx, y1), quarter(mx, my, x1, y1))
    return box.select(*(c for c in box.columns if c not in ("x0", "y0", "x1", "y1")), F.inline(four))


def quad_leaves(box: DataFrame, largest: float, depth: int = 4) -> DataFrame:
    """The boxes left after splitting those whose area exceeds ``largest``, at most ``depth`` times."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    done, now = None, box
    for _ in range(depth):
        small = now.filter(area <= largest)
        done = small if done is None else done.unionByName(small)
        now = quad_split(now.filter(area > largest))
    return now if done is None else done.unionByName(now)


def dimmed(colour: Column, amount: float = 0.72) -> Column:
    """A colour struct<r, g, b> washed out toward white."""
    return F.struct(*((colour[c] + (1.0 - colour[c]) * amount).alias(c) for c in "rgb"))


# ---------------------------------------------------------------- polygons


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian WKB of a polygon given by its closed rings."""
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.array(r, "<f8").tobytes() for r in rings)


def box_wkb(x0: str, y0: str, x1: str, y1: str) -> Column:
    """The outline of a box as WKB, counter-clockwise from its lower left corner."""

    def run(*sides: pa.Array) -> pa.Array:
        a, b, c, d = (x.to_numpy(zero_copy_only=False).astype("<f8") for x in sides)
        rings = np.stack([a, b, c, b, c, d, a, d, a, b], axis=1)
        head = np.frombuffer(struct.pack("<BIII", 1, 3, 1, 5), np.uint8)
        whole = np.hstack([np.broadcast_to(head, (len(a), len(head))), np.ascontiguousarray(rings).view(np.uint8)])
        offsets = np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])

    return F.arrow_udf(run, "binary")(x0, y0, x1, y1)


def distinct_shapes(geoms: DataFrame) -> DataFrame:
    """One row of each geometry ``geom`` (by its bytes); empty and null ones go."""
    return geoms.filter("geom is not null and octet_length(geom) > 0").dropDuplicates(["geom"])


def parse_wkb(data: bytes) -> list[list[np.ndarray]]:
    """The polygons (lists of rings) of a WKB polygon, multipolygon or collection; lines and points have none."""
    at = 0

    def read() -> list[list[np.ndarray]]:
        nonlocal at
        end = "<" if data[at] else ">"
        kind, at2 = struct.unpack_from(end + "I", data, at + 1)[0], at + 5
        kind, size = kind & 0xFF, 16 + 8 * bool(kind & 0x80000000)
        at = at2

        def count() -> int:
            nonlocal at
            n = struct.unpack_from(end + "I", data, at)[0]
            at += 4
            return n

        def points(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, end + "f8", n * size // 8, at).reshape(n, -1)[:, :2].astype(float)
            at += n * size
            return out

        if kind == 1:
            points(1)
            return []
        if kind == 2:
            points(count())
            return []
        if kind == 3:
            return [[points(count()) for _ in range(count())]]
        return [p for _ in range(count()) for p in read()]

    return read()


def contains(polygons: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside (even-odd over all rings; a point on a border counts as outside)."""
    inside, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for rings in polygons:
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
                across = (y0 > y) != (y1 > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside ^= across & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
                flat = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                on |= (flat == 0) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
    return inside & ~on


def area(polygons: list[list[np.ndarray]]) -> float:
    shoelace = lambda r: abs(np.dot(r[:-1, 0], r[1:, 1]) - np.dot(r[1:, 0], r[:-1, 1])) / 2
    return float(sum(shoelace(rings[0]) - sum(map(shoelace, rings[1:])) for rings in polygons if rings))


def _segments(polygons: list[list[np.ndarray]]) -> np.ndarray:
    parts = [np.hstack([r[:-1], r[1:]]) for rings in polygons for r in rings if len(r) > 1]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def _point_to_segments(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distances of points (n, 2) to segments (m, 4)."""
    a, d = s[None, :, :2], s[None, :, 2:] - s[None, :, :2]
    along = ((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(2), 1e-300)
    nearest = a + np.clip(along, 0, 1)[..., None] * d
    return np.sqrt(((p[:, None] - nearest) ** 2).sum(2))


def _cross(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether any segment of s properly crosses one of t."""
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    p, q, r, u = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    return bool(((side(p, q, r) * side(p, q, u) < 0) & (side(r, u, p) * side(r, u, q) < 0)).any())


def distance(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> float:
    """Least distance of two polygons; zero if they meet or one holds the other."""
    s, t = _segments(a), _segments(b)
    if not len(s) or not len(t):
        return float("nan")
    if _cross(s, t) or contains(a, t[:1, 0], t[:1, 1])[0] or contains(b, s[:1, 0], s[:1, 1])[0]:
        return 0.0
    return float(min(_point_to_segments(s[:, :2], t).min(), _point_to_segments(t[:, :2], s).min()))


def wkb_area(geom: str | Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if g.as_py() is None else area(parse_wkb(g.as_py())) for g in column], pa.float64())

    return F.arrow_udf(run, "double")(geom)


def wkb_distance(a: str | Column, b: str | Column) -> Column:
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if g.as_py() is None or h.as_py() is None else distance(parse_wkb(g.as_py()), parse_wkb(h.as_py())) for g, h in zip(left, right, strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def within_polygon(x: str, y: str, geom: bytes) -> Column:
    """Whether a point lies inside one fixed polygon (a study area); its bounds are tested first, in plain columns."""
    shape = parse_wkb(geom)
    points = np.concatenate([r for rings in shape for r in rings])
    (x0, y0), (x1, y1) = points.min(0).tolist(), points.max(0).tolist()

    def run(px: pa.Array, py: pa.Array) -> pa.Array:
        return pa.array(contains(shape, px.to_numpy(zero_copy_only=False).astype(float), py.to_numpy(zero_copy_only=False).astype(float)))

    near = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    return F.when(near, F.arrow_udf(run, "boolean")(x, y)).otherwise(False)
