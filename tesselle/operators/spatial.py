"""Spatial joins as bucketed equi-joins, with box geometry in plain column expressions.

A range join never meets all pairs: each side is put into the lattice cells it touches, cells
are an equi-join key (shuffled, and split by adaptive execution if one is crowded), and the
exact test runs on what shares a cell.  A pair is kept only in the first cell it shares, so
no distinct is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.operators.prep import quantiles

#: Two shapes at most this far apart touch (sightlines; edge classes use the smaller one).
TOUCH_FT, CLASS_TOUCH_FT = 1e-6, 1e-9
#: A shared border longer than this is a wall between two tiles, a shorter one a corner.
ROOK_FT = 1.0


# ---------------------------------------------------------------- boxes


def gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))


def overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0))


def box_distance(a: str = "a", b: str = "b") -> Column:
    gx, gy = (gap(f"{a}_{c}0", f"{a}_{c}1", f"{b}_{c}0", f"{b}_{c}1") for c in "xy")
    return F.sqrt(gx * gx + gy * gy)


def shared_length(a: str = "a", b: str = "b") -> Column:
    """Length of what two touching boxes share (the perimeter, where they overlap in area)."""
    ox, oy = (overlap(f"{a}_{c}0", f"{a}_{c}1", f"{b}_{c}0", f"{b}_{c}1") for c in "xy")
    return F.when((ox > 0) & (oy > 0), 2 * (ox + oy)).otherwise(F.greatest(ox, oy, F.lit(0.0)))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def cells(df: DataFrame, prefix: str, size: float, reach: float = 0.0) -> DataFrame:
    """A row for every lattice cell that a box, grown by ``reach``, touches (columns cx, cy)."""
    first, last = (lambda c, r: F.floor((F.col(f"{prefix}_{c}0") - r) / size)), (lambda c, r: F.floor((F.col(f"{prefix}_{c}1") + r) / size))
    wide = df.withColumn("cx", F.explode(F.sequence(first("x", reach), last("x", reach))))
    return wide.withColumn("cy", F.explode(F.sequence(first("y", reach), last("y", reach))))


def _first_shared(size: float, reach: float) -> Column:
    """Whether (cx, cy) is the first cell that grown box a and box b share."""
    at = lambda c: F.floor(F.greatest(F.col(f"a_{c}0") - reach, F.col(f"b_{c}0")) / size)
    return (F.col("cx") == at("x")) & (F.col("cy") == at("y"))


def range_join(left: DataFrame, right: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """All pairs of boxes within ``reach`` (inclusive): columns ``a_*`` and ``b_*`` and ``distance``.

    ``size`` is the side of the lattice cells (by default twice the reach, 100 at least).  A box
    is a row in each cell it touches, which Catalyst's estimates don't see: a side is never broadcast.
    """
    side = size or max(100.0, 2 * reach)
    a, b = cells(prefixed(left, "a"), "a", side, reach), cells(prefixed(right, "b"), "b", side)
    met = a.hint("merge").join(b, ["cx", "cy"]).filter(_first_shared(side, reach))
    return met.withColumn("distance", box_distance()).filter(F.col("distance") <= reach).drop("cx", "cy")


def within_distance(boxes: DataFrame, reach: float) -> DataFrame:
    """``(src, dst, distance)`` with src < dst: the boxes at most ``reach`` apart."""
    return range_join(boxes, boxes, reach).filter("a_id < b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "distance", *(f"{s}_{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1")))


# ---------------------------------------------------------------- sightlines


def sightlines(pairs: DataFrame, epsilon: float) -> DataFrame:
    """Add the ends ``px, py, qx, qy`` of the segment between two boxes that don't touch.

    Where the boxes face each other along an axis it runs at the middle of the overlap, else
    between the facing sides; both ends are drawn in by min(epsilon, a quarter of it).
    """

    def ends(c: str) -> tuple[Column, Column]:
        a0, a1, b0, b1 = (F.col(f"{s}_{c}{k}") for s in "ab" for k in "01")
        middle = (F.greatest(a0, b0) + F.least(a1, b1)) / 2
        p = F.when(a1 < b0, a1).when(b1 < a0, a0).otherwise(middle)
        q = F.when(a1 < b0, b0).when(b1 < a0, b1).otherwise(middle)
        return p, q

    (px, qx), (py, qy) = ends("x"), ends("y")
    out = pairs.withColumns({"px": px, "py": py, "qx": qx, "qy": qy})
    share = F.least(F.lit(epsilon), 0.25 * F.col("distance")) / F.col("distance")
    inward = {f"{e}{c}": F.col(f"{e}{c}") + share * (F.col(f"{o}{c}") - F.col(f"{e}{c}")) for e, o in ("pq", "qp") for c in "xy"}
    return out.withColumns(inward)


def crosses(box: str = "o") -> Column:
    """Whether the segment p-q meets a box: the parameters at which it is inside on each axis."""
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for c in "xy":
        p, d = F.col(f"p{c}"), F.col(f"q{c}") - F.col(f"p{c}")
        near, far = F.col(f"{box}_{c}0"), F.col(f"{box}_{c}1")
        moves = d != 0
        t0, t1 = F.when(moves, (near - p) / d), F.when(moves, (far - p) / d)
        lo, hi = F.greatest(lo, F.when(moves, F.least(t0, t1)).otherwise(0.0)), F.least(hi, F.when(moves, F.greatest(t0, t1)).otherwise(1.0))
        ok = ok & (moves | p.between(near, far))
    return ok & (lo <= hi)


def line_of_sight(pairs: DataFrame, obstacles: DataFrame, epsilon: float = 0.5, size: float = 200.0) -> DataFrame:
    """``(src, dst)`` of the pairs that touch or whose sightline no obstacle crosses.

    ``pairs`` come from :func:`within_distance`.  An obstacle that is one of the two boxes
    itself can't be met, as the ends are drawn in.
    """
    touching = pairs.filter(F.col("distance") <= TOUCH_FT).select("src", "dst")
    apart = sightlines(pairs.filter(F.col("distance") > TOUCH_FT), epsilon)
    lines = apart.select("src", "dst", "px", "py", "qx", "qy", *(f.alias(n) for n, f in (("a_x0", F.least("px", "qx")), ("a_x1", F.greatest("px", "qx")), ("a_y0", F.least("py", "qy")), ("a_y1", F.greatest("py", "qy")))))
    met = cells(lines, "a", size).join(cells(prefixed(obstacles, "o"), "o", size), ["cx", "cy"])
    blocked = met.filter(crosses("o")).select("src", "dst").distinct()
    return touching.unionByName(apart.select("src", "dst").join(blocked, ["src", "dst"], "left_anti"))


def select_obstacles(modeled: DataFrame, everything: DataFrame | None, mode: str, clear: Column | None = None) -> DataFrame:
    """What blocks a sightline: the modeled parcels, all, or all but those that are ``clear``.

    Without the whole table it's the modeled ones; without a way to tell clear ones, all.
    """
    if mode not in ("modeled", "all", "all_except"):
        raise ValueError(f"no such obstacle mode: {mode}")
    if mode == "modeled" or everything is None:
        return modeled
    return everything if mode == "all" or clear is None else everything.filter(~clear)


# ---------------------------------------------------------------- tiles


def grid_cells(bounds: DataFrame, size: float) -> DataFrame:
    """``(cell, x0, y0, x1, y1)``: the cells of a lattice through the origin that cover the bounds (one row)."""
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1)
    out = bounds.select(F.explode(steps("xmin", "xmax")).alias("i"), "ymin", "ymax").select("i", F.explode(steps("ymin", "ymax")).alias("j"))
    return out.select(F.concat_ws(":", "i", "j").alias("cell"), (F.col("i") * size).alias("x0"), (F.col("j") * size).alias("y0"), ((F.col("i") + 1) * size).alias("x1"), ((F.col("j") + 1) * size).alias("y1"))


def grid_lines(bounds: DataFrame, size: float) -> DataFrame:
    """``(x0, y0, x1, y1)``: the full-length lines of the same lattice, both ways, for each row of bounds (other columns are kept)."""
    keep = [c for c in bounds.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    snap = bounds.select(*keep, *((F.floor(F.col(c) / size) * size).alias(c) for c in ("xmin", "ymin")), *((F.ceil(F.col(c) / size) * size).alias(c) for c in ("xmax", "ymax")))
    at = lambda lo, hi: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.round((F.col(hi) - F.col(lo)) / size).cast("long")), lambda k: F.col(lo) + k * size))
    upright = snap.select(*keep, at("xmin", "xmax").alias("x0"), F.col("ymin").alias("y0"), F.col("ymax").alias("y1")).select(*keep, "x0", "y0", F.col("x0").alias("x1"), "y1")
    level = snap.select(*keep, at("ymin", "ymax").alias("y0"), F.col("xmin").alias("x0"), F.col("xmax").alias("x1")).select(*keep, "x0", "y0", "x1", F.col("y0").alias("y1"))
    return upright.unionByName(level)


def points_in_tiles(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """``points`` with ``tile_id``: the least tile that holds the point strictly inside, or null.

    A point lies in one lattice cell and a tile in the cells it touches, so the join is an
    equi-join on the cell.
    """
    t = cells(prefixed(tiles, "t"), "t", size).withColumnRenamed("t_id", "tile")
    p = points.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    inside = (F.col("px") > F.col("t_x0")) & (F.col("px") < F.col("t_x1")) & (F.col("py") > F.col("t_y0")) & (F.col("py") < F.col("t_y1"))
    first = p.select("parcel_id", "px", "py", "cx", "cy").join(t, ["cx", "cy"]).filter(inside).groupBy("parcel_id").agg(F.min("tile").alias("tile_id"))
    return points.join(first, "parcel_id", "left")


def virtual_tiles(placed: DataFrame) -> DataFrame:
    """``(parcel_id, tile_id, is_virtual)``: parcels in no tile get tiles of their own.

    New ids follow the largest one, in parcel order.  Orphans are numbered by range
    partitions and their sizes, so no task sees all of them.
    """
    top = placed.agg(F.coalesce(F.max("tile_id"), F.lit(-1)).alias("top"))
    orphans = placed.filter("tile_id is null").select("parcel_id")
    numbered = dense_numbers(orphans, "parcel_id").crossJoin(F.broadcast(top))
    own = numbered.select("parcel_id", (F.col("top") + 1 + F.col("number")).alias("tile_id"), F.lit(True).alias("is_virtual"))
    return placed.filter("tile_id is not null").select("parcel_id", "tile_id", F.lit(False).alias("is_virtual")).unionByName(own)


def dense_numbers(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``number``: the rank of each row by ``key`` from 0, for a unique integer key.

    Rows are ranked within buckets of equal key width and offset by the sizes of the buckets
    before; only the bucket sizes (at most ``buckets + 1`` rows) are ordered in one place.
    """
    span = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / buckets))
    cut = df.crossJoin(F.broadcast(span)).withColumn("_b", F.floor((F.col(key) - F.col("_lo")) / width)).drop("_lo", "_hi")
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return cut.withColumn("_in", inner).join(F.broadcast(before), "_b").withColumn("number", (F.col("_before") + F.col("_in")).cast("long")).drop("_b", "_in", "_before")


def lift_edges(edges: DataFrame, tile_of: DataFrame) -> DataFrame:
    """``(src, dst)`` between different tiles, from edges between parcels."""
    t = tile_of.select("parcel_id", "tile_id")
    a = edges.join(t.withColumnsRenamed({"parcel_id": "src", "tile_id": "ta"}), "src").join(t.withColumnsRenamed({"parcel_id": "dst", "tile_id": "tb"}), "dst")
    return a.filter("ta <> tb").select(F.least("ta", "tb").alias("src"), F.greatest("ta", "tb").alias("dst")).distinct()


def tile_adjacency(mode: str, tiles: DataFrame, parcels: DataFrame, tile_of: DataFrame, reach: float, sightline: bool = True, obstacles: DataFrame | None = None, epsilon: float = 0.5) -> DataFrame:
    """``(src, dst)`` between tiles, by the rule of the mode.

    ``tile``: tiles (boxes) within reach.  ``parcel``: tiles of parcels (boxes) within reach,
    with ``sightline`` only those whose sightline no obstacle crosses (the parcels themselves,
    unless others are given).
    """
    if mode == "tile":
        return within_distance(tiles, reach).select("src", "dst")
    if mode != "parcel":
        raise ValueError(f"no such adjacency mode: {mode}")
    near = within_distance(parcels, reach)
    edges = line_of_sight(near, (parcels if obstacles is None else obstacles).select("x0", "y0", "x1", "y1"), epsilon) if sightline else near.select("src", "dst")
    return lift_edges(edges, tile_of)


def tiles_of(parcels: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles ``(id, x0, y0, x1, y1)`` and, for the tile ids of ``parcels (parcel_id, tile_id, x0, ...)``
    that aren't among them, the outline of the first parcel that has them."""
    sides = ("x0", "y0", "x1", "y1")
    first = parcels.groupBy("tile_id").agg(F.min_by(F.struct(*sides), "parcel_id").alias("box"))
    lone = first.join(tiles.select(F.col("id").alias("tile_id")), "tile_id", "left_anti")
    return tiles.select("id", *sides).unionByName(lone.select(F.col("tile_id").alias("id"), "box.*"))


def adjacency_with_isolates(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(tile_id, neighbours)``: how many neighbours every tile has, isolated ones included."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    counted = both.groupBy(F.col("src").alias("tile_id")).agg(F.countDistinct("dst").alias("neighbours"))
    return tiles.select("tile_id").distinct().join(counted, "tile_id", "left").select("tile_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def nearest(point: tuple[float, float], boxes: DataFrame, within: float) -> DataFrame:
    """The box that holds the point, else the nearest one within a distance: ``(id, distance)``, a row at most."""
    x, y = point
    gx = F.greatest(F.lit(0.0), F.col("x0") - x, x - F.col("x1"))
    gy = F.greatest(F.lit(0.0), F.col("y0") - y, y - F.col("y1"))
    near = boxes.filter((F.col("x0") <= x + within) & (F.col("x1") >= x - within) & (F.col("y0") <= y + within) & (F.col("y1") >= y - within))
    return near.select("id", F.sqrt(gx * gx + gy * gy).alias("distance")).filter(F.col("distance") <= within).orderBy("distance", "id").limit(1)


# ---------------------------------------------------------------- edge classes


def edge_classes(pairs: DataFrame) -> DataFrame:
    """``(src, dst, edge_class, gap_ft)``: rook (a shared wall), corner or gap.

    The distance settles a gap; only touching pairs look at what they share.
    """
    kind = F.when(F.col("distance") > CLASS_TOUCH_FT, "gap").when(shared_length() > ROOK_FT, "rook").otherwise("corner")
    return pairs.select("src", "dst", kind.alias("edge_class"), F.when(F.col("distance") > CLASS_TOUCH_FT, F.col("distance")).otherwise(0.0).alias("gap_ft"))


def draw_segments(pairs: DataFrame) -> DataFrame:
    """``(src, dst, kind, x0, y0, x1, y1)``: a line between the middles of two boxes, and across a gap."""
    middle = lambda s, c: (F.col(f"{s}_{c}0") + F.col(f"{s}_{c}1")) / 2
    nodes = pairs.select("src", "dst", F.lit("node").alias("kind"), middle("a", "x").alias("x0"), middle("a", "y").alias("y0"), middle("b", "x").alias("x1"), middle("b", "y").alias("y1"))
    across = sightlines(pairs.filter(F.col("distance") > CLASS_TOUCH_FT), 0.0)
    return nodes.unionByName(across.select("src", "dst", F.lit("crossing").alias("kind"), F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("qx").alias("x1"), F.col("qy").alias("y1")))


def weak_tiles(edges: DataFrame) -> DataFrame:
    """``(tile_id, rook, any)`` of tiles that hang on their label only by corners or gaps.

    ``edges``: ``(src, dst, edge_class)`` within one label.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("tile_id"), "edge_class")
    degree = ends.groupBy("tile_id").agg(F.sum((F.col("edge_class") == "rook").cast("long")).alias("rook"), F.count("*").alias("any"))
    return degree.filter("rook = 0 and any > 0")


def class_summary(edges: DataFrame) -> DataFrame:
    """``(edge_class, n, percent, median_gap, max_gap)``, a row for each class that occurs."""
    kinds = ("rook", "corner", "gap")
    own = edges.select("edge_class", "gap_ft", *(F.when(F.col("edge_class") == k, F.col("gap_ft")).alias(f"gap_{k}") for k in kinds))
    middle = quantiles(own, [f"gap_{k}" for k in kinds], [0.5])
    median = F.create_map(*(x for k in kinds for x in (F.lit(k), F.lit(middle[f"gap_{k}"][0]).cast("double"))))
    whole = edges.agg(F.count("*").alias("whole"))
    by = edges.groupBy("edge_class").agg(F.count("*").alias("n"), F.max("gap_ft").alias("max_gap"))
    return by.crossJoin(F.broadcast(whole)).select("edge_class", "n", (100.0 * F.col("n") / F.col("whole")).alias("percent"), median[F.col("edge_class")].alias("median_gap"), "max_gap")
