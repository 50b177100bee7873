"""All queries on the spatial engine: name -> (spark, sf_dir) -> DataFrame.

Parcels are a view over orders and lineitem (see :mod:`tesselle.sources.tables`); tiles are
lattice cells; box footprints make every spatial operator expressible in SQL as well.  The
SQL twins are in :mod:`tesselle.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.functions import linework, shapes, text
from tesselle.operators import anneal, graph, moves, prep, scoring, seeding, spatial
from tesselle.operators.components import connected_components
from tesselle.plans.oracles import ORACLES as ORACLES
from tesselle.scratch import stash
from tesselle.sources import features, store, tables
from tesselle.sources import parcels as parcel_files
from tesselle.streaming import progress

#: Fields that the score queries use and their weights.
WEIGHTS = {"assr_impr_ppsf": 1.5, "assr_land_ppsf": 1.5, "assr_market_value": 0.5}
BINS = 30
REACH_FT = 100.0


def number(column: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero, so that two engines print the same."""
    return F.round(column, digits) + F.lit(0.0)


def tab(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def weights(spark: SparkSession) -> DataFrame:
    return tab(spark, sorted(WEIGHTS.items()), "field string, weight double")


# ---------------------------------------------------------------- shared steps


def derived(s: SparkSession, d: str) -> DataFrame:
    p = prep.derive_ratios(tables.parcels(s, d))
    return p.withColumns({"tile_id": tables.lattice_id("px", "py", 1000.0, 10), "nid": tables.lattice_id("px", "py", 2500.0, 4)})


def binned(s: SparkSession, d: str) -> DataFrame:
    """The scored fields in quantile bins; the fields are written first, since edges and bins read them several times."""
    fields = stash(derived(s, d).select("parcel_id", "tile_id", "nid", *WEIGHTS))
    out = prep.quantile_bins(fields, list(WEIGHTS), BINS)
    return out.select("parcel_id", "tile_id", "nid", *(F.col(prep.scored_name(f)).alias(f) for f in WEIGHTS))


def codes(s: SparkSession, d: str) -> DataFrame:
    return prep.bin_codes(binned(s, d), list(WEIGHTS))


def tile_cells(s: SparkSession, d: str) -> DataFrame:
    return stash(scoring.tile_cells(codes(s, d)))


def scores(s: SparkSession, d: str, exact: bool = False) -> DataFrame:
    return scoring.score_labels(codes(s, d), weights(s), exact=exact)


def lattice(s: SparkSession, d: str) -> DataFrame:
    """All parcels on 500 ft tiles, with start labels that lie across the strips of :func:`lattice_pairs`."""
    return tables.positions(s, d).withColumns({"tile_id": tables.lattice_id("px", "py", 500.0, 100), "nid": tables.lattice_id("px", "py", 4000.0, 3)})


def tile_boxes(p: DataFrame, size: float, columns: int) -> DataFrame:
    t = p.select("tile_id").distinct()
    i, j = F.floor(F.col("tile_id") / columns), F.col("tile_id") % columns
    return t.select(F.col("tile_id").alias("id"), (i * size).cast("double").alias("x0"), (j * size).cast("double").alias("y0"), ((i + 1) * size).cast("double").alias("x1"), ((j + 1) * size).cast("double").alias("y1"))


def lattice_pairs(s: SparkSession, d: str) -> DataFrame:
    """Adjacent tiles of one strip of five columns: canals between the strips make islands of them."""
    strip = lambda end: F.floor(F.col(end) / 500)
    return spatial.within_distance(tile_boxes(lattice(s, d), 500.0, 100), REACH_FT).filter(strip("src") == strip("dst"))


def lattice_edges(s: SparkSession, d: str) -> DataFrame:
    return lattice_pairs(s, d).select("src", "dst")


def lattice_components(s: SparkSession, d: str) -> DataFrame:
    p = lattice(s, d)
    return graph.tile_components(lattice_edges(s, d), p.select("tile_id"))


def coarse_edges(s: SparkSession, d: str) -> DataFrame:
    """Adjacent populated 1000 ft tiles."""
    return spatial.within_distance(tile_boxes(tables.placed(s, d), 1000.0, 10), REACH_FT).select("src", "dst")


def footprints(s: SparkSession, d: str) -> DataFrame:
    return tables.boxes(s, d)


def near_footprints(s: SparkSession, d: str) -> DataFrame:
    return spatial.within_distance(footprints(s, d), REACH_FT)


def sight_edges(s: SparkSession, d: str) -> DataFrame:
    return spatial.line_of_sight(near_footprints(s, d), footprints(s, d).drop("id"))


def border(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = moves.tile_labels(tables.placed(s, d))
    return moves.boundary(coarse_edges(s, d), labels), labels


def donation_gains(s: SparkSession, d: str, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    b, labels = border(s, d)
    ways = moves.donations(b, labels)
    return ways, moves.gains(moves.donation_sides(ways), cells or tile_cells(s, d), weights(s))


def swap_gains(s: SparkSession, d: str, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    b, labels = border(s, d)
    ways = moves.swaps(b, labels)
    return ways, moves.gains(moves.swap_sides(ways), cells or tile_cells(s, d), weights(s))


def all_gains(s: SparkSession, d: str) -> DataFrame:
    """Donations and swaps with their gains and the batch they were drawn in."""
    cells = tile_cells(s, d)
    (a, ga), (b, gb) = donation_gains(s, d, cells), swap_gains(s, d, cells)
    both = a.join(ga, "cand").select("cand", "kind", "n1", "n2", "gain").unionByName(b.join(gb, "cand").select("cand", "kind", "n1", "n2", "gain"))
    return both.withColumn("batch", F.least("n1", "n2") % 4).withColumn("gain", number("gain", 9))


def refused(s: SparkSession, d: str) -> DataFrame:
    """``(cand)``: the moves over the boundary that would split a label or set a swapped tile down alone."""
    b, labels = border(s, d)
    return moves.breaking(moves.donations(b, labels), moves.swaps(b, labels), coarse_edges(s, d), labels)


def islands_of(s: SparkSession, d: str) -> DataFrame:
    b, labels = border(s, d)
    return moves.islands(moves.swaps(b, labels), coarse_edges(s, d), labels)


def splits_of(s: SparkSession, d: str) -> DataFrame:
    labels = moves.tile_labels(lattice(s, d))
    b = moves.boundary(lattice_edges(s, d), labels)
    return moves.disconnecting(moves.donations(b, labels), lattice_edges(s, d), labels)


def gapped_tiles(s: SparkSession, d: str) -> DataFrame:
    """1000 ft tiles drawn 40 ft smaller where (column + row) is odd: walls, corners and gaps."""
    t = tile_boxes(tables.placed(s, d), 1000.0, 10)
    odd = (F.floor(F.col("id") / 10) + F.col("id") % 10) % 2 == 1
    shrink = F.when(odd & (F.col("id") % 3 == 0), 40.0).otherwise(0.0)
    return t.select("id", "x0", "y0", (F.col("x1") - shrink).alias("x1"), (F.col("y1") - shrink).alias("y1"))


def classed(s: SparkSession, d: str) -> DataFrame:
    return spatial.edge_classes(spatial.within_distance(gapped_tiles(s, d), 50.0))


def checkerboard(s: SparkSession, d: str) -> DataFrame:
    """Tiles labelled by three colours along diagonals, so that corners matter."""
    return tables.placed(s, d).select("tile_id").distinct().select("tile_id", ((F.floor(F.col("tile_id") / 10) + F.col("tile_id") % 10) % 3).cast("long").alias("nid"))


def inner_edges(s: SparkSession, d: str) -> DataFrame:
    lab = checkerboard(s, d)
    a = classed(s, d).join(lab.withColumnsRenamed({"tile_id": "src", "nid": "ns"}), "src").join(lab.withColumnsRenamed({"tile_id": "dst", "nid": "nd"}), "dst")
    return a.filter("ns = nd").select("src", "dst", "edge_class", F.col("ns").alias("nid"))


def fragments(s: SparkSession, d: str) -> DataFrame:
    """For each label, into how many parts it falls by walls alone and by walls and corners."""
    lab, inner = checkerboard(s, d), inner_edges(s, d)
    out = None
    for name, kinds in (("rook", ["rook"]), ("rook+corner", ["rook", "corner"])):
        parts = graph.tile_components(inner.filter(F.col("edge_class").isin(kinds)).select("src", "dst"), lab)
        one = lab.join(parts, "tile_id").groupBy("nid").agg(F.countDistinct("component").alias("pieces")).withColumn("accepted", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def relabels(s: SparkSession, d: str) -> DataFrame:
    """Events as relabels: a parcel is a user, an iteration a hundred events."""
    e = tables.scan(s, d, "events")
    return e.select(F.floor(F.col("event_id") / 100).cast("long").alias("iteration"), F.col("user_id").alias("parcel"))


def places(s: SparkSession) -> DataFrame:
    rows = [("Leesburg city", "Leesburg", "12", 40.0), ("Lee CDP", "Lee", "12", 3.0), ("Lee County", "Lee", "12", 800.0), ("Lee County", "Lee", "01", 600.0), ("Leeds city", "Leeds", "01", 22.0), ("Fort Myers city", "Fort Myers", "12", 49.0), ("Fort Myers Beach town", "Fort Myers Beach", "12", 6.0), ("Upper Lee village", "Upper Lee", "12", 2.0)]
    return tab(s, rows, "name string, basename string, state string, area double")


PLACE_QUERIES = ["Fort Myers, FL", "Lee County Florida", "Charleston West Virginia", "Bonita Springs FL", "Cape Coral", "Paris, Texas", "Lake, Of, The Woods, mn", "  Reno  ", "FL"]
AREA_NAMES = ["Lee County", "Iosco charter township", "Valdez-Cordova Census Area", "Chicago", "County", "Juneau City and Borough", "Carson City", "  Bristol town  ", "Nashville metropolitan government county"]
FILE_NAMES = ["Fort Myers, FL", "  --  ", "Éire 9", "a__b", "Lee County"]
CHECKPOINTS = [("r1", i * 100, False) for i in range(1, 8)] + [("r1", 700, True), ("r2", 50, False), ("r2", 60, False), ("r3", 10, True)]
RESPONSES = [(1, 200, None), (2, 200, "runtime error: Query timed out"), (3, 429, None), (4, 503, ""), (5, 504, None), (6, 400, None), (7, 200, "ok"), (8, 200, "Too Many rows")]
CONFIG = {
    "parcel_filter_column": "model_grp", "parcel_filter_value": "single_family", "adjacency_mode": "parcel", "obstacle_mode": "all_except", "land_class_column": "land_class",
    "continuous_variables": ["assr_market_value", "assr_impr_ppsf", "nowhere"], "seed_fields": ["px", "nowhere_else"], "weights": {"assr_market_value_binned": 0.5, "land_area_sqft_binned": 0.25, "ghost_binned": 1.0},
}


def words(s: SparkSession, values: list[str], name: str = "v") -> DataFrame:
    return tab(s, [(v,) for v in values], f"{name} string")


def universe(s: SparkSession, d: str) -> list[tuple[str, str]]:
    return tables.field_universe(tables.parcels(s, d).schema, prep.DERIVED_RATIOS)


def sizes_of(s: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(lattice(s, d), lattice_components(s, d))


def split_of(s: SparkSession, d: str) -> DataFrame:
    return graph.split_labels(lattice(s, d), lattice_components(s, d))


def annealed(s: SparkSession, d: str) -> DataFrame:
    """Each island refined by its own chain, on the operator's own schedule."""
    p, parts = lattice(s, d), stash(lattice_components(s, d))
    fields = list(WEIGHTS)
    bins = stash(binned(s, d).select("parcel_id", *fields))
    coded = prep.wide_codes(bins, fields)
    lab = graph.split_labels(p, parts).select("parcel_id", "component", F.col("split").alias("nid"))
    ready = stash(p.drop("nid").join(lab, "parcel_id").join(coded, "parcel_id").select("parcel_id", "tile_id", "nid", "component", *fields))
    groups = stash(graph.group_components(graph.component_sizes(p, parts), 4))
    overall = scoring.global_histogram(ready.unpivot(["parcel_id"], fields, "field", "code"))
    out = anneal.anneal(ready, lattice_edges(s, d), groups, overall, WEIGHTS, anneal.Schedule())
    return out.select("group_id", "parcel_id", "nid")


def near_point(s: SparkSession, d: str) -> DataFrame:
    asked = [(700.0, 700.0), (5000.0, 5000.0), (9990.0, 10.0)]
    out = None
    for k, point in enumerate(asked):
        one = spatial.nearest(point, footprints(s, d), 400.0).select(F.lit(k).alias("query"), "id", number("distance").alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def adjacency_modes(s: SparkSession, d: str) -> DataFrame:
    """Edges between 1000 ft tiles by every rule."""
    everything = footprints(s, d)
    out = None
    for name, mode, sightline in (("tile", "tile", False), ("near", "parcel", False), ("sight", "parcel", True)):
        one = spatial.tile_adjacency(mode, gapped_tiles(s, d), everything, tables.placed(s, d), REACH_FT, sightline).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def tiles_from_cache(s: SparkSession, d: str) -> DataFrame:
    """The gapped tiles, and the outlines of parcels that lie in none, rebuilt from placed parcels."""
    t = gapped_tiles(s, d)
    seats = spatial.virtual_tiles(spatial.points_in_tiles(tables.positions(s, d), t, 1000.0)).select("parcel_id", "tile_id")
    return spatial.tiles_of(seats.join(footprints(s, d).withColumnRenamed("id", "parcel_id"), "parcel_id"), t)


def scanned(s: SparkSession, d: str) -> DataFrame:
    """A parcel file with outlines, filtered, clipped to an area, and binned."""
    own = tables.parcels(s, d).join(tables.scan(s, d, "orders").select(F.col("o_orderkey").alias("parcel_id"), "o_orderstatus"), "parcel_id")
    boxed = own.join(footprints(s, d).withColumnRenamed("id", "parcel_id"), "parcel_id").drop("px", "py")
    file = stash(boxed.select("parcel_id", "o_orderstatus", "assr_market_value", "bldg_area_finished_sqft", parcel_files.with_crs(shapes.box_wkb("x0", "y0", "x1", "y1"), "EPSG:2237")))
    config = store.RunConfig(parcel_filter_column="o_orderstatus", parcel_filter_value="F", continuous_variables=["assr_market_value", "assr_impr_ppsf"], max_bins=10, weights={"assr_market_value_binned": 1.0})
    area = shapes.polygon_wkb([[(1000.0, 500.0), (9e9, 500.0), (9e9, 9000.0), (1000.0, 9000.0), (1000.0, 500.0)]])
    out = parcel_files.load_parcels(s, file.stash_path, config, "EPSG:2237", area)
    return out.select("parcel_id", number("px").alias("px"), number("py").alias("py"), "assr_market_value_binned", "assr_impr_ppsf_binned")


def elements(s: SparkSession, d: str) -> DataFrame:
    """Parcels as JSON map elements: closed ways, open ways, and relations of two halves with a hole."""
    point = lambda dx, dy: F.struct((F.col("px") + dx).alias("lon"), (F.col("py") + dy).alias("lat"))
    path = lambda *corners: F.array(*(point(*c) for c in corners))
    member = lambda role, *corners: F.struct(F.lit(role).alias("role"), path(*corners).alias("geometry"))
    ring = [(-25, -25), (25, -25), (25, 25), (-25, 25), (-25, -25)]
    hole = [(-10, -10), (10, -10), (10, 10), (-10, 10), (-10, -10)]
    parts = F.array(member("outer", *ring[:3]), member("inner", *hole), member("", *ring[2:]), member("outer", (0, 0)))
    kind = F.col("parcel_id") % 3
    way = F.struct(F.lit("way").alias("type"), F.col("parcel_id").alias("id"), F.when(kind == 0, path(*ring)).otherwise(path(*ring[:3])).alias("geometry"))
    relation = F.struct(F.lit("relation").alias("type"), F.col("parcel_id").alias("id"), parts.alias("members"))
    return tables.positions(s, d).select("parcel_id", F.when(kind < 2, F.to_json(way)).otherwise(F.to_json(relation)).alias("element"))


def stream_novelty(s: SparkSession, d: str) -> DataFrame:
    """The novelty windows of ``events`` read as a stream, after the stream has ended."""
    import uuid

    name = f"novelty_{uuid.uuid4().hex[:8]}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = progress.novelty(events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "1 hour", late="10 minutes")
    query = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return s.table(name).select("start", "events", "distinct_users", number("novelty").alias("novelty"))


def stamped(df: DataFrame) -> DataFrame:
    """Window starts as text, which reads alike in every engine and time zone."""
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def universe_frame(s: SparkSession, d: str) -> DataFrame:
    return tab(s, universe(s, d), "name string, kind string")


# ---------------------------------------------------------------- the queries


QUERIES = {
    # scans, projections and filters
    "derived_ratio": lambda s, d: derived(s, d).select("parcel_id", number("assr_impr_ppsf").alias("assr_impr_ppsf"), number("assr_land_ppsf").alias("assr_land_ppsf")),
    "filter_string_eq": lambda s, d: prep.filter_equal(tables.scan(s, d, "part"), "p_size", "15").select("p_partkey", "p_size"),
    "coerce_numeric": lambda s, d: tables.scan(s, d, "part").select("p_partkey", prep.numeric(F.regexp_replace("p_brand", "^Brand#", "")).alias("brand_number"), prep.numeric("p_type").alias("type_number")),
    "qcut_bins": lambda s, d: binned(s, d).withColumnsRenamed({f: prep.scored_name(f) for f in WEIGHTS}),
    "bin_codes": lambda s, d: codes(s, d).select("parcel_id", "field", "code"),
    "field_universe": universe_frame,
    "validate_config": lambda s, d: prep.validate_fields(s, universe(s, d), CONFIG).select("setting", "value", "fatal"),
    "distinct_values_topk": lambda s, d: prep.distinct_values(tables.scan(s, d, "part"), "p_type", 20),
    "transparent_classes": lambda s, d: words(s, ["SINGLE FAMILY RESIDENTIAL", "RIGHT-OF-WAY", "Road R/W", "RIVERS, LAKES, SUBMERGED LAND", "VACANT AGRICULTURAL", "utility easement", "CROWN LAND", None], "land_class").select("land_class", prep.transparent("land_class").alias("transparent")),
    "clip_within_box": lambda s, d: tables.positions(s, d).filter("px > 1000 and px < 4000 and py > 2000 and py < 9000").select("parcel_id"),
    "clip_within_polygon": lambda s, d: tables.positions(s, d).filter(shapes.within_polygon("px", "py", shapes.polygon_wkb([[(1000, 1000), (9000, 2000), (5000, 9000), (1000, 1000)], [(4000, 3000), (5000, 3000), (5000, 4000), (4000, 4000), (4000, 3000)]]))).select("parcel_id"),
    "bounds_aggregate": lambda s, d: tables.positions(s, d).agg(F.min("px").alias("xmin"), F.min("py").alias("ymin"), F.max("px").alias("xmax"), F.max("py").alias("ymax")),
    "viewport_count": lambda s, d: tables.placed(s, d).filter("px between 2000 and 6000 and py between 1000 and 3000").agg(F.count("*").alias("visible"), F.countDistinct("tile_id").alias("tiles")),
    "median_impute": lambda s, d: seeding.impute(stash(derived(s, d).select("parcel_id", "assr_impr_ppsf", "bldg_area_finished_sqft")), ["assr_impr_ppsf", "bldg_area_finished_sqft"]).select("parcel_id", number("assr_impr_ppsf").alias("assr_impr_ppsf"), number("bldg_area_finished_sqft").alias("bldg_area_finished_sqft")),
    # histograms and scores
    "hist_global": lambda s, d: scoring.global_histogram(codes(s, d)),
    "hist_by_neighborhood": lambda s, d: scoring.label_histogram(codes(s, d)),
    "totals": lambda s, d: scoring.totals(tables.placed(s, d)),
    "tile_delta": lambda s, d: scoring.tile_deltas(codes(s, d)),
    "mi_score": lambda s, d: scores(s, d).select("nid", "n", number("score").alias("score")),
    "mi_score_exact": lambda s, d: scores(s, d, True).select("nid", "n", number("score").alias("score")),
    "weighted_score": lambda s, d: scoring.weighted_score(scores(s, d)).select(number("num", 4).alias("num"), "den", number("weighted_score").alias("weighted_score")),
    "mean_score": lambda s, d: scoring.mean_score(scores(s, d)).select("labels", "active", number("mean_score").alias("mean_score")),
    # tiles and spatial joins
    "grid_cells": lambda s, d: spatial.grid_cells(tab(s, [(-120.0, 30.0, 1950.0, 1210.0)], "xmin double, ymin double, xmax double, ymax double"), 500.0),
    "grid_lines": lambda s, d: spatial.grid_lines(tab(s, [(-120.0, 30.0, 1950.0, 1210.0)], "xmin double, ymin double, xmax double, ymax double"), 500.0),
    "shatter_tiles": lambda s, d: shattered(s, d).select("area_id", "tile_id", number("sqft", 3).alias("sqft")),
    "water_clip": lambda s, d: clipped(s, d).groupBy("tile_id").agg(number(F.sum("sqft"), 3).alias("sqft")),
    "point_in_tile": lambda s, d: spatial.points_in_tiles(tables.positions(s, d), gapped_tiles(s, d), 1000.0).select("parcel_id", "tile_id"),
    "virtual_tiles": lambda s, d: spatial.virtual_tiles(spatial.points_in_tiles(tables.positions(s, d), gapped_tiles(s, d), 1000.0)),
    "populated_tiles": lambda s, d: spatial.grid_cells(tables.positions(s, d).agg(F.min("px").alias("xmin"), F.min("py").alias("ymin"), (F.max("px") + 2000).alias("xmax"), F.max("py").alias("ymax")), 1000.0).join(
        tables.positions(s, d).select(F.concat_ws(":", F.floor(F.col("px") / 1000), F.floor(F.col("py") / 1000)).alias("cell")), "cell", "left_semi"
    ).select("cell"),
    "dwithin_boxes": lambda s, d: near_footprints(s, d).select("src", "dst", number("distance").alias("distance")),
    "los_edges": lambda s, d: sight_edges(s, d),
    "tile_lift": lambda s, d: spatial.lift_edges(near_footprints(s, d).select("src", "dst"), tables.placed(s, d)),
    "adjacency_isolates": lambda s, d: spatial.adjacency_with_isolates(lattice_edges(s, d), lattice(s, d)),
    "obstacles_by_mode": lambda s, d: obstacle_modes(s, d),
    "nearest_tile": near_point,
    "adjacency_modes": adjacency_modes,
    "tiles_from_cache": tiles_from_cache,
    "parcel_scan": scanned,
    "json_lines": lambda s, d: features.lines(elements(s, d)).select("parcel_id", "line", F.size("points").alias("points"), number(F.col("points")[0]["lon"]).alias("lon"), number(F.col("points")[0]["lat"]).alias("lat")),
    "json_polygons": lambda s, d: features.polygons(elements(s, d)).select("parcel_id", "part", number(shapes.wkb_area("geom"), 3).alias("sqft")),
    "transparent_report": lambda s, d: prep.transparent_classes(tables.scan(s, d, "part"), "p_name", ("RING", "bolt")),
    "owned_labels": lambda s, d: graph.owned_labels(moves.tile_labels(lattice(s, d))),
    "union_dedupe": lambda s, d: shapes.distinct_shapes(outlines(footprints(s, d)).unionByName(outlines(gapped_tiles(s, d))).unionByName(outlines(footprints(s, d)))).select("x0", "y0", "x1", "y1"),
    "states_for_bounds": lambda s, d: tab(s, [("12", -87.6, 24.5, -80.0, 31.0), ("13", -85.6, 30.4, -80.8, 35.0), ("01", -88.5, 30.2, -84.9, 35.0), ("13", -85.6, 30.4, -80.8, 35.0), ("48", -106.6, 25.8, -93.5, 36.5)], "state string, x0 double, y0 double, x1 double, y1 double").filter("x0 <= -84.0 and x1 >= -85.2 and y0 <= 30.9 and y1 >= 30.1").select("state").dropDuplicates(),
    "crs_choice": lambda s, d: tab(s, [("EPSG:2236", 90.0, False), ("EPSG:2237", 80.0, False), ("EPSG:26759", 12.0, True), ("EPSG:6438", 95.0, False)], "crs string, area double, nad27 boolean").agg(F.min_by("crs", F.col("area") * F.when(F.col("nad27"), 10.0).otherwise(1.0)).alias("crs")),
    # graph
    "connected_components": lambda s, d: connected_components(lattice_edges(s, d)),
    "component_sizes": lambda s, d: sizes_of(s, d),
    "component_summary": lambda s, d: graph.component_summary(sizes_of(s, d)).withColumn("ceiling", number("ceiling")),
    "parcel_component": lambda s, d: lattice(s, d).join(lattice_components(s, d), "tile_id").select("parcel_id", "component"),
    "split_labels": lambda s, d: split_of(s, d),
    "spanning": lambda s, d: graph.spanning_labels(lattice(s, d), lattice_components(s, d)),
    "label_pieces": lambda s, d: graph.label_pieces(lattice(s, d), lattice_edges(s, d)),
    "worst_labels": lambda s, d: graph.worst_labels(graph.label_pieces(lattice(s, d), lattice_edges(s, d))),
    "lpt_groups": lambda s, d: graph.group_components(sizes_of(s, d), 3),
    "worker_count": lambda s, d: graph.useful_workers(sizes_of(s, d)),
    "group_loads": lambda s, d: graph.group_loads(sizes_of(s, d), graph.group_components(sizes_of(s, d), 3)),
    "mixed_tiles": lambda s, d: moves.tile_labels(tables.placed(s, d)).filter("mixed").select("tile_id", "nid", "parcels"),
    "boundary_edges": lambda s, d: border(s, d)[0],
    "donation_gain": lambda s, d: donation_gains(s, d)[1].select("cand", number("gain").alias("gain")),
    "swap_gain": lambda s, d: swap_gains(s, d)[1].select("cand", number("gain").alias("gain")),
    "best_move": lambda s, d: moves.best_moves(all_gains(s, d)).select("batch", "cand", "kind", number("gain").alias("gain")),
    "legal_move": lambda s, d: moves.best_moves(all_gains(s, d).join(refused(s, d), "cand", "left_anti")).select("batch", "cand", "kind", number("gain").alias("gain")),
    "refused_moves": refused,
    "island_test": islands_of,
    "articulation_test": splits_of,
    "consolidate_jacobi": lambda s, d: moves.consolidate_at_once(tile_cells(s, d), weights(s)).select("tile_id", "nid", number("score").alias("score")),
    "expand_labels": lambda s, d: graph.expand_labels(tables.placed(s, d).select("parcel_id", "tile_id", "nid"), moves.tile_labels(tables.placed(s, d)).filter("mixed")),
    "edge_class": lambda s, d: classed(s, d).withColumn("gap_ft", number("gap_ft")),
    "edge_class_pct": lambda s, d: spatial.class_summary(stash(classed(s, d))).select("edge_class", "n", number("percent").alias("percent"), number("median_gap").alias("median_gap"), number("max_gap").alias("max_gap")),
    "weak_tiles": lambda s, d: spatial.weak_tiles(inner_edges(s, d)),
    "fragments_by_class": fragments,
    "neighbors_of": lambda s, d: graph.neighbours_of(classed(s, d), 44),
    "joint_edges": lambda s, d: inner_edges(s, d),
    "draw_segments": lambda s, d: spatial.draw_segments(spatial.within_distance(gapped_tiles(s, d), 50.0)).select("src", "dst", "kind", *(number(c).alias(c) for c in ("x0", "y0", "x1", "y1"))),
    "selection_report": lambda s, d: inner_edges(s, d).select(F.explode(F.array("src", "dst")).alias("tile_id"), "edge_class").groupBy("tile_id", "edge_class").agg(F.count("*").alias("edges")),
    "kmeans_seed": lambda s, d: seeding.seed_labels(derived(s, d), ["px", "py", "assr_market_value"], 12),
    "anneal_grouped": annealed,
    # progress over time
    "novelty_window": lambda s, d: stamped(progress.novelty(tables.scan(s, d, "events"), "1 hour")).withColumn("novelty", number("novelty")),
    "novelty_sliding": lambda s, d: stamped(progress.novelty(tables.scan(s, d, "events"), "2 hours", "1 hour")).withColumn("novelty", number("novelty")),
    "novelty_stream": lambda s, d: stamped(stream_novelty(s, d)),
    "progress_ratio": lambda s, d: progress.trailing_ratio(relabels(s, d), 5).withColumn("ratio", number("ratio")),
    "change_fraction": lambda s, d: progress.change_fraction(relabels(s, d).groupBy("parcel").agg(F.max("iteration").alias("iteration")), 100, 20).withColumn("fraction", number("fraction")),
    "stability_streak": lambda s, d: progress.calm_streaks(progress.trailing_ratio(relabels(s, d), 5).select(F.col("iteration").alias("start"), F.col("ratio").alias("novelty")), 0.96, 3).withColumn("novelty", number("novelty")),
    "parallel_stats": lambda s, d: progress.merged_stats(worker_messages(s, d)).select("iteration", number("temperature").alias("temperature"), "accepted", "rejected", "boundary", number("score").alias("score")),
    # names, files and services
    "parse_place": lambda s, d: words(s, PLACE_QUERIES, "query").select("query", text.parse_place("query").alias("p")).select("query", "p.name", "p.fips"),
    "strip_suffix": lambda s, d: words(s, AREA_NAMES, "name").select("name", text.strip_suffix("name").alias("bare")),
    "rank_places": lambda s, d: text.rank_places(places(s), "Lee County, FL"),
    "slugify": lambda s, d: words(s, FILE_NAMES, "name").select("name", text.slug("name").alias("slug")),
    "cache_key_sha1": lambda s, d: tables.scan(s, d, "customer").select("c_custkey", text.cache_key("c_name").alias("key")),
    "color_hash": lambda s, d: tables.scan(s, d, "customer").select("c_custkey", text.label_colour("c_custkey").alias("colour")),
    "quadsplit": lambda s, d: shapes.quad_leaves(tab(s, [(0.0, 0.0, 0.4, 0.4)], "x0 double, y0 double, x1 double, y1 double"), 0.015).select(*(number(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1"))),
    "response_policy": lambda s, d: tab(s, RESPONSES, "id int, status int, remark string").select("id", text.response_action("status", "remark").alias("action")),
    "escape_quotes": lambda s, d: words(s, ["O'Brien", "plain", "''"], "name").select("name", text.escape_quotes("name").alias("escaped")),
    "candidate_years": lambda s, d: s.range(1).select(F.explode(text.candidate_years(F.lit("2026-07-28").cast("date"))).alias("year")),
    "json_elements": lambda s, d: tables.scan(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
    "checkpoint_prune": lambda s, d: store.prune_order(tab(s, CHECKPOINTS, "run_id string, iteration int, is_final boolean"), 3),
    "latest_checkpoint": lambda s, d: store.latest(tab(s, CHECKPOINTS, "run_id string, iteration int, is_final boolean")),
}


def obstacle_modes(s: SparkSession, d: str) -> DataFrame:
    """How many footprints block a sightline in each mode."""
    everything = tables.positions(s, d).select("parcel_id", F.when(F.col("parcel_id") % 10 == 0, "RIGHT-OF-WAY").otherwise("HOUSE").alias("land_class"))
    modeled = everything.filter("parcel_id % 2 = 0")
    out = None
    for mode in ("modeled", "all", "all_except"):
        one = spatial.select_obstacles(modeled, everything, mode, prep.transparent("land_class")).agg(F.lit(mode).alias("mode"), F.count("*").alias("obstacles"))
        out = one if out is None else out.unionByName(one)
    return out


def outlines(boxes: DataFrame) -> DataFrame:
    """Boxes with their outline as a polygon."""
    return boxes.withColumn("geom", shapes.box_wkb("x0", "y0", "x1", "y1"))


def squares(s: SparkSession, d: str) -> DataFrame:
    """The populated 10,000 ft squares: ``(area_id, x0, y0, x1, y1)``, 9,500 ft high."""
    at = tables.positions(s, d).select(F.floor(F.col("px") / tables.SQUARE_FT).cast("long").alias("area_id")).distinct()
    return at.select("area_id", (F.col("area_id") * tables.SQUARE_FT).alias("x0"), F.lit(0.0).alias("y0"), ((F.col("area_id") + 1) * tables.SQUARE_FT).alias("x1"), F.lit(9500.0).alias("y1"))


def shattered(s: SparkSession, d: str) -> DataFrame:
    """Every populated square cut along the lattice of 1000 ft."""
    areas = squares(s, d)
    bounds = areas.select("area_id", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax"))
    return linework.shatter_areas(outlines(areas).select("area_id", "geom"), spatial.grid_lines(bounds, 1000.0))


def waters(s: SparkSession, d: str) -> DataFrame:
    """A river through every populated square, and a pond for every supplier in the tile of its number."""
    river = squares(s, d).select((F.col("x0") + 2500).alias("x0"), F.lit(-100.0).alias("y0"), (F.col("x0") + 2700).alias("x1"), F.lit(20000.0).alias("y1"))
    tile, side = F.col("s_suppkey"), 100.0 + 50 * (F.col("s_suppkey") % 5)
    corner = tables.scan(s, d, "supplier").select((F.floor(tile / 10) * 1000.0 + 100).alias("x0"), ((tile % 10) * 1000.0 + 100).alias("y0"), side.alias("side"))
    pond = corner.select("x0", "y0", (F.col("x0") + F.col("side")).alias("x1"), (F.col("y0") + F.col("side")).alias("y1"))
    return outlines(river.unionByName(pond))


def clipped(s: SparkSession, d: str) -> DataFrame:
    """The populated 1000 ft tiles without rivers and ponds."""
    return linework.clip_out(outlines(tile_boxes(tables.placed(s, d), 1000.0, 10)), waters(s, d), 1000.0)


def worker_messages(s: SparkSession, d: str) -> DataFrame:
    """Events as messages of four workers."""
    e = tables.scan(s, d, "events")
    return e.select(
        (F.col("event_id") % 4).alias("worker"), F.col("event_id").alias("iteration"), (F.col("event_id") % 7 / 10.0).alias("temperature"), (F.col("event_id") % 11).alias("accepted"),
        (F.col("event_id") % 5).alias("rejected"), (F.col("event_id") % 13).alias("boundary"), (F.col("event_id") % 17).cast("double").alias("num"), (F.col("event_id") % 4 + 20).cast("double").alias("den"),
    )
