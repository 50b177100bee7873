"""Labels over a tile graph: components, splitting, spanning, grouping for workers."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselle.operators.components import connected_components

#: Automatic worker counts stop here.
MOST_WORKERS = 8


def tile_components(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(tile_id, component)`` of all tiles; isolated ones are components of their own."""
    known = connected_components(edges).withColumnsRenamed({"node": "tile_id"})
    alone = tiles.select("tile_id").distinct().join(known, "tile_id", "left_anti").select("tile_id", F.col("tile_id").alias("component"))
    return known.unionByName(alone)


def component_sizes(parcels: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, tiles, parcels)``, from parcels with tile_id."""
    per_tile = parcels.groupBy("tile_id").agg(F.count("*").alias("n"))
    return components.join(per_tile, "tile_id", "left").groupBy("component").agg(F.count("*").alias("tiles"), F.sum(F.coalesce("n", F.lit(0))).alias("parcels"))


def component_summary(sizes: DataFrame) -> DataFrame:
    """One row ``(components, parcels, largest, ceiling)``; the ceiling on speed-up is all over largest."""
    s = sizes.agg(F.count("*").alias("components"), F.sum("parcels").alias("parcels"), F.max("parcels").alias("largest"))
    return s.withColumn("ceiling", F.when(F.col("largest") > 0, F.col("parcels") / F.col("largest")))


def split_labels(parcels: DataFrame, components: DataFrame) -> DataFrame:
    """``(parcel_id, nid, component, split)``: a new label for every (label, component) that occurs.

    New labels are dense from 0 in the order of label and component.  The distinct pairs are ranked
    label by label; only the labels' numbers of pairs are summed in one place.
    """
    both = parcels.join(components, "tile_id")
    pairs = both.select("nid", "component").distinct()
    many = pairs.groupBy("nid").agg(F.count("*").alias("_many"))
    before = many.select("nid", (F.sum("_many").over(Window.orderBy("nid")) - F.col("_many")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("nid").orderBy("component")) - 1
    ranked = pairs.withColumn("_in", inner).join(before, "nid").select("nid", "component", (F.col("_before") + F.col("_in")).cast("long").alias("split"))
    return both.join(ranked, ["nid", "component"]).select("parcel_id", "nid", "component", "split")


def spanning_labels(parcels: DataFrame, components: DataFrame) -> DataFrame:
    """``(nid, components)`` of the labels that lie in several components."""
    return parcels.join(components, "tile_id").groupBy("nid").agg(F.countDistinct("component").alias("components")).filter("components > 1")


def label_pieces(parcels: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nid, pieces)``: into how many connected parts each label falls.

    A tile belongs to the label of its first parcel; edges count between tiles of one label.
    """
    label = parcels.groupBy("tile_id").agg(F.min_by("nid", "parcel_id").alias("nid"))
    inner = edges.join(label.withColumnsRenamed({"tile_id": "src", "nid": "ns"}), "src").join(label.withColumnsRenamed({"tile_id": "dst", "nid": "nd"}), "dst").filter("ns = nd").select("src", "dst")
    pieces = tile_components(inner, label)
    return label.join(pieces, "tile_id").groupBy("nid").agg(F.countDistinct("component").alias("pieces"))


def worst_labels(pieces: DataFrame, limit: int = 5) -> DataFrame:
    return pieces.filter("pieces > 1").orderBy(F.desc("pieces"), "nid").limit(limit)


def longest_first(weights: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """``(component, group)``: heaviest first, each to the least loaded group (ties: lowest group).

    Equal weights go by component id; weights of zero are left out.
    """
    loads = [(0, g) for g in range(max(1, groups))]
    out = []
    for component, weight in sorted(weights, key=lambda w: (-w[1], w[0])):
        if weight <= 0:
            continue
        load, g = heapq.heappop(loads)
        out.append((component, g))
        heapq.heappush(loads, (load + weight, g))
    return out


def group_components(sizes: DataFrame, groups: int) -> DataFrame:
    """``(component, group_id)`` by :func:`longest_first`.

    The greedy order is sequential; it runs over one row a component, in a single task.
    """

    def run(batches):
        import pyarrow as pa

        rows = [(c, w) for b in batches for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        found = longest_first(rows, groups)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([g for _, g in found], pa.int64())], names=["component", "group_id"])

    return sizes.select("component", "parcels").coalesce(1).mapInArrow(run, "component bigint, group_id bigint")


def useful_workers(sizes: DataFrame, request: int = 0) -> DataFrame:
    """One row ``(workers)``: the request, or (0) what the components allow, never more than there are."""
    s = sizes.agg(F.sum((F.col("parcels") > 0).cast("int")).alias("some"), F.sum("parcels").alias("all"), F.max("parcels").alias("top"))
    free = F.least(F.floor(F.col("all") / F.col("top") + 0.5), F.col("some"), F.lit(MOST_WORKERS)) if request <= 0 else F.least(F.lit(request), F.col("some"))
    return s.select(F.when(F.coalesce(F.col("some"), F.lit(0)) <= 1, 1).otherwise(F.greatest(F.lit(1), free)).cast("int").alias("workers"))


def group_loads(sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, components, parcels)``."""
    return sizes.join(groups, "component").groupBy("group_id").agg(F.count("*").alias("components"), F.sum("parcels").alias("parcels"))


def neighbours_of(edges: DataFrame, vertex: int) -> DataFrame:
    """``(neighbour, edge_class)`` of one vertex, by class, then id."""
    out = edges.filter(F.col("src") == vertex).select(F.col("dst").alias("neighbour"), "edge_class").unionByName(edges.filter(F.col("dst") == vertex).select(F.col("src").alias("neighbour"), "edge_class"))
    return out.orderBy("edge_class", "neighbour")


def owned_labels(tile_labels: DataFrame) -> DataFrame:
    """``(nid, tiles)`` of the labels that have a tile."""
    return tile_labels.groupBy("nid").agg(F.count("*").alias("tiles"))


def expand_labels(parcels: DataFrame, tile_labels: DataFrame) -> DataFrame:
    """Parcels with the label of their tile where there's a new one, else their own."""
    new = tile_labels.select("tile_id", F.col("nid").alias("_new"))
    return parcels.join(new, "tile_id", "left").withColumn("nid", F.coalesce("_new", "nid")).drop("_new")
