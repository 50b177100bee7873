"""Candidate moves of a whole boundary at once: donations, swaps, and what they gain.

A candidate is a row; its two sides (the label that loses, the label that gains) are scored
by adding signed tile counts to the labels' histograms and summing again.  The number of
rows follows the boundary times the bins of a label, never its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselle.operators import scoring
from tesselle.operators.components import connected_components
from tesselle.scratch import stash


def tile_labels(parcels: DataFrame) -> DataFrame:
    """``(tile_id, nid, parcels, mixed)``: the label of a tile's first parcel, and whether there are others."""
    return parcels.groupBy("tile_id").agg(F.min_by("nid", "parcel_id").alias("nid"), F.count("*").alias("parcels"), (F.countDistinct("nid") > 1).alias("mixed"))


def boundary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(i, j)``: edges between tiles of different labels, and ``(i, i)`` for mixed tiles."""
    side = lambda end, name: labels.select(F.col("tile_id").alias(end), F.col("nid").alias(name))
    cross = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).join(side("i", "ni"), "i").join(side("j", "nj"), "j").filter("ni <> nj")
    return cross.select("i", "j").unionByName(labels.filter("mixed").select(F.col("tile_id").alias("i"), F.col("tile_id").alias("j")))


def donations(border: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cand, kind, tile, n1, n2, parcels)``: every way to give a boundary tile to the label across."""
    side = lambda end, name, size: labels.select(F.col("tile_id").alias(end), F.col("nid").alias(name), F.col("parcels").alias(size))
    both = border.filter("i <> j").join(side("i", "ni", "pi"), "i").join(side("j", "nj", "pj"), "j")
    ways = F.array(F.struct(F.col("i").alias("tile"), F.col("ni").alias("n1"), F.col("nj").alias("n2"), F.col("pi").alias("parcels")), F.struct(F.col("j").alias("tile"), F.col("nj").alias("n1"), F.col("ni").alias("n2"), F.col("pj").alias("parcels")))
    out = both.select(F.inline(ways)).distinct()
    return out.select(F.concat_ws(":", F.lit("d"), "tile", "n2").alias("cand"), F.lit("donation").alias("kind"), "tile", "n1", "n2", "parcels")


def swaps(border: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cand, kind, t1, t2, n1, n2, p1, p2)``: every exchange of two tiles across the boundary."""
    side = lambda end, name, size: labels.select(F.col("tile_id").alias(end), F.col("nid").alias(name), F.col("parcels").alias(size))
    both = border.filter("i <> j").join(side("i", "n1", "p1"), "i").join(side("j", "n2", "p2"), "j")
    return both.select(F.concat_ws(":", F.lit("s"), "i", "j").alias("cand"), F.lit("swap").alias("kind"), F.col("i").alias("t1"), F.col("j").alias("t2"), "n1", "n2", "p1", "p2")


def donation_sides(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of donations: ``(cand, nid, shift)`` and ``(cand, nid, tile_id, sign)``."""
    sides = moves.select("cand", "tile", "parcels", F.inline(F.array(F.struct(F.col("n1").alias("nid"), F.lit(-1).alias("sign")), F.struct(F.col("n2").alias("nid"), F.lit(1).alias("sign")))))
    return sides.select("cand", "nid", (F.col("sign") * F.col("parcels")).alias("shift")), sides.select("cand", "nid", F.col("tile").alias("tile_id"), "sign")


def swap_sides(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of swaps: each label loses one tile and gets the other."""
    one = F.struct(F.col("n1").alias("nid"), (F.col("p2") - F.col("p1")).alias("shift"), F.col("t1").alias("out"), F.col("t2").alias("in"))
    two = F.struct(F.col("n2").alias("nid"), (F.col("p1") - F.col("p2")).alias("shift"), F.col("t2").alias("out"), F.col("t1").alias("in"))
    sides = moves.select("cand", F.inline(F.array(one, two)))
    ways = F.array(F.struct(F.col("out").alias("tile_id"), F.lit(-1).alias("sign")), F.struct(F.col("in").alias("tile_id"), F.lit(1).alias("sign")))
    return sides.select("cand", "nid", "shift"), sides.select("cand", "nid", F.inline(ways))


def gains(sides: tuple[DataFrame, DataFrame], cells: DataFrame, weights: DataFrame) -> DataFrame:
    """``(cand, gain)``: how much the two labels of each candidate would score more together.

    ``cells``: :func:`scoring.tile_cells` of all parcels, written; everything else is a sum of them.
    """
    shifts, tiles = sides
    counts = stash(scoring.summed(cells, ["nid", "field", "code"]))
    overall, deltas = scoring.summed(counts, ["field", "code"]), scoring.summed(cells, ["tile_id", "field", "code"], "cnt")
    sizes = stash(scoring.label_sizes(counts, ["nid"]))
    total = sizes.agg(F.sum("n").alias("g"))
    now = scoring.weighted_mi(counts, sizes, overall, weights, total, ["nid"]).select("nid", F.col("score").alias("now"))
    whole = shifts.join(counts, "nid").select("cand", "nid", "field", "code", "c")
    moved = tiles.join(deltas, "tile_id").select("cand", "nid", "field", "code", (F.col("sign") * F.col("cnt")).alias("c"))
    after = whole.unionByName(moved).groupBy("cand", "nid", "field", "code").agg(F.sum("c").alias("c")).filter("c <> 0")
    new_sizes = shifts.join(sizes, "nid").select("cand", "nid", (F.col("n") + F.col("shift")).alias("n"))
    then = scoring.weighted_mi(after, new_sizes, overall, weights, total, ["cand", "nid"])
    return then.join(now, "nid").groupBy("cand").agg(F.sum(F.col("score") - F.col("now")).alias("gain"))


def best_moves(scored: DataFrame, batch: str = "batch") -> DataFrame:
    """The best candidate of each batch: by gain, then candidate."""
    first = Window.partitionBy(batch).orderBy(F.desc("gain"), "cand")
    return scored.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


# ---------------------------------------------------------------- contiguity


def islands(moves: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The swaps ``(cand, nid, arriving)`` whose tile would have no neighbour in its new label but the leaver."""
    sides = moves.select("cand", F.inline(F.array(F.struct(F.col("n1").alias("nid"), F.col("t1").alias("leaving"), F.col("t2").alias("arriving")), F.struct(F.col("n2").alias("nid"), F.col("t2").alias("leaving"), F.col("t1").alias("arriving")))))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    held = both.join(labels.select(F.col("tile_id").alias("dst"), F.col("nid").alias("held")), "dst").select(F.col("src").alias("arriving"), F.col("dst").alias("other"), "held")
    anchor = sides.join(held, "arriving").filter((F.col("held") == F.col("nid")) & (F.col("other") != F.col("leaving"))).select("cand", "nid")
    return sides.join(anchor.distinct(), ["cand", "nid"], "left_anti").select("cand", "nid", "arriving")


def disconnecting(moves: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The donations ``(cand, tile)`` that would split what is left of the donor label.

    All (label, leaver) pairs are one graph: its vertices are the label's other tiles, one
    copy for each leaver, and a leaver splits its label if its neighbours there fall into
    several components.  Copies are numbered, so components run once for all.
    """
    pairs = moves.select("cand", F.col("tile").alias("leaver"), F.col("n1").alias("nid")).distinct()
    mine = labels.select("tile_id", "nid")
    inner = edges.select("src", "dst").join(mine.withColumnsRenamed({"tile_id": "src", "nid": "ns"}), "src").join(mine.withColumnsRenamed({"tile_id": "dst", "nid": "nd"}), "dst").filter("ns = nd").select("src", "dst", F.col("ns").alias("nid"))
    copy = lambda end: F.concat_ws("/", F.col("leaver"), F.col(end))
    graph = pairs.select("leaver", "nid").distinct().join(inner, "nid").filter("src <> leaver and dst <> leaver").select(copy("src").alias("src"), copy("dst").alias("dst"))
    parts = connected_components(graph)
    near = inner.select(F.col("src").alias("leaver"), F.col("dst").alias("tile_id"), "nid").unionByName(inner.select(F.col("dst").alias("leaver"), F.col("src").alias("tile_id"), "nid"))
    anchors = pairs.join(near, ["leaver", "nid"]).withColumn("node", copy("tile_id")).join(parts, "node", "left")
    split = anchors.groupBy("cand", "leaver").agg(F.countDistinct(F.coalesce("component", "node")).alias("parts")).filter("parts > 1")
    return split.select("cand", F.col("leaver").alias("tile"))


def breaking(donated: DataFrame, swapped: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cand)``: donations that split the label they leave, and swaps of which either tile splits
    the label it leaves or has no other neighbour where it goes (four tests)."""
    leaves = F.inline(F.array(F.struct(F.col("t1").alias("tile"), F.col("n1")), F.struct(F.col("t2").alias("tile"), F.col("n2").alias("n1"))))
    ways = donated.select("cand", "tile", "n1").unionByName(swapped.select("cand", leaves))
    splits = disconnecting(ways, edges, labels)
    return splits.select("cand").unionByName(islands(swapped, edges, labels).select("cand")).distinct()


def consolidate_at_once(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """``(tile_id, nid, score)``: for each mixed tile the label that would score best with all of it.

    Every mixed tile is judged on the counts before any of them changes (ties: least label).
    ``cells``: :func:`scoring.tile_cells` of all parcels, written.
    """
    held = scoring.label_sizes(cells, ["tile_id", "nid"]).withColumnRenamed("n", "own")
    size = held.groupBy("tile_id").agg(F.count("*").alias("labels"), F.sum("own").alias("all")).filter("labels > 1")
    ways = stash(held.join(size, "tile_id").select(F.concat_ws(":", "tile_id", "nid").alias("cand"), "tile_id", "nid", (F.col("all") - F.col("own")).alias("shift")))
    counts = stash(scoring.summed(cells, ["nid", "field", "code"]))
    overall, sizes = scoring.summed(counts, ["field", "code"]), scoring.label_sizes(counts, ["nid"])
    part = cells.withColumnRenamed("nid", "from")
    arriving = ways.join(part, "tile_id").filter("from <> nid").select("cand", "nid", "field", "code", "c")
    after = ways.join(counts, "nid").select("cand", "nid", "field", "code", "c").unionByName(arriving).groupBy("cand", "nid", "field", "code").agg(F.sum("c").alias("c"))
    new_sizes = ways.join(sizes, "nid").select("cand", "nid", (F.col("n") + F.col("shift")).alias("n"))
    scored = scoring.weighted_mi(after, new_sizes, overall, weights, sizes.agg(F.sum("n").alias("g")), ["cand", "nid"]).join(ways.select("cand", "tile_id"), "cand")
    best = Window.partitionBy("tile_id").orderBy(F.desc(F.round("score", 12)), "nid")
    return scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("tile_id", "nid", "score")
