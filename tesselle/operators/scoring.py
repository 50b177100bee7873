"""Histograms of labels and their weighted mutual information.

Everything is in sparse long form (label, field, code, count); the score is one grouped sum
over it.  Scores are in nats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of degenerate labels: empty, of one parcel, and of all parcels.
EMPTY, SINGLE, WHOLE = 2.0, 1.0, 0.0


def global_histogram(codes: DataFrame) -> DataFrame:
    """``(field, code, c)`` over all parcels."""
    return codes.groupBy("field", "code").agg(F.count("*").alias("c"))


def label_histogram(codes: DataFrame, label: str = "nid") -> DataFrame:
    """``(label, field, code, c)``."""
    return codes.groupBy(label, "field", "code").agg(F.count("*").alias("c"))


def totals(parcels: DataFrame, label: str = "nid") -> DataFrame:
    """``(label, n)``."""
    return parcels.groupBy(label).agg(F.count("*").alias("n"))


def tile_deltas(codes: DataFrame) -> DataFrame:
    """``(tile_id, field, code, cnt)``: what moving a tile adds to a label's counts."""
    return codes.groupBy("tile_id", "field", "code").agg(F.count("*").alias("cnt"))


def _terms(inside: Column, everywhere: Column, n: Column, total: Column) -> Column:
    """One bin's share of the information, times the total: inside and outside the label."""
    outside = everywhere - inside
    part = lambda c, m: F.when(c > 0, c * (F.ln(c) + F.ln(total) - F.ln(m) - F.ln(everywhere))).otherwise(F.lit(0.0))
    return part(inside, n) + part(outside, total - n)


def _degenerate(n: Column, total: Column, score: Column) -> Column:
    return F.when(n <= 0, F.lit(EMPTY)).when(n == 1, F.lit(SINGLE)).when(n >= total, F.lit(WHOLE)).otherwise(score)


def weighted_mi(counts: DataFrame, sizes: DataFrame, overall: DataFrame, weights: DataFrame, total: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """``(<keys>, n, score)`` for every row of ``sizes (<keys>, n)``.

    ``counts (<keys>, field, code, c)``, ``overall (field, code, c)``, ``weights (field,
    weight)``, ``total``: one row ``(g)``.  By default a bin counts only where the label has
    it; with ``exact`` every bin that other labels have counts too: such bins add their weight
    times their size times one logarithm, so their sum is the whole sum less that of the bins the
    label has.  Bins are joined as any table; only the one row of totals is broadcast.
    """
    bins = overall.join(weights, "field").select("field", "code", F.col("c").alias("everywhere"), "weight")
    base = counts.join(bins, ["field", "code"]).join(sizes, keys).withColumn("inside", F.col("c")).crossJoin(F.broadcast(total))
    mass = F.col("weight") * F.col("everywhere")
    scored = base.groupBy(*keys).agg(F.sum(F.col("weight") * _terms(F.col("inside"), F.col("everywhere"), F.col("n"), F.col("g"))).alias("s"), F.sum(mass).alias("seen"))
    out = sizes.join(scored, keys, "left").crossJoin(F.broadcast(total))
    s = F.coalesce(F.col("s"), F.lit(0.0))
    if exact:
        out = out.crossJoin(F.broadcast(bins.agg(F.sum(mass).alias("mass"))))
        s = s + (F.col("mass") - F.coalesce("seen", F.lit(0.0))) * (F.ln("g") - F.ln(F.col("g") - F.col("n")))
    return out.select(*keys, "n", _degenerate(F.col("n"), F.col("g"), s / F.col("g")).alias("score"))


def tile_cells(codes: DataFrame) -> DataFrame:
    """``(tile_id, nid, field, code, c)``: what all other histograms are sums of."""
    return codes.groupBy("tile_id", "nid", "field", "code").agg(F.count("*").alias("c"))


def summed(cells: DataFrame, keys: list[str], name: str = "c") -> DataFrame:
    """A histogram over fewer keys, from a finer one."""
    return cells.groupBy(*keys).agg(F.sum("c").alias(name))


def label_sizes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``(<keys>, n)`` from a histogram: a parcel has one code in every field."""
    return counts.groupBy(*keys, "field").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.max("c").alias("n"))


def score_labels(codes: DataFrame, weights: DataFrame, label: str = "nid", exact: bool = False) -> DataFrame:
    """``(label, n, score)`` of coded parcels ``(parcel_id, label, field, code)``.

    Parcels are read once: global counts and label sizes are sums of the labels' histograms
    (a parcel has one code in every field).
    """
    counts = label_histogram(codes, label)
    sizes, overall = label_sizes(counts, [label]), summed(counts, ["field", "code"])
    return weighted_mi(counts, sizes, overall, weights, sizes.agg(F.sum("n").alias("g")), [label], exact)


def weighted_score(scores: DataFrame) -> DataFrame:
    """One row ``(num, den, weighted_score)``: the mean over labels with parcels, by parcels."""
    s = scores.filter("n > 0").agg(F.sum(F.col("score") * F.col("n")).alias("num"), F.sum("n").alias("den"))
    return s.select("num", "den", F.expr("if(den > 0, num / den, 0D)").alias("weighted_score"))


def mean_score(scores: DataFrame, label: str = "nid") -> DataFrame:
    """One row ``(labels, active, mean_score)`` over the ids from 0 to the largest; one without parcels counts as EMPTY."""
    s = scores.agg((F.max(label) + 1).alias("labels"), F.count(F.when(F.col("n") > 0, 1)).alias("active"), F.sum(F.when(F.col("n") > 0, F.col("score")).otherwise(0.0)).alias("s"))
    return s.select("labels", "active", ((F.col("s") + EMPTY * (F.col("labels") - F.col("active"))) / F.col("labels")).alias("mean_score"))
