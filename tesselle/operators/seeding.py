"""Start labels: imputed, standardised fields and k-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.operators.prep import numeric, quantiles
from tesselle.scratch import stash


def impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of each column replaced by its exact median, a constant of the plan."""
    medians = quantiles(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(numeric(c), F.lit(medians[c][0]).cast("double")) for c in columns})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its mean, over its population deviation (zero, if it is constant)."""
    stats = df.agg(*(f(c).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = lambda k, c: (F.col(c) - stats[f"m_{k}"]) / stats[f"s_{k}"] if stats[f"s_{k}"] else F.lit(0.0)
    return df.withColumns({c: scaled(k, c) for k, c in enumerate(columns)})


def seed_labels(parcels: DataFrame, fields: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``(parcel_id, nid)``: k-means labels over the imputed, standardised fields.

    The fields are written once; medians, deviations, the fit and the labels all read that table.
    """
    own = stash(parcels.select("parcel_id", *(numeric(f).alias(f) for f in fields)))
    ready = standardise(impute(own, fields), fields)
    vectors = VectorAssembler(inputCols=list(fields), outputCol="features").transform(ready).select("parcel_id", "features")
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="nid").fit(vectors)
    return model.transform(vectors).select("parcel_id", F.col("nid").cast("long").alias("nid"))
