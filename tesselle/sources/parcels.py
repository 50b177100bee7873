"""Parcel files: any table with a WKB geometry whose column says its coordinate system."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.functions.linework import inner_point
from tesselle.functions.shapes import parse_wkb, within_polygon
from tesselle.operators import prep
from tesselle.scratch import stash
from tesselle.sources.store import RunConfig

#: What a file's suffix says about its format (anything else is Parquet).
FORMATS = {".json": "json", ".orc": "orc", ".csv": "csv"}


def with_crs(geom: Column, crs: str) -> Column:
    """A geometry column named ``geometry`` that says its coordinate system."""
    return geom.alias("geometry", metadata={"crs": crs})


def crs_of(df: DataFrame) -> str:
    """The coordinate system of a table's geometry; ValueError if it has none."""
    crs = df.schema["geometry"].metadata.get("crs") if "geometry" in df.columns else None
    if not crs:
        raise ValueError("the table has no geometry column with a coordinate system")
    return crs


def representative_point(geom: str) -> Column:
    """A point inside a polygon (of its first part), as struct<x, y>; null for what has no area."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for g in column:
            shape = [rings for rings in parse_wkb(g.as_py()) if rings] if g.as_py() else []
            out.append(dict(zip("xy", inner_point(shape[0]), strict=True)) if shape else None)
        return pa.array(out, pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    return F.arrow_udf(run, "struct<x:double,y:double>")(geom)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A parcel table, by the suffix of its path."""
    suffix = next((f for s, f in FORMATS.items() if path.rstrip("/").lower().endswith(s)), "parquet")
    return spark.read.format(suffix).options(**({"header": "true", "inferSchema": "true"} if suffix == "csv" else {})).load(path)


def load_parcels(spark: SparkSession, path: str, config: RunConfig, crs: str, clip: bytes | None = None) -> DataFrame:
    """The parcels to work on, with ``px, py``, ratios and quantile bins.

    Rows are kept whose filter column, as text, has the value (all, without such a column),
    whose geometry isn't empty and whose inner point lies within ``clip``.  ValueError for a
    table without a coordinate system or with another one than ``crs`` (nothing is reprojected
    here), if no parcel is left, and for scored fields that nothing provides.
    """
    df = scan(spark, path)
    if (own := crs_of(df)) != crs:
        raise ValueError(f"the table is in {own}, the run in {crs}")
    if config.parcel_filter_column and config.parcel_filter_value:
        df = prep.filter_equal(df, config.parcel_filter_column, config.parcel_filter_value)
    df = df.filter("geometry is not null and octet_length(geometry) > 0").withColumn("_p", representative_point("geometry")).filter("_p is not null")
    df = df.withColumns({"px": F.col("_p.x"), "py": F.col("_p.y")}).drop("_p")
    if clip is not None:
        df = df.filter(within_polygon("px", "py", clip))
    df = stash(prep.derive_ratios(df))
    if df.isEmpty():
        raise ValueError("no parcel lies in the study area")
    df = prep.quantile_bins(df, [c for c in config.continuous_variables if c in df.columns], config.max_bins)
    if missing := sorted(set(config.weights) - set(df.columns)):
        raise ValueError(f"nothing provides the scored fields {', '.join(missing)}")
    return df
