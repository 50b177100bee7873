"""Table scans, and the parcel tables that the queries are asked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Never offered as a field to score or seed on.
EXCLUDED_COLUMNS = ("geometry", "tile_id", "neighborhood_id")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mod(x: str, m: int) -> Column:
    return F.pmod(F.col(x), F.lit(m))


#: Parcels fill one 10,000 ft square after another, eastwards, so many in each: density stays as it is.
SQUARE_FT, SQUARE_PARCELS = 10_000.0, 12_000


def px(parcel: str = "parcel_id") -> Column:
    return ((F.col(parcel) * 7919) % 9973 + SQUARE_FT * F.floor(F.col(parcel) / SQUARE_PARCELS)).cast("double")


def py(parcel: str = "parcel_id") -> Column:
    return ((F.col(parcel) * 104729) % 9967).cast("double")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel for each order, with a position, a value and two areas.

    ``parcel_id, px, py, assr_market_value, bldg_area_finished_sqft, land_area_sqft``; the areas
    are null for an order without lines.  Positions lie on a row of 10,000 ft squares that grows
    with the table.
    """
    areas = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("parcel_id")).agg(F.sum("l_quantity").alias("bldg_area_finished_sqft"), F.max("l_extendedprice").alias("land_area_sqft"))
    o = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parcel_id"), F.col("o_totalprice").alias("assr_market_value"))
    return o.join(areas, "parcel_id", "left").select(
        "parcel_id",
        px().alias("px"),
        py().alias("py"),
        "assr_market_value",
        "bldg_area_finished_sqft",
        "land_area_sqft",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parcel_id, px, py`` alone: needs no join."""
    o = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parcel_id"))
    return o.select("parcel_id", px().alias("px"), py().alias("py"))


def lattice_id(x: str, y: str, size: float, columns: int) -> Column:
    """Number of the lattice cell of a point: column * columns + row (there may be any number of columns, and at most ``columns`` rows)."""
    return (F.floor(F.col(x) / size) * columns + F.floor(F.col(y) / size)).cast("long")


def placed(spark: SparkSession, sf_dir: str, tile: float = 1000.0, label: float = 2500.0) -> DataFrame:
    """Positions with their tile (10 by 10 in each square) and start label (4 by 4)."""
    return positions(spark, sf_dir).withColumns({"tile_id": lattice_id("px", "py", tile, 10), "nid": lattice_id("px", "py", label, 4)})


def boxes(spark: SparkSession, sf_dir: str, half: float = 25.0) -> DataFrame:
    """Square footprints of all parcels."""
    p = positions(spark, sf_dir)
    return p.select(F.col("parcel_id").alias("id"), (F.col("px") - half).alias("x0"), (F.col("py") - half).alias("y0"), (F.col("px") + half).alias("x1"), (F.col("py") + half).alias("y1"))


def field_universe(schema: T.StructType, ratios: list[tuple[str, str, str]] = ()) -> list[tuple[str, str]]:
    """``(name, kind)`` of the fields a table offers, from its schema alone (no scan).

    Kinds: numeric, text, prebinned (a numeric ``*_binned``), derived (a ratio whose inputs
    are there and whose name isn't).
    """
    out, names = [], {f.name for f in schema.fields}
    for f in schema.fields:
        if f.name in EXCLUDED_COLUMNS:
            continue
        if isinstance(f.dataType, T.NumericType):
            out.append((f.name, "prebinned" if f.name.endswith("_binned") else "numeric"))
        elif isinstance(f.dataType, T.StringType | T.BooleanType):
            out.append((f.name, "text"))
    out += [(new, "derived") for new, num, den in ratios if new not in names and {num, den} <= names]
    return sorted(out)
