"""Preparing the parcel table: coercion, ratios, filters, quantile bins and bin codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (new column, numerator, denominator) of the ratios that are derived where their inputs exist.
DERIVED_RATIOS = (
    ("assr_impr_ppsf", "assr_market_value", "bldg_area_finished_sqft"),
    ("assr_land_ppsf", "assr_market_value", "land_area_sqft"),
)

# What marks a land class as lying in the gaps between homes (matched anywhere, in any case).
TRANSPARENT_KEYWORDS = (
    "right-of-way", "right of way", "row", "submerged", "river", "lake", "canal", "ditch", "drain", "waterway",
    "utility", "subsurface", "sewage", "waste land", "common element", "common area", "street", "road", "highway", "easement",
)

BINNED = "_binned"


def source_name(scored: str) -> str:
    return scored.removesuffix(BINNED)


def scored_name(source: str) -> str:
    return source if source.endswith(BINNED) else source + BINNED


def numeric(column: str | Column) -> Column:
    """The value as a double, null where it's no number (NaN counts as null too)."""
    col = F.col(column) if isinstance(column, str) else column
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def derive_ratios(df: DataFrame, ratios: Sequence[tuple[str, str, str]] = DERIVED_RATIOS) -> DataFrame:
    """Add each ratio whose inputs exist and whose column doesn't; null unless the denominator > 0."""
    new = {name: F.when(numeric(den) > 0, numeric(num) / numeric(den)) for name, num, den in ratios if name not in df.columns and {num, den} <= set(df.columns)}
    return df.withColumns(new) if new else df


def filter_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column, as text, is the value; all rows if there's no such column."""
    return df.filter(F.col(column).cast("string") == value) if column in df.columns else df


#: A pass of :func:`quantiles` cuts the values in question into about this many parts a column.
PARTS = 4096
_LARGEST = 1.7976931348623157e308


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of each column (nulls left out; None without values).

    The value of a rank is found by narrowing: each pass counts the values of the intervals that
    hold a wanted rank in equal parts, and goes on with the parts that hold one, until a part has one
    value or two.  A pass sends a few thousand numbers a column; no task holds a column's values.
    """
    named = [f"_q{k}" for k in range(len(columns))]
    finite = lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(_LARGEST)), F.lit(-_LARGEST)))
    values = df.select(*(finite(numeric(c)).alias(n) for n, c in zip(named, columns, strict=True)))
    ends = values.agg(*(f(n).alias(f"{n}_{k}") for n in named for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    known: dict[str, dict[int, float]] = {n: {} for n in named}
    # name -> intervals (least, largest, values below, values in it, wanted ranks), all closed and apart
    todo: dict[str, list[tuple]] = {}
    for n in named:
        many = ends[f"{n}_n"]
        ranks = sorted({r for q in at for r in (int(q * (many - 1)), -int(-q * (many - 1) // 1))}) if many else []
        todo[n] = [(ends[f"{n}_lo"], ends[f"{n}_hi"], 0, many, ranks)] if many else []
    while any(todo.values()):
        for n, intervals in todo.items():
            left = []
            for lo, hi, below, many, ranks in intervals:
                if lo == hi or many <= 2:  # two values are the least and the largest
                    known[n] |= {r: lo if lo == hi or r == below else hi for r in ranks}
                else:
                    left.append((lo, hi, below, many, ranks))
            todo[n] = left
        asked = []
        for n, intervals in todo.items():
            parts = max(2, PARTS // max(1, len(intervals)))
            part = F.lit(None).cast("int")
            for k, (lo, hi, *_) in enumerate(intervals):
                along = (F.col(n) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
                part = F.when(F.col(n).between(lo, hi), k * parts + F.least(F.floor(along * parts), F.lit(parts - 1))).otherwise(part)
            if intervals:
                asked.append(F.struct(F.lit(n).alias("name"), part.cast("int").alias("part"), F.col(n).alias("v")))
        if not asked:
            break
        counted = values.select(F.inline(F.array(*asked))).filter("part is not null").groupBy("name", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        got: dict[str, list] = {n: [] for n in named}
        for r in counted.collect():
            got[r.name].append((r.part, r.n, r.lo, r.hi))
        for n, intervals in todo.items():
            parts, found, rows = max(2, PARTS // max(1, len(intervals))), [], sorted(got[n])
            for k, (_, _, below, _, ranks) in enumerate(intervals):
                for part, many, lo, hi in rows:
                    if part // parts == k:
                        if mine := [r for r in ranks if below <= r < below + many]:
                            found.append((lo, hi, below, many, mine))
                        below += many
            todo[n] = found
    out = {}
    for c, n in zip(columns, named, strict=True):
        last = (ends[f"{n}_n"] or 0) - 1
        row = []
        for q in at:
            position = q * last
            a, b = int(position), -int(-position // 1)
            row.append(None if last < 0 else known[n][a] if a == b or known[n][a] == known[n][b] else (b - position) * known[n][a] + (position - a) * known[n][b])
        out[c] = row
    return out


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Add ``<column>_binned``: right-closed quantile intervals with the lowest included.

    Null stays null; equal edges are merged; a column with a single edge is null throughout.
    The edges (at most ``bins + 1`` numbers a column, see :func:`quantiles`) are computed at once and
    become constants of the plan: binning itself is a projection.  They are looked for in several
    passes, so ``df`` should be a written table.
    """
    found = quantiles(df, columns, [i / bins for i in range(bins + 1)])

    def binned(c: str) -> Column:
        value, edges = numeric(c), sorted({e for e in found[c] if e is not None})
        if len(edges) < 2:
            return F.lit(None).cast("int")
        below = sum(((value > e).cast("int") for e in edges[1:]), F.lit(0))
        return F.when(value.isNotNull(), F.least(below, F.lit(len(edges) - 2)))

    return df.withColumns({scored_name(c): binned(c) for c in columns})


#: So many distinct (field, value) pairs are looked up as constants; beyond that they are joined.
MOST_CODES = 5000


def wide_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """``df`` with its binned columns replaced by codes; None if there are over MOST_CODES distinct values.

    A field with a null has its values dense-ranked with null first; any other keeps its
    values less the least (gaps stay).  The values of all fields are found in one job.
    """
    ids = [c for c in df.columns if c not in columns]
    found = df.unpivot(ids, list(columns), "field", "value").select("field", "value").distinct().limit(MOST_CODES + 1).collect()
    if len(found) > MOST_CODES:
        return None
    by_field: dict[str, set] = {}
    for r in found:
        by_field.setdefault(r.field, set()).add(r.value)

    def code(field: str) -> Column:
        held = by_field.get(field, set())
        known = sorted(v for v in held if v is not None)
        if None not in held:
            return F.col(field) - F.lit(known[0] if known else 0)
        if not known:
            return F.lit(0)
        ranks = F.create_map(*(F.lit(x) for rank, v in enumerate(known, 1) for x in (v, rank)))
        return F.when(F.col(field).isNull(), 0).otherwise(ranks[F.col(field)])

    return df.select(*ids, *(code(c).cast("int").alias(c) for c in columns))


def bin_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(<ids>, field, code)`` of binned columns, from a table of ids and those columns:
    see :func:`wide_codes`."""
    ids = [c for c in df.columns if c not in columns]
    coded = wide_codes(df, columns)
    if coded is None:
        long = df.unpivot(ids, list(columns), "field", "value")
        return _joined_codes(long, long.select("field", "value").distinct(), ids)
    return coded.unpivot(ids, list(columns), "field", "code")


def _joined_codes(long: DataFrame, values: DataFrame, ids: list[str]) -> DataFrame:
    by_field = Window.partitionBy("field")
    codes = values.select(
        "field",
        "value",
        F.when(F.max(F.col("value").isNull()).over(by_field), F.dense_rank().over(by_field.orderBy(F.col("value").asc_nulls_first())) - 1)
        .otherwise(F.col("value") - F.min("value").over(by_field))
        .cast("int")
        .alias("code"),
    )
    joined = long.alias("l").join(codes.alias("c"), (F.col("l.field") == F.col("c.field")) & F.col("l.value").eqNullSafe(F.col("c.value")))
    return joined.select(*(f"l.{c}" for c in ids), "l.field", "c.code")


def transparent(column: str | Column, keywords: Sequence[str] = TRANSPARENT_KEYWORDS) -> Column:
    """Whether a land class holds any of the keywords, in any case; null counts as no."""
    import re

    col = F.col(column) if isinstance(column, str) else column
    pattern = "|".join(re.escape(k.lower()) for k in keywords if k)
    return F.coalesce(F.lower(col).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def distinct_values(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """The most frequent values of a column as text, ties by value: ``(value, n)``."""
    counted = df.select(F.col(column).cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(limit)


def transparent_classes(df: DataFrame, column: str, keywords: Sequence[str] = TRANSPARENT_KEYWORDS, limit: int = 12) -> DataFrame:
    """The most frequent of the land classes that count as transparent: ``(value, n)``."""
    return distinct_values(df.filter(transparent(column, keywords)), column, limit)


def validate_fields(spark, universe: Sequence[tuple[str, str]], config: dict, filter_values: Sequence[str] | None = None) -> DataFrame:
    """``(setting, value, detail, fatal)``: every way the configured fields fail against the table."""
    kinds = dict(universe)
    present = {n for n, k in universe if k != "derived"}
    binnable = {n for n, k in kinds.items() if k in ("numeric", "prebinned", "derived")}
    rows: list[tuple[str, str, str, bool]] = []
    column, value = config.get("parcel_filter_column"), config.get("parcel_filter_value")
    if column and column not in present:
        rows.append(("parcel_filter_column", column, "no such column", True))
    elif column and value and filter_values is not None and value not in filter_values:
        rows.append(("parcel_filter_value", value, "never occurs, so nothing would be kept", True))
    land = config.get("land_class_column")
    if config.get("adjacency_mode") == "parcel" and config.get("obstacle_mode") == "all_except" and land not in present:
        rows.append(("land_class_column", str(land), "no such column, so every parcel blocks", False))
    rows += [(setting, name, "cannot be binned", True) for setting in ("continuous_variables", "seed_fields") for name in config.get(setting, ()) if name not in binnable]
    made = {scored_name(c) for c in config.get("continuous_variables", ())} | {n for n, k in kinds.items() if k == "prebinned"}
    for name in config.get("weights", {}):
        if name not in made:
            rows.append(("weights", name, "its source isn't in the binning list" if source_name(name) in binnable else "no such column", True))
    if not config.get("weights"):
        rows.append(("weights", "(empty)", "nothing is scored", True))
    return spark.createDataFrame(rows, "setting string, value string, detail string, fatal boolean")
