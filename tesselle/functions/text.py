"""String rules for places, names, files and service answers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Postal codes and FIPS codes of states and territories, and the names that are recognised.
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09", "DE": "10", "DC": "11", "FL": "12",
    "GA": "13", "HI": "15", "ID": "16", "IL": "17", "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23",
    "MD": "24", "MA": "25", "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33",
    "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44",
    "SC": "45", "SD": "46", "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54", "WI": "55",
    "WY": "56", "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}
STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL",
    "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "puerto rico": "PR",
}
# What the census appends to an area's bare name.
AREA_SUFFIXES = (
    "county", "parish", "borough", "census area", "municipality", "municipio", "city and borough", "city", "town", "township", "village",
    "cdp", "charter township", "urban county", "consolidated government", "metropolitan government", "unified government", "plantation",
    "gore", "district", "precinct", "reservation",
)
# How a service says, within a successful answer, that it cut the answer short.
TRUNCATION_HINTS = ("timed out", "out of memory", "too many", "exceeded")


def _any_of(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def state_fips(text: Column) -> Column:
    """FIPS code of a state given by postal code or name in any case, else null."""
    return F.coalesce(_lookup(STATE_FIPS, F.upper(text)), _lookup({n: STATE_FIPS[c] for n, c in STATE_NAMES.items()}, F.lower(text)))


def parse_place(text: str) -> Column:
    """``struct<name, fips>``: a place and its state, which stands after a comma or at the end.

    "Fort Myers, FL", "Lee County Florida", "Bonita Springs FL"; without a state fips is null.
    The longest state name wins.
    """
    col = F.col(text)
    parts = F.filter(F.transform(F.split(col, ","), lambda p: F.trim(p)), lambda p: p != "")
    after_comma = F.when(F.size(parts) >= 2, state_fips(F.element_at(parts, -1)))
    plain = F.trim(col)
    named = rf"(?i)^(.*?) ({_any_of(STATE_NAMES)})$"
    words = F.split(plain, r"\s+")
    by_code = F.when(F.size(words) >= 2, _lookup(STATE_FIPS, F.upper(F.element_at(words, -1))))
    by_name = F.when(plain.rlike(named), state_fips(F.regexp_extract(plain, named, 2)))
    name = (
        F.when(after_comma.isNotNull(), F.concat_ws(", ", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))))
        .when(by_name.isNotNull(), F.trim(F.regexp_extract(plain, named, 1)))
        .when(by_code.isNotNull(), F.concat_ws(" ", F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))))
        .otherwise(plain)
    )
    return F.struct(name.alias("name"), F.coalesce(after_comma, by_name, by_code).alias("fips"))


def strip_suffix(name: str | Column) -> Column:
    """An area's bare name: all trailing suffixes go, unless nothing would be left."""
    col = F.trim(F.col(name) if isinstance(name, str) else name)
    return F.regexp_replace(col, rf"(?i)(?<=\S)(\s+({_any_of(AREA_SUFFIXES)}))+$", "")


def slug(text: str) -> Column:
    """Lower case, runs of other than letters and digits as one underscore; 'run' if nothing is left."""
    out = F.trim(F.regexp_replace(F.lower(F.trim(F.col(text))), "[^a-z0-9]+", "_"))
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.when(out == "", "run").otherwise(out)


def cache_key(text: str) -> Column:
    return F.substring(F.sha1(F.col(text).cast("binary")), 1, 16)


def escape_quotes(text: str) -> Column:
    return F.replace(F.col(text), F.lit("'"), F.lit("''"))


def truncated(remark: str) -> Column:
    return F.coalesce(F.lower(F.col(remark)).rlike("|".join(TRUNCATION_HINTS)), F.lit(False))


def response_action(status: str, remark: str) -> Column:
    """What to do with a service's answer: use, split the area, back off, try the next endpoint."""
    code = F.col(status)
    return F.when((code == 200) & truncated(remark), "split").when(code == 200, "use").when(code.isin(429, 503), "back_off").when(code == 400, "split").otherwise("next_endpoint")


# Factor, offset and shift of a label's colour, and the number of colours.
COLOUR_FACTOR, COLOUR_OFFSET, COLOUR_SHIFT, COLOURS = 2654435761, 12345, 3, 20


def label_colour(label: str, colours: int = COLOURS) -> Column:
    """Number of a label's colour: neighbouring labels get colours far apart."""
    return F.pmod(F.shiftright(F.col(label).cast("long") * F.lit(COLOUR_FACTOR) + F.lit(COLOUR_OFFSET), COLOUR_SHIFT), F.lit(colours)).cast("int")


def rank_places(places: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """``places (name, basename, state, area)`` that match a query, best first, with ``tier``.

    Tier 0 equals a form of the query, 1 begins with it, 2 is the rest; larger areas first.
    """
    asked = places.sparkSession.range(1).select(F.lit(query).alias("q")).select(parse_place("q").alias("p"))
    asked = asked.select(F.lower("p.name").alias("whole"), F.lower(strip_suffix(F.col("p.name"))).alias("bare"), F.col("p.fips").alias("fips"))
    forms = F.array(F.lower("name"), F.lower("basename"), F.lower(strip_suffix("name")))
    met = places.crossJoin(F.broadcast(asked)).withColumn("forms", forms)
    met = met.filter((F.col("fips").isNull() | (F.col("state") == F.col("fips"))) & F.exists(F.array(F.lower("name"), F.lower("basename")), lambda f: f.startswith(F.col("whole")) | f.startswith(F.col("bare"))))
    hit = F.exists("forms", lambda f: (f == F.col("whole")) | (f == F.col("bare")))
    begins = F.exists("forms", lambda f: f.startswith(F.col("whole")) | f.startswith(F.col("bare")))
    tier = F.when(hit, 0).when(begins, 1).otherwise(2)
    return met.select("name", "basename", "state", "area", tier.alias("tier")).orderBy("tier", F.desc("area"), "name").limit(limit)


def candidate_years(today: Column, first: int = 2020) -> Column:
    """Vintages to try, newest first, from next year on."""
    return F.sequence(F.year(today) + 1, F.lit(first), F.lit(-1))
