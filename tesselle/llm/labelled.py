"""Which rows a model may learn from, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows no model learns from: crc32 of the id as text leaves 1 by 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, y)``: one 0/1 label per id; an id with both keeps the larger."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))


def group_sizes(known: DataFrame) -> list[tuple]:
    """``(group, rows)`` of every group of ``known (doc_id, group)``, by group: a row for each label or language."""
    known = known.filter("doc_id is not null and group is not null")
    return sorted((r.group, r.n) for r in known.groupBy("group").agg(F.count("*").alias("n")).collect())


def sample(docs: DataFrame, known: DataFrame, sizes: list[tuple], rows: int, max_bytes: int) -> list[tuple]:
    """``(group, text)`` of about ``rows`` documents of each of the groups ``sizes``, sorted.

    ``known`` is ``(doc_id, group)``.  Rows are chosen by a hash of doc_id, over narrow
    columns; only the chosen ids (at most ``2 * rows`` a group) are broadcast to fetch their
    texts.  Texts over ``max_bytes`` are left out of the sample.  What is held at once is bounded by
    the number of groups asked for.
    """
    if not sizes:
        return []
    spark = docs.sparkSession
    known = known.filter("doc_id is not null and group is not null").select("doc_id", "group")
    share = spark.createDataFrame([(g, rows / n) for g, n in sizes], known.select("group").schema.add("share", "double"))
    chosen = known.join(F.broadcast(share), "group").filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000_000)) < F.lit(1_000_000_000) * F.col("share"))
    ids = chosen.select("doc_id", "group").distinct().limit(2 * rows * len(sizes))
    got = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, max_bytes)).join(F.broadcast(ids), "doc_id")
    return sorted((r.group, r.text) for r in got.select("group", "text").toLocalIterator())
