"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept and returns rows with the columns of ``documents``
(the last one: pieces and their places in sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.llm import decontaminate, lines, packing, quality, simhash
from tesselle.scratch import settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quadratic discriminant accepts.

    A null text counts as empty and is judged like any other; rows that repeat are judged alike and
    all stay or all go; a null doc_id stays null; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(settled(lambda: quality.features(docs)), labels)
    return docs.filter(quality.accepted(model))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; those with nothing left go.

    Earlier is by doc_id (null last), then place.  A document that loses no line stays as it is,
    null and empty texts included; rows that repeat an id and its text are one document, and each
    row gets what is left of it.
    """
    found = lines.deduplicate(docs, carry=True)
    left = found.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"])}
    return left.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (all pairs of similarity 0.8 in five-word shingles): the smallest id.

    Equal texts, empty and null ones among them, are one group; a document without doc_id
    belongs to none and stays; of rows that repeat an id and its text one stays.
    """
    groups = simhash.duplicate_groups(docs, width=5, radius=8, similarity=0.8)
    gone = groups.filter("doc_id <> group_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark.

    Null and empty texts hold none; rows that repeat an id and its text are judged alike; items
    without words or id match nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    Every row is packed, a null or empty text as its end mark alone; which of equal pieces
    goes where is open.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_neardup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't state the stages; tests hold them against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        last = k == len(STAGES) - 1
        docs = stage(spark, docs, sf_dir) if last else settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
