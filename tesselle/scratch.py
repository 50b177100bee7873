"""Cutting lineage: intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A written Parquet table is columnar and compressed, survives the loss of any executor and
can be read by all of them.  Only where the setting is absent (tests, local runs) is a folder
chosen here.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The tables that each running :func:`settled` has made so far.
_MADE: list[list[DataFrame]] = []
#: Settings that hold while a table is written: nothing reads the shuffle files of the written
#: plan again, so Spark deletes them when the write ends; and Arrow batches are kept small,
#: since rows with whole texts are wide.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

#: And while a table is made from rows of half a megabyte, as those of an index are: so many rows at
#: once are read into columns and sent to Python, else it's all that a task has.
_WIDE = {"spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}


def folder(spark: SparkSession) -> str:
    """The scratch folder of this application inside the shared checkpoint folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tesselle-")
        top = _LOCAL[app]
    return f"{top.rstrip('/')}/tesselle-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, wide: bool = False) -> DataFrame:
    """``df`` written once and read back: later plans start at the written table.

    ``wide``: what it reads has very large rows.  The table's place is kept in ``.stash_path`` of
    the result for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    held = _WHILE_WRITING | _WIDE if wide else _WHILE_WRITING
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    if _MADE:
        _MADE[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; the tables that were stashed on the way are deleted."""
    _MADE.append([])
    try:
        out = stash(make())
    finally:
        made = _MADE.pop()
    for table in made:
        if table is not out:
            discard(table)
    if _MADE:
        _MADE[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stash` that no later plan reads."""
    path = getattr(df, "stash_path", None)
    if path is None:
        return
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
