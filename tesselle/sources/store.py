"""Run folders: configuration, checkpoints that can be continued, results, cached sources."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class RunConfig:
    """Settings of a run; unknown keys of a saved one are ignored."""

    place: str = ""
    parcel_filter_column: str = ""
    parcel_filter_value: str = ""
    adjacency_mode: str = "tile"
    adjacency_ft: float = 100.0
    obstacle_mode: str = "modeled"
    land_class_column: str = "land_class"
    sightline_epsilon_ft: float = 0.5
    grid_ft: float = 500.0
    max_bins: int = 30
    continuous_variables: list[str] = field(default_factory=list)
    seed_fields: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    exact_mi: bool = False
    n_neighborhoods: int = 100
    max_iterations: int = 1_000_000
    enforce_contiguity: bool = True
    split_severed: bool = True
    workers: int = 1
    random_seed: int = 42
    keep_checkpoints: int = 20

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


def prune_order(checkpoints: DataFrame, keep: int) -> DataFrame:
    """``checkpoints (run_id, iteration, is_final, ...)`` with ``drop``: all but the newest ``keep``.

    Final ones are never dropped and don't count; ``keep`` 0 keeps all.
    """
    age = F.row_number().over(Window.partitionBy("run_id", "is_final").orderBy(F.desc("iteration")))
    return checkpoints.withColumn("drop", (~F.col("is_final")) & (age > keep) if keep else F.lit(False))


def latest(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint of each run; at one iteration a final one counts as newer."""
    return checkpoints.groupBy("run_id").agg(F.max(F.struct("iteration", "is_final")).alias("m")).select("run_id", "m.iteration", "m.is_final")


class CheckpointStore:
    """Checkpoints of one run: a folder each, complete once its ``_SUCCESS`` is written.

    A folder holds the labels (Parquet) and one row of chain state for each group, so every
    group goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 20) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, iteration: int, final: bool) -> str:
        return f"{self.folder}/checkpoints/{'final' if final else 'iter'}_{iteration:09d}"

    def save(self, labels: DataFrame, states: DataFrame, iteration: int, final: bool = False) -> str:
        path = self._path(iteration, final)
        states.coalesce(1).write.mode("overwrite").parquet(f"{path}/states")
        labels.write.mode("overwrite").parquet(f"{path}/labels")  # last: it makes the checkpoint complete
        self.prune()
        return path

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self) -> list[tuple[int, bool, str]]:
        """``(iteration, final, path)`` of the complete checkpoints, oldest first."""
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        top = path(f"{self.folder}/checkpoints")
        if not fs.exists(top):
            return []
        out = []
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            kind, _, number = name.partition("_")
            if kind in ("iter", "final") and number.isdecimal() and fs.exists(path(f"{top.toString()}/{name}/labels/_SUCCESS")):
                out.append((int(number), kind == "final", f"{self.folder}/checkpoints/{name}"))
        return sorted(out)

    def latest(self) -> tuple[int, bool, str] | None:
        found = self.list()
        return found[-1] if found else None

    def load(self, path: str | None = None) -> tuple[DataFrame, dict[int, str]] | None:
        """Labels and the state of each group (a row a group); None if there is no checkpoint."""
        if path is None:
            found = self.latest()
            if found is None:
                return None
            path = found[2]
        states = {int(r.group_id): r.state for r in self.spark.read.parquet(f"{path}/states").collect()}
        return self.spark.read.parquet(f"{path}/labels"), states

    def prune(self) -> None:
        if not self.keep:
            return
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        for _, _, old in [c for c in self.list() if not c[1]][: -self.keep]:
            fs.delete(path(old), True)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it can be read, else ``build()`` written there and read back.

    Spark reads lazily, so the files' footers are read here: a damaged cache is rebuilt.
    """
    try:
        out = spark.read.parquet(path)
        out.limit(1).count()
        return out
    except (PySparkException, Py4JJavaError):
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def write_result(parcels: DataFrame, labels: DataFrame, path: str) -> None:
    """Parcels with their final ``neighborhood_id``."""
    parcels.drop("neighborhood_id").join(labels.select("parcel_id", F.col("nid").alias("neighborhood_id")), "parcel_id").write.mode("overwrite").parquet(path)
