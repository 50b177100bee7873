"""Connected components of an edge table that no single machine has to hold.

Alternating star contraction (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every round is two grouped minima joined back to the edges, so a vertex of
any degree is only ever a join key, never a collected list.  The join is on a key made from
the vertex, for which both of its sides are shuffled anew: so adaptive execution sees the sizes
of both and can split a hub's edges over tasks.  Each round's edges are written to the
shared scratch folder.  A graph of at most LOCAL_EDGES edges is one task's work instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselle.scratch import discard, stash

#: At most so many edges are contracted in one task, which gives the same rows without any rounds.
LOCAL_EDGES = 10_000


def _apart(df: DataFrame) -> Column:
    """A key that is equal where ``u`` is, but by which no table is dealt out yet."""
    return F.bitwise_not("u") if isinstance(df.schema["u"].dataType, T.IntegralType) else F.reverse("u")


def _with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows`` with the ``m`` of their vertex ``u``."""
    return rows.withColumn("_k", _apart(rows)).join(low.select(_apart(low).alias("_k"), "m"), "_k").drop("_k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_low(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_low(edges, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and the sum of their hashes, counted meanwhile."""
    seen = Observation()
    out = stash(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def least_of_each(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For vertices 0, 1, ... the least one that edges lead to."""
    low = np.arange(int(max(u.max(initial=-1), v.max(initial=-1))) + 1)
    while True:
        a, b = low[u], low[v]
        if (a == b).all():
            return low
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every vertex but the least of its component, with the least."""
    kind = edges.schema["u"].dataType

    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        names = rows.column("u").to_pylist() + rows.column("v").to_pylist()
        vertex = sorted(set(names))
        place = {x: i for i, x in enumerate(vertex)}
        ends = np.array([place[x] for x in names])
        low = least_of_each(*ends.reshape(2, -1)).tolist()
        far = [i for i, k in enumerate(low) if i != k]
        yield pa.RecordBatch.from_arrays([pa.array([vertex[i] for i in far], rows.schema.field("u").type), pa.array([vertex[low[i]] for i in far], rows.schema.field("u").type)], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges``; a component is its least vertex.

    Null ends and self-loops: a loop makes its vertex a component of its own (unless other
    edges join it), a null end is dropped.  Repeated and reversed edges are harmless.  An
    empty edge table gives an empty result.
    """
    pairs = stash(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"))
    loops = stash(pairs.filter("a = b").select(F.col("a").alias("node")).distinct())
    now, before = _written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    discard(pairs)
    if 0 < before[0] <= local_edges:
        now, before = stash(_in_one_task(now)), (0, None)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after_df, after = _written(_small_star(_large_star(now)))
        discard(now)
        now = after_df
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = tree.unionByName(roots)
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)
