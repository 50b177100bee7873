"""Comparing the members of many cells: splitting hot ones, streaming them, and linking within."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def split(cells: DataFrame, keys: list[str], item: str, limit: int) -> DataFrame:
    """``cells`` with ``lo`` and ``hi``: cells of over ``limit`` rows in parts, by pairs of parts.

    Members of a hot cell are dealt to about ``rows / limit`` parts by a hash of ``item``, and
    every two parts (and each with itself) make one cell of the result.
    """
    hot = cells.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    cells = cells.join(hot, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    cells = cells.withColumn("_own", F.pmod(F.xxhash64(item, F.lit(5)), F.col("_parts")).cast("int")).withColumn("_with", F.explode(F.expr("sequence(0, _parts - 1)")))
    return cells.withColumn("lo", F.least("_own", "_with")).withColumn("hi", F.greatest("_own", "_with")).drop("_parts", "_own", "_with")


def whole_cells(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = 50_000, size: int = 4 << 20) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first ``n_keys`` (integer) columns, in steps of whole cells.

    Yields the number of each row's cell (ascending from 0) and the rows, at least ``rows``
    rows or ``size`` bytes at a time but for the last step.
    """

    def numbered(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        for k in range(n_keys):
            key = table.column(k).to_numpy()
            change[1:] |= key[1:] != key[:-1]
        return np.cumsum(change)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            table = pa.Table.from_batches(held)
            cell = numbered(table)
            if cell[-1] == 0:  # one cell so far
                continue
            cut = int(np.searchsorted(cell, cell[-1]))
            yield cell[:cut], table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield numbered(table), table


def pairs_within(cell: np.ndarray, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one cell, for cells of at most ``largest`` rows, by distance."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    first, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(cell)]])
    size = end - first
    small = (size <= largest) & (size > 1)
    first, end, size = first[small], end[small], size[small]
    for gap in range(1, int(size.max(initial=1))):
        wide = size > gap
        count = end[wide] - first[wide] - gap
        at = np.repeat(first[wide], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield at, at + gap


def large_cells(cell: np.ndarray, over: int) -> Iterator[tuple[int, int]]:
    """First and end row of the cells of more than ``over`` rows."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)], strict=True):
        if b - a > over:
            yield a, b


class Forest:
    """Union-find over the positions of one cell; a root is the first of its component."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            upper = self.up[self.up]
            if (upper == self.up).all():
                return self.up
            self.up = upper

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            top = self.roots()
            a, b = top[a], top[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def component_roots(n: int, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], tile: int = TILE) -> np.ndarray:
    """For each of ``n`` members of a cell the first member that it is linked to, over any links.

    ``near(queries, others)`` gives index pairs into the two. Every member is a query once,
    against those not yet asked that it isn't connected to; so a tight group costs about one
    scan, and a cell without links all of its pairs.
    """
    forest, waiting = Forest(n), np.ones(n, bool)
    while waiting.any():
        top = forest.roots()
        left = np.flatnonzero(waiting)
        grown = left[top[left] != left]
        if len(grown):  # finish one component before the next
            root = top[grown[0]]
            asked = grown[top[grown] == root][:tile]
            others = left[top[left] != root]
        else:
            asked, others = left[:tile], left
        waiting[asked] = False
        if len(others):
            q, v = near(asked, others)
            forest.join(asked[q], others[v])
    return forest.roots()
