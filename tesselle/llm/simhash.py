"""SimHash near-duplicates, compared bit-sliced.

Fingerprints of documents are collapsed to distinct values first.  Two fingerprints that
differ in at most ``radius`` of 64 bits agree on at least two of ``blocks = radius + 2`` bit
blocks, so every pair of blocks is a table and the pairs to look at share a table cell: no
link is lost.  Inside a cell the fingerprints are stored vertically (one machine word holds
one bit of 64 fingerprints); differences are added up in carry-save counters, and words whose
64 lanes all exceed the radius are abandoned.  A cell yields the links of a spanning forest
and never all of its pairs; a cell with very many fingerprints is split over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.llm.cells import component_roots, large_cells, pairs_within, split, whole_cells
from tesselle.operators.components import connected_components
from tesselle.scratch import discard, settled, stash

SEED = 42
#: A cell with more fingerprints is compared in parts, each pair of parts by a task of its own.
CELL_ROWS = 8192
#: The same for cells of whole shingle sets.
SET_ROWS = 2048
#: One text in SAMPLE tells which shingles are common, at most COMMON of them. This only orders
#: the shingles, so that cells stay small; no pair depends on it.
SAMPLE, COMMON = 64, 200_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingles(text: bytes, width: int) -> list[bytes]:
    """The word shingles of a text after A-Z are lower-cased, repeats included."""
    w = text.translate(tk.LOWER).split()
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    flat = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    return [flat[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    got = shingles(text, width)
    if not got:
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(got), 8192):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in got[at : at + 8192]], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(got), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp bigint)`` for every row; a null text has no shingles and fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            fps = np.fromiter((fingerprint(raw[a:b], width) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- bit-sliced comparison


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 x ceil(n/64) words: word w of plane b holds bit b of values 64w to 64w+63."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def carry_save(plane: Callable[[int, np.ndarray | None], np.ndarray], words: int, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``(word, lanes)`` of the words with a lane whose set bits over all planes are <= radius.

    ``plane(b, alive)`` gives the difference words of plane b for the words still alive (None:
    all).  The counters are bit-sliced; every ``step`` planes the words in which all 64 lanes
    exceed the radius are dropped.
    """
    depth = (radius + 1).bit_length()
    alive: np.ndarray | None = None
    counter = [np.zeros(words, np.uint64) for _ in range(depth)]
    over = np.zeros(words, np.uint64)

    def exceeds() -> np.ndarray:
        more, equal = over.copy(), ~over
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal &= counter[k]
            else:
                more |= equal & counter[k]
                equal &= ~counter[k]
        return more

    for b in range(64):
        carry = plane(b, alive)
        for k in range(depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % step == step - 1 and b > radius:
            keep = exceeds() != _ALL
            if (left := int(keep.sum())) < 0.8 * len(keep):
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                counter, over = [c[keep] for c in counter], over[keep]
                if not left:
                    break
    lanes = ~exceeds()
    return (np.arange(words) if alive is None else alive), lanes


def _lanes(word: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Lane numbers (word * 64 + bit) of the set bits."""
    if not len(lanes):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return word[w] * 64 + b


def near(queries: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``(query, value)`` index pairs within the radius."""
    planes = planes_of(values)
    words = planes.shape[1]
    flip = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), _ALL, np.uint64(0))

    def plane(b: int, alive: np.ndarray | None) -> np.ndarray:
        if alive is None:
            return (flip[b][:, None] ^ planes[b][None, :]).ravel()
        return flip[b][alive // words] ^ planes[b][alive % words]

    at = _lanes(*carry_save(plane, len(queries) * words, radius))
    q, v = at // (words * 64), at % (words * 64)
    real = v < len(values)
    return q[real], v[real]


def near_differences(differences: np.ndarray, radius: int) -> np.ndarray:
    """Which of the 64-bit differences have at most ``radius`` set bits."""
    planes = planes_of(differences)
    at = _lanes(*carry_save(lambda b, alive: planes[b].copy() if alive is None else planes[b][alive], planes.shape[1], radius))
    return at[at < len(differences)]


def cell_links(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value of a cell the position of its component's first, over links <= radius."""

    def pairs(asked: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return near(values[asked], values[others], radius)

    return component_roots(len(values), pairs)


def _links_of_run(cell: np.ndarray, value: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells; ``cell`` numbers the cell of every row and is ascending."""
    a_all, b_all = [node[:0]], [node[:0]]
    for a, b in pairs_within(cell, 48):
        at = near_differences(value[a] ^ value[b], radius)
        a_all.append(node[a[at]])
        b_all.append(node[b[at]])
    for i, e in large_cells(cell, 48):
        order = np.argsort(node[i:e], kind="stable")  # so that roots are least nodes
        root = cell_links(value[i:e][order], radius)
        linked = np.flatnonzero(root != np.arange(e - i))
        a_all.append(node[i:e][order][linked])
        b_all.append(node[i:e][order][root[linked]])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def cell_edges(cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """``(src, dst)`` links between the nodes of ``cells (keys..., fp, node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in whole_cells(batches, len(keys)):
            value, node = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy()
            a, b = _links_of_run(cell, value, node, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    rows = cells.select(*(F.col(k).cast("long") for k in keys), "fp", "node")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src bigint, dst bigint")


def block_tables(radius: int) -> list[tuple[int, int]]:
    """``(number, mask)`` of every table: the bits of two of ``radius + 2`` blocks."""
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [(k, a | b) for k, (a, b) in enumerate(combinations(masks, 2))]


def links(classes: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links that connect all of ``classes (fp, node)`` at most ``radius`` bits apart."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*(F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in block_tables(radius)))
    cells = classes.select("fp", "node", F.inline(tables))
    cells = split(cells, ["tab", "key"], "fp", cell_rows)
    return cell_edges(cells, ["tab", "key", "lo", "hi"], radius)


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint string, component_id)`` for every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a component is
    named by the smallest doc_id in it.  Null and wordless texts have fingerprint 0 and are
    linked like any other.  A row without doc_id keeps its fingerprint, is in the component
    of equal fingerprints (null if no row with an id has them) and links nothing; repeated
    rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    fps = stash(fingerprints(docs, width))

    def named() -> DataFrame:
        classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
        tree = connected_components(links(classes.filter("node is not null"), radius))
        return classes.join(tree, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))

    named = settled(named)  # a table, so that a fingerprint that very many have can be split in the join
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets of word shingles have at least the Jaccard similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            rows = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(raw[a:b], width)], np.uint64)).view(np.int64) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "set"])

    wanted = pairs.select(F.col("src").alias("doc_id")).unionByName(pairs.select(F.col("dst").alias("doc_id"))).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    held = stash(texts.select("doc_id", "text").mapInArrow(sets, "node bigint, set array<bigint>"))
    both = pairs.join(held.select(F.col("node").alias("src"), F.col("set").alias("s")), "src").join(held.select(F.col("node").alias("dst"), F.col("set").alias("d")), "dst")
    common = F.size(F.array_intersect("s", "d"))
    return both.filter(common >= F.lit(similarity) * (F.size("s") + F.size("d") - common)).select("src", "dst")


# ---------------------------------------------------------------- all similar sets


def _sample_common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (ascending) that a sample of the texts often has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            raw, at = data.tobytes(), offsets.tolist()
            for a, b in zip(at, at[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(raw[a:b], width)[0].view(np.int64))], names=["key"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "sha"), F.lit(SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = often.orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], rows["n"].to_numpy(np.int64)[order]


def hashes(text: bytes, width: int) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes of a text, ascending, and its fingerprint."""
    every = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, width)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(every), 8192):
        bits += np.unpackbits(every[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.unique(every), int(np.packbits(bits * 2 > len(every), bitorder="little").view("<u8")[0])


def prefix(held: np.ndarray, similarity: float, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first hashes of a set, rare ones first: two sets of at least the similarity share one of them.

    Sets that similar share ``ceil(similarity * size)`` hashes of each, so of any order that all
    sets keep the first ``size - that + 1`` meet.  An empty set meets the others at hash 0.
    """
    if not len(held):
        return np.zeros(1, np.uint64)
    n = len(held) - int(np.ceil(similarity * len(held) - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        rank = np.where(common[at] == held, count[at], 0)
        if rank.any():
            held = held[np.argsort(rank, kind="stable")]
    return held[:n]


def parities(held: np.ndarray) -> np.ndarray:
    """A bit for each hash at least (a power of two of them): whether the hashes of that number are odd in count.

    Two sets' parities differ in at most as many bits as the sets differ in hashes; half the
    bits are the two halves' difference.
    """
    n = 1 << max(6, (len(held) - 1).bit_length())
    odd = np.bincount((held & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(doc_id, sha, fp, size, bits array<bigint>, prefix array<bigint>)`` for every row of ``docs (doc_id, sha, text)``."""
    common, count = _sample_common(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(2))
            raw, at = data.tobytes(), offsets.tolist()
            fps, sizes, bits, keys = [], [], [], []
            for a, b in zip(at, at[1:], strict=False):
                held, fp = hashes(raw[a:b], width)
                fps.append(fp)
                sizes.append(len(held))
                bits.append(parities(held).view(np.int64))
                keys.append(prefix(held, similarity, common, count).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, kind), pa.array(keys, kind)], names=["doc_id", "sha", "fp", "size", "bits", "prefix"]
            )

    return docs.select("doc_id", "sha", "text").mapInArrow(run, "doc_id bigint, sha string, fp bigint, size bigint, bits array<bigint>, prefix array<bigint>")


def _named(cell: np.ndarray, item: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """The rows of the cells that several groups have, under names that cells of the same items share.

    Members of one group need no comparison, and the same items only one.
    """
    first = np.searchsorted(cell, np.arange(int(cell[-1]) + 1))
    several = np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)
    name = np.add.reduceat(tk.mixed(item.view(np.uint64)), first)
    keep = several[cell]
    return pa.RecordBatch.from_arrays([pa.array(name[cell[keep]].view(np.int64)), pa.array(item[keep]), pa.array(group[keep])], names=["cell", "item", "group"])


_CELLS = "cell bigint, item bigint, group bigint"


def _open_cells(tokens: DataFrame) -> DataFrame:
    """``(cell, item, group)``: the members of the keys of ``tokens (key, item, group)`` that several groups have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in whole_cells(batches, 1, 200_000, 16 << 20):
            yield _named(cell, rows.column("item").to_numpy(), rows.column("group").to_numpy())

    return tokens.select("key", "item", "group").repartition("key").sortWithinPartitions("key").mapInArrow(run, _CELLS).distinct()


def close_roots(size: np.ndarray, bits: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of a cell the first of its component, over all pairs that may be similar by size and parities."""
    words = np.array([len(x) for x in bits])
    share = (1 - similarity) / (1 + similarity)  # sets that similar differ in at most this share of their sizes
    planes = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero((words == w) | (words == 2 * w))
        planes[w] = at, np.stack([bits[k] if words[k] == w else bits[k][:w] ^ bits[k][w:] for k in at.tolist()])

    def near(asked: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, v = [], []
        for k, a in enumerate(asked.tolist()):
            most = share * (size[a] + size[others]) + 1e-6
            may = np.flatnonzero(np.abs(size[a] - size[others]) <= most)
            for w in np.unique(np.minimum(words[a], words[others[may]])).tolist():
                at, plane = planes[w]
                some = may[np.minimum(words[a], words[others[may]]) == w]
                apart = np.bitwise_count(plane[np.searchsorted(at, a)] ^ plane[np.searchsorted(at, others[some])]).sum(1, dtype=np.int64)
                hit = some[apart <= most[some]]
                q.append(np.full(len(hit), k))
                v.append(hit)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *q]), np.concatenate([none, *v])

    return component_roots(len(size), near, 16)


def _close_cells(cells: DataFrame, similarity: float) -> DataFrame:
    """``(cell, item, group)``: cells ``(cell, lo, hi, item, group, size, bits)`` without the pairs that their parities tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in whole_cells(batches, 3):
            item, group, size = (rows.column(c).to_numpy() for c in ("item", "group", "size"))
            held = rows.column("bits").combine_chunks()
            flat, at = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
            part = np.arange(len(cell))
            for i, e in large_cells(cell, 1):
                part[i:e] = i + close_roots(size[i:e], [flat[at[k] : at[k + 1]] for k in range(i, e)], similarity)
            order = np.argsort(part, kind="stable")
            part = part[order]
            yield _named(np.cumsum(np.diff(part, prepend=part[0]) != 0), item[order], group[order])

    rows = cells.select("cell", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "item", "group", "size", "bits")
    return rows.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(run, _CELLS).distinct()


def set_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the sets the first of its component, over links of at least the similarity."""
    size = np.array([len(x) for x in sets], np.int64)
    _, ident, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = often[ident] > 1  # the others are in no intersection
    owner = np.repeat(np.arange(len(sets)), size)[met]
    ident, mark = ident[met], np.zeros(len(often), bool)
    edge = np.searchsorted(owner, np.arange(len(sets) + 1))

    def near(asked: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = edge[others + 1] - edge[others]
        end = np.cumsum(held)
        flat = ident[np.arange(int(end[-1])) + np.repeat(edge[others] - (end - held), held)]
        q, v = [], []
        for k, a in enumerate(asked.tolist()):
            own = ident[edge[a] : edge[a + 1]]
            mark[own] = True
            shared = np.concatenate([[0], np.cumsum(mark[flat])])
            mark[own] = False
            both = shared[end] - shared[end - held]
            hit = np.flatnonzero(both >= similarity * (size[a] + size[others] - both))
            q.append(np.full(len(hit), k))
            v.append(hit)
        return np.concatenate(q), np.concatenate(v)

    return component_roots(len(sets), near, 16)


def _set_links(cells: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)`` links between the nodes of each cell ``(cell, node, set)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in whole_cells(batches, 1):
            node = rows.column("node").to_numpy()
            held = rows.column("set").combine_chunks()
            flat, at = held.values.to_numpy(), held.offsets.to_numpy()
            src, dst = [node[:0]], [node[:0]]
            for i, e in large_cells(cell, 1):
                root = set_roots([flat[at[k] : at[k + 1]] for k in range(i, e)], similarity)
                linked = np.flatnonzero(root != np.arange(e - i))
                src.append(node[i:e][linked])
                dst.append(node[i:e][root[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return cells.select("cell", "node", "set").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "src bigint, dst bigint")


def similar_links(docs: DataFrame, known: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links that join all groups of ``known (item, node, group, sha, size, bits, prefix)`` with a pair of texts of at least the similarity.

    Similar sets share a hash of their prefixes, so every pair of different groups meets in a
    cell; pairs whose sizes or parities show that they differ too much are left out, and the
    others compared by whole sets. ``docs (doc_id, sha, text)`` has the texts.
    """
    met = stash(_open_cells(known.select("item", "group", F.explode("prefix").alias("key"))))
    cells = stash(_close_cells(split(met, ["cell"], "item", SET_ROWS).join(known.select("item", "size", "bits"), "item"), similarity))
    discard(met)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            rows = [hashes(raw[a:b], width)[0].view(np.int64) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["item", "set"])

    wanted = known.join(cells.select("item").distinct(), "item", "left_semi").select("item", "sha", F.col("node").alias("doc_id"))
    texts = docs.join(wanted, ["doc_id", "sha"]).select("item", "text").dropDuplicates(["item"])
    held = stash(texts.mapInArrow(sets, "item bigint, set array<bigint>"))
    return _set_links(cells.join(known.select("item", "node"), "item").join(held, "item"), similarity)


def duplicate_groups(docs: DataFrame, width: int = 5, radius: int = 8, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, group_id)``, a row for each doc_id: the components of all pairs of texts whose
    sets of ``width``-word shingles have at least the similarity.

    SimHash proposes first: links within ``radius`` bits to a document's least neighbour and
    to its component's least document are checked on the whole sets and make most groups
    cheaply.  Every pair of sets that these leave in different groups and that can be similar
    (it shares a hash of both prefixes) is then compared as well, so no pair is lost.  Equal
    texts are always one group.  A group is named by its smallest doc_id.  Rows without doc_id
    are left out; an id with several texts is linked through each of them.
    """
    return settled(lambda: _groups(docs, width, radius, similarity))


def _groups(docs: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    told = docs.filter("doc_id is not null").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha"), "text")
    drawn = stash(_sketches(told, width, similarity))
    same = stash(drawn.groupBy("sha").agg(F.min("doc_id").alias("node")))
    first = stash(drawn.select("doc_id", "sha").join(same, "sha").select("doc_id", "node").distinct())
    # Distinct texts may share a fingerprint, so each text is a node and equal fingerprints are links.
    items = drawn.join(same.withColumnRenamed("node", "doc_id"), ["sha", "doc_id"], "left_semi").dropDuplicates(["sha"]).withColumnRenamed("doc_id", "node")
    items = stash(items.withColumn("item", F.xxhash64("sha")))
    discard(drawn)
    nodes = items.select("fp", "node").distinct()
    classes = stash(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = nodes.join(classes, "fp").filter("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
    edges = stash(links(classes.withColumnRenamed("rep", "node"), radius).unionByName(equal).distinct())
    root = connected_components(edges).filter("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    least = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).groupBy("src").agg(F.min("dst").alias("dst"))
    checked = stash(root.unionByName(least).distinct())
    sound = _similar(checked, docs.select("doc_id", "text"), width, similarity)
    # Equal texts are joined to their least id, whatever else that id is linked to.
    copies = first.filter("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    proposed = stash(connected_components(sound.unionByName(copies)))
    known = stash(items.join(proposed, "node", "left").withColumn("group", F.coalesce("component", "node")))
    discard(items)
    rest = similar_links(told, known, width, similarity)
    groups = connected_components(proposed.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(rest)).withColumnsRenamed({"node": "doc_id", "component": "group_id"})
    alone = first.select("doc_id").distinct().join(groups, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("group_id"))
    return groups.unionByName(alone)
