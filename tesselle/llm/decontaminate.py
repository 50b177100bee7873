"""Benchmark decontamination by a distributed positional inverted index.

The corpus is read once and stored as an index: a row is a segment (the texts of one step
of a task) with its terms and, for each term, the ascending positions of its tokens.  A term's
postings are therefore spread over all segments; none is ever gathered in one place, however
frequent it is, and a search reads the index alone.

The windows of the benchmark get the global frequency of each of their terms from the index.
In a segment a window's lists are taken from the globally rarest term on, shifted by the
term's place in the window, and intersected until they're empty or all terms agree: an exact
phrase.  Proximity matches are places where a window's two rarest terms stand about as close
as in the window.  Windows are sent to the tasks in blocks of bounded size, a pass over the
index for each; a benchmark of any size takes the same path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.scratch import discard, settled, stash

WINDOW = 10
#: A segment of the index covers about this many bytes of text (a longer text is a segment alone).
SEGMENT_BYTES = 1 << 18
#: One broadcast block holds the windows of about this many bytes of benchmark text.
BLOCK_BYTES = 1 << 20

_TO_WORDS = bytes(32 if tk.NON_ALNUM[tk._LOWER_LUT[b]] else tk.LOWER[b] for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII."""
    return (text or "").encode().translate(_TO_WORDS).split()


def expanded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths: which list, and which entry of it, one after another."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


# ---------------------------------------------------------------- the index


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's term, and a token of each term; equal bytes, equal terms."""
    _, some, number = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    token, inner = expanded(size)
    other = some[number]
    if (size == size[other]).all() and (data[starts[token] + inner] == data[starts[other[token]] + inner]).all():
        return number, some
    held: dict[bytes, int] = {}  # a hash that two terms share
    raw = data.tobytes()
    number = np.array([held.setdefault(raw[a:b], len(held)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return number, np.unique(number, return_index=True)[1]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an array of strings."""
    size = ends - starts
    token, inner = expanded(size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[starts[token] + inner])))


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a table, a row a segment: ``(segment bigint, ids array<bigint>, first array<int>,
    terms array<string>, count array<int>, gaps array<int>)``.

    ``first`` has the first token of each document and the number of all; ``count`` the
    length of each term's list; ``gaps`` all lists on end, the first position of each as it is and the
    others less the one before.  A null text has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1), SEGMENT_BYTES):
                data = tk.lowered(data)
                starts, ends, first = tk.spans(data, offsets, tk.NON_ALNUM)
                number, some = numbered(data, starts, ends)
                order = np.argsort(number, kind="stable")
                count = np.bincount(number, minlength=len(some))
                gaps = np.diff(order, prepend=0)
                head = np.cumsum(count) - count
                gaps[head] = order[head]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                small = lambda x: one(pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([segment]), one(batch.column(0).slice(a, b - a)), small(first), one(_strings(data, starts[some], ends[some])), small(count), small(gaps)], names=["segment", "ids", "first", "terms", "count", "gaps"])
                segment += 1

    return docs.select("doc_id", "text").mapInArrow(run, "segment bigint, ids array<bigint>, first array<int>, terms array<string>, count array<int>, gaps array<int>")


@dataclass
class Segment:
    """A segment of the index, opened."""

    first: np.ndarray  # the first token of each document, and the end
    terms: list[str]
    count: np.ndarray  # length of each term's list
    head: np.ndarray  # where it begins in positions
    positions: np.ndarray  # ascending within each term

    @classmethod
    def opened(cls, first: pa.Array, terms: pa.Array, count: pa.Array, gaps: pa.Array) -> Segment:
        first, count, gaps = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, count, gaps))
        head = np.cumsum(count) - count
        total = np.cumsum(gaps)
        return cls(first, terms.to_pylist(), count, head, total - np.repeat(total[head] - gaps[head], count))

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Segment]]:
        """``(segment, ids, opened)`` of the rows ``(segment, ids, first, terms, count, gaps)``."""
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].values, cls.opened(*(batch.column(c)[i].values for c in range(2, 6)))


def postings(index: DataFrame) -> DataFrame:
    """The index term by term: ``(term, doc_id, positions array<int>)``, words of a document counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, s in Segment.each(batches):
            term = np.repeat(np.arange(len(s.count)), s.count)
            doc = np.searchsorted(s.first, s.positions, "right") - 1
            edge = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(doc) != 0))) if len(term) else term
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(term)).astype(np.int32)), pa.array((s.positions - s.first[doc]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(s.terms, pa.string()).take(pa.array(term[edge])), ids.take(pa.array(doc[edge])), lists], names=["term", "doc_id", "positions"])

    return index.select("segment", "ids", "first", "terms", "count", "gaps").mapInArrow(run, "term string, doc_id bigint, positions array<int>")


# ---------------------------------------------------------------- the windows


def test_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(phrase string, items array<string>)``: the distinct windows, words parted by a space, and whose they are.

    A window is ``width`` consecutive words of an item; an item of fewer, but not none, is one.
    Items without id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase, item = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                found = {b" ".join(w[i : i + width]).decode() for i in range(max(1, len(w) - width + 1) if w else 0)}
                phrase += found
                item += [name] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(item, pa.string())], names=["phrase", "item"])

    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "phrase string, item string")
    return rows.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def weighed(windows: DataFrame, index: DataFrame) -> DataFrame:
    """``(phrase, items, rare array<struct<n, place, term>>)``: the different terms of each window by
    how many tokens of the corpus are that term, rare ones first (ties: the earlier place)."""
    places = windows.select("phrase", F.posexplode(F.split("phrase", " ")).alias("place", "term")).groupBy("phrase", "term").agg(F.min("place").alias("place"))
    wanted = places.select("term").distinct()
    counted = index.select(F.explode(F.arrays_zip("terms", "count")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.count").alias("n"))
    often = counted.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = places.join(often, "term", "left").select("phrase", F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "place", "term").alias("t"))
    return windows.join(ranked.groupBy("phrase").agg(F.sort_array(F.collect_list("t")).alias("rare")), "phrase")


@dataclass
class TestWindows:
    """The distinct windows of a block, over a numbered vocabulary."""

    number: dict[str, int]
    windows: np.ndarray  # W x width, numbers of terms, -1 after a shorter window's end
    rare_first: np.ndarray  # W x width, places by global frequency
    length: np.ndarray  # W
    items: list[list[str]]  # items of each window
    pairs: np.ndarray  # the two rarest terms of the windows and their distance

    @classmethod
    def build(cls, rows: list[tuple[str, list[str], list[tuple[int, int, str]]]]) -> TestWindows:
        """From rows of :func:`weighed`."""
        split = [r[0].split(" ") for r in rows]
        number: dict[str, int] = {}
        width = max(map(len, split), default=1)
        grid, many = np.full((len(rows), width), -1, np.int32), np.full((len(rows), width), np.iinfo(np.int64).max)
        pairs = set()
        for k, (w, (_, _, rare)) in enumerate(zip(split, rows, strict=True)):
            often = {term: n for n, _, term in rare}
            grid[k, : len(w)] = [number.setdefault(t, len(number)) for t in w]
            many[k, : len(w)] = [often[t] for t in w]
            if len(rare) > 1:
                (_, i, a), (_, j, b) = rare[:2]
                pairs.add((number[a], number[b], abs(i - j)))
        return cls(number, grid, np.argsort(many, axis=1, kind="stable").astype(np.int8 if width < 128 else np.int32), (grid >= 0).sum(1), [r[1] for r in rows], np.array(sorted(pairs), np.int64).reshape(-1, 3))


def window_blocks(weighed_windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[TestWindows]:
    """The windows in blocks, one at a time on the driver; windows with the same two rarest terms share a block."""
    size = weighed_windows.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    n = max(1, -(-size // (block_bytes * WINDOW)))
    two = F.xxhash64(F.col("rare.term")[0], F.when(F.size("rare") > 1, F.col("rare.term")[1]))
    for k in range(n):
        rows = weighed_windows.filter(F.pmod(two, F.lit(n)) == k).orderBy("phrase").collect()
        yield TestWindows.build([(r.phrase, list(r["items"]), [tuple(t) for t in r.rare]) for r in rows])


# ---------------------------------------------------------------- the search


class Lists:
    """The postings of a segment for the terms of a block."""

    def __init__(self, segment: Segment, tests: TestWindows) -> None:
        n = len(tests.number)
        at = [(tests.number[t], i) for i, t in enumerate(segment.terms) if t in tests.number]
        number, own = np.array(at, np.int64).reshape(-1, 2).T
        order = np.argsort(number)
        number, own = number[order], own[order]
        self.count = np.zeros(n, np.int64)
        self.count[number] = segment.count[own]
        self.head = np.cumsum(self.count) - self.count
        owner, entry = expanded(segment.count[own])
        self.positions = segment.positions[segment.head[own][owner] + entry]
        self.keys = (number[owner] << 40) | self.positions  # ascending

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        key = (term << 40) | np.maximum(position, 0)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[i] == key) & (position >= 0)


def phrase_matches(lists: Lists, tests: TestWindows, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(window, first token)`` of every exact occurrence that lies within one document."""
    grid = tests.windows
    none = np.zeros(0, np.int64)
    if not len(grid):
        return none, none
    live = np.flatnonzero(((lists.count[grid] > 0) | (grid < 0)).all(1))
    if not len(live):
        return none, none
    rare_first = tests.rare_first[live].astype(np.int64)
    term = grid[live, rare_first[:, 0]].astype(np.int64)
    owner, entry = expanded(lists.count[term])
    start = lists.positions[lists.head[term[owner]] + entry] - rare_first[owner, 0]
    inside = (start >= 0) & (start + tests.length[live[owner]] <= first[-1])
    owner, start = owner[inside], start[inside]
    for k in range(1, grid.shape[1]):
        if not len(owner):
            break
        place = rare_first[owner, k]
        term = grid[live[owner], place].astype(np.int64)
        keep = (term < 0) | lists.holds(np.maximum(term, 0), start + place)
        owner, start = owner[keep], start[keep]
    window = live[owner]
    same = np.searchsorted(first, start, "right") == np.searchsorted(first, start + tests.length[window] - 1, "right")
    return window[same], start[same]


def proximity_matches(lists: Lists, tests: TestWindows, first: np.ndarray, slop: int) -> np.ndarray:
    """How many places of each document have one of a window's two rarest terms with the other at
    most ``slop`` tokens farther away than in the window, on either side."""
    n = len(first) - 1
    pairs = tests.pairs
    pairs = pairs[(lists.count[pairs[:, 0]] > 0) & (lists.count[pairs[:, 1]] > 0)] if len(pairs) else pairs
    if not len(pairs):
        return np.zeros(n, np.int64)
    owner, entry = expanded(lists.count[pairs[:, 0]])
    at = lists.positions[lists.head[pairs[owner, 0]] + entry]
    doc = np.searchsorted(first, at, "right") - 1
    other, reach = pairs[owner, 1] << 40, pairs[owner, 2] + slop
    lo = np.searchsorted(lists.keys, other | np.maximum(at - reach, first[doc]))
    hi = np.searchsorted(lists.keys, other | np.minimum(at + reach, first[doc + 1] - 1), "right")
    return np.bincount(doc[hi > lo], minlength=n)


_FOUND = "segment bigint, place int, doc_id bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>, n_near bigint"


def _search(index: DataFrame, tests: TestWindows, slop: int) -> DataFrame:
    """A row for every document of the index: what the windows of a block hit in it."""
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, ids, s in Segment.each(batches):
            tests, n = sent.value, len(s.first) - 1
            lists = Lists(s, tests)
            window, start = phrase_matches(lists, tests, s.first)
            near = proximity_matches(lists, tests, s.first, slop)
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            doc = np.searchsorted(s.first, start, "right") - 1
            for w, d, a, b in zip(window.tolist(), doc.tolist(), (start - s.first[doc]).tolist(), (start - s.first[doc] + tests.length[window]).tolist(), strict=True):
                spans[d].append({"a": a, "b": b})
                items[d].update(tests.items[w])
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.diff(s.first)), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(near)],
                names=["segment", "place", "doc_id", "n_words", "spans", "items", "n_near"],
            )

    return index.select("segment", "ids", "first", "terms", "count", "gaps").mapInArrow(run, _FOUND)


def covered(spans: pa.Array) -> pa.Array:
    """How many words the spans of each row cover."""
    out = []
    for row in spans.to_pylist():
        total, reach = 0, 0
        for a, b in sorted((s["a"], s["b"]) for s in row or ()):
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        out.append(total)
    return pa.array(out, pa.int64())


def matches(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, spans, items, n_near)`` for every document of an index from :func:`build_index`.

    ``spans`` are the exact occurrences of windows (first word, end), ``items`` whose they are,
    ``n_near`` the proximity matches.  See :func:`contamination`.  What is found is written, so that
    the index, whose rows are half a megabyte, is read a few rows at a time whoever asks.
    """
    ready = stash(weighed(stash(test_windows(benchmark, width)), index), wide=True)
    found = None
    for tests in window_blocks(ready, block_bytes):
        one = stash(_search(index, tests, slop), wide=True)
        if found is None:
            found = one
        else:
            before, found = found, stash(_merged(found.unionByName(one)))
            discard(before)
            discard(one)
    discard(ready)
    return found.drop("segment", "place")


def _merged(rows: DataFrame) -> DataFrame:
    """One row a document of what two blocks found."""
    both = rows.groupBy("segment", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    return both.select("segment", "place", "doc_id", "n_words", "spans", "items", "n_near")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items array<string>, n_near, contaminated)`` for every row.

    A window is ``width`` consecutive words of an item; an item with fewer words, but not
    none, is one window.  A word of a document inside any occurrence of a window is hit;
    ``items`` are those with an occurring window.  ``n_near`` counts proximity: places of the
    rarer of a window's two rarest terms (by tokens of the corpus; ties: the earlier place)
    that have the other one at most ``slop`` words farther away than in the window.

    A null or empty text has no words; items without words or id match nothing; repeated
    items or windows count once, repeated rows of ``docs`` each get a row; other columns are
    ignored; an empty table gives no rows.  The benchmark may have any size: it is searched in
    blocks, each a pass over the stored index.
    """
    index = stash(build_index(docs))
    found = matches(index, benchmark, width, slop, block_bytes)
    discard(index)
    hit = found.withColumn("n_hit", F.arrow_udf(covered, "bigint")("spans"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "n_near", (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    key, name = tk.row_key("doc_id", "text"), max(docs.columns, key=len) + "_"
    held = settled(lambda: contamination(docs.select(key.alias("doc_id"), "text"), benchmark, width).filter("contaminated").select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, key).join(held, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def items_digest(items: list[str]) -> str:
    """sha256 of the sorted item ids, comma-joined: the plain form of the query's column."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
