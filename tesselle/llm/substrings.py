"""Removal of long passages that repeat across documents, by prefix-partitioned suffix trees.

A passage is a window of ``WINDOW`` consecutive words.  The suffixes that matter are those
that begin such a window; a window is led by one of its word k-grams (the least by hash), so
equal windows have equal leads and neighbouring windows mostly share one.  Windows of a
document with the same lead form a run, and runs are grouped by the lead: a prefix that
splits all suffixes into groups of which only those met in several documents go on.

Of such a group each distinct run (by a 128-bit digest of its words) is fetched once, and
a generalised suffix tree is built over the runs of as many groups as fit in memory.  The
tree's internal nodes of depth ``WINDOW`` or more are the repeated passages: the topmost ones give every
window the least document below its node, and all of them the maximal repeats.  A group
with too many runs for one tree is taken apart into suffixes, which are parted by longer prefixes,
each as long as it takes for its group to fit; suffixes that agree in the whole window
need no tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.scratch import discard, stash

WINDOW, LEAD = 50, 8
#: A group with more distinct runs than this is parted by longer prefixes, into groups of at most so many suffixes.
GROUP_RUNS, GROUP_SUFFIXES = 2000, 4000
#: Words of the groups whose trees are built together.
TREE_WORDS = 300_000
_LAST = (1 << 63) - 1
_KEYS = ["p", "x", "y", "n"]
_RUN, _RUN_TYPES = "p bigint, x bigint, y bigint, n int", [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_SPANS = "array<struct<a:int,b:int,low:bigint>>"


def least_lead(lead: np.ndarray, reach: int) -> np.ndarray:
    """For every position the first place of the least value among the ``reach`` from it on.

    Windows grow by doubling, so the cost is a few array operations a position.
    """
    padded = np.concatenate([lead, np.full(reach, np.iinfo(np.uint64).max, np.uint64)])
    best, size = np.arange(len(padded)), 1
    while size < reach:
        step = min(size, reach - size)
        later = best[step:]
        own = best[: len(later)]
        best = best.copy()
        best[: len(later)] = np.where(padded[later] < padded[own], later, own)
        size += step
    return best[: len(lead)]


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins there."""
    size = ends - starts
    begins = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out[begins[word] + inner] = data[starts[word] + inner]
    return out.tobytes(), begins


def runs_of(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """The runs of windows with one lead: prefix, digest of all their words, windows, row, and
    (``at``, cut by ``cuts``) the first words of the equal ones in that row."""
    starts, ends, first = tk.spans(data, offsets, tk.SPACES)
    word, row = tk.span_hashes(data, starts, ends), tk.row_of(first)
    at = np.arange(len(word))
    end = first[row + 1] if len(row) else at
    lead = np.full(len(word), np.iinfo(np.uint64).max, np.uint64)
    whole = np.flatnonzero(at + k <= end)
    lead[whole] = tk.span_hashes(word, whole, whole + k, 1)
    s = np.flatnonzero(at + window <= end)
    led = least_lead(lead, window - k + 1)[s]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (led[1:] != led[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(s)))
    lo = s[begin]
    p, own = lead[led[begin]], row[lo]
    text, place = spaced(data, starts, ends)
    last = lo + n + window - 2
    x, y = tk.digests(text, place[lo], place[last] + (ends - starts)[last])
    # A row's equal runs (text that goes round in a circle has one every few words) are one entry.
    order = np.lexsort((lo, y, x, own))
    new = np.ones(len(order), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    cuts = np.flatnonzero(new)
    one = order[cuts]
    return {"p": p[one], "x": x[one], "y": y[one], "n": n[one], "row": own[one], "at": (lo - first[own])[order], "cuts": np.append(cuts, len(order))}


def _runs(keyed: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, _, data, offsets in tk.chunks(batch.column(2)):
                r = runs_of(data, offsets, window, k)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(r[c].view(np.int64)) for c in "pxy"), pa.array(r["n"].astype(np.int32)), pa.array(doc[a + r["row"]]), pa.array(rid[a + r["row"]]), pa.ListArray.from_arrays(pa.array(r["cuts"].astype(np.int32)), pa.array(r["at"].astype(np.int32)))],
                    names=[*_KEYS, "doc", "rid", "at"],
                )

    return keyed.select("doc", "rid", "text").mapInArrow(run, f"{_RUN}, doc bigint, rid bigint, at array<int>")


def _contents(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs ``(p, x, y, n, doc, rid, at)``: ``(p, x, y, n, low, words binary)``."""
    lists = wanted.groupBy("doc", "rid").agg(F.collect_list(F.struct(*_KEYS, "at")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().split()
                for w in want:
                    for column, value in zip(out, (*(w[k] for k in _KEYS), doc, b" ".join(words[w["at"] : w["at"] + w["n"] + window - 1])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*_RUN_TYPES, pa.int64(), pa.binary()), strict=True)], names=[*_KEYS, "low", "words"])

    # Rows that repeat an id and its text have the same runs: one of them is read.
    texts = keyed.join(lists, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("doc", "text", "want")
    return texts.mapInArrow(run, f"{_RUN}, low bigint, words binary")


class SuffixTree:
    """The generalised suffix tree of some texts (of numbered words), held as arrays.

    ``order`` has all suffixes ascending, ``depth[i]`` how many words suffixes i and i + 1 of
    that order share.  An internal node of depth d is a longest range of suffixes of which
    all neighbours share d words or more and some just d.  ``last[i]`` is the end of the text that position i
    is in; a suffix ends there.
    """

    def __init__(self, words: np.ndarray, last: np.ndarray) -> None:
        n = len(words)
        at = np.arange(n)
        longest = int((last - at).max(initial=1))
        rank, step, ranks = np.unique(words, return_inverse=True)[1] + 1, 1, []
        while True:  # ranks of the first 1, 2, 4, ... words
            ranks.append((step, rank))
            if step >= longest:
                break
            later = np.zeros(n, np.int64)
            inside = np.flatnonzero(at + step < last)
            later[inside] = rank[inside + step]
            rank, step = np.unique(rank * (n + 1) + later, return_inverse=True)[1] + 1, 2 * step
        self.words, self.order = words, np.argsort(rank, kind="stable")
        self.starts = np.ones(n, bool)
        self.starts[1:] = last[1:] != last[:-1]
        a, b = self.order[:-1], self.order[1:]
        self.depth = np.zeros(max(0, n - 1), np.int64)
        for step, rank in reversed(ranks):
            more = np.flatnonzero((a + self.depth + step <= last[a]) & (b + self.depth + step <= last[b]))
            more = more[rank[(a + self.depth)[more]] == rank[(b + self.depth)[more]]]
            self.depth[more] += step

    def topmost(self, least: int) -> np.ndarray:
        """For each position the number of the topmost node of at least this depth that its suffix is below
        (suffixes below none have numbers of their own)."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(np.append(0, self.depth < least))
        return out

    def deep_nodes(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(depth, first, end)``: the internal nodes of each depth from ``least`` on, as ranges of the order."""
        for d in np.unique(self.depth[self.depth >= least]).tolist():
            edge = np.concatenate([[0], np.flatnonzero(self.depth < d) + 1, [len(self.order)]])
            first, end = edge[:-1], edge[1:]
            wide = end - first > 1
            first, end = first[wide], end[wide]
            lowest = np.minimum.reduceat(np.append(self.depth, d + 1), np.stack([first, end - 1], 1).ravel())[::2]
            yield d, first[lowest == d], end[lowest == d]

    def maximal_repeats(self, least: int) -> list[tuple[int, list[int]]]:
        """``(words, places)`` of every sequence of at least so many words that occurs more than once
        and not always with the same word before or after it."""
        before = np.where(self.starts, -1 - np.arange(len(self.words)), np.roll(self.words, 1))[self.order]
        out = []
        for d, first, end in self.deep_nodes(least):
            for a, e in zip(first.tolist(), end.tolist(), strict=True):
                if before[a:e].min() != before[a:e].max():
                    out.append((d, sorted(self.order[a:e].tolist())))
        return out


def tree_of(texts: list[bytes]) -> tuple[SuffixTree, np.ndarray]:
    """The tree of texts whose words are parted by one space, and where each text begins."""
    numbers: dict[bytes, int] = {}
    flat, sizes = [], []
    for text in texts:
        words = text.split(b" ")
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        sizes.append(len(words))
    end = np.cumsum(sizes, dtype=np.int64)
    return SuffixTree(np.array(flat, np.int64), np.repeat(end, sizes)), end - sizes


def _subtree_minima(rows: list[tuple], window: int) -> pa.RecordBatch:
    """For runs ``(.., n, low, words)`` of whole groups the least document of each window, as spans of equal ones."""
    tree, begin = tree_of([r[-1] for r in rows])
    n = np.array([r[-3] for r in rows])
    low = np.array([r[-2] for r in rows], np.int64)
    node = tree.topmost(window)
    owner = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    node = node[begin[owner] + inner]
    least = np.full(int(node.max()) + 1, _LAST, np.int64)
    np.minimum.at(least, node, low[owner])
    value = least[node]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], len(value))
    spans = pa.StructArray.from_arrays([pa.array(inner[at].astype(np.int32)), pa.array(inner[end - 1].astype(np.int32)), pa.array(value[at])], names=["a", "b", "low"])
    cuts = np.searchsorted(owner[at], np.arange(len(rows) + 1)).astype(np.int32)
    keys = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_RUN_TYPES, 1)]
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(cuts), spans)], names=[*_KEYS, "spans"])


def _trees(contents: DataFrame, group: str, window: int) -> DataFrame:
    """``(p, x, y, n, spans)`` of the runs of groups (one value of the column ``group``) that fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and words >= TREE_WORDS and row[0] != held[-1][0]:
                    yield _subtree_minima(held, window)
                    held, words = [], 0
                held.append(row)
                words += row[4] + window - 1
        if held:
            yield _subtree_minima(held, window)

    rows = contents.select(F.col(group).alias("_group"), *_KEYS, "low", "words")
    return rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, f"{_RUN}, spans {_SPANS}")


def _suffixes(contents: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """``(p, x, y, n, low, j, prefixes array<bigint>, words binary)``: every window of the runs, with a
    key of each of its prefixes of these lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *keys, low, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                starts, ends, _ = tk.spans(data, np.array([0, len(data)]), tk.SPACES)
                word, j = tk.span_hashes(data, starts, ends), np.arange(keys[-1])
                prefixes = np.stack([tk.span_hashes(word, j, j + k, 1) for k in lengths], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([v] * len(j), t) for v, t in zip((*keys, low), (*_RUN_TYPES, pa.int64()), strict=True)),
                        pa.array(j.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(lengths) * len(j) + 1, len(lengths), dtype=np.int32)), pa.array(prefixes.ravel())),
                        pa.array([text[starts[i] : ends[i + window - 1]] for i in j.tolist()], pa.binary()),
                    ],
                    names=[*_KEYS, "low", "j", "prefixes", "words"],
                )

    return contents.select(*_KEYS, "low", "words").mapInArrow(run, f"{_RUN}, low bigint, j int, prefixes array<bigint>, words binary")


def _parted(contents: DataFrame, window: int, lead: int, group_suffixes: int) -> DataFrame:
    """``(p, x, y, n, spans)`` of the runs of groups of any size, by suffixes and longer prefixes.

    A suffix is grouped by the shortest of its prefixes (of ``lead``, twice, four times, ...
    words) that at most ``group_suffixes`` suffixes have.  Where even the longest one has more,
    the suffixes are grouped by the whole window, counted in parts, word by word.
    """
    lengths = [k for i in range(16) if (k := lead << i) < window] or [window]
    suffixes = stash(_suffixes(contents, window, lengths))
    known, group, settled = suffixes, F.lit(None).cast("bigint"), F.lit(False)
    for i in range(len(lengths)):
        prefix = F.col("prefixes")[i]
        hot = stash(suffixes.groupBy(prefix.alias(f"h{i}")).agg(F.count("*").alias("many")).filter(F.col("many") > group_suffixes).select(f"h{i}", F.lit(True).alias(f"hot{i}")))
        known = known.withColumn(f"h{i}", prefix).join(hot, f"h{i}", "left")
        fits = F.col(f"hot{i}").isNull()
        group = F.when(settled, group).when(fits, F.xxhash64(F.lit(i), f"h{i}"))
        settled = settled | fits
    known = stash(known.select(*_KEYS, "low", "j", "words", group.alias("group")))
    discard(suffixes)
    # One suffix is a run of one window; its place in its own run is kept as n.
    single = known.filter("group is not null").withColumn("x", F.struct(*_KEYS, "j"))
    ids = single.select("group", F.monotonically_increasing_id().alias("p"), "x", "low", "words")
    ids = stash(ids)
    alone = ids.select("group", "p", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(1).alias("n"), "low", "words")
    treed = _trees(alone, "group", window).select("p", F.col("spans")[0]["low"].alias("least"))
    by_tree = ids.select("p", "x").join(treed, "p").select("x.*", "least")
    rest = known.filter("group is null")
    least = stash(rest.groupBy("words").agg(F.min("low").alias("least")))
    by_window = rest.join(least, "words").select(*_KEYS, "j", "least")
    parts = by_tree.unionByName(by_window).groupBy(*_KEYS).agg(F.collect_list(F.struct(F.col("j").alias("a"), F.col("j").alias("b"), F.col("least").alias("low"))).alias("spans"))
    return parts.select(*_KEYS, F.col("spans").cast(_SPANS).alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, lead: int = LEAD, group_runs: int = GROUP_RUNS, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept string)`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if it is in a window of ``window`` words that
    also starts in a document with a smaller doc_id; windows are judged on the input.
    ``kept`` has the other words, joined by one space.

    A null text has no words; texts with fewer words than a window stay whole; repeats within
    one document, and between rows with the same doc_id, stay; a null doc_id counts as larger
    than any other; other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), tk.row_key("doc_id", "text").alias("rid"), "text")
    runs = stash(_runs(keyed, window, lead))
    shared = stash(runs.groupBy("p").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("p"))
    met = stash(runs.join(shared, "p"))
    discard(runs)
    distinct = stash(met.groupBy(*_KEYS).agg(F.min(F.struct("doc", "rid", F.col("at")[0].alias("at"))).alias("first")).select(*_KEYS, "first.*"))
    sizes = stash(distinct.groupBy("p").agg(F.count("*").alias("many")))
    sized = distinct.join(sizes, "p")
    # A group of one run needs no tree: all its windows are first met in the same document.
    alone = sized.filter("many = 1").select(*_KEYS, F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"), F.col("doc").alias("low"))).cast(_SPANS).alias("spans"))
    contents = stash(_contents(keyed, sized.filter("many > 1"), window).join(sizes, "p"))
    found = alone.unionByName(_trees(contents.filter(F.col("many") <= group_runs), "p", window))
    large = contents.filter(F.col("many") > group_runs)
    if not large.isEmpty():
        found = found.unionByName(_parted(large, window, lead, group_suffixes))
    found = stash(found)
    discard(contents)
    earlier = F.filter("spans", lambda s: s["low"] < F.col("doc"))
    covered = met.join(found, _KEYS).withColumn("spans", earlier).filter(F.size("spans") > 0)
    covered = covered.select("doc", "rid", F.flatten(F.transform("at", lambda w: F.transform("spans", lambda s: F.struct((w + s["a"]).alias("a"), (w + s["b"] + window).alias("b"))))).alias("cover"))
    covers = covered.groupBy("doc", "rid").agg(F.flatten(F.collect_list("cover")).alias("cover"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in tk.chunks(batch.column(1)):
                out: list[tuple] = []
                for text, cover in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    edge = np.zeros(len(words) + 1, np.int32)
                    for c in cover or ():
                        edge[c["a"]] += 1
                        edge[c["b"]] -= 1
                    keep = np.cumsum(edge[:-1]) <= 0
                    kept = [words[i] for i in np.flatnonzero(keep)] if cover else words
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(covers, ["doc", "rid"], "left").select("doc_id", "text", "cover")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
