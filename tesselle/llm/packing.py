"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

A piece is one of at most ``capacity`` lengths, so what best-fit decreasing does to the whole
corpus depends only on how many pieces there are of each length.  That histogram (at most
``capacity`` numbers, however large the corpus) is packed on the driver: a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and equal bins and
equal pieces are handled as ranges.  The plan says where the r-th piece of each length goes;
pieces find their r by counts per partition, without gathering a length anywhere.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.scratch import stash

CAPACITY = 2048
END_ID = 0
#: What byte-level BPE splits on before merging (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


# ---------------------------------------------------------------- tokens


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def load_vocabulary(path: str) -> dict:
    """Ranks and special tokens of a byte-level BPE ``tokenizer.json``; fits a small broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    letters = _byte_letters()
    simple = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    words = {t: i for t, i in model["vocab"].items() if t not in special}
    if not simple or any(c not in letters for t in words for c in t):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    return {"ranks": {bytes(letters[c] for c in t): i for t, i in words.items()}, "special": special}


#: Runs of this many blanks are cut out before the splitting pattern runs, whose look-ahead recurses over them.
LONG_BLANK = 1000
#: White space in Unicode's sense, as the pattern has it (a fixed value).
_BLANKS = "[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def encoder(vocabulary: dict) -> Callable[[str], list[int]]:
    """``text -> ids``, the ids that the vocabulary's own library gives.

    The splitting pattern makes all of a run of blanks but its last character one piece (all of
    it at a text's or special token's edge).  A very long run is taken out as that piece here.
    """
    import tiktoken

    made = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=vocabulary["ranks"], special_tokens=vocabulary["special"])
    long = re.compile(_BLANKS + "{%d,}" % LONG_BLANK)
    special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary["special"], key=len, reverse=True))) + ")") if vocabulary["special"] else None
    whole = lambda text: made.encode(text, allowed_special="all")

    def between(text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out, done = [], 0
        for run in long.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += made.encode_ordinary(text[done : run.start()])
            out += made._encode_single_piece(text[run.start() : end])
            done = end
        return out + made.encode_ordinary(text[done:])

    def encode(text: str) -> list[int]:
        if len(text) < LONG_BLANK or not long.search(text):
            return whole(text)
        parts = special.split(text) if special else [text]
        return [i for k, part in enumerate(parts) for i in (whole(part) if k % 2 else between(part))]

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full, but for a shorter first one."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``(doc_id, piece, start, length, ids_crc32, part, k[, ids])``.

    A document is its ids and ``END_ID``.  ``k`` numbers the pieces of one length within the
    partition ``part``; a lost task that runs again numbers them alike.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(vocabulary_path) or _ENCODERS.setdefault(vocabulary_path, encoder(vocabulary.value))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, _, _ in tk.chunks(batch.column(1)):
                rows: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids = encode(text or "")
                    ids.append(END_ID)
                    raw = np.array(ids, "<u4").tobytes()
                    for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                        got = raw[4 * start : 4 * (start + length)]
                        row = [doc_id, piece, start, length, zlib.crc32(got), part, int(seen[length])]
                        seen[length] += 1
                        for column, value in zip(rows, [*row, np.frombuffer(got, "<i4")] if with_ids else row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=names)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, k bigint"
    return docs.select("doc_id", "text").mapInArrow(run, kinds + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- the plan


class CapacityTree:
    """A segment tree over remaining capacities: which are open, and the least that fits."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << (top + 1).bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            now = self.open[2 * i] | self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least ``need``."""
        i = need + self.leaves
        while not self.open[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass
class Plan:
    """Ranges of pieces: those of ``length`` with rank from ``first`` go ``per`` to a bin from ``bin`` on, beginning at ``offset``."""

    key: np.ndarray  # length << 40 | first, ascending
    first: np.ndarray
    per: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 40) | rank, "right") - 1
        j = rank - self.first[i]
        return self.bin[i] + j // self.per[i], self.offset[i] + j % self.per[i] * length


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Exactly what best-fit decreasing does piece by piece, in steps over equal pieces and bins.

    A piece goes to the open bin with the least room that holds it.  That bin stays the
    tightest for the next piece of the same length until it's too full, so a bin of room c
    takes c // length of them before the next bin of room c is begun.
    """
    tree, ranges = CapacityTree(capacity), [[] for _ in range(capacity + 1)]  # ranges[c]: (first bin, bins) with room c
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first_bin: int, count: int) -> None:
        if room and count:
            if not ranges[room]:
                tree.set(room, True)
            ranges[room].append((first_bin, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first_bin, count = bins, -(-left // per)
                bins += count
            else:
                per = room // length
                first_bin, count = ranges[room].pop()
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            used = full + (rest > 0)
            rows.append((length, rank, per, first_bin, capacity - room))
            put(room - per * length, first_bin, full)
            put(room - rest * length, first_bin + full, int(rest > 0))
            if room != capacity:  # a range of open bins: what wasn't used stays
                if used < count:
                    ranges[room].append((first_bin + used, count - used))
                if not ranges[room]:
                    tree.set(room, False)
            rank += full * per + rest
            left -= full * per + rest
    rows.sort()
    length, first, per, bin_, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    return Plan((length << 40) | first, first, per, bin_, offset, bins)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])`` for every piece.

    Null and empty texts are the one id ``END_ID``; special tokens that occur in a text are
    those tokens; repeated rows are packed each; a null doc_id is kept; other columns are
    ignored; an empty table gives no pieces.  Documents over ``capacity`` tokens are cut;
    no other is.
    """
    rows = stash(pieces(docs, vocabulary_path, capacity, with_ids))
    counts = stash(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(histogram, capacity))
    # A row for each partition and length: it grows with the corpus, so it's never broadcast.
    base = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    ranked = rows.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"), *["ids"] * with_ids)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(np.asarray(batch.column(3)), np.asarray(batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names=names)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, kinds + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids array<int>)``: the packed sequences themselves, from ``pack(..., with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
