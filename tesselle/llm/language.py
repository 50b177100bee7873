"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree, learned once and then frozen.  A byte's
probability comes from the longest context that the tree holds: seen there, its share of the
counts; not seen, the escape probability (method C: as many escapes as distinct successors)
times what the next shorter context gives, among the bytes the longer one hasn't seen.  The
code length of a text is the exact sum of -log2 of these, and the shortest code wins.

Because statistics are frozen, the code length of every byte after every held context is a
table, shared by all languages; scoring a text is two array look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.llm.labelled import group_sizes, held_out, sample

ORDER = 3
#: The trees are learned from at most about this many texts a language, each of at most so many bytes.
SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 20_000
#: Contexts of two or more bytes are held if they occur this often in a language's sample.
LEAST = 24
#: So many languages are learned together; each one's code lengths are the same whichever they are.
TOGETHER = 16
_LETTER = tk.lut([*range(65, 91), *range(97, 123)])
_START = 32  # what stands before a text's first byte


@dataclass
class ContextTrees:
    """The trees of all languages over one set of contexts.

    ``symbol``: byte -> number of its class (all bytes that no sample has are the last one);
    ``node``: three preceding classes -> the longest held context; ``bits``: node x class x
    language, the code length.
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray

    @classmethod
    def learn(cls, samples: dict[str, list[bytes]]) -> ContextTrees:
        languages = sorted(samples)
        joined = {k: np.frombuffer(b"".join(bytes([_START] * ORDER) + t for t in samples[k]), np.uint8) for k in languages}
        seen = np.zeros(256, bool)
        seen[_START] = True
        for data in joined.values():
            seen[np.unique(data)] = True
        size = int(seen.sum()) + 1
        symbol = np.full(256, size - 1, np.uint8 if size <= 256 else np.int16)
        symbol[seen] = np.arange(size - 1)
        unseen_bytes = max(1, 256 - (size - 1))
        coded = {k: symbol[v].astype(np.int64) for k, v in joined.items()}

        def counts(order: int) -> list[tuple[np.ndarray, np.ndarray]]:
            """For each language the (context * size + successor) that occur, and how often."""
            out = []
            for k in languages:
                key = np.zeros(max(0, len(coded[k]) - order), np.int64)
                for j in range(order + 1):
                    key = key * size + coded[k][j : j + len(key)]
                out.append(np.unique(key, return_counts=True))
            return out

        # A class that stands for several unseen bytes splits its probability among them.
        share = np.ones(size)
        share[-1] = unseen_bytes
        rows: list[np.ndarray] = []  # probability of each class, by language: (size, languages)
        held: list[dict[int, int]] = []  # context -> row, for each order
        for order in range(ORDER + 1):
            per = counts(order)
            contexts: set[int] = set()
            for key, n in per:
                total = np.bincount(np.searchsorted(u := np.unique(key // size), key // size), weights=n) if len(key) else np.zeros(0)
                contexts.update((u[total >= (LEAST if order > 1 else 1)] if len(key) else key).tolist())
            wanted = np.array(sorted(contexts), np.int64) if order else np.zeros(1, np.int64)
            table = np.zeros((len(wanted), size, len(languages)))
            for k, (key, n) in enumerate(per):
                at = np.searchsorted(wanted, key // size)
                keep = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == key // size) if len(wanted) else np.zeros(len(key), bool)
                table[at[keep], key[keep] % size, k] = n[keep]
            if order > 1:  # another language's context is none of this one's if it's too rare here
                table[np.broadcast_to(table.sum(1, keepdims=True) < LEAST, table.shape)] = 0
            if order:
                # The context one byte shorter, or the longest held one after that.
                shorter = np.array([_longest(held, c % size ** (order - 1), order - 1, size) for c in wanted.tolist()], np.int64)
                low = np.concatenate(rows)[shorter]
            else:
                low = np.broadcast_to((share / 256)[None, :, None], table.shape)
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            fresh = np.where(table > 0, 0, low)
            room = fresh.sum(1, keepdims=True)
            escape = np.where(room > 0, kinds / np.maximum(total + kinds, 1), 0)
            p = np.where(table > 0, table / np.maximum(total, 1) * (1 - escape), escape * fresh / np.where(room > 0, room, 1))
            base = sum(len(r) for r in rows)
            rows.append(np.where(total > 0, p, low))
            held.append({c: base + i for i, c in enumerate(wanted.tolist())})
        p = np.concatenate(rows)
        bits = -np.log2(np.maximum(p / share[None, :, None], 1e-12)).astype(np.float32)
        node = np.zeros(size**ORDER, np.int32)
        for order in range(1, ORDER + 1):
            grid = node.reshape(-1, size**order)
            for c, row in held[order].items():
                grid[:, c] = row
        return cls(languages, symbol, node, np.ascontiguousarray(bits))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every text (rows) in every language (columns)."""
        size = self.bits.shape[1]
        # Every text is preceded by the start context, as in learning.
        n = len(offsets) - 1
        spaced = np.full(len(data) + ORDER * n, self.symbol[_START], np.int32)
        own = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
        spaced[own] = self.symbol[data]
        context = np.zeros(len(spaced) - ORDER if n else 0, np.int32)
        for j in range(ORDER):
            context = context * np.int32(size) + spaced[j : j + len(context)]
        node = self.node[context[own - ORDER]].astype(np.int64)
        flat = self.bits.reshape(-1, self.bits.shape[2])
        cost = flat[node * size + spaced[own]].astype(np.float64)
        out = np.zeros((len(data) + 1, cost.shape[1]))
        np.cumsum(cost, axis=0, out=out[1:])
        return out[offsets[1:]] - out[offsets[:-1]]


def _longest(held: list[dict[int, int]], context: int, order: int, size: int) -> int:
    while order and context not in held[order]:
        order -= 1
        context %= size**order
    return held[order][context if order else 0]


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, max_bytes: int = SAMPLE_BYTES) -> list[ContextTrees]:
    """Trees of all languages, TOGETHER in each, from bounded samples of the labelled rows that aren't held out.

    The driver holds at most 2 * ``texts`` texts of TOGETHER languages at a time, each of at most
    ``max_bytes`` bytes (chosen by a hash of doc_id).  Languages are those with a non-null ``lang``.
    """
    known = docs.filter(~held_out()).select("doc_id", F.col("lang").alias("group"))
    sizes = group_sizes(known)
    out = []
    for at in range(0, len(sizes), TOGETHER):
        samples: dict[str, list[bytes]] = {}
        for lang, text in sample(docs, known, sizes[at : at + TOGETHER], texts, max_bytes):
            samples.setdefault(lang, []).append(text.encode())
        if samples:
            out.append(ContextTrees.learn(samples))
    return out


def identify(docs: DataFrame, unknown: str = "und") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, n_bits)`` for every row of ``docs``.

    ``score`` is the share of the best language if code lengths are taken as log
    probabilities; ``n_bits`` its code length.  A null text, and one without any letter
    (Unicode's categories of letters; numerals and symbols are none), is ``und`` with score 0
    (as is every text if nothing could be learned); of languages with equal code lengths the
    first by name wins.  Whole texts are scored; repeated rows each get a row; a null doc_id is
    kept; other columns are ignored; an empty table gives none.
    """
    trees = learn(docs)
    languages = np.array([x for t in trees for x in t.languages] or [unknown], object)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    names = ["doc_id", "held_out", "lang_pred", "score", "n_bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(2), tk.CHUNK_BYTES // 2):
                letters = tk.per_row(_LETTER[data], offsets) > 0
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                if not models:
                    bits, best, score = np.zeros((b - a, 1)), np.zeros(b - a, int), np.zeros(b - a)
                    letters[:] = False
                else:
                    bits = np.concatenate([m.lengths(data, offsets) for m in models], axis=1)
                    best = bits.argmin(1)
                    least = bits[np.arange(b - a), best]
                    score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                pred = np.where(letters, languages[best], unknown)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(bits[np.arange(b - a), best])],
                    names=names,
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, n_bits double")
