"""Toxicity by compression distance with two Zstandard dictionaries.

Texts are first rewritten as fixed-width word codes (a hash of the word's beginning and one
of the whole word, after A-Z are lower-cased), so that what a compressor finds in a
dictionary is a word or its beginning and not a chance run of letters.  One dictionary is trained on
ordinary text, one on what is characteristic of toxic text; the second compressor has both.
A window that the second compresses to fewer bytes holds toxic wording, and a text's savings
are turned into a probability by thresholds that are calibrated on other labelled rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.llm.labelled import group_sizes, held_out, one_label, sample

#: Words of a window, bytes of a word that its beginning has, bytes of a word code, and of those the beginning's.
WINDOW, STEM, CODE, STEM_CODE = 16, 5, 8, 6
#: The model learns from about this many texts of each label, of at most so many bytes each.
SAMPLE_TEXTS, SAMPLE_BYTES = 3000, 40_000
ORDINARY_DICTIONARY, TOXIC_DICTIONARY = 32_768, 16_384
#: A beginning of a word is characteristic if toxic texts have it in so many surroundings, and so many times as often.
LEAST_SURROUNDINGS, LEAST_RATIO = 5, 25.0
#: Stands before every window and in both dictionaries, so that both lengths are of compressed
#: blocks: a short block without any match would be stored as it is, whatever the dictionary.
LEAD = hashlib.sha512(b"lead").digest() + hashlib.sha512(b"in").digest()


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The word codes of all rows on end, and the first word of each row."""
    data = tk.lowered(data)
    starts, ends, first = tk.spans(data, offsets, tk.NON_ALNUM)
    bits = np.uint64(8 * STEM_CODE)
    stem = tk.span_hashes(data, starts, np.minimum(ends, starts + STEM)) & np.uint64((1 << 8 * STEM_CODE) - 1)
    return (stem | tk.span_hashes(data, starts, ends, 1) << bits).astype("<u8").tobytes(), first


def _codes(text: str) -> list[bytes]:
    raw = text.encode()
    got, first = coded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [got[CODE * i : CODE * (i + 1)] for i in range(int(first[-1]))]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=9, min_match=6, target_length=256, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


class Savings:
    """What the toxic dictionary saves on each row: all bytes saved, the most in a window, windows."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.both = _compressor(ordinary), _compressor(ordinary + toxic)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, first = coded(data, offsets)
        out = np.zeros((len(offsets) - 1, 3))
        plain, both, step, at = self.plain.compress, self.both.compress, WINDOW * CODE, (first * CODE).tolist()
        for row, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            total = most = 0
            for i in range(a, b, step):
                window = LEAD + codes[i : min(i + step, b)]
                saved = len(plain(window)) - len(both(window))
                if saved > 0:
                    total += saved
                    most = max(most, saved)
            out[row] = total, most, -(-(b - a) // step)
        return out


def _inputs(savings: np.ndarray) -> np.ndarray:
    total, most, windows = savings.T
    return np.stack([np.ones(len(savings)), np.minimum(total, 24) / 8, np.minimum(most, 8) / 4, np.log1p(windows) / 4], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _surroundings(texts: list[list[bytes]]) -> dict[bytes, int]:
    """In how many different surroundings (word before, word after) each beginning of a word stands."""
    seen = defaultdict(set)
    for words in texts:
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            seen[word[:STEM_CODE]].add((before, after))
    return {k: len(v) for k, v in seen.items()}


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=CODE).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: all of it
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    @classmethod
    def train(cls, ordinary: list[str], toxic: list[str]) -> Model:
        """The two dictionaries."""
        learnt = {0: [_codes(t) for t in ordinary], 1: [_codes(t) for t in toxic]}
        count = {k: _surroundings(v) for k, v in learnt.items()}
        size = {k: max(1, sum(map(len, v))) for k, v in learnt.items()}
        ratio = lambda w: (count[1][w] + 0.5) / size[1] / ((count[0].get(w, 0) + 0.5) / size[0])
        marked = {w for w, n in count[1].items() if n >= LEAST_SURROUNDINGS and ratio(w) >= LEAST_RATIO}
        windows = sorted({b"".join(t[i : i + WINDOW]) for t in learnt[0] for i in range(0, len(t), WINDOW)}, key=lambda w: hashlib.md5(w).digest())
        found = [b"".join(x) for t in learnt[1] if (x := [w for w in t if w[:STEM_CODE] in marked])]
        return cls(_dictionary(windows[:60_000], ORDINARY_DICTIONARY, 16), _dictionary(found * 3, TOXIC_DICTIONARY, 32) if found else b"", np.zeros(4))

    @classmethod
    def learn(cls, samples: list[tuple[int, str]]) -> Model | None:
        """Thresholds from a quarter of the texts and dictionaries of the rest; then dictionaries of all."""
        texts = {k: sorted({t for y, t in samples if y == k}, key=lambda t: hashlib.md5(t.encode()).digest()) for k in (0, 1)}
        if min(len(v) for v in texts.values()) < 8:
            return None
        cut = {k: len(v) * 3 // 4 for k, v in texts.items()}
        trial = cls.train(*(texts[k][: cut[k]] for k in (0, 1)))
        savings = Savings(trial.ordinary, trial.toxic)
        x, y = [], []
        for k, v in texts.items():
            for t in v[cut[k] :]:
                raw = t.encode()
                x.append(savings.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
                y.append(k)
        model = cls.train(texts[0], texts[1])
        # The odds are those of the sample, which has at most about as many ordinary as toxic texts.
        model.weights = _logistic(_inputs(np.array(x)), np.array(y, float))
        return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, saved_bytes)`` for every row of ``docs``.

    Learns from a bounded sample (about ``texts`` of each label, of at most SAMPLE_BYTES
    bytes) of the labelled rows that aren't held out; with under eight texts of a label every
    score is 0.  Whole texts are scored.  A null or wordless text saves nothing and has the
    score of that; equal texts have equal scores; repeated rows each get a row; a null doc_id
    is scored; other columns are ignored; an empty table gives no rows.
    """
    known = one_label(labels, "toxic").filter(~held_out()).select("doc_id", F.col("y").alias("group"))
    sent = docs.sparkSession.sparkContext.broadcast(Model.learn(sample(docs, known, group_sizes(known), texts, SAMPLE_BYTES)))
    names = ["doc_id", "held_out", "score", "predicted", "saved_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        savings = Savings(model.ordinary, model.toxic) if model else None
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(2)):
                got = savings.of(data, offsets) if model else np.zeros((b - a, 3))
                p = 1 / (1 + np.exp(-np.clip(_inputs(got) @ model.weights, -30, 30))) if model else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(got[:, 0].astype(np.int64))], names=names
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, saved_bytes bigint")
