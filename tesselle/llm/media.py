"""Media columns: bytes kept as lossless WebP images, read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselle.llm import textkit as tk
from tesselle.llm import webp
from tesselle.scratch import stash

#: Samples in an image row, and rows of one image; a longer payload is several images on end.
WIDTH, ROWS = 192, 2048
_GREY = np.uint32(0x00010101)


def payload_of(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of the row width."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


#: log2 of the side of a predictor block, and how much of the bits a predictor must leave at most.
BLOCK_BITS, WORTH = 9, 0.8
#: Predictors that are tried: black (a pixel stays as it is), left and top (fixed values of the format).
MODES = (0, 1, 2)


def bits_of(samples: np.ndarray) -> float:
    """What an ideal prefix code would take for the samples."""
    n = np.bincount(samples, minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(samples) / n)).sum())


def predictors(samples: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The block image of the cheapest predictor of each block of rows (of WIDTH samples), or None if none pays."""
    rows = samples.reshape(-1, WIDTH)
    left, top = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    top[1:] -= rows[:-1]
    chosen = []
    for at in range(0, len(rows), 1 << BLOCK_BITS):
        cost = [bits_of(x[at : at + (1 << BLOCK_BITS)].ravel()) for x in (rows, left, top)]
        best = int(np.argmin(cost))
        chosen.append(MODES[best] if cost[best] <= WORTH * cost[0] else 0)
    if not any(chosen):
        return None
    return (np.uint32(webp.BLACK) | np.array(chosen, np.uint32) << np.uint32(8))[:, None], BLOCK_BITS


def to_media(payload: bytes) -> bytes:
    """The payload as grey lossless WebP images, one byte a sample.

    An image of few values is stored by palette, others with green subtracted, and with a predictor
    where one would save a fifth of the bits.  Copies may begin where a run of letters begins, so repeated
    words and lines cost little.  A colour cache, cross-colour and several code groups never
    pay for one grey channel, so the stored form has none of them.
    """
    out = []
    for at in range(0, len(payload), WIDTH * ROWS):
        samples = np.frombuffer(payload[at : at + WIDTH * ROWS], np.uint8)
        pixels = np.uint32(webp.BLACK) | samples.astype(np.uint32) * _GREY
        few = np.count_nonzero(np.bincount(samples, minlength=256)) <= 16
        starts = np.flatnonzero(samples[:-1] <= 32) + 1
        out.append(webp.encode(pixels.reshape(-1, WIDTH), palette=few, green=not few, predictor=None if few else predictors(samples), copy_starts=None if few else starts))
    return b"".join(out)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of the images that stand one after another."""
    at = 0
    while at < len(media):
        end = at + webp.frame_length(media, at)
        yield webp.decode(media[at:end])
        at = end


def from_media(media: bytes) -> bytes:
    return b"".join((pixels & np.uint32(255)).astype(np.uint8).tobytes() for pixels in images(media))


def describe(payload: bytes) -> str:
    """Sides, mean, deviation and a 64-bit hash: which of 64 equal sections are brighter than the mean."""
    v = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(v), 65).astype(np.int64)
    sums = np.zeros(len(v) + 1, np.int64)
    np.cumsum(v, out=sums[1:])
    mean = sums[-1] / len(v)
    bright = np.diff(sums[edges]) > mean * np.diff(edges)
    return f"{WIDTH}x{len(v) // WIDTH} mean={mean:.3f} std={v.std():.3f} hash={np.packbits(bright).tobytes().hex()}"


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media binary)``: every text as images; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                media = [to_media(payload_of(raw[i:j])) for i, j in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read(stored: DataFrame) -> DataFrame:
    """Digests and features of what the stored images decode to."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                payload = from_media(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def pixels(stored: DataFrame) -> DataFrame:
    """``(doc_id, image int, width int, height int, argb array<int>)``: the decoded pixel arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, image in enumerate(images(media.as_py() or b"")):
                    flat = pa.array([image.ravel().view(np.int32)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.array([x], pa.int32()) for x in (k, image.shape[1], image.shape[0])), flat], names=["doc_id", "image", "width", "height", "argb"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id bigint, image int, width int, height int, argb array<int>")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text in the scratch folder as images, read them back and describe them.

    One row for each row of ``docs``; a null or empty text is one row of spaces; equal texts
    give equal values; a null doc_id is kept; other columns are ignored; an empty table gives
    no rows.  Memory follows the longest text: an image has at most ROWS rows.
    """
    return read(stash(store(docs)))
