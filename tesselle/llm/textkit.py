"""Vectorised byte-level text handling that the operators share.

A batch of texts is one byte buffer plus row offsets (Arrow's own layout).  Work goes over
:func:`chunks` of about a quarter megabyte, cut between rows, so memory follows the longest single
text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of one step together hold at most this many bytes (a longer text is a step alone).
CHUNK_BYTES = 1 << 18

#: The field of the span hashes, and two points of it (the first digits of pi and e).
_P = np.uint64((1 << 61) - 1)
_POINTS = {0: 0x243F6A8885A308D3 % ((1 << 61) - 1), 1: 0xB7E151628AED2A6A % ((1 << 61) - 1)}
_LOW, _HALF = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
_ODD = 0x9E3779B97F4A7C15
_ROLLING: list[tuple[np.ndarray, np.ndarray]] = []


def lut(members: bytes | range) -> np.ndarray:
    """A 256-entry table that is true at the given bytes."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Space and \t \n \v \f \r: what separates words where a contract says ``[^\x20\x09-\x0D]+``.
SPACES = lut(b" \t\n\x0b\x0c\r")
#: All ASCII that is no digit and no lower-case letter (after A-Z are lower-cased).
NON_ALNUM = lut([b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)])
#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER_LUT = np.frombuffer(LOWER, np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER_LUT[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null row is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets from 0)`` in steps of about ``limit`` bytes."""
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n, row + 20_000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators, and the first run of each row.

    Runs end at row ends too.  The third array has one entry more than there are rows.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _kept(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values as members of the field."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """Members of the field times 2**31."""
    return (x >> np.uint64(30)) + ((x & _HALF) << np.uint64(31))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, from 31-bit halves."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    return _kept(np.uint64(2) * a1 * b1 + _shifted(a1 * b0 + a0 * b1) + a0 * b0)


def _run_of_powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, np.full(len(out), pow(factor, len(out), int(_P)), np.uint64))])
    return out[:n]


def _powers(point: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low and high halves of the powers of a point, and the powers of its inverse."""
    got = _POWERS.get(point)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        up, down = (_run_of_powers(f, size) for f in (_POINTS[point], pow(_POINTS[point], -1, int(_P))))
        got = ((up & _LOW).astype(np.uint32), (up >> np.uint64(31)).astype(np.uint32), down)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[point] = got
    return got


def _sums(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every span, from running sums.

    The span is a polynomial over the field of 2**61 - 1 at a fixed point, so two different
    sequences of length n agree at no more than n of all points, whatever pattern they have.
    Equal sequences have equal hashes wherever they stand in whichever buffer.  Bytes are
    taken as they are, wider values after a scramble.
    """
    low, high, down = _powers(base, len(values) + 1)
    low, high = low[: len(values)], high[: len(values)]
    v = values.astype(np.uint64) + np.uint64(1)
    if values.dtype == np.uint8 and not len(values) >> 24:  # no sum can overflow
        small, large = _sums(v * low), _sums(v * high)
    else:
        powers = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(31)
        terms = _times(v if values.dtype == np.uint8 else _kept(mixed(v)), powers)
        small, large = _sums(terms & _LOW), _sums(terms >> np.uint64(31))
    raw = _kept(_shifted(_kept(large[ends] - large[starts])) + _kept(small[ends] - small[starts]))
    return mixed(_times(raw, down[starts]) ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and scale of a cheap rolling key: ``(sums[b] - sums[a]) * scale[a]`` for ``values[a:b]``.

    Equal sequences have equal keys, but unequal ones can be made to agree: for candidates that
    are compared afterwards.
    """
    n = len(values) + 1
    if not _ROLLING or len(_ROLLING[0][0]) < n:
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(max(n, CHUNK_BYTES + 1024), f, np.uint64))) for f in (_ODD, pow(_ODD, -1, 1 << 64)))
        if n > 4 * CHUNK_BYTES:
            return _sums((values.astype(np.uint64) + np.uint64(1)) * up[: n - 1]), down
        _ROLLING[:] = [(up, down)]
    up, down = _ROLLING[0]
    return _sums((values.astype(np.uint64) + np.uint64(1)) * up[: n - 1]), down


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a BLAKE2 digest of every ``raw[start:end]``: what decides that texts are equal."""
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(made, "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def row_key(*columns: str) -> Column:
    """60 bits of a SHA-1 over columns: tells rows with equal ids and different texts apart."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.sha1(F.concat_ws("\x01", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every run, from the third result of :func:`spans`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's bytes the mask marks."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """How many distinct values each row has."""
    if not len(hashes):
        return np.zeros(n_rows, np.int64)
    key = mixed(hashes ^ mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount(rows[order[fresh]], minlength=n_rows)
