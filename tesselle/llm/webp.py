"""Lossless WebP (VP8L): a decoder for the whole format and an encoder that can use all of it.

The decoder reads the prefix codes of a stream at EVERY bit position of a stretch at once
(array lookups), which turns decoding into following a chain of "next position" links; only
back-references, colour-cache hits and images with several prefix-code groups are handled
symbol by symbol.  Transforms are inverted on whole arrays; the predictor along the wavefront
x + 2y, on which pixels don't depend on each other.

Pixels are uint32 ARGB arrays of shape (height, width).
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
MAX_CODE, MAX_LENGTH_CODE, MAX_COPY = 15, 7, 4096

#: Near pixels in the order of distance codes 1 to 120: by distance, then |x|, then right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

#: Bit positions that are looked at in one step of the decoder.
STRETCH = 1 << 17


class BadImage(ValueError):
    """A stream that breaks the format."""


# ---------------------------------------------------------------- bits


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data = data + b"\0" * 16
        self.end = len(data) * 8
        self.at = 0

    def peek(self) -> int:
        """At least 57 bits from here (zeros after the end)."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise BadImage("the stream ends early")

    def symbol(self, code: Code) -> int:
        entry = int(code.table[self.peek() & code.mask])
        self.skip(entry & 15)
        return entry >> 4


class BitWriter:
    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.widths: list[int] = []

    def put(self, value: int, width: int) -> None:
        self.values.append(value)
        self.widths.append(width)

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.parts.append((np.array(self.values, np.uint32), np.array(self.widths, np.uint8)))
        self.parts.append((values, widths))
        self.values, self.widths = [], []

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0, np.uint32), np.zeros(0, np.uint8))
        values, widths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(widths, dtype=np.uint32)
        # Shifting a value by (place - first place) leaves the bit of each place lowest.
        shift = np.arange(ends[-1], dtype=np.uint32) - np.repeat(ends - widths, widths)
        bits = np.repeat(values, widths) >> shift
        return np.packbits((bits & np.uint32(1)).astype(bool), bitorder="little").tobytes()


# ---------------------------------------------------------------- prefix codes


@dataclass
class Code:
    """A lookup table over the next bits: symbol << 4 | bits used."""

    table: np.ndarray
    mask: int
    width: int

    @property
    def lone(self) -> int | None:
        """The symbol of a code that takes no bits."""
        return int(self.table[0]) >> 4 if self.width == 0 else None


_REVERSED = np.zeros(1 << MAX_CODE, np.uint16)
for _k in range(MAX_CODE):
    _REVERSED |= ((np.arange(1 << MAX_CODE) >> _k & 1) << (MAX_CODE - 1 - _k)).astype(np.uint16)


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in canonical order, how many of the longest codes each stands for, the longest."""
    used = np.flatnonzero(lengths)
    symbols = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[symbols[-1]])
    weight = 1 << (width - lengths[symbols].astype(np.int64))
    if weight.sum() != 1 << width:
        raise BadImage("a prefix code that doesn't fill its tree")
    return symbols, weight, width


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The bits of every symbol, first read bit lowest."""
    symbols, weight, _ = _in_order(lengths)
    out = np.zeros(len(lengths), np.uint32)
    own = lengths[symbols].astype(np.int64)
    out[symbols] = _REVERSED[(np.cumsum(weight) - weight) // weight] >> (MAX_CODE - own)
    return out


def make_code(lengths: np.ndarray) -> Code:
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return Code(np.array([(int(used[0]) if len(used) else 0) << 4], np.int32), 0, 0)
    symbols, weight, width = _in_order(lengths)
    entries = (symbols << 4 | lengths[symbols]).astype(np.int32)
    table = np.repeat(entries, weight)[_REVERSED[: 1 << width] >> (MAX_CODE - width)]
    return Code(table, (1 << width) - 1, width)


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.uint8)
    if r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)] + ([r.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise BadImage("a symbol outside its alphabet")
        lengths[symbols] = 1
        return make_code(lengths)
    first = np.zeros(19, np.uint8)
    for k in LENGTH_ORDER[: 4 + r.read(4)]:
        first[k] = r.read(3)
    outer = make_code(first)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = r.symbol(outer)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        value, times = (last, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3)) if s == 17 else (0, 11 + r.read(7))
        if at + times > alphabet:
            raise BadImage("too many code lengths")
        lengths[at : at + times] = value
        at += times
    return make_code(lengths)


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths of at most ``longest`` bits; counts are levelled until they fit."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while True:
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        tie = len(used)
        parents: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parents[tie] = (i, j)
            heapq.heappush(heap, (a + b, tie))
            tie += 1
        level = {heap[0][1]: 0}
        for node in range(tie - 1, len(used) - 1, -1):
            for child in parents[node]:
                level[child] = level[node] + 1
        depth = [level[i] for i in range(len(used))]
        if max(depth) <= longest:
            lengths[used] = depth
            return lengths
        weights = (weights + 1) // 2 + 1


def write_lone(w: BitWriter, symbol: int) -> None:
    """A code of one symbol (under 256), which then takes no bits."""
    w.put(1, 1)
    w.put(0, 1)
    w.put(int(symbol > 1), 1)
    w.put(symbol, 8 if symbol > 1 else 1)


def write_code(w: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for these symbol counts; the bits and lengths to write symbols with."""
    used = np.flatnonzero(counts).tolist()
    zero = np.zeros(len(counts), np.uint32)
    if len(used) <= 2 and (not used or used[-1] < 256):
        lengths = np.zeros(len(counts), np.uint8)
        if len(used) < 2:
            write_lone(w, used[0] if used else 0)
            return zero, lengths
        w.put(1, 1)
        w.put(1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        w.put(used[1], 8)
        lengths[used] = 1
        zero[used[1]] = 1
        return zero, lengths
    lengths = code_lengths(counts, MAX_CODE)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, width of extra
    at, last, stop = 0, 8, used[-1] + 1
    plain = lengths.tolist()
    while at < stop:
        run = at
        while run < stop and plain[run] == plain[at]:
            run += 1
        n, value = run - at, plain[at]
        if value == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif value and value == last and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((value, 0, 0))
            last = value or last
        at += n
    outer = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), MAX_LENGTH_CODE)
    w.put(0, 1)
    n = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if outer[s])])
    w.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.put(int(outer[s]), 3)
    w.put(1, 1)
    need = max(2, len(tokens)) - 2
    width = max(2, need.bit_length() + (need.bit_length() & 1))
    w.put((width - 2) // 2, 3)
    w.put(need, width)
    outer_bits = _canonical(outer) if (outer > 0).sum() > 1 else np.zeros(19, np.uint32)
    outer_width = outer if (outer > 0).sum() > 1 else np.zeros(19, np.uint8)
    for s, extra, width in tokens:
        w.put(int(outer_bits[s]), int(outer_width[s]))
        w.put(extra, width)
    for _ in range(max(2, len(tokens)) - len(tokens)):
        w.put(int(outer_bits[0]), int(outer_width[0]))
    return (_canonical(lengths), lengths) if len(used) > 1 else (zero, np.zeros(len(counts), np.uint8))


def value_code(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number for a copy length or distance code (from 1)."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    width = top - 1
    return 2 * top + (v >> width & 1), v & ((1 << width) - 1), width


def _read_value(r: BitReader, code: int) -> int:
    if code < 4:
        return code + 1
    width = (code - 2) >> 1
    return ((2 + (code & 1)) << width) + r.read(width) + 1


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """The distance code of each distance that a near pixel has in an image of this width."""
    return {plane_distance(k + 1, width): k + 1 for k in reversed(range(len(NEAR)))}


def plane_distance(code: int, width: int) -> int:
    """How many pixels back a distance code means in an image of this width."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# ---------------------------------------------------------------- entropy-coded images


class _Cache:
    """The colour cache: the last pixel of every hash, brought up to date when it's asked."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.colours = np.zeros(1 << bits if bits else 0, np.uint32)
        self.seen = 0

    def at(self, index: int, out: np.ndarray, n: int) -> int:
        if self.seen < n:
            new = out[self.seen : n]
            self.colours[(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - self.bits)] = new
            self.seen = n
        return int(self.colours[index])


def _copy(out: np.ndarray, n: int, length: int, back: int) -> None:
    if back > n or n + length > len(out):
        raise BadImage("a copy from before the image or beyond it")
    if back >= length:
        out[n : n + length] = out[n - back : n - back + length]
    else:
        out[n : n + length] = np.resize(out[n - back : n], length)


def _decode_chained(r: BitReader, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray:
    """An image with one prefix-code group."""
    out, n, cache = np.zeros(total, np.uint32), 0, _Cache(cache_bits)
    green, red, blue, alpha, distance = codes
    if all(c.width == 0 for c in (green, red, blue, alpha)) and green.lone < 256:
        out[:] = alpha.lone << 24 | red.lone << 16 | green.lone << 8 | blue.lone
        return out
    raw = np.frombuffer(r.data, np.uint8)
    while n < total:
        base = r.at
        span = min(STRETCH, (total - n) * 60 + 64, len(raw) * 8 - base)
        if span <= 0:
            raise BadImage("the stream ends early")
        lo = base >> 3
        b = raw[lo : lo + (span + 80 >> 3) + 12].astype(np.uint32)
        word = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        look = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()[base & 7 :]
        span = min(span, len(look) - 61)
        entry = green.table[look[:span] & np.uint32(green.mask)]
        literal = entry < 256 << 4
        nxt = np.arange(span, dtype=np.int32) + (entry & 15)
        places = []
        for c in (red, blue, alpha):
            places.append(nxt)
            if c.width:
                nxt = nxt + (c.table[look[nxt] & np.uint32(c.mask)] & 15)
        hop = np.arange(span + 64, dtype=np.int32)  # a position that begins no literal stays
        hop[:span][literal] = nxt[literal]
        hop2 = hop[hop]
        hop3 = hop[hop2]
        after = hop[hop3]
        one, four = memoryview(hop), memoryview(np.where(after != hop3, after, -1))
        at = 0
        while n < total and at < span:
            fours, p = [], at
            for _ in range((total - n) // 4):
                if (q := four[p]) < 0:
                    break
                fours.append(p)
                p = q
            hops = []
            for _ in range(total - n - 4 * len(fours)):
                if p >= span or (q := one[p]) == p:
                    break
                hops.append(p)
                p = q
            if fours:
                f = np.array(fours)
                hops = np.concatenate([np.stack([f, hop[f], hop2[f], hop3[f]], axis=1).ravel(), np.array(hops, np.int64)])
            if len(hops):
                i = np.asarray(hops)
                argb = (entry[i] >> 4).astype(np.uint32) << np.uint32(8)
                for c, place, shift in zip((red, blue, alpha), places, (16, 0, 24), strict=True):
                    argb |= (c.table[look[place[i]] & np.uint32(c.mask)] >> 4).astype(np.uint32) << np.uint32(shift) if c.width else np.uint32(c.lone << shift)
                out[n : n + len(i)] = argb
                n += len(i)
                at = p
            if n < total and at < span:
                r.at = base + at
                s = r.symbol(green)
                if s < 256 + LENGTH_CODES:
                    length = _read_value(r, s - 256)
                    back = plane_distance(_read_value(r, r.symbol(distance)), width)
                    _copy(out, n, length, back)
                    n += length
                else:
                    out[n] = cache.at(s - 256 - LENGTH_CODES, out, n)
                    n += 1
                at = r.at - base
        r.at = base
        r.skip(at)
    return out


def _decode_stepwise(r: BitReader, groups: list[list[Code]], group_of: np.ndarray, bits: int, width: int, total: int, cache_bits: int) -> np.ndarray:
    """An image whose prefix codes change from block to block."""
    out, n, cache = np.zeros(total, np.uint32), 0, _Cache(cache_bits)
    while n < total:
        green, red, blue, alpha, distance = groups[group_of[n // width >> bits, n % width >> bits]]
        s = r.symbol(green)
        if s < 256:
            out[n] = s << 8 | r.symbol(red) << 16 | r.symbol(blue) | r.symbol(alpha) << 24
            n += 1
        elif s < 256 + LENGTH_CODES:
            length = _read_value(r, s - 256)
            back = plane_distance(_read_value(r, r.symbol(distance)), width)
            _copy(out, n, length, back)
            n += length
        else:
            out[n] = cache.at(s - 256 - LENGTH_CODES, out, n)
            n += 1
    return out


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of over 11 bits")
    group_of, bits = None, 0
    if main and r.read(1):
        bits = r.read(3) + 2
        group_of = (_read_pixels(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[read_code(r, n) for n in sizes] for _ in range(int(group_of.max()) + 1 if group_of is not None else 1)]
    if len(groups) == 1:
        flat = _decode_chained(r, groups[0], width, width * height, cache_bits)
    else:
        flat = _decode_stepwise(r, groups, group_of, bits, width, width * height, cache_bits)
    return flat.reshape(height, width)


# ---------------------------------------------------------------- transforms


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels B, G, R, A as int32 along a last axis."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)


def _merge(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view(np.uint32)[..., 0]


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The prediction of one mode from the channels of the neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:  # whichever is nearer to left + top - top_left
        to_left, to_top = np.abs(top - top_left).sum(-1), np.abs(left - top_left).sum(-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        base = mean(left, top)
        half = base - top_left
        return np.clip(base + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    out = np.zeros_like(left)
    out[..., 3] = 255
    return out


def _modes(data: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """The predictor mode of every pixel, borders by their fixed rules."""
    modes = np.repeat(np.repeat((data >> np.uint32(8)) & np.uint32(15), 1 << bits, 0)[:height], 1 << bits, 1)[:, :width].astype(np.int8)
    modes[0, :], modes[:, 0], modes[0, 0] = 1, 2, 0
    return modes


def invert_predictor(residual: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residuals, along the wavefront x + 2y (a pixel needs x+1 of the row above)."""
    height, width = residual.shape
    modes, rest = _modes(data, bits, height, width).ravel(), _split(residual).reshape(-1, 4)
    out = np.zeros((height * width, 4), np.int32)
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        at = y * width + (t - 2 * y)
        mode = modes[at]
        near = [out[np.maximum(at - d, 0)] for d in (1, width, width - 1, width + 1)]
        guess = np.zeros((len(at), 4), np.int32)
        for m in np.unique(mode).tolist():
            k = np.flatnonzero(mode == m)
            guess[k] = predicted(m, *(x[k] for x in near))
        out[at] = (rest[at] + guess) & 255
    return _merge(out).reshape(height, width)


def apply_predictor(argb: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    """Residuals of the modes in ``data``."""
    height, width = argb.shape
    modes, flat = _modes(data, bits, height, width).ravel(), _split(argb).reshape(-1, 4)
    at = np.arange(len(flat))
    near = [flat[np.maximum(at - d, 0)] for d in (1, width, width - 1, width + 1)]
    guess = np.zeros_like(flat)
    for m in np.unique(modes).tolist():
        k = np.flatnonzero(modes == m)
        guess[k] = predicted(m, *(x[k] for x in near))
    return _merge(flat - guess).reshape(height, width)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(argb: np.ndarray, data: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Take green and red out of red and blue, or (inverse) put them back."""
    height, width = argb.shape
    spread = lambda c: np.repeat(np.repeat(c, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]
    c, m = _split(argb), _signed(_split(data))
    green_to_red, green_to_blue, red_to_blue = (spread(m[..., k]) for k in (0, 1, 2))
    green, red = _signed(c[..., 1]), c[..., 2].copy()
    sign = 1 if inverse else -1
    c[..., 2] += sign * (green_to_red * green >> 5)
    c[..., 0] += sign * (green_to_blue * green >> 5)
    c[..., 0] += sign * (red_to_blue * _signed(c[..., 2] if inverse else red) >> 5)
    return _merge(c)


def subtract_green(argb: np.ndarray, inverse: bool) -> np.ndarray:
    """Take green out of red and blue, or (inverse) put it back."""
    green = (argb >> np.uint32(8)) & np.uint32(255)
    both, rest = argb & np.uint32(0x00FF00FF), argb & np.uint32(0xFF00FF00)
    twice = green << np.uint32(16) | green
    # 0x01000100 lends each byte what a subtraction may borrow.
    both = both + twice if inverse else (both | np.uint32(0x01000100)) - twice
    return rest | both & np.uint32(0x00FF00FF)


def index_bits(colours: int) -> int:
    """log2 of how many palette indices share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(packed: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Pixels from palette indices; an index outside the palette is transparent black."""
    shift = index_bits(len(palette))
    index = ((packed >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    if shift:
        each = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift) * each).astype(np.uint8)) & np.uint8((1 << each) - 1)
        index = index.reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def bundle(index: np.ndarray, colours: int) -> np.ndarray:
    shift = index_bits(colours)
    if shift:
        each, n = 8 >> shift, 1 << shift
        wide = np.zeros((len(index), -(-index.shape[1] // n) * n), np.uint32)
        wide[:, : index.shape[1]] = index
        index = (wide.reshape(len(index), -1, n) << (np.arange(n, dtype=np.uint32) * np.uint32(each))).sum(2, dtype=np.uint32)
    return np.uint32(BLACK) | index.astype(np.uint32) << np.uint32(8)


# ---------------------------------------------------------------- files


def frame_length(data: bytes, at: int = 0) -> int:
    """Bytes of the WebP file that begins at ``at``."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise BadImage("no WebP file")
    return 8 + int.from_bytes(data[at + 4 : at + 8], "little")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    if frame_length(data) > len(data):
        raise BadImage("the file is cut off")
    at, chunk = 12, None
    while at + 8 <= len(data) and chunk is None:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            chunk = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if chunk is None or chunk[:1] != bytes([SIGNATURE]):
        raise BadImage("no lossless image")
    r = BitReader(chunk)
    r.skip(8)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise BadImage("an unknown version")
    undo, now = [], width
    seen = set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise BadImage("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            blocks = _read_pixels(r, (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, blocks, bits))
        elif kind == COLOUR_INDEXING:
            deltas = _split(_read_pixels(r, r.read(8) + 1, 1, False))[0]
            palette = _merge(np.cumsum(deltas, axis=0))
            undo.append((kind, palette, now))
            now = -(-now // (1 << index_bits(len(palette))))
        else:
            undo.append((kind, None, 0))
    pixels = _read_pixels(r, now, height, True)
    for kind, what, number in reversed(undo):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, what, number)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, what, number, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = unbundle(pixels, what, number)
    return pixels


def matches(flat: np.ndarray, starts: np.ndarray, shortest: int = 16) -> list[tuple[int, int, int]]:
    """``(place, length, distance)`` of copies, left to right, that begin at one of ``starts``.

    A place is tried if the ``shortest`` pixels from it have been seen at an earlier start,
    and the match is extended as far as it goes.
    """
    starts = starts[starts + shortest <= len(flat)]
    if len(starts) < 2:
        return []
    grams = flat[starts[:, None] + np.arange(shortest)]
    weight = np.cumprod(np.full(shortest, 0x9E3779B97F4A7C15, np.uint64))
    key = (grams.astype(np.uint64) * weight).sum(1, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    here = np.argsort(order[same + 1], kind="stable")
    out, free = [], 0
    for i, j in zip(starts[order[same + 1]][here].tolist(), starts[order[same]][here].tolist(), strict=True):
        while i >= free and i < len(flat):
            limit = min(MAX_COPY, len(flat) - i)
            for look in (min(64, limit), limit):  # most end soon
                differ = flat[i : i + look] != flat[j : j + look]
                length = int(differ.argmax()) if differ.any() else look
                if length < look:
                    break
            if length < shortest:
                break
            out.append((i, length, i - j))
            free = i + length
            if length < MAX_COPY:
                break
            i, j = i + length, j + length
    return out


def _tokens(flat: np.ndarray, width: int, cache_bits: int, copies: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """Symbols of the stream in order: ``green`` for each, and for copies their other parts."""
    copied = np.zeros(len(flat) + 1, np.int64)
    for i, length, _ in copies:
        copied[i + 1] += 1
        copied[i + length] -= 1
    at = np.flatnonzero(np.cumsum(copied[:-1]) == 0)  # literals and the first pixels of copies
    green = ((flat[at] >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    length_extra, length_width, dist, dist_extra, dist_width = (np.zeros(len(at), np.int64) for _ in range(5))
    place = np.searchsorted(at, [c[0] for c in copies]) if copies else []
    near = _near_codes(width)
    for k, (_, length, back) in zip(place, copies, strict=True):
        code, length_extra[k], length_width[k] = value_code(length)
        green[k] = 256 + code
        dist[k], dist_extra[k], dist_width[k] = value_code(near.get(back, back + len(NEAR)))
    if cache_bits:
        slot = (flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(len(flat), bool)  # the last pixel of this slot was this colour
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
        use = hit[at] & (green < 256)
        green[use] = 256 + LENGTH_CODES + slot[at[use]]
    return {"at": at, "green": green, "length_extra": length_extra, "length_width": length_width, "dist": dist, "dist_extra": dist_extra, "dist_width": dist_width}


def _write_pixels(w: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] = (), groups: np.ndarray | None = None, group_bits: int = 0) -> None:
    height, width = argb.shape
    flat = argb.ravel()
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(group_bits - 2, 3)
            _write_pixels(w, groups.astype(np.uint32) << np.uint32(8), False)
    t = _tokens(flat, width, cache_bits, list(copies))
    at, green = t["at"], t["green"]
    group = groups[at // width >> group_bits, at % width >> group_bits].astype(np.int64) if groups is not None else None
    literal, copy = green < 256, (green >= 256) & (green < 256 + LENGTH_CODES)
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    # Which symbols to write and for which tokens; a channel that never changes needs no bits.
    parts = [(0, green, None)]
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        varies = bool(((flat ^ flat[0]) & np.uint32(255 << shift)).any())
        parts.append((k, ((flat[at] >> np.uint32(shift)) & np.uint32(255)).astype(np.int64) if varies else None, literal))
    parts.append((4, t["dist"] if copies else None, copy))
    constant = [int(flat[0]) >> shift & 255 for shift in (16, 0, 24)]
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in range(int(group.max()) + 1 if group is not None else 1):
        mine = None if group is None else group == g
        for k, symbol, use in parts:
            if symbol is None:
                write_lone(w, constant[k - 1] if k < 4 else 0)
                continue
            rows = mine if use is None else use if mine is None else mine & use
            here = symbol if rows is None else symbol[rows]
            bits, lengths = write_code(w, np.bincount(here, minlength=sizes[k]))
            if rows is None:
                columns[k] = (bits[here], lengths[here])
            else:
                values, widths = columns.setdefault(k, (np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint8)))
                values[rows], widths[rows] = bits[here], lengths[here]
    order = [columns[k] for k in sorted(columns)]
    if copies:  # a copy is: green, extra bits of the length, distance symbol, its extra bits
        extra = lambda name: (t[f"{name}_extra"].astype(np.uint32), t[f"{name}_width"].astype(np.uint8))
        order[1:] = [extra("length"), *order[1:], extra("dist")]
    w.put_all(*(np.stack(x, axis=1).ravel() if len(order) > 1 else x[0] for x in zip(*order, strict=True)))


def encode(
    argb: np.ndarray,
    *,
    palette: bool = False,
    predictor: tuple[np.ndarray, int] | None = None,
    cross: tuple[np.ndarray, int] | None = None,
    green: bool = False,
    cache_bits: int = 0,
    copy_starts: np.ndarray | None = None,
    groups: tuple[np.ndarray, int] | None = None,
) -> bytes:
    """A lossless WebP file of the pixels.

    ``predictor`` and ``cross`` are (block image, bits of the block side); ``groups`` the same
    for prefix-code groups; ``copy_starts`` the flat pixel places where back-references may
    begin or point to (None: no back-references).  A palette needs at most 256 colours.
    """
    height, width = argb.shape
    w = BitWriter()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(bool((argb >> np.uint32(24) != 255).any())), 1)
    w.put(0, 3)
    if palette:
        colours = np.unique(argb)
        w.put(1, 1)
        w.put(COLOUR_INDEXING, 2)
        w.put(len(colours) - 1, 8)
        _write_pixels(w, _merge(np.diff(_split(colours), axis=0, prepend=0))[None, :], False)
        argb = bundle(np.searchsorted(colours, argb), len(colours))
    if green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        argb = subtract_green(argb, False)
    for kind, chosen in ((PREDICTOR, predictor), (CROSS_COLOUR, cross)):
        if chosen is not None:
            blocks, bits = chosen
            w.put(1, 1)
            w.put(kind, 2)
            w.put(bits - 2, 3)
            _write_pixels(w, blocks, False)
            argb = apply_predictor(argb, blocks, bits) if kind == PREDICTOR else cross_colour(argb, blocks, bits, False)
    w.put(0, 1)
    copies = matches(argb.ravel(), copy_starts) if copy_starts is not None else []
    _write_pixels(w, argb, True, cache_bits, copies, *(groups or ()))
    body = bytes([SIGNATURE]) + w.bytes()
    body += b"\0" * (len(body) & 1)
    size = len(body)
    return b"RIFF" + struct.pack("<I", 12 + size) + b"WEBPVP8L" + struct.pack("<I", size) + body
