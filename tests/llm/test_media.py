"""Lossless WebP: exact round trips through every part of the format."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselle.llm import media, webp


def picture(h, w, kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "few":
        return rng.integers(0, 2**32, 5, dtype=np.uint64).astype(np.uint32)[rng.integers(0, 5, (h, w))]
    if kind == "noise":
        return rng.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)
    v = (np.cumsum(rng.integers(0, 3, (h, w)), 1) % 256).astype(np.uint32)
    return np.uint32(0xFF000000) | v << np.uint32(16) | (v // 2) << np.uint32(8) | (255 - v)


def blocks(h, w, bits, top, seed):
    return np.random.default_rng(seed).integers(0, top, ((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits), dtype=np.uint64).astype(np.uint32)


def test_near_distances_are_the_rule():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (20, 33), (64, 17), (1, 300)])
@pytest.mark.parametrize("kind", ["few", "noise", "smooth"])
def test_transforms_and_symbols(size, kind):
    h, w = size
    x = picture(h, w, kind, 1)
    pred, cross, group = blocks(h, w, 2, 16, 2) << np.uint32(8), blocks(h, w, 3, 2**32, 3), blocks(h, w, 2, 3, 4).astype(int)
    every = np.arange(h * w)
    for on in itertools.product([False, True], repeat=6):
        how = {"predictor": (pred, 2), "cross": (cross, 3), "green": True, "cache_bits": 5, "copy_starts": every, "groups": (group, 2)}
        how = {k: v for (k, v), use in zip(how.items(), on, strict=True) if use}
        assert (webp.decode(webp.encode(x, **how)) == x).all(), list(how)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = np.unique(rng.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32))
    x = table[rng.integers(0, len(table), (13, 29))]
    assert (webp.decode(webp.encode(x, palette=True, cache_bits=3)) == x).all()


def test_each_predictor_mode_alone():
    x = picture(17, 23, "smooth", 5)
    for mode in range(16):
        data = np.full((5, 6), mode << 8, np.uint32)
        assert (webp.invert_predictor(webp.apply_predictor(x, data, 2), data, 2) == x).all()


def test_a_hand_made_stream():
    """1 x 1, no transforms: the bits of the specification written out one by one."""
    w = webp.BitWriter()
    for value, width in [(0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]:  # sides, alpha, version, no transform, no cache, no groups
        w.put(value, width)
    for symbol in (9, 200, 1, 255, 0):  # one symbol each: green, red, blue, alpha, distance
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(symbol > 1), 1)
        w.put(symbol, 8 if symbol > 1 else 1)
    body = b"\x2f" + w.bytes()
    body += b"\0" * (len(body) % 2)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[0xFFC80901]]


def test_damage_is_an_error():
    good = webp.encode(picture(30, 30, "noise", 2))
    for bad in (good[:40], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_any_bytes(data):
    payload = media.payload_of(data)
    assert len(payload) % 192 == 0 and payload.startswith(data) and media.from_media(media.to_media(payload)) == payload


def test_many_images():
    payload = media.payload_of(b"lorem ipsum " * 80_000)
    stored = media.to_media(payload)
    assert len(list(media.images(stored))) == 3 and media.from_media(stored) == payload


def test_query_rows(make, odd_rows):
    got = sorted(media.round_trip(make(odd_rows)).collect(), key=str)
    want = []
    for doc_id, text in odd_rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.round_trip(make([])).count() == 0


def test_pixels_table(make):
    row = media.pixels(media.store(make([(1, "ab")]))).first()
    assert (row.width, row.height, len(row.argb)) == (192, 1, 192) and row.argb[0] & 255 == ord("a")
