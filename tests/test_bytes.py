"""Transforms, chunking and codecs: inverses, bounds, and hostile input."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnstore.functions import chunking, codecs, transforms
from cairnstore.functions.scalars import TRANSFORMS


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from([1, 2, 3, 4, 5]))
def test_transforms_invert(data, code):
    assert transforms.apply(code, transforms.apply(code, data), True) == data


def test_code_transform_inverts_planted_opcodes():
    rng = random.Random(2)
    for _ in range(50):
        raw = bytearray(rng.randbytes(2048))
        raw[rng.randrange(2000)] = 0xE8
        raw[rng.randrange(2000)] = 0x0F
        assert transforms.bcj_x86(transforms.bcj_x86(bytes(raw)), True) == bytes(raw)


def bmp(width, height, bits, rng):
    stride = (width * bits // 8 + 3) // 4 * 4
    head = b"BM" + struct.pack("<IHHI", 54 + stride * height, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0)
    return head + rng.integers(0, 256, stride * height, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("bits", [8, 24, 32])
@pytest.mark.parametrize("width", range(13, 21))
def test_rasters_invert(bits, width):
    data = bmp(width, 9, bits, np.random.default_rng(99))
    for name in ("med", "med_rows", *(("rct_med", "rct_med_rows") if bits > 8 else ())):
        coded = transforms.apply(TRANSFORMS[name], data)
        assert coded != data and transforms.apply(TRANSFORMS[name], coded, True) == data


def test_raster_formats():
    assert transforms.raster_of(b"P6\n# note\n4 2\n255\n" + bytes(24)) == (18, 12, 12, 2, 3)
    assert transforms.raster_of(b"P5 4 2 255\n" + bytes(8)).pixel == 1
    tga = bytearray(18)
    tga[2], tga[16] = 2, 24
    struct.pack_into("<HH", tga, 12, 5, 3)
    assert transforms.raster_of(bytes(tga) + bytes(45)).stride == 15
    for bad in (b"", b"BM", b"P6\n", b"P5 4 2 65535\n" + bytes(8), b"P5 4 2 255\n"):
        assert transforms.raster_of(bad) is None


def test_sniff():
    assert transforms.sniff(b"\x7fELF" + bytes(14) + b"\x3e\0") == 3
    assert transforms.sniff(b"RIFF1234WAVE" + bytes(20) + b"\x04\0") == 5
    assert transforms.sniff(b"plain") == 0 == transforms.sniff(b"")


@pytest.mark.parametrize("size", [0, 1, 100, 8192, 8193, 300_000])
def test_chunks_cover_and_stay_in_bounds(size):
    data = random.Random(size).randbytes(size)
    parts = chunking.cuts(data)
    assert b"".join(data[s : s + n] for s, n in parts) == data
    assert all(n <= chunking.MOST for _, n in parts) and all(n >= chunking.LEAST for _, n in parts[:-1])
    assert parts == chunking.cuts(data)


def test_candidates_equal_the_rolling_hash():
    data = random.Random(5).randbytes(20_000)
    h, want = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(chunking.GEAR[b])) % (1 << 64)
        if i >= 9 and h % 1024 == 0:
            want.append(i + 1)
    assert chunking.candidates(data, 10).tolist() == want


def test_entropy_bounds():
    assert transforms.entropy(random.Random(1).randbytes(65_536)) > 7.9
    assert transforms.entropy(bytes(65_536)) < 0.01 and transforms.entropy(b"") == 0


@pytest.mark.parametrize("mode", ["fast", "best", "max", "ultra", "text"])
def test_codecs_round_trip_and_refuse(mode):
    data = b"the cat sat on the mat. " * 500
    frame = codecs.compress(data, mode)
    assert len(frame.payload) < len(data) and codecs.decompress(frame, len(data)) == data
    with pytest.raises(ValueError):
        codecs.decompress(frame, 100)
    broken = codecs.Frame(frame.codec, frame.payload[:20])
    with pytest.raises(ValueError):
        if codecs.decompress(broken, len(data)) != data:
            raise ValueError("cut short")


def test_dictionary_only_if_it_pays():
    samples = [f"record {i}: value {i * 7}".encode() * 9 for i in range(400)]
    known = codecs.train_dictionary(samples, 4096)
    frame = codecs.compress(samples[3], "best", known)
    assert codecs.decompress(frame, 10_000, known) == samples[3]
    assert codecs.train_dictionary(samples[:3]) is None


@pytest.mark.parametrize("n,want", [(0, 2), ((4 << 20) - 1, 2), (4 << 20, 4), (16 << 20, 16), (99 << 20, 16)])
def test_dictionary_tiers(n, want):
    assert codecs.dictionary_bytes(n) == want << 20


@pytest.mark.parametrize("width,rows,pixel,pad", [(1, 1, 1, 0), (13, 6, 1, 3), (17, 9, 3, 1), (5, 20, 4, 0)])
def test_gradient(width, rows, pixel, pad):
    rng = random.Random(width)
    g = transforms.Raster(7, width * pixel + pad, width * pixel, rows, pixel)
    data = rng.randbytes(7 + g.stride * rows)
    out = transforms.gradient(data, g)
    assert transforms.gradient(out, g, True) == data
    at = lambda d, y, x: d[7 + y * g.stride + x] if y >= 0 and x >= 0 else 0
    for y in range(rows):
        for x in range(width * pixel):
            guess = at(data, y, x - pixel) + at(data, y - 1, x) - at(data, y - 1, x - pixel)
            assert at(out, y, x) == (at(data, y, x) - guess) % 256
