import hashlib
import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import media


def filtered(pixels, kinds, bpp):
    """The filters of PNG, forwards."""
    out, above = [], np.zeros(pixels.shape[1], int)
    for kind, line in zip(kinds, pixels.astype(int), strict=True):
        left = np.concatenate([np.zeros(bpp, int), line[:-bpp]])
        corner = np.concatenate([np.zeros(bpp, int), above[:-bpp]])
        p = left + above - corner
        d = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        out.append((line - guess) % 256)
        above = line
    return np.array(out, np.uint8)


@pytest.mark.parametrize("bpp", [1, 3, 4])
def test_all_filters(bpp):
    r = np.random.default_rng(0)
    pixels = r.integers(0, 256, (40, 12 * bpp), np.uint8)
    kinds = r.integers(0, 5, 40)
    assert (media.unfilter(kinds, filtered(pixels, kinds, bpp), bpp) == pixels).all()


@pytest.mark.parametrize("bpp", [1, 3])
def test_many_images_at_once(bpp):
    r = np.random.default_rng(5)
    images = [r.integers(0, 256, (h, 8 * bpp), np.uint8) for h in (1, 7, 1, 30, 2)]
    kinds = [r.integers(0, 5, len(x)) for x in images]
    lines = np.concatenate([filtered(x, k, bpp) for x, k in zip(images, kinds, strict=True)])
    within = np.concatenate([np.arange(len(x)) for x in images])
    assert (media.unfilter(np.concatenate(kinds), lines, bpp, within) == np.concatenate(images)).all()


def test_encoder_takes_the_best_filter_of_each_line():
    """Stored lines are those of a plain encoder, which tries all filters."""
    r = np.random.default_rng(6)
    ramp = (np.add.outer(np.arange(20) * 3, np.arange(64) * 2) + r.integers(0, 3, (20, 64))) % 256
    texts = [b"some text in lines " * 40, bytes(64), ramp.astype(np.uint8).tobytes(), r.integers(0, 256, 640, np.uint8).tobytes(), bytes(range(64)) * 3]
    seen = set()
    for raw, png in zip(texts, media.encode_pngs([media.pad(x) for x in texts]), strict=True):
        pixels = np.frombuffer(media.pad(raw), np.uint8).reshape(-1, 64)
        size = int.from_bytes(png[33:37])
        lines = np.frombuffer(zlib.decompress(png[41 : 41 + size]), np.uint8).reshape(-1, 65)
        for i, line in enumerate(lines):
            every = [filtered(pixels[: i + 1], [0] * i + [k], 1)[i] for k in range(5)]
            costs = [sum(min(int(v), 256 - int(v)) for v in x) for x in every]
            assert line[0] == int(np.argmin(costs)) and (line[1:] == every[line[0]]).all()
            seen.add(int(line[0]))
        assert media.decode_png(png).tobytes() == media.pad(raw) and media.encode_png(pixels) == png
    assert seen >= {0, 1, 2, 4}


def test_hash_is_that_of_a_plain_transform():
    r = np.random.default_rng(8)
    for height, width in ((32, 32), (64, 64), (100, 64), (3, 64)):
        image = r.integers(0, 256, (height, width), np.uint8)
        small = [[0.0] * 32 for _ in range(32)]
        for y in range(32):
            for x in range(32):
                rows = range(y * height // 32, max((y + 1) * height // 32, y * height // 32 + 1))
                cols = range(x * width // 32, max((x + 1) * width // 32, x * width // 32 + 1))
                small[y][x] = sum(float(image[i, j]) for i in rows for j in cols) / (len(rows) * len(cols))
        flat = []
        for u in range(8):
            for v in range(8):
                flat.append(round(sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6))
        median = sorted(flat[1:])[31]
        bits = int.from_bytes(media.cosine_hash(image))
        want = sum((c > median) << (63 - i) for i, c in enumerate(flat))
        assert bits == want


def test_round_trip_and_checksums():
    pixels = np.random.default_rng(1).integers(0, 256, (3000, 64), np.uint8)
    png = media.encode_png(pixels)
    assert (media.decode_png(png)[:, :, 0] == pixels).all() and png.count(b"IDAT") > 1
    broken = bytearray(png)
    broken[100] ^= 1
    for bad in (bytes(broken), png[:50], b"", png[:-12]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_hash_is_stable():
    r = np.random.default_rng(2)
    image = np.kron(r.integers(40, 200, (8, 8)), np.ones((12, 8))).astype(np.uint8)
    assert media.cosine_hash(image) == media.cosine_hash(image.copy()) and len(media.cosine_hash(image)) == 8
    noisy = image + r.integers(0, 3, image.shape).astype(np.uint8)
    other = np.kron(r.integers(40, 200, (8, 8)), np.ones((12, 8))).astype(np.uint8)
    apart = lambda a, b: bin(int.from_bytes(media.cosine_hash(a)) ^ int.from_bytes(media.cosine_hash(b))).count("1")
    assert apart(image, noisy) <= 4 < 16 <= apart(image, other)


def test_digests(odd, empty):
    got = sorted((tuple(r) for r in media.digests(media.text_media(odd)).collect()), key=str)
    want = []
    for r in odd.collect():
        raw = (r.text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        pixels = np.frombuffer(data, np.uint8).reshape(-1, 64)
        png = media.encode_png(pixels)
        want.append((r.doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.cosine_hash(pixels).hex()))
    assert got == sorted(want, key=str)
    assert media.digests(media.text_media(empty)).count() == 0
