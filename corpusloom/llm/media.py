"""Binary media columns: lossless PNG from zlib chunks, read back with checksum tests, and a cosine-transform hash.

The encoder stores bytes as an 8-bit grey image of a given width and takes for each line the filter whose differences are
smallest in sum. The decoder takes any 8-bit grey, RGB or RGBA PNG without interlace, tests the CRC of every chunk and
undoes all five line filters in numpy: a pixel depends on those to the left and above, so the pixels of one diagonal, of
all images at hand, are undone at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import column, keyed, parquet, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, SIDE, LOW = 64, 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predicted(kind: int | np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What a filter expects from the pixels to the left (a), above (b) and above to the left (c)."""
    if isinstance(kind, int):
        return [np.zeros_like(a), a, b, (a + b) >> 1, _paeth(a, b, c)][kind]
    out = np.where(kind == 1, a, 0)
    for k, one in ((2, lambda: b), (3, lambda: (a + b) >> 1), (4, lambda: _paeth(a, b, c))):
        if (kind == k).any():
            out = np.where(kind == k, one(), out)
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))


def filtered(lines: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Lines of grey images, `within` their numbers in their images, each behind the number of its filter: the first of
    those with the smallest sum of differences, taken as signed."""
    x = lines.astype(np.int16)
    above = np.where(within[:, None] > 0, np.roll(x, 1, axis=0), 0).astype(np.int16)
    shifted = lambda y: np.concatenate([np.zeros((len(y), 1), np.int16), y[:, :-1]], axis=1)
    left, corner = shifted(x), shifted(above)
    out, best = np.zeros((len(x), x.shape[1] + 1), np.uint8), np.full(len(x), np.iinfo(np.int64).max)
    for kind in range(5):
        rest = (x - _predicted(kind, left, above, corner)).astype(np.uint8)
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < best
        best[better] = cost[better]
        out[better, 0], out[better, 1:] = kind, rest[better]
    return out


def _stored(lines: np.ndarray, level: int = 1) -> bytes:
    """A PNG from filtered lines, the data in chunks of at most 64 KiB."""
    data = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", lines.shape[1] - 1, len(lines), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + 65536]) for i in range(0, len(data), 65536)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A grey image (height, width) of uint8."""
    return _stored(filtered(pixels, np.arange(len(pixels))), level)


def encode_pngs(payloads: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Payloads of whole lines as grey images of one width."""
    heights = np.array([len(p) // width for p in payloads], np.int64)
    ends = np.cumsum(heights)
    lines = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    lines = filtered(lines, np.arange(len(lines)) - np.repeat(ends - heights, heights))
    return [_stored(lines[e - h : e]) for e, h in zip(ends.tolist(), heights.tolist(), strict=True)]


def _parsed(media: bytes) -> tuple[np.ndarray, int]:
    """The filtered lines of a PNG and its channels; ValueError for a wrong signature, checksum, form or length."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("chunk cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, *rest = head
    if depth != 8 or colour not in CHANNELS or any(rest):
        raise ValueError("only 8 bits without palette and interlace are read")
    bpp = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong length")
    return raw.reshape(height, width * bpp + 1), bpp


def decode_pngs(media: list[bytes]) -> list[np.ndarray]:
    """(height, width, channels) of uint8 of each; ValueError for a wrong signature, checksum, form or length."""
    parsed, out = [_parsed(m) for m in media], {}
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (lines, bpp) in enumerate(parsed):
        shapes.setdefault((lines.shape[1], bpp), []).append(i)
    for (width, bpp), own in shapes.items():
        lines = np.concatenate([parsed[i][0] for i in own])
        heights = np.array([len(parsed[i][0]) for i in own], np.int64)
        ends = np.cumsum(heights)
        done = unfilter(lines[:, 0], lines[:, 1:], bpp, np.arange(len(lines)) - np.repeat(ends - heights, heights))
        for i, e, h in zip(own, ends.tolist(), heights.tolist(), strict=True):
            out[i] = done[e - h : e].reshape(h, (width - 1) // bpp, bpp)
    return [out[i] for i in range(len(media))]


def decode_png(media: bytes) -> np.ndarray:
    return decode_pngs([media])[0]


def unfilter(kinds: np.ndarray, lines: np.ndarray, bpp: int, within: np.ndarray | None = None) -> np.ndarray:
    """Undoes the line filters 0 none, 1 sub, 2 up, 3 average, 4 Paeth; `within` are the numbers of lines in their images."""
    if not kinds.any():
        return lines
    if (kinds > 4).any():
        raise ValueError("unknown line filter")
    n, width = len(lines), lines.shape[1] // bpp
    within = np.arange(n) if within is None else within
    order = np.argsort(within, kind="stable")
    at, kind = within[order], kinds[order].astype(np.int16)[:, None]
    # A line and a column of zeros before each image's pixels; `above` of first lines is the line of zeros.
    out = np.zeros(((n + 1) * (width + 1), bpp), np.int16)
    here, above = (order + 1) * (width + 1), np.where(at > 0, order, 0) * (width + 1)
    source, begin = lines.reshape(n * width, bpp), order * width
    for step in range(int(at[-1]) + width):
        lo, hi = np.searchsorted(at, (step - width + 1, step + 1))
        j = step - at[lo:hi]
        a, b, c = out[here[lo:hi] + j], out[above[lo:hi] + j + 1], out[above[lo:hi] + j]
        out[here[lo:hi] + j + 1] = (source[begin[lo:hi] + j] + _predicted(kind[lo:hi], a, b, c)) & 255
    return out.reshape(n + 1, (width + 1) * bpp)[1:, bpp:].astype(np.uint8)


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


_DCT = _cosines(SIDE, LOW)


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n nearly equal runs along the first axis; with fewer than n lines, lines repeat."""
    edges = np.arange(n) * len(x) // n
    ends = np.maximum((np.arange(n) + 1) * len(x) // n, edges + 1)
    total = np.zeros((len(x) + 1, x.shape[1]))
    np.cumsum(x, axis=0, out=total[1:])
    return (total[ends] - total[edges]) / (ends - edges)[:, None]


def cosine_hash(grey: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients of the 32 x 32 means exceed their median, the constant one aside."""
    small = _means(_means(grey.astype(np.float64), SIDE).T, SIDE).T
    coefficients = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(coefficients > np.median(coefficients[1:])).tobytes()


def pad(raw: bytes, block: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % block if raw else block)


SCHEMA = "doc_id long, n_bytes long, media binary, hash binary"


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, hash): each text, zero-padded to lines of 64 bytes, as a PNG and its cosine hash.

    A null text is an empty one; equal texts give equal bytes. Keys are passed on, of any type, nulls and repeats too. An empty
    table gives no rows; other columns are not looked at, whatever their names.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = column(batch, "k"), column(batch, "t").fill_null("")
            for lo, hi in slices(texts):
                raws = [x.as_buffer().to_pybytes() for x in texts[lo:hi]]
                media = encode_pngs([pad(x) for x in raws])
                hashes = [cosine_hash(image[:, :, 0]) for image in decode_pngs(media)]
                yield pa.record_batch([keys[lo:hi], pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "n_bytes", "media", "hash"])

    return df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(make, keyed(SCHEMA, df, key))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What op9 returns, from media columns alone: the payload is what the stored bytes give when read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(column(batch, "media")):
                own = [column(batch, c)[lo:hi].to_pylist() for c in ("doc_id", "n_bytes", "media", "hash")]
                rows = []
                for doc, n, stored, bits, image in zip(*own, decode_pngs(own[2]), strict=True):
                    payload = image.tobytes()
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), bits.hex()))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cells = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[1:], kinds[1:], strict=True)]
                yield pa.record_batch([column(batch, "doc_id")[lo:hi], *cells], [x.split()[0] for x in DIGESTS.split(", ")])

    return media.mapInArrow(read, keyed(DIGESTS, media, "doc_id"))


def op9_media(spark, sf_dir):
    return digests(text_media(parquet(spark, sf_dir, "documents")))


QUERIES = {"op9_media": op9_media}
SQL: dict[str, str] = {}
