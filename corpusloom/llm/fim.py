"""Fill-in-middle: a text is cut at two line ends and its parts are put in an order that asks for the middle last.

The lines of all texts of a slice are one packed bit vector over their bytes, with a bit where a line ends, and a directory
of the bits before each block. A rank at the borders of a text gives the number of its lines, a select the byte at which
its k-th line ends, so neither lines nor characters are ever made one by one; characters are counted by rank in a second
vector, of the bytes that begin one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from corpusloom.llm.common import column, offsets_of, parquet, slices

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: 64-bit words of a block.
BLOCK = 8


class Bits:
    """A packed bit vector that counts the bits before places (rank) and finds the k-th bit (select), many at a time."""

    def __init__(self, marks: np.ndarray):
        padded = np.zeros(-(-(len(marks) + 1) // (64 * BLOCK)) * 64 * BLOCK, bool)
        padded[: len(marks)] = marks
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        count = np.bitwise_count(self.words).reshape(-1, BLOCK)
        #: Bits before each block, and before each word of its block.
        self.directory = np.concatenate([[0], np.cumsum(count.sum(axis=1, dtype=np.int64))])
        self.inside = (np.cumsum(count, axis=1, dtype=np.uint16) - count).astype(np.int64)

    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The bits before each place, up to the length of the vector."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.directory[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th bit, from 0 to less than the total."""
        block = np.searchsorted(self.directory, k, "right") - 1
        rest = k - self.directory[block]
        nth = (self.inside[block] <= rest[:, None]).sum(axis=1) - 1
        rest = rest - self.inside[block, nth]
        place = (block * BLOCK + nth) * 64
        word = self.words[block * BLOCK + nth]
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            over = rest >= low
            rest, place = rest - low * over, place + half * over
            word = np.where(over, word >> np.uint64(half), word)
        return place


def line_ends(data: np.ndarray, offsets: np.ndarray) -> Bits:
    """Bits at the last byte of every line; the last line of a text may lack its newline."""
    ends = data == 10
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return Bits(ends)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text its lines n, the bytes at which prefix and middle end, and the characters of both."""
    lines, chars = line_ends(data, offsets), Bits((data & 0xC0) != 0x80)
    before = lines.rank(offsets)
    n = np.diff(before)
    out = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = offsets[:-1].copy()
        some = k > 0
        at[some] = lines.select(before[:-1][some] + k[some] - 1) + 1
        out.append(at)
    starts = chars.rank(offsets[:-1])
    first, second = chars.rank(out[0]), chars.rank(out[1])
    return n, *out, first - starts, second - first


def _checked(marks: tuple[str, str, str]) -> list[bytes]:
    raw = [m.encode() for m in marks]
    overlap = any(a[-k:] == b[:k] for a in raw for b in raw for k in range(1, min(len(a), len(b)) + (a is not b)))
    if len(raw) != 3 or not all(raw) or overlap:
        raise ValueError("marks have to be three texts of which none ends as one begins")
    return raw


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row.

    n counts the lines of the text. The key and the seed decide all else: of four 32-bit numbers of the SHA-256 of
    `seed:key`, two give the lines at which prefix and middle end, the third whether the text is transformed (`rate` in
    100) and the fourth its form (`spm` in 100 begin with the suffix). A text that holds a mark, and an empty one, stay
    plain: their output is the text, and their characters are null.

    A null text is an empty one. Keys may be of any type that has a string; a null key is that of the empty string. Repeated
    rows are transformed each, and alike. An empty table gives no rows. Other columns are not looked at, whatever their
    names. A long text is worked on whole, in memory in the order of its length.
    """
    raw = _checked(marks)
    kind = df.schema[key].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    own = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), digest.alias("digest")).select("k", "t", *parts)
    schema = StructType().add("k", kind).add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = raw
        for batch in batches:
            texts = column(batch, "t")
            hashes = [column(batch, f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            for lo, hi in slices(texts):
                offsets, buffer = offsets_of(texts[lo:hi]), texts[lo:hi].buffers()[2]
                low, high = int(offsets[0]), int(offsets[-1])
                data, offsets = np.frombuffer(buffer, np.uint8)[low:high] if buffer is not None else np.zeros(0, np.uint8), offsets - low
                h1, h2, h3, h4 = (h[lo:hi] for h in hashes)
                n, one, two, prefix, middle = cuts(data, offsets, h1, h2)
                whole, forms, outputs = memoryview(data), [], []
                for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist(), strict=True)):
                    own = bytes(whole[a:d])
                    if not own or h3[i] % 100 >= rate or any(x in own for x in raw):
                        forms.append("plain")
                        outputs.append(own)
                        continue
                    x, y, z = own[: b - a], own[b - a : c - a], own[c - a :]
                    spm_first = h4[i] % 100 < spm
                    forms.append("spm" if spm_first else "psm")
                    outputs.append(b"".join((s, z, p, x, m, y) if spm_first else (p, x, s, z, m, y)))
                plain = np.array([f == "plain" for f in forms], bool)
                cells = [column(batch, "k")[lo:hi], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.record_batch(cells, schema.fieldNames())

    return own.mapInArrow(run, schema).withColumnRenamed("k", key)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. As no mark ends as one begins, each is found where it was put."""
    _checked(marks)

    def three(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the first mark, the second mark and that of the middle."""
        rest = F.substring(F.col(output), F.lit(len(first) + 1), F.length(output))
        head = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(head) + len(second) + 1, F.length(output))
        tail = F.substring_index(rest, marks[2], 1)
        return head, tail, F.substring(rest, F.length(tail) + len(marks[2]) + 1, F.length(output))

    prefix, suffix, middle = three(marks[0], marks[1])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = three(marks[1], marks[0])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", F.concat(prefix, middle, suffix)).otherwise(F.col(output))


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(parquet(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
_HEX = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
SQL = {
    "op11_fill_in_middle": f"""
    WITH units AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || doc_id) AS h FROM documents
    ), numbers AS (
      SELECT doc_id, t, u, len(u) AS n, {", ".join(f"{_HEX.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM units
    ), placed AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
      FROM numbers
    ), parts AS (
      SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM placed
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
    FROM parts"""
}
