"""Global counts of keys and answers to those who hold them, without a group of rows in any one task.

Text is worked on in slices of a few MB, kept as rows of a table, so that a slice has a lasting number. A slice sends
each of its keys once, however many of its documents have it, so a key that a third of all documents share arrives
once per slice and no more. Keys travel as sorted arrays of 64-bit numbers, one row per slice and bucket of the hash
range; a bucket is what one task sorts, and their number grows with the keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a bucket on average.
BUCKET_KEYS = 500_000
#: Bits of a filter over keys: fixed, so what is broadcast has one size. It is used while a quarter of the bits at most
#: can be set. Bits are gathered in blocks of 32,768, the size of Spark's bitmaps.
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 15


def buckets_for(keys: int, least: int) -> int:
    return max(least, -(-keys // BUCKET_KEYS))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in sorted keys; at most 2**32 buckets of equal ranges."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


def blobs(parts) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def u64(blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob, np.uint64)


def i64(blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob, np.int64)


def key_filter(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A condition on 64-bit hashes that holds for every one in `column` of keys, and for few others.

    One bit array of FILTER_BITS with two bits a key. Every task of keys makes its own blocks of it, and those are joined
    by partial aggregates, so no task sees more than one block of each of the others. For more keys than a filter of that
    size can tell apart, the condition holds for all.
    """
    if keys.count() > FILTER_BITS // 8:
        return lambda _: F.lit(True)
    places = F.array(F.pmod(column, F.lit(FILTER_BITS)), F.pmod(F.shiftright(column, 32), F.lit(FILTER_BITS)))
    bits = keys.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / BLOCK_BITS).alias("block"))
    table = np.zeros((FILTER_BITS // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in bits.agg(F.bitmap_construct_agg(F.pmod("p", F.lit(BLOCK_BITS))).alias("bits")).collect():  # FILTER_BITS / 8 bytes in all
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table.reshape(-1))

    @F.pandas_udf("boolean")
    def passes(h):
        import pandas as pd

        values = h.to_numpy(np.int64)
        ok = np.ones(len(values), bool)
        for k in (values % FILTER_BITS, (values >> 32) % FILTER_BITS):
            ok &= (shared.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return passes
