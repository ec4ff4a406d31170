"""Operators that pass keys on take them of any type."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, media, packing, unigram

OPERATORS = {
    "token_counts": lambda df: unigram.count_tokens(df, "id", "body"),
    "bpe": lambda df: bpe.encode_texts(df, "id", "body"),
    "packing": lambda df: packing.digests(packing.pack(df, "id", "body", "source")),
    "media": lambda df: media.digests(media.text_media(df, "id", "body")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_keys_of_any_type(docs, name):
    numbers = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "source")
    want = {r.doc_id: [tuple(x)[1:] for x in [r]] for r in OPERATORS[name](numbers).collect()}
    texts = numbers.withColumn("id", F.concat(F.lit("k"), "id"))
    got = OPERATORS[name](texts)
    assert dict(got.dtypes)["doc_id"] == "string"
    assert {r.doc_id for r in got.collect()} == {f"k{k}" for k in want}
    pairs = OPERATORS[name](numbers.withColumn("id", F.struct("id", F.lit("x").alias("y"))))
    assert {r.doc_id.id for r in pairs.collect()} == set(want)
    if name != "packing":
        assert {r.doc_id: [tuple(r)[1:]] for r in got.collect()} == {f"k{k}": v for k, v in want.items()}
