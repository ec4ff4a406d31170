import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use inside.
CLASHES = ["k", "t", "id", "row", "w", "h", "b", "cell", "size", "shard", "features", "keys", "rank", "n", "c", "label", "single"]


def corpus():
    """Texts with copies, near copies, shared passages, repeats within, ties, nulls and odd characters."""
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["The", "of", "É", "ß", "漢", "a,b", "it's"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n", "one", "Five words are one shingle", "four words are short", base, base, base.upper(), " ".join(near), text(50) + " " + passage + " " + text(40), passage, text(30) + "\n" + passage.replace(" ", "\n") + "\n" + text(30)]
    texts += ["x " * 40, "x " * 13, "ha ha ho " * 20, "line one\nline one\nline two\n\n\n", "a b\x0bc\x0cd\x1ce\x85f", "퟿\U0001f600 ́eİΣ <|endoftext|> '<|'s 12²", "x" * 20_000, text(3000), base + " " + text(9), None, "one"]
    texts += [text(r.randint(1, 40)) for _ in range(20)]
    return [(i * 7 % 101, t, [None, "en", "de"][i % 3], [None, "", "s1", "s1", "s2"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, null keys and columns with clashing names."""
    from pyspark.sql import functions as F

    more = [*rows, rows[6], rows[6], (None, rows[6][1], "en", "s1", 1), (None, None, None, None, None), (None, "alone in the world", "en", "s1", 1)]
    return spark.createDataFrame(more, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
