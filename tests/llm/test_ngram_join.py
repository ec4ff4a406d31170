from corpusloom.llm import ngram_join
from tests.llm import brute


def test_components(docs, rows, empty):
    want = brute.components([(r[0], r[1]) for r in rows])
    got = {r.k: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_chain_and_group(spark):
    """A chain whose ends are far apart, and a group of near copies with outliers of its own."""
    base = [f"b{i}" for i in range(200)]
    chain = [" ".join(base[i * 8 :] + [f"e{j}" for j in range(i * 8)]) for i in range(8)]
    group = [" ".join([*base[:100], f"z{i}", *base[100:]]) for i in range(30)]
    texts = chain + group + ["p q r s t u"] * 3 + ["p q r s t v", ""]
    docs = list(enumerate(texts))
    want = brute.components(docs)
    got = {r.k: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_one_shingle_in_many_sizes(spark):
    """A shingle that unlike sets of many sizes share, rare in all of them, and sets at the bound of similarity."""
    texts = [" ".join(["k l m n o", *(f"x{i}_{j}" for j in range(3 * i))]) for i in range(30)]
    texts += [" ".join(f"y{j}" for j in range(n)) for n in (44, 54, 55, 69, 84)]
    docs = list(enumerate(texts))
    got = {r.k: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.components(docs)


def test_least_key_is_a_key(spark):
    rows = [(-(1 << 63), "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.k, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str) == sorted([(-(1 << 63), -(1 << 63)), (3, -(1 << 63)), (None, -(1 << 63)), (None, None)], key=str)


def test_one_of_each(odd, rows):
    out = ngram_join.one_of_each(odd).collect()
    want = brute.components([(r[0], r[1]) for r in rows])
    first = {c for n, c in want.values() if n}
    kept = [r.doc_id for r in out if r.text is not None and brute.words(r.text)]
    assert sorted(x for x in kept if x is not None) == sorted(first) and kept.count(None) == 1
    assert sum(1 for r in out if not brute.words(r.text)) == sum(1 for r in odd.collect() if not brute.words(r.text))
    assert len(out[0]) == len(odd.columns)


def test_prefixes_hold_every_link():
    for n in range(1, 60):
        p = ngram_join.prefix_length(n)
        need = -(-n * 80 // 100)
        assert p == n - need + 1
