import corpus_pipeline
from corpusloom.llm import quality
from tests.llm import brute


def test_stages(spark, odd, tmp_path, rows):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = odd
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == columns
            ids.append({r.doc_id: r.text for r in docs.collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "packing"]
    good = [(d, t) for d, t, *_ in rows if (c := brute.counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert {d for d, _ in good} == {d for d in ids[0] if d is not None}
    first = {c for _, c in brute.components(good).values()}
    assert first == {d for d in ids[1] if d is not None}
    left = brute.without_repeats([(d, t) for d, t in good if d in first])
    assert {d: brute.words(t) for d, t in ids[2].items() if d is not None} == {d: k for d, (_, k) in left.items()}
    assert {r.doc_id for r in docs.collect()} == set(ids[2])


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{small}/documents.parquet").count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert quality.RULES.keys() == quality.CUTOFFS.keys()
