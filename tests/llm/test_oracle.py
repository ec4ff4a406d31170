"""Every query with SQL gives the same rows in DuckDB, on tables in which cutoffs are certified and copies have links."""

import duckdb
import pytest

from corpusloom.llm import registry
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, db, name):
    got, want = registry.queries()[name](spark, FOLDER), db.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda row: [str(x) for x in row]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


def test_sql_on_odd_texts(rows):
    """The SQL itself against the plain versions, with nulls, empty texts, blanks and runs."""
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    db.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    docs, sql = [r[:2] for r in rows], registry.oracle_sql()
    got = {r[0]: r[1:] for r in db.sql(sql["op3_ngram_jaccard"]).fetchall()}
    assert {d: g[:2] for d, g in got.items()} == brute.components(docs)
    got = {r[0]: r[1:3] for r in db.sql(sql["op10_substring_dedup"]).fetchall()}
    assert got == {d: (len(w), len(w) - len(k)) for d, (w, k) in brute.without_repeats(docs).items()}
    got = {r[0]: r[1:6] for r in db.sql(sql["op6_quality_rules"]).fetchall()}
    assert got == {d: brute.counts(t) for d, t in docs}
