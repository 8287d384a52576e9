"""Exact deduplication against DuckDB and a plain grouping, with digests that clash, and odd tables."""

import hashlib

import duckdb
import pytest

from spanloom.llm.exact_dedup import drop_copies, exact_groups
from spanloom.llm.queries import OP7_SQL, op7_exact_dedup

DIR = "/root/testdata/sf0.001"
SPACE = {ord(c): None for c in " \t\n\x0b\x0c\r"}
ROWS = [(5, "a b"), (3, "a  b"), (4, "ab"), (9, "x"), (2, None), (1, " \n"), (8, ""), (7, "a b"), (6, "long " * 50_000), (12, "long" * 50_000)]


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    rel = con.sql(OP7_SQL)
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in rel.columns) for r in op7_exact_dedup(spark, DIR).collect())


@pytest.mark.parametrize("digest_chars", [64, 2])
def test_against_plain_groups(spark, digest_chars):
    rows = ROWS + [(100 + k, f"text {k % 300}") for k in range(900)]  # more texts than digests of two digits
    groups = {}
    for k, t in rows:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), k))
    want = sorted((k, min(g)[1], len(g), k == min(g)[1], hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for _, k in g)
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest_chars, files_per_batch=2).collect()
    assert want == sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got)


def test_odd_tables(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (2, "b", None), (2, "c", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = exact_groups(docs).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 4
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["text"] or "") for r in left.collect()) == ["", "a", "b", "c"]
    assert exact_groups(docs.limit(0)).count() == 0 and drop_copies(docs.limit(0)).count() == 0


def test_state_that_stays(spark, tmp_path):
    folder = str(tmp_path / "state")
    schema = "doc_id long, text string"
    exact_groups(spark.createDataFrame([(3, "a b"), (4, "c")], schema), state_dir=folder).collect()
    got = exact_groups(spark.createDataFrame([(1, "ab"), (2, "c  "), (5, "d")], schema), state_dir=folder).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 3, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 2, 2, False), (5, 5, 1, True)]


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 1, "x", 3), (2, " a", 1, "y", 3)], "doc_id long, text string, _id int, _sha string, digest int")
    assert [tuple(r) for r in drop_copies(docs).collect()] == [(2, " a", 1, "y", 3)]


def test_kept_texts_too_large_to_broadcast(spark, monkeypatch):
    from spanloom.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    test_against_plain_groups(spark, 2)
