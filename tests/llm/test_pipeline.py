"""The queries and the pipeline as registered, held against stated results on a test folder."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in names if x.startswith("op")}
    assert "pipeline" in names and "pipeline" not in E.oracle_sql()


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op3_warc", "op4_url_filter", "op5_license_scan", "op9_quality_rules"])
def test_oracle(spark, name):
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    query = con.execute(E.oracle_sql()[name])
    columns = [c[0] for c in query.description]
    expected = sorted(map(repr, (tuple(r) for r in query.fetchall())))
    got = sorted(map(repr, (tuple(r) for r in E.queries()[name](spark, SF).select(*columns).collect())))
    assert got == expected


def test_pipeline_against_the_operators(spark):
    import corpus_pipeline as C
    from spendlens.llm import ngram_join, quality_rules, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in C.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "tokens"]
    one = C.cut(C.quality(spark, docs, SF), "one")
    assert one.columns == docs.columns
    kept = {r.doc_id for r in quality_rules.quality_report(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in one.collect()} == kept
    two = C.cut(C.toxic(spark, one, SF), "two")
    clean = {r.doc_id for r in toxicity.toxicity_report(one, labels).filter("NOT toxic").collect()}
    assert {r.doc_id for r in two.collect()} == clean and two.columns == docs.columns
    three = C.cut(C.near_duplicates(spark, two, SF), "three")
    firsts = {r.component_id for r in ngram_join.ngram_jaccard_join(two).collect()}
    assert {r.doc_id for r in three.collect()} == firsts and three.columns == docs.columns
    four = C.cut(C.mixture(spark, three, SF), "four")
    assert {r.doc_id for r in four.collect()} <= firsts and four.columns == docs.columns
    five = C.tokens(spark, four, SF).collect()
    assert len(five) == four.count() and all(len(r.ids) == r.n_tokens for r in five)
