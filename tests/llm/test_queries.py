import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from castlist.llm import queries
from tests.oracle import differences

SF_DIR = "/root/testdata/sf0.001"


def test_all_thirteen_and_the_pipeline_are_registered():
    names = entry_points.queries().keys()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert queries.QUERIES.keys() <= names and "pipeline" in names
    assert queries.ORACLES.keys() <= entry_points.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_other_queries_give_a_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR)
    assert rows.count() == rows.select("doc_id").distinct().count() == 200


def test_stages(spark, table):
    words = " ".join(f"w{i}" for i in range(40))
    near = words.replace("w39", "other")
    footer = "shared footer line"
    rows = [(i, f"this is the text of number {'abcdefghijkl'[i]} with {'mnopqrstuvwx'[i]} words\n{footer}", "en", "s") for i in range(12)]
    rows += [(20, words, "en", "s"), (21, words, "en", "s"), (22, near, "en", "s"), (23, None, "en", "s"), (24, "1 2 3", "en", "s")]
    docs = table(rows)
    identified = corpus_pipeline.language(spark, docs, SF_DIR)
    assert {r.doc_id for r in identified.collect()} == {r[0] for r in rows} - {23, 24}
    lines = corpus_pipeline.shared_lines(spark, identified, SF_DIR)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts[0] == rows[0][1].split("\n")[0] and texts[20] == words
    kept = corpus_pipeline.near_dedup(spark, lines, SF_DIR)
    assert {r.doc_id for r in kept.collect()} == {*range(12), 20}
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    planted = kept.unionByName(table([(30, f"before {item.upper()} after", "en", "s")]))
    clean = corpus_pipeline.decontaminate(spark, planted, SF_DIR)
    assert {r.doc_id for r in clean.collect()} == {*range(12), 20}
    assert clean.columns == docs.columns
    encoded = corpus_pipeline.encode(spark, clean, SF_DIR).collect()
    assert len(encoded) == 13 and all(r.restored and r.n_tokens * 4 == len(r.ids) for r in encoded)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    found = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, bytes(r.ids)) for r in found.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in docs.collect())


def test_stages_over_no_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
