import random

import pytest
from pyspark.sql import functions as F

from castlist.operators import mapping

COUNTS = "doc_id bigint, name string, occurrences int"
ROWS = "doc_id bigint, original string, replacement string, occurrence_count int, rank int"


def test_rank_and_label(spark):
    counts = spark.createDataFrame([(1, "Alice", 2), (1, "Bob", 5), (1, "Carol", 1)], COUNTS)
    labelled = mapping.rank_names(counts).withColumn(
        "label", mapping.label(F.col("name"), F.col("occurrences"))
    )
    assert [row.label for row in labelled.orderBy("rank").collect()] == [
        "Bob (5)", "Alice (2)", "Carol (1)",
    ]


def test_ties_follow_code_points(spark):
    tied = ["🎉", "￥", "a", "B", "é", "张"]
    counts = spark.createDataFrame([(1, name, 1) for name in tied], COUNTS)
    ranked = mapping.rank_names(counts).orderBy("rank").collect()
    assert [row.name for row in ranked] == sorted(tied)


def test_missing_counts_are_zero(spark):
    listed = spark.createDataFrame([(1, "A"), (1, "B")], "doc_id bigint, name string")
    counts = spark.createDataFrame([(1, "B", 2)], COUNTS)
    ranked = mapping.rank_names(listed, counts).orderBy("rank").collect()
    assert [tuple(row) for row in ranked] == [(1, "B", 2, 1), (1, "A", 0, 2)]


@pytest.mark.parametrize("rows_per_task", [1, 7, 60])
def test_split_ranks_equal_plain_ranks(spark, rows_per_task):
    rng = random.Random(rows_per_task)
    rows = {}
    for doc_id, size in ((1, 300), (2, 40), (3, 1)):
        for i in range(size):
            name = rng.choice(["", "张", "prefix-long-", "Z"]) + str(i)
            rows[doc_id, name] = rng.choice([0, 1, 1, 1, 2, 5, 31_999, 32_000, 40_000, 90_000])
    counts = spark.createDataFrame([(d, n, c) for (d, n), c in rows.items()], COUNTS)
    split = {tuple(row) for row in mapping.rank_names(counts, rows_per_task=rows_per_task).collect()}
    plain = set()
    for doc_id in (1, 2, 3):
        ordered = sorted((-c, n) for (d, n), c in rows.items() if d == doc_id)
        plain |= {(doc_id, n, -c, i + 1) for i, (c, n) in enumerate(ordered)}
    assert split == plain
    top = {tuple(row) for row in mapping.top_names(counts, 4).collect()}
    assert top == {row for row in plain if row[3] <= 4}


def test_top_names_limits_before_the_shuffle(spark):
    counts = spark.createDataFrame([(1, "A", 1)], COUNTS)
    plan = mapping.top_names(counts, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert plan.count("WindowGroupLimit") == 2


def table(spark, *replacements):
    rows = [(1, "A" * (i + 1), r, 1, i + 1) for i, r in enumerate(replacements)]
    return spark.createDataFrame(rows, ROWS)


def test_edited_mappings(spark):
    rows = spark.createDataFrame(
        [(1, "A", "", 1, 1), (2, "A", " ", 1, 1), (3, "A", " A ", 1, 1), (4, "A", " B ", 1, 1),
         (5, "Alice", "Alicia", 3, 1)],
        ROWS,
    )
    found = {tuple(row) for row in mapping.edited_mappings(rows).collect()}
    assert found == {(4, "A", "B", 1), (5, "Alice", "Alicia", 1)}
    counts = dict(mapping.edited_counts(rows).collect())
    assert counts == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_edits(spark):
    edits = spark.createDataFrame(
        [(1, "A", "first", 1), (1, "A", "second", 2), (1, "unknown", "x", 3), (2, "AA", "y", 4)],
        "doc_id bigint, original string, replacement string, edit_no int",
    )
    edited = mapping.apply_edits(table(spark, "", "kept"), edits).orderBy("rank").collect()
    assert [(row.original, row.replacement) for row in edited] == [("A", "second"), ("AA", "kept")]


def test_resets(spark):
    rows = table(spark, "x", "y")

    def replacements(df):
        return [row.replacement for row in df.orderBy("rank").collect()]

    assert replacements(mapping.reset_all(rows)) == ["", ""]
    assert replacements(mapping.reset_row(rows, 1)) == ["x", ""]
    assert replacements(mapping.reset_row(rows, 5)) == ["x", "y"]
    assert replacements(mapping.reset_row(rows, -1)) == ["x", "y"]


def test_equal_counts_with_a_long_prefix_fill_several_ranges(spark):
    counts = spark.range(5000).select(
        F.lit(1).alias("doc_id"), F.format_string("a long common prefix %06d", "id").alias("name"), F.lit(70_000).alias("occurrences")
    )
    sizes = [row["count"] for row in mapping.in_ranges(counts, 8).groupBy("range_no").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2500
    ranked = mapping.rank_names(counts, rows_per_task=700).orderBy("rank").collect()
    assert [row.rank for row in ranked] == list(range(1, 5001))
    assert [row.name for row in ranked] == sorted(row.name for row in ranked)


def test_last_row_of_an_original_wins(spark):
    rows = [(1, "A", "B", 1, 1), (1, "A", "C ", 1, 2), (1, "A", "A", 1, 3), (2, "A", "D", 1, 1), (1, "E", "", 1, 4)]
    found = mapping.edited_mappings(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(tuple(row) for row in found) == [(1, "A", "C", 1), (2, "A", "D", 1)]


def test_few_ranges_for_many_rows_and_ranks_over_several(spark, monkeypatch):
    counts = spark.range(4000).select(F.lit(1).alias("doc_id"), F.format_string("n%05d", "id").alias("name"), (F.col("id") % 7).alias("occurrences"))
    made, in_ranges = [], mapping.in_ranges
    monkeypatch.setattr(mapping, "in_ranges", lambda rows, n: made.append(n) or in_ranges(rows, n))
    plain = sorted((-(i % 7), f"n{i:05d}") for i in range(4000))
    for least, n in ((mapping.LEAST_RANGE, 1), (500, 8)):
        monkeypatch.setattr(mapping, "LEAST_RANGE", least)
        ranked = mapping.rank_names(counts, rows_per_task=10).orderBy("rank").collect()
        assert made.pop() == n
        assert [(-r.occurrences, r.name, r.rank) for r in ranked] == [(c, name, i + 1) for i, (c, name) in enumerate(plain)]
