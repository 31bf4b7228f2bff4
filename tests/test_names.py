import random

import pytest
from pyspark.sql import functions as F

from castlist.operators import names, skew
from castlist.operators.skew import heavy_keys

RESPONSES = "doc_id bigint, chunk_idx int, response string, error_class string, error string"
PARSED = "doc_id bigint, chunk_idx int, names array<string>, error_class string, error string"


def test_distinct_names(spark):
    df = spark.createDataFrame(
        [(["Charlie", "Alice", "Bob", " Alice", "", "　", "Bob\n"],)], "names array<string>"
    )
    assert df.select(names.distinct_names(F.col("names"))).first()[0] == ["Charlie", "Alice", "Bob"]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_dedupe_keeps_first_seen_order(spark, partitions):
    rows = [
        (1, 1, ["Bob", "Dora "], None, None),
        (1, 0, ["Alice", " Alice", "", "Bob"], None, None),
        (1, 2, None, "TimeoutError", "x"),
        (2, 0, ["alice", "Alice"], None, None),
    ]
    parsed = spark.createDataFrame(rows, PARSED).repartition(partitions)
    found = names.dedupe_names(parsed).orderBy("doc_id", "first_chunk", "first_pos").collect()
    assert [tuple(row) for row in found] == [
        (1, "Alice", 0, 0),
        (1, "Bob", 0, 3),
        (1, "Dora", 1, 1),
        (2, "alice", 0, 0),
        (2, "Alice", 0, 1),
    ]


def test_parse_keeps_failures_as_rows(spark):
    rows = [
        (1, 0, '{"names": ["A"]}', None, None),
        (1, 1, None, "TimeoutError", "late"),
        (1, 2, '{"x": 1}', None, None),
    ]
    parsed = names.parse_replies(spark.createDataFrame(rows, RESPONSES)).orderBy("chunk_idx")
    assert [tuple(row) for row in parsed.drop("response").collect()] == [
        (1, 0, ["A"], None, None),
        (1, 1, None, "TimeoutError", "late"),
        (1, 2, None, "ValueError", 'Could not extract names from response: {"x": 1}'),
    ]


TEXTS = ["Alice met Bob. Alice waved at Bob. Carol watched.", "张三丰 张三", "aaaa", ""]
NAMES = [
    (0, "Alice", 2), (0, "Bob", 2), (0, "Carol", 1), (0, "Diana", 0),
    (1, "张三丰", 1), (1, "张三", 2), (2, "aa", 2), (2, "a", 4), (3, "x", 0),
]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_counts(spark, docs_of, broadcast_bytes, rows_per_task):
    table = spark.createDataFrame([(d, n) for d, n, _ in NAMES] + [(9, "no text")],
                                  "doc_id bigint, name string")
    counted = names.count_occurrences(docs_of(*TEXTS), table, broadcast_bytes, rows_per_task)
    assert {tuple(row) for row in counted.collect()} == set(NAMES)


def test_counts_of_own_names(spark):
    docs = spark.createDataFrame(
        [(0, TEXTS[0], ["Bob", "Alice", "Carol ", "Bob", "Diana"])],
        "doc_id bigint, text string, names array<string>",
    )
    found = names.count_own_names(docs).orderBy("rank").collect()
    assert [tuple(row) for row in found] == [
        (0, "Alice", 2, 1), (0, "Bob", 2, 2), (0, "Carol", 1, 3), (0, "Diana", 0, 4),
    ]


def test_automaton_counts_like_a_search_per_name(monkeypatch):
    if names.ahocorasick is None:
        pytest.skip("no automaton library")
    monkeypatch.setattr(names, "AUTOMATON_WORK", 0)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("ab张🎉", k=rng.randint(0, 60)))
        words = {"".join(rng.choices("ab张🎉", k=rng.randint(1, 4))) for _ in range(8)}
        listed = sorted(words)
        assert names.count_all(text, listed) == [text.count(word) for word in listed]


def outcome_of(spark, *chunks):
    rows = [(1, i, found, cls, error) for i, (found, cls, error) in enumerate(chunks)]
    row = names.run_outcome(spark.createDataFrame(rows, PARSED)).first()
    return row.status, row.message, row.details


def test_outcomes(spark):
    failed = outcome_of(spark, (None, "E", "x"), (None, "E", "y"))
    assert failed == ("failed", "All 2 chunk(s) failed", "x")
    assert outcome_of(spark, (["A"], None, None), (None, "E", "y"))[0] == "ok"
    assert outcome_of(spark, ([], None, None), (None, "E", "y")) == (
        "failed", "All 1 chunk(s) failed", "y",
    )
    assert outcome_of(spark, ([], None, None)) == ("ok", None, None)
    limited = ("rate_limited", "Rate limit exceeded. Please wait and retry.", "Provider rate limit.")
    assert outcome_of(spark, (["A"], None, None), (None, "RateLimitError", "y")) == limited
    assert outcome_of(spark, (None, "E", "Error code: 429")) == limited


def test_summaries(spark):
    rows = [(1, 0, ["A", "A"], None, None), (1, 1, [], None, None), (1, 2, None, "E", "x")]
    summary = names.chunk_summary(spark.createDataFrame(rows, PARSED)).orderBy("chunk_idx")
    assert [tuple(row) for row in summary.collect()] == [(1, 0, 2), (1, 1, 0)]
    counts = spark.createDataFrame([(1, "A", 3), (1, "B", 0)], "doc_id long, name string, occurrences int")
    assert tuple(names.mention_totals(counts).first()) == (1, 2, 3)


def test_heavy_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"))
    heavy = heavy_keys(df, "k", 100)
    assert (heavy.count, [tuple(row) for row in heavy.table.select("k", "parts").collect()]) == (1, [(7, 4)])
    assert heavy_keys(df, "k") is None


def test_heavy_keys_may_be_too_many_to_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 0)
    table = spark.createDataFrame([(d, n) for d, n, _ in NAMES], "doc_id bigint, name string")
    counted = names.count_occurrences(docs_of(*TEXTS), table, 0, 1)
    assert {tuple(row) for row in counted.collect()} == set(NAMES)


@pytest.mark.parametrize("limits", [(1 << 20, 10**6), (0, 10**6), (0, 1)])
@pytest.mark.parametrize("work", [0, 200_000])
def test_names_are_cleaned_before_they_are_counted(spark, docs_of, limits, work, monkeypatch):
    monkeypatch.setattr(names, "AUTOMATON_WORK", work)
    raw = [(0, " Alice "), (0, "Alice"), (0, " "), (0, ""), (0, None), (1, "Alice")]
    table = spark.createDataFrame(raw, "doc_id bigint, name string")
    counted = names.count_occurrences(docs_of("Alice met Alice", "nobody"), table, *limits)
    assert sorted(tuple(row) for row in counted.collect()) == [(0, "Alice", 2), (1, "Alice", 0)]


def test_both_counts_agree_on_empty_names(monkeypatch):
    for work in (0, 10**9):
        monkeypatch.setattr(names, "AUTOMATON_WORK", work)
        assert names.count_all("abca", ["", "a", None]) == [0, 2, 0]
        assert names.count_all("abca", [""]) == [0]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_outcome_does_not_depend_on_a_setting(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        failed = outcome_of(spark, (None, "E", "x"), (None, "E", "y"))
        rows = [(1, 0, None, "E", "x"), (1, 1, None, "E", "y")]
        n_names = names.run_outcome(spark.createDataFrame(rows, PARSED)).first().n_names
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert failed == ("failed", "All 2 chunk(s) failed", "x") and n_names == 0


def test_joined_lists_exchange_each_side_once(spark, docs_of):
    table = spark.createDataFrame([(0, "a")], "doc_id bigint, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = names.count_occurrences(docs_of("a"), table, broadcast_bytes=0)
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2
