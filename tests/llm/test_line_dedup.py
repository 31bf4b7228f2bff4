import time
from collections import Counter

import pytest

from castlist.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACES))


def by_hand(rows, min_docs, min_length):
    held = Counter()
    for _, text in rows:
        held.update({key(line) for line in (text or "").split("\n")})
    gone = {k for k, n in held.items() if n >= min_docs and len(k) >= min_length}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "min_docs", "min_length"), [(1, 3, 1), (2, 2, 0), (3, 1, 2), (4, 10, 1)])
def test_equals_brute_force(table, corpus, seed, min_docs, min_length):
    rows = corpus(seed)
    found = line_dedup.drop_frequent_lines(table(rows), min_docs, min_length)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr)
    assert got == by_hand(rows, min_docs, min_length)


def test_repeated_and_null_ids_count_as_rows(table):
    rows = [(1, "a\nb"), (1, "a\nc"), (None, "A \nd"), (None, None)]
    found = line_dedup.drop_frequent_lines(table(rows), 3, 1).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, ""), (0, "d"), (1, "b"), (1, "c")]


def test_other_columns_and_empty_tables(table):
    docs = table([(1, "a", "x", "y")]).withColumnRenamed("lang", "n_dropped").withColumnRenamed("source", "key")
    row = line_dedup.drop_frequent_lines(docs, 1, 1).first()
    assert (row.text, row.n_dropped, row.key) == ("", 1, "y")
    assert line_dedup.drop_frequent_lines(table([])).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame(
        [(1, "a\nb", 5, "h", "d", 7), (2, "a", 6, "i", "e", 8)],
        "doc_id int, text string, dropped int, text_hash string, row string, gone_id int",
    )
    found = line_dedup.drop_frequent_lines(docs, 2, 1)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, found.collect())) == [(1, "b", 5, "h", "d", 7, 2, 1), (2, "", 6, "i", "e", 8, 1, 1)]


def test_time_is_linear_in_the_lines_of_a_text(spark, table):
    def seconds(n):
        text = "\n".join(f"line number {i}" for i in range(n))
        docs = table([(1, text), (2, text)])
        start = time.perf_counter()
        assert line_dedup.drop_frequent_lines(docs, 2, 1).where("n_dropped = n_lines").count() == 2
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(20_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large <= 2.3 * small + 0.2, (small, large)
