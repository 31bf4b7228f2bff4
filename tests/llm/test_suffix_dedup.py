import random

import numpy as np
import pytest

from castlist.llm import suffix_dedup as dedup
from castlist.llm.suffix_array import suffix_arrays
from castlist.session import drop_stored


def by_hand(rows, length=dedup.LENGTH):
    big = 1 << 63
    order = sorted(rows, key=lambda r: big if r[0] is None else r[0])
    seen, out, at = set(), [], 0
    while at < len(order):
        same = [r for r in order if r[0] == order[at][0]]
        for doc, text in same:
            data = (text or "").encode()
            gone = [False] * len(data)
            for i in range(len(data) - length + 1):
                if data[i : i + length] in seen:
                    gone[i : i + length] = [True] * length
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            out.append((doc, len(data), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
        for _, text in same:
            data = (text or "").encode()
            seen.update(data[i : i + length] for i in range(len(data) - length + 1))
        at += len(same)
    return sorted(out, key=repr)


def texts(seed, n=50):
    rng = random.Random(seed)
    pieces = ["".join(rng.choices("abcdé \n漢", k=rng.randint(5, 90))) for _ in range(12)] + ["a" * 130, "ab" * 70]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for i in range(n)]
    return [*rows, (n, None), (None, rows[3][1]), (None, rows[3][1]), (7, rows[4][1]), (n + 1, "x" * 3000 + pieces[0])]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"block_bytes": 900, "owner_bytes": 2000}),
                                             (3, {"block_bytes": 700, "owner_bytes": 900, "crowd": 2}),
                                             (4, {"crowd_in_block": 2})])
def test_equals_brute_force(table, seed, limits):
    rows = texts(seed)
    found = dedup.remove_repeats(table(rows), **limits).collect()
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in found), key=repr)
    assert got == by_hand(rows)
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in found)


def test_other_columns_and_empty_tables(table):
    docs = table([(1, "z" * 60), (2, "z" * 60)]).withColumnRenamed("lang", "block").withColumnRenamed("source", "kept")
    assert [(r.doc_id, len(r.kept)) for r in dedup.remove_repeats(docs).orderBy("doc_id").collect()] == [(1, 60), (2, 0)]
    assert dedup.remove_repeats(table([])).count() == 0


def test_strips_of_a_long_text(monkeypatch):
    monkeypatch.setattr(dedup, "STRIP", 100)
    text = ("abcdefghij" * 20 + "y" * 200 + "abcdefghij" * 20).encode()
    found = dedup.stretches([b"", text, b"short"], dedup.GRAM, 3)
    covered = sorted(s + k for s, n in zip(found.start, found.count, strict=True) for k in range(n))
    assert covered == list(range(len(text) - dedup.LENGTH + 1)) and set(found.text) == {1}
    anchor = {}
    for s, n, a in zip(found.start, found.count, found.anchor, strict=True):
        for i in range(s, s + n):
            assert anchor.setdefault(text[i : i + dedup.LENGTH], a) == a


def test_suffix_arrays_of_random_sequences():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sequences = []
        for _ in range(rng.integers(1, 6)):
            symbols = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40))
            if rng.random() < 0.3 and len(symbols):
                symbols = np.resize(symbols[: rng.integers(1, 4)], len(symbols))
            sequences.append([*symbols.tolist(), 0])
        expected, base = [], 0
        for s in sequences:
            expected += [base + i for i in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
            base += len(s)
        lengths = np.array([len(s) for s in sequences])
        assert suffix_arrays(np.concatenate(sequences), lengths).tolist() == expected


def test_nothing_is_left_behind(spark, table):
    before = {t.name for t in spark.catalog.listTables()}
    dedup.remove_repeats(table([(1, "z" * 60), (2, "z" * 60)])).collect()
    made = {t.name for t in spark.catalog.listTables()} - before
    assert len(made) == 1
    drop_stored(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_runs_of_contents_equal_brute_force(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(dedup, "BATCH_SYMBOLS", 900)
    groups = []
    for _ in range(60):
        pieces = ["".join(rng.choices("ab", k=rng.randint(20, 60))).encode() for _ in range(3)]
        contents = {b"".join(rng.choices(pieces, k=rng.randint(2, 4))) + b"x" * 30 for _ in range(rng.randint(1, 5))}
        groups.append([(c, rng.randrange(100)) for c in sorted(contents)])
    for group, found in zip(groups, dedup.first_documents(groups), strict=True):
        least = {}
        for content, doc in group:
            for i in range(len(content) - dedup.LENGTH + 1):
                window = content[i : i + dedup.LENGTH]
                least[window] = min(doc, least.get(window, doc))
        for (content, _), runs in zip(group, found, strict=True):
            told = [doc for a, b, doc in runs for _ in range(a, b)]
            assert told == [least[content[i : i + dedup.LENGTH]] for i in range(len(content) - dedup.LENGTH + 1)]
            assert [a for a, _, _ in runs] == [0, *(b for _, b, _ in runs[:-1])]


def test_a_very_long_text_and_ties(table):
    long = "".join(chr(97 + i % 23) + str(i) for i in range(400_000))
    found = dedup.remove_repeats(table([(1, long), (2, long), (2, "x" + long[:70])])).collect()
    assert sorted((r.doc_id, r.n_bytes - len(r.kept)) for r in found) == [(1, 0), (2, 70), (2, len(long))]


def test_packed_columns_come_back():
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 2**31 - 1, 50), np.sort(rng.integers(0, 9, 50)), np.arange(50)]
    assert np.array_equal(dedup._unpacked(dedup._packed(*columns), 3), np.stack(columns))
    assert dedup._unpacked(dedup._packed(*[np.zeros(0, np.int64)] * 3), 3).shape == (3, 0)
