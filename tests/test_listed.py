import random

import pytest

from castlist.operators import listed


def by_hand(texts, names):
    wanted = {n.strip() for n in names if n and n.strip()}
    return sorted((i, n, t.count(n)) for i, t in texts if t for n in wanted if n in t)


def found(spark, texts, names, **options):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return sorted(map(tuple, listed.count_listed(docs, rows, **options).collect()))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_bytes", [7, listed.BLOCK_BYTES])
def test_equals_search_of_each_name(spark, seed, block_bytes):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choices("ab🎉", k=rng.randint(1, most)))
    texts = [(i, word(60)) for i in range(20)] + [(90, ""), (91, None), (92, "a" * 3000)]
    names = [word(5) for _ in range(12)] + ["aa", "aba", " aa ", "", "  ", None]
    assert found(spark, texts, names, block_bytes=block_bytes) == by_hand(texts, names)


def test_pieces_of_long_texts(spark, monkeypatch):
    names = ["anan", "nana", "n", "banana" * 4]
    text = "banana" * 50 + "x" + "anan" * 31
    block = listed.Block(names)
    whole = block.counts(text)
    monkeypatch.setattr(listed, "PIECE", 10)
    assert listed.Block(names).counts(text) == whole == {k: text.count(n) for k, n in enumerate(names)}
    monkeypatch.setattr(listed, "PIECE", 7)
    plain = listed.Block(["ab", "b"])
    assert plain.counts("ab" * 30) == {0: 30, 1: 30}


@pytest.mark.parametrize(("name", "expected"), [("anan", True), ("aa", True), ("a", False), ("abc", False), ("abcab", True), ("", False)])
def test_overlaps_itself(name, expected):
    assert listed.overlaps_itself(name) is expected


def test_nothing_to_count(spark):
    assert found(spark, [(1, "text")], []) == found(spark, [(1, "text")], [None, " "]) == []
    assert found(spark, [], ["a"]) == []


def test_any_type_of_id_and_totals(spark):
    docs = spark.createDataFrame([("x", "Anna Anna"), ("y", "Anna"), (None, "Bert")], "doc_id string, text string")
    names = spark.createDataFrame([("Anna",), ("Bert",), ("Carl",)], "name string")
    counts = listed.count_listed(docs, names)
    assert {(r.doc_id, r.name, r.occurrences) for r in counts.collect()} == {("x", "Anna", 2), ("y", "Anna", 1), (None, "Bert", 1)}
    assert {tuple(r) for r in listed.listed_totals(counts).collect()} == {("Anna", 2, 3), ("Bert", 1, 1)}
