import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers as vocabularies
import pytest
import xxhash
from pyspark.sql import functions as F

from castlist.llm import lm
from castlist.llm.common import wide_hash

PATH = vocabularies.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lm.vocabulary(PATH)


def all_segmentations(pieces, scores, word):
    """The probability of a word, summed over its segmentations one by one."""
    marked = lm.MARK + word
    edges = {}
    for start, end, ids in pieces.edges(marked):
        edges.setdefault(start, []).append((end, math.exp(sum(scores[i] for i in ids))))

    @cache
    def rest(at):
        if at == len(marked):
            return 1.0
        return sum(p * rest(end) for end, p in edges.get(at, []))

    return math.log(rest(0))


@pytest.mark.parametrize("word", ["the", "thndatanth", "né", "漢字🎉x", "\x00\x01", "a" * 40, "ⴰb"])
def test_word_score_is_the_sum_over_segmentations(pieces, word):
    scores = lm.first_scores(PATH).tolist()
    assert lm.word_score(pieces, scores, word) == pytest.approx(all_segmentations(pieces, scores, word))


def test_expected_uses_are_the_slopes_of_the_score(pieces):
    scores = lm.first_scores(PATH).tolist()
    uses = [0.0] * pieces.size
    lm.expected_uses(pieces, scores, "erthndly", 3, uses)
    for i in sorted(range(pieces.size), key=lambda i: -uses[i])[:12]:
        found = []
        for step in (1e-4, -1e-4):
            moved = list(scores)
            moved[i] += step
            found.append(lm.word_score(pieces, moved, "erthndly"))
        assert uses[i] == pytest.approx(3 * (found[0] - found[1]) / 2e-4, rel=1e-3, abs=1e-7)


def test_probabilities_sum_to_one_and_rise(spark, pieces):
    words = spark.createDataFrame([("the", 9), ("thenth", 2), ("né", 1), ("new", 0)], "word string, known long")
    one, many = (lm.fit(words, 4, PATH, rounds) for rounds in (1, 4))
    assert math.exp(one[pieces.end]) > 0 and sum(map(math.exp, many)) == pytest.approx(1)
    score = lambda s: 9 * lm.word_score(pieces, s.tolist(), "the") + 2 * lm.word_score(pieces, s.tolist(), "thenth")
    assert score(many) > score(one)


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_scores_equal_brute_force(table, corpus, pieces, most, monkeypatch):
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (most,))
    rows = corpus(3)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    docs = table(rows).withColumnRenamed("lang", "score")
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    found = {r.doc_id: r for r in lm.score(docs.select("doc_id", "text"), training, PATH, rounds=1).collect()}
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    counts = Counter()
    for d, words in tokens.items():
        counts.update([] if held[d] else words)
    n, v = sum(counts.values()), len(counts)
    uses = [0.0] * pieces.size
    first = lm.first_scores(PATH).tolist()
    for word, times in counts.items():
        if word is not None:
            lm.expected_uses(pieces, first, word.decode(), times, uses)
    uses[pieces.end] += counts[None]
    total = sum(uses) + lm.PRIOR * pieces.size
    scores = [math.log((u + lm.PRIOR) / total) for u in uses]
    for d, words in tokens.items():
        row = found[d]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        own = sum(scores[pieces.end] if w is None else lm.word_score(pieces, scores, w.decode()) for w in words)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(own / math.log(10))


def test_without_training_or_rows(table):
    row = lm.score(table([(1, "a b")]).select("doc_id", "text"), F.lit(False), PATH, 1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)
    assert lm.score(table([]).select("doc_id", "text"), F.lit(True), PATH, 1).count() == 0


def test_uses_by_probabilities_are_those_by_logarithms(pieces):
    scores = lm.first_scores(PATH)
    for word in ("erthndly", "a", "mañana", "x" * lm.SHORT, "thththth"):
        fast, slow = [0.0] * pieces.size, [0.0] * pieces.size
        assert lm.short_uses(pieces, np.exp(scores).tolist(), word, 3, fast)
        lm.expected_uses(pieces, scores.tolist(), word, 3, slow)
        assert fast == pytest.approx(slow, rel=1e-9, abs=1e-12)
    none = [0.0] * pieces.size
    assert not lm.short_uses(pieces, [1e-200] * pieces.size, "abcdefghijkl", 1, none) and not any(none)


def test_hashes_in_tasks_are_sparks(spark):
    words = ["the", "né", "", "x" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(wide_hash(F.col("w")).alias("h")).collect()
    for word, row in zip(words, rows, strict=True):
        digests = [lm._signed(xxhash.xxh64_intdigest(word.encode(), seed)) for seed in (lm.SEED, lm.SECOND_SEED)]
        assert [row.h.a, row.h.b] == digests


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_of_one_id_or_none_are_scored_each_by_itself(spark, most, monkeypatch):
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (most,))
    rows = [("1", "alpha beta", 5, "r"), ("1", "alpha beta", 6, "s"), (None, "alpha beta", 7, None), (None, None, 8, "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, number int, row string")
    found = lm.score(docs, F.lit(True), PATH, 1)
    assert found.columns == ["doc_id", "number", "row", *lm._MADE]
    found = found.collect()
    assert sorted((r.doc_id or "", r.number, r.row or "") for r in found) == [("", 7, ""), ("", 8, "t"), ("1", 5, "r"), ("1", 6, "s")]
    full = [r for r in found if r.number != 8]
    assert {(r.n_tokens, r.n_known) for r in full} == {(3, 3)} and len({round(r.score, 9) for r in full}) == 1


def test_a_very_long_word_and_text(table):
    found = lm.score(table([(1, "x" * 200_000 + " " + "word " * 400_000)]).select("doc_id", "text"), F.lit(True), PATH, 1).first()
    assert found.n_tokens == 400_002 and math.isfinite(found.score)
