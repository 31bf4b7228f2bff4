import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from castlist.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def by_hand(rows, min_docs, top):
    """All of the result from (text, lang, source), by dictionaries."""
    docs = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    held = defaultdict(Counter)
    for words, lang, _ in docs:
        held[lang].update(set(words))
    uses, whole = defaultdict(Counter), defaultdict(Counter)
    for words, lang, source in docs:
        kept = [w for w in words if held[lang][w] >= min_docs]
        uses[lang, source].update(kept)
        whole[lang].update(kept)
    share = lambda n, total, kinds: 1 + 10**9 * (n + 2) // (total + 2 * kinds)
    out = []
    for lang, source in uses:
        kinds = sorted(whole[lang])
        p = lambda g, t: share(uses[lang, g][t], uses[lang, g].total(), len(kinds))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(f(p(source, t), p(o, t)) for t in kinds), o) for lg, o in uses if lg == lang and o != source]
        own = []
        for t in kinds:
            a, b = p(source, t), share(whole[lang][t], whole[lang].total(), len(kinds))
            if uses[lang, source][t] and a > b:
                own.append((-f(a, b), t))
        for part, found in (("pair", pairs), ("term", own)):
            ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


def sample(seed, n=80):
    rng = random.Random(seed)
    long = ["w" * 17, "w" * 16, "w" * 18, "é" * 40, "x" * 300, "x" * 299 + "y"]
    bag = ["a", "B", "ab", "né", "NÉ", "漢字", "eightlet", "ninelette", "b" * 15 + "c", *long]
    rows = []
    for _ in range(n):
        text = rng.choice(" .1\n").join(rng.choices(bag, k=rng.randint(0, 25)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), rng.choice(["s", "t", None, "ü"])))
    return [*rows, ("only", "xx", "alone"), (None, "xx", "empty"), *rows[:5]]


def found(spark, rows, *options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(map(tuple, divergence.audit(docs, *options).collect()))


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(1, 3, 10), (2, 1, 2), (3, 10, 1)])
def test_equals_brute_force(spark, seed, min_docs, top):
    rows = sample(seed)
    assert found(spark, rows, min_docs, top) == by_hand(rows, min_docs, top)


def test_blocks_of_sources_parts_of_terms_and_small_pieces(spark, monkeypatch):
    rows = sample(4)
    for name, value in (("BLOCK", 1), ("CELL_ROWS", 7), ("CHUNK", 2), ("PIECE_BYTES", 50), ("MOST_RUNS", 10), ("MOST_LONG_BYTES", 100)):
        monkeypatch.setattr(divergence, name, value)
    # The closures of the tasks see the module as the worker imports it; what is set here counts in this process.
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs, 2, 5).collect())) == by_hand(rows, 2, 5)


def test_counting_in_pieces_is_counting_at_once(monkeypatch):
    import pyarrow as pa

    rows = sample(5)
    batch = pa.RecordBatch.from_arrays([pa.array([c or "" for c in column], pa.string()) for column in zip(*rows)], ["text", "lang", "source"])

    def counted():
        total = defaultdict(lambda: [0, 0])
        for part in divergence._count_batches(iter([batch.slice(0, 30), batch.slice(30)])):
            for lang, source, w0, w1, tail, n, docs in zip(*(c.to_pylist() for c in part.columns)):
                held = total[lang, source, w0, w1, tail]
                held[0] += n
                held[1] += docs
        return dict(total)

    at_once = counted()
    for name, value in (("PIECE_BYTES", 30), ("MOST_RUNS", 4), ("MOST_LONG_BYTES", 40)):
        monkeypatch.setattr(divergence, name, value)
    assert counted() == at_once and len(at_once) > 20


def test_radix_order_is_stable_and_sorts_by_bytes():
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**64, 500, dtype=np.uint64)
    assert divergence.radix_order(first, second // 2**62).tolist() == np.lexsort((second // 2**62, first)).tolist()
    assert divergence.radix_order(np.zeros(0, np.uint64)).tolist() == []


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kinds = 9 * 10**17, 10**18, 12345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kinds)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kinds)


def test_empty_tables_clashing_columns_and_long_text(spark):
    assert found(spark, []) == []
    rows = [("Same word " * 300_000, "en", "a"), ("word", "en", "b")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, p int, item string, value int")
    assert sorted(map(tuple, divergence.audit(docs, 1, 5).collect())) == by_hand(rows, 1, 5)
    assert found(spark, [(None, None, None)]) == []
