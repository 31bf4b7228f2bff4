import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from castlist.llm import quality


def base_by_hand(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    full = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    n, r = len(words), len(repeated)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(full) - len(set(full)), r, n < 10 or 100 * r > 20 * n


@pytest.mark.parametrize("seed", range(3))
def test_base_statistics_equal_brute_force(table, corpus, seed):
    rows = corpus(seed) + [(900 + i, t) for i, t in enumerate(["# $ | < >" * 4, "a b c d e a b c d e", "x\n\nx\n x\n", "é b " * 9])]
    found = quality.base_statistics(table(rows).withColumnRenamed("lang", "n_words")).collect()
    assert {r.doc_id: tuple(r[c] for c in (*quality.BASE, "base_failed")) for r in found} == {
        d: base_by_hand(t) for d, t in rows
    }


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    root = rng.normal(size=(5, 5))
    scatter, centre, x = root @ root.T + np.eye(5), rng.normal(size=5), rng.normal(size=(20, 5))
    names = {f"m{i}": centre[i] for i in range(5)} | {f"s{i}_{j}": scatter[i, j] for i in range(5) for j in range(i + 1)}
    rows = [{f"x{i}": float(v) for i, v in enumerate(row)} | {k: float(v) for k, v in names.items()} for row in x]
    frame = quality.with_factors(spark.createDataFrame(rows)).select("x0", quality.squared_distance().alias("d"))
    expected = {row[0]: (row - centre) @ np.linalg.inv(scatter) @ (row - centre) for row in x}
    for row in frame.collect():
        assert row.d == pytest.approx(expected[row.x0])


def pick(values, share):
    return np.sort(values)[max(int(np.ceil(share * len(values))), 1) - 1]


def scatter_of(near):
    centre = near.mean(axis=0)
    spread = (near.T @ near) / len(near) - np.outer(centre, centre)
    return centre, quality.CONSISTENT * spread + np.diag(np.array(quality.FLOOR) ** 2)


def concentrated(x, centre, scatter):
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
    return scatter_of(x[d <= pick(d, quality.SHARE)])


def estimates_of(spark, groups):
    rows = [(g, *map(float, row)) for g, x in groups.items() for row in x]
    found = {}
    for r in quality.estimate(spark.createDataFrame(rows, ["g", *quality.VECTOR])).collect():
        lower = np.array([[r[f"l{i}_{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
        found[r.g] = (np.array([r[f"m{i}"] for i in range(5)]), lower @ lower.T)
        assert r.size == len(groups[r.g])
    return found


def test_estimates_rest_and_resist_outliers(spark):
    rng = np.random.default_rng(2)
    clean = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    groups = {
        "far": np.concatenate([clean, rng.normal(50, 1, (60, 5))]),
        "two clusters": np.concatenate([rng.normal(0, 1, (160, 5)), rng.normal(9, 0.1, (40, 5))]),
        "constant": np.ones((60, 5)),
        "single": np.ones((1, 5)),
        "plain": clean,
    }
    found = estimates_of(spark, groups)
    for g, (centre, scatter) in found.items():
        _, after = concentrated(groups[g], centre, scatter)
        assert np.linalg.slogdet(after)[1] >= np.linalg.slogdet(scatter)[1] - quality.RESTS, g
    assert np.linalg.norm(found["far"][0]) < 5 and np.linalg.norm(found["two clusters"][0]) < 2


def test_determinants_against_exhaustive_search_on_small_groups(spark):
    """The least determinant over all subsets of the size that the share asks for.

    Steps from a few starts end in a minimum, which need not be the least; where rows lie apart they must be left
    out all the same, and no single start may end lower.
    """
    groups, least, single, apart = {}, {}, {}, {}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(16, 5)) * (1 + 2 * rng.random(5))
        apart[str(seed)] = seed % 5
        x[: seed % 5] += rng.choice([-15, 15], 5)
        groups[str(seed)] = x
        subsets = (x[list(rows)] for rows in combinations(range(16), 12))
        least[str(seed)] = min(np.linalg.slogdet(scatter_of(s)[1])[1] for s in subsets)
        centre, scatter = scatter_of(x)
        for _ in range(30):
            centre, scatter = concentrated(x, centre, scatter)
        single[str(seed)] = np.linalg.slogdet(scatter)[1]
    estimates = estimates_of(spark, groups)
    found = {g: np.linalg.slogdet(scatter)[1] for g, (_, scatter) in estimates.items()}
    excess = np.array([found[g] - least[g] for g in groups])
    assert (excess > -1e-6).all() and np.median(excess) < 0.1 and excess.max() < 1, excess.round(3).tolist()
    assert np.mean([found[g] <= single[g] + 0.01 for g in groups]) >= 0.9
    for g, (centre, scatter) in estimates.items():
        d = np.einsum("ij,jk,ik->i", groups[g] - centre, np.linalg.inv(scatter), groups[g] - centre)
        assert (d[: apart[g]] > d[apart[g] :].max()).all(), g


def test_estimates_beyond_broadcast_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    groups = {str(g): rng.normal(size=(60, 5)) for g in range(4)}
    few = estimates_of(spark, groups)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 1)
    many = estimates_of(spark, groups)
    assert all(np.allclose(few[g][k], many[g][k]) for g in groups for k in (0, 1))


def test_judgement(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)), "en", f"s{i % 2}") for i in range(140)]
    rows += [(500, " | ".join(rng.choice(words, 80)), "en", "s0"), (501, None, None, None), (502, "few", "en", "s0")]
    rows += [(503, " ".join(rng.choice(words, 80)), None, None), (504, " # ".join(rng.choice(words, 80)), "xx", None)]
    clashing = {name: F.lit("own") for name in ("x0", "g", "row", "m0", "l0_0", "size", "n_full_lines", "_words")}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns(clashing)
    judged = quality.judge(docs)
    assert judged.columns == ["doc_id", "lang", "source", *clashing, *quality.BASE, "base_failed", "distance", "kept"]
    found = {r.doc_id: r for r in judged.collect()}
    assert {found[0][name] for name in clashing} == {"own"}
    assert {d for d, r in found.items() if not r.kept} == {500, 501, 502, 504}
    assert {d for d, r in found.items() if r.base_failed} == {501, 502} and found[501].distance is None
    assert quality.judge(docs.limit(0)).count() == 0


def test_repeated_rows_ties_and_a_very_long_text(spark):
    rows = [("x", "same words here " + " ".join(f"w{i}" for i in range(30)), "en", "s")] * 60
    rows += [(None, " ".join(f"a{i}" for i in range(700_000)), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    found = quality.judge(docs).collect()
    assert sum(r.kept for r in found) == 60 and [r.n_words for r in found if not r.kept] == [700_000]
