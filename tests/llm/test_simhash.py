import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from castlist.llm import simhash
from castlist.llm.components import components


def fingerprint_by_hand(text, size):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 8192), (2, 4)])
def test_components_equal_brute_force(table, corpus, seed, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = corpus(seed, 120)
    found = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in simhash.near_groups(table(rows)).collect()}
    fps = [fingerprint_by_hand(text, 3) for _, text in rows]
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    expected = roots(len(fps), near)
    assert found == {i: (f"{fp:016x}", expected[i]) for i, fp in enumerate(fps)}


@pytest.mark.parametrize("crowd", [8192, 16])
def test_links_of_random_neighbours(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    groups = spark.createDataFrame([(i, bytearray(fp.to_bytes(8, "big"))) for i, fp in enumerate(fps)], "id long, fp binary")
    found = [(r.a, r.b) for r in simhash.links(groups, 3, 4, 8).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in found)
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert roots(len(fps), found) == roots(len(fps), near)


def test_every_allotment_finds_its_radius(spark):
    rng = np.random.default_rng(2)
    sample = [rng.bytes(8) for _ in range(200)]
    for n in (100, 10**6, 10**9):
        parts = simhash.plan(sample, n, 4)
        assert sum(u for _, u in parts) == 4
        bits = sorted(b for part, _ in parts for b in part)
        assert len(bits) == len(set(bits))
    assert simhash.allot([[0, 5, 9], [0, 1, 100], [0, 4, 5]], 4) == (11, [1, 1, 2])


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 16))
    bits[:, 9] = bits[:, 2]
    bits[:, 13] = 1 - bits[:, 2]
    part = next(p for p in simhash.group_bits(bits, 4) if 2 in p)
    assert 9 in part and 13 in part


def test_forest_connects_what_links_do():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    words = (np.repeat(base, 100) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))[:, None]
    edges = simhash.forest(words, 2)
    near = [(i, j) for i, j in combinations(range(300), 2) if (int(words[i, 0]) ^ int(words[j, 0])).bit_count() <= 2]
    assert len(edges) < 300 and roots(300, [e[:2] for e in edges]) == roots(300, near)


def test_null_ids_other_columns_and_empty_tables(table):
    docs = table([(None, "a b c"), (3, "a b c"), (2, "A  b\tc"), (None, "alone here now"), (9, None), (8, "")])
    found = sorted(((r.doc_id or 0, r.component_id or 0) for r in simhash.near_groups(docs).collect()))
    assert found == [(0, 0), (0, 2), (2, 2), (3, 2), (8, 8), (9, 8)]
    assert simhash.near_groups(table([])).count() == 0
    kept = simhash.drop_near_duplicates(docs.withColumnRenamed("lang", "fp"))
    assert kept.columns == ["doc_id", "text", "fp", "source"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 8]
    assert simhash.drop_near_duplicates(table([])).count() == 0


def test_near_copies_go_and_others_stay(table):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, copies, i = [], set(), 0
    for _ in range(40):
        words = rng.choices(vocabulary, k=200)
        rows.append((i, " ".join(words)))
        for _ in range(rng.randint(0, 2)):
            i += 1
            changed = list(words)
            for at in rng.sample(range(200), 2):
                changed[at] = "new"
            rows.append((i, " ".join(changed)))
            copies.add(i)
        i += 1
        # Half of the words are new: no near copy.
        rows.append((i, " ".join(words[:100] + rng.choices(vocabulary, k=100))))
        i += 1
    kept = {r.doc_id for r in simhash.drop_near_duplicates(table(rows)).collect()}
    assert kept == {i for i, _ in rows} - copies


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 150)] + [(200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles_by_hand(text, size=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_in_a_templated_group(table):
    # Any two texts of the template have a Jaccard similarity just under 0.8; hidden among them are pairs just over it.
    rng = random.Random(11)
    template = [f"t{i}" for i in range(220)]
    rows, expected = [], set()
    for g in range(1200):
        words = [*template, *(f"s{g}x{i}" for i in range(rng.randint(29, 30)))]
        rows.append((2 * g, " ".join(words)))
        if g % 20 == 0:
            for i in rng.sample(range(1, 43), 5):
                words[5 * i] = f"c{g}x{i}"
            rows.append((2 * g + 1, " ".join(words)))
            expected.add(2 * g + 1)
    sets = {i: shingles_by_hand(t) for i, t in rows}
    assert all(0.8 <= jaccard(sets[i - 1], sets[i]) < 0.9 for i in expected)
    assert max(jaccard(sets[0], sets[i]) for i in sets if i > 1) < 0.8
    kept = {r.doc_id for r in simhash.drop_near_duplicates(table(rows)).collect()}
    assert {i for i, _ in rows} - kept == expected


@pytest.mark.parametrize(("few", "block", "spread"), [(8, 256, 8192), (2, 3, 20), (0, 4, 0)])
def test_near_copies_equal_brute_force_whatever_the_plan(table, few, block, spread, monkeypatch):
    for name, value in (("FEW", few), ("BLOCK", block), ("SPREAD", spread)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(12)
    template, texts = [f"t{i}" for i in range(30)], [None, "", "one", "One", "two words"]
    while len(texts) < 150:
        words = rng.choice(texts[5:] or [""]).split() if rng.random() < 0.7 else [*template, *rng.choices("abcdefgh", k=rng.randint(5, 80))]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(0, len(words)), f"n{rng.randrange(1000)}")
        texts.append(" ".join(words))
    sets = [shingles_by_hand(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 40
    expected = [i for i, root in enumerate(roots(len(sets), near)) if root == i]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table(list(enumerate(texts)))).collect()) == expected


def test_the_pipeline_follows_links_of_fingerprints(spark, table):
    import corpus_pipeline

    # Few shingles of five words are shared, but the repeated ones decide the fingerprint: only its links find these.
    hum = " ".join(["x y z"] * 60)
    tail = " ".join(f"n{i}" for i in range(25))
    rows = [(4, hum), (7, f"{hum} {tail}"), (9, f"{tail} other words stand here and there at last"), (2, None)]
    linked = {r.doc_id: r.component_id for r in simhash.near_groups(table(rows)).collect()}
    assert linked == {4: 4, 7: 4, 9: 9, 2: 2}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table(rows)).collect()) == [2, 4, 7, 9]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table(rows), "").collect()) == [2, 4, 9]


def test_chains_of_both_kinds_of_links_are_one_group(table):
    hum = " ".join(["x y z"] * 60)
    tail = [f"n{i}" for i in range(25)]
    # 9 links with 5 by its fingerprint, 3 with 5 by shingles alone: its own repeats turn the fingerprint.
    many = " ".join([*tail, *tail, *tail])
    rows = [(9, hum), (5, f"{hum} {' '.join(tail)}"), (3, f"{' '.join(['x y z'] * 2)} {many}"), (1, "quite another text")]
    near = {r.doc_id: r.component_id for r in simhash.near_groups(table(rows)).collect()}
    assert near[9] == near[5] == 5 and near[3] == 3
    plain = sorted(r.doc_id for r in simhash.drop_near_duplicates(table(rows), similarity=0.7).collect())
    assert plain == [1, 3, 9]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table(rows), similarity=0.7, radius=3).collect()) == [1, 3]


def test_near_copies_leave_one_table_and_texts_where_they_are(spark, table, monkeypatch):
    from castlist import session

    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40))) for i in range(30)]
    docs = table(rows)
    session.drop_stored(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.drop_near_duplicates(docs, radius=3)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 2))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        # More ids than are sent to the texts, or none.
        monkeypatch.setattr(simhash, "BROADCAST_IDS", 3)
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, radius=3).collect()) == list(range(0, 30, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert session.drop_stored(spark) == 2


def test_the_sample_for_common_shingles_grows_with_the_documents(table, monkeypatch):
    rows = [(i, f"a b c d e own{i} f{i}") for i in range(300)] + [(i, f"p q r s t new{i}") for i in range(300, 400)]
    monkeypatch.setattr(simhash, "SPREAD", 10)
    first, second = simhash.shingle_hashes(b"a b c d e", 5).view(np.int64)[0], simhash.shingle_hashes(b"p q r s t", 5).view(np.int64)[0]
    monkeypatch.setattr(simhash, "SPREAD_SHARE", 1.0)
    assert simhash.common_shingles(table(rows), 5).tolist() == [second, first]
    # The most frequent ones fit.
    monkeypatch.setattr(simhash, "COMMON", 1)
    monkeypatch.setattr(simhash, "COMMON_DOCS", 1000)
    assert simhash.common_shingles(table(rows), 5).tolist() == [first]


def test_blocks_meet_only_where_near_copies_can_share_enough(spark):
    # Two crowds of sets of 100 that share a token; in the second it is so late that no two of them can be near copies.
    rows = [(t, 20, 100 * t + i, 100, 0 if t == 1 else 15) for t in (1, 2) for i in range(20)]
    crowded = spark.createDataFrame(rows, "token long, crowd long, id long, n int, at int")
    parity = simhash._parities(np.arange(100, dtype=np.int64))
    sketches = spark.createDataFrame([(r[2], 100, parity) for r in rows], "doc_id long, n int, parity binary")
    hopes = simhash.crowd_hopes(crowded, sketches, 0.8).collect()
    assert {r.id for r in hopes} == {100 + i for i in range(20)}
