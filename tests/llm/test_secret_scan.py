import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from castlist.llm import queries, secret_scan as scan

BASE = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_by_hand(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m.group(2 if kind == "assign" else 0)) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def spans_of(spark, texts, schema="doc_id int, text string"):
    docs = spark.createDataFrame(list(enumerate(texts)), schema)
    rows = scan.scan(docs).collect()
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in rows}


def known(spans):
    return [s for s in spans if not s.startswith("random")]


def noise(rng, n=40):
    bits = [
        "password", "PassWord=", "token", " = ", ":", "'", '"', "api_key", "apikey: ", "abcdefgh", "short", "AKIA", "AKIA" + "Q7" * 6,
        "AKIAAKIA" + "B" * 11, "0123456789abcdef" * 2, "deadbeef" * 3, "🎉", "é", "\n", " ", "passwd='", "secret:", "K9+/=", "ſecret=abcdefghij",
    ]
    return "".join(rng.choices(bits, k=rng.randint(0, n)))


def test_base_spans_equal_those_of_another_engine(spark):
    rng = random.Random(1)
    texts = [noise(rng) for _ in range(300)] + [None, "", "password=token=abcdefgh", 'password: "secret:longvalue123"']
    found = spans_of(spark, texts)
    assert {i: known(s) for i, s in found.items()} == {i: base_by_hand(t) for i, t in enumerate(texts)}


def test_query_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.QUERIES["op13_secret_scan"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for doc in docs:
        wanted, row = base_by_hand(doc.text), rows[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s.startswith(k) for s in wanted) for k in BASE]
        assert known(row.spans.split(",")) == wanted or (row.spans == "" and wanted == [])


def test_many_matches_in_one_text(spark):
    unit = "token=abcdefgh "
    for n in (1, 63, 64, 65, 4096, 4097, 40_000):
        found = spans_of(spark, [unit * n])[0]
        assert found == [f"assign:{15 * k}:{15 * k + 14}" for k in range(n)]


# ---- The battery -----------------------------------------------------------------------


def normal_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_by_hand(key, alphabet):
    n, size = len(key), len(alphabet)
    at = [alphabet.index(c) for c in key]
    chi = lambda square, d: (max(square, 0) / d) ** (1 / 3) / math.sqrt(2 / (9 * d)) - (1 - 2 / (9 * d)) / math.sqrt(2 / (9 * d))
    square = sum(key.count(c) ** 2 for c in alphabet) * size / n - n
    p = [2 * normal_tail(abs(chi(size - 1 + (square - size + 1) * math.sqrt(n / (n - 1)), size - 1)))]
    kinds = [string.digits, string.ascii_lowercase, string.ascii_uppercase]
    cells = []
    for test in (*(lambda c, k=k: c in k for k in kinds), lambda c: not c.isalnum()):
        expected = n * sum(map(test, alphabet)) / size
        if expected:
            cells.append((sum(map(test, key)) - expected) ** 2 / expected)
    p.append(normal_tail(chi(sum(cells), len(cells) - 1)))
    high = [(a + 1) > size / 2 for a in at]
    ones, changes = sum(high), sum(a != b for a, b in zip(high, high[1:]))
    mixed = 2 * ones * (n - ones)
    variance = mixed * (mixed - n) / (n * n * (n - 1))
    p.append(2 * normal_tail(abs((changes - mixed / n) / math.sqrt(variance)) if variance > 0 else scan.FAR))
    x = np.array(at) - np.mean(at)
    r = (x[:-1] * x[1:]).sum() / (x * x).sum() if (x * x).sum() else None
    p.append(2 * normal_tail(abs((r + 1 / n) * math.sqrt(n)) if r is not None else scan.FAR))
    return 1 - (1 - min(*p, 1)) ** 4


def test_p_values_equal_numpy(spark):
    rng = random.Random(3)
    keys = []
    for name, _, alphabet in scan.ENCODINGS:
        for n in (20, 33, 200):
            keys.append((name, "".join(rng.choices(alphabet, k=n)), alphabet))
        keys += [(name, alphabet[0] * 30, alphabet), (name, (alphabet * 3)[:40], alphabet), (name, (alphabet[0] + alphabet[-1]) * 15, alphabet)]
    table = spark.createDataFrame(keys, "name string, key string, abc string")
    rows = table.select("key", "abc", scan.p_value(F.col("key"), F.col("abc")).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(p_by_hand(row.key, row.abc), abs=2e-6), row.key


def test_p_values_of_random_strings_are_spread_evenly(spark):
    rng = random.Random(4)
    for name, _, alphabet in scan.ENCODINGS[:3]:
        keys = [("".join(rng.choices(alphabet, k=64)), alphabet) for _ in range(600)]
        table = spark.createDataFrame(keys, "key string, abc string")
        p = np.array([r.p for r in table.select(scan.p_value(F.col("key"), F.col("abc")).alias("p")).collect()])
        for level in (0.05, 0.2, 0.5):
            assert abs((p <= level).mean() - level) < 0.08, (name, level)


def planted(rng, n=150):
    """Texts with a random key each, and as many with strings that people write."""
    words = "the quick brown fox jumps over lazy dogs while version numbers grow internationally".split()
    b64, hexa = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    texts = []
    for i in range(n):
        key = "".join(rng.choices(b64, k=rng.choice([40, 44, 64]))) if i % 2 else "".join(rng.choices(hexa.upper(), k=40))
        texts.append(" ".join(rng.choices(words, k=20)) + " " + key + " end")
    for i in range(n):
        name = rng.choice([
            "_".join(rng.choices(words, k=4)) + "_v2", "/".join(rng.choices(words, k=5)) + "/2024", "".join(w.title() for w in rng.choices(words, k=4)) + "1",
            "0000000000000000000000a1", "ABABABABABABABABABABABAB12", "abcdefghijklmnopqrstuvwxyz0123456789", "2024-01-02_some_file_name_final",
        ])
        texts.append(f"see {name} for more")
    return texts


def test_random_keys_are_found_and_written_names_left_alone(spark):
    texts = planted(random.Random(5))
    found = spans_of(spark, texts)
    half = len(texts) // 2
    caught = sum(any(s.startswith("random") for s in found[i]) for i in range(half))
    wrong = sum(bool(found[i]) for i in range(half, len(texts)))
    assert caught >= 0.85 * half and wrong <= 0.02 * half, (caught, wrong)
    key = re.search(r"[A-Za-z0-9+/]{40,}", texts[1])
    assert found[1] in ([], [f"random:{key.start()}:{key.end()}"])


def test_false_discovery_cut_equals_the_procedure(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 400])) for c in "abc" for _ in range(60)] + [("d", 0)] * 30 + [("e", 30)]
    found = scan.least_random(spark.createDataFrame(rows, "class string, step int"))
    for c in "abcde":
        steps = [s for name, s in rows if name == c]
        ps = sorted(math.exp(-s / scan.STEPS) for s in steps)
        passed = [p for k, p in enumerate(ps, 1) if p * len(ps) <= scan.RATE * k * (1 + 1e-12)]
        aside = {s for s in steps if passed and math.exp(-s / scan.STEPS) <= max(passed)}
        assert {s for s in steps if s >= found.get(c, 10**6)} == aside


def test_candidates_inside_known_spans_add_nothing(spark):
    key = "Zx9Kq2mVb7Lw4Tn8Rj3Y"
    found = spans_of(spark, [f"token={key}", f"a {key} b", f"AKIA{'ABCDEF2345670000'}"])
    assert found[0] == [f"assign:0:{6 + len(key)}"] and known(found[1]) == [] and all(not s.startswith("random") for s in found[2])


def test_nulls_ids_long_texts_clashing_columns_and_empty_tables(spark):
    rows = [(None, None, 1, "a", 2), (1, "x" * 5_000_000 + " token=abcdefgh", 1, "b", 2), (1, "token=abcdefgh", 1, None, 2), (1, "token=abcdefgh", 1, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, found int, row string, n_hex int")
    out = scan.scan(docs)
    assert out.columns == ["doc_id", "found", "row", *scan.COUNTS, "spans"]
    assert sorted((r.doc_id or 0, r.row or "", r.n_assign, [tuple(s) for s in r.spans]) for r in out.collect()) == [
        (0, "a", 0, []), (1, "", 1, [("assign", 0, 14)]), (1, "", 1, [("assign", 0, 14)]), (1, "b", 1, [("assign", 5_000_001, 5_000_015)])
    ]
    assert scan.scan(docs.limit(0)).count() == 0
    only = spark.createDataFrame([("text",)], "text string")
    assert scan.scan(only).columns == [*scan.COUNTS, "spans"]
