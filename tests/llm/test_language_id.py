import math

import numpy as np
import pytest

from castlist.llm import language_id as lid
from castlist.llm import queries


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = lid.new_model(["a", "b", "c"], 3)
    model.output[:] = rng.normal(0, 0.5, model.output.shape)
    for name in ("inputs", "states", "output"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    data, labels = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, slopes = lid.gradients(model, data, labels)
    for p, slope in zip(model.parameters(), slopes, strict=True):
        for at in np.argsort(-np.abs(slope).ravel())[:6]:
            old = p.flat[at]
            losses = []
            for step in (1e-3, -1e-3):
                p.flat[at] = old + step
                losses.append(lid.gradients(model, data, labels)[0])
            p.flat[at] = old
            assert slope.flat[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=1e-4)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd "), 300)) for _ in range(20)] + ["".join(rng.choice(list("efgh "), 300)) for _ in range(20)]
    data, labels = lid.sample_windows(texts, [0] * 20 + [1] * 20)
    return lid.train(data, labels, ["one", "two"], steps=60)


def test_every_position_is_labelled_and_pooled(model):
    data = np.frombuffer(b"abcd" * 16, np.uint8)[:, None]
    labels = lid.position_probabilities(model, data)
    assert labels.shape == (64, 2, 1) and np.allclose(labels.sum(axis=1), 1, atol=1e-5)
    # Whole texts count, in windows, and the last one is shorter.
    text = b"abcd " * 100 + b"efgh " * 7
    windows = [text[i : i + lid.WINDOW] for i in range(0, len(text), lid.WINDOW)]
    by_hand = sum(
        lid.position_probabilities(model, np.frombuffer(w, np.uint8)[:, None]).sum(axis=(0, 2)) for w in windows
    ) / len(text)
    assert np.allclose(lid.document_probabilities(model, [b"", text])[1], by_hand, atol=1e-4)


def test_predictions_nulls_and_clashing_columns(table, model):
    rows = [(1, "abcd abcd dcba"), (2, "efgh hgfe " * 2000), (3, None), (4, ""), (5, "12 ,. 3"), (None, "abba"), (1, "abcd abcd dcba")]
    docs = table(rows).withColumnRenamed("source", "score")
    found = lid.predict(docs, model)
    assert sorted(found.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    got = [(r.doc_id, r.lang_pred) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, "one"), (2, "two"), (3, "und"), (4, "und"), (5, "und"), (None, "one"), (1, "one")], key=str)
    assert all(0 <= r.score <= 1 for r in found.collect())
    kept = lid.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2]
    assert lid.predict(table([]), model).count() == 0


def naive_network(model, text):
    """The label probabilities of each byte of a window, one number at a time."""
    gate = lambda x: min(max(x / 4 + 0.5, 0), 1)
    hidden, states = model.states.shape[2], []
    for d in (0, 1):
        h, own = [0.0] * hidden, {}
        for t in range(len(text)) if d == 0 else range(len(text) - 1, -1, -1):
            x, u = model.inputs[d][text[t]], model.states[d]
            dot = lambda row, v: sum(float(a) * b for a, b in zip(row, v))
            update = [gate(float(x[i]) + dot(u[i], h)) for i in range(hidden)]
            kept = [gate(float(x[hidden + i]) + dot(u[hidden + i], h)) * h[i] for i in range(hidden)]
            new = [math.tanh(float(x[2 * hidden + i]) + dot(u[2 * hidden + i], kept)) for i in range(hidden)]
            h = [(1 - z) * a + z * b for z, a, b in zip(update, h, new)]
            own[t] = h
        states.append(own)
    out = []
    for t in range(len(text)):
        scores = [math.exp(sum(float(a) * b for a, b in zip(row, [*states[0][t], *states[1][t], 1.0]))) for row in model.output]
        out.append([s / sum(scores) for s in scores])
    return out


def test_pooled_probabilities_equal_a_naive_network(model):
    for text in (b"a", b"abcd efgh", b"ab" * 40 + b"gh" * 35, "né 漢字".encode() * 9):
        windows = [text[i : i + lid.WINDOW] for i in range(0, len(text), lid.WINDOW)]
        rows = [row for w in windows for row in naive_network(model, w)]
        wanted = np.mean(rows, axis=0)
        assert np.allclose(lid.document_probabilities(model, [text])[0], wanted, atol=1e-4)


def test_learning_is_bounded_whatever_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lid, "train", lambda data, labels, languages: seen.append((len(data), languages)))
    rows = [(7, f"text number {i} with letters " * 30, "en") for i in range(300)] + [(None, "same text " * 90, "de")] * 300
    lid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"), per_language=20)
    assert seen == [(2 * 20 * lid.WINDOWS, ["de", "en"])]


def test_columns_named_like_the_result_are_kept(spark, model):
    docs = spark.createDataFrame([(1, "abcd abcd", 7.5, "mine", "row")], "doc_id int, text string, score double, lang_pred string, judged string")
    assert [tuple(r) for r in lid.keep_identified(docs, model).collect()] == [(1, "abcd abcd", 7.5, "mine", "row")]


def test_nothing_to_learn_from(table):
    docs = table([(1, "abc", None), (2, "12", "en"), (3, None, "en")])
    assert lid.fit(docs) is None
    assert {(r.lang_pred, r.score) for r in lid.predict(docs, None).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op9_language_id"](spark, folder).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == true[r.doc_id] for r in rows) / len(rows) > 0.97
