"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions; the two states of
a position give the probabilities of the languages there, so every position is labelled. A
document's probabilities are the means over all its positions. Whole texts are read: a
text is cut into windows, the last of which may be shorter.

Training is by backpropagation through time in numpy, with Adam, on windows of a bounded
sample: ``PER_LANGUAGE`` documents of each language, those with the smallest hashes
of id and text, each row by itself, and ``WINDOWS`` windows of each, spread over the text. The model is a
few thousand numbers. Inference is narrow: no row is exchanged.

Defined results: a text without a letter, and a null text, is ``und`` with score 0; documents
with a null language are not learned from; without any document to learn from every text is ``und``.
Ties go to the language that sorts first. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 200
WINDOWS = 8
STEPS = 250
BATCH = 256
RATE = 0.02
# How many windows run through the network together.
LANES = 4096

_HAS_LETTER = "\\p{L}"


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight lines: 0 below -2, 1 above 2."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return np.where((y > 0) & (y < 1), np.float32(0.25), np.float32(0))


@dataclass
class Model:
    """Weights of two directions (0 forward, 1 backward) and of the output; states are columns."""

    languages: list[str]
    inputs: np.ndarray  # direction, byte, 3 x hidden: update, reset, candidate
    states: np.ndarray  # direction, 3 x hidden, hidden
    output: np.ndarray  # language, 2 x hidden + 1

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.output]


def new_model(languages: list[str], hidden: int, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    return Model(
        languages,
        rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        rng.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(np.float32),
        np.zeros((len(languages), 2 * hidden + 1), np.float32),
    )


def _run(model: Model, data: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, lane) for bytes (time, lane)."""
    steps, lanes = data.shape
    hidden = model.states.shape[2]
    table = np.ascontiguousarray(model.inputs[direction].T)
    gates_u, candidate_u = model.states[direction][: 2 * hidden], model.states[direction][2 * hidden :]
    h = np.zeros((hidden, lanes), np.float32)
    out = np.empty((steps, hidden, lanes), np.float32)
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        x = table[:, data[t]]
        gates = _gate(x[: 2 * hidden] + gates_u @ h)
        update, reset = gates[:hidden], gates[hidden:]
        kept = reset * h
        candidate = np.tanh(x[2 * hidden :] + candidate_u @ kept)
        if keep is not None:
            keep.append((t, h, gates, kept, candidate))
        h = h + update * (candidate - h)
        out[t] = h
    return out


def position_probabilities(model: Model, data: np.ndarray) -> np.ndarray:
    """(time, language, lane): the label probabilities of every position."""
    hidden = model.states.shape[2]
    forward, backward = _run(model, data, 0), _run(model, data, 1)
    scores = model.output[:, :hidden] @ forward
    scores += model.output[:, hidden : 2 * hidden] @ backward
    scores += model.output[:, 2 * hidden, None]
    np.exp(scores - scores.max(axis=1, keepdims=True), out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(model: Model, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions, and its gradients, through time."""
    steps, lanes = data.shape
    hidden = model.states.shape[2]
    kept_by: list[list] = [[], []]
    states = [_run(model, data, d, kept_by[d]) for d in (0, 1)]
    both = np.concatenate([*states, np.ones((steps, 1, lanes), np.float32)], axis=1)
    scores = model.output @ both
    scores -= scores.max(axis=1, keepdims=True)
    probabilities = np.exp(scores)
    probabilities /= probabilities.sum(axis=1, keepdims=True)
    lane = np.arange(lanes)
    loss = -float(np.log(np.maximum(probabilities[:, labels, lane], 1e-30)).mean())
    error = probabilities / np.float32(steps * lanes)
    error[:, labels, lane] -= np.float32(1 / (steps * lanes))
    d_output = np.einsum("tlb,thb->lh", error, both, optimize=True)
    d_states = model.output.T[: 2 * hidden] @ error
    d_inputs, d_weights = np.zeros_like(model.inputs), np.zeros_like(model.states)
    for d in (0, 1):
        u = model.states[d]
        carry = np.zeros((hidden, lanes), np.float32)
        for t, h, gates, kept, candidate in reversed(kept_by[d]):
            update, reset = gates[:hidden], gates[hidden:]
            dh = carry + d_states[t, d * hidden : (d + 1) * hidden]
            d_candidate = dh * update * (1 - candidate * candidate)
            d_kept = u[2 * hidden :].T @ d_candidate
            d_gates = np.concatenate([dh * (candidate - h), d_kept * h]) * _gate_slope(gates)
            carry = dh * (1 - update) + d_kept * reset + u[: 2 * hidden].T @ d_gates
            d_x = np.concatenate([d_gates, d_candidate])
            d_weights[d, : 2 * hidden] += d_gates @ h.T
            d_weights[d, 2 * hidden :] += d_candidate @ kept.T
            np.add.at(d_inputs[d], data[t], d_x.T)
    return loss, [d_inputs, d_weights, d_output]


def train(
    data: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS
) -> Model:
    """Fit a model to windows (window, time) of bytes with their labels, by Adam."""
    model, rng = new_model(languages, hidden), np.random.default_rng(2)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        picked = rng.integers(0, len(data), min(BATCH, len(data)))
        _, slopes = gradients(model, data[picked].T, labels[picked])
        rate = RATE * (1 - (step - 1) / steps)
        for p, g, m, v in zip(model.parameters(), slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def sample_windows(texts: list[str], labels: list[int], window: int = WINDOW, most: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` windows of each text, evenly spread; short texts are repeated to fill one."""
    data, owners = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            continue
        if len(raw) < window:
            raw = np.resize(raw, window)
        n = min(most, len(raw) // window)
        for start in np.linspace(0, len(raw) - window, n).astype(int):
            data.append(raw[start : start + window])
            owners.append(label)
    return np.array(data, np.uint8).reshape(-1, window), np.array(owners, np.int64)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the languages of the documents (doc_id, text, lang); None if there are none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(_HAS_LETTER))
    # A row is picked by itself, whatever ids repeat: the first rows by id, then by text. Spark cuts each task's
    # rows to the first places before it exchanges them, and only hashes are exchanged.
    key = ["lang", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.xxhash64(F.lit(1), "text").alias("c")]
    order = Window.partitionBy("lang").orderBy("a", "b", "c")
    picked = usable.select(*key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    # Equal rows are one, counted; so the table has per_language rows of each language at most.
    picked = picked.groupBy("lang", "a", "b", "c").agg(F.count("*").alias("n"))
    texts = usable.select(*key, "text").join(F.broadcast(picked), ["lang", "a", "b", "c"])
    pieces = texts.groupBy("lang", "a", "b", "c").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    # Bounded: per_language documents of each language, a few windows of each.
    cut = pieces.select("lang", "a", "b", "n", "text").mapInArrow(_cut, "lang string, a long, b long, n long, window binary")
    rows = sorted((row.lang, row.a, row.b, bytes(row.window), row.n) for row in cut.collect())
    if not rows:
        return None
    languages = sorted({lang for lang, *_ in rows})
    times = [row[-1] for row in rows]
    data = np.frombuffer(b"".join(w for *_, w, _ in rows), np.uint8).reshape(len(rows), WINDOW).repeat(times, axis=0)
    labels = np.repeat([languages.index(lang) for lang, *_ in rows], times)
    return train(data, labels, languages)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, owners = sample_windows(batch.column("text").to_pylist(), list(range(len(batch))))
        windows = pa.array([w.tobytes() for w in data], pa.binary())
        yield batch.drop_columns(["text"]).take(pa.array(owners)).append_column("window", windows)


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """(text, language): the mean over all positions of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    # Full windows of all texts side by side, then the shorter last ones by their length.
    groups: dict[int, list] = {}
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        full = len(raw) // WINDOW
        if full:
            groups.setdefault(WINDOW, []).append((i, raw[: full * WINDOW].reshape(full, WINDOW)))
        if len(raw) % WINDOW:
            groups.setdefault(len(raw) % WINDOW, []).append((i, raw[None, full * WINDOW :]))
    for _, members in sorted(groups.items()):
        data = np.concatenate([rows for _, rows in members])
        owners = np.repeat([i for i, _ in members], [len(rows) for _, rows in members])
        for at in range(0, len(data), LANES):
            part = np.ascontiguousarray(data[at : at + LANES].T)
            pooled = position_probabilities(model, part).sum(axis=0, dtype=np.float64)
            np.add.at(sums, owners[at : at + LANES], pooled.T)
    return sums / np.maximum(lengths, 1)[:, None]


def judge(model: Model | None, text: Column) -> Column:
    """A struct (lang_pred, score) of a text."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(texts: pa.Array, letters: pa.Array) -> pa.Array:
        names, scores = [], []
        shown = letters.to_pylist()
        for at, until in _strips(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            raw = [(t or "").encode() for t in texts.slice(at, until - at).to_pylist()]
            for k, row in enumerate(document_probabilities(model, raw)):
                best = int(row.argmax())
                names.append(model.languages[best] if shown[at + k] else UNKNOWN)
                scores.append(min(1.0, float(row[best])) if shown[at + k] else 0.0)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
        )

    return judged(text, F.coalesce(text.rlike(_HAS_LETTER), F.lit(False)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred and score, from their text alone; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # The other columns travel in one, so that no name can clash.
    judged = docs.select(F.struct(*kept).alias("row"), judge(model, F.col("text")).alias("judged"))
    return judged.select(*(F.col("row")[c].alias(c) for c in kept), "judged.lang_pred", "judged.score")


def _strips(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``limit`` bytes."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.35) -> DataFrame:
    """The documents, all columns as they are, without those of no language or with a score below ``least``."""
    judged = docs.select(F.struct(*docs.columns).alias("row"), judge(model, F.col("text")).alias("judged"))
    sure = judged.where((F.col("judged.lang_pred") != UNKNOWN) & (F.col("judged.score") >= least))
    return sure.select(*(F.col("row")[c].alias(c) for c in docs.columns))
