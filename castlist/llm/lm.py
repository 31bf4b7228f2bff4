"""Language-model scores by a subword lattice.

The model draws pieces of an existing vocabulary one by one until it draws the end. A word's lattice has an
edge for every piece that fits at a position; a forward recursion in log space sums over all paths,
so a text's score is its marginal probability over all segmentations, not that of the best one.
Pieces do not cross words, so a text's score is the sum of its words' scores and the end's.

The vocabulary comes with ranks. Their Zipf weights are the first scores; expectation
maximisation over the words of the training documents, ``ROUNDS`` times, turns them into probabilities: the expected uses of each
piece in all segmentations of all words, plus ``PRIOR``, over their sum. A character that no piece holds is spelled in byte pieces.

Words are lower-cased in A-Z and preceded by the vocabulary's mark of a word's begin.

What moves: each different word of the corpus with its counts (partially aggregated) once; every other step on
words is on that table, stored in the shared folder. The ``FREQUENT`` most frequent words go to
all tasks with their scores; of a document's other words only hashes go out to meet theirs, so no word that is in
many documents is a join key. The table of piece probabilities is as long as the vocabulary.

Defined results: a null text is an empty one, of the end alone; rows are scored each by itself,
whatever ids repeat or are null, since what belongs to a row meets by its number; with no training documents counts are 0
and the base uses N = V = 0. Words meet their counts by 128-bit hashes. Further columns are kept, one with the name of a
result column is replaced. The vocabulary file is read on every executor at ``path``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.llm.common import SPACES, lowered, wide_hash
from castlist.session import cut_lineage

MARK = "▁"
ROUNDS = 2
PRIOR = 0.1
ZIPF_SHIFT = 100
FREQUENT = 100_000
# The expected uses of pieces in words up to this long are summed as probabilities, which are not too small there.
SHORT, TINY = 24, 1e-250
# The seeds of Spark's xxhash64 of a word, and of 1 and a word.
SEED = 42
SECOND_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), SEED)
_NONE = -math.inf


class Vocabulary:
    """The pieces of a vocabulary file: an automaton over those made of text, and those of single bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.end = model.eos_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        self.characters = set()
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.automaton.add_word(piece, (len(piece), i))
                if len(piece) == 1:
                    self.characters.add(piece)
        self.automaton.make_automaton()

    def edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, pieces) of the lattice of a marked word, by end."""
        found = [(e + 1 - size, e + 1, (i,)) for e, (size, i) in self.automaton.iter(word)]
        if self.characters.issuperset(word):
            return found
        spelled = [
            (k, k + 1, tuple(self.bytes[b] for b in c.encode()))
            for k, c in enumerate(word)
            if c not in self.characters
        ]
        return sorted(found + spelled, key=lambda edge: edge[1])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def first_scores(path: str) -> np.ndarray:
    """Natural logarithms of Zipf weights by the rank of each piece."""
    words = vocabulary(path)
    weights = 1.0 / (np.arange(words.size) + ZIPF_SHIFT)
    return np.log(weights / weights.sum())


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == _NONE else a + math.log1p(math.exp(b - a))


def word_score(words: Vocabulary, scores: list[float], word: str) -> float:
    """The logarithm of the probability of all segmentations of a word."""
    marked = MARK + word
    if words.characters.issuperset(marked):
        # The automaton gives the edges by their ends, so what comes before is complete.
        alpha = [0.0] + [_NONE] * len(marked)
        for e, (size, i) in words.automaton.iter(marked):
            x, y = alpha[e + 1 - size] + scores[i], alpha[e + 1]
            if y == _NONE:
                alpha[e + 1] = x
            elif x < y:
                alpha[e + 1] = y + math.log1p(math.exp(x - y))
            else:
                alpha[e + 1] = x + math.log1p(math.exp(y - x))
        return alpha[-1]
    alpha = [0.0] + [_NONE] * len(marked)
    for start, end, pieces in words.edges(marked):
        alpha[end] = _log_add(alpha[end], alpha[start] + sum(scores[i] for i in pieces))
    return alpha[-1]


def expected_uses(words: Vocabulary, scores: list[float], word: str, times: float, uses: list[float]) -> None:
    """Add how often each piece is used in all segmentations of a word, ``times`` over."""
    marked = MARK + word
    edges = words.edges(marked)
    alpha = [0.0] + [_NONE] * len(marked)
    beta = [_NONE] * len(marked) + [0.0]
    weights = []
    for start, end, pieces in edges:
        weight = scores[pieces[0]] if len(pieces) == 1 else sum(scores[i] for i in pieces)
        weights.append(weight)
        alpha[end] = _log_add(alpha[end], alpha[start] + weight)
    # From the last end to the first: the edges that leave an end have later ends, so it is complete.
    for (start, end, _), weight in zip(reversed(edges), reversed(weights), strict=True):
        beta[start] = _log_add(beta[start], beta[end] + weight)
    total = alpha[-1]
    for (start, end, pieces), weight in zip(edges, weights, strict=True):
        share = times * math.exp(alpha[start] + weight + beta[end] - total)
        for i in pieces:
            uses[i] += share


def short_uses(words: Vocabulary, chances: list[float], word: str, times: float, uses: list[float]) -> bool:
    """``expected_uses`` by probabilities; False, and nothing added, if these would be too small or the word is spelled in bytes."""
    marked = MARK + word
    if not words.characters.issuperset(marked):
        return False
    alpha = [1.0] + [0.0] * len(marked)
    edges = []
    for e, (size, i) in words.automaton.iter(marked):
        alpha[e + 1] += alpha[e + 1 - size] * chances[i]
        edges.append((e + 1 - size, e + 1, i))
    if alpha[-1] < TINY:
        return False
    beta = [0.0] * len(marked) + [1.0]
    share = times / alpha[-1]
    for start, end, i in reversed(edges):
        after = chances[i] * beta[end]
        beta[start] += after
        uses[i] += share * alpha[start] * after
    return True


# ---- The corpus -------------------------------------------------------------------------


def corpus_words(docs: DataFrame, training: Column) -> DataFrame:
    """(word, uses, known): every different word, how often it occurs, and how often in training documents."""
    split = F.split(lowered(F.coalesce("text", F.lit(""))), f"[{SPACES}]+")
    tokens = docs.select(training.alias("_training"), F.explode(split).alias("word")).where("word <> ''")
    return tokens.groupBy("word").agg(
        F.count("*").alias("uses"), F.count_if("_training").alias("known")
    )


def fit(words: DataFrame, n_texts: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Logarithms of the piece probabilities, from the words (word, known) of ``n_texts`` training texts."""
    scores = first_scores(path)
    learned = words.where("known > 0").select("word", "known")
    for _ in range(rounds):
        given = scores.tolist()

        def run(batches: Iterator[pa.RecordBatch], given: list[float] = given) -> Iterator[pa.RecordBatch]:
            pieces, chances = vocabulary(path), np.exp(given).tolist()
            uses = [0.0] * pieces.size
            for batch in batches:
                for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if len(word) > SHORT or not short_uses(pieces, chances, word, times, uses):
                        expected_uses(pieces, given, word, times, uses)
            found = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(np.array(uses)[found], pa.float64())], ["piece", "uses"]
            )

        sums = learned.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        total = np.full(len(scores), PRIOR)
        for row in sums.collect():
            total[row.piece] += row.uses
        total[vocabulary(path).end] += n_texts
        scores = np.log(total / total.sum())
    return scores


def scored_words(words: DataFrame, scores: np.ndarray, path: str) -> DataFrame:
    """(word, a, b, uses, known, score): the words, hashed, with the base-10 logarithm of their probability."""
    given = scores.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            found = [word_score(pieces, given, w) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    rows = words.select("word", wide_hash(F.col("word")).alias("hash"), "uses", "known").select("word", "hash.*", "uses", "known")
    return rows.mapInArrow(run, "word string, a long, b long, uses long, known long, score double")


def frequent_words(words: DataFrame, most: int = FREQUENT) -> dict[bytes, tuple[int, float]]:
    """(known, score) of the words of highest use, no more than ``most`` of them."""
    level = F.floor(F.log2("uses") * 8).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for row in sorted(levels, key=lambda r: -r.level):
        total += row.n
        if total > most:
            break
        least = row.level
    if least is None:
        return {}
    rows = words.where(level >= least).select("word", "known", "score").collect()
    return {row.word.encode(): (row.known, row.score) for row in rows}


_MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_FIRST = "row {}, n_tokens long, n_known long, base double, score double, rare array<struct<a:long,b:long,n:int>>"


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def score(docs: DataFrame, training: Column, path: str, rounds: int = ROUNDS) -> DataFrame:
    """All columns but ``text`` of documents with a text, and n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says which of them the counts and the model are learned from. The base is the
    score of the words' own frequencies, with one half added to each count.
    """
    counted = cut_lineage(corpus_words(docs, training))
    n_texts = docs.where(training).count()
    n, distinct = counted.agg(
        F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.count_if(F.col("known") > 0), F.lit(0))
    ).first()
    n += n_texts
    distinct += 1 if n_texts else 0
    base_total = n + 0.5 * (distinct + 1)
    scores = fit(counted, n_texts, path, rounds)
    words = cut_lineage(scored_words(counted, scores, path))
    frequent = {
        word: (known > 0, math.log10((known + 0.5) / base_total), value)
        for word, (known, value) in frequent_words(words).items()
    }
    end_base = math.log10((n_texts + 0.5) / base_total)
    end_score = float(scores[vocabulary(path).end]) / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                uses = Counter(text.as_py().encode().lower().split())
                known, base, value, rare = int(n_texts > 0), end_base, end_score, []
                for word, times in uses.items():
                    found = frequent.get(word)
                    if found is None:
                        digests = (xxhash.xxh64_intdigest(word, seed) for seed in (SEED, SECOND_SEED))
                        rare.append((*map(_signed, digests), times))
                    else:
                        known += times if found[0] else 0
                        base += times * found[1]
                        value += times * found[2]
                rows.append((uses.total() + 1, known, base, value, rare))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            triples = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), triples]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["row", "n_tokens", "n_known", "base", "score", "rare"],
            )

    # The other columns travel in one, so that no name can clash.
    kept = [c for c in docs.columns if c not in ("text", *_MADE)]
    given = docs.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    first = given.mapInArrow(run, _FIRST.format(given.schema["row"].dataType.simpleString()))
    first = cut_lineage(first.withColumn("number", F.monotonically_increasing_id()))
    rare = first.select("number", F.inline("rare")).join(words.select("a", "b", "known", "score"), ["a", "b"])
    rest = rare.groupBy("number").agg(
        F.sum(F.when(F.col("known") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("known") + 0.5) / base_total)).alias("more_base"),
        F.sum(F.col("n") * F.col("score")).alias("more_score"),
    )
    joined = first.drop("rare").join(rest, "number", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        *(F.col("row")[c].alias(c) for c in kept),
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )
