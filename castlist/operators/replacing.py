"""Applying name mappings to texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.operators import matching
from castlist.operators.rows import inline_structs
from castlist.operators.skew import ROWS_PER_TASK, heavy_keys
from castlist.session import bounded_batches


# From this many character comparisons on (mappings x text length) an automaton is asked first what can occur; so many
# mappings at once, and as long as it does not read more than that share of the characters that single searches would.
AUTOMATON_WORK = 2_000_000
BATCH = 50_000
WORTH = 1 / 20


class Occurring:
    """Which originals can occur in a text that changes: a superset, kept up to date from what is new.

    An original that occurs was there from the start, or holds a character of a replacement or the seam it left; so after each
    replacement only its surroundings are read again, as far as the longest original reaches.
    """

    def __init__(self, text: str, mappings: tuple[tuple[str, str], ...]):
        self.automaton = ahocorasick.Automaton()
        originals = {original for original, _ in mappings if original}
        for original in originals:
            self.automaton.add_word(original, original)
        self.reach = max(map(len, originals), default=1) - 1
        self.left = len(text) * len(mappings) * WORTH
        self.names: set[str] = set()
        if originals:
            self.automaton.make_automaton()
            self._read(text)

    def _read(self, text: str) -> None:
        self.left -= len(text)
        self.names.update(original for _, original in self.automaton.iter(text))

    def look_again(self, text: str, pieces: list[str], replacement: str) -> bool:
        """Read what is new in a text joined from pieces; False if that is no longer worth it."""
        windows: list[list[int]] = []
        at = 0
        for piece in pieces[:-1]:
            at += len(piece)
            low, high = max(0, at - self.reach), at + len(replacement) + self.reach
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
            at += len(replacement)
        if 2 * sum(high - low for low, high in windows) > len(text):
            windows = [[0, len(text)]]
        for low, high in windows:
            self._read(text[low:high])
        return self.left > 0


def replace_in_turn(text: str, mappings: Iterable[tuple[str, str]]) -> Iterator[tuple]:
    """Apply mappings one after the other, each on the result so far.

    Yields (step, original, n, None) for each, then (number of steps, None,
    total, text). Mappings that cannot occur are not searched for.
    """
    step = total = 0
    for batch in batched(mappings, BATCH):
        occurring = Occurring(text, batch) if len(batch) * len(text) >= AUTOMATON_WORK else None
        for original, replacement in batch:
            step += 1
            if not original:
                raise ValueError("a mapping needs a non-empty original")
            if occurring is not None and original not in occurring.names:
                yield step, original, 0, None
                continue
            # counting and replacing in one search of the text
            pieces = text.split(original)
            n = len(pieces) - 1
            if n:
                text = replacement.join(pieces)
                total += n
                if occurring is not None and not occurring.look_again(text, pieces, replacement):
                    occurring = None
            yield step, original, n, None
    yield step, None, total, text


OUTPUT = {"step": "int", "original": "string", "n": "int", "text": "string"}
STEP = (
    T.StructType().add("step", "integer").add("original", "string").add("n", "integer").add("text", "string")
)
ORDER = ["minus_length", "rank", "original", "replacement"]


@F.arrow_udf(T.ArrayType(STEP))
def _replace_listed(texts: pa.Array, originals: pa.Array, replacements: pa.Array) -> pa.Array:
    kind = pa.struct([(name, matching.ARROW_TYPES[type_]) for name, type_ in OUTPUT.items()])
    rows = zip(texts.to_pylist(), originals.to_pylist(), replacements.to_pylist())
    return pa.array(
        (None if t is None else list(replace_in_turn(t, zip(a or (), b or ()))) for t, a, b in rows),
        pa.list_(kind),
    )


def apply_replacements(
    docs: DataFrame,
    mappings: DataFrame,
    broadcast_bytes: int = matching.BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    carry: tuple[str, ...] = (),
    unmapped: bool = True,
) -> DataFrame:
    """Rows (doc_id, *carry, step, original, n, text) for documents and their mappings.

    ``mappings`` has unique (doc_id, original) with replacement and rank. They
    apply from the longest original (in code points) to the shortest, then by
    rank, original and replacement; each step sees what the steps before it produced. A document yields
    one row per mapping with its count (zeros included) and a closing row with
    ``original`` NULL, the new text, the total and the number of mappings.
    A document without mappings yields its text unchanged, which never leaves
    the JVM, or with ``unmapped`` false nothing. A document whose text is NULL
    yields nothing. ``carry`` names string columns of the documents to keep on
    their rows.

    The steps of one document depend on each other and so run in one task. Those
    of a document with more than rows_per_task of them come as a stream; only
    the texts of such documents are exchanged and sorted for that.
    ``mappings`` is measured first and so read more than once: pass a stored
    table.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", *carry)
    items = mappings.select(
        "doc_id",
        (-F.char_length("original")).alias("minus_length"),
        "rank",
        "original",
        "replacement",
    )
    small = matching.fits_broadcast(items, broadcast_bytes)
    heavy = None if small else heavy_keys(items, "doc_id", rows_per_task)
    if heavy is None:
        return _replace_lists(texts, items, small, carry, unmapped)
    many = heavy.sided(heavy.table.select("doc_id"))

    def fold(text: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        return replace_in_turn(text, ((row[2], row[3]) for row in rows))

    streamed = matching.fold_items(
        texts.join(many, "doc_id", "left_semi"),
        items.join(many, "doc_id", "left_semi"),
        ORDER,
        [F.col(name) for name in ORDER],
        fold,
        OUTPUT,
        carry,
    )
    light = (table.join(many, "doc_id", "left_anti") for table in (texts, items))
    return _replace_lists(*light, small, carry, unmapped).unionByName(streamed)


def _replace_lists(
    texts: DataFrame, items: DataFrame, small: bool, carry: tuple[str, ...], unmapped: bool
) -> DataFrame:
    """The replacements of documents whose mappings fit a list."""
    if not unmapped:
        listed = matching.with_item_lists(texts, items, ORDER, small, "inner")
        applied = _replace_listed("text", F.col("items.original"), F.col("items.replacement"))
        return inline_structs(listed, ["doc_id", *carry], applied, "step")
    listed = matching.with_item_lists(texts, items, ORDER, small)
    mapped = F.col("items").isNotNull()
    unchanged = F.struct(
        F.lit(0).alias("step"),
        F.lit(None).cast("string").alias("original"),
        F.lit(0).alias("n"),
        F.col("text").alias("text"),
    )
    applied = _replace_listed(
        F.when(mapped, F.col("text")), F.col("items.original"), F.col("items.replacement")
    )
    steps = F.when(~mapped & F.col("text").isNotNull(), F.array(unchanged)).otherwise(applied)
    return inline_structs(listed, ["doc_id", *carry], steps, "step")


def replaced_texts(applied: DataFrame) -> DataFrame:
    """Rows (doc_id, *carry, text, n_names, total): the closing rows."""
    closing = applied.where(F.col("original").isNull()).drop("original")
    return closing.withColumnsRenamed({"step": "n_names", "n": "total"})


def replacement_counts(applied: DataFrame) -> DataFrame:
    """Rows (doc_id, step, original, n): count of each mapping at its step."""
    return applied.where(F.col("original").isNotNull()).select("doc_id", "step", "original", "n")


def replacement_summary(counts: DataFrame) -> DataFrame:
    """Rows (doc_id, total, n_names): n_names includes names never found."""
    return counts.groupBy("doc_id").agg(
        F.sum("n").cast("bigint").alias("total"), F.count(F.lit(1)).alias("n_names")
    )


def names_replaced(counts: DataFrame) -> DataFrame:
    """Only the mappings that were found at least once."""
    return counts.where(F.col("n") > 0)
