"""Removal of lines that many documents share, in DataFrame operations only.

Every text is split at line feeds. The key of a line is the line without white
space at both ends, A-Z in lower case. The lines are exploded with their
positions, their keys are hashed to 128 bits, and the documents of each hash are
counted. Lines of keys that reach the threshold go, everywhere; the others are put
together again in their order.

No text moves for the counting: a document's distinct hashes are found inside
its row, and only hashes are exchanged, partially counted before. Hashes of frequent keys meet the (hash,
document, position) rows in a join whose smaller side is unique, so a key that a third of all
documents hold is split by Spark's skew handling or meets a broadcast whose size Spark has
checked. Texts move once, to meet the positions that go.

Defined results: a null text counts as an empty one, which is a single empty
line; keys shorter than ``min_length`` code points always stay, so with 1 or more
empty lines stay; every row counts as a document of its own, also
where an id is repeated or null. No rows give no rows. Further
columns are kept, whatever their names; only one with the name of a result column is replaced. The work on a text is
linear in its lines, but for sorting their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.llm.common import SPACES, let, lowered, wide_hash


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(SPACES)))


def frequent_keys(docs: DataFrame, min_docs: int, min_length: int) -> DataFrame:
    """(key, n_docs): hashes of the keys found in at least ``min_docs`` documents."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashes = F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_length), wide_hash)
    # Equal hashes are neighbours once sorted; Spark's own distinct would compare every two structs.
    once = let(F.sort_array(hashes), lambda h: F.filter(h, lambda x, i: (i == 0) | (x != F.get(h, i - 1))))
    return (
        docs.select(F.explode(once).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )


def dropped_positions(docs: DataFrame, min_docs: int, min_length: int) -> DataFrame:
    """(doc_id, text_hash, dropped): the ascending positions of the lines that go, where any do.

    Rows of one id and one text are one here, since they lose the same lines.
    """
    # The hash stands in a step of its own, or Spark computes it for every line.
    hashed = docs.select("doc_id", wide_hash(F.col("text")).alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    lines = hashed.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("k"))
    keyed = keyed.where(F.char_length("k") >= min_length)
    keyed = keyed.select("doc_id", "text_hash", "pos", wide_hash(F.col("k")).alias("key"))
    frequent = frequent_keys(docs, min_docs, min_length).select("key")
    return (
        keyed.join(frequent, "key", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    )


def without(lines: Column, dropped: Column) -> Column:
    """The lines but for those at the ascending positions: the slices between them."""

    def between(lines: Column, ends: Column) -> Column:
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(ends) - 1),
            lambda i: F.slice(lines, F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1),
        ))

    # The lines and the bounds are made once, not for every slice.
    return let(lines, lambda ls: let(
        F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(ls))), lambda ends: between(ls, ends)
    ))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """The documents with ``text`` reassembled, and ``n_lines`` and ``n_dropped``."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_positions(docs.select("doc_id", "text"), min_docs, min_length)
    gone = gone.select(F.col("doc_id").alias("gone_id"), "text_hash", "dropped")
    # The columns travel in one, so that no name can clash.
    rows = docs.select(F.struct(*kept).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (wide_hash(F.col("row.text")) == F.col("text_hash"))
    joined = rows.join(gone, same, "left")
    text = F.col("row.text")
    cut = F.concat_ws("\n", without(lines_of(text), F.col("dropped")))
    left = F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)
    return joined.select(
        *(left.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )
