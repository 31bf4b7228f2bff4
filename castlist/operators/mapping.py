"""The mapping table: ranked names of a document and their replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castlist.functions.text import strip
from castlist.operators.skew import ROWS_PER_TASK, HeavyKeys, heavy_keys
from castlist.session import cut_lineage

# A range of a heavy document's rows has at least as many: fewer are not worth a task and a file, and for every range Spark
# collects a hundred rows to place the bounds by.
LEAST_RANGE = 100_000


def label(name: Column, occurrences: Column) -> Column:
    """How a row is shown: ``name (count)``."""
    return F.concat(name, F.lit(" ("), occurrences.cast("string"), F.lit(")"))


def rank_names(
    names: DataFrame, counts: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows (doc_id, name, occurrences, rank), rank 1 first.

    By count descending, then name by code point. Names without a count have
    zero. The names of a document with more than rows_per_task of them are
    sorted by several tasks. Reads its input once more to look for such
    documents, so pass a stored table.
    """
    if counts is not None:
        names = names.select("doc_id", "name").join(
            counts.select("doc_id", "name", "occurrences"), ["doc_id", "name"], "left"
        )
    rows = names.select(
        "doc_id", "name", F.coalesce("occurrences", F.lit(0)).cast("int").alias("occurrences")
    )
    heavy = heavy_keys(rows, "doc_id", rows_per_task)
    if heavy is None:
        return rows.withColumn("rank", F.row_number().over(_in_order("doc_id")))
    return _rank_split(rows, heavy, rows_per_task)


def top_names(counts: DataFrame, k: int) -> DataFrame:
    """The k best-ranked rows per document.

    The rank filter sits right on the window, so Spark keeps only k rows per
    document in each task before the shuffle; no document needs splitting.
    """
    rows = counts.select("doc_id", "name", F.col("occurrences").cast("int").alias("occurrences"))
    return rows.withColumn("rank", F.row_number().over(_in_order("doc_id"))).where(
        F.col("rank") <= k
    )


def _in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("occurrences"), F.asc("name"))


def _rank_split(rows: DataFrame, heavy: HeavyKeys, rows_per_task: int) -> DataFrame:
    """Exact ranks, with the rows of heavy documents in ranges of their order.

    The rows are range-partitioned by document, count and name, into as many ranges as the rows of all heavy documents
    fill; several documents may share one. Where Spark's sample puts the bounds affects only how even the ranges are,
    so the ranges are stored once: the rank is the place in the range plus the sizes of the
    document's ranges before it.
    """
    many = heavy.sided(heavy.table.select("doc_id"))
    light = rows.join(many, "doc_id", "left_anti")
    ranked = light.withColumn("rank", F.row_number().over(_in_order("doc_id")))
    total = heavy.table.agg(F.sum("size")).first()[0]
    n_ranges = -(-total // max(rows_per_task, LEAST_RANGE))
    ranged = cut_lineage(in_ranges(rows.join(many, "doc_id", "left_semi"), n_ranges))
    sizes = ranged.groupBy("doc_id", "range_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("range_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "doc_id", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    local = ranged.withColumn("place", F.row_number().over(_in_order("doc_id", "range_no")))
    split = local.join(offsets, ["doc_id", "range_no"]).select(
        "doc_id", "name", "occurrences", (F.col("place") + F.col("offset")).cast("int").alias("rank")
    )
    return ranked.unionByName(split)


def in_ranges(rows: DataFrame, n_ranges: int) -> DataFrame:
    """The rows with ``range_no``, which never decreases along a document's order."""
    ranged = rows.repartitionByRange(n_ranges, "doc_id", F.desc("occurrences"), F.asc("name"))
    return ranged.withColumn("range_no", F.spark_partition_id())


def name_rows(ranked: DataFrame) -> DataFrame:
    """The mapping table of ranked names; replacements start empty."""
    return ranked.select(
        "doc_id",
        F.col("name").alias("original"),
        F.lit("").alias("replacement"),
        F.col("occurrences").alias("occurrence_count"),
        "rank",
    )


def apply_edits(rows: DataFrame, edits: DataFrame, order: str = "edit_no") -> DataFrame:
    """Set the replacements named in (doc_id, original, replacement, edit_no).

    The last edit of a row wins; edits of unknown rows are ignored.
    """
    last = edits.groupBy("doc_id", "original").agg(
        F.max(F.struct(order, "replacement"))["replacement"].alias("edited")
    )
    return rows.join(last, ["doc_id", "original"], "left").select(
        "doc_id",
        "original",
        F.coalesce("edited", "replacement").alias("replacement"),
        "occurrence_count",
        "rank",
    )


def is_edited(original: Column, replacement: Column) -> Column:
    """True if the stripped replacement is not empty and differs from the original."""
    new = strip(replacement)
    return (new != "") & (new != original)


def edited_mappings(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, original, replacement, rank) to apply.

    Where an original has several edited rows, the last one by rank gives the
    replacement, at the place of the first.
    """
    edited = rows.where(is_edited(F.col("original"), F.col("replacement")))
    last = F.max(F.struct("rank", strip(F.col("replacement")).alias("replacement")))
    return edited.groupBy("doc_id", "original").agg(
        last["replacement"].alias("replacement"), F.min("rank").alias("rank")
    )


def edited_counts(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, n_edited) for every document of the table."""
    edited = is_edited(F.col("original"), F.col("replacement"))
    return rows.groupBy("doc_id").agg(F.count_if(edited).alias("n_edited"))


def reset_all(rows: DataFrame) -> DataFrame:
    """Empty every replacement."""
    return rows.withColumn("replacement", F.lit(""))


def reset_row(rows: DataFrame, index: int) -> DataFrame:
    """Empty the replacement at a 0-based place of each document's table."""
    cleared = F.when(F.col("rank") == index + 1, "").otherwise(F.col("replacement"))
    return rows.withColumn("replacement", cleared)
