"""Export of renamed documents: edited mappings, replacement, output files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.functions.text import processed_path
from castlist.operators import mapping, matching, replacing


def export_documents(
    docs: DataFrame, rows: DataFrame, broadcast_bytes: int = matching.BROADCAST_BYTES
) -> DataFrame:
    """Rows (doc_id, path, encoding, text, n_names, total) to save.

    ``docs`` has (doc_id, path, text, encoding) and ``rows`` is the mapping
    table, stored. Only documents with an edited name are exported, each in
    the encoding it came in. Path and encoding travel with the text, which is
    matched with the mappings just once.
    """
    return exported(replaced_documents(docs, rows, broadcast_bytes))


def replaced_documents(
    docs: DataFrame, rows: DataFrame, broadcast_bytes: int = matching.BROADCAST_BYTES
) -> DataFrame:
    """The replacement of all documents with an edited name.

    Store it (see ``castlist.session.cut_lineage``) to take both the texts
    (``exported``) and the counts per name (``exported_counts``) from one run.
    """
    edited = mapping.edited_mappings(rows)
    return replacing.apply_replacements(
        docs, edited, broadcast_bytes, carry=("path", "encoding"), unmapped=False
    )


def exported(applied: DataFrame) -> DataFrame:
    """Rows (doc_id, path, encoding, text, n_names, total) to save."""
    return replacing.replaced_texts(applied).withColumn("path", processed_path(F.col("path")))


def exported_counts(applied: DataFrame) -> DataFrame:
    """Rows (doc_id, path, step, original, n): how often each name of a file was replaced."""
    counts = applied.where(F.col("original").isNotNull())
    path = processed_path(F.col("path")).alias("path")
    return counts.select("doc_id", path, "step", "original", "n")
