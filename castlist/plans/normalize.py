"""Layout repair of files: scan, decode, repair, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.functions.layout import repair_layout
from castlist.functions.text import normalized_path
from castlist.sources import files


def normalize_documents(docs: DataFrame) -> DataFrame:
    """The documents with their text repaired. No shuffle."""
    return docs.withColumn("text", repair_layout(F.col("text")))


def normalize_files(scanned: DataFrame) -> DataFrame:
    """Rows (path, text, encoding) to save, from scanned files.

    The path gets its suffix and the output is always UTF-8. Files that cannot
    be decoded are left out; see ``castlist.sources.files.quarantined``.
    """
    texts = files.loaded(files.decode_files(scanned))
    return texts.select(
        normalized_path(F.col("path")).alias("path"),
        repair_layout(F.col("text")).alias("text"),
        F.lit("utf-8").alias("encoding"),
    )
