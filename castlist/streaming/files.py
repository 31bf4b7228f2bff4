"""Files that keep arriving: the same scan and per-document steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castlist.sources.files import decode_files

# Fixed value: the columns of Spark's binaryFile source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Decoded files of a growing folder, as an unbounded table.

    Decoding, layout repair, chunking, scoring and reply parsing keep no
    state between documents, so they apply to this table unchanged.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    arriving = reader.options(**options).load(path)
    return decode_files(arriving.select("path", "length", "content"))
