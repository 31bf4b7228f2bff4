"""Text files of unknown encoding: scan, decode, quarantine, profile, save."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.functions.text import line_count, profile_label, size_kb
from castlist.session import new_table
from castlist.sources import shared
from castlist.sources.datasource import Files, FileWriter, Segments, finish, read_batches

# Byte order marks with their labels, in the order they are
# tested, and the encodings tried in turn on files without one.
MARKS = (("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
ENCODINGS = ("utf-8", "gb18030", "gbk", "big5", "shift_jis", "euc-kr")

DECODED = T.StructType().add("text", "string").add("encoding", "string").add("reason", "string")


def scan_files(spark: SparkSession, path: str | list[str], manifest: DataFrame | None = None,
               **options: str) -> DataFrame:
    """Rows (path, length, content), one per file under the path(s).

    Spark's file source skips zero-byte files and names that start with a dot
    or an underscore; ``read_files`` has them. A manifest with a ``path`` column, in the form Spark
    reports paths, names the files wanted, wherever they are: they are dealt out to tasks and opened there one by one,
    and one that does not exist raises. A file named twice comes once. The manifest is read once.
    """
    if manifest is None:
        return (
            spark.read.format("binaryFile").options(**options).load(path)
            .select("path", "length", "content")
        )
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read_batches(path for batch in batches for path in batch.column(0).to_pylist())

    # The exchange of the paths deals them out, in a number of parts that Spark does not merge; contents are never exchanged.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = manifest.select("path").where(F.col("path").isNotNull()).repartition(parts, "path").distinct()
    return paths.mapInArrow(read, "path string, length bigint, content binary")


def read_files(
    spark: SparkSession, path: str | list[str], recursive: bool = False, hidden: bool = False, content: bool = True
) -> DataFrame:
    """Rows (path, length, content), one per file under the path(s), empty files and, with ``hidden``, hidden ones too.

    A path is a file, a folder or a pattern. Without ``content`` the files are not opened and content is NULL.
    """
    spark.dataSource.register(Files)
    paths = [path] if isinstance(path, str) else path
    wanted = {"recursive": recursive, "hidden": hidden, "content": content}
    options = {name: str(value).lower() for name, value in wanted.items()} | {"listing": new_table(spark, "listing")}
    return spark.read.format(Files.name()).options(paths=json.dumps([qualified(spark, p) for p in paths]), **options).load()


def read_segments(
    spark: SparkSession, path: str | list[str], size: int = 16 << 20, recursive: bool = False, hidden: bool = False
) -> DataFrame:
    """Rows (path, seg_idx, text, reason): UTF-8 files of any length in segments of about ``size`` bytes, whole characters each.

    A mark at the beginning is dropped. Where a segment is not valid UTF-8, text is NULL and ``reason`` says so.
    """
    spark.dataSource.register(Segments)
    paths = [path] if isinstance(path, str) else path
    options = {"recursive": str(recursive).lower(), "hidden": str(hidden).lower(), "size": str(size), "listing": new_table(spark, "listing")}
    return spark.read.format(Segments.name()).options(paths=json.dumps([qualified(spark, p) for p in paths]), **options).load()


def save_segments(segments: DataFrame) -> int:
    """Write the texts (path, seg_idx, text) of each path, in order, to one UTF-8 file of any length; return the number of files.

    A file is written by one task, as a stream.
    """
    ordered = segments.repartition("path").sortWithinPartitions("path", "seg_idx")
    return _save(ordered.select("path", F.encode("text", "UTF-8").alias("content")), segments="true")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the file system that Spark takes it to be in, in the form Spark reports paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def decode_files(files: DataFrame) -> DataFrame:
    """The files with (text, encoding, reason) in place of content.

    A byte order mark decides the encoding and is dropped; what follows must
    then decode. Else the first encoding that decodes the whole file counts.
    UTF-8, with or without a mark, is decoded by Catalyst; only other bytes
    are handed to Python's strict codecs. Where all fail, text and encoding
    are NULL and ``reason`` says why.
    """
    content = F.col("content")
    utf8_mark = _has_mark(content, MARKS[0][0])
    body = F.when(utf8_mark, F.substring(content, 4, 2_147_483_647)).otherwise(content)
    marked = files.withColumn("is_marked", utf8_mark).withColumn("body", body)
    wide = _has_mark(content, MARKS[1][0]) | _has_mark(content, MARKS[2][0])
    as_utf8 = F.when(~wide, F.try_validate_utf8(F.col("body").cast("string")))
    tried = marked.withColumn("utf8", as_utf8)
    rest = F.when(F.col("utf8").isNull() & ~F.col("is_marked"), content)
    read = tried.withColumn("other", _decode_other(rest))
    keep = [name for name in files.columns if name != "content"]
    encoding = F.when(
        F.col("utf8").isNotNull(), F.when(F.col("is_marked"), MARKS[0][1]).otherwise(ENCODINGS[0])
    ).otherwise(F.col("other.encoding"))
    return read.select(
        *keep,
        F.coalesce("utf8", "other.text").alias("text"),
        encoding.alias("encoding"),
        F.when(
            F.col("utf8").isNull() & F.col("other.text").isNull(),
            F.when(F.col("is_marked"), F.lit("not valid after its utf-8-sig mark")).otherwise(
                F.coalesce("other.reason", F.lit("could not detect encoding"))
            ),
        ).alias("reason"),
    )


def loaded(decoded: DataFrame) -> DataFrame:
    """Only the files that could be decoded."""
    return decoded.where(F.col("reason").isNull()).drop("reason")


def quarantined(decoded: DataFrame) -> DataFrame:
    """Rows (path, length, reason) of the files that could not."""
    return decoded.where(F.col("reason").isNotNull()).select("path", "length", "reason")


def profile_files(decoded: DataFrame) -> DataFrame:
    """Rows (path, size_kb, line_count, encoding, label)."""
    sized = loaded(decoded).select(
        "path",
        size_kb(F.col("length")).alias("size_kb"),
        line_count(F.col("text")).alias("line_count"),
        "encoding",
    )
    name = F.regexp_extract("path", "([^/]*)$", 1)
    label = profile_label(name, F.col("size_kb"), F.col("line_count"), F.col("encoding"))
    return sized.withColumn("label", label)


def encode_text(text: Column, encoding: Column) -> Column:
    """The bytes to save: the three marked encodings stay, all else is UTF-8.

    Only utf-8-sig writes its mark.
    """
    utf8 = F.encode(text, "UTF-8")
    return (
        F.when(encoding == "utf-8-sig", F.concat(F.unhex(F.lit(MARKS[0][0])), utf8))
        .when(encoding == "utf-16-le", F.encode(text, "UTF-16LE"))
        .when(encoding == "utf-16-be", F.encode(text, "UTF-16BE"))
        .otherwise(utf8)
    )


def encoded(texts: DataFrame) -> DataFrame:
    """Rows (path, content, encoding) from (path, text, encoding)."""
    return texts.select(
        "path", encode_text(F.col("text"), F.col("encoding")).alias("content"), "encoding"
    )


def save_table(texts: DataFrame, folder: str) -> None:
    """Write (path, content, encoding) as a Parquet table: the form for large corpora."""
    encoded(texts).write.mode("overwrite").parquet(folder)


def save_files(texts: DataFrame) -> int:
    """Write every text to its own file and return their number.

    Runs in the tasks, on any file system Arrow knows, and runs the plan of the texts once. The files appear together
    after the last task that writes (see ``castlist.sources.datasource``); if any cannot be written, none appears. Of several
    texts for one path one is kept.
    """
    return _save(encoded(texts).select("path", "content"))


def _save(rows: DataFrame, **options: str) -> int:
    spark = rows.sparkSession
    spark.dataSource.register(Files)
    staging = new_table(spark, "staging")
    rows.write.format(Files.name()).options(staging=staging, **options).mode("append").save()
    written = json.loads(shared.read(f"{staging}/total"))
    try:
        _finish(spark, written["lists"])
    except Exception:
        FileWriter(staging).abort([])
        raise
    return written["files"]


def _finish(spark: SparkSession, lists: list[str]) -> None:
    """Name the files of all lists, dealt out to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for listed in batch.column(0).to_pylist():
                finish(listed)
            yield batch.slice(0, 0)

    if lists:
        parts = min(len(lists), int(spark.conf.get("spark.sql.shuffle.partitions")))
        named = spark.createDataFrame([(name,) for name in lists], "list string").repartition(parts)
        named.mapInArrow(run, "list string").collect()


def _has_mark(content: Column, mark: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(mark)))


def decode_bytes(data: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, reason) of bytes that are not plain UTF-8."""
    for mark, encoding in MARKS:
        prefix = bytes.fromhex(mark)
        if data.startswith(prefix):
            try:
                return data[len(prefix):].decode(encoding.removesuffix("-sig")), encoding, None
            except UnicodeDecodeError:
                return None, None, f"not valid after its {encoding} mark"
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding), encoding, None
        except UnicodeDecodeError:
            pass
    return None, None, "could not detect encoding"


def _decode_all(contents: pa.Array) -> pa.Array:
    kind = pa.struct([(name, pa.string()) for name in ("text", "encoding", "reason")])
    return pa.array(
        (None if data is None else decode_bytes(data) for data in contents.to_pylist()), kind
    )


# Declared nondeterministic so that no filter is pushed below with a copy of the call.
_decode_other = F.arrow_udf(_decode_all, DECODED).asNondeterministic()
