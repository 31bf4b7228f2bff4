"""Queries on encodings, profiles and paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.functions import text as texts
from castlist.operators import segments
from castlist.plans import normalize
from castlist.session import cut_lineage, new_table
from castlist.sources import files
from castlist.sources.tables import read_table

import workload
from workload import documents, query
from workload.layout import DECORATED_SQL, LAYOUT_SQL, decorated


@query(
    """
    SELECT doc_id,
           strlen(text) / 1024.0::DOUBLE AS size_kb,
           (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS line_count,
           printf('doc | %.1f KB | %d lines | utf-8', strlen(text) / 1024.0::DOUBLE,
                  length(text) - length(replace(text, chr(10), '')) + 1) AS label
    FROM documents
    """
)
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    loaded = documents(spark, sf_dir).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/doc")).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )
    profile = files.profile_files(files.decode_files(loaded))
    number = F.substring_index("path", "/", 1).cast("bigint")
    return profile.select(number.alias("doc_id"), "size_kb", "line_count", "label")


def raw_bytes(doc_id: Column, text: Column) -> Column:
    """The text as a file in one of six states, by document.

    In the fifth the whole text is in a legacy encoding: a short text of ASCII
    only follows a half-width katakana, which no encoding before shift_jis reads.
    """
    state = F.pmod(doc_id, F.lit(6))
    utf8 = F.encode(text, "UTF-8")
    return (
        F.when(state == 0, utf8)
        .when(state == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(state == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(state == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(state == 4, F.when(half_width(text), F.concat(F.unhex(F.lit("B131")), utf8)).otherwise(
            gb18030(F.concat(F.lit("中文"), text))))
        .otherwise(F.concat(F.unhex(F.lit("FF")), utf8))
    )


def half_width(text: Column) -> Column:
    return text.rlike("^[\\x00-\\x7F]*\\z")


@F.arrow_udf(T.BinaryType())
def gb18030(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else t.encode("gb18030") for t in texts.to_pylist()), pa.binary())


HALF_WIDTH_SQL = "regexp_full_match({text}, '[\\x00-\\x7F]*')"
DECODED_SQL = """CASE doc_id % 6
    WHEN 4 THEN CASE WHEN regexp_full_match({text}, '[\\x00-\\x7F]*') THEN 'ｱ1' ELSE '中文' END || {text}
    WHEN 5 THEN NULL ELSE {text} END"""

PATH_SQL = """'/corpus/' || source || '/' || CASE doc_id % 4
    WHEN 0 THEN 'doc.' || doc_id || '.txt' WHEN 1 THEN '.hidden' || doc_id
    WHEN 2 THEN 'doc' || doc_id || '.' ELSE 'doc' || doc_id END"""


def path_of(doc_id: Column, source: Column) -> Column:
    number = doc_id.cast("string")
    form = F.pmod(doc_id, F.lit(4))
    name = (
        F.when(form == 0, F.concat(F.lit("doc."), number, F.lit(".txt")))
        .when(form == 1, F.concat(F.lit(".hidden"), number))
        .when(form == 2, F.concat(F.lit("doc"), number, F.lit(".")))
        .otherwise(F.concat(F.lit("doc"), number))
    )
    return F.concat(F.lit("/corpus/"), source, F.lit("/"), name)


def raw_files(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """The documents as (doc_id, path, length, content) of files."""
    table = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", tasks=workload.TASKS)
    content = raw_bytes(F.col("doc_id"), F.col("text") if text is None else text)
    return table.select(
        "doc_id", path_of(F.col("doc_id"), F.col("source")).alias("path"), content.alias("content")
    ).select("doc_id", "path", F.octet_length("content").cast("bigint").alias("length"), "content")


@query(
    f"""
    SELECT doc_id,
           CASE doc_id % 6 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le'
                WHEN 3 THEN 'utf-16-be'
                WHEN 4 THEN CASE WHEN {HALF_WIDTH_SQL.format(text="text")} THEN 'shift_jis' ELSE 'gb18030' END
                END AS encoding,
           md5({DECODED_SQL.format(text="text")}) AS text_md5,
           CASE doc_id % 6 WHEN 5 THEN 'could not detect encoding' END AS reason
    FROM documents
    """
)
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = files.decode_files(raw_files(spark, sf_dir))
    return decoded.select("doc_id", "encoding", F.md5("text").alias("text_md5"), "reason")


@query(
    f"""
    WITH states AS (
        SELECT {PATH_SQL} AS path, (strlen(text) + 1)::BIGINT AS length,
               CASE doc_id % 6 WHEN 5 THEN 'could not detect encoding' END AS reason
        FROM documents)
    SELECT path, length, reason FROM states WHERE reason IS NOT NULL
    """
)
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.quarantined(files.decode_files(raw_files(spark, sf_dir)))


@query(
    """
    WITH chosen AS (
        SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig'
               WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE 'gb18030' END AS encoding
        FROM documents),
    saved AS (
        SELECT doc_id, encoding, CASE encoding
            WHEN 'utf-8-sig' THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text)
            WHEN 'utf-16-le' THEN from_hex(array_to_string(list_transform(string_split(text, ''),
                lambda c: printf('%02X%02X', unicode(c) % 256, unicode(c) // 256)), ''))
            WHEN 'utf-16-be' THEN from_hex(array_to_string(list_transform(string_split(text, ''),
                lambda c: printf('%02X%02X', unicode(c) // 256, unicode(c) % 256)), ''))
            ELSE encode(text) END AS content
        FROM chosen)
    SELECT doc_id, encoding, octet_length(content)::INTEGER AS n_bytes,
           md5(content) AS content_md5
    FROM saved
    """
)
def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.pmod("doc_id", F.lit(5))
    encoding = (
        F.when(turn == 0, "utf-8").when(turn == 1, "utf-8-sig").when(turn == 2, "utf-16-le")
        .when(turn == 3, "utf-16-be").otherwise("gb18030")
    )
    chosen = documents(spark, sf_dir).select(
        F.col("doc_id").alias("path"), "text", encoding.alias("encoding")
    )
    return files.encoded(chosen).select(
        F.col("path").alias("doc_id"),
        "encoding",
        F.octet_length("content").alias("n_bytes"),
        F.md5("content").alias("content_md5"),
    )


@query(
    """
    SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding,
           (strlen(text) + CASE doc_id % 2 WHEN 0 THEN 3 ELSE 0 END)::BIGINT AS length,
           md5(text) AS text_md5
    FROM documents
    """
)
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document saved to a file of its own, and the folder scanned again."""
    folder = new_table(spark, "castlist-files")
    name = F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    encoding = F.when(F.pmod("doc_id", F.lit(2)) == 0, "utf-8-sig").otherwise("utf-8")
    docs = documents(spark, sf_dir)
    files.save_files(docs.select(name.alias("path"), "text", encoding.alias("encoding")))
    decoded = files.loaded(files.decode_files(files.read_files(spark, folder)))
    return decoded.select(
        F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
        "encoding",
        "length",
        F.md5("text").alias("text_md5"),
    )


@query(
    """
    WITH kept AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' ELSE text END AS text FROM documents
                  WHERE doc_id % 10 <> 9)
    SELECT doc_id, strlen(text)::BIGINT AS length, md5(text) AS text_md5 FROM kept
    """
)
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by a manifest: some are empty, some have names that the source skips, some are not wanted."""
    folder = files.qualified(spark, new_table(spark, "castlist-files"))
    form = F.pmod("doc_id", F.lit(10))
    prefix = F.when(form == 1, "/_").when(form == 2, "/.").otherwise("/")
    name = F.concat(F.lit(folder), prefix, F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.when(form == 0, "").otherwise(F.col("text"))
    docs = documents(spark, sf_dir).select("doc_id", name.alias("path"), text.alias("text"))
    files.save_files(docs.withColumn("encoding", F.lit("utf-8")))
    manifest = docs.where(form != 9).select("path")
    decoded = files.loaded(files.decode_files(files.scan_files(spark, folder, manifest)))
    return decoded.select(
        F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
        "length",
        F.md5("text").alias("text_md5"),
    )


@query(
    """
    SELECT doc_id, greatest(1, (strlen(text) + 999) // 1000)::BIGINT AS n_segments, md5(text) AS text_md5
    FROM documents
    """
)
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document streamed to a file from pieces of 997 characters, and read again in segments of 1,000 bytes."""
    folder = new_table(spark, "castlist-files")
    cut = segments.cut_into_segments(documents(spark, sf_dir), 997)
    name = F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files.save_segments(cut.select(name.alias("path"), "seg_idx", "text"))
    read = files.read_segments(spark, folder, 1000)
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint")
    rows = cut_lineage(read.select(number.alias("doc_id"), "seg_idx", "text"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    texts = segments.joined_segments(rows).select("doc_id", F.md5("text").alias("text_md5"))
    return counts.join(texts, "doc_id")


def suffixed_sql(path: str, suffix: str) -> str:
    """SQL for the suffix rule: the last dot splits, if it is inside the name."""
    name = f"regexp_replace({path}, '^.*/', '')"
    dot = f"length({name}) - strpos(reverse({name}), '.')"
    inside = f"strpos({name}, '.') > 0 AND {dot} > 0 AND {dot} < length({name}) - 1"
    folder = f"left({path}, length({path}) - length({name}))"
    return (
        f"{folder} || CASE WHEN {inside} THEN left({name}, {dot}) || '{suffix}' || "
        f"substr({name}, {dot} + 1) ELSE {name} || '{suffix}' END"
    )


@query(
    f"""
    WITH paths AS (SELECT doc_id, {PATH_SQL} AS path FROM documents)
    SELECT doc_id, path, {suffixed_sql("path", "_processed")} AS processed,
           {suffixed_sql("path", "_normalized")} AS normalized
    FROM paths
    """
)
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = table.select("doc_id", path_of(F.col("doc_id"), F.col("source")).alias("path"))
    return paths.select(
        "doc_id",
        "path",
        texts.processed_path(F.col("path")).alias("processed"),
        texts.normalized_path(F.col("path")).alias("normalized"),
    )


@query(
    f"""
    WITH sources AS (
        SELECT doc_id, {PATH_SQL} AS path, {DECORATED_SQL} AS decorated FROM documents),
    texts AS (
        SELECT path, {DECODED_SQL.format(text="decorated")} AS text FROM sources),
    repaired AS (SELECT path, {LAYOUT_SQL} AS text FROM texts WHERE text IS NOT NULL)
    SELECT {suffixed_sql("path", "_normalized")} AS path, 'utf-8' AS encoding,
           md5(text) AS content_md5
    FROM repaired
    """
)
def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = raw_files(spark, sf_dir, decorated(F.col("doc_id"), F.col("text")))
    saved = files.encoded(normalize.normalize_files(scanned))
    return saved.select("path", "encoding", F.md5("content").alias("content_md5"))
