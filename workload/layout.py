"""Queries on layout repair.

The given texts hold no Chinese, so the queries first dress their lines with
chapter titles, indents, sentence ends, blank lines and foreign line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.functions import layout
from castlist.functions.text import unix_newlines
from castlist.operators import segments
from castlist.operators.long_layout import repair_segments
from castlist.operators.rows import explode_items
from castlist.plans.normalize import normalize_documents
from workload import documents, query

WIDE = "　"


def decorated(doc_id: Column, text: Column) -> Column:
    def dress(line: Column, i: Column) -> Column:
        form = F.pmod(i + doc_id, F.lit(8))
        return (
            F.when(form == 0, F.concat(F.lit("第"), i.cast("string"), F.lit("章 "), line))
            .when(form == 1, F.concat(F.lit(WIDE * 2), line, F.lit("。")))
            .when(form == 2, F.concat(F.lit("  "), line))
            .when(form == 3, F.concat(line, F.lit("！」\n")))
            .when(form == 4, F.concat(line, F.lit("\r")))
            .when(form == 5, F.concat(F.lit("\t\t"), line, F.lit("…")))
            .when(form == 6, line)
            .otherwise(F.concat(F.lit(" "), line, F.lit("？\n\n")))
        )

    return F.array_join(F.transform(F.split(text, "\n", -1), dress), "\n")


DECORATED_SQL = """array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE (i - 1 + doc_id) % 8 WHEN 0 THEN '第' || (i - 1) || '章 ' || l
        WHEN 1 THEN '　　' || l || '。' WHEN 2 THEN '  ' || l
        WHEN 3 THEN l || '！」' || chr(10) WHEN 4 THEN l || chr(13)
        WHEN 5 THEN chr(9) || chr(9) || l || '…' WHEN 6 THEN l
        ELSE ' ' || l || '？' || chr(10) || chr(10) END), chr(10))"""

UNIX_SQL = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
LINES_SQL = f"string_split({UNIX_SQL.format('text')}, chr(10))"


def title_sql(line: str) -> str:
    return (
        f"regexp_matches(trim({line}, ' 　' || chr(9)),"
        " '^第[0-9一二三四五六七八九十百千零两]+[章节回卷部篇]')"
    )


def breaks_sql(previous: str, following: str) -> str:
    return (
        f"({title_sql(previous)} OR regexp_matches({previous},"
        f" '[。！？!?…][\"”’」』）】》]*$') OR {title_sql(following)})"
    )


def joined_sql(previous: str, following: str) -> str:
    return (
        f"{previous} || CASE WHEN regexp_matches({previous}, '[0-9A-Za-z]$') AND"
        f" regexp_matches({following}, '^[0-9A-Za-z]') THEN ' ' ELSE '' END || {following}"
    )


INDENTED_SQL = f"regexp_matches({{0}}, '^[ \\t{WIDE}]{{{{2,}}}}[^\\s{WIDE}]')"
STRIPPED_SQL = "trim({0}, ' 　' || chr(9))"
WITH_INDENT_SQL = f"regexp_extract(x.raw, '^{WIDE}*') || x.line"

# The whole repair as a fold over the lines: cur is the open paragraph, done
# the finished ones with their separators.
LAYOUT_SQL = f"""list_reduce(
    list_transform({LINES_SQL}, lambda r: {{'raw': r, 'line': {STRIPPED_SQL.format("r")},
        'cur': '', 'done': '', 'blank': false}}),
    lambda a, x: CASE
        WHEN x.line = '' THEN {{'raw': '', 'line': '', 'cur': a.cur, 'done': a.done, 'blank': true}}
        WHEN a.cur = '' THEN {{'raw': '', 'line': '', 'cur': {WITH_INDENT_SQL}, 'done': a.done,
            'blank': false}}
        WHEN (a.blank OR {INDENTED_SQL.format("x.raw")}) AND {breaks_sql("a.cur", "x.line")}
            THEN {{'raw': '', 'line': '', 'cur': {WITH_INDENT_SQL}, 'blank': false,
                'done': a.done || a.cur || CASE WHEN a.blank THEN chr(10) || chr(10)
                    ELSE chr(10) END}}
        ELSE {{'raw': '', 'line': '', 'cur': {joined_sql("a.cur", "x.line")}, 'done': a.done,
            'blank': false}} END,
    {{'raw': '', 'line': '', 'cur': '', 'done': '', 'blank': false}})"""
LAYOUT_SQL = f"({LAYOUT_SQL}).done || ({LAYOUT_SQL}).cur"

DRESSED_SQL = f"dressed AS (SELECT doc_id, {DECORATED_SQL} AS text FROM documents)"
LINE_ROWS_SQL = f"""{DRESSED_SQL},
    line_lists AS (SELECT doc_id, {LINES_SQL} AS lines FROM dressed),
    line_rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_idx
                  FROM line_lists),
    pairs AS (SELECT a.doc_id, a.line_idx, a.line AS previous, b.line AS following
              FROM line_rows a JOIN line_rows b
              ON a.doc_id = b.doc_id AND a.line_idx + 1 = b.line_idx)"""


def dressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.withColumn("text", decorated(F.col("doc_id"), F.col("text")))


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = dressed_documents(spark, sf_dir)
    return dressed.select("doc_id", F.split(unix_newlines(F.col("text")), "\n", -1).alias("lines"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines (doc_id, line_idx, previous, following), built in the row."""
    arrays = line_arrays(spark, sf_dir)
    n = F.size("lines")
    pairs = F.zip_with(
        F.slice("lines", F.lit(1), n - 1),
        F.slice("lines", F.lit(2), n),
        lambda a, b: F.struct(a.alias("previous"), b.alias("following")),
    )
    return explode_items(arrays, ["doc_id"], pairs, "line_idx", "pair").select(
        "doc_id", "line_idx", "pair.previous", "pair.following"
    )


@query(
    f"""
    WITH {DRESSED_SQL}
    SELECT doc_id, md5({UNIX_SQL.format("text")}) AS text_md5 FROM dressed
    """
)
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = dressed_documents(spark, sf_dir)
    return dressed.select("doc_id", F.md5(unix_newlines(F.col("text"))).alias("text_md5"))


@query(
    f"""
    WITH {LINE_ROWS_SQL}
    SELECT doc_id, line_idx::INTEGER AS line_idx, {title_sql("line")} AS is_title
    FROM line_rows
    """
)
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = line_arrays(spark, sf_dir)
    lines = explode_items(arrays, ["doc_id"], F.col("lines"), "line_idx", "line")
    return lines.select(
        "doc_id", "line_idx", layout.is_chapter_title(F.col("line")).alias("is_title")
    )


@query(
    f"""
    WITH {LINE_ROWS_SQL}
    SELECT doc_id, line_idx::INTEGER AS line_idx, {breaks_sql("previous", "following")} AS breaks
    FROM pairs
    """
)
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = layout.starts_new_paragraph(F.col("previous"), F.col("following"))
    return line_pairs(spark, sf_dir).select("doc_id", "line_idx", breaks.alias("breaks"))


@query(
    f"""
    WITH {LINE_ROWS_SQL}
    SELECT doc_id, line_idx::INTEGER AS line_idx,
           md5({joined_sql("previous", "following")}) AS joined_md5
    FROM pairs
    """
)
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = layout.join_wrapped(F.col("previous"), F.col("following"))
    return line_pairs(spark, sf_dir).select("doc_id", "line_idx", F.md5(joined).alias("joined_md5"))


@query(
    f"""
    WITH {LINE_ROWS_SQL}
    SELECT doc_id, line_idx::INTEGER AS line_idx,
           regexp_extract(line, '^{WIDE}*') AS indent,
           {INDENTED_SQL.format("line")} AS is_indented
    FROM line_rows
    """
)
def line_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = line_arrays(spark, sf_dir)
    lines = explode_items(arrays, ["doc_id"], F.col("lines"), "line_idx", "line")
    return lines.select(
        "doc_id",
        "line_idx",
        layout.fullwidth_indent(F.col("line")).alias("indent"),
        layout.is_indented(F.col("line")).alias("is_indented"),
    )


@query(
    f"""
    WITH {DRESSED_SQL}, repaired AS (SELECT doc_id, {LAYOUT_SQL} AS text FROM dressed)
    SELECT doc_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM repaired
    """
)
def layout_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = normalize_documents(dressed_documents(spark, sf_dir))
    return repaired.select(
        "doc_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query(
    f"""
    WITH {DRESSED_SQL}, repaired AS (SELECT doc_id, {LAYOUT_SQL} AS text FROM dressed)
    SELECT doc_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM repaired
    """
)
def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for texts longer than a cell, on texts cut every 997 characters."""
    cut = segments.cut_into_segments(dressed_documents(spark, sf_dir), 997)
    repaired = segments.joined_segments(repair_segments(cut))
    return repaired.select(
        "doc_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )
