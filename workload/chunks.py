"""Queries on splitting and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.functions import splitting
from castlist.functions.text import byte_length
from castlist.operators import chunks as chunking
from castlist.operators import long_chunks, segments
from castlist.operators.rows import explode_items
from castlist.session import cut_lineage
from workload import documents, query

PIECE_BYTES = 1000
SMALL_CHUNK_BYTES = 600

SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
SENTENCES_SQL = (
    "list_filter(list_transform(regexp_extract_all({0},"
    " '[^。！？；.!?;]*[。！？；.!?;]|[^。！？；.!?;]+$'), lambda s: ltrim(s, " + SPACES + ")),"
    " lambda s: s <> '')"
)
# The given texts have single line breaks only, so these are doubled.
PARAGRAPHS_SQL = f"""spaced AS (
        SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)),
               chr(10) || chr(10)) AS parts FROM documents),
    trimmed AS (
        SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p, {SPACES})),
               lambda p: p <> '') AS paras FROM spaced),
    paras AS (
        SELECT doc_id, unnest(paras) AS para, generate_subscripts(paras, 1) - 1 AS para_idx
        FROM trimmed)"""


def cut_starts_sql(text: str, limit: int) -> str:
    """List of the 1-based characters at which the byte-limited pieces start."""
    state = "{{'n': {n}, 'pos': {pos}, 'size': {size}, 'starts': {starts}}}"
    each = state.format(n="strlen(c)", pos="0", size="0", starts="CAST([] AS BIGINT[])")
    init = state.format(
        n="0::BIGINT", pos="0::BIGINT", size=f"{limit}::BIGINT", starts="CAST([] AS BIGINT[])"
    )
    stay = state.format(n="0", pos="a.pos + 1", size="a.size + x.n", starts="a.starts")
    cut = state.format(
        n="0", pos="a.pos + 1", size="x.n", starts="list_append(a.starts, a.pos + 1)"
    )
    each = each.replace("'pos': 0", "'pos': 0::BIGINT").replace("'size': 0", "'size': 0::BIGINT")
    return (
        f"(list_reduce(list_transform(string_split({text}, ''), lambda c: {each}),"
        f" lambda a, x: CASE WHEN a.size + x.n < {limit} THEN {stay} ELSE {cut} END, {init})).starts"
    )


def pieces_sql(text: str, limit: int) -> str:
    """List of the byte-limited pieces of a text."""
    starts = cut_starts_sql(text, limit)
    return (
        f"list_transform(list_zip({starts}, list_append(({starts})[2:], length({text}) + 1)),"
        f" lambda z: substr({text}, z[1], z[2] - z[1]))"
    )


def chunks_sql(limit: int) -> str:
    """CTEs ending in chunks(doc_id, chunk_idx, chunk)."""
    state = "{{'n': {n}, 'run': {run}, 'solo': {solo}, 'k': {k}, 'ks': {ks}}}"
    each = state.format(n="nb", run="run", solo="solo", k="0::BIGINT", ks="CAST([] AS BIGINT[])")
    init = state.format(
        n="0::BIGINT", run="-2::BIGINT", solo="false", k="-1::BIGINT", ks="CAST([] AS BIGINT[])"
    )
    gap = "CASE WHEN x.run = -1 THEN 2 ELSE 0 END"
    stay = state.format(
        n=f"a.n + {gap} + x.n", run="x.run", solo="x.solo", k="a.k", ks="list_append(a.ks, a.k)"
    )
    new = state.format(
        n="x.n", run="x.run", solo="x.solo", k="a.k + 1", ks="list_append(a.ks, a.k + 1)"
    )
    return f"""{PARAGRAPHS_SQL},
    long_paras AS (
        SELECT doc_id, para_idx, {SENTENCES_SQL.format("para")} AS sents
        FROM paras WHERE strlen(para) >= {limit}),
    sents AS (
        SELECT doc_id, para_idx, unnest(sents) AS sent, generate_subscripts(sents, 1) AS sent_idx
        FROM long_paras),
    long_sents AS (
        SELECT doc_id, para_idx, sent_idx, {pieces_sql("sent", limit)} AS pieces
        FROM sents WHERE strlen(sent) >= {limit}),
    units AS (
        SELECT doc_id, para_idx, 0 AS sent_idx, 0 AS piece_idx, para AS unit, -1::BIGINT AS run,
               false AS solo FROM paras WHERE strlen(para) < {limit}
        UNION ALL
        SELECT doc_id, para_idx, sent_idx, 0, sent, para_idx, false
        FROM sents WHERE strlen(sent) < {limit}
        UNION ALL
        SELECT doc_id, para_idx, sent_idx, generate_subscripts(pieces, 1), unnest(pieces),
               para_idx, true FROM long_sents),
    sized AS (SELECT *, strlen(unit)::BIGINT AS nb FROM units),
    unit_lists AS (
        SELECT doc_id, list(unit ORDER BY para_idx, sent_idx, piece_idx) AS units,
               list(run ORDER BY para_idx, sent_idx, piece_idx) AS runs,
               list({each} ORDER BY para_idx, sent_idx, piece_idx) AS states
        FROM sized GROUP BY doc_id),
    numbered AS (
        SELECT doc_id, units, runs, (list_reduce(states, lambda a, x: CASE
            WHEN a.run = x.run AND NOT a.solo AND NOT x.solo AND a.n + {gap} + x.n < {limit}
            THEN {stay} ELSE {new} END, {init})).ks AS ks FROM unit_lists),
    placed AS (
        SELECT doc_id, unnest(units) AS unit, unnest(runs) AS run, unnest(ks) AS chunk_idx,
               generate_subscripts(units, 1) AS pos FROM numbered),
    chunks AS (
        SELECT doc_id, chunk_idx::INTEGER AS chunk_idx,
               CASE WHEN min(run) = -1 THEN string_agg(unit, chr(10) || chr(10) ORDER BY pos)
                    ELSE string_agg(unit, '' ORDER BY pos) END AS chunk
        FROM placed GROUP BY doc_id, chunk_idx)"""


def spaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query(
    f"""
    WITH {PARAGRAPHS_SQL}
    SELECT doc_id, para_idx::INTEGER AS para_idx, strlen(para)::INTEGER AS n_bytes,
           md5(para) AS para_md5
    FROM paras
    """
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_paragraphs(spaced_documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "para_idx",
        byte_length(F.col("text")).alias("n_bytes"),
        F.md5("text").alias("para_md5"),
    )


@query(
    f"""
    WITH {PARAGRAPHS_SQL},
    lists AS (SELECT doc_id, para_idx, {SENTENCES_SQL.format("para")} AS sents FROM paras),
    sents AS (SELECT doc_id, para_idx, unnest(sents) AS sent,
                     generate_subscripts(sents, 1) - 1 AS sent_idx FROM lists)
    SELECT doc_id, para_idx::INTEGER AS para_idx, sent_idx::INTEGER AS sent_idx,
           md5(sent) AS sent_md5
    FROM sents
    """
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_sentences(
        chunking.explode_paragraphs(spaced_documents(spark, sf_dir))
    )
    return rows.select("doc_id", "para_idx", "sent_idx", F.md5("text").alias("sent_md5"))


@query(
    f"""
    WITH lists AS (SELECT doc_id, {pieces_sql("text", PIECE_BYTES)} AS pieces FROM documents),
    pieces AS (SELECT doc_id, unnest(pieces) AS piece,
                      generate_subscripts(pieces, 1) - 1 AS piece_idx FROM lists)
    SELECT doc_id, piece_idx::INTEGER AS piece_idx, strlen(piece)::INTEGER AS n_bytes,
           md5(piece) AS piece_md5
    FROM pieces
    """
)
def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pieces = splitting.byte_pieces(F.col("text"), PIECE_BYTES)
    rows = explode_items(docs, ["doc_id"], pieces, "piece_idx", "piece")
    return rows.select(
        "doc_id",
        "piece_idx",
        byte_length(F.col("piece")).alias("n_bytes"),
        F.md5("piece").alias("piece_md5"),
    )


def chunk_rows(chunked: DataFrame) -> DataFrame:
    return chunked.select("doc_id", "chunk_idx", "n_bytes", F.md5("chunk").alias("chunk_md5"))


CHUNK_ROWS_SQL = """
    SELECT doc_id, chunk_idx, strlen(chunk)::INTEGER AS n_bytes, md5(chunk) AS chunk_md5
    FROM chunks
    """


@query(f"WITH {chunks_sql(chunking.CHUNK_MAX_BYTES)} {CHUNK_ROWS_SQL}")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(chunking.split_into_chunks(spaced_documents(spark, sf_dir)))


@query(f"WITH {chunks_sql(SMALL_CHUNK_BYTES)} {CHUNK_ROWS_SQL}")
def small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spaced_documents(spark, sf_dir)
    return chunk_rows(chunking.split_into_chunks(docs, SMALL_CHUNK_BYTES))


@query(f"WITH {chunks_sql(SMALL_CHUNK_BYTES)} {CHUNK_ROWS_SQL}")
def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for texts longer than a cell, on texts cut every 997 characters."""
    cut = cut_lineage(segments.cut_into_segments(spaced_documents(spark, sf_dir), 997))
    return chunk_rows(long_chunks.chunk_segments(cut, SMALL_CHUNK_BYTES))
