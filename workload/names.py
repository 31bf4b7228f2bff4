"""Queries on prompts, scoring, reply parsing, deduplication, counts and outcomes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.functions import replies
from castlist.operators import asking, listed
from castlist.operators import names as naming
from castlist.operators import scoring
from castlist.operators.rows import explode_items
from castlist.plans.extract import extract_names
from castlist.session import cut_lineage, new_table
from workload import NAME_PATTERN, documents, query, turns
from workload.chunks import chunks_sql

EXTRACTION_CHUNK_BYTES = 2048
BARE_TEMPLATE = scoring.SLOT

TURNS_SQL = """turns AS (
        SELECT conv_id AS doc_id, turn::INTEGER AS chunk_idx, text AS chunk FROM conversations)"""


def found_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{NAME_PATTERN}')"


def found_names(text: Column) -> Column:
    """The stand-in extractor as a column: every match, repeats included."""
    return F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0))


def stand_in(refuses: bool = True):
    """A deterministic maker of answers in place of a model; some prompts fail, of these some are refused.

    Defined inside a function, so that it travels to the workers by value.
    """

    def make():
        pattern = re.compile(NAME_PATTERN)

        class RateLimitError(Exception):
            pass

        def answer(prompt: str) -> str:
            size = len(prompt)
            if refuses and size % 97 == 0:
                raise RateLimitError("slow down")
            if refuses and size % 89 == 0:
                raise RuntimeError("Error code: 429 - quota")
            if size % 11 == 0:
                raise TimeoutError("no answer in time")
            if size % 13 == 0:
                return ""
            return json.dumps({"names": pattern.findall(prompt)})

        return answer

    return make


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"""
    WITH {TURNS_SQL}
    SELECT doc_id, chunk_idx, length(prompt)::INTEGER AS n_chars, md5(prompt) AS prompt_md5
    FROM (SELECT doc_id, chunk_idx, replace({_quoted(scoring.DEFAULT_PROMPT)},
                 '{scoring.SLOT}', chunk) AS prompt FROM turns)
    """
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = turns(spark, sf_dir).withColumn("prompt", scoring.prompt(F.col("chunk")))
    return made.select(
        "doc_id",
        "chunk_idx",
        F.char_length("prompt").alias("n_chars"),
        F.md5("prompt").alias("prompt_md5"),
    )


def answers_sql(chunks: str) -> str:
    """CTE responses, as the stand-in answers the chunks of a CTE."""
    listed = (
        f"array_to_string(list_transform({found_sql('chunk')},"
        " lambda n: '\"' || n || '\"'), ', ')"
    )
    return f"""sizes AS (SELECT *, length(chunk) AS size FROM {chunks}),
    responses AS (
        SELECT doc_id, chunk_idx,
            CASE WHEN size % 97 = 0 OR size % 89 = 0 OR size % 11 = 0 THEN NULL
                 WHEN size % 13 = 0 THEN ''
                 ELSE '{{"names": [' || {listed} || ']}}' END AS response,
            CASE WHEN size % 97 = 0 THEN 'RateLimitError' WHEN size % 89 = 0 THEN 'RuntimeError'
                 WHEN size % 11 = 0 THEN 'TimeoutError' END AS error_class,
            CASE WHEN size % 97 = 0 THEN 'slow down' WHEN size % 89 = 0
                 THEN 'Error code: 429 - quota'
                 WHEN size % 11 = 0 THEN 'no answer in time' END AS error,
            CASE WHEN size % 97 = 0 OR size % 89 = 0 OR size % 11 = 0 THEN NULL
                 WHEN size % 13 = 0 THEN CAST([] AS VARCHAR[])
                 ELSE {found_sql('chunk')} END AS names
        FROM sizes)"""


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_chunks(turns(spark, sf_dir), stand_in(), BARE_TEMPLATE)


@query(
    f"""
    WITH {TURNS_SQL}, {answers_sql("turns")}
    SELECT doc_id, chunk_idx, response, error_class, error FROM responses
    """
)
def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_turns(spark, sf_dir)


@query(
    f"""
    WITH {TURNS_SQL}, {answers_sql("turns")}
    SELECT doc_id, chunk_idx, coalesce(contains(lower(error_class), 'ratelimit')
           OR contains(lower(error), 'rate limit') OR contains(lower(error), 'error code: 429'),
           false) AS is_rate_limit
    FROM responses
    """
)
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = replies.is_rate_limit(F.col("error_class"), F.col("error"))
    return scored_turns(spark, sf_dir).select(
        "doc_id", "chunk_idx", limited.alias("is_rate_limit")
    )


# Replies of ten forms, made from the names in each turn.
REPLIES_SQL = f"""{TURNS_SQL},
    found AS (
        SELECT doc_id, chunk_idx, (doc_id + chunk_idx) % 10 AS form,
               {found_sql("chunk")} AS names,
               array_to_string(list_transform({found_sql("chunk")},
                               lambda n: '"' || n || '"'), ', ') AS quoted
        FROM turns),
    replies AS (
        SELECT doc_id, chunk_idx, CASE form
            WHEN 0 THEN '{{"names": [' || quoted || ']}}'
            WHEN 1 THEN 'Here you are: {{"names": [' || quoted || ']}} I hope it helps.'
            WHEN 2 THEN '```json' || chr(10) || '{{"names": [' || quoted || ']}}' || chr(10) || '```'
            WHEN 3 THEN 'The list is "names": [' || quoted || '] and no more'
            WHEN 4 THEN array_to_string(list_transform(names, lambda n, i: i || '. ' || n), chr(10))
            WHEN 5 THEN '{{"names": [' || quoted || '], "more": {{"deep": 1}}}}'
            WHEN 6 THEN '{{"names": ["A ", 123, true, null, "", 0, false, ' || doc_id || ']}}'
            WHEN 7 THEN '{{"characters": [' || quoted || ']}}'
            WHEN 8 THEN '  ' || chr(10)
            ELSE '- ' || array_to_string(names, chr(10) || '- ') || chr(10) || 'Last ' || doc_id
            END AS response
        FROM found)"""


def reply_forms(found: Column, form: Column, doc_id: Column) -> Column:
    quoted = F.array_join(
        F.transform(found, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", "
    )
    numbered = F.transform(found, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n))
    strict = F.concat(F.lit('{"names": ['), quoted, F.lit("]}"))
    number = doc_id.cast("string")
    return (
        F.when(form == 0, strict)
        .when(form == 1, F.concat(F.lit("Here you are: "), strict, F.lit(" I hope it helps.")))
        .when(form == 2, F.concat(F.lit("```json\n"), strict, F.lit("\n```")))
        .when(
            form == 3,
            F.concat(F.lit('The list is "names": ['), quoted, F.lit("] and no more")),
        )
        .when(form == 4, F.array_join(numbered, "\n"))
        .when(form == 5, F.concat(F.lit('{"names": ['), quoted, F.lit('], "more": {"deep": 1}}')))
        .when(
            form == 6,
            F.concat(F.lit('{"names": ["A ", 123, true, null, "", 0, false, '), number, F.lit("]}")),
        )
        .when(form == 7, F.concat(F.lit('{"characters": ['), quoted, F.lit("]}")))
        .when(form == 8, F.lit("  \n"))
        .otherwise(
            F.concat(F.lit("- "), F.array_join(found, "\n- "), F.lit("\nLast "), number)
        )
    )


def made_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns(spark, sf_dir).withColumn("found", found_names(F.col("chunk")))
    form = F.pmod(F.col("doc_id") + F.col("chunk_idx"), F.lit(10))
    return found.select(
        "doc_id",
        "chunk_idx",
        reply_forms(F.col("found"), form, F.col("doc_id")).alias("response"),
        F.lit(None).cast("string").alias("error_class"),
        F.lit(None).cast("string").alias("error"),
    )


STRIP_SQL = "trim({0}, chr(9) || chr(10) || chr(13) || ' ')"
JSON_ITEMS_SQL = """list_transform(list_filter(from_json({0}, '["JSON"]'),
        lambda j: json_type(j) <> 'NULL' AND CAST(j AS VARCHAR) NOT IN ('0', '""', 'false')),
        lambda j: CASE json_type(j) WHEN 'BOOLEAN' THEN 'True' ELSE j->>'$' END)"""
LINE_ITEMS_SQL = f"""list_filter(list_transform(list_filter(
        list_transform(string_split({{0}}, chr(10)), lambda x: {STRIP_SQL.format("x")}),
        lambda x: x <> '' AND length(x) <= 50
            AND NOT regexp_matches(x, '^([\\[{{{{#*-]|```)')),
        lambda x: {STRIP_SQL.format("regexp_replace(regexp_replace(x, '^[0-9]+[.] *', ''), '^[-*] *', '')")}),
        lambda x: x <> '')"""
PARSED_SQL = f"""{REPLIES_SQL},
    stripped AS (SELECT doc_id, chunk_idx, {STRIP_SQL.format("response")} AS r FROM replies),
    candidates AS (
        SELECT *, CASE WHEN json_valid(r) THEN r::JSON END AS whole,
            regexp_extract(r, '(?s)\\{{[^{{}}]*"names"\\s*:\\s*\\[[^\\]]*\\][^{{}}]*\\}}') AS flat,
            regexp_extract(r, '(?s)"names"\\s*:\\s*(\\[[^\\]]*\\])', 1) AS arr FROM stripped),
    arrays AS (
        SELECT *, CASE
            WHEN json_type(whole, '$.names') = 'ARRAY' THEN json_extract(whole, '$.names')
            WHEN flat <> '' AND json_valid(flat) THEN json_extract(flat::JSON, '$.names')
            WHEN arr <> '' AND json_valid(arr) THEN arr::JSON END AS items FROM candidates),
    parsed AS (
        SELECT doc_id, chunk_idx, r, CASE WHEN r = '' THEN CAST([] AS VARCHAR[])
            WHEN items IS NOT NULL THEN {JSON_ITEMS_SQL.format("items")}
            WHEN len({LINE_ITEMS_SQL.format("r")}) > 0 THEN {LINE_ITEMS_SQL.format("r")} END AS names
        FROM arrays)"""


@query(
    f"""
    WITH {PARSED_SQL}
    SELECT doc_id, chunk_idx, array_to_string(names, '|') AS names,
           len(names)::INTEGER AS n_names,
           CASE WHEN names IS NULL THEN 'ValueError' END AS error_class,
           CASE WHEN names IS NULL THEN 'Could not extract names from response: ' || left(r, 200)
                END AS error
    FROM parsed
    """
)
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = naming.parse_replies(made_replies(spark, sf_dir))
    return parsed.select(
        "doc_id",
        "chunk_idx",
        F.array_join("names", "|").alias("names"),
        F.when(F.col("names").isNotNull(), F.size("names")).alias("n_names"),
        "error_class",
        "error",
    )


@query(
    f"""
    WITH listed AS (
        SELECT doc_id, array_to_string(list_transform({found_sql("text")}, lambda n, i:
            CASE i % 6 WHEN 0 THEN i || '. ' || n WHEN 1 THEN '  ' || n || ' ' WHEN 2 THEN '- ' || n
                 WHEN 3 THEN '# ' || n WHEN 4 THEN i || '.' || n || chr(10)
                 ELSE n || ' of ' || repeat(n, 12) END), chr(10)) AS reply
        FROM documents),
    names AS (SELECT doc_id, {LINE_ITEMS_SQL.format("reply")} AS names FROM listed)
    SELECT doc_id, len(names)::INTEGER AS n_names, md5(array_to_string(names, '|')) AS names_md5
    FROM names
    """
)
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dress(name: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        form = (i + 1) % 6
        return (
            F.when(form == 0, F.concat(number, F.lit(". "), name))
            .when(form == 1, F.concat(F.lit("  "), name, F.lit(" ")))
            .when(form == 2, F.concat(F.lit("- "), name))
            .when(form == 3, F.concat(F.lit("# "), name))
            .when(form == 4, F.concat(number, F.lit("."), name, F.lit("\n")))
            .otherwise(F.concat(name, F.lit(" of "), F.repeat(name, F.lit(12))))
        )

    docs = documents(spark, sf_dir)
    reply = F.array_join(F.transform(found_names(F.col("text")), dress), "\n")
    listed = docs.select("doc_id", replies.list_lines(reply).alias("names"))
    return listed.select(
        "doc_id",
        F.size("names").alias("n_names"),
        F.md5(F.array_join("names", "|")).alias("names_md5"),
    )


MENTIONS_SQL = f"""{PARSED_SQL},
    mentions AS (
        SELECT doc_id, chunk_idx, unnest(names) AS raw, generate_subscripts(names, 1) - 1 AS pos
        FROM parsed WHERE names IS NOT NULL),
    cleaned AS (
        SELECT doc_id, chunk_idx, pos, {STRIP_SQL.format("raw")} AS name FROM mentions)"""


@query(
    f"""
    WITH {MENTIONS_SQL},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY chunk_idx, pos) AS k
                FROM cleaned WHERE name <> '')
    SELECT doc_id, name, chunk_idx AS first_chunk, pos::INTEGER AS first_pos
    FROM ordered WHERE k = 1
    """
)
def deduped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.dedupe_names(naming.parse_replies(made_replies(spark, sf_dir)))


@query(
    f"""
    WITH {PARSED_SQL}
    SELECT doc_id, chunk_idx, len(names)::INTEGER AS n_names FROM parsed WHERE names IS NOT NULL
    """
)
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.chunk_summary(naming.parse_replies(made_replies(spark, sf_dir)))


def outcome_sql(source: str) -> str:
    """CTE outcome from a CTE with (doc_id, chunk_idx, names, error_class, error)."""
    limited = (
        "contains(lower(coalesce(error_class, '')), 'ratelimit')"
        " OR contains(lower(coalesce(error, '')), 'rate limit')"
        " OR contains(lower(coalesce(error, '')), 'error code: 429')"
    )
    return f"""totals AS (
        SELECT doc_id, count(*) AS n_chunks, count(error) AS n_failed,
               coalesce(sum(len(names)), 0)::BIGINT AS n_names, bool_or({limited}) AS limited,
               arg_min(error, chunk_idx) FILTER (error IS NOT NULL) AS first_error
        FROM {source} GROUP BY doc_id),
    outcome AS (
        SELECT doc_id, n_chunks, n_failed, n_names, CASE WHEN limited THEN 'rate_limited'
               WHEN n_names = 0 AND n_failed > 0 THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN limited THEN 'Rate limit exceeded. Please wait and retry.'
                    WHEN n_names = 0 AND n_failed > 0
                    THEN 'All ' || n_failed || ' chunk(s) failed' END AS message,
               CASE WHEN limited THEN 'Provider rate limit.'
                    WHEN n_names = 0 AND n_failed > 0 THEN first_error END AS details
        FROM totals)"""


@query(f"WITH {TURNS_SQL}, {answers_sql('turns')}, {outcome_sql('responses')} SELECT * FROM outcome")
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.run_outcome(naming.parse_replies(scored_turns(spark, sf_dir)))


OWN_COUNTS_SQL = f"""own AS (
        SELECT DISTINCT doc_id, unnest({found_sql("text")}) AS name FROM documents),
    counts AS (
        SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) / length(name))
               ::INTEGER AS occurrences
        FROM own JOIN documents USING (doc_id))"""


def own_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, names) with the names the stand-in sees in the text."""
    docs = documents(spark, sf_dir)
    return docs.withColumn("names", found_names(F.col("text")))


def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc_id, name) rows, written down like the names of a real run."""
    distinct = documents(spark, sf_dir).select(
        "doc_id", naming.distinct_names(found_names(F.col("text"))).alias("names")
    )
    rows = explode_items(distinct, ["doc_id"], F.col("names"), "pos", "name")
    return cut_lineage(rows.select("doc_id", "name"))


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.count_occurrences(documents(spark, sf_dir), stored_names(spark, sf_dir))


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def name_counts_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for more names than can be broadcast."""
    docs = documents(spark, sf_dir)
    return naming.count_occurrences(docs, stored_names(spark, sf_dir), broadcast_bytes=0)


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def name_counts_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for documents with more names than one task should hold."""
    docs = documents(spark, sf_dir)
    names = stored_names(spark, sf_dir)
    return naming.count_occurrences(docs, names, broadcast_bytes=0, rows_per_task=10)


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names as replies may give them: padded, repeated, blank and missing."""
    names = stored_names(spark, sf_dir)
    forms = F.array(
        F.concat(F.lit("  "), "name", F.lit("\t")), F.col("name"), F.lit(" "), F.lit(""), F.lit(None)
    )
    return names.select("doc_id", F.explode(forms).alias("name"))


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def raw_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.count_occurrences(documents(spark, sf_dir), raw_names(spark, sf_dir))


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def raw_name_counts_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return naming.count_occurrences(docs, raw_names(spark, sf_dir), broadcast_bytes=0)


@query(f"WITH {OWN_COUNTS_SQL} SELECT doc_id, name, occurrences FROM counts")
def raw_name_counts_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, names = documents(spark, sf_dir), raw_names(spark, sf_dir)
    return naming.count_occurrences(docs, names, broadcast_bytes=0, rows_per_task=10)


@query(
    f"""
    WITH {OWN_COUNTS_SQL}
    SELECT doc_id, count(*) AS unique_names, sum(occurrences)::BIGINT AS total_mentions
    FROM counts GROUP BY doc_id
    """
)
def mention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.mention_totals(naming.count_own_names(own_names(spark, sf_dir)))


EXTRACTION_SQL = f"""{chunks_sql(EXTRACTION_CHUNK_BYTES)}, {answers_sql("chunks")},
    {outcome_sql("responses")}"""


def extraction(spark: SparkSession, sf_dir: str):
    docs = documents(spark, sf_dir)
    spaced = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return extract_names(spaced, stand_in(), EXTRACTION_CHUNK_BYTES, BARE_TEMPLATE)


@query(
    f"""
    WITH {EXTRACTION_SQL},
    seen AS (SELECT DISTINCT doc_id, unnest(names) AS name FROM responses
             WHERE doc_id NOT IN (SELECT doc_id FROM outcome WHERE status = 'rate_limited')),
    counted AS (
        SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) / length(name))
               ::INTEGER AS occurrences
        FROM seen JOIN documents USING (doc_id))
    SELECT doc_id, name, occurrences, (row_number() OVER (
           PARTITION BY doc_id ORDER BY occurrences DESC, name))::INTEGER AS rank
    FROM counted
    """
)
def extracted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(spark, sf_dir).ranked


@query(
    f"""
    WITH {EXTRACTION_SQL}
    SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_failed, 0) AS n_failed,
           coalesce(n_names, 0) AS n_names, coalesce(status, 'ok') AS status, message, details
    FROM documents LEFT JOIN outcome USING (doc_id)
    """
)
def extraction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(spark, sf_dir).outcome


# The stand-in when nothing is refused.
PATIENT_SQL = answers_sql("turns").replace("size % 97 = 0 OR size % 89 = 0 OR size % 11 = 0", "size % 11 = 0").replace(
    """CASE WHEN size % 97 = 0 THEN 'RateLimitError' WHEN size % 89 = 0 THEN 'RuntimeError'
                 WHEN size % 11 = 0""", "CASE WHEN size % 11 = 0").replace(
    """CASE WHEN size % 97 = 0 THEN 'slow down' WHEN size % 89 = 0
                 THEN 'Error code: 429 - quota'
                 WHEN size % 11 = 0""", "CASE WHEN size % 11 = 0")


@query(f"WITH {TURNS_SQL}, {PATIENT_SQL} SELECT doc_id, chunk_idx, response, error_class, error FROM responses")
def resumed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that a refusal stops, and one with the same log that asks what was left."""
    chunks, log = turns(spark, sf_dir), new_table(spark, "log")
    cut_lineage(asking.ask_chunks(chunks, stand_in(), log, BARE_TEMPLATE, flush=1000))
    return asking.ask_chunks(chunks, stand_in(refuses=False), log, BARE_TEMPLATE, flush=1000)


LISTED_SQL = f"""listed AS (
        SELECT DISTINCT unnest({found_sql("text")}) AS name FROM benchmark),
    counts AS (
        SELECT doc_id, name, ((length(text) - length(replace(text, name, ''))) / length(name))
               ::INTEGER AS occurrences
        FROM documents JOIN listed ON contains(text, name))"""


def listed_names_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in all benchmark items, padded and repeated as they come."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = items.select(F.explode(found_names(F.col("text"))).alias("name"))
    return names.unionAll(names.select(F.concat(F.lit(" "), "name", F.lit("\t")).alias("name")))


@query(f"WITH {LISTED_SQL} SELECT doc_id, name, occurrences FROM counts")
def listed_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of names, counted in all documents."""
    return listed.count_listed(documents(spark, sf_dir), listed_names_of_items(spark, sf_dir))


@query(f"WITH {LISTED_SQL} SELECT doc_id, name, occurrences FROM counts")
def listed_name_counts_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a list in several blocks."""
    return listed.count_listed(documents(spark, sf_dir), listed_names_of_items(spark, sf_dir), block_bytes=500)


@query(
    f"""
    WITH {LISTED_SQL}
    SELECT name, count(*) AS n_docs, sum(occurrences)::BIGINT AS occurrences FROM counts GROUP BY name
    """
)
def listed_name_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed.listed_totals(listed.count_listed(documents(spark, sf_dir), listed_names_of_items(spark, sf_dir)))


CORPUS_LISTED_SQL = LISTED_SQL.replace("FROM benchmark", "FROM documents")


@query(
    f"""
    WITH {CORPUS_LISTED_SQL}
    SELECT name, count(*) AS n_docs, sum(occurrences)::BIGINT AS occurrences FROM counts GROUP BY name
    """
)
def corpus_name_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all documents, counted in all documents, also where they stand inside other words."""
    docs = documents(spark, sf_dir)
    names = docs.select(F.explode(found_names(F.col("text"))).alias("name"))
    return listed.listed_totals(listed.count_listed(docs, names))
