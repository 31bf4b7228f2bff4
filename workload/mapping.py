"""Queries on the mapping table and on replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.operators import mapping as mappings
from castlist.operators import names as naming
from castlist.operators import replacing
from castlist.plans.incremental import export_changed
from castlist.plans.rename import export_documents, replaced_documents
from castlist.plans.rename import exported_counts as rename_counts
from castlist.session import cut_lineage, new_table
from castlist.sources import files
from castlist.sources.tables import read_table

import workload
from workload import documents, query
from workload.files import PATH_SQL, path_of, suffixed_sql
from workload.names import OWN_COUNTS_SQL, own_names, stored_names

RANKED_SQL = f"""{OWN_COUNTS_SQL},
    ranked AS (
        SELECT doc_id, name, occurrences, (row_number() OVER (
               PARTITION BY doc_id ORDER BY occurrences DESC, name))::INTEGER AS rank
        FROM counts)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.count_own_names(own_names(spark, sf_dir))


@query(
    f"""
    WITH {RANKED_SQL}
    SELECT doc_id, name, occurrences, rank, name || ' (' || occurrences || ')' AS label FROM ranked
    """
)
def ranked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names counted and ranked inside the row of their own text."""
    label = mappings.label(F.col("name"), F.col("occurrences"))
    return ranked(spark, sf_dir).withColumn("label", label)


@query(
    f"""
    WITH {OWN_COUNTS_SQL},
    padded AS (SELECT doc_id, name, occurrences FROM counts
               UNION ALL SELECT doc_id, 'zz unseen', 0 FROM own GROUP BY doc_id)
    SELECT doc_id, name, occurrences, (row_number() OVER (
           PARTITION BY doc_id ORDER BY occurrences DESC, name))::INTEGER AS rank
    FROM padded
    """
)
def ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and counts as separate tables, with one uncounted name per document."""
    names = stored_names(spark, sf_dir)
    counts = naming.count_occurrences(documents(spark, sf_dir), names)
    unseen = names.select("doc_id", F.lit("zz unseen").alias("name")).distinct()
    return mappings.rank_names(names.unionByName(unseen), cut_lineage(counts))


@query(
    f"""
    WITH {RANKED_SQL}
    SELECT doc_id, name, occurrences, rank FROM ranked
    """
)
def ranked_rows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for documents with more names than one task should sort."""
    counts = cut_lineage(ranked(spark, sf_dir).drop("rank"))
    return mappings.rank_names(counts, rows_per_task=10)


TOP_SQL = f"""
    WITH {RANKED_SQL}
    SELECT doc_id, name, occurrences, rank FROM ranked WHERE rank <= 3
    """


@query(TOP_SQL)
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best names of every document, without a shuffle."""
    return naming.count_own_names(own_names(spark, sf_dir), top=3)


@query(TOP_SQL)
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of counts."""
    counts = ranked(spark, sf_dir).drop("rank")
    return mappings.top_names(counts, 3)


# Edits made by rule: a reversed name, capitals, the name itself, a blank, the
# name with its rank; names mentioned more than once are edited again.
EDITS_SQL = f"""{RANKED_SQL},
    edits AS (
        SELECT doc_id, name AS original, CASE rank % 5 WHEN 1 THEN reverse(name)
               WHEN 2 THEN ' ' || upper(name) || ' ' WHEN 3 THEN name WHEN 4 THEN '  '
               ELSE name || rank END AS replacement, 1 AS edit_no
        FROM ranked
        UNION ALL
        SELECT doc_id, name, name || ' II', 2 FROM ranked WHERE occurrences > 1),
    last_edits AS (
        SELECT doc_id, original, arg_max(replacement, edit_no) AS replacement
        FROM edits GROUP BY doc_id, original),
    rows AS (
        SELECT r.doc_id, name AS original, coalesce(e.replacement, '') AS replacement,
               occurrences AS occurrence_count, rank
        FROM ranked r LEFT JOIN last_edits e ON r.doc_id = e.doc_id AND r.name = e.original),
    edited AS (
        SELECT doc_id, original, trim(replacement) AS replacement, rank
        FROM rows WHERE trim(replacement) <> '' AND trim(replacement) <> original)"""


def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cut_lineage(ranked(spark, sf_dir))
    turn = F.col("rank") % 5
    name = F.col("name")
    replacement = (
        F.when(turn == 1, F.reverse(name))
        .when(turn == 2, F.concat(F.lit(" "), F.upper(name), F.lit(" ")))
        .when(turn == 3, name)
        .when(turn == 4, F.lit("  "))
        .otherwise(F.concat(name, F.col("rank").cast("string")))
    )
    first = names.select(
        "doc_id", name.alias("original"), replacement.alias("replacement"), F.lit(1).alias("edit_no")
    )
    second = names.where(F.col("occurrences") > 1).select(
        "doc_id",
        name.alias("original"),
        F.concat(name, F.lit(" II")).alias("replacement"),
        F.lit(2).alias("edit_no"),
    )
    return mappings.apply_edits(mappings.name_rows(names), first.unionByName(second))


@query(f"WITH {EDITS_SQL} SELECT doc_id, original, replacement, occurrence_count, rank FROM rows")
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_rows(spark, sf_dir)


@query(f"WITH {EDITS_SQL} SELECT doc_id, original, replacement, rank FROM edited")
def edited_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.edited_mappings(edited_rows(spark, sf_dir))


@query(
    f"""
    WITH {EDITS_SQL},
    repeated AS (
        SELECT * FROM rows
        UNION ALL SELECT doc_id, original, original || ' again', occurrence_count, rank + 1000000
        FROM rows WHERE rank % 3 = 0),
    edited_again AS (
        SELECT doc_id, original, trim(replacement) AS replacement, rank
        FROM repeated WHERE trim(replacement) <> '' AND trim(replacement) <> original)
    SELECT doc_id, original, arg_max(replacement, rank) AS replacement, min(rank) AS rank
    FROM edited_again GROUP BY doc_id, original
    """
)
def repeated_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in which a third of the originals have a second row."""
    rows = edited_rows(spark, sf_dir)
    again = rows.where(F.col("rank") % 3 == 0).withColumns(
        {
            "replacement": F.concat("original", F.lit(" again")),
            "rank": F.col("rank") + 1_000_000,
        }
    )
    return mappings.edited_mappings(rows.unionByName(again))


@query(
    f"""
    WITH {EDITS_SQL}
    SELECT doc_id, count(*) FILTER (trim(replacement) <> '' AND trim(replacement) <> original)
           AS n_edited
    FROM rows GROUP BY doc_id
    """
)
def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.edited_counts(edited_rows(spark, sf_dir))


@query(
    f"""
    WITH {EDITS_SQL}
    SELECT doc_id, original, '' AS replacement, occurrence_count, rank FROM rows
    """
)
def reset_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.reset_all(edited_rows(spark, sf_dir))


@query(
    f"""
    WITH {EDITS_SQL}
    SELECT doc_id, original, CASE WHEN rank = 2 THEN '' ELSE replacement END AS replacement,
           occurrence_count, rank
    FROM rows
    """
)
def reset_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.reset_row(edited_rows(spark, sf_dir), 1)


# Mappings to apply: a third of the names turn into the next name of their
# document, so that replacements chain, a third grow, a third are reversed. One
# name per document is not in its text.
MAPPINGS_SQL = f"""{RANKED_SQL},
    mappings AS (
        SELECT doc_id, name AS original, rank, CASE rank % 3 WHEN 1 THEN coalesce(
               lead(name) OVER (PARTITION BY doc_id ORDER BY rank), 'Nobody')
               WHEN 2 THEN name || ' of ' || name ELSE reverse(name) END AS replacement
        FROM ranked
        UNION ALL SELECT DISTINCT doc_id, 'Unseen', 0, 'Seen' FROM ranked),
    steps AS (
        SELECT doc_id, list({{'original': original, 'replacement': replacement, 'text': '',
                   'counts': CAST([] AS BIGINT[])}} ORDER BY length(original) DESC, rank) AS steps
        FROM mappings GROUP BY doc_id),
    folded AS (
        SELECT doc_id, steps, list_reduce(coalesce(steps, []), lambda a, m: {{
            'original': '', 'replacement': '',
            'text': replace(a.text, m.original, m.replacement),
            'counts': list_append(a.counts, (length(a.text)
                - length(replace(a.text, m.original, ''))) // length(m.original))}},
            {{'original': '', 'replacement': '', 'text': text, 'counts': CAST([] AS BIGINT[])}}
            ) AS result
        FROM documents LEFT JOIN steps USING (doc_id)),
    step_counts AS (
        SELECT doc_id, unnest(steps).original AS original, unnest(result.counts) AS n,
               generate_subscripts(result.counts, 1) AS step
        FROM folded WHERE steps IS NOT NULL)"""


def stored_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping table as it would be stored after editing."""
    names = cut_lineage(ranked(spark, sf_dir))
    following = names.select(
        "doc_id", (F.col("rank") - 1).alias("rank"), F.col("name").alias("next_name")
    )
    name = F.col("name")
    turn = F.col("rank") % 3
    replacement = (
        F.when(turn == 1, F.coalesce("next_name", F.lit("Nobody")))
        .when(turn == 2, F.concat(name, F.lit(" of "), name))
        .otherwise(F.reverse(name))
    )
    rows = names.join(following, ["doc_id", "rank"], "left").select(
        "doc_id",
        name.alias("original"),
        replacement.alias("replacement"),
        F.col("occurrences").alias("occurrence_count"),
        "rank",
    )
    unseen = names.where(F.col("rank") == 1).select(
        "doc_id",
        F.lit("Unseen").alias("original"),
        F.lit("Seen").alias("replacement"),
        F.lit(0).alias("occurrence_count"),
        F.lit(0).alias("rank"),
    )
    return cut_lineage(rows.unionByName(unseen))


def applied(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    table = stored_mappings(spark, sf_dir)
    return replacing.apply_replacements(documents(spark, sf_dir), table, **options)


REPLACED_SQL = f"""
    WITH {MAPPINGS_SQL}
    SELECT doc_id, md5(result.text) AS text_md5, coalesce(len(steps), 0)::INTEGER AS n_names,
           coalesce(list_sum(result.counts), 0)::INTEGER AS total
    FROM folded
    """


def replaced_rows(result: DataFrame) -> DataFrame:
    return replacing.replaced_texts(result).select(
        "doc_id", F.md5("text").alias("text_md5"), "n_names", "total"
    )


@query(REPLACED_SQL)
def replaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced_rows(applied(spark, sf_dir))


@query(REPLACED_SQL)
def replaced_text_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for more mappings than can be broadcast."""
    return replaced_rows(applied(spark, sf_dir, broadcast_bytes=0))


@query(REPLACED_SQL)
def replaced_text_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for documents with more mappings than one task should hold."""
    return replaced_rows(applied(spark, sf_dir, broadcast_bytes=0, rows_per_task=10))


@query(
    f"""
    WITH {MAPPINGS_SQL}
    SELECT doc_id, step::INTEGER AS step, original, n::INTEGER AS n FROM step_counts
    """
)
def replacement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacing.replacement_counts(applied(spark, sf_dir))


@query(
    f"""
    WITH {MAPPINGS_SQL}
    SELECT doc_id, sum(n)::BIGINT AS total, count(*) AS n_names FROM step_counts GROUP BY doc_id
    """
)
def replacement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacing.replacement_summary(replacing.replacement_counts(applied(spark, sf_dir)))


@query(
    f"""
    WITH {MAPPINGS_SQL}
    SELECT doc_id, step::INTEGER AS step, original, n::INTEGER AS n FROM step_counts WHERE n > 0
    """
)
def names_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacing.names_replaced(replacing.replacement_counts(applied(spark, sf_dir)))


@query(
    f"""
    WITH {MAPPINGS_SQL},
    paths AS (SELECT doc_id, {PATH_SQL} AS path FROM documents),
    exported AS (
        SELECT doc_id, {suffixed_sql("path", "_processed")} AS path, result.text AS text,
               CASE doc_id % 2 WHEN 0 THEN 'utf-8-sig' ELSE 'gb18030' END AS encoding
        FROM folded JOIN paths USING (doc_id)
        WHERE doc_id IN (SELECT doc_id FROM mappings WHERE replacement <> original))
    SELECT path, encoding, md5(CASE encoding WHEN 'utf-8-sig'
           THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text) ELSE encode(text) END) AS content_md5
    FROM exported
    """
)
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = export_documents(files_of(spark, sf_dir), stored_mappings(spark, sf_dir))
    return files.encoded(exported).select("path", "encoding", F.md5("content").alias("content_md5"))


@query(
    f"""
    WITH {MAPPINGS_SQL},
    paths AS (SELECT doc_id, {PATH_SQL} AS path FROM documents),
    edited AS (SELECT doc_id, original FROM mappings WHERE replacement <> original)
    SELECT {suffixed_sql("path", "_processed")} AS path, (row_number() OVER (
           PARTITION BY doc_id ORDER BY step))::INTEGER AS step, original, n::INTEGER AS n
    FROM step_counts JOIN edited USING (doc_id, original) JOIN paths USING (doc_id)
    """
)
def exported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name was replaced, from the run that also gives the texts."""
    run = cut_lineage(replaced_documents(files_of(spark, sf_dir), stored_mappings(spark, sf_dir)))
    return rename_counts(run).select("path", "step", "original", "n")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as loaded files (doc_id, path, text, encoding)."""
    table = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", tasks=workload.TASKS)
    encoding = F.when(F.pmod("doc_id", F.lit(2)) == 0, "utf-8-sig").otherwise("gb18030")
    return table.select(
        "doc_id",
        path_of(F.col("doc_id"), F.col("source")).alias("path"),
        "text",
        encoding.alias("encoding"),
    )


# The mappings after a second round of edits, in every seventh document.
EDITED_AGAIN_SQL = MAPPINGS_SQL.replace(
    "CASE rank % 3 WHEN 1 THEN", "CASE WHEN doc_id % 7 = 0 AND rank = 1 THEN name || ' I' WHEN rank % 3 = 1 THEN"
).replace("WHEN 2 THEN name", "WHEN rank % 3 = 2 THEN name")


@query(
    f"""
    WITH {EDITED_AGAIN_SQL}
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS run, md5(result.text) AS text_md5
    FROM folded WHERE steps IS NOT NULL
    """
)
def reexported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export, and another after some edits, which writes the files of the edited documents alone."""
    folder = new_table(spark, "castlist-export")
    name = F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = files_of(spark, sf_dir).withColumns({"path": name, "encoding": F.lit("utf-8")})
    rows = stored_mappings(spark, sf_dir)
    export_changed(docs, rows, folder)
    edited = F.when(
        (F.col("doc_id") % 7 == 0) & (F.col("rank") == 1), F.concat("original", F.lit(" I"))
    ).otherwise(F.col("replacement"))
    done = export_changed(docs, cut_lineage(rows.withColumn("replacement", edited)), folder)
    number = F.regexp_extract("path", r"(\d+)_processed\.txt$", 1).cast("bigint")
    texts = files.read_files(spark, folder).select(number.alias("doc_id"), F.md5("content").alias("text_md5"))
    return done.manifest.select("doc_id", "run").join(texts, "doc_id")
