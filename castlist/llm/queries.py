"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from castlist.llm import (
    bpe,
    chat,
    decontamination,
    divergence,
    language_id,
    lexical_search,
    line_dedup,
    lm,
    quality,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
)
from castlist.llm.common import LOWER, SPACES, UPPER, read, remainder
from castlist.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{i:03d}" for i in range(256)]

# White space as SQL strings of DuckDB.
SQL_SPACES = "||".join(f"chr({ord(c)})" for c in SPACES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(ship_package(spark), sf_dir)

        QUERIES[run.__name__] = shipped
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of 256."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(docs, SHARDS, ["doc_id"])


@query("""
WITH bytes AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM bytes)
), first AS (
    SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k
), gone AS (
    SELECT doc_id, i FROM windows JOIN first USING (k) WHERE first_doc < doc_id
), numbered AS (
    SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM gone)
), spans AS (
    SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY doc_id, run
), between_spans AS (
    SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans
), cut AS (
    SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last_e,
           string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head
    FROM between_spans JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last_e, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
""")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the strings of 50 bytes that stand in an earlier one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document, by a model of four fifths of them and by their word frequencies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 1
    scored = lm.score(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and the text they stand for."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = docs.select("doc_id", bpe.encode(F.col("text"), path, pattern).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), path, pattern))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), sized AS (
    SELECT item_id, w, least(len(w), 10) AS n FROM item_words WHERE len(w) > 0
), windows AS (
    SELECT item_id, n, i AS a, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), lengths AS (
    SELECT DISTINCT n FROM windows
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), found AS (
    SELECT doc_id, item_id, a, i, places.n FROM places JOIN windows USING (k) WHERE places.n = windows.n
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), met AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), diagonals AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - a ORDER BY i) AS island FROM found
), matches AS (
    SELECT doc_id, item_id, min(a) - 1 AS item_word, min(i) - 1 AS word, count(*) + n - 1 AS length
    FROM diagonals GROUP BY doc_id, item_id, n, i - a, island
), longest AS (
    SELECT doc_id, count(*) AS n_matches, max(length) AS longest,
           sha256(string_agg(CAST(item_id AS VARCHAR) || ':' || item_word || ':' || word || ':' || length, ','
                             ORDER BY CAST(item_id AS VARCHAR), item_word, word)) AS matches_sha256
    FROM matches GROUP BY doc_id
)
SELECT doc_words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_matches, 0) AS n_matches, coalesce(longest, 0) AS longest,
       coalesce(matches_sha256, sha256('')) AS matches_sha256
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id) LEFT JOIN longest USING (doc_id)
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in a benchmark item, and the longest matches with their places."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found = decontamination.report(docs, items, window=10)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    ordered = F.array_sort(
        F.transform("matches", lambda m: F.struct(m["item_id"].cast("string").alias("item"), m["item_word"], m["word"], m["length"]))
    )
    places = F.transform(ordered, lambda m: F.concat_ws(":", m["item"], m["item_word"], m["word"], m["length"]))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("matches").cast("long").alias("n_matches"),
        "longest",
        F.sha2(F.array_join(places, ","), 256).alias("matches_sha256"),
    )


@query(f"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, {SQL_SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines
), frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that 10 documents share."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_length=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component it belongs to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_groups(docs, size=3, radius=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every document and whether it is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held_out))
    judged = language_id.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# Texts of a conversation that hold the marks of templates.
MARKED_TURNS = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@query(r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS n
    FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
), sized AS (
    SELECT *, n = max(n) OVER (PARTITION BY conv_id) AS is_last,
           sum(15 + length(role) + length(text)
               + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
               + length(regexp_replace(text, '[^\\#<]', '', 'g')))
           OVER (PARTITION BY conv_id ORDER BY n) AS upto
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the examples of every conversation say, read back from their text."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED_TURNS, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.expand(turns.unionByName(marked)))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(r"""
WITH split AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), used AS (
    SELECT d, lang, source, item, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS item FROM split) GROUP BY ALL
), kept AS (
    SELECT lang, item, CAST(sum(n) AS HUGEINT) AS lang_n FROM used GROUP BY lang, item HAVING count(*) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM split
), grid AS (
    SELECT lang, source, item, lang_n, CAST(coalesce(n, 0) AS HUGEINT) AS n
    FROM groups JOIN kept USING (lang)
    LEFT JOIN (SELECT lang, source, item, sum(n) AS n FROM used GROUP BY ALL) USING (lang, source, item)
), totals AS (
    SELECT *, sum(n) OVER own AS total, count(*) OVER own AS kinds, sum(lang_n) OVER own AS lang_total
    FROM grid WINDOW own AS (PARTITION BY lang, source)
), shares AS (
    SELECT lang, source, item, n, CAST(1 + 1000000000 * (n + 2) // (total + 2 * kinds) AS HUGEINT) AS p,
           CAST(1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * kinds) AS HUGEINT) AS q
    FROM totals
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), every AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM every)
WHERE part = 'pair' OR place <= 10
""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source lies from the others of its language, and the terms that set it apart."""
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=10, top=10)


@query(r"""
WITH item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark
), docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), totals AS (
    SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM docs
), sized AS (
    SELECT doc_id, 100 - 50 + (50 * len(w) * big_n) // big_l AS m FROM docs, totals WHERE len(w) > 0
), uses AS (
    SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) GROUP BY ALL
), weighed AS (
    SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM uses, totals GROUP BY t, big_n
), scored AS (
    SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM uses JOIN item_terms USING (t) JOIN weighed USING (t) JOIN sized USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= 50
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that answer every benchmark item best."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=50)


@query()
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the secrets of every document stand."""
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secret_scan.joined(secret_scan.known(F.col("spans")))
    spans = secret_scan.joined(F.col("spans"))
    return found.select("doc_id", *secret_scan.COUNTS, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))
