"""From documents to token ids: five stages, each over all that the one before has kept.

1. ``language``: documents whose language the network of ``language_id`` cannot tell go.
2. ``line_dedup``: lines that 10 documents share go from all of them.
3. ``near_dedup``: of documents whose SimHash fingerprints differ in at most three bits, or that share four fifths
   of their shingles of five words, the one with the smallest doc_id stays.
4. ``decontamination``: documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go.
5. ``encode``: the ids of every text, checked by decoding them.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the
next. Null and empty texts: the first stage rejects them, having no letter; texts that lose all
their lines stay as empty ones, one of which outlasts the third stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlist.llm import bpe, decontamination, language_id, line_dedup, simhash
from castlist.llm.common import bounded_batches
from castlist.session import cut_lineage, ship_package


# Workers that have run the other stages too keep fewer pieces of the last one.
KEPT_PIECES = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of an identified language."""
    bounded_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without frequent lines, n_chars set anew."""
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_length=1)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded_batches(spark)
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a part of the benchmark."""
    items = bounded_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs, items, window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, restored): ids as packed 32-bit integers, and whether they decode to the text."""
    bounded_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = docs.withColumn("ids", bpe.encode(F.col("text"), path, pattern, KEPT_PIECES))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), path, pattern, KEPT_PIECES))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == whole).alias("restored"),
    )


STAGES = [
    ("language", language),
    ("line_dedup", shared_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encode", encode),
]

# A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
