"""Every operator on tables with clashing names, text ids, null ids, repeated rows, a very long text, and no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from castlist.llm import (
    bpe,
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

# Names that the operators use for columns of their own.
CLASHING = (
    "row found _doc _text _kept _letter _slot _shard _part place owner number text_hash dropped gone_id digest id prefix later "
    "g x0 m0 l0_0 size far bound salt a b n docs p q spans rare base known _words _full _five block _lang"
).split()

LONG = "one two three four five six seven eight nine ten eleven " * 95_000
BASE = "this is a clean text that has more than ten different words in its only line"


def documents(spark, ids):
    rows = [(1, BASE, "en", "s"), (1, BASE, "en", "s"), (None, BASE + " again", "en", None), (None, None, None, "s"), (2, "", "en", "s"), (3, LONG, "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(ids))
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


def items(spark):
    return spark.createDataFrame([("i", "clean text that has more than ten different words in its"), (None, None)], "item_id string, text string")


VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
# Operators that give a row for each row: what they add or replace, and whether they drop the text or rows.
BY_ROW = {
    "sharding": (lambda spark, d: sharding.assign(d, ["a", "b"], ["doc_id"], 7), ["slot", "shard"], 6),
    "lm": (lambda spark, d: lm.score(d, F.lit(True), VOCABULARY, 1), list(lm._MADE), 6),
    "bpe": (lambda spark, d: d.withColumn("ids", bpe.encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)), ["ids"], 6),
    "contaminated": (lambda spark, d: decontamination.report(d, items(spark)), ["n_words", "matches", "spans", "items", "n_hit", "longest", "contaminated"], 6),
    "clean": (lambda spark, d: decontamination.remove_contaminated(d, items(spark)), [], 3),
    "lines": (lambda spark, d: line_dedup.drop_frequent_lines(d, 2, 1), ["n_lines", "n_dropped"], 6),
    "quality": (lambda spark, d: quality.judge(d), [*quality.BASE, "base_failed", "distance", "kept"], 6),
    "predicted": (lambda spark, d: language_id.predict(d, language_id.fit(d)), ["lang_pred", "score"], 6),
    "identified": (lambda spark, d: language_id.keep_identified(d, language_id.fit(d), 0.0), [], 4),
    "secrets": (lambda spark, d: secret_scan.scan(d), [*secret_scan.COUNTS, "spans"], 6),
}


@pytest.mark.parametrize("ids", ["bigint", "string"])
@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_operators_by_row(spark, name, ids):
    run, made, n = BY_ROW[name]
    docs = documents(spark, ids)
    found = run(spark, docs)
    assert set(found.columns) == (set(docs.columns) - {"text"} | set(made) | set(found.columns) & {"text"})
    assert len(found.columns) == len(set(found.columns))
    rows = found.drop("text").collect()
    assert len(rows) == n
    own = set(CLASHING) - set(made)
    assert all(row[c] == f"own {c}" for row in rows for c in own)
    assert sorted(str(r.doc_id) for r in rows if r.doc_id is not None).count("1") in (0, 2)
    assert run(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_operators_that_search_and_audit(spark, ids):
    docs = documents(spark, ids)
    assert lexical_search.search(docs, items(spark), 2).count() == 2
    assert divergence.audit(docs, 1, 3).where("part = 'term'").count() > 0
    assert lexical_search.search(docs.limit(0), items(spark)).count() == divergence.audit(docs.limit(0)).count() == 0


def test_operators_on_pairs(spark):
    docs = documents(spark, "bigint")
    assert simhash.near_groups(docs).count() == suffix_dedup.remove_repeats(docs).count() == 6
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["id"] for r in kept.drop("text").collect()} == {"own id"}
    assert kept.count() == 6 and kept.where("doc_id is null").count() == 2
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
