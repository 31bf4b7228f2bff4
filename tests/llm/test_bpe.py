import hashlib
import random

import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import functions as F

from castlist.llm import bpe, queries

PATTERN = vocabularies.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = vocabularies.path(request.param)
    codec = bpe.Codec(path, PATTERN)
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.encoder.ranks, special_tokens={})
    return codec, exact


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_random_texts(pair):
    codec, exact = pair
    rng = random.Random(5)
    parts = ["a", "b", " ", "\n", "the", "ing", "tion", "\x1c", "\x85", " ", "　", "é", "ß", "你", "🎉", "½", "'s", "--",
             "\r", "\x00", "<|endoftext|>", "́"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        packed = codec.encode(text)
        assert ids(packed) == exact.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "-" * 5000, " " * 4000, "the" * 2000, "aaab" * 1000 + "b"])
def test_long_pieces(pair, text):
    codec, exact = pair
    assert ids(codec.encode(text)) == exact.encode_ordinary(text)


def test_texts_longer_than_a_block(pair, monkeypatch):
    codec, exact = pair
    monkeypatch.setattr(bpe, "LONG_TEXT", 7)
    text = "The words of a text, in blocks of seven. " * 5
    packed = codec.encode(text)
    assert ids(packed) == exact.encode_ordinary(text) and codec.decode(packed) == text.encode()


def test_pieces_are_forgotten_but_not_lost():
    codec = bpe.Codec(vocabularies.path("byte_bpe_50k.tiktoken"), PATTERN, kept=3)
    text = " ".join(f"qwx{i % 7}zzk" for i in range(60))
    assert codec.decode(codec.encode(text)) == text.encode()
    assert len(codec.pieces) <= 3


def test_columns(table, corpus):
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    exact = bpe.Codec(path, PATTERN)
    rows = corpus(9)
    docs = table(rows).withColumnRenamed("lang", "ids")
    out = docs.select("doc_id", "text", bpe.encode(F.col("text"), path, PATTERN).alias("packed"))
    out = out.withColumn("back", bpe.decode(F.col("packed"), path, PATTERN)).collect()
    assert len(out) == len(rows)
    for row in out:
        assert bytes(row.packed) == exact.encode(row.text or "") and bytes(row.back) == (row.text or "").encode()
    assert table([]).select(bpe.encode(F.col("text"), path, PATTERN)).count() == 0


def test_query_equals_tiktoken_on_every_document(spark):
    folder = "/root/testdata/sf0.001"
    ranks = bpe.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.QUERIES["op4_byte_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) == 200
    for doc in docs:
        own, row = exact.encode_ordinary(doc.text or ""), found[doc.doc_id]
        packed = b"".join(i.to_bytes(4, "little") for i in own)
        assert (row.n_tokens, row.ids_sha256) == (len(own), hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
