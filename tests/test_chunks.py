import random
import re

import pytest
from pyspark.sql import functions as F

from castlist.functions import splitting
from castlist.operators import chunks


def chunk_lists(docs, max_bytes=chunks.CHUNK_MAX_BYTES):
    found: dict[int, dict[int, str]] = {}
    for row in chunks.split_into_chunks(docs, max_bytes).collect():
        assert row.n_bytes == len(row.chunk.encode())
        found.setdefault(row.doc_id, {})[row.chunk_idx] = row.chunk
    for places in found.values():
        assert sorted(places) == list(range(len(places)))
    return {doc: [places[i] for i in sorted(places)] for doc, places in found.items()}


@pytest.mark.parametrize(
    "text, parts",
    [
        (
            "First paragraph.\n\nSecond paragraph.\n\nThird paragraph.",
            ["First paragraph.", "Second paragraph.", "Third paragraph."],
        ),
        ("", []),
        ("   ", []),
        ("\n\n\n", []),
        ("Para 1.\r\n\r\nPara 2.", ["Para 1.", "Para 2."]),
        ("a\nb\n 　\t\n\n\nc", ["a\nb", "c"]),
        ("a\n\x1c\nb", ["a", "b"]),
        (" a \n\nb", ["a", "b"]),
    ],
)
def test_paragraphs(evaluate, text, parts):
    assert evaluate(splitting.paragraphs, text) == parts


@pytest.mark.parametrize(
    "text", ["ab. c..d", "一。二！ 三？\n四；", "no end", "...", "a.　b!\x1cc", ";x"]
)
def test_sentences(evaluate, text):
    expected = [s for s in re.split(r"(?<=[。！？；.!?;])\s*", text) if s.strip()]
    assert evaluate(splitting.sentences, text) == expected


@pytest.mark.parametrize(
    "text, limit, pieces",
    [
        ("一二三四五", 10, ["一二三", "四五"]),
        ("abc", 2, ["a", "b", "c"]),
        ("一🎉a", 1, ["一", "🎉", "a"]),
        ("一🎉a", 5, ["一", "🎉", "a"]),
        ("a🎉", 6, ["a🎉"]),
        ("", 5, []),
    ],
)
def test_byte_pieces(evaluate, text, limit, pieces):
    assert evaluate(lambda c: splitting.byte_pieces(c, limit), text) == pieces
    assert "".join(pieces) == text


def test_oversized_sentence_keeps_to_itself(docs_of):
    assert chunk_lists(docs_of("A. B. CCCCCCCCCC. D."), 8)[0] == ["A.B.", "CCCCCCC", "CCC.", "D."]


def test_mixed_paragraphs(docs_of):
    text = "这是一个测试段落。" * 100 + "\n\n" + "另一个段落。" * 100
    found = chunk_lists(docs_of(text), 500)[0]
    assert all(1 <= len(c.encode()) < 500 for c in found)
    assert "".join(found) == text.replace("\n\n", "")


def test_large_text(docs_of):
    paragraph = "这是小说中的一个段落。张三和李四在讨论事情。" * 10
    found = chunk_lists(docs_of("\n\n".join([paragraph] * 30)))[0]
    assert len(found) > 1
    assert all(len(c.encode()) < chunks.CHUNK_MAX_BYTES for c in found)
    assert "\n\n".join(found) == "\n\n".join([paragraph] * 30)


def test_blank_documents_have_no_chunks(docs_of):
    assert chunk_lists(docs_of("", " \n\n ", "x")) == {2: ["x"]}


def grow_one_by_one(text, limit):
    """Slow model of the rules: add the next unit and look at the size."""
    size = lambda s: len(s.encode())
    done, open_chunk, open_run = [], None, None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    units = []
    for i, para in enumerate(p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()):
        if size(para) < limit:
            units.append(("paragraphs", "\n\n", para))
            continue
        for sentence in re.split(r"(?<=[。！？；.!?;])\s*", para):
            if sentence.strip():
                units.append((i, "", sentence))
    for run, gap, unit in units:
        joined = unit if open_run != run else open_chunk + gap + unit
        if open_run == run and size(joined) < limit:
            open_chunk = joined
            continue
        if open_chunk is not None:
            done.append(open_chunk)
        open_chunk, open_run = unit, run
        if size(unit) >= limit:
            piece = ""
            for char in unit:
                if piece and size(piece + char) >= limit:
                    done.append(piece)
                    piece = ""
                piece += char
            done.append(piece)
            open_chunk = open_run = None
    return done + ([open_chunk] if open_chunk is not None else [])


@pytest.mark.parametrize("limit", [3, 8, 20, 64])
def test_random_texts(docs_of, limit):
    rng = random.Random(limit)
    parts = ["字", "word", "。", ". ", "!", "\n", "\n\n", "\r\n\r\n", "🎉", "é", " ", "；", "long" * 9]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    found = chunk_lists(docs_of(*texts), limit)
    for i, text in enumerate(texts):
        assert found.get(i, []) == grow_one_by_one(text, limit), text


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_partitioning_does_not_matter(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    shuffled = docs.orderBy(F.xxhash64("doc_id")).repartition(partitions)
    assert chunk_lists(shuffled, 700) == chunk_lists(docs, 700)


def test_driver_documents_keep_their_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = chunk_lists(docs, 512)
    for doc_id, text in docs.collect():
        parts = found.get(doc_id, [])
        assert all(len(c.encode()) < 512 for c in parts)
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
