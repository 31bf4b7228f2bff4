import random

import pytest
from pyspark.sql import functions as F

from castlist.functions import layout
from castlist.operators import chunks, long_chunks, long_layout, segments
from castlist.sources import datasource, files
from tests.test_layout import GOLDENS

PIECES = [
    "第", "一", "2", "章", "回", "他走了", "过来", "。", "！", "”", "\"", "Hello", "wor", "ld", "a", "1", ".", "…",
    "\n", "\n", "\n\n", "\r\n", "\r", " ", "  ", "\t", "\u3000", "\u3000\u3000", "\xa0", "\x0b", "\u2028",
]


def texts(seed, n=60):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]
    return [*made, *(before for before, _ in GOLDENS), "", "\n", "\r", "\r\n", " \n "]


def cuts(rng, text):
    """The text in pieces cut anywhere, some empty."""
    places = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 6)))
    bounds = [0, *places, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def segment_rows(spark, documents):
    rows = [(i, k, part) for i, parts in enumerate(documents) for k, part in enumerate(parts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, seg_idx int, text string")


def joined(df, glue=""):
    return {r.doc_id: r.text for r in segments.joined_segments(df, glue).collect()}


def unix(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def test_states_have_numbers():
    assert [s.number for s in long_layout.STATES] == list(range(80)) and len(set(long_layout.STATES)) == 80


def test_steps_are_the_fold():
    for text in texts(1, 400):
        lines = unix(text).split("\n")
        assert long_layout.repair(lines, long_layout.State()) == layout.repair_layout_text(text)


def test_summaries_are_associative():
    rng = random.Random(2)
    for text in texts(2, 100):
        lines = unix(text).split("\n")
        k = rng.randint(0, len(lines))
        first, second = long_layout.summary(lines[:k]), long_layout.summary(lines[k:])
        assert [second[n] for n in first] == long_layout.summary(lines)
    assert long_layout.summary([]) == list(range(80))


@pytest.mark.parametrize("seed", range(2))
def test_every_cut_gives_the_fold(spark, seed):
    rng = random.Random(seed)
    documents = [cuts(rng, text) for text in texts(seed) for _ in range(3)]
    rows = segment_rows(spark, documents)
    lines = joined(segments.whole_lines(rows), "\n")
    assert lines == {i: unix("".join(parts)) for i, parts in enumerate(documents)}
    repaired = joined(long_layout.repair_segments(rows))
    assert repaired == {i: layout.repair_layout_text("".join(parts)) for i, parts in enumerate(documents)}


def test_missing_texts_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "\nb")], "doc_id bigint, seg_idx int, text string")
    assert joined(long_layout.repair_segments(rows)) == {1: "a b"}
    assert long_layout.repair_segments(rows.limit(0)).count() == 0


def test_cutting(spark, docs_of):
    rows = segments.cut_into_segments(docs_of("一🎉ab", "", "xyz"), 3).collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "一🎉a"), (0, 1, "b"), (1, 0, ""), (2, 0, "xyz")]


CHUNK_PIECES = ["ab", "é", "一二三", "word ", ". ", "。", "\n", "\n\n", "\n \n", "\r\n\r\n", "\r", "x" * 30, "🎉"]


def chunked(df):
    found = {}
    for r in df.collect():
        assert r.n_bytes == len(r.chunk.encode())
        found.setdefault(r.doc_id, []).append((r.chunk_idx, r.chunk))
    return {i: sorted(rows) for i, rows in found.items()}


@pytest.mark.parametrize("max_bytes", [1, 8, 25, 60])
def test_every_cut_gives_the_chunks_of_the_whole(spark, max_bytes):
    rng = random.Random(max_bytes)
    made = ["".join(rng.choices(CHUNK_PIECES, k=rng.randint(0, 60))) for _ in range(60)]
    documents = [cuts(rng, text) for text in made for _ in range(2)]
    rows = segment_rows(spark, documents)
    whole = spark.createDataFrame([(i, "".join(parts)) for i, parts in enumerate(documents)], "doc_id bigint, text string")
    found = chunked(long_chunks.chunk_segments(rows, max_bytes))
    assert found == chunked(chunks.split_into_chunks(whole, max_bytes))


def test_paragraphs_stay_whole(spark):
    rng = random.Random(3)
    made = ["".join(rng.choices(CHUNK_PIECES, k=40)) for _ in range(40)]
    rows = segment_rows(spark, [cuts(rng, text) for text in made])
    from pyspark.sql import functions as F

    from castlist.functions import splitting

    split = lambda df: df.select("doc_id", "seg_idx", F.posexplode(splitting.paragraphs(F.col("text"))).alias("pos", "p"))
    found = {}
    for r in split(segments.whole_paragraphs(rows)).orderBy("doc_id", "seg_idx", "pos").collect():
        found.setdefault(r.doc_id, []).append(r.p)
    docs = spark.createDataFrame([(i, 0, text) for i, text in enumerate(made)], "doc_id bigint, seg_idx int, text string")
    wanted = {}
    for r in split(docs).orderBy("doc_id", "pos").collect():
        wanted.setdefault(r.doc_id, []).append(r.p)
    assert found == wanted


def test_a_chunk_over_many_segments(spark):
    rows = segment_rows(spark, [["a\n", "\nb", "\n", "\n", "c\n\n", "", "d", "e"]])
    assert chunked(long_chunks.chunk_segments(rows, 100)) == {0: [(0, "a\n\nb\n\nc\n\nde")]}
    assert chunked(long_chunks.chunk_segments(rows, 5)) == {0: [(0, "a\n\nb"), (1, "c"), (2, "de")]}


def test_files_in_segments_and_back(spark, tmp_path):
    rng = random.Random(4)
    made = {f"{i}.txt": "".join(rng.choices("aé漢🎉\n", k=rng.choice([0, 1, 7, 300]))) for i in range(12)}
    (tmp_path / "in").mkdir()
    for name, text in made.items():
        (tmp_path / "in" / name).write_bytes(b"\xef\xbb\xbf" * (name < "3") + text.encode())
    for size in (1, 2, 5, 64, 1 << 20):
        rows = files.read_segments(spark, str(tmp_path / "in"), size)
        found = {}
        for r in rows.collect():
            assert r.reason is None
            found.setdefault(r.path.rpartition("/")[2], []).append((r.seg_idx, r.text))
        assert {name: "".join(t for _, t in sorted(parts)) for name, parts in found.items()} == made
    out = files.read_segments(spark, str(tmp_path / "in"), 5)
    moved = out.withColumn("path", F.replace("path", F.lit("/in/"), F.lit("/out/")))
    assert files.save_segments(moved) == len(made)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == made


def test_long_files_are_dealt_out(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    (tmp_path / "b.txt").write_bytes(b"")
    monkeypatch.setattr(datasource, "TASK_BYTES", 30)
    reader = datasource.SegmentReader({"paths": f'["file:{tmp_path}"]', "size": "10"})
    parts = [[(path[-5:], first, end) for path, _, first, end in p.parts] for p in reader.partitions()]
    assert parts == [[("a.txt", 0, 3)], [("a.txt", 3, 6)], [("a.txt", 6, 9)], [("a.txt", 9, 10), ("b.txt", 0, 1)]]
    monkeypatch.setattr(datasource, "BATCH_BYTES", 20)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [2, 1, 2, 1, 2, 1, 2]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"good" + b"\xff\xfe" + b"good")
    rows = {r.seg_idx: (r.text, r.reason) for r in files.read_segments(spark, str(tmp_path), 4).collect()}
    assert rows == {0: ("good", None), 1: (None, "not valid as utf-8"), 2: ("od", None)}


def test_layout_of_files_longer_than_a_cell_may_be(spark, tmp_path):
    text = "第一章 开始\r\n\r\n　　他走了\n过来。\n" * 40
    (tmp_path / "long.txt").write_bytes(text.encode())
    rows = files.read_segments(spark, str(tmp_path), 37).withColumnRenamed("path", "doc_id")
    repaired = long_layout.repair_segments(rows.select("doc_id", "seg_idx", "text"))
    saved = repaired.withColumn("path", F.concat("doc_id", F.lit(".fixed")))
    assert files.save_segments(saved) == 1
    assert (tmp_path / "long.txt.fixed").read_text() == layout.repair_layout_text(text)


def test_chunks_of_segments_are_cut_once(spark):
    rows = segment_rows(spark, [["a\n", "\nb", "\n\nc"], ["d"]])
    made = long_chunks.chunk_segments(rows, 100)
    # Neither Python's summaries nor its cuts are in the plan that is left: both have been stored.
    assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert chunked(made) == {0: [(0, "a\n\nb\n\nc")], 1: [(0, "d")]}
