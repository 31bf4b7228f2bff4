import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from castlist.plans.normalize import normalize_files
from castlist.plans.rename import export_documents
from castlist.sources import datasource, files, paths
from castlist.streaming.files import stream_files

SAMPLES = {
    "plain.txt": ("plain".encode(), "plain", "utf-8"),
    "中.txt": ("中文 é 🎉".encode(), "中文 é 🎉", "utf-8"),
    "bom.txt": (b"\xef\xbb\xbfHello with BOM", "Hello with BOM", "utf-8-sig"),
    "only_bom.txt": (b"\xef\xbb\xbf", "", "utf-8-sig"),
    "le.txt": (b"\xff\xfe" + "中文🎉".encode("utf-16-le"), "中文🎉", "utf-16-le"),
    "be.txt": (b"\xfe\xff" + "中文".encode("utf-16-be"), "中文", "utf-16-be"),
    "a b%20 #中.txt": (b"odd name", "odd name", "utf-8"),
    "gb.txt": ("中文内容测试".encode("gb18030"), "中文内容测试", "gb18030"),
    "gb4.txt": ("한é🎉".encode("gb18030"), "한é🎉", "gb18030"),
    "sjis.txt": (b"\x83\x65\x80", None, None),
    "shift.txt": (b"\xa0\x41\xb1\xfd\x31", None, None),
    "broken_bom.txt": (b"\xef\xbb\xbf\xff", None, None),
    "broken_le.txt": (b"\xff\xfe\x00", None, None),
    "lone.txt": (b"\xfe\xff\xd8\x00", None, None),
    "surrogate.txt": (b"\xed\xa0\x80", None, None),
}
REASONS = {
    "broken_bom.txt": "not valid after its utf-8-sig mark",
    "broken_le.txt": "not valid after its utf-16-le mark",
    "lone.txt": "not valid after its utf-16-be mark",
}


def expected_of(data):
    """What the rules say, asked of Python's codecs one by one."""
    for mark, name, codec in (
        (b"\xef\xbb\xbf", "utf-8-sig", "utf-8"),
        (b"\xff\xfe", "utf-16-le", "utf-16-le"),
        (b"\xfe\xff", "utf-16-be", "utf-16-be"),
    ):
        if data.startswith(mark):
            codecs = [(name, codec, data[len(mark):])]
            break
    else:
        codecs = [(c, c, data) for c in ("utf-8", "gb18030", "gbk", "big5", "shift_jis", "euc-kr")]
    for name, codec, rest in codecs:
        try:
            return rest.decode(codec), name
        except UnicodeDecodeError:
            pass
    return None, None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("texts")
    for name, (data, _, _) in SAMPLES.items():
        (path / name).write_bytes(data)
    (path / "empty.txt").write_bytes(b"")
    (path / ".hidden.txt").write_bytes("藏".encode("gb18030"))
    return path


def by_name(df):
    return {os.path.basename(row.path): row for row in df.collect()}


def test_decoding(spark, folder):
    found = by_name(files.decode_files(files.scan_files(spark, str(folder))))
    for name, (data, text, encoding) in SAMPLES.items():
        text, encoding = (text, encoding) if text is not None else expected_of(data)
        assert (found[name].text, found[name].encoding) == (text, encoding), name
        assert (found[name].reason is None) == (text is not None), name
        if name in REASONS:
            assert found[name].reason == REASONS[name]


def test_all_byte_pairs(spark):
    pairs = [bytes((a, b)) for a in range(256) for b in range(0, 256, 5)]
    df = spark.createDataFrame(
        [(str(i), len(data), bytearray(data)) for i, data in enumerate(pairs)],
        "path string, length bigint, content binary",
    )
    for row in files.decode_files(df).collect():
        assert (row.text, row.encoding) == expected_of(pairs[int(row.path)])


def test_split_into_loaded_and_quarantined(spark, folder):
    decoded = files.decode_files(files.scan_files(spark, str(folder)))
    bad = by_name(files.quarantined(decoded))
    good = by_name(files.loaded(decoded))
    assert bad.keys() | good.keys() == SAMPLES.keys()
    assert not bad.keys() & good.keys()
    assert REASONS.keys() <= bad.keys()


def manifest_of(spark, folder, *names):
    return spark.createDataFrame([(f"file:{folder}/{name}",) for name in names], "path string")


def test_files_the_source_skips_need_the_manifest(spark, folder):
    manifest = manifest_of(spark, folder, "empty.txt", "plain.txt", ".hidden.txt")
    found = by_name(files.decode_files(files.scan_files(spark, str(folder), manifest)))
    assert {name: (row.text, row.encoding, row.length) for name, row in found.items()} == {
        "empty.txt": ("", "utf-8", 0),
        "plain.txt": ("plain", "utf-8", 5),
        ".hidden.txt": ("藏", "gb18030", 2),
    }


def test_missing_file_of_the_manifest_raises(spark, folder):
    manifest = manifest_of(spark, folder, "none.txt")
    with pytest.raises(Exception, match="No such file"):
        files.scan_files(spark, str(folder), manifest).collect()


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_files(spark, str(tmp_path / "none"))


def test_profile(spark, folder):
    found = by_name(files.profile_files(files.decode_files(files.scan_files(spark, str(folder)))))
    assert found["bom.txt"].size_kb == 17 / 1024
    assert found["bom.txt"].line_count == 1


def test_length_filter_reaches_the_scan(spark, folder):
    small = files.scan_files(spark, str(folder)).where(F.col("length") < 10).select("path")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(length,10)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("form", ["path", "uri"])
def test_saving(spark, tmp_path, form):
    text = "一é🎉\r\n"
    encodings = ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "gb18030", "big5"]
    prefix = f"{tmp_path}/" if form == "path" else f"file://{tmp_path}/"
    rows = [(f"{prefix}{name}.txt", text, name) for name in encodings]
    (tmp_path / "utf-8.txt").write_bytes(b"old")
    saved = files.save_files(spark.createDataFrame(rows, "path string, text string, encoding string"))
    assert saved == len(encodings)
    codecs = {"gb18030": "utf-8", "big5": "utf-8"}
    for name in encodings:
        assert (tmp_path / f"{name}.txt").read_bytes() == text.encode(codecs.get(name, name))
    assert len(list(tmp_path.iterdir())) == len(encodings)


def test_saving_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "utf-8-sig")], "path string, text string, encoding string")
    for _ in range(2):
        files.save_table(rows, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.path, bytes(r.content), r.encoding) for r in row] == [("a", b"\xef\xbb\xbfx", "utf-8-sig")]


def test_normalize_and_reload(spark, tmp_path):
    (tmp_path / "story.txt").write_bytes("第一章\r\n\r\n　　他走\n了".encode("gb18030"))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff")
    files.save_files(normalize_files(files.scan_files(spark, str(tmp_path))))
    written = (tmp_path / "story_normalized.txt").read_bytes()
    assert written == "第一章\n\n　　他走了".encode()
    assert not (tmp_path / "bad_normalized.txt").exists()
    again = by_name(files.decode_files(files.scan_files(spark, f"{tmp_path}/*_normalized.txt")))
    assert again["story_normalized.txt"].encoding == "utf-8"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_export(spark, tmp_path, limit):
    docs = spark.createDataFrame(
        [
            (1, f"{tmp_path}/a.txt", "Alice and Bob", "utf-8-sig"),
            (2, f"{tmp_path}/b.txt", "Alice", "utf-8"),
            (3, f"{tmp_path}/c.txt", "no names", "utf-8"),
        ],
        "doc_id bigint, path string, text string, encoding string",
    )
    rows = spark.createDataFrame(
        [(1, "Alice", " Eve ", 1, 1), (1, "Bob", "", 1, 2), (2, "Alice", "Alice", 1, 1)],
        "doc_id bigint, original string, replacement string, occurrence_count int, rank int",
    )
    assert files.save_files(export_documents(docs, rows, limit)) == 1
    assert (tmp_path / "a_processed.txt").read_bytes() == b"\xef\xbb\xbfEve and Bob"


def test_odd_names_come_back(spark, folder, tmp_path):
    decoded = files.loaded(files.decode_files(files.scan_files(spark, str(folder))))
    moved = F.replace("path", F.lit(str(folder)), F.lit(str(tmp_path)))
    assert files.save_files(decoded.withColumn("path", moved)) == decoded.count()
    again = by_name(files.scan_files(spark, str(tmp_path)))
    assert bytes(again["a b%20 #中.txt"].content) == b"odd name"


def test_streaming_scan(spark, folder, tmp_path):
    decoded = stream_files(spark, str(folder))
    query = (
        decoded.select("path", "text", "encoding").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .option("path", str(tmp_path / "out"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = by_name(spark.read.parquet(str(tmp_path / "out")))
    assert found["gb.txt"].text == "中文内容测试"
    assert found.keys() == SAMPLES.keys()


@pytest.mark.parametrize(("path", "parts"), [
    ("/a/b.txt", ("file", "", "/a/b.txt")),
    ("file:/a/b.txt", ("file", "", "/a/b.txt")),
    ("file:///a/b.txt", ("file", "", "/a/b.txt")),
    ("hdfs:///novels/a.txt", ("hdfs", "", "/novels/a.txt")),
    ("hdfs://host:9000/novels/a.txt", ("hdfs", "host:9000", "/novels/a.txt")),
    ("s3a://bucket/x/a b.txt", ("s3a", "bucket", "/x/a b.txt")),
])
def test_paths_are_taken_apart(path, parts):
    assert paths.split_path(path) == parts


def left_in(folder):
    """What stays once the tasks that were still running have given up."""
    for _ in range(50):
        if not folder.exists() or not list(folder.iterdir()):
            return []
        time.sleep(0.1)
    return list(folder.iterdir())


def test_a_path_that_cannot_be_reached_lets_nothing_appear(spark, tmp_path):
    rows = [(f"{tmp_path}/out/{i}.txt", "t", "utf-8") for i in range(40)] + [("dbfs:/x/a.txt", "t", "utf-8")]
    texts = spark.createDataFrame(rows, "path string, text string, encoding string").repartition(8)
    with pytest.raises(Exception, match="no file system known for dbfs"):
        files.save_files(texts)
    assert left_in(tmp_path / "out") == []
    assert paths.SCHEMES["s3a"] == paths.SCHEMES["s3n"] == "s3"


def test_saving_runs_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [(f"{tmp_path}/out/{i}.txt", f"text {i}", "utf-8") for i in range(50)]
    texts = spark.createDataFrame(rows, "path string, text string, encoding string")
    assert files.save_files(texts.withColumn("text", counted.asNondeterministic()("text"))) == 50
    assert seen.value == 50
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{i}.txt" for i in range(50))


def test_nothing_to_save(spark):
    assert files.save_files(spark.createDataFrame([], "path string, text string, encoding string")) == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = [(f"{tmp_path}/out/{i}.txt", "t" * 10, "utf-8") for i in range(40)]
    texts = spark.createDataFrame(rows, "path string, text string, encoding string").repartition(4, "path")
    bad = texts.withColumn("text", F.when(F.col("path").endswith("/7.txt"), F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        files.save_files(bad)
    assert left_in(tmp_path / "out") == []


def names_read(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_reading_with_empty_and_hidden_files(spark, folder, tmp_path):
    every = {*SAMPLES, "empty.txt"}
    found = files.read_files(spark, str(folder))
    assert set(names_read(found)) == every
    spark_s = {r.path: (r.length, bytes(r.content)) for r in files.scan_files(spark, str(folder)).collect()}
    own = {r.path: (r.length, bytes(r.content)) for r in found.collect()}
    assert spark_s.items() <= own.items() and own.keys() - spark_s.keys() == {f"file:{folder}/empty.txt"}
    assert set(names_read(files.read_files(spark, f"file://{folder}", hidden=True))) == {*every, ".hidden.txt"}
    sizes = files.read_files(spark, str(folder), content=False).collect()
    assert {(r.path, r.length) for r in sizes} == {(p, n) for p, (n, _) in own.items()} and not any(r.content for r in sizes)


def test_reading_patterns_folders_and_lists(spark, tmp_path):
    for name in ("a/1.txt", "a/2.dat", "a/b/3.txt", "c/4.txt", "_x/5.txt", "c/z.txt.gz"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    read = lambda *p, **o: names_read(files.read_files(spark, [f"{tmp_path}/{x}" for x in p], **o))
    assert read("a") == ["1.txt", "2.dat"] and read("a", recursive=True) == ["1.txt", "2.dat", "3.txt"]
    assert read("*/*.txt") == ["1.txt", "4.txt"] and read("a/1.txt", "c") == ["1.txt", "4.txt", "z.txt.gz"]
    assert read("", recursive=True) == ["1.txt", "2.dat", "3.txt", "4.txt", "z.txt.gz"]
    assert read("a", "a/1.txt") == ["1.txt", "2.dat"] and read("a/n*") == []
    packed = files.read_files(spark, f"{tmp_path}/c/z.txt.gz").first()
    assert bytes(packed.content) == b"c/z.txt.gz"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_files(spark, f"{tmp_path}/none").collect()


def test_shares_and_batches_are_bounded(tmp_path, monkeypatch):
    import json

    for i in range(10):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (1 if i else 50))
    monkeypatch.setattr(datasource, "TASK_BYTES", 4)
    reader = datasource.FileReader({"paths": json.dumps([f"file:{tmp_path}"])})
    shares = reader.partitions()
    assert [len(s.paths) for s in shares] == [1, 4, 4, 1]
    monkeypatch.setattr(datasource, "BATCH_BYTES", 3)
    batches = list(datasource.read_batches(p for s in shares for p in s.paths))
    assert [b.num_rows for b in batches] == [1, 3, 3, 3] and sum(b.num_rows for b in batches) == 10
    assert list(datasource.read_batches(iter(()))) == []


def test_manifest_is_read_once_and_in_many_tasks(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(path):
        seen.add(1)
        return path

    manifest = manifest_of(spark, folder, "empty.txt", "plain.txt", "plain.txt").union(spark.createDataFrame([(None,)], "path string"))
    manifest = manifest.withColumn("path", counted.asNondeterministic()("path"))
    found = files.scan_files(spark, str(folder), manifest)
    assert names_read(found) == ["empty.txt", "plain.txt"] and seen.value == 4


@pytest.mark.parametrize("segments", [False, True])
def test_files_of_a_batch_share_a_list_and_appear_when_it_is_finished(tmp_path, segments):
    names = [f"file:{tmp_path}/out/{i}.txt" for i in (0, 0, 1, 2, 2)] if segments else [f"file:{tmp_path}/out/{i}.txt" for i in (0, 1, 2)]
    batch = pa.RecordBatch.from_pydict({"path": names, "content": [b"x"] * len(names)})
    more = pa.RecordBatch.from_pydict({"path": names[-1:] if segments else [f"file:{tmp_path}/out/3.txt"], "content": [b"y"]})
    writer = datasource.FileWriter(f"file:{tmp_path}/staging", segments)
    staged = writer.write(iter([batch, more]))
    assert (staged.files, len(staged.lists)) == ((3, 1) if segments else (4, 2))
    writer.commit([staged])
    # The driver moves none; a list that is gone through a second time, after a lost task, changes nothing.
    assert all(p.name.startswith("_") for p in (tmp_path / "out").iterdir())
    for listed in [*staged.lists, *staged.lists]:
        datasource.finish(listed)
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    wanted = {"0.txt": b"xx", "1.txt": b"x", "2.txt": b"xxy"} if segments else {f"{i}.txt": b"xxxy"[i : i + 1] for i in range(4)}
    assert found == wanted


def test_the_driver_holds_a_bounded_number_of_names(tmp_path, monkeypatch):
    import json
    import tracemalloc

    names = {f"{i:03}{'n' * 100}.txt" for i in range(900)}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in names:
        (tmp_path / "in" / ("deep" if name < "3" else ".") / name).write_bytes(b"x")
    (tmp_path / "in" / "deep" / ".hidden").write_bytes(b"x")
    (tmp_path / "in" / "gone.txt").symlink_to(tmp_path / "none")
    folder = f"file:{tmp_path}/in"
    wanted = {"paths": json.dumps([folder, f"{folder}/deep", f"{folder}/{max(names)}"]), "recursive": "true"}
    every = datasource.FileReader(wanted).partitions()
    assert [len(s.paths) for s in every] == [900] and every[0].paths == sorted(every[0].paths)
    for name, value in (("RUN_FILES", 50), ("RUNS", 4), ("HELD_FILES", 20), ("TASK_FILES", 20)):
        monkeypatch.setattr(datasource, name, value)
    reader = datasource.FileReader(wanted | {"listing": f"file:{tmp_path}/listing"})
    tracemalloc.start()
    shares = reader.partitions()
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shares) == 45 and sum(len(s.paths) for s in shares) == 20 and used < 300_000
    found = [r["path"] for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert found == every[0].paths and {p.rpartition("/")[2] for p in found} == names
    segments = datasource.SegmentReader(wanted | {"listing": f"file:{tmp_path}/listing", "size": "10"})
    parts = segments.partitions()
    assert sum(len(p.parts) for p in parts) == 20 and sum(b.num_rows for p in parts for b in segments.read(p)) == 900


def test_more_files_than_the_driver_tells_tasks_itself(spark, tmp_path, monkeypatch):
    # The planner of Spark runs in a process of its own: what it lists in files is read by the tasks.
    (tmp_path / "in").mkdir()
    for i in range(datasource.HELD_FILES + 50):
        (tmp_path / "in" / f"{i}.txt").touch()
    found = files.read_files(spark, str(tmp_path / "in"))
    assert found.count() == found.select("path").distinct().count() == datasource.HELD_FILES + 50
