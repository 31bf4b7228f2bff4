import pathlib
import re

import pytest
from pyspark.sql import functions as F

from castlist.functions import text as texts


def test_whitespace_is_what_python_strips():
    spaces = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(texts.WHITESPACE) == spaces
    assert {c for c in map(chr, range(0x3100)) if re.match(texts.WS, c)} == spaces


def test_strip(spark):
    samples = [c + "a b" + c for c in texts.WHITESPACE] + ["", " 　", "​x "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for before, after in df.select("s", texts.strip(F.col("s"))).collect():
        assert after == before.strip()


def test_whitespace_class_in_spark(spark):
    df = spark.createDataFrame([(c,) for c in texts.WHITESPACE], "s string")
    assert df.where(F.col("s").rlike(f"^{texts.WS}$")).count() == len(texts.WHITESPACE)
    assert df.where(F.col("s").rlike(f"^{texts.NOT_WS}$")).count() == 0


@pytest.mark.parametrize(
    "before, after",
    [("a\r\nb\rc\nd", "a\nb\nc\nd"), ("\r\r\n\n", "\n\n\n"), ("", ""), ("\r", "\n")],
)
def test_unix_newlines(evaluate, before, after):
    assert evaluate(texts.unix_newlines, before) == after


def test_byte_length(evaluate):
    assert evaluate(texts.byte_length, "Hello你好") == 11


@pytest.mark.parametrize("text, lines", [("", 1), ("a", 1), ("a\n", 2), ("\n\n", 3)])
def test_line_count(evaluate, text, lines):
    assert evaluate(texts.line_count, text) == lines


@pytest.mark.parametrize(
    "text, needle", [("aaaa", "aa"), ("", "x"), ("张三丰张三", "张三"), ("abab", "ba"), ("x", "xx")]
)
def test_count_substring(evaluate, text, needle):
    assert evaluate(texts.count_substring, text, needle) == text.count(needle)


@pytest.mark.parametrize("n_bytes", [0, 1, 51, 256, 768, 1024, 1280, 2_000_000, 52_428_800])
def test_profile_label(spark, n_bytes):
    kb = texts.size_kb(F.lit(n_bytes))
    label = texts.profile_label(F.lit("f.txt"), kb, F.lit(3), F.lit("gbk"))
    expected = f"f.txt | {n_bytes / 1024:.1f} KB | 3 lines | gbk"
    assert spark.range(1).select(label).first()[0] == expected


PATHS = [
    "/path/to/story.chapter1.txt",
    "/path/to/.hidden.txt",
    "/path/to/story",
    "/path/to/.hidden",
    "story.",
    "a.b.c",
    "/x.y/name",
    "..txt",
    "/d/文.本",
]


@pytest.mark.parametrize("path", PATHS)
def test_output_paths(evaluate, path):
    p = pathlib.PurePosixPath(path)
    stem, suffix = p.stem, p.suffix
    assert evaluate(texts.processed_path, path) == str(p.parent / f"{stem}_processed{suffix}")
    assert evaluate(texts.normalized_path, path) == str(p.parent / f"{stem}_normalized{suffix}")
