import random

import pytest
from pyspark.sql import functions as F

from castlist.functions import layout
from castlist.functions.text import unix_newlines
from castlist.plans.normalize import normalize_documents

GOLDENS = [
    (
        "第一章 开始\n\n　　他走了\n过来。\n　　她也来了。\n\n完",
        "第一章 开始\n\n　　他走了过来。\n　　她也来了。\n\n完",
    ),
    ("Hello wor\nld again.\n\nNext para", "Hello wor ld again.Next para"),
    ("a1\r\nb2\r\n\r\n问？」\r\n\r\n下", "a1 b2问？」\n\n下"),
    ("", ""),
    ("   \n\n", ""),
    ("\n\n a \n", "a"),
    # a title that only the joined lines spell out
    ("第一\n章 开始\n\n正文", "第一章 开始\n\n正文"),
    # ASCII digits get a space between them, which spoils the title
    ("第1\n2章\n\n正文", "第1 2章正文"),
    # closing marks on a line of their own still end the sentence
    ("“走！\n”\n\n他说", "“走！”\n\n他说"),
    ("“走\n”\n\n他说", "“走”他说"),
    # a break is kept before a title, with or without a blank line
    ("正文\n\n第二回 续", "正文\n\n第二回 续"),
    ("正文\n  第二回 续", "正文\n第二回 续"),
    ("正文\n第二回 续", "正文第二回 续"),
    # the indent of a line that is joined is dropped
    ("他走\n　　了过来", "他走了过来"),
    ("第三卷\xa0\n\n\xa0\n\n完", "第三卷\xa0\n\n\xa0完"),
]


def test_goldens(docs_of):
    rows = normalize_documents(docs_of(*(before for before, _ in GOLDENS))).collect()
    found = {row.doc_id: row.text for row in rows}
    for i, (_, after) in enumerate(GOLDENS):
        assert found[i] == after, i


@pytest.mark.parametrize(
    "line, title",
    [
        ("第一章", True),
        ("  第十二回 火烧", True),
        ("　第3卷", True),
        ("第章", False),
        ("第一 章", False),
        ("前第一章", False),
        ("第一章\n下", False),
        ("第零两百千篇\n", True),
        ("", False),
    ],
)
def test_titles(evaluate, line, title):
    assert evaluate(layout.is_chapter_title, line) is title


@pytest.mark.parametrize(
    "previous, following, kept",
    [
        ("他走了。", "她", True),
        ("他走了。”）", "她", True),
        ("他走了。” ", "她", False),
        ("The end.", "Next", False),
        ("Really?", "Next", True),
        ("他说…\n", "她", True),
        ("他说。 ", "她", False),
        ("第一章", "她", True),
        ("他", "第二节 x", True),
        ("他", "她", False),
    ],
)
def test_breaks(evaluate, previous, following, kept):
    assert evaluate(layout.starts_new_paragraph, previous, following) is kept


@pytest.mark.parametrize(
    "previous, following, joined",
    [
        ("Hello", "World", "Hello World"),
        ("Hello,", "World", "Hello,World"),
        ("他1", "2她", "他1 2她"),
        ("他", "A", "他A"),
        ("é", "a", "éa"),
        ("", "a", "a"),
    ],
)
def test_joins(evaluate, previous, following, joined):
    assert evaluate(layout.join_wrapped, previous, following) == joined


@pytest.mark.parametrize(
    "line, indent, indented",
    [
        ("　　他", "　　", True),
        ("　 他", "　", True),
        (" 　他", "", True),
        (" 他", "", False),
        ("\t\t ", "", False),
        ("他", "", False),
        ("  ", "", False),
    ],
)
def test_indents(evaluate, line, indent, indented):
    assert evaluate(layout.fullwidth_indent, line) == indent
    assert evaluate(layout.is_indented, line) is indented


def native_fold(text):
    """The repair as a Catalyst fold, built from the line predicates."""
    lines = F.split(unix_newlines(text), "\n", -1)
    empty = F.struct(F.lit("").alias("cur"), F.lit("").alias("done"), F.lit(False).alias("blank"))

    def state(cur, done, blank):
        return F.struct(cur.alias("cur"), done.alias("done"), F.lit(blank).alias("blank"))

    def step(acc, raw):
        line = F.btrim(raw, F.lit(layout.INDENT))
        fresh = F.concat(layout.fullwidth_indent(raw), line)
        broken = (acc["blank"] | layout.is_indented(raw)) & layout.starts_new_paragraph(
            acc["cur"], line
        )
        gap = F.when(acc["blank"], "\n\n").otherwise("\n")
        return (
            F.when(line == "", state(acc["cur"], acc["done"], True))
            .when(acc["cur"] == "", state(fresh, acc["done"], False))
            .when(broken, state(fresh, F.concat(acc["done"], acc["cur"], gap), False))
            .otherwise(state(layout.join_wrapped(acc["cur"], line), acc["done"], False))
        )

    return F.aggregate(lines, empty, step, lambda a: F.concat(a["done"], a["cur"]))


def test_equals_native_fold(docs_of):
    rng = random.Random(7)
    parts = ["第", "一", "章", "他", "abc", "1", "。", "”", "！", "」", ".", "\n", "\n", "\n\n",
             "　", "　　", "  ", "\t", " ", "\r", "\r\n", "?", "…", "\""]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)]
    docs = docs_of(*texts)
    both = docs.select(
        "text", layout.repair_layout(F.col("text")).alias("a"), native_fold(F.col("text")).alias("b")
    )
    for text, a, b in both.collect():
        assert a == b, text
