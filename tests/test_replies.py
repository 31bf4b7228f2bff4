import json
import random
import re

import pytest
from pyspark.sql import functions as F

from castlist.functions import replies

FENCE = "```"
REPLIES = [
    ('{"names": ["张三", "李四", "王五"]}', ["张三", "李四", "王五"]),
    ('Here: {"names": ["Alice", "Bob"]} done', ["Alice", "Bob"]),
    (f'{FENCE}json\n{{"names": ["张三", "李四"]}}\n{FENCE}', ["张三", "李四"]),
    ('{"names": []}', []),
    ('{"names": [null, ""]}', []),
    ("", []),
    (" \n　", []),
    ("1. 张三\n2. 李四\n3. 王五", ["张三", "李四", "王五"]),
    ("张三\n\n  李四  \n", ["张三", "李四"]),
    ("１２. 张三", ["张三"]),
    ("3.- Bob", ["Bob"]),
    ("- Bob", None),
    ("# Names\nBob", ["Bob"]),
    ("x" * 50, ["x" * 50]),
    ("x" * 51, None),
    ("1. " + "x" * 47, ["x" * 47]),
    ("🎉" * 50, ["🎉" * 50]),
    ('{"names": ["Alice", 123, "Bob", true]}', ["Alice", "123", "Bob", "True"]),
    ('{"names": ["A", 123, true, null, "", 0, false]}', ["A", "123", "True"]),
    ('{"names": [1.0, 1.50, 0.0, 1e20, -3]}', ["1.0", "1.5", "1e+20", "-3"]),
    ('{"names": [{"a": 1}, [], ["b"], {}]}', ["{'a': 1}", "['b']"]),
    ('{"characters": ["Alice"]}', None),
    ('{"names": "Alice"}', None),
    ('[{"names": ["Alice"]}]', ["Alice"]),
    ('{"names": ["A"], "names": ["B", "C"]}', ["B", "C"]),
    ('{"\\u006eames": ["A"]}', ["A"]),
    ('{"names": ["A\\"B", "C\\nD", "\\u5f20"]}', ['A"B', "C\nD", "张"]),
    ('{"names": ["A"], "more": {"x": 1}}', ["A"]),
    ('{"more": {"names": ["X"]}, "names": ["B"]}', ["B"]),
    # the whole is no JSON, so the first flat object counts
    ('{"more": {"names": ["X"]}, "names": ["B"]} end', ["X"]),
    ('{"names": ["A"]} and {"names": ["B"]}', ["A"]),
    # only the first names array is looked at
    ('{"names": ["A", }, "names": ["B"]', None),
    ('The "names" : ["A", "B"] here', ["A", "B"]),
    ('{"names": ["A]", "B"]}', ["A]", "B"]),
    ('text {"names": ["A{", "B"]} text', ["A{", "B"]),
    ('"names": [\nAlice\nBob', ['"names": [', "Alice", "Bob"]),
    ("null", ["null"]),
    ("42", ["42"]),
    ('{"names": [" A ", "A"]}', [" A ", "A"]),
    ('{"names": ["\\ud800x"]}', ["?x"]),
    ('{"names": [NaN, "A"]}', ["nan", "A"]),
    ('{"names": ["A"], "n": NaN}', ["A"]),
    ("[" * 100_000, None),
    ('{"names": ' + "[" * 100_000, None),
]


def test_reply_names(spark):
    df = spark.createDataFrame(
        [(i, reply) for i, (reply, _) in enumerate(REPLIES)], "i int, response string"
    )
    found = {row.i: row.names for row in replies.with_reply_names(df).collect()}
    for i, (reply, names) in enumerate(REPLIES):
        assert found[i] == names, reply[:100]


def test_missing_reply_has_no_names(spark):
    df = spark.createDataFrame([(None,)], "response string")
    assert replies.with_reply_names(df).first().names is None


def test_error_text(evaluate):
    reply = " {" + "很" * 300
    assert evaluate(replies.unreadable_reply, reply) == (
        "Could not extract names from response: {" + "很" * 199
    )


@pytest.mark.parametrize(
    "error_class, error, limited",
    [
        ("RateLimitError", "x", True),
        ("ratelimited", "", True),
        ("APIStatusError", "Error code: 429 - {}", True),
        ("ValueError", "You hit the Rate Limit", True),
        ("ValueError", "code 429", False),
        ("TimeoutError", "slow", False),
        (None, None, False),
        (None, "rate limit", True),
    ],
)
def test_rate_limits(evaluate, error_class, error, limited):
    assert evaluate(lambda c, e: replies.is_rate_limit(c, e), error_class, error) is limited


def test_no_filter_runs_python_twice(spark):
    df = spark.createDataFrame([("{}",)], "response string")
    read = replies.with_reply_names(df).where(F.col("names").isNotNull())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def names_by_trial(reply):
    """Slow model: let Python's parser and regexes judge every candidate."""
    reply = reply.strip()
    if not reply:
        return []
    flat = re.search(r'\{[^{}]*"names"\s*:\s*\[[^\]]*\][^{}]*\}', reply)
    bare = re.search(r'"names"\s*:\s*(\[[^\]]*\])', reply)
    candidates = [reply, flat and flat[0], bare and '{"names": %s}' % bare[1]]
    for candidate in filter(None, candidates):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("names"), list):
            return [str(name) for name in value["names"] if name]
    found = []
    for line in map(str.strip, reply.split("\n")):
        if line and len(line) <= 50 and not re.match(r"[{\[#*-]|```", line):
            line = re.sub(r"^[-*]\s*", "", re.sub(r"^\d+\.\s*", "", line)).strip()
            found += [line] if line else []
    return found or None


def test_random_replies(spark):
    rng = random.Random(5)
    parts = ['{', '}', '[', ']', '"names"', ':', ',', '"A"', '"B C"', '"names": ["A", "B"]', '1',
             'null', 'true', ' ', '\n', '\u3000', '"x": {"y": 1}', '{"names": ["D"]}', 'text', '\\',
             '- ', '1. ', '"\\n"', '0.5', '""', '{"names": [', ']}', '```', '\x1c', '"names":']
    samples = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, response string")
    for row in replies.with_reply_names(df).collect():
        assert row.names == names_by_trial(samples[row.i]), samples[row.i]
