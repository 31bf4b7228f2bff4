"""Secrets in texts, in DataFrame operations only: known shapes, and strings that pass tests of randomness.

Known shapes (``BASE``) are found by their patterns, from left to right without overlap, and those too short are
dropped. Positions come from splitting the text at the matches: the pieces between and the matches alternate.

Further candidates are maximal runs of ``LEAST`` or more characters that keys are written in, of at least two kinds (capitals,
small letters, digits, others); strings of one kind are words or numbers. The characters tell the encoding: ``hex``, ``base32``,
``base62``, ``base64`` or ``base64url``; padding is cut off. Under the hypothesis that the symbols were
drawn independently and uniformly from the encoding's alphabet, a battery of tests gives a p-value:

- chi-squared over the symbols, its variance that of the string's length (two-sided: ``abcdef0123`` is too even);
- chi-squared over the kinds of symbols, which has power for short strings (one-sided);
- Wald-Wolfowitz runs of the alphabet's lower and upper half (two-sided);
- serial correlation of neighbouring symbols (two-sided).

The least of the four, p, counts as 1 - (1 - p)^4. What is not random gets small values, the smaller the longer it
is. For each encoding and class of lengths (powers of the square root of two) the procedure of
Benjamini and Hochberg sets candidates aside as not random, at a false-discovery rate of ``RATE``: where ordinary strings
abound it sets aside more, where most are random less. The p-values are rounded up to powers of e^(1/4) for
that, so it needs counts only, and is exact for the rounded ones. The rest are spans of the kind ``random``; a candidate
inside a known span adds nothing.

Everything about a text happens inside its row; only counts of rounded p-values by class are exchanged, and the cuts
come back as a map of at most 5 encodings by 62 classes. The positions found are stored once, the texts are not.
Positions are sums of sizes over blocks of blocks, so many matches in one text do not cost the square of their number.

Defined results: a null text is an empty one and has no spans; every row is judged by itself, also where ids repeat,
while the cuts are learned from all rows, each counting; no rows give none. Very long texts are scanned whole. Further
columns but ``text`` are kept; one with the name of a result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castlist.llm.common import LOWER, UPPER, let
from castlist.session import cut_lineage

# The kinds of known spans in their order, each with its pattern, the group that is measured and its least length.
# Runs of hex digits, and of what follows AKIA, are maximal, so the least length may stand in the pattern.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = [*(kind for kind, *_ in BASE), "random"]
RANDOM = len(BASE)
COUNTS = [f"n_{kind}" for kind, *_ in BASE]

LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
DIGITS = "0123456789"
# Encodings, the first that fits holds: what a whole string looks like, and the alphabet in its order.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)

RATE = 0.1
STEPS = 4
LAST_STEP = 400
BLOCK = 64


# ---- Positions --------------------------------------------------------------------------


def before(values: Column, start: int, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each of an array of integers, all those before it taken together by ``op``."""
    zero = F.lit(start)

    def within(block: Column, first: Column) -> Column:
        done = F.struct(first.alias("all"), F.array().cast("array<int>").alias("out"))
        step = lambda d, x: F.struct(op(d["all"], x).alias("all"), F.concat(d["out"], F.array(d["all"])).alias("out"))
        return F.aggregate(block, done, step, lambda d: d["out"])

    if not levels:
        return within(values, zero)
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))

    def joined(held: Column) -> Column:
        whole = F.transform(held, lambda block: F.aggregate(block, zero, op))
        return F.flatten(F.zip_with(held, before(whole, start, op, levels - 1), within))

    return let(blocks, joined)


def matches(text: Column, pattern: str) -> Column:
    """An array of (start, end, m) in code points: the matches, none empty, from left to right without overlap."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.char_length)
        sized = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))

        def summed(pairs: Column) -> Column:
            sizes = F.transform(pairs, lambda s: s["gap"] + F.char_length(s["m"]))
            ends = before(sizes, 0, lambda a, b: a + b)
            return F.zip_with(pairs, ends, lambda s, at: F.struct(
                (at + s["gap"]).alias("start"), (at + s["gap"] + F.char_length(s["m"])).alias("end"), s["m"].alias("m")
            ))

        # Most texts have no match and need no second search.
        return F.when(F.size(found) > 0, let(sized, summed)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


# ---- Tests of randomness ----------------------------------------------------------------


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by the rational approximation of the error function for z >= 0."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * series * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.abs(z))


def chi_normal(square: Column, freedom: Column) -> Column:
    """A chi-squared variable as a standard normal one, by its cube root."""
    spread = 2 / (9 * freedom)
    return (F.cbrt(F.greatest(square, F.lit(0.0)) / freedom) - (1 - spread)) / F.sqrt(spread)


def of_kind(text: Column) -> Column:
    """How many digits, small letters, capitals and others a text has."""
    size = F.char_length(text)
    parts = [size - F.char_length(F.translate(text, letters, "")) for letters in (DIGITS, LOWER, UPPER)]
    return F.array(*parts, size - parts[0] - parts[1] - parts[2])


def p_symbols(key: Column, alphabet: Column) -> Column:
    n, kinds = F.char_length(key), F.char_length(alphabet)
    uses = F.transform(F.split(alphabet, ""), lambda c: n - F.char_length(F.replace(key, c, F.lit(""))))
    squares = F.aggregate(uses, F.lit(0).cast("long"), lambda total, c: total + c.cast("long") * c)
    freedom = kinds - 1
    apart = (squares * kinds / n - n - freedom) * F.sqrt(n / (n - 1))
    return two_sided(chi_normal(freedom + apart, freedom.cast("double")))


def p_kinds(key: Column, alphabet: Column) -> Column:
    n, kinds = F.char_length(key), F.char_length(alphabet)
    cells = F.filter(
        F.zip_with(of_kind(key), of_kind(alphabet), lambda c, a: F.struct(c.alias("c"), (a * n / kinds).alias("e"))),
        lambda cell: cell["e"] > 0,
    )

    def tested(held: Column) -> Column:
        square = F.aggregate(held, F.lit(0.0), lambda s, cell: s + (cell["c"] - cell["e"]) * (cell["c"] - cell["e"]) / cell["e"])
        return upper_tail(chi_normal(square, (F.size(held) - 1).cast("double")))

    return let(cells, tested)


def places(key: Column, alphabet: Column) -> Column:
    """Where in the alphabet each symbol stands."""
    return F.transform(F.split(key, ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))


def neighbours(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``op`` over each value and the next."""
    size = F.size(values)
    pairs = F.zip_with(F.slice(values, F.lit(1), size - 1), F.slice(values, F.lit(2), size - 1), op)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


FAR = 40.0


def p_runs(at: Column, alphabet: Column) -> Column:
    n = F.size(at).cast("double")

    def tested(high: Column) -> Column:
        ones = F.aggregate(high, F.lit(0.0), lambda total, x: total + x)
        mixed = 2 * ones * (n - ones)
        changes = neighbours(high, lambda a, b: F.abs(a - b))
        variance = mixed * (mixed - n) / (n * n * (n - 1))
        z = (changes - mixed / n) / F.sqrt(F.when(variance > 0, variance))
        return two_sided(F.coalesce(z, F.lit(FAR)))

    return let(F.transform(at, lambda x: (x > F.char_length(alphabet) / 2).cast("double")), tested)


def p_serial(at: Column) -> Column:
    n = F.size(at).cast("double")
    mean = F.aggregate(at, F.lit(0.0), lambda total, x: total + x) / n

    def tested(off: Column) -> Column:
        square = F.aggregate(off, F.lit(0.0), lambda total, x: total + x * x)
        r = neighbours(off, lambda a, b: a * b) / F.when(square > 0, square)
        return two_sided(F.coalesce((r + 1 / n) * F.sqrt(n), F.lit(FAR)))

    return let(mean, lambda middle: let(F.transform(at, lambda x: x - middle), tested))


def p_value(key: Column, alphabet: Column) -> Column:
    """How likely a random string over the alphabet looks at least as odd to the battery."""
    placed = let(places(key, alphabet), lambda at: F.least(p_runs(at, alphabet), p_serial(at)))
    least = F.least(p_symbols(key, alphabet), p_kinds(key, alphabet), placed)
    return 1 - F.pow(1 - F.least(least, F.lit(1.0)), 4)


def step_of(p: Column) -> Column:
    """p rounded up to e^(-step / STEPS), as the step."""
    return F.least(F.floor(-STEPS * F.ln(F.greatest(p, F.lit(1e-60)))), F.lit(LAST_STEP)).cast("int")


# ---- Spans ------------------------------------------------------------------------------

_FOUND = "struct<start:int,kind:int,end:int,class:string,step:int>"


def base_spans(text: Column) -> list[Column]:
    """For each kind the array of its spans."""

    def of(number: int, pattern: str, group: int, least: int) -> Column:
        whole = F.filter(matches(text, pattern), lambda s: F.char_length(F.regexp_extract(s["m"], pattern, group)) >= least)
        none = (F.lit(None).cast("string").alias("class"), F.lit(None).cast("int").alias("step"))
        return F.transform(
            whole, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), *none)
        )

    return [of(number, *rest) for number, (_, *rest) in enumerate(BASE)]


def candidates(text: Column) -> Column:
    """The array of candidate spans, each with its class and the step of its p-value."""
    fits = F.when(F.lit(False), F.lit(None).cast("struct<name:string,abc:string>"))

    def encoding(key: Column) -> Column:
        found = fits
        for name, pattern, alphabet in ENCODINGS:
            found = found.when(key.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("abc")))
        return found

    def with_key(s: Column) -> Column:
        key = F.rtrim(s["m"], F.lit("="))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), key.alias("key"), encoding(key).alias("enc"))

    mixed = lambda s: F.size(F.filter(of_kind(s["key"]), lambda n: n > 0)) > 1
    keyed = F.filter(F.transform(matches(text, CANDIDATE), with_key), lambda s: s["enc"].isNotNull() & mixed(s))

    def judged(s: Column) -> Column:
        key = F.when(s["enc"]["name"] == "hex", F.lower(s["key"])).otherwise(s["key"])
        length = F.floor(2 * F.log2(F.char_length(s["key"]))).cast("string")
        return F.struct(
            s["start"].alias("start"), F.lit(RANDOM).alias("kind"), s["end"].alias("end"),
            F.concat(s["enc"]["name"], F.lit(" "), length).alias("class"),
            step_of(p_value(key, s["enc"]["abc"])).alias("step"),
        )

    return F.transform(keyed, judged)


def outside(found: Column) -> Column:
    """Of spans by start and kind, those that are known or do not lie inside a known one."""
    known = F.transform(found, lambda s: F.when(s["kind"] < RANDOM, s["end"]).otherwise(0))
    reach = before(known, 0, lambda a, b: F.greatest(a, b))
    pairs = F.zip_with(found, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r")))
    free = F.filter(pairs, lambda x: (x["s"]["kind"] < RANDOM) | (x["s"]["end"] > x["r"]))
    return F.transform(free, lambda x: x["s"])


def least_random(steps: DataFrame) -> dict[str, int]:
    """For each class the first step of the p-values that are set aside as not random, where there is one.

    Of ``steps`` (class, step), by Benjamini and Hochberg: the largest rounded p whose expected share among
    all p-values up to it is at most RATE.
    """
    counts = steps.groupBy("class", "step").agg(F.count("*").alias("n"))
    rows = Window.partitionBy("class")
    small = F.sum("n").over(rows.orderBy(F.desc("step")))
    rate = F.exp(-F.col("step") / STEPS) * F.sum("n").over(rows) / small
    cuts = counts.withColumn("rate", rate).where(F.col("rate") <= RATE).groupBy("class").agg(F.min("step").alias("step"))
    return {row["class"]: row.step for row in cuts.collect()}


def scan(docs: DataFrame) -> DataFrame:
    """The documents without ``text``, with n_assign, n_access, n_hex and ``spans``, an array of (kind, start, end)."""
    kept = [c for c in docs.columns if c not in ("text", "spans", *COUNTS)]
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.array_sort(F.concat(*base_spans(text), candidates(text)).cast(f"array<{_FOUND}>"))
    # The other columns travel in one, so that no name can clash.
    stored = cut_lineage(docs.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), let(every, outside).alias("found")))
    random = stored.select(F.inline("found")).where(F.col("kind") == RANDOM)
    cuts = least_random(random.select("class", "step"))
    # A class that sets nothing aside has no entry; the first one keeps the map from being empty.
    first = F.create_map(*(F.lit(x) for pair in [("", 0), *sorted(cuts.items())] for x in pair))
    cut = lambda s: F.coalesce(F.try_element_at(first, s["class"]), F.lit(LAST_STEP + 1))
    left = F.filter("found", lambda s: (s["kind"] < RANDOM) | (s["step"] < cut(s)))
    names = F.array(*map(F.lit, KINDS))
    result = stored.select("row", left.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    spans = F.transform("found", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return result.select(
        *(F.col("row")[c].alias(c) for c in kept), *(count(k).alias(c) for k, c in enumerate(COUNTS)), spans.alias("spans")
    )


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def known(spans: Column) -> Column:
    """Those of the known kinds."""
    return F.filter(spans, lambda s: s["kind"] != KINDS[RANDOM])
