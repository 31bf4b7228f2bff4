"""Quality rules: base limits, then robust multivariate outliers, in DataFrame operations only.

Base statistics of a text: words (``[^\\x20\\x09-\\x0D]+``), their code points, symbols, lines that repeat an
earlier one, and words in five-word windows that occur more than once. A document fails the base
rules with fewer than 10 words or with over a fifth of its words in repeated windows.

The others are judged by a vector of five transformed statistics: log of the number of words, log of the mean
word length, and the square roots of the shares of symbols, repeated lines and repeated words.
For every language and source the location and scatter are estimated by the
minimum covariance determinant, the scatter of the ``SHARE`` of the rows that lie nearest by Mahalanobis distance. Steps that
take a new mean and covariance from the rows nearest by the old ones lower the determinant, so they are taken
from several starts (``STARTS``): medians with median deviations, all rows, and the lower and the upper half by
the statistic whose standard deviation exceeds its median deviation most, which tells two clusters apart. After ``FIRST_STEPS``
the start of least determinant goes on alone until no group's determinant falls any more (at most ``MOST_STEPS``). The scatter is
widened by ``CONSISTENT``, what a normal distribution loses by the selection, and rows whose squared distance
exceeds ``CUTOFF`` are rejected.

``FLOOR`` is added to the standard deviation of each statistic, since most texts have no symbols or
repeats at all, and a scatter of zero would reject every text that has one.

A group of fewer than ``LEAST`` rows is judged by the estimate of all rows. Every step is two
partial aggregations into a row for each group, so a group that holds a third of all rows costs no
more than others. The estimates are counted: up to ``BROADCAST_GROUPS`` groups they are broadcast to the rows, beyond that rows and
estimates meet by group and a salt, so rows of a group are never exchanged to one task.
Quantiles are those of ``percentile_approx``, whose error is 1 in 10,000 of the rows.

Defined results: a null text has no words and fails; null languages and sources are groups of their own; repeated rows
each count; tables without rows give none. Further columns are kept, whatever their names; only one with the name of a result
column is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.llm.common import SPACES
from castlist.session import cut_lineage

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
SHARE, LEAST = 0.75, 50
FIRST_STEPS, MOST_STEPS = 2, 20
# A determinant falls if its logarithm does by more than this, beyond the error of the quantiles.
RESTS = 1e-3
BROADCAST_GROUPS, SALTS = 100_000, 32
FLOOR = (0.4, 0.15, 0.05, 0.15, 0.12)
# Of chi-squared variables: what one in a million of five degrees of freedom exceeds; SHARE over the
# distribution function of seven degrees at the SHARE quantile of five.
CUTOFF, CONSISTENT = 35.888, 1.412
DIMENSIONS = len(FLOOR)
VECTOR = [f"x{i}" for i in range(DIMENSIONS)]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_statistics(docs: DataFrame) -> DataFrame:
    """The documents with the BASE columns, n_lines_with_words and base_failed."""
    kept = [c for c in docs.columns if c not in (*BASE, "base_failed", "n_full_lines")]
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    # Columns that are used more than once stand in a step of their own, or Spark computes them as often.
    split = docs.select(
        *kept,
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
        full.alias("_full"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    five = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, 5))),
    )
    windows = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_full").cast("long").alias("n_full_lines"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        five.alias("_five"),
    )
    repeated = F.when(F.size(F.array_distinct("_five")) == F.size("_five"), F.lit(None)).otherwise(
        F.array_sort(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    sorted_ = windows.withColumn("_sorted", repeated).drop("_five")
    again = F.filter(
        "_sorted",
        lambda s, i: (s["h"] == F.get("_sorted", i - 1)["h"]) | (s["h"] == F.get("_sorted", i + 1)["h"]),
    )
    places = sorted_.withColumn("_places", F.array_sort(F.transform(again, lambda s: s["i"]))).drop("_sorted")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_places",
        start,
        lambda acc, p: F.struct(
            (p + 5).alias("end"), (acc["n"] + p + 5 - F.greatest(acc["end"], p)).alias("n")
        ),
        lambda acc: acc["n"],
    )
    counted = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return counted.select(*kept, *BASE, "n_full_lines", failed.alias("base_failed"))


def vectors(statistics: DataFrame) -> DataFrame:
    """The rows with the transformed statistics x0 to x4."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    values = (
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_full_lines"),
        share("n_repeat_words", "n_words"),
    )
    return statistics.withColumns(dict(zip(VECTOR, values, strict=True)))


# ---- Estimates --------------------------------------------------------------------------

# The group of all rows; the others are JSON objects.
EVERYTHING = "all"
# The estimates that are improved side by side have these marks behind the names of their columns.
STARTS = ("_middle", "_every", "_low", "_high")
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def names_of(mark: str = "") -> list[str]:
    """The columns of an estimate: its centre and the factors of its scatter."""
    return [f"m{i}{mark}" for i in range(DIMENSIONS)] + [f"l{i}_{j}{mark}" for i, j in PAIRS]


def squared_distance(mark: str = "") -> Column:
    """Mahalanobis distance, squared, of x0.. from the centre m0.. by the factors l0_0, l1_0, .. of the scatter."""
    solved: list[Column] = []
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}{mark}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}{mark}") * solved[k]
        solved.append(rest / F.col(f"l{i}_{i}{mark}"))
    return reduce(lambda total, z: total + z * z, solved, F.lit(0.0))


def with_factors(estimates: DataFrame, mark: str = "") -> DataFrame:
    """The estimates with Cholesky factors l0_0, l1_0, .. of the scatter s0_0, s1_0, .., column by column."""
    for j in range(DIMENSIONS):
        rest = {}
        for i in range(j, DIMENSIONS):
            rest[i] = F.col(f"s{i}_{j}{mark}")
            for k in range(j):
                rest[i] = rest[i] - F.col(f"l{i}_{k}{mark}") * F.col(f"l{j}_{k}{mark}")
        estimates = estimates.withColumn(f"l{j}_{j}{mark}", F.sqrt(F.greatest(rest[j], F.lit(1e-9))))
        estimates = estimates.withColumns({f"l{i}_{j}{mark}": rest[i] / F.col(f"l{j}_{j}{mark}") for i in rest if i > j})
    return estimates


def log_determinant(mark: str = "") -> Column:
    return reduce(lambda total, c: total + c, [2 * F.ln(f"l{i}_{i}{mark}") for i in range(DIMENSIONS)])


def with_estimates(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of (g, ..) with the estimates, stored, of their group."""
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), "g", how)
    salted = rows.withColumn("salt", F.floor(F.rand(1) * SALTS).cast("int"))
    copies = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["g", "salt"], how).drop("salt")


def _sums(rows: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """(g, size, m.., l..) for each mark: mean and widened covariance of the rows chosen for it."""
    sums = []
    for mark, taken in chosen.items():
        sums += [F.avg(F.when(taken, F.col(x))).alias(f"m{i}{mark}") for i, x in enumerate(VECTOR)]
        sums += [F.avg(F.when(taken, F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"p{i}_{j}{mark}") for i, j in PAIRS]
    found = rows.groupBy("g").agg(F.first("size").alias("size"), *sums)
    for mark in chosen:
        scatter = {
            f"s{i}_{j}{mark}": CONSISTENT * (F.col(f"p{i}_{j}{mark}") - F.col(f"m{i}{mark}") * F.col(f"m{j}{mark}"))
            + F.lit(FLOOR[i] ** 2 if i == j else 0.0)
            for i, j in PAIRS
        }
        found = with_factors(found.withColumns(scatter), mark)
    return found.select("g", "size", *(c for mark in chosen for c in names_of(mark)))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, size, m.., l..) for each of STARTS."""
    middle = cut_lineage(rows.groupBy("g").agg(
        F.count("*").alias("size"),
        *[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}_middle") for i, x in enumerate(VECTOR)],
        *[F.stddev_pop(x).alias(f"sd{i}") for i, x in enumerate(VECTOR)],
    ))
    apart = [F.abs(F.col(x) - F.col(f"m{i}_middle")) for i, x in enumerate(VECTOR)]
    spread = with_estimates(rows, middle).groupBy("g").agg(
        *[F.percentile_approx(d, 0.5, 10000).alias(f"d{i}") for i, d in enumerate(apart)]
    )
    scale = [1.4826 * F.col(f"d{i}") + FLOOR[i] for i in range(DIMENSIONS)]
    factors = [(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}_middle") for i, j in PAIRS]
    excess = [F.col(f"sd{i}") / scale[i] for i in range(DIMENSIONS)]
    axis = F.array_position(F.array(*excess), F.greatest(*excess)).cast("int").alias("axis")
    middle = cut_lineage(
        middle.join(spread, "g").select("g", "size", *(f"m{i}_middle" for i in range(DIMENSIONS)), *factors, axis)
    )
    placed = with_estimates(rows, middle)
    value, bound = (F.element_at(F.array(*c), F.col("axis")) for c in (VECTOR, [f"m{i}_middle" for i in range(DIMENSIONS)]))
    halves = {"_every": F.lit(True), "_low": value <= bound, "_high": value >= bound}
    others = _sums(placed, halves).drop("size")
    return cut_lineage(middle.drop("axis").join(others, "g"))


def _concentrate(rows: DataFrame, estimates: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """New estimates of each group, for each mark from the rows that lie nearest by the old ones."""
    far = with_estimates(rows, estimates).select("g", "size", *VECTOR, *(squared_distance(m).alias(f"far{m}") for m in marks))
    bounds = cut_lineage(
        far.groupBy("g").agg(*[F.percentile_approx(f"far{m}", SHARE, 10000).alias(f"bound{m}") for m in marks])
    )
    return _sums(with_estimates(far, bounds), {m: F.col(f"far{m}") <= F.col(f"bound{m}") for m in marks})


def estimate(rows: DataFrame) -> DataFrame:
    """(g, size, m0.., l..): the minimum covariance determinant estimate of each group of (g, x0..)."""
    estimates = _starts(rows)
    for _ in range(FIRST_STEPS):
        estimates = cut_lineage(_concentrate(rows, estimates, STARTS))
    choice = [
        F.struct(log_determinant(m).alias("det"), *(F.col(c).alias(n) for c, n in zip(names_of(m), names_of(), strict=True)))
        for m in STARTS
    ]
    best = cut_lineage(estimates.select("g", "size", F.least(*choice).alias("best")).select("g", "size", "best.*"))
    for _ in range(MOST_STEPS):
        new = _concentrate(rows, best, ("",)).withColumn("det", log_determinant())
        both = new.join(best.select("g", F.col("det").alias("was"), *(F.col(c).alias(f"old_{c}") for c in names_of())), "g")
        # What does not fall stays as it is.
        falls = F.col("det") < F.col("was") - RESTS
        kept = {c: F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")) for c in names_of()}
        kept |= {"falls": falls, "det": F.when(falls, F.col("det")).otherwise(F.col("was"))}
        best = cut_lineage(both.withColumns(kept).select("g", "size", "det", *names_of(), "falls"))
        if best.where("falls").isEmpty():
            break
        best = best.drop("falls")
    return best.select("g", "size", *names_of())


def judge(docs: DataFrame) -> DataFrame:
    """The documents, all columns but ``text``, with BASE, base_failed, distance (squared, null if failed) and kept."""
    made = (*BASE, "base_failed", "distance", "kept")
    kept = [c for c in docs.columns if c not in ("text", *made)]
    # The other columns travel in one, so that no name can clash.
    own = F.to_json(F.struct("lang", "source")).alias("g")
    given = docs.select(F.struct(*kept).alias("row"), own, "text")
    measured = cut_lineage(vectors(base_statistics(given)).drop("text"))
    sound = measured.where(~F.col("base_failed")).select(
        F.explode(F.array("g", F.lit(EVERYTHING))).alias("g"), *VECTOR
    )
    estimates = estimate(sound)
    own_estimates = estimates.where((F.col("g") != EVERYTHING) & (F.col("size") >= LEAST))
    all_rows = estimates.where(F.col("g") == EVERYTHING).select(F.lit(True).alias("few"), *names_of())
    few = estimates.where((F.col("g") != EVERYTHING) & (F.col("size") < LEAST)).select("g", F.lit(True).alias("few"))
    few = few.join(F.broadcast(all_rows), "few").drop("few")
    used = cut_lineage(own_estimates.select("g", *names_of()).unionByName(few))
    placed = with_estimates(measured, used, "left").withColumn(
        "distance", F.when(~F.col("base_failed"), squared_distance())
    )
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return placed.select(*(F.col("row")[c].alias(c) for c in kept), *BASE, "base_failed", "distance", verdict.alias("kept"))
