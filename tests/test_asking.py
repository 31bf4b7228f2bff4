import os
import time

import pytest
from pyspark.sql import functions as F

from castlist.functions import replies
from castlist.operators import asking, names, scoring
from castlist.plans.extract import extract_names
from castlist.session import cut_lineage
from castlist.sources import shared


class RateLimitError(Exception):
    pass


def counting(folder, refuse=(), fail=(), die=(), pause=0.0):
    """A maker of answers that leaves a file for each call."""

    def make():
        def answer(prompt):
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{time.time():.6f}-{os.getpid()}-{prompt}", "w"):
                pass
            time.sleep(pause)
            if prompt in die and not os.path.exists(f"{folder}-died"):
                open(f"{folder}-died", "w").close()
                os._exit(1)
            if prompt in refuse:
                raise RuntimeError("Error code: 429")
            if prompt in fail:
                raise TimeoutError("late")
            return prompt.upper()

        return answer

    return make


def calls(folder):
    return sorted(name.split("-", 2)[2] for name in os.listdir(folder)) if os.path.exists(folder) else []


def starts(folder):
    return sorted(float(name.split("-")[0]) for name in os.listdir(folder))


@pytest.fixture
def chunks(spark):
    def make(n, docs=3):
        rows = [(i % docs, i // docs, f"p{i}") for i in range(n)]
        return spark.createDataFrame(rows, "doc_id bigint, chunk_idx int, chunk string")

    return make


def ask(chunks, make, log, **options):
    return cut_lineage(asking.ask_chunks(chunks, make, str(log), scoring.SLOT, **options)).collect()


def test_answers_are_those_of_score_chunks(chunks, tmp_path):
    make = counting(str(tmp_path / "a"), fail=("p3",))
    plain = scoring.score_chunks(chunks(20), make, scoring.SLOT).collect()
    logged = ask(chunks(20), make, tmp_path / "log", partitions=3)
    assert sorted(map(tuple, logged)) == sorted(map(tuple, plain))


def test_nothing_logged_is_asked_again(chunks, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    ask(chunks(12), counting(first, fail=("p3",)), tmp_path / "log", partitions=3)
    rows = ask(chunks(15), counting(second), tmp_path / "log", partitions=3)
    assert calls(second) == ["p12", "p13", "p14"] and len(rows) == 15
    assert {r.error for r in rows} == {None, "late"}
    again = ask(chunks(15), counting(str(tmp_path / "c")), tmp_path / "log", retry_errors=True)
    assert calls(str(tmp_path / "c")) == ["p3"] and len(again) == 15 and all(r.error is None for r in again)


def test_another_prompt_to_the_same_chunk_is_asked(chunks, tmp_path):
    ask(chunks(3), counting(str(tmp_path / "a")), tmp_path / "log")
    changed = chunks(3).withColumn("chunk", F.when(F.col("chunk") == "p1", "other").otherwise(F.col("chunk")))
    rows = ask(changed, counting(str(tmp_path / "b")), tmp_path / "log")
    assert calls(str(tmp_path / "b")) == ["other"] and {r.response for r in rows} == {"P0", "OTHER", "P2"}


@pytest.mark.parametrize("flush", [1, 4])
def test_a_killed_task_repeats_no_logged_request(chunks, tmp_path, flush):
    folder, log = str(tmp_path / "a"), tmp_path / "log"
    with pytest.raises(Exception):  # noqa: B017  a local session does not repeat tasks
        ask(chunks(20, docs=1), counting(folder, die=("p9",)), log, partitions=1, flush=flush)
    assert len(calls(folder)) == 10
    rows = ask(chunks(20, docs=1), counting(folder), log, partitions=1, flush=flush)
    lost = 9 % flush
    assert len(calls(folder)) == 20 + 1 + lost and sorted(r.response for r in rows) == sorted(f"P{i}" for i in range(20))


def test_a_repeated_task_goes_on_where_the_first_attempt_was_killed(spark, tmp_path):
    """Two attempts of one partition of one run, without Spark's scheduler."""
    import pyarrow as pa

    schema = asking._log_schema(pa.schema([pa.field("doc_id", pa.int64())]))
    row = {"doc_id": None, "chunk_idx": 0, "prompt_hash": "h", "response": "r", "error_class": None, "error": None, "started": 1.0}
    first = asking.Log(str(tmp_path / "part"), schema, 1)
    first.add(row)
    first.add(row | {"chunk_idx": 1})
    second = asking.Log(str(tmp_path / "part"), schema, 1)
    assert second.held.keys() == first.held.keys() and len(shared.names(str(tmp_path / "part"))) == 2
    second.add(row | {"chunk_idx": 2})
    second.close()
    assert len(shared.names(str(tmp_path / "part"))) == 1
    assert len(asking.Log(str(tmp_path / "part"), schema, 1).held) == 3


def test_a_task_that_ended_leaves_one_file(chunks, tmp_path):
    ask(chunks(9), counting(str(tmp_path / "a")), tmp_path / "log", partitions=1)
    files = [f for _, _, names_ in os.walk(tmp_path / "log" / "answers") for f in names_]
    assert len(files) == 1


def test_a_refusal_stops_all_tasks(chunks, tmp_path):
    folder, n = str(tmp_path / "a"), 80
    rows = ask(chunks(n, docs=8), counting(folder, refuse=("p0",), pause=0.05), tmp_path / "log", partitions=4)
    refused = [r for r in rows if r.error_class == "RuntimeError"]
    unasked = [r for r in rows if r.error_class == asking.NOT_ASKED]
    assert len(rows) == n and len(refused) == 1 and len(unasked) == n - len(calls(folder))
    # Before the refusal its task may have answered others; after it every task makes one more call at most.
    seen = starts(folder)
    at = next(float(f.split("-")[0]) for f in os.listdir(folder) if f.endswith("-p0"))
    assert sum(t > at + 0.06 for t in seen) <= 4
    resumed = ask(chunks(n, docs=8), counting(str(tmp_path / "b")), tmp_path / "log", partitions=4)
    assert {r.response for r in resumed} == {f"P{i}" for i in range(n)}
    assert len(calls(str(tmp_path / "b"))) == len(unasked) + 1


def test_without_stop_a_refusal_is_a_failed_chunk(chunks, tmp_path):
    rows = ask(chunks(6), counting(str(tmp_path / "a"), refuse=("p2",)), tmp_path / "log", stop=False)
    assert sorted(r.error or "" for r in rows) == [""] * 5 + ["Error code: 429"]
    rows = ask(chunks(6), counting(str(tmp_path / "b")), tmp_path / "log")
    assert calls(str(tmp_path / "b")) == ["p2"] and all(r.error is None for r in rows)


def test_starts_of_all_tasks_lie_an_interval_apart(spark, chunks, tmp_path):
    folder, interval = str(tmp_path / "a"), 0.12
    ask(chunks(16, docs=4), counting(folder), tmp_path / "log", partitions=4, interval=interval)
    logged = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "log" / "answers"))
    times = sorted(r.started for r in logged.collect())
    assert len(times) == 16 and min(b - a for a, b in zip(times, times[1:])) >= interval


def test_a_ticket_goes_to_one_taker(tmp_path):
    path = str(tmp_path / "t" / "1")
    assert shared.publish(path, b"a") and not shared.publish(path, b"b")
    assert shared.read(path) == b"a" and shared.names(str(tmp_path / "t")) == [path]
    assert shared.read(str(tmp_path / "none")) is None and shared.names(str(tmp_path / "none")) == []
    with pytest.raises(ValueError, match="exclusively"):
        shared.publish("s3://bucket/name", b"a")


def test_turns_survive_removed_tickets(tmp_path, monkeypatch):
    monkeypatch.setattr(asking, "TICKETS", 2)
    one, other = asking.Turns(str(tmp_path / "t"), 0.01), asking.Turns(str(tmp_path / "t"), 0.01)
    times = [other.wait()] + [one.wait() for _ in range(5)] + [other.wait()]
    assert min(b - a for a, b in zip(times, times[1:])) >= 0.01
    assert len(shared.names(str(tmp_path / "t"))) <= 3


def test_refusals_are_those_of_the_column(spark):
    class Odd(Exception):
        pass

    failures = [RateLimitError("x"), Odd("Rate Limit hit"), Odd("ERROR CODE: 429"), Odd("429"), Odd(""), TimeoutError("rate")]
    rows = spark.createDataFrame([(type(f).__name__, str(f)) for f in failures], "c string, e string")
    column = rows.select(replies.is_rate_limit(F.col("c"), F.col("e")).alias("x")).collect()
    assert [r.x for r in column] == [asking.is_refusal(f) for f in failures] == [True, True, True, False, False, False]


def test_outcomes_of_a_stopped_run(spark):
    rows = [
        (1, 0, "[]", ["A"], None, None),
        (1, 1, None, None, asking.NOT_ASKED, asking.NOT_ASKED_MESSAGE),
        (2, 0, None, None, "RuntimeError", "Error code: 429"),
        (2, 1, None, None, asking.NOT_ASKED, asking.NOT_ASKED_MESSAGE),
        (3, 0, "[]", ["B"], None, None),
    ]
    schema = "doc_id bigint, chunk_idx int, response string, names array<string>, error_class string, error string"
    found = {r.doc_id: r for r in names.run_outcome(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i].status for i in (1, 2, 3)] == ["stopped", "rate_limited", "ok"]
    assert found[1].message == "1 chunk(s) not asked" and found[1].details == asking.NOT_ASKED_MESSAGE
    assert found[1].n_failed == 0 and found[2].n_failed == 1


def test_extraction_with_a_log(spark, docs_of, tmp_path):
    docs = docs_of("Anna met Bert.", "Carl", "")

    def make():
        def answer(prompt):
            if "Carl" in prompt:
                raise RateLimitError("no")
            return '{"names": ["Anna"]}'

        return answer

    def patient():
        return lambda prompt: '{"names": ["Carl"]}' if "Carl" in prompt else 1 / 0

    log = str(tmp_path / "log")
    first = extract_names(docs, make, template=scoring.SLOT, log=log, interval=0.01)
    assert {r.doc_id: r.status for r in first.outcome.collect()}[1] == "rate_limited"
    second = extract_names(docs, patient, template=scoring.SLOT, log=log)
    assert [r.status for r in second.outcome.collect()] == ["ok"] * 3
    assert sorted(r.name for r in second.ranked.collect()) == ["Anna", "Carl"]
