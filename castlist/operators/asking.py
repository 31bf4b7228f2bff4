"""Model calls with a log: nothing that was answered is asked again, one pace for all tasks, one refusal stops them.

The log is a folder that all tasks reach (see ``castlist.sources.shared``). Its ``answers`` are Parquet files of
(doc_id, chunk_idx, prompt_hash, response, error_class, error, started), written as the answers come; a task that ends puts its
own into one file. Chunks with a logged answer to the same prompt are left out by an anti-join before any
task starts. A task that is repeated first reads what its earlier attempts have logged, and goes on from there, so killed
tasks cost the answers not yet written, none with ``flush`` 1.

A request refused by a rate limit is not logged as answered. The task that sees it leaves a marker; all tasks look for
it before each call, and the chunks not asked become rows of the class ``NotAsked``. So after a refusal there
are at most as many calls as tasks were running. The next run with the same log asks what is still open.

``interval`` is the least time between the starts of any two calls of the run, whatever the number of tasks. A
task takes the next of a row of tickets, files that only one task can create; each names a start at least an interval after the one
before. A task that wakes too late for its ticket takes another. Clocks of the machines must agree.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.operators.scoring import DEFAULT_PROMPT, RESPONSES, prompt
from castlist.sources import shared

# How providers say that a request came too soon, as in ``castlist.functions.replies``.
REFUSED_CLASS, REFUSED_MESSAGES = "ratelimit", ("rate limit", "error code: 429")
NOT_ASKED = "NotAsked"
NOT_ASKED_MESSAGE = "not asked: the run had been stopped"

ANSWER = ("response", "error_class", "error")
# The tickets that are kept behind the last one, and how late a task may be for its own.
TICKETS, LATE = 1000, 0.05


def is_refusal(failure: BaseException) -> bool:
    """True if a call failed because the rate limit was exceeded."""
    message = str(failure).lower()
    return REFUSED_CLASS in type(failure).__name__.lower() or any(m in message for m in REFUSED_MESSAGES)


class Turns:
    """Starts of calls, at least ``interval`` seconds apart over all that share the folder."""

    def __init__(self, folder: str, interval: float):
        self.folder, self.interval = folder, interval
        self.last = -1

    def wait(self) -> float:
        """Sleep until a turn of one's own has come; its time."""
        while self.interval > 0:
            planned = self._ticket()
            time.sleep(max(0.0, planned - time.time()))
            if (now := time.time()) <= planned + LATE:
                return now
        return time.time()

    def _ticket(self) -> float:
        while True:
            before = self._newest()
            planned = max(time.time(), before + self.interval + LATE)
            if shared.publish(self._path(self.last + 1), repr(planned).encode()):
                self.last += 1
                if self.last >= TICKETS:
                    shared.remove(self._path(self.last - TICKETS))
                return planned

    def _newest(self) -> float:
        """The start that the newest ticket names; ``last`` becomes its number."""
        known = shared.read(self._path(self.last)) if self.last >= 0 else None
        if known is None and (held := shared.names(self.folder)):
            self.last = int(held[-1].rpartition("/")[2])
            known = shared.read(held[-1])
        while (later := shared.read(self._path(self.last + 1))) is not None:
            self.last, known = self.last + 1, later
        return float(known) if known else float("-inf")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:015d}"


class Log:
    """The answers that one partition of a run has written."""

    def __init__(self, folder: str, schema: pa.Schema, flush: int):
        self.folder, self.schema, self.flush = folder, schema, flush
        self.rows: list[dict] = []
        self.files = shared.names(folder)
        self.held = {_key(row): row for path in self.files for row in self._read(path)}

    def _read(self, path: str) -> list[dict]:
        content = shared.read(path)
        return pq.read_table(pa.BufferReader(content)).to_pylist() if content is not None else []

    def add(self, row: dict) -> None:
        self.held[_key(row)] = row
        self.rows.append(row)
        if len(self.rows) >= self.flush:
            self._write(self.rows)
            self.rows = []

    def _write(self, rows: list[dict]) -> None:
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pylist(rows, self.schema), sink)
        path = f"{self.folder}/{uuid.uuid4().hex}.parquet"
        shared.put(path, sink.getvalue().to_pybytes())
        self.files.append(path)

    def close(self) -> None:
        """Everything into one file; those before it go afterwards, so that nothing is missing at any time."""
        old = list(self.files)
        if self.rows or len(old) > 1:
            self._write(list(self.held.values()))
            for path in old:
                shared.remove(path)


def _key(row: dict) -> tuple:
    return row["doc_id"], row["chunk_idx"], row["prompt_hash"]


def logged_answers(chunks: DataFrame, log: str) -> DataFrame:
    """(doc_id, chunk_idx, prompt_hash, response, error_class, error, started) of a log, each request once."""
    spark = chunks.sparkSession
    fields = [("chunk_idx", "integer"), ("prompt_hash", "string"), *((name, "string") for name in ANSWER), ("started", "double")]
    schema = T.StructType([T.StructField("doc_id", chunks.schema["doc_id"].dataType)])
    for name, kind in fields:
        schema = schema.add(name, kind)
    if not shared.exists(f"{log}/answers"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{log}/answers")
    return rows.dropDuplicates(["doc_id", "chunk_idx", "prompt_hash"])


def ask_chunks(
    chunks: DataFrame,
    make_fn: Callable[[], Callable[[str], str]],
    log: str,
    template: str = DEFAULT_PROMPT,
    interval: float = 0.0,
    partitions: int | None = None,
    stop: bool = True,
    retry_errors: bool = False,
    flush: int = 1,
) -> DataFrame:
    """Rows (doc_id, chunk_idx, response, error_class, error), one per chunk (doc_id, chunk_idx, chunk).

    As ``score_chunks``, with the log in the folder ``log``. A failed call is logged like an answer; with
    ``retry_errors`` a later run makes it again. Without ``stop`` a refusal is a failed chunk like others, but is asked
    again by the next run too. ``flush`` is the number of answers a task gathers before it writes them.
    """
    log = log.rstrip("/")
    prompts = chunks.select(
        "doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), prompt(F.col("chunk"), template).alias("prompt")
    ).withColumn("prompt_hash", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    logged = logged_answers(chunks, log)
    if retry_errors:
        logged = logged.where(F.col("error").isNull())
    done = logged.select(*(F.col(c).alias(f"logged_{c}") for c in ("doc_id", "chunk_idx", "prompt_hash")), *ANSWER)
    same = F.col("doc_id").eqNullSafe(F.col("logged_doc_id"))
    for name in ("chunk_idx", "prompt_hash"):
        same = same & (F.col(name) == F.col(f"logged_{name}"))
    known = prompts.join(done, same).select("doc_id", "chunk_idx", *ANSWER)
    rest = prompts.join(done, same, "left_anti")
    if partitions is not None:
        rest = rest.repartition(partitions, "doc_id", "chunk_idx")
    rest = rest.sortWithinPartitions("doc_id", "chunk_idx")
    run = uuid.uuid4().hex

    def call_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        book = fn = None
        turns, stopped = Turns(f"{log}/turns/{run}", interval), False
        marker = f"{log}/stopped/{run}"
        for batch in batches:
            if book is None:
                book = Log(f"{log}/answers/{run}/{part}", _log_schema(batch.schema), flush)
            answers = []
            for doc_id, chunk_idx, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = book.held.get((doc_id, chunk_idx, digest))
                if held is not None:
                    answers.append([held[name] for name in ANSWER])
                    continue
                stopped = stopped or (stop and shared.exists(marker))
                if stopped:
                    answers.append((None, NOT_ASKED, NOT_ASKED_MESSAGE))
                    continue
                fn = fn or make_fn()
                started = turns.wait()
                refused = False
                try:
                    answer = (fn(text) or "", None, None)
                except Exception as failure:  # any failure is a result row
                    answer, refused = (None, type(failure).__name__, str(failure)), is_refusal(failure)
                if refused and stop:
                    shared.put(marker, answer[2].encode())
                if not refused:
                    row = {"doc_id": doc_id, "chunk_idx": chunk_idx, "prompt_hash": digest, "started": started}
                    book.add(row | dict(zip(ANSWER, answer, strict=True)))
                answers.append(answer)
            columns = [pa.array(c, pa.string()) for c in zip(*answers, strict=True)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "chunk_idx", *ANSWER])
        if book is not None:
            book.close()

    kind = chunks.schema["doc_id"].dataType.simpleString()
    asked = rest.select("doc_id", "chunk_idx", "prompt", "prompt_hash").mapInArrow(call_all, RESPONSES.format(id_type=kind))
    return known.unionByName(asked)


def _log_schema(schema: pa.Schema) -> pa.Schema:
    texts = [pa.field(name, pa.string()) for name in ("prompt_hash", *ANSWER)]
    return pa.schema([schema.field("doc_id"), pa.field("chunk_idx", pa.int32()), *texts, pa.field("started", pa.float64())])
