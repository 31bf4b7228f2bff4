"""Bringing per-document items (names, mappings) to the document's text.

Texts are the bulk of a corpus, so they should not be shuffled without need.
If all items together are small, which is measured, they are broadcast and
the texts stay where they are. Else texts and lists of items are joined by
document. No list is longer than a task can hold: the items of a document with
more are either dealt out to several tasks, or, where their order matters,
streamed past the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.operators.skew import HeavyKeys, with_parts

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
OUTPUT_BATCH_BYTES = 4 * 1024 * 1024
ARROW_TYPES = {"int": pa.int32(), "string": pa.string()}

Fold = Callable[[str, Iterator[tuple]], Iterable[tuple]]


def fits_broadcast(items: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True if the rows, measured by one aggregate over them, stay within limit."""
    strings = [
        F.coalesce(F.octet_length(field.name), F.lit(0))
        for field in items.schema
        if field.dataType.simpleString() == "string"
    ]
    row_bytes = sum(strings, F.lit(ROW_OVERHEAD_BYTES))
    total = items.agg(F.sum(row_bytes.cast("bigint")).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def with_item_lists(
    docs: DataFrame,
    items: DataFrame,
    columns: list[str],
    small: bool,
    how: str = "left",
    heavy: HeavyKeys | None = None,
    collect: Callable[[Column], Column] = F.collect_list,
) -> DataFrame:
    """The documents with their ``items``, an array of structs sorted by the columns.

    ``small`` items are broadcast. A document without items has NULL there.
    With ``heavy`` a document of many items appears several times, each with a
    share of them; use it only where items do not depend on each other. Without,
    the items are grouped by document alone, and the exchange for that serves
    the join too. ``collect`` may be ``collect_set`` to drop repeated items;
    equal items meet in one share.
    """
    keys, dealt = ["doc_id"], items
    if heavy is not None:
        keys = ["doc_id", "part"]
        part = F.pmod(F.xxhash64(*columns), F.col("parts").cast("bigint")).cast("int")
        dealt = with_parts(items, "doc_id", heavy).withColumn("part", part)
    lists = dealt.groupBy(*keys).agg(F.sort_array(collect(F.struct(*columns))).alias("items"))
    if heavy is not None:
        numbers = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        docs = with_parts(docs, "doc_id", heavy).withColumn("part", numbers).drop("parts")
    return docs.join(F.broadcast(lists) if small else lists, keys, how)


def fold_items(
    docs: DataFrame,
    items: DataFrame,
    columns: list[str],
    order: list[Column],
    fold: Fold,
    output: dict[str, str],
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``fold(text, items)`` for every document, over a stream of its items.

    ``fold`` gets the item columns as tuples, in the given order, and yields
    tuples for the ``output`` columns (name to "int" or "string"). Items without
    a document are ignored. String columns of the documents named in ``carry``
    appear on each of their rows.
    """
    item_types = {field.name: field.dataType for field in items.schema}
    texts = docs.select(
        "doc_id",
        F.lit(0).alias("kind"),
        "text",
        *carry,
        *(F.lit(None).cast(item_types[name]).alias(name) for name in columns),
    )
    rows = items.select(
        "doc_id",
        F.lit(1).alias("kind"),
        *(F.lit(None).cast("string").alias(name) for name in ("text", *carry)),
        *columns,
    )
    together = (
        texts.unionByName(rows)
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "kind", *order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold_batches(batches, carry, columns, fold, out_types)

    out_types = dict.fromkeys(carry, "string") | output
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [f"doc_id {id_type}", *(f"{name} {kind}" for name, kind in out_types.items())]
    return together.mapInArrow(run, ", ".join(fields))


def _fold_batches(
    batches: Iterator[pa.RecordBatch],
    carry: tuple[str, ...],
    columns: list[str],
    fold: Fold,
    output: dict[str, str],
) -> Iterator[pa.RecordBatch]:
    id_type = pa.null()
    start = 3 + len(carry)

    def flat_rows() -> Iterator[tuple]:
        nonlocal id_type
        names = ["doc_id", "kind", "text", *carry, *columns]
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            yield from zip(*(batch.column(name).to_pylist() for name in names))

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        types = [id_type, *(ARROW_TYPES[kind] for kind in output.values())]
        arrays = [pa.array(column, type_) for column, type_ in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *output])

    pending: list[tuple] = []
    size = 0
    for doc_id, group in groupby(flat_rows(), key=itemgetter(0)):
        first = next(group)
        kind, text, carried = first[1], first[2], first[3:start]
        if kind != 0 or text is None:
            continue
        for row in fold(text, (row[start:] for row in group)):
            pending.append((doc_id, *carried, *row))
            size += ROW_OVERHEAD_BYTES + sum(len(v) for v in row if isinstance(v, str))
            if size >= OUTPUT_BATCH_BYTES:
                yield flush(pending)
                pending, size = [], 0
    if pending:
        yield flush(pending)
