"""Export again only what has changed: a manifest of the exported documents with a digest of what they were made from.

The digest of a document covers its path, encoding and text and, summed up without order, all of its edited mappings. A run
compares digests with those of the manifest, replaces names in the documents whose digest is new, writes their files together
(see ``castlist.sources.datasource``), and then puts a new manifest in place of the old one by replacing a small file
that names it. A run that dies before that has changed no manifest, and the next one writes the same files again.

The manifest lies in the folder ``_castlist`` of the output folder. One run at a time; files removed by others are
not noticed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.operators import mapping, matching
from castlist.plans.rename import export_documents
from castlist.session import cut_lineage
from castlist.sources import files, shared

MANIFEST = "doc_id {}, path string, digest string, n_names int, total int, run int"


@dataclass(frozen=True)
class Export:
    """``written`` files in ``run``; ``manifest`` has (doc_id, path, digest, n_names, total, run) of all exported documents.

    ``dropped`` are rows of the manifest before whose documents have no edits, or are missing, now. Their files stay.
    """

    run: int
    written: int
    manifest: DataFrame
    dropped: DataFrame


def digests(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, digest) of the documents with an edited name."""
    one = [F.xxhash64(F.lit(seed), "original", "replacement", "rank") for seed in (0, 1)]
    edits = mapping.edited_mappings(rows).groupBy("doc_id").agg(
        F.concat_ws(
            "/", F.count(F.lit(1)), F.bit_xor(one[0]), F.sum(one[1].cast("decimal(38,0)"))
        ).alias("edits")
    )
    content = F.sha2(F.concat_ws("\x00", "path", "encoding", "text"), 256).alias("content")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", content)
    return texts.join(edits, "doc_id").select("doc_id", F.sha2(F.concat("content", "edits"), 256).alias("digest"))


def read_manifest(docs: DataFrame, folder: str) -> tuple[int, DataFrame]:
    """The number of the last run and its manifest, an empty one before the first."""
    spark = docs.sparkSession
    schema = MANIFEST.format(docs.schema["doc_id"].dataType.simpleString())
    current = shared.read(f"{folder}/_castlist/current")
    if current is None:
        return 0, spark.createDataFrame([], schema)
    named = json.loads(current)
    return named["run"], spark.read.schema(schema).parquet(f"{folder}/_castlist/{named['manifest']}")


def export_changed(
    docs: DataFrame, rows: DataFrame, folder: str, broadcast_bytes: int = matching.BROADCAST_BYTES
) -> Export:
    """Write the processed files of all (doc_id, path, text, encoding) that have changed since the last run into ``folder``'s manifest.

    ``rows`` is the mapping table, stored. The files lie where ``export_documents`` puts them, next to the documents.
    """
    folder = folder.rstrip("/")
    last, before = read_manifest(docs, folder)
    run = last + 1
    old = before.select("doc_id", F.col("digest").alias("old"))
    state = cut_lineage(digests(docs, rows).join(old, "doc_id", "full"))
    changed = state.where(F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("old")))
    changed = changed.select("doc_id", "digest")
    todo, edits = (table.join(changed.select("doc_id"), "doc_id", "left_semi") for table in (docs, rows))
    out = cut_lineage(export_documents(todo, edits, broadcast_bytes))
    written = files.save_files(out.select("path", "text", "encoding"))
    made = out.join(changed, "doc_id").select(
        "doc_id", "path", "digest", *(F.col(c).cast("int").alias(c) for c in ("n_names", "total")), F.lit(run).alias("run")
    )
    same = state.where(F.col("digest") == F.col("old")).select("doc_id")
    name = f"manifest-{run}-{uuid.uuid4().hex}"
    manifest = cut_lineage(before.join(same, "doc_id", "left_semi").unionByName(made), f"{folder}/_castlist/{name}")
    dropped = cut_lineage(before.join(state.where(F.col("digest").isNotNull()), "doc_id", "left_anti"))
    shared.put(f"{folder}/_castlist/current", json.dumps({"run": run, "manifest": name}).encode())
    return Export(run, written, manifest, dropped)
