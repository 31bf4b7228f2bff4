"""Sessions for local use, and cutting lineage where a result must not be redone."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import islice
from pathlib import Path
from uuid import uuid4
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("castlist")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of a session.

    Not needed where it is installed on the executors or passed with
    ``--py-files``. Does nothing the second time.
    """
    context = spark.sparkContext
    if any(name.endswith("/castlist.zip") for name in context.listFiles):
        return spark
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="castlist-package-")) / "castlist.zip"
    with ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    return spark


# What goes to Python workers at once: texts are long rows, so the number of rows alone is no bound.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session with ``BATCHES``, where it does not say otherwise."""
    chosen = spark.conf.getAll
    for name, value in BATCHES.items():
        if name not in chosen:
            spark.conf.set(name, value)
    return spark


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a result down once, as a Parquet table, and go on from the copy.

    Without a path the table goes into ``shared_folder``. Unlike an eager
    checkpoint, which runs its plan a second time to store it, this runs the
    plan once, so no request is made twice. Tables without a path of their own
    are removed by ``drop_stored``, at the latest when the session ends. What the
    plan has exchanged goes with its end.
    """
    spark = df.sparkSession
    target = path or new_table(spark)
    with _released(spark):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


# Without it shuffle files stay until the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the plans run within go as soon as these end; only for plans that nobody runs again."""
    before = spark.conf.getAll.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


# The tables in the shared folder that this process has stored, by application.
_stored: dict[str, list[str]] = {}


def new_table(spark: SparkSession, prefix: str = "castlist") -> str:
    """A path for a new table or folder in the shared folder, to be removed by ``drop_stored``."""
    target = f"{shared_folder(spark)}/{prefix}-{uuid4().hex}"
    tables = _stored.setdefault(spark.sparkContext.applicationId, [])
    if not tables:
        atexit.register(_drop_quietly, spark)
    tables.append(target)
    if (inner := getattr(_scratch, "tables", None)) is not None:
        inner.append(target)
    return target


# The tables that the innermost ``scratch`` of a thread has stored.
_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables in the shared folder that are begun within are removed at its end; no result may read them later."""
    outer, _scratch.tables = getattr(_scratch, "tables", None), []
    try:
        yield
    finally:
        made, _scratch.tables = _scratch.tables, outer
        stored = _stored.get(spark.sparkContext.applicationId, [])
        _delete(spark, [table for table in made if table in stored])
        stored[:] = [table for table in stored if table not in made]


# The entries in the catalogue that go with the stored tables, by application.
_named: dict[str, list[str]] = {}


def forget_later(spark: SparkSession, name: str) -> None:
    """Take a table out of the catalogue when the stored tables are dropped, at the latest when the process ends."""
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)


def drop_stored(spark: SparkSession) -> int:
    """Remove all tables stored without a path; results not yet taken that read them fail afterwards."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    tables = _stored.pop(spark.sparkContext.applicationId, [])
    _delete(spark, tables)
    return len(tables)


def _delete(spark: SparkSession, tables: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table)
        system = path.getFileSystem(conf)
        uri = system.makeQualified(path).toUri()
        if uri.getScheme() == "file":
            _delete_local(uri.getPath())
        else:
            system.delete(path, True)


def _delete_local(folder: str) -> None:
    """Remove a folder, some entries at a time: Hadoop would hold the names of all its files."""
    while True:
        try:
            with os.scandir(folder) as entries:
                some = list(islice(entries, 10_000))
        except FileNotFoundError:
            return
        for entry in some:
            if entry.is_dir(follow_symlinks=False):
                _delete_local(entry.path)
            else:
                os.unlink(entry.path)
        if not some:
            os.rmdir(folder)
            return


def _drop_quietly(spark: SparkSession) -> None:
    """At exit; a session that has stopped has nobody left to remove its tables."""
    if spark.sparkContext._jsc is not None:
        drop_stored(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = _temporary_folder()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return folder.rstrip("/")


@cache
def _temporary_folder() -> str:
    return tempfile.mkdtemp(prefix="castlist-tables-")
