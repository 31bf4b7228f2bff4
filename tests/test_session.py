import pytest
from pyspark.sql import functions as F

from castlist import session
from castlist.functions import layout
from castlist.operators import chunks, mapping, names, replacing


class Unset:
    """A session that has no folder set."""

    def __init__(self, master):
        self.sparkContext = self
        self.master = master
        self.conf = {}


def test_shared_folder(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(Unset("local[2]")) == session.shared_folder(Unset("local"))
    with pytest.raises(ValueError, match="shared folder"):
        session.shared_folder(Unset("spark://cluster"))


def test_cut_lineage_runs_the_plan_once(spark, tmp_path):
    log = str(tmp_path / "runs")

    def note(batches):
        with open(log, "a") as runs:
            runs.write("x")
        yield from batches

    df = spark.range(0, 5, 1, 1).mapInArrow(note, "id bigint")
    stored = session.cut_lineage(df)
    assert stored.count() == 5 and stored.count() == 5
    assert len(open(log).read()) == 1
    again = session.cut_lineage(df, str(tmp_path / "table"))
    assert again.count() == spark.read.parquet(str(tmp_path / "table")).count() == 5


def test_package_is_shipped_once(spark):
    before = list(spark.sparkContext.listFiles)
    session.ship_package(spark)
    assert list(spark.sparkContext.listFiles) == before


def test_missing_texts_yield_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "Ann")], "doc_id bigint, text string")
    assert [row.doc_id for row in chunks.split_into_chunks(docs).collect()] == [2]
    assert docs.select(layout.repair_layout(F.col("text"))).first()[0] is None
    named = docs.withColumn("names", F.array(F.lit("Ann")))
    assert [tuple(row) for row in names.count_own_names(named).collect()] == [(2, "Ann", 1, 1)]
    wanted = spark.createDataFrame([(1, "Ann", "Eve", 1), (2, "Ann", "Eve", 1), (2, "Zed", "x", 2)],
                                   "doc_id bigint, original string, replacement string, rank int")
    for limits in ((1 << 20, 9), (0, 9), (0, 1)):
        done = replacing.replaced_texts(replacing.apply_replacements(docs, wanted, *limits))
        assert [(row.doc_id, row.text) for row in done.collect()] == [(2, "Eve")]


@pytest.mark.parametrize("limits", [(1 << 20, 9), (0, 9), (0, 1)])
def test_ids_may_be_strings(spark, limits):
    docs = spark.createDataFrame([("p/a", "Ann Bob Ann"), ("p/b", "Bob")], "doc_id string, text string")
    listed = spark.createDataFrame([("p/a", "Ann"), ("p/a", "Bob"), ("p/b", "Bob")],
                                   "doc_id string, name string")
    ranked = mapping.rank_names(names.count_occurrences(docs, listed, *limits), rows_per_task=limits[1])
    assert {tuple(row) for row in ranked.collect()} == {
        ("p/a", "Ann", 2, 1), ("p/a", "Bob", 1, 2), ("p/b", "Bob", 1, 1),
    }
    rows = mapping.name_rows(ranked).withColumn("replacement", F.lit("Eve"))
    applied = replacing.apply_replacements(docs, mapping.edited_mappings(rows), *limits)
    texts = {row.doc_id: row.text for row in replacing.replaced_texts(applied).collect()}
    assert texts == {"p/a": "Eve Eve Eve", "p/b": "Eve"}


def test_a_run_leaves_nothing_behind(spark):
    import os

    session.drop_stored(spark)
    folder = session.shared_folder(spark)
    before = set(os.listdir(folder))
    counts = spark.createDataFrame([(1, f"n{i}", 1) for i in range(20)], "doc_id bigint, name string, occurrences int")
    assert mapping.rank_names(counts, rows_per_task=5).count() == 20
    assert set(os.listdir(folder)) > before
    assert session.drop_stored(spark) >= 2 and set(os.listdir(folder)) == before


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    wanted = spark.conf.getAll.get(session.RELEASE)
    before = set(known.keySet().mkString(",").split(","))
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = session.cut_lineage(rows)
    assert set(known.keySet().mkString(",").split(",")) <= before
    assert stored.count() == 7 and rows.count() == 7 and spark.conf.getAll.get(session.RELEASE) == wanted


def test_scratch_tables_go_at_the_end(spark):
    import os

    session.drop_stored(spark)
    folder = session.shared_folder(spark)
    before = set(os.listdir(folder))
    target = session.new_table(spark)
    with session.scratch(spark):
        first = session.cut_lineage(spark.range(5))
        with session.scratch(spark):
            assert session.cut_lineage(first.where("id > 2")).count() == 2
        assert first.count() == 5 and len(set(os.listdir(folder)) - before) == 1
        kept = session.cut_lineage(first.where("id > 1"), target)
    assert set(os.listdir(folder)) - before == {target.rpartition("/")[2]} and kept.count() == 3
    assert session.drop_stored(spark) == 1 and set(os.listdir(folder)) == before


def test_folders_with_many_files_go_some_at_a_time(spark):
    import os

    session.drop_stored(spark)
    local = session.new_table(spark).removeprefix("file:")
    os.makedirs(f"{local}/a/b")
    for i in range(10_050):
        open(f"{local}/a/{i}", "w").close()
    os.symlink("/none", f"{local}/a/b/link")
    os.symlink(session.shared_folder(spark).removeprefix("file:"), f"{local}/a/folder")
    session.new_table(spark)  # nothing was ever written there
    assert session.drop_stored(spark) == 2
    assert not os.path.lexists(local) and os.path.isdir(session.shared_folder(spark).removeprefix("file:"))
