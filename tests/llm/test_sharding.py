
import pytest

from castlist.llm import queries, sharding

SHARDS = ["a", "b", "c", "d", "e"]


def claimed_in_turn(shards, slots):
    """The table by its definition, with lists."""
    orders = []
    for shard in shards:
        offset, step = sharding.preference(shard, slots)
        orders.append([(offset + i * step) % slots for i in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = [slot for slot in order if slot not in owner]
            if free:
                owner[free[0]] = i
    return [owner[slot] for slot in range(slots)]


@pytest.mark.parametrize("slots", [5, 7, 101])
def test_table_equals_its_definition(slots):
    assert sharding.lookup_table(SHARDS, slots).tolist() == claimed_in_turn(SHARDS, slots)


def test_shards_are_even_and_changes_move_little():
    before = sharding.lookup_table(SHARDS)
    sizes = [(before == i).sum() for i in range(5)]
    assert max(sizes) - min(sizes) <= 1
    after = sharding.lookup_table(SHARDS[:4])
    moved = (before != after)[before != 4].mean()
    assert moved < 0.2


def test_wrong_parameters():
    for shards, slots in (([], 7), (["a", "a"], 7), (SHARDS, 8), (SHARDS, 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_rows_nulls_ties_and_clashing_columns(table):
    rows = [(1, "x"), (1, "x"), (None, None), (2, "")]
    docs = table(rows).withColumnRenamed("source", "shard")
    placed = sharding.assign(docs, SHARDS, ["doc_id"]).collect()
    assert len(placed) == 4 and all(row.shard in SHARDS for row in placed)
    assert len({(row.slot, row.shard) for row in placed if row.doc_id == 1}) == 1
    assert sharding.assign(table([]), SHARDS, ["doc_id"]).count() == 0


def test_a_hot_key_is_spread(table):
    docs = table([(i, "x", "en") for i in range(200)])
    plain = sharding.assign(docs, SHARDS, ["lang"]).select("slot").distinct().count()
    spread = sharding.assign(docs, SHARDS, ["lang"], spread=16, spread_by=["doc_id"]).select("slot").distinct()
    assert plain == 1 and spread.count() == 16


def test_query_places_every_document(spark):
    table = sharding.lookup_table(queries.SHARDS)
    rows = queries.QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert all(row.shard == queries.SHARDS[table[row.slot]] for row in rows)


def test_shards_are_written(spark, table, tmp_path):
    placed = sharding.assign(table([(i, "x") for i in range(50)]), SHARDS, ["doc_id"])
    sharding.write_shards(placed, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
