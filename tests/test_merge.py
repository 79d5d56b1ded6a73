"""Merging into a bucketed table: whole batches, each once, other buckets untouched."""

import random

import pytest

from sessionledger.plans import scratch_path
from sessionledger.streaming import merge as mg
from sessionledger.streaming import runs as ru

from .test_oracles import check
from .test_streams import few_partitions, landed_in, rows_of  # noqa: F401

SCHEMA = "account_key string, sampled_at long, seq long"


def made(spark, rule=None, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    return mg.MergeTable(spark, scratch_path(spark, "t"), schema, "account_key", rule or mg.newest("account_key", ["sampled_at"]), buckets)


def some(rng, n, keys=40):
    return [(rng.choice([None, *(f"k{i}" for i in range(keys))]), rng.randrange(20), i) for i in range(n)]


@pytest.mark.parametrize("upsert", [False, True])
def test_newest_of_all_batches(spark, upsert):
    rng = random.Random(1)
    table, best = made(spark, ru.upsert_latest if upsert else None), {}
    for batch_id in range(4):
        rows = some(rng, 60)
        table.merge(spark.createDataFrame(rows, SCHEMA), batch_id)
        for k in {r[0] for r in rows}:
            at, seq = max(((r[1], -r[2]) for r in rows if r[0] == k))
            if k not in best or at > best[k][0]:
                best[k] = (at, -seq)
    got = {r.account_key: (r.sampled_at, r.seq) for r in table.read().collect()}
    assert got == best and table.read().count() == len(best)
    table.vacuum()
    assert {r.account_key: (r.sampled_at, r.seq) for r in table.read().collect()} == best


def test_replay_changes_nothing(spark):
    table = made(spark)
    rows = some(random.Random(2), 50)
    table.merge(spark.createDataFrame(rows, SCHEMA), 0)
    table.merge(spark.createDataFrame([("k1", 99, 1)], SCHEMA), 1)
    before, held = rows_of(table.read()), table.manifest()
    table.merge(spark.createDataFrame([("k1", 100, 2), ("new", 1, 1)], SCHEMA), 1)
    table.merge(spark.createDataFrame(rows, SCHEMA), 0)
    assert rows_of(table.read()) == before and table.manifest() == held


def test_other_buckets_keep_their_files(spark):
    table = made(spark)
    table.merge(spark.createDataFrame([(f"k{i}", 1, i) for i in range(100)], SCHEMA), 0)
    files = lambda: {f for f in table.read().inputFiles()}
    before, first = files(), table.manifest()["buckets"]
    table.merge(spark.createDataFrame([("k5", 2, 1)], SCHEMA), 1)
    second = table.manifest()["buckets"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert len(before & files()) >= 7 and table.read().count() == 100
    table.merge(spark.createDataFrame([], SCHEMA), 2)
    assert table.manifest()["buckets"] == second and table.manifest()["batch"] == 2


def test_failed_merge_is_not_seen(spark):
    """A merge that dies before its manifest leaves the table as it was, and can be repeated."""
    table = made(spark)
    table.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), 0)
    put_up = table._put_up

    def dies(manifest):
        raise RuntimeError("lost")

    table._put_up = dies
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([("a", 2, 2)], SCHEMA), 1)
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA))
    table._put_up = put_up
    table.merge(spark.createDataFrame([("a", 2, 2)], SCHEMA), 1)
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([("a", 2, 2), ("b", 1, 1)], SCHEMA))


def test_two_writers_do_not_overwrite_each_other(spark):
    table = made(spark)
    other = mg.MergeTable(spark, table.path, table.schema, "account_key", table.rule, 8)
    held = table.manifest()
    table.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    other.manifest = lambda: held
    with pytest.raises(RuntimeError):
        other.merge(spark.createDataFrame([("b", 1, 1)], SCHEMA), 0)
    assert [r.account_key for r in table.read().collect()] == ["a"]
    table.vacuum()
    assert [r.account_key for r in table.read().collect()] == ["a"]


def test_stream_into_the_table(spark):
    rows = [(k, at, i) for i, (k, at, _) in enumerate(some(random.Random(4), 300))]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], f"session_id string, ord long, {SCHEMA}")
    table = made(spark)
    stream = landed_in(spark, df, 3).select("account_key", "sampled_at", "seq")
    got = mg.run_merged(stream, table, table.path + "-checkpoint", "append")
    assert table.manifest()["batch"] == 2
    assert {(r.account_key, r.sampled_at) for r in got.collect()} == {(k, max(r[1] for r in rows if r[0] == k)) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("name", ["upsert_latest", "stream_newest", "stream_activity"])
def test_registered(spark, duck, name):
    check(spark, duck, name)
