"""Logs written in place: order by manifest, overlaps, hot and nameless sessions."""

import pytest
from pyspark.sql import functions as F

from sessionledger.sources import parts as pt

SCHEMA = "session_id string, ord long, value string"


def landed(spark, rows, folder, parts):
    """One file a partition, in the order given."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        mine = rows[i * size : (i + 1) * size]
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def line(sid, i):
    name = "" if sid is None else f'"log":"{sid}",'
    return (sid, i, f'{{{name}"n":{i}}}')


def orders(spark, path):
    lines = pt.read_log_parts(spark, path, "$.log")
    records = lines.select("session_id", "ord", F.get_json_object("value", "$.n").cast("long").alias("n"))
    got = pt.in_session_order(records, path).collect()
    return {s: [r.n for r in sorted((r for r in got if r.session_id == s), key=lambda r: r.ord)] for s in {r.session_id for r in got}}


@pytest.fixture
def one_file_a_task(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hot_session_over_parts_out_of_order(spark, tmp_path, one_file_a_task):
    """A session of a third of all lines lies in chunks, written last to first."""
    chunks = [[line("hot", i) for i in range(b, b + 20)] for b in range(0, 120, 20)]
    rows = [r for k, c in enumerate(reversed(chunks)) for r in [*c, *(line(f"s{k}", 1000 + i) for i in range(35)), *(line(None, 500 - 5 * k + i) for i in range(5))]]
    lines = landed(spark, rows, str(tmp_path / "in"), 6)
    out = str(tmp_path / "out")
    assert pt.write_log_parts(lines, out) is True
    runs = spark.read.parquet(f"{out}/runs").filter("session_id = 'hot'").orderBy("place").collect()
    assert [(r.lines, r.before) for r in runs] == [(20, 20 * i) for i in range(6)]
    assert len({r.part for r in runs}) == 6
    got = orders(spark, out)
    assert got["hot"] == list(range(120))
    assert got[None] == sorted(r[1] for r in rows if r[0] is None)
    assert all(got[f"s{k}"] == list(range(1000, 1035)) for k in range(6))


def test_overlapping_parts_are_dealt_by_range(spark, tmp_path, one_file_a_task):
    rows = [line(f"s{i % 3}", i) for i in sorted(range(300), key=lambda i: (i * 7) % 300)]
    lines = landed(spark, rows, str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    assert pt.write_log_parts(lines, out) is False
    assert orders(spark, out) == {f"s{k}": list(range(k, 300, 3)) for k in range(3)}


def test_shuffled_and_empty_lines(spark, tmp_path):
    lines = spark.createDataFrame([line("a", i) for i in range(50)], SCHEMA).repartition(5)
    assert pt.write_log_parts(lines, str(tmp_path / "a")) is False
    assert orders(spark, str(tmp_path / "a")) == {"a": list(range(50))}
    assert pt.write_log_parts(spark.createDataFrame([], SCHEMA), str(tmp_path / "b")) is True
    assert orders(spark, str(tmp_path / "b")) == {}


def test_writing_in_place_shuffles_no_text(spark, tmp_path):
    lines = landed(spark, [line(f"s{i // 10}", i) for i in range(100)], str(tmp_path / "in"), 2)
    plan = pt.session_runs(lines)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1]
    assert pt.in_place(lines.sortWithinPartitions("session_id", "ord").select("value"))
