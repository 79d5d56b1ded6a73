"""Paged snapshots: bounded pages, digests, changes found from the top."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionledger.sources import paged as pg

SCHEMA = "at long, host string, agent long, status string, project string"


def plain_changes(rows):
    by = {at: Counter(r[1:] for r in rows if r[0] == at and r[2] is not None) for at in {r[0] for r in rows}}
    out, before = [], Counter()
    for at in sorted(by):
        out += [(at, *k, before[k], by[at][k]) for k in before.keys() | by[at].keys() if before[k] != by[at][k]]
        before = by[at]
    return sorted(out, key=repr)


def test_large_instant_in_bounded_pages(spark, tmp_path):
    """100,000 agents, a third of them on one host; then 30 of them change."""
    base = spark.range(100_000).selectExpr(
        "1L AS at", "IF(id % 3 = 0, 'hot', concat('h', id % 400)) AS host", "id AS agent", "'idle' AS status", "'p' AS project"
    )
    later = base.withColumn("at", F.lit(2)).withColumn("status", F.when((F.col("agent") % 3 == 0) & (F.col("agent") < 90), "busy").otherwise("idle"))
    path = str(tmp_path / "snap")
    pg.write_paged(base.union(later), path, page=500)
    pages = pg.read_level(spark, path, "pages")
    assert pages.agg(F.max(F.size("agents"))).first()[0] <= 500
    hot = pages.filter("at = 1 AND host = 'hot'")
    assert hot.agg(F.sum(F.size("agents"))).first()[0] == 33_334 and hot.count() > 66
    fleets = pg.read_level(spark, path, "fleets").orderBy("at").collect()
    assert [(f.hosts, f.agents) for f in fleets] == [(401, 100_000)] * 2 and fleets[0].hash != fleets[1].hash
    pairs = pg.instants(pg.read_level(spark, path, "fleets")).filter("prev IS NOT NULL")
    hosts, opened = pg.open_nodes(spark, path, pairs)
    assert {r.host for r in hosts.collect()} == {"hot"}
    assert opened.select("page").distinct().count() <= 30 and opened.count() <= 60
    got = pg.snapshot_changes(spark, path, pairs).collect()
    assert Counter((r.status, r.n_before, r.n_now) for r in got) == {("busy", 0, 1): 30, ("idle", 1, 0): 30}
    assert {r.agent for r in got} == set(range(0, 90, 3))


@pytest.mark.parametrize("page", [1, 3, 50])
def test_changes_equal_plain_comparison(spark, tmp_path, page):
    """NULL fields and hosts, repeated rows, hosts that come, go, grow and stand empty."""
    rng, rows = random.Random(page), []
    fleet = [(h, a, "idle", None) for h in ("a", "b", None) for a in range(20)]
    for at in range(0, 60, 10):
        rows += [(at, *r) for r in fleet] + [(at, "empty", None, None, None)]
        fleet = [(h, a, rng.choice([s, s, s, "busy", None]), p) for h, a, s, p in fleet if rng.random() > 0.1]
        fleet += [(rng.choice(["a", "c", None]), rng.randrange(200), "new", "p") for _ in range(rng.randrange(40))]
        fleet += rng.choices(fleet, k=5)
    rows += [(60, *r) for r in fleet] + [(70, *r) for r in fleet]
    path = str(tmp_path / "snap")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"page": F.lit("x"), "hash": F.lit(1)})
    pg.write_paged(df, path, page)
    got = [tuple(r) for r in pg.snapshot_changes(spark, path).collect()]
    assert sorted(got, key=repr) == plain_changes(rows)
    assert not any(r[0] == 70 for r in got)
    back = [tuple(r) for r in pg.explode_pages(pg.read_level(spark, path, "pages")).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
    assert pg.read_level(spark, path, "pages").agg(F.max(F.size("agents"))).first()[0] <= page


def test_repeats_and_nothing(spark, tmp_path):
    """One row ten thousand times is one entry; an empty table has no levels."""
    same = spark.range(10_000).selectExpr("1L AS at", "'h' AS host", "7L AS agent", "'idle' AS status", "'p' AS project")
    pg.write_paged(same, str(tmp_path / "a"))
    pages = pg.read_level(spark, str(tmp_path / "a"), "pages")
    assert [(x.agent, x.n) for x in pages.first().agents] == [(7, 10_000)] and pg.explode_pages(pages).count() == 10_000
    pg.write_paged(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert pg.snapshot_changes(spark, str(tmp_path / "b")).count() == 0
