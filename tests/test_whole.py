"""Nothing is lost to a NULL key, to a large group or to its distance."""

import json

import pytest
from pyspark.sql import functions as F

from sessionledger.operators import quota as q
from sessionledger.operators import turns as tn
from sessionledger.operators import usage as us
from sessionledger.plans import Run, chunked_fold, running
from sessionledger.sources import logs as lg
from sessionledger.sources import snapshots as sn
from sessionledger.streaming import folds as fo
from sessionledger.streaming import runs as ru

from .test_rules import NOW, reply

WHOLE = 1 << 40


@pytest.mark.parametrize("span", [10, 1000])
def test_running_carries_null_keys(spark, span):
    df = spark.range(100).selectExpr("IF(id % 2 = 0, NULL, 1) AS key", "id AS ord", "IF(id % 7 = 0, NULL, id) AS v")
    outs = {
        "n": Run("sum", F.lit(1)),
        "top": Run("max", F.col("v"), before=True),
        "last": Run("last", F.col("v"), before=True),
        "first": Run("first", F.col("v")),
        "next": Run("next", F.col("v")),
    }
    got = {(r.key, r.ord): r for r in running(df, ["key"], "ord", outs, span).collect()}
    assert len(got) == 100
    for key, parity in ((None, 0), (1, 1)):
        values = [(i, None if i % 7 == 0 else i) for i in range(parity, 100, 2)]
        for at, (i, _) in enumerate(values):
            before = [v for _, v in values[:at] if v is not None]
            upto = [v for _, v in values[: at + 1] if v is not None]
            after = [v for _, v in values[at + 1 :] if v is not None]
            r = got[key, i]
            assert (r.n, r.top, r.last) == (at + 1, max(before, default=None), before[-1] if before else None)
            assert (r["first"], r["next"]) == (upto[0] if upto else None, after[0] if after else None)


def test_running_of_no_rows(spark):
    df = spark.createDataFrame([], "key string, ord long")
    assert running(df, ["key"], "ord", {"n": Run("sum", F.lit(1))}, 10).collect() == []


def usage_rows(spark, ids, session=None):
    rows = [(session, i, "assistant", i + 1, m, 1, 2, 3, 4, "end", "m", False, False, False, False) for i, m in enumerate(ids)]
    schema = (
        "session_id string, ord long, kind string, stamp long, message_id string, input long, output long, "
        "cache_read long, cache_write long, stop string, model string, bad boolean, forked boolean, synthetic boolean, mismatch boolean"
    )
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("span", [7, 1000])
@pytest.mark.parametrize("session", [None, "s"])
def test_reopened_after_a_hundred_groups(spark, span, session):
    ids = ["a", "a", *[f"m{i}" for i in range(100)], "a", "z"]
    df = usage_rows(spark, ids, session)
    r = us.dedup_stats(df, span=span).first()
    assert (r.assistant_lines, r.merged_lines, r.groups, r.reopened_groups) == (104, 1, 103, 1)
    assert us.dedup_stats(df, ring=32, span=span).first().reopened_groups == 0
    assert us.dedup_stats(df, ring=200, span=span).first().reopened_groups == 1


@pytest.mark.parametrize("again", ["m0", "z"])
def test_stream_remembers_closed_messages(spark, again):
    """A message that reopens a hundred groups later, in another micro-batch."""
    df = usage_rows(spark, [*[f"m{i}" for i in range(100)], again, "end"], "s")
    df = df.unionByName(usage_rows(spark, ["a", "b"], "t"))
    path = ru.land_segments(df, "session_id", "ord")
    stream = lambda: ru.stream_segments(spark, path, df.schema, files_per_trigger=1)
    total = ["session_id", "total_input", "total_cache_read", "total_cache_write", "total_uncached_input", "total_output", "usage_seq"]
    events = ru.run_to_table(fo.stream_fold(stream(), "session_id", fo.MACHINE_USAGE), "whole-usage")
    want = us.usage_totals(df).select(total).sort("session_id").collect()
    assert fo.usage_view(events).select(total).sort("session_id").collect() == want
    assert (want[0].total_output is None) == (again == "m0")
    assert not any('"m50"' in e.text for e in events.filter("event = 'state'").collect())
    ringed = ru.run_to_table(fo.stream_fold(stream(), "session_id", fo.usage_machine(ring=32)), "ring-usage")
    assert fo.usage_view(ringed).filter("session_id = 's'").first().total_output == 2 * 102


@pytest.mark.parametrize("span", [10, WHOLE])
def test_fold_carries_null_keys(spark, span):
    rows = [(None if k % 2 else 5, 2 * k + e, e == 0, f"t{k}", 10 * k + 10, 10 * k + 15, "completed") for k in range(40) for e in (0, 1)]
    schema = "session_id long, ord long, opens boolean, key string, start long, `end` long, outcome string"
    records = tn.turn_records_a(spark.createDataFrame(rows, schema), 10**6, span)
    events = chunked_fold(records, ["session_id"], tn.MACHINE_A, span).collect()
    for session in (None, 5):
        mine = [e for e in events if e.session_id == session]
        assert sum(e.event == "last" for e in mine) == 20
        assert not any(e.event == "lost" for e in mine)


def test_large_snapshot(spark):
    agents = spark.range(20 * 5000).selectExpr("1L AS at", "concat('h', id % 20) AS host", "id AS agent", "'idle' AS status", "'p' AS project")
    doc = sn.nest_snapshot(agents).first()
    assert [len(h.agents) for h in doc.hosts] == [5000] * 20
    assert all(h.online for h in doc.hosts)
    assert sn.nest_snapshot(agents, max_hosts=16).count() == 0
    assert not any(h.online for h in sn.nest_snapshot(agents, limit=4096).first().hosts)


def test_long_header_and_late_name(spark):
    head = json.dumps({"sessionId": "s1", "pad": "x" * 100_000})
    lines = spark.createDataFrame([("f", "s1", 0, head), ("f", "s1", 1, "{}")], "file string, session_id string, ord long, value string")
    assert lg.verify_header(lines).count() == 2
    assert lg.verify_header(lines, limit=64 * 1024).count() == 0
    records = spark.range(1000).selectExpr("1 AS dir", "1L AS session_id", "id AS ord", "id AS modified", "IF(id = 900, 7L, NULL) AS named", "false AS malformed")
    assert lg.file_heads(records).first().named == 7
    assert lg.file_heads(records, bound=512).first().state == "unknown"


def test_adapter_reads_the_whole_log(spark):
    rows = spark.range(500).selectExpr(
        "'s' AS session_id", "id AS ord", "IF(id = 3, 'assistant', 'label') AS c_type", "id AS stamp", "1L AS input",
        "2L AS output", "3L AS cache_read", "4L AS cache_write", "true AS has_usage",
    )
    live = spark.createDataFrame([], "session_id string, live_seq long, live_input long, live_output long")
    assert us.adapter_latest_usage(rows, live, 10**6).first().usage_seq == 3
    assert us.adapter_latest_usage(rows, live, 10**6, depth=128).first().usage_seq is None


def test_many_credits(spark):
    one = ",".join(f'{{"id":"c{i}","status":"available","resetType":"{q.PASS_TYPE}","expiresAt":{2_000_000_000 + i}}}' for i in range(1500))
    text = f'{{"rateLimitResetCredits":{{"availableCount":1500,"credits":[{one}]}}}}'
    assert q.credits_summary(reply(spark, text), NOW).first().reset_expires_at == 2_000_000_000
