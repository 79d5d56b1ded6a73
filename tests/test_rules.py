"""Rules on hand-made cases."""

from pyspark.sql import functions as F

from sessionledger.functions import guards as g
from sessionledger.functions import labels as lb
from sessionledger.functions import scalars as sc
from sessionledger.operators import quota as q
from sessionledger.operators import samples as sm
from sessionledger.operators import telemetry as tm

NOW = 1_700_000_000


def one(spark, schema, values, *cols):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*cols).collect()]


def test_strict_counters(spark):
    texts = [("0",), ("12",), ("9007199254740991",), ("9007199254740992",), ("01",), ("-1",), ("1.0",), ("true",), ("1e3",), (" 1",), ("1\n",), (None,)]
    got = one(spark, "t string", texts, g.safe_counter(F.col("t")))
    assert [r[0] for r in got] == [0, 12, 9007199254740991] + [None] * 9


def test_stamps(spark):
    texts = [
        ("1970-01-01T00:00:01Z",), ("2024-02-29T12:00:00.1234567+01:00",), ("2023-02-29T12:00:00Z",),
        ("2024-01-01T00:00:00",), ("2024-01-01T24:00:00Z",), ("1969-12-31T23:59:59Z",), ("2024-01-01T00:00:00.Z",),
    ]
    got = [r[0] for r in one(spark, "t string", texts, g.rfc3339_us(F.col("t")))]
    assert got == [1_000_000, 1_709_204_400_123_456, None, None, None, None, None]


def test_models_and_addresses(spark):
    good = [("a",), ("vendor/model-1.2:x",), ("a/b/c",), ("a..b",), ("-a",), ("a:/b",), ("a\n",)]
    assert [r[0] for r in one(spark, "t string", good, g.safe_model(F.col("t")))] == ["a", "vendor/model-1.2:x"] + [None] * 5
    mails = [("a@b.c",), ("a@b",), ("a@@b.c",), ("a b@c.d",), ("<a@b.c>",), ("@b.c",), ("a@b.",)]
    assert [r[0] for r in one(spark, "t string", mails, g.valid_email(F.col("t")))] == ["a@b.c"] + [None] * 6


def test_pace_bands(spark):
    rows = [(float(left - 70),) for left in (70, 66, 65, 64, 60)]
    got = one(spark, "d double", rows, sc.pace_band(sc.pace_reading(F.col("d"))))
    assert [r[0] for r in got] == ["surplus", "caution", "caution", "warning", "deficit"]
    # 30-day window, a quarter used, half the time left
    month = 30 * 86400
    x = [("k", "available", 25, NOW + month // 2, month, NOW, None, None)]
    df = spark.createDataFrame(
        x, "account_key string, status string, used_percent long, resets_at long, duration_s long, sampled_at long, reset_count long, reset_expires_at long"
    )
    r = q.account_view(df, NOW).first()
    assert (r["remaining"], r["time_remaining"], r["pace"], r["band"]) == (75, 50.0, 25.0, "surplus")


def reply(spark, text):
    df = spark.createDataFrame([(1, text)], "seq long, reply string")
    return df.select("seq", q.parse_reply(F.col("reply")).alias("r"))


def test_quota_replies(spark):
    def read(bucket, named=False):
        inner = f'"rateLimitsByLimitId":{{"codex":{bucket}}}' if named else f'"rateLimits":{bucket}'
        return q.read_quota(reply(spark, f'{{"accountId":"a",{inner}}}'), NOW).collect()

    week = lambda used, reset=NOW + 10: f'{{"windowDurationMins":10080,"usedPercent":{used},"resetsAt":{reset}}}'
    day = '{"windowDurationMins":1440,"usedPercent":1,"resetsAt":9999999999}'
    assert read(f'{{"limitId":"codex","planType":"pro","primary":{week(30)}}}')[0]["weekly_remaining"] == 70
    assert read(f'{{"primary":{day},"secondary":{week(0)}}}', True)[0]["weekly_remaining"] == 100
    for odd in ("true", "1.5", '101', "-1"):
        assert read(f'{{"primary":{week(odd)}}}')[0]["weekly_remaining"] is None
    assert read(f'{{"primary":{week(1)},"secondary":{week(2)}}}')[0]["weekly_remaining"] is None
    assert read(f'{{"primary":{week(1, NOW)}}}')[0]["weekly_resets_at"] is None
    assert read(f'{{"limitId":"other","primary":{week(1)}}}') == []


def test_passes(spark):
    def passes(count, rows):
        r = q.credits_summary(reply(spark, f'{{"rateLimitResetCredits":{{"availableCount":{count},"credits":[{rows}]}}}}'), NOW).first()
        return r["reset_count"], r["reset_expires_at"]

    one_pass = lambda i, at, status="available": f'{{"id":"{i}","status":"{status}","resetType":"codexRateLimits","expiresAt":{at}}}'
    a, b = one_pass("a", NOW + 5), one_pass("b", NOW + 3)
    assert passes(2, f"{a},{b}") == (2, NOW + 3)
    assert passes(3, f"{a},{b}") == (3, None)
    assert passes(2, f"{a},{a}") == (2, None)
    assert passes(2, f"{a},{one_pass('b', NOW)}") == (None, None)
    assert passes(1, f"{a},{one_pass('b', NOW + 1, 'used')}") == (1, NOW + 5)
    assert passes(1, one_pass("a", "null")) == (1, None)


def test_sanitise_keeps_fields_apart(spark):
    schema = (
        "account_key string, sampled_at double, plan string, weekly_remaining long, weekly_resets_at long, "
        "reset_count long, reset_expires_at long, lifetime_tokens long, peak_daily_tokens long"
    )
    rows = [
        ("past reset", NOW - 1.0, "pro", 5, NOW, 2, NOW + 9, 1, 1),
        ("past pass", NOW - 1.0, "gold", 5, NOW + 9, 2, NOW, 1, 1),
        ("old", NOW - 601.0, "pro", 5, NOW + 9, 2, None, 1, 1),
        ("ahead", NOW + 1.0, "pro", 5, NOW + 9, 2, None, 1, 1),
        ("future", NOW + 1.5, "pro", 5, NOW + 9, 2, None, 1, 1),
    ]
    got = {r["account_key"]: r for r in q.quota_sanitise(spark.createDataFrame(rows, schema), NOW).collect()}
    assert set(got) == {"past reset", "past pass", "ahead"}
    r = got["past reset"]
    assert (r["weekly_remaining"], r["weekly_resets_at"], r["reset_count"]) == (None, None, 2)
    r = got["past pass"]
    assert (r["plan"], r["weekly_remaining"], r["reset_count"], r["reset_expires_at"]) == (None, 5, None, None)


def test_labels(spark):
    got = one(spark, "n long", [(0,), (999,), (1_000,), (1_250,), (2_000_000,), (None,)], lb.tokens_label(F.col("n")))
    assert [r[0] for r in got] == ["0", "999", "1K", "1.3K", "2M", "—"]
    got = one(spark, "n long", [(5,), (65,), (3_661,)], lb.duration_label(F.col("n")), lb.age_label(F.col("n")))
    assert got == [("5s", "5s ago"), ("1m 05s", "1m ago"), ("1h 01m", "1h ago")]
    got = one(spark, "n double", [(0.4,), (99.5,), (100.0,), (49.5,)], lb.percent_label(F.col("n")))
    assert [r[0] for r in got] == ["<1%", ">99%", "100%", "50%"]


def test_last_known_does_not_survive_a_generation(spark):
    schema = "agent long, ord long, stamp long, generation long, missing boolean, rejected boolean, cleared boolean, short boolean, output long"
    on, off = False, True
    rows = [
        (1, 1, 10, 1, on, False, False, False, 7),
        (1, 2, 20, 1, off, False, False, False, None),
        (1, 3, 30, 2, off, False, False, False, None),
        (1, 4, 40, 1, off, False, False, False, None),
        (1, 5, 50, 1, on, False, False, False, 0),
        (1, 6, 60, 1, off, True, False, False, None),
        (1, 7, 70, 1, off, False, False, False, None),
    ]
    for span in (100, 1):
        got = sm.last_known(spark.createDataFrame(rows, schema), ["output"], span).orderBy("ord").collect()
        assert [r["output"] for r in got] == [7, 7, None, None, 0, None, None]
        assert [r["carried"] for r in got] == [False, True, False, False, False, False, False]


def test_counts_have_no_default_limit(spark):
    done = dict(subagent_total=5_000, subagent_done=5_000, subagent_status_seq=3, seq=9, subagent_running=0, subagent_completed=5_000)
    rest = dict(subagent_interrupted=0, subagent_failed=0, subagent_unknown=0, subagent_starts=5_000, subagent_stops=2, subagent_seq=1)
    row = {**done, **rest}
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))
    assert tm.hook_counters_valid(tm.outcome_partition(rows)).first().asDict() == row
    capped = tm.hook_counters_valid(tm.outcome_partition(rows, 128), 999).first()
    assert capped.subagent_total is None and capped.subagent_completed is None and capped.subagent_starts is None
    flag = "transform(sequence(1, 20), i -> struct('weekly' AS kind, 'L' AS label, 60L AS duration_s, i = 17 AS pacing, i AS n))"
    ws = spark.range(1).select(F.expr(flag).alias("ws"))
    assert ws.select(sc.pacing_window("ws").n, sc.pacing_window("ws", 8).n).first()[:] == (17, None)
