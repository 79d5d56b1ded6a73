"""Streaming queries, each compared with the oracle of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F0_SQL, F1_SQL, F2_SQL, F3_SQL, F4_SQL, f0, f1, f2, f4, table, with_ctes
from ..operators import turns as tn
from ..operators.quota import newest_per_account
from ..plans import scratch_path
from ..streaming import folds as fo
from ..streaming import liveness as lv
from ..streaming import merge as mg
from ..streaming import ordered as od
from ..streaming import runs as ru
from .quota import SAN_SQL, sanitised
from .registry import query
from .sources import transcript_lines
from .turns import _B, TRIG_SQL, _summary_a, records_a
from .turns_oracle import summary_sql
from .usage import LAST_RESPONSE_SQL, USAGE_TOTALS_SQL, _outcomes_sql


SEGMENT_FILES = 4


def follow(spark, df, key="session_id", ord="ord"):
    """A stream over ``df`` as four segments; each micro-batch takes the files of about two."""
    path = ru.land_segments(df, key, ord, files=SEGMENT_FILES)
    return ru.stream_segments(spark, path, df.schema, files_per_trigger=2 * SEGMENT_FILES)


def fold(spark, df, machine, name, key="session_id"):
    keep = df.select(key, *machine.inputs)
    return ru.run_to_table(fo.stream_fold(follow(spark, keep, key), key, machine), name)


@query(
    "stream_usage",
    f"SELECT t.*, r.context, r.model FROM ({USAGE_TOTALS_SQL}) t JOIN ({LAST_RESPONSE_SQL}) r ON r.session_id IS NOT DISTINCT FROM t.session_id",
)
def _(spark, d):
    return fo.usage_view(fold(spark, f1(spark, d), fo.MACHINE_USAGE, "usage"))


def merge_table(spark, name, schema, key, rule):
    path = scratch_path(spark, name)
    return mg.MergeTable(spark, path, schema, key, rule), path + "-checkpoint"


@query("stream_children", _outcomes_sql("ok"))
def _(spark, d):
    return fo.children_view(fold(spark, f1(spark, d), fo.MACHINE_CHILDREN, "children"))


@query("stream_turns_a", _summary_a("true"))
def _(spark, d):
    return fo.turn_view_a(fold(spark, records_a(spark, d), fo.turn_machine_a(), "turns-a"))


def b_stream_records(spark, d):
    """Classified records with the fields the format B stream reads."""
    x = f1(spark, d).filter(~F.col("forked"))
    x = x.select("*", *[F.expr(e.format(div="div")).alias(n) for n, e in _B.items()])
    lost = F.expr(
        "CASE WHEN bad AND NOT synthetic AND kind IS NOT NULL THEN CASE WHEN kind = 'queue-operation' THEN 'queue' ELSE 'record' END END"
    )
    return x.withColumns(
        {
            "stamp": F.expr("CASE WHEN p = 6 AND k % 5 = 2 AND trig > 0 THEN trig ELSE stamp END"),
            "lost": lost,
            "foreign": F.col("mismatch"),
        }
    )


@query("stream_turns_b", summary_sql(TRIG_SQL, _B))
def _(spark, d):
    return tn.turn_summary_b(fold(spark, b_stream_records(spark, d), fo.MACHINE_B_STREAM, "turns-b"))


LAST_KNOWN_SQL = with_ctes(
    F4_SQL,
    """v AS (SELECT *, rejected OR cleared OR short AS drops, NOT missing AND NOT (rejected OR cleared OR short) AS keeps,
  generation IS DISTINCT FROM lag(generation) OVER (PARTITION BY agent ORDER BY ord) AS nw FROM f4),
ev AS (SELECT *, last_value(CASE WHEN keeps OR drops OR nw THEN ord END IGNORE NULLS)
   OVER (PARTITION BY agent ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eo FROM v),
j AS (SELECT ev.*, b.keeps AS bk, b.stamp AS bs, b.output AS bo FROM ev JOIN v b ON b.agent = ev.agent AND b.ord = ev.eo)""",
    body="""SELECT agent, ord, CASE WHEN keeps THEN stamp WHEN missing AND NOT drops AND bk THEN bs END AS usage_stamp,
 CASE WHEN keeps THEN output WHEN missing AND NOT drops AND bk THEN bo END AS output, missing AND NOT drops AND bk AS carried FROM j""",
)


@query("stream_last_known", LAST_KNOWN_SQL)
def _(spark, d):
    ev = fold(spark, f4(spark, d), fo.MACHINE_KNOWN, "known", key="agent").filter("event = 'sample'")
    return ev.select("agent", "ord", F.col("a").alias("usage_stamp"), F.col("b").alias("output"), (F.col("text") == "carried").alias("carried"))


@query(
    "stream_newest",
    with_ctes(
        F3_SQL,
        SAN_SQL,
        body="SELECT account_key, max(sampled_at) AS sampled_at FROM sn GROUP BY 1",
    ),
)
def _(spark, d):
    """The table is the only state: each micro-batch is reduced to its newest rows and merged."""
    x = sanitised(spark, d).select("account_key", F.col("seq").alias("ord"), "sampled_at", "seq")
    stream = follow(spark, x, key="account_key").select("account_key", "sampled_at", "seq")
    table, at = merge_table(spark, "newest", stream.schema, "account_key", mg.newest("account_key", ["sampled_at"]))
    return mg.run_merged(stream, table, at, "append").select("account_key", "sampled_at")


@query(
    "changed_snapshots",
    with_ctes(
        F4_SQL,
        """x AS (SELECT *, lag(ord) OVER w IS NULL OR lag(status) OVER w IS DISTINCT FROM status OR lag(k // 10) OVER w IS DISTINCT FROM k // 10 AS nw FROM f4 WINDOW w AS (PARTITION BY agent ORDER BY ord)),
y AS (SELECT *, sum(nw::INT) OVER (PARTITION BY agent ORDER BY ord) AS revision FROM x)""",
        body="SELECT agent, ord, CAST(revision AS BIGINT) AS revision, stamp FROM y WHERE nw",
    ),
)
def _(spark, d):
    x = f4(spark, d).selectExpr("agent", "ord", "concat(status, ':', CAST(k div 10 AS STRING)) AS content", "stamp")
    ev = fold(spark, x, fo.MACHINE_CHANGES, "changes", key="agent").filter("event = 'change'")
    return ev.select("agent", "ord", F.col("a").alias("revision"), F.col("b").alias("stamp"))


@query(
    "stream_session_log",
    f"""SELECT t.*, n.lines FROM ({USAGE_TOTALS_SQL}) t
  JOIN ({with_ctes(F1_SQL, body="SELECT session_id, count(*) AS lines FROM f1 GROUP BY 1")}) n ON n.session_id IS NOT DISTINCT FROM t.session_id""",
)
def _(spark, d):
    """Text is landed in three rounds; after each the stream goes on from its byte positions."""
    from ..sources.logs import write_log_segments
    from ..streaming import growing as gr

    text = transcript_lines(spark, d)
    low, high = text.agg(F.min("ord"), F.max("ord")).first()
    third = (high - low) // 3 + 1
    path, out = (scratch_path(spark, n) for n in ("text-segments", "text-usage"))
    for i in range(3):
        begin = low + i * third
        write_log_segments(text.filter(F.col("ord").between(begin, begin + third - 1)), f"{path}/{i}")
        lines = gr.segment_lines(gr.follow_logs(spark, path, suffix=".txt"), F.get_json_object("value", "$.log"))
        records = gr.record_stream(lines)
        events = ru.run_to_table(fo.stream_fold(records, "session_id", fo.MACHINE_USAGE), "text-usage", out)
    plain = ru.run_to_table(lines.select("session_id"), "text-lines")
    n = plain.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))
    usage = fo.usage_view(events).drop("context", "model")
    return usage.join(n, "session_id").withColumn("session_id", F.col("session_id").cast("long"))


# ------------------------------------------------------------ order and repeats
@query(
    "late_and_future",
    with_ctes(
        F0_SQL,
        "x AS (SELECT session_id, ord, CASE WHEN k % 10 = 0 THEN stamp - 86400000000 WHEN k % 10 = 1 THEN stamp + 40 * 86400000000 ELSE stamp END AS stamp FROM f0)",
        body="""SELECT session_id, ord, stamp <= 1706745600000000 AS accepted, max(CASE WHEN stamp <= 1706745600000000 THEN stamp END) OVER (PARTITION BY session_id ORDER BY ord) AS newest FROM x""",
    ),
)
def _(spark, d):
    x = f0(spark, d).withColumn(
        "stamp", F.expr("CASE WHEN k % 10 = 0 THEN stamp - 86400000000 WHEN k % 10 = 1 THEN stamp + 40 * 86400000000 ELSE stamp END")
    )
    return ru.late_and_future(x, F.lit(1706745600000000))


@query(
    "dedup_reports",
    with_ctes(
        F0_SQL,
        "x AS (SELECT session_id, ord, rn - k % 4 AS seq FROM f0)",
        "y AS (SELECT *, max(seq) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x)",
        body="SELECT session_id, ord, seq FROM y WHERE coalesce(seq > top, true)",
    ),
)
def _(spark, d):
    x = f0(spark, d).selectExpr("session_id", "ord", "rn - k % 4 AS seq")
    return ru.dedup_reports(x, "session_id", "ord", "seq").select("session_id", "ord", "seq")


@query(
    "dedup_stream",
    with_ctes(F0_SQL, body="SELECT session_id, rn // 3 AS report, min(stamp) <= max(stamp) AS kept FROM f0 GROUP BY 1, 2"),
)
def _(spark, d):
    x = f0(spark, d).select("session_id", "ord", F.expr("rn div 3").alias("report"), F.timestamp_micros("stamp").alias("ts"))
    s = ru.dedup_stream(follow(spark, x), ["session_id", "report"], "ts", "60 days")
    return ru.run_to_table(s, "dedup").select("session_id", "report", F.lit(True).alias("kept"))


@query(
    "upsert_latest",
    with_ctes(
        F3_SQL,
        SAN_SQL,
        """c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY sampled_at DESC, seq) AS r FROM sn WHERE seq % 3 > 0) WHERE r = 1),
u AS (SELECT account_key, sampled_at, seq, 0 AS src FROM c UNION ALL SELECT account_key, sampled_at, seq, 1 FROM sn WHERE seq % 3 = 0)""",
        body="SELECT account_key, sampled_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY sampled_at DESC, src, seq) AS r FROM u) WHERE r = 1",
    ),
)
def _(spark, d):
    """Two batches merged into a bucketed table; the second is given twice, which changes nothing."""
    s = sanitised(spark, d).select("account_key", "sampled_at", "seq")
    table, _ = merge_table(spark, "upsert", s.schema, "account_key", ru.upsert_latest)
    table.merge(newest_per_account(s.filter("seq % 3 > 0")), 0)
    for _ in range(2):
        table.merge(s.filter("seq % 3 = 0"), 1)
    return table.read()


DISORDER = 1000  # how far a row may come behind its place


def shuffled(df):
    """``df`` with the place at which a row arrives, up to ``DISORDER`` behind its own."""
    return df.withColumn("arrival", F.col("ord") + F.pmod(F.xxhash64("ord"), F.lit(DISORDER)))


@query(
    "stream_late_and_future",
    with_ctes(
        F0_SQL,
        "x AS (SELECT session_id, ord, k, CASE WHEN k % 10 = 0 THEN stamp - 86400000000 WHEN k % 10 = 1 THEN stamp + 40 * 86400000000 ELSE stamp END AS stamp FROM f0)",
        body="""SELECT session_id, ord, stamp <= 1706745600000000 AS accepted, max(CASE WHEN stamp <= 1706745600000000 THEN stamp END) OVER (PARTITION BY session_id ORDER BY ord) AS newest,
  CASE WHEN stamp > 1706745600000000 THEN 'future' END AS refused FROM x
UNION ALL SELECT session_id, ord, NULL, NULL, 'again' FROM x WHERE k % 10 = 2""",
    ),
)
def _(spark, d):
    """Rows come out of order and some of them twice; the refused ones are a side output."""
    x = f0(spark, d).withColumn(
        "stamp", F.expr("CASE WHEN k % 10 = 0 THEN stamp - 86400000000 WHEN k % 10 = 1 THEN stamp + 40 * 86400000000 ELSE stamp END")
    )
    rows = shuffled(x)
    again = rows.filter("k % 10 = 2").withColumn("arrival", F.col("arrival") + 5 * DISORDER)
    sent = rows.unionByName(again).select("session_id", "ord", "arrival", "stamp")
    stream = follow(spark, sent, ord="arrival")
    events = ru.run_to_table(od.ordered_stream(stream, "session_id", od.marks(1706745600000000), DISORDER), "marks")
    told = od.standing(events, "session_id").withColumn("refused", F.when(~F.col("accepted"), "future"))
    out = od.refused(events, "session_id").filter(F.col("refused").isin("late", "repeat"))
    none = F.lit(None)
    out = out.select("session_id", "ord", none.cast("boolean").alias("accepted"), none.cast("long").alias("newest"), F.lit("again").alias("refused"))
    return told.select(out.columns).unionByName(out)


@query(
    "stream_generation_reset",
    with_ctes(
        F4_SQL,
        body="""SELECT agent, generation, count(*) AS samples, CAST(sum(output) AS BIGINT) AS output, min(ord) AS first_ord FROM f4 GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    x = shuffled(f4(spark, d)).select("agent", "ord", "arrival", "generation", "output")
    stream = follow(spark, x, "agent", "arrival")
    return od.generation_totals(ru.run_to_table(od.ordered_stream(stream, "agent", od.GENERATIONS, DISORDER), "generations"), "agent")


# -------------------------------------------------------------------- windows
_ACT = "k AS tokens, p = 0 AS is_turn, abort AS is_abort"


def activity(spark, d):
    return f1(spark, d).selectExpr("session_id", "ord", "stamp", "timestamp_micros(stamp) AS ts", *_ACT.split(", "))


@query(
    "activity_windows",
    with_ctes(
        F1_SQL,
        body="SELECT stamp // 3600000000 * 3600000000 AS start_us, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (p = 0) AS turns, count(*) FILTER (abort) AS aborts FROM f1 GROUP BY 1",
    ),
)
def _(spark, d):
    return ru.activity_windows(activity(spark, d), "ts", "1 hour")


@query(
    "activity_sliding",
    with_ctes(
        F1_SQL,
        "x AS (SELECT *, unnest(range(4)) AS i FROM f1)",
        body="SELECT (stamp // 900000000 - i) * 900000000 AS start_us, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (p = 0) AS turns, count(*) FILTER (abort) AS aborts FROM x GROUP BY 1",
    ),
)
def _(spark, d):
    return ru.activity_windows(activity(spark, d), "ts", "1 hour", "15 minutes")


@query(
    "activity_sessions",
    with_ctes(
        F1_SQL,
        "x AS (SELECT *, coalesce(stamp - lag(stamp) OVER (PARTITION BY session_id ORDER BY ord) >= 36000000000, true) AS nw FROM f1)",
        "y AS (SELECT *, sum(nw::INT) OVER (PARTITION BY session_id ORDER BY ord) AS stretch FROM x)",
        body="SELECT session_id, CAST(stretch AS BIGINT) AS stretch, min(stamp) AS start_us, max(stamp) AS end_us, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (p = 0) AS turns, count(*) FILTER (abort) AS aborts FROM y GROUP BY 1, 2",
    ),
)
def _(spark, d):
    return ru.activity_sessions(activity(spark, d), "stamp", 36_000_000_000, "session_id")


@query(
    "stream_activity",
    with_ctes(
        F1_SQL,
        body="SELECT stamp // 3600000000 * 3600000000 AS start_us, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (p = 0) AS turns, count(*) FILTER (abort) AS aborts FROM f1 GROUP BY 1",
    ),
)
def _(spark, d):
    """Every window, open ones too: what a micro-batch updates replaces the table's row."""
    s = follow(spark, activity(spark, d)).withWatermark("ts", "2 days")
    windows = ru.activity_windows(s, "ts", "1 hour")
    table, at = merge_table(spark, "activity", windows.schema, "start_us", mg.replaced("start_us"))
    return mg.run_merged(windows, table, at)


@query(
    "host_liveness",
    with_ctes(
        F2_SQL,
        """dd AS (SELECT host, sampled_at, count(*) AS n FROM f2 GROUP BY 1, 2),
x AS (SELECT *, coalesce(sampled_at - lag(sampled_at) OVER (PARTITION BY host ORDER BY sampled_at) > 345600, true) AS nw FROM dd),
y AS (SELECT *, sum(nw::INT) OVER (PARTITION BY host ORDER BY sampled_at) AS s FROM x),
z AS (SELECT host, min(sampled_at) AS live_from, max(sampled_at) + 345600 AS unreachable_at, CAST(sum(n) AS BIGINT) AS samples FROM y GROUP BY host, s)""",
        body="SELECT *, unreachable_at > (SELECT max(sampled_at) - 30 * 86400 FROM f2) AS open FROM z",
    ),
)
def _(spark, d):
    """All stretches: those that the watermark, 30 days behind, has passed are closed, the rest open."""
    x = f2(spark, d).select("host", "ord", F.timestamp_seconds("sampled_at").alias("ts"))
    gap = 4 * 86400
    return lv.live_now(ru.run_to_table(lv.host_liveness(follow(spark, x, "host"), gap, "30 days"), "liveness"), gap)
