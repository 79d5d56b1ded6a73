"""Source, sink and corpus queries. Sinks write to a fresh shared folder and
return what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F0_SQL, F1_SQL, F2_SQL, F6_SQL, NOW_S, NOW_US, f0, f1, f2, f6, table, with_ctes
from ..operators import children as ch
from ..operators import report as rp
from ..operators import turns as tn
from ..operators import usage as us
from ..plans import scratch_path
from ..sources import logs as lg
from ..sources import paged as pg
from ..sources import parts as pt
from ..sources import snapshots as sn
from .records import TEL_SQL, telemetry
from .registry import query
from .turns import _summary_a
from .usage import _FAIL_SQL, USAGE_TOTALS_SQL


def transcript_lines(spark, d):
    """F1 as transcript JSON lines; ``log`` names the file's own session."""
    c = F.col
    text = lambda name, v: F.concat(F.lit(f'"{name}":"'), v.cast("string"), F.lit('"'))
    sid = c("session_id").cast("string")
    usage = F.to_json(
        F.struct(
            c("input").alias("input_tokens"),
            c("output").alias("output_tokens"),
            c("cache_read").alias("cache_read_input_tokens"),
            c("cache_write").alias("cache_creation_input_tokens"),
            F.when(c("compaction_iteration"), F.array(F.struct(F.lit("compaction").alias("type")))).alias("iterations"),
        )
    )
    message = F.concat(
        F.lit('"message":{'),
        F.concat_ws(
            ",",
            text("id", c("message_id")),
            text("model", F.when(c("synthetic"), "<synthetic>").otherwise(c("model"))),
            F.coalesce(text("stop_reason", c("stop")), F.lit('"stop_reason":null')),
            F.concat(F.lit('"usage":'), usage),
        ),
        F.lit("}"),
    )
    a = c("kind") == "assistant"
    tool = F.when(
        (c("kind") == "user") & (c("child_event") == "launch"),
        F.concat(F.lit('"toolUseResult":{"status":"async_launched","agentId":"'), c("child_key"), F.lit('"}')),
    ).when(
        (c("kind") == "user") & (c("child_event") == "resume"),
        F.concat(F.lit('"toolUseResult":{"success":true,"resumedAgentId":"'), c("child_key"), F.lit('"}')),
    )
    word = (
        F.when(c("child_event") == "errored", "failed")
        .when(c("child_event") == "interrupted", "killed")
        .when(c("child_event") == "unknown", "blocked")
        .otherwise(c("child_event"))
    )
    note = F.when(
        (c("kind") == "user") & c("child_event").isin("completed", "errored", "interrupted", "unknown"),
        F.concat(
            F.lit('"origin":{"kind":"task-notification"},"message":{"content":[{"type":"text","text":"<task-notification>\\n<task-id>'),
            c("child_key"), F.lit("</task-id><status>"), word, F.lit('</status></task-notification>"}]}'),
        ),
    )
    parts = [
        text("log", sid),
        text("type", c("kind")),
        F.when(c("mismatch"), F.lit('"sessionId":"elsewhere"')).when(a | ~c("bad"), text("sessionId", sid)),
        text("timestamp", F.date_format(F.timestamp_micros("stamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        text("uuid", c("uuid")),
        F.when(c("forked"), F.lit('"forkedFrom":{"messageUuid":"x"}')),
        text("subtype", c("subtype")),
        F.when(a & ~c("bad"), message),
        tool,
        note,
        text("operation", F.when(c("kind") == "queue-operation", c("operation"))),
        F.when(c("abort"), F.lit('"interruptedMessageId":"m"')),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return f1(spark, d).select("session_id", "ord", line.alias("value"))


def transcript(spark, d):
    path = scratch_path(spark, "segments")
    pt.write_log_parts(transcript_lines(spark, d), path)
    lines = pt.read_log_parts(spark, path, "$.log")
    records = pt.in_session_order(lg.transcript_records(lg.parse_transcript(lines)), path)
    # Text is parsed once; the operators read the written record table.
    table_path = scratch_path(spark, "records")
    records.withColumn("session_id", F.col("session_id").cast("long")).write.parquet(table_path)
    return spark.read.parquet(table_path)


@query("read_session_log", USAGE_TOTALS_SQL)
def _(spark, d):
    return us.usage_totals(transcript(spark, d))


_CH = "kind = 'user' AND child_event IS NOT NULL AND NOT bad AND NOT forked AND NOT mismatch"


@query(
    "transcript_records",
    with_ctes(
        F1_SQL,
        body=f"""SELECT session_id, kind, count(*) AS lines, count(*) FILTER (bad AND NOT mismatch) AS bad, count(*) FILTER (forked AND (NOT bad OR kind = 'assistant')) AS forked, count(*) FILTER (synthetic AND NOT bad) AS synthetic,
 count(*) FILTER (mismatch) AS mismatch, CAST(sum(output) FILTER (kind = 'assistant' AND NOT bad) AS BIGINT) AS output, count(*) FILTER ({_CH}) AS child_events, max(stamp) AS newest,
 count(*) FILTER (abort) AS aborts FROM f1 GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    r = transcript(spark, d)
    n = lambda c: F.count_if(c)
    c = F.col
    return r.groupBy("session_id", "kind").agg(
        F.count(F.lit(1)).alias("lines"),
        n(c("bad") & ~c("mismatch")).alias("bad"),
        n(c("forked") | (c("kind").isNull())).alias("forked"),
        n(c("synthetic")).alias("synthetic"),
        n(c("mismatch")).alias("mismatch"),
        F.sum(F.when(c("kind") == "assistant", c("output"))).alias("output"),
        n(c("child_event").isNotNull() & ~c("bad") & ~c("forked") & ~c("mismatch")).alias("child_events"),
        F.max("stamp").alias("newest"),
        n(c("role") == "abort").alias("aborts"),
    )


# --------------------------------------------------------------- rollout logs
_EARLY = "p = 6 AND k = 23 AND session_id % 11 = 0"  # an event of a child that has not started
_ODD = "p IN (4, 6) AND k = 19 AND session_id % 7 = 0"  # another thread, or a path elsewhere
_TORN = "p IN (4, 6) AND k = 3 AND session_id % 5 = 0"  # a line cut short
_CHILD_KIND = """CASE WHEN p = 4 THEN 'started' ELSE CASE ord % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'errored'
  WHEN 2 THEN 'interrupted' WHEN 3 THEN 'failed' ELSE 'interacted' END END"""


def rollout_lines(spark, d):
    """F1 as rollout JSON lines: turns, children, and meta lines for the rest."""
    e, text = F.expr, lambda x: F.col(x).cast("string")
    x = f1(spark, d).withColumn("sid", text("session_id"))
    path = e(f"concat(CASE WHEN {_ODD} AND p = 4 THEN '/else/' ELSE '/root/' END, CASE WHEN {_EARLY} THEN concat('late', ord) ELSE concat('ch', c % 4) END)")
    ms = e("stamp div 1000")
    turn = e("CASE WHEN k = 2 THEN NULL WHEN k = 7 THEN concat('t', c - 1) ELSE concat('t', c) END")
    start = e("trig div 1000000 + CASE WHEN p = 7 AND k % 10 = 9 THEN 1 WHEN p = 0 AND k = 31 THEN -4000 ELSE 0 END")
    payload = F.struct(
        e("""CASE p WHEN 0 THEN 'task_started' WHEN 4 THEN 'sub_agent_activity' WHEN 6 THEN 'item_completed'
          WHEN 7 THEN CASE WHEN event_type = 'error' THEN 'turn_aborted' ELSE 'task_complete' END ELSE 'note' END""").alias("type"),
        F.when(e("p IN (0, 7)"), turn).alias("turn_id"),
        F.when(e("p IN (0, 7)"), start).alias("started_at"),
        F.when(e("p = 7"), e("stamp div 1000000")).alias("completed_at"),
        F.when(e("p = 4"), path).alias("agent_path"),
        F.when(e("p = 4"), e(_CHILD_KIND)).alias("kind"),
        F.when(e("p = 4"), ms).alias("occurred_at_ms"),
        F.when(e("p = 6"), e(f"CASE WHEN {_ODD} THEN 'elsewhere' ELSE sid END")).alias("thread_id"),
        F.when(e("p = 6"), F.struct(F.lit("SubAgentActivity").alias("type"), path.alias("agent_path"), e(_CHILD_KIND).alias("kind"))).alias("item"),
        F.when(e("p = 6"), ms).alias("completed_at_ms"),
    )
    line = F.to_json(F.struct(F.col("sid").alias("log"), F.lit("event_msg").alias("type"), payload.alias("payload")))
    torn = F.concat(F.lit('{"log":"'), F.col("sid"), F.lit('","type":"event_msg'))
    return x.select("session_id", "ord", F.when(e(_TORN), torn).otherwise(line).alias("value"))


def rollout(spark, d):
    """The lines written as text and read back. A torn line keeps its log's name."""
    path = scratch_path(spark, "rollout")
    lg.write_log_segments(rollout_lines(spark, d), path)
    lines = lg.read_log_segments(spark, path, "$.log")
    named = F.coalesce("session_id", F.regexp_extract("value", '^\\{"log":"([^"]*)"', 1))
    return lines.withColumn("session_id", named)


_ROLLOUT_SQL = f"""ev AS (SELECT session_id, ord, {_TORN} OR {_ODD} AS lost, CASE WHEN {_EARLY} THEN 'late' || ord ELSE 'ch' || c % 4 END AS child, {_CHILD_KIND} AS what, stamp // 1000 * 1000 AS micros
  FROM f1 WHERE p IN (4, 6)),
pc AS (SELECT session_id, child, arg_max(what, ord) AS last, arg_min(what, ord) <> 'started' AS early, bool_or(what = 'started') AS launched FROM ev WHERE NOT lost GROUP BY 1, 2),
ps AS (SELECT session_id, count(*) FILTER (launched AND last IN ('started', 'interacted')) AS running, count(*) FILTER (launched AND last = 'completed') AS completed,
   count(*) FILTER (launched AND last = 'interrupted') AS interrupted, count(*) FILTER (launched AND last IN ('errored', 'failed')) AS errored, count(*) FILTER (launched) AS total, bool_or(early) AS early FROM pc GROUP BY 1),
v AS (SELECT f.session_id, NOT coalesce(bool_or(lost), false) AS fine, arg_max(micros, ev.ord) FILTER (NOT lost) AS seq FROM (SELECT DISTINCT session_id FROM f1) f LEFT JOIN ev ON ev.session_id = f.session_id GROUP BY 1),
j AS (SELECT v.session_id, fine AND NOT coalesce(early, false) AS valid, seq, ps.* EXCLUDE (session_id, early) FROM v LEFT JOIN ps ON ps.session_id = v.session_id)"""


@query(
    "rollout_children",
    with_ctes(
        F1_SQL,
        _ROLLOUT_SQL,
        body="""SELECT session_id, valid, CASE WHEN valid THEN coalesce(running, 0) END AS running, CASE WHEN valid THEN coalesce(completed, 0) END AS completed,
 CASE WHEN valid THEN coalesce(interrupted, 0) END AS interrupted, CASE WHEN valid THEN coalesce(errored, 0) END AS errored, CASE WHEN valid THEN 0 END AS unknown,
 CASE WHEN valid THEN coalesce(total, 0) END AS total, CASE WHEN valid THEN coalesce(completed, 0) END AS done, CASE WHEN valid THEN seq END AS child_seq FROM j""",
    ),
)
def _(spark, d):
    out = ch.rollout_outcomes(lg.rollout_children(rollout(spark, d), NOW_US))
    return out.withColumn("session_id", F.col("session_id").cast("long"))


@query("rollout_turns", _summary_a("true"))
def _(spark, d):
    """Keyed turns from rollout text. Torn lines hold child records only."""
    rec = lg.parse_rollout(rollout(spark, d)).filter("opens OR closes")
    rec = rec.withColumn("session_id", F.col("session_id").cast("long"))
    # Text is parsed once; the fold and its summaries read the written record table.
    path = scratch_path(spark, "rollout-records")
    rec.select("session_id", "ord", "opens", "key", "start", "end", "outcome").write.parquet(path)
    rec = spark.read.parquet(path)
    return tn.turn_summary_a(tn.turn_records_a(rec, NOW_S), extent=rec)


# ------------------------------------------------------------ whole-file rules
def _named_lines(spark, d):
    x = f1(spark, d)
    sid = F.col("session_id").cast("string")
    named = F.when(F.expr("session_id % 5 = 0 AND rn = 0"), F.lit("other")).otherwise(sid)
    return x.select(
        F.concat(F.lit("f"), sid, F.expr("CASE WHEN session_id % 6 = 0 AND rn >= 10 THEN '-b' ELSE '' END")).alias("file"),
        sid.alias("session_id"),
        "ord",
        F.to_json(F.struct(named.alias("sessionId"), F.when(F.expr("session_id % 7 = 0 AND rn = 0"), F.repeat(F.lit("x"), 70000)).alias("pad"))).alias("value"),
    )


FILES_SQL = """fl AS (SELECT 'f' || session_id || CASE WHEN session_id % 6 = 0 AND rn >= 10 THEN '-b' ELSE '' END AS file, session_id, count(*) AS lines, min(rn) AS first FROM f1 GROUP BY 1, 2)"""


@query("verify_header", with_ctes(F1_SQL, FILES_SQL, body="SELECT file, lines FROM fl WHERE NOT (session_id % 5 = 0 AND first = 0)"))
def _(spark, d):
    return lg.verify_header(_named_lines(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "header_limit",
    with_ctes(F1_SQL, FILES_SQL, body="SELECT file, lines FROM fl WHERE NOT ((session_id % 5 = 0 OR session_id % 7 = 0) AND first = 0)"),
)
def _(spark, d):
    kept = lg.verify_header(_named_lines(spark, d), limit=64 * 1024)
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "unique_binding",
    with_ctes(F1_SQL, body="SELECT CAST(session_id AS VARCHAR) AS session_id, 'f' || session_id AS file FROM f1 GROUP BY f1.session_id HAVING NOT (f1.session_id % 6 = 0 AND max(rn) >= 10)"),
)
def _(spark, d):
    return lg.unique_binding(_named_lines(spark, d).select("session_id", "file"))


PRED_SQL = """fr AS (SELECT session_id % 4 AS dir, session_id, ord, rn, stamp, CASE WHEN k % 25 = 7 AND session_id % 3 > 0 THEN session_id + 4 * (k % 3) END AS named, k = 3 AND session_id % 5 = 0 AS malformed FROM f1),
hd AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS r FROM fr WHERE malformed OR named IS NOT NULL),
fm AS (SELECT dir, session_id, max(stamp) AS m, count(*) AS n FROM fr GROUP BY 1, 2),
st AS (SELECT fm.dir, fm.session_id, fm.m, CASE WHEN hd.session_id IS NULL THEN 'ended' WHEN hd.malformed THEN 'unknown' ELSE 'named' END AS state,
  CASE WHEN NOT hd.malformed THEN hd.named END AS named FROM fm LEFT JOIN hd ON hd.session_id = fm.session_id AND hd.r = 1)"""


def _heads(spark, d):
    x = f1(spark, d).selectExpr(
        "session_id % 4 AS dir", "session_id", "ord", "stamp AS modified",
        "CASE WHEN k % 25 = 7 AND session_id % 3 > 0 THEN session_id + 4 * (k % 3) END AS named", "k = 3 AND session_id % 5 = 0 AS malformed",
    )
    return lg.file_heads(x)


@query("file_heads", with_ctes(F1_SQL, PRED_SQL, body="SELECT dir, session_id, m AS modified, state, named FROM st"))
def _(spark, d):
    return _heads(spark, d)


@query(
    "predecessor_check",
    with_ctes(
        F1_SQL,
        PRED_SQL,
        body="""SELECT dir, session_id, CASE WHEN EXISTS (SELECT 1 FROM st g WHERE g.dir = st.dir AND g.session_id <> st.session_id AND g.m >= st.m AND (g.state = 'unknown' OR g.named = st.session_id)) THEN 'unknown'
 WHEN EXISTS (SELECT 1 FROM st g WHERE g.dir = st.dir AND g.session_id <> st.session_id AND g.m >= st.m AND g.state = 'ended') THEN 'growing' ELSE 'clear' END AS verdict FROM st""",
    ),
)
def _(spark, d):
    return lg.predecessor_check(_heads(spark, d))


# ------------------------------------------------------------------ snapshots
def _snapshots(spark, d):
    """F2 written in pages under their hash tree."""
    path = scratch_path(spark, "snapshots")
    pg.write_paged(f2(spark, d).withColumnRenamed("sampled_at", "at"), path)
    return path


@query(
    "explode_snapshot",
    with_ctes(F2_SQL, body="""SELECT sampled_at::DOUBLE AS "at", CAST(host AS VARCHAR) AS host, CAST(agent AS VARCHAR) AS agent, status, project FROM f2"""),
)
def _(spark, d):
    rows = pg.explode_pages(pg.read_level(spark, _snapshots(spark, d), "pages"))
    text = lambda n: F.col(n).cast("string").alias(n)
    return rows.select(F.col("at").cast("double").alias("at"), text("host"), text("agent"), "status", "project")


@query(
    "write_snapshot",
    with_ctes(F2_SQL, body="""SELECT sampled_at AS "at", count(DISTINCT host) AS hosts, count(*) AS agents FROM f2 GROUP BY 1"""),
)
def _(spark, d):
    return pg.read_level(spark, _snapshots(spark, d), "fleets").select("at", "hosts", "agents")


@query(
    "snapshot_changes",
    with_ctes(
        F2_SQL,
        """c AS (SELECT sampled_at AS "at", host, agent, status, project, count(*) AS n FROM f2 GROUP BY ALL),
p AS (SELECT "at", lag("at") OVER (ORDER BY "at") AS prev FROM (SELECT DISTINCT "at" FROM c)),
x AS (SELECT p."at", host, agent, status, project, 0 AS n_before, n AS n_now FROM p JOIN c ON c."at" = p."at"
  UNION ALL SELECT p."at", host, agent, status, project, n, 0 FROM p JOIN c ON c."at" = p.prev)""",
        body="""SELECT "at", host, agent, status, project, CAST(sum(n_before) AS BIGINT) AS n_before, CAST(sum(n_now) AS BIGINT) AS n_now
 FROM x GROUP BY ALL HAVING sum(n_before) <> sum(n_now)""",
    ),
)
def _(spark, d):
    return pg.snapshot_changes(spark, _snapshots(spark, d))


# --------------------------------------------------------------------- packed
_PACKED = [n for names in sn.GROUPS for n in names]
_TUPLE = [n for names, _ in sn.TUPLES.values() for n in names]


@query(
    "decode_packed",
    with_ctes(
        TEL_SQL,
        """p AS (SELECT * FROM tel WHERE total_uncached_input >= 0 AND NOT ord % 10 = 9 AND NOT ord % 7 = 3)""",
        body="SELECT ord, seq, "
        + ", ".join(f'CASE WHEN ord % 7 = 1 THEN NULL ELSE "{n}" END AS "{n}"' for n in _PACKED)
        + ", "
        + ", ".join(f"CASE WHEN ord % 7 <> 1 AND subagent_starts <= 999 THEN {n} END AS {n}" for n in sn.TUPLES["children"][0])
        + ", "
        + ", ".join(f"CASE WHEN ord % 7 <> 1 THEN {n} END AS {n}" for k in ("completion", "outcomes") for n in sn.TUPLES[k][0])
        + " FROM p WHERE TRUE UNION ALL SELECT ord, seq, "
        + ", ".join("NULL" for _ in [*_PACKED, *_TUPLE])
        + " FROM tel WHERE total_uncached_input < 0 AND ord % 7 = 1 AND NOT ord % 10 = 9",
    ),
)
def _(spark, d):
    x = telemetry(spark, d).select("ord", "seq", *_PACKED, *_TUPLE)
    packed = sn.encode_packed(x).withColumns(
        {
            "obs_v": F.expr("CASE ord % 7 WHEN 1 THEN '1' WHEN 3 THEN '3' ELSE '2' END"),
            "obs_bind": F.expr("CASE WHEN ord % 10 = 9 THEN 'theirs' ELSE 'ours' END"),
            "ours": F.lit("ours"),
            **{f"obs_{n}": F.lit(None).cast("string") for n in _PACKED},
        }
    ).drop("seq", *_PACKED, *_TUPLE)
    return sn.decode_packed(packed, "ours", "ord")


@query(
    "encode_packed",
    with_ctes(
        TEL_SQL,
        body="""SELECT ord, coalesce(input::VARCHAR, '') || ',' || coalesce(output_tokens::VARCHAR, '') || ',' || coalesce(cache_read::VARCHAR, '') || ',' || coalesce(cache_write::VARCHAR, '') AS obs_n0,
 coalesce(compactions::VARCHAR, '') || ',' || coalesce(context_percent::VARCHAR, '') AS obs_n3, subagent_total || ',' || subagent_done || ',' || coalesce(subagent_status_seq::VARCHAR, '') AS obs_completion FROM tel""",
    ),
)
def _(spark, d):
    return sn.encode_packed(telemetry(spark, d)).select("ord", "obs_n0", "obs_n3", "obs_completion")


# ------------------------------------------------------------- adapter, legacy
@query(
    "read_adapter_events",
    with_ctes(TEL_SQL, body="""SELECT CAST(session_id AS VARCHAR) AS session_id, event, count(*) AS n, max(seq) AS newest FROM tel WHERE event IN ('turn', 'tool-start', 'idle') AND phase = 'working' GROUP BY 1, 2"""),
)
def _(spark, d):
    path = scratch_path(spark, "adapter")
    x = telemetry(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    x.select("session_id", "event", "phase", "seq", "model", "tool", "result", "context", "window").write.json(path)
    rows = sn.read_adapter_events(spark, path)
    return rows.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest"))


@query(
    "read_legacy_quota",
    """WITH x AS (SELECT o_orderkey % 6 AS n, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 140 END AS w FROM orders),
y AS (SELECT o_orderkey AS reply_id, unnest(range(n)) AS position, w FROM x)
SELECT reply_id, position, 'k' || position AS account_key, CASE WHEN w <= 100 THEN w END AS weekly_remaining, CAST(NULL AS BIGINT) AS reset_count FROM y""",
)
def _(spark, d):
    item = lambda i: F.struct(
        F.lit(f"k{i}").alias("account_key"),
        F.lit(1.5).alias("sampled_at"),
        F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 140 END").alias("weekly_remaining"),
        F.lit(True).alias("reset_count"),
        F.lit("private").alias("email"),
    )
    x = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("reply_id"),
        F.to_json(F.slice(F.array(*[item(i) for i in range(6)]), F.lit(1), (F.col("o_orderkey") % 6).cast("int"))).alias("value"),
    )
    return sn.read_legacy_quota(x).select("reply_id", "position", "account_key", "weekly_remaining", "reset_count")


@query(
    "read_inventory",
    with_ctes(F6_SQL, body="SELECT id, target, CASE WHEN num % 4 = 0 THEN 'default' ELSE session END AS session, CASE WHEN num % 6 = 0 THEN id ELSE label END AS label, enabled FROM f6"),
)
def _(spark, d):
    path = scratch_path(spark, "inventory")
    f6(spark, d).selectExpr(
        "id", "target", "CASE WHEN num % 4 > 0 THEN session END AS session", "CASE WHEN num % 6 > 0 THEN label END AS label", "enabled"
    ).write.json(path)
    return sn.read_inventory(spark, path)


@query(
    "read_account_map",
    """SELECT count(*) AS rows, count(*) FILTER (c_custkey % 100 = 7 OR NOT regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9 _.-]{0,39}')) AS rejected, false AS accepted FROM customer""",
)
def _(spark, d):
    path = scratch_path(spark, "accounts")
    table(spark, d, "customer").selectExpr(
        "sha2(c_name, 256) AS account_key", "concat('a', CAST(c_custkey AS STRING)) AS id", "c_name AS label",
        "CASE WHEN c_custkey % 100 = 7 THEN 'Other' ELSE 'Work' END AS category", "CAST(604800 AS BIGINT) AS window_seconds",
    ).write.json(path)
    return sn.account_map_checks(sn.read_account_map(spark, path))


# --------------------------------------------------------------------- corpus
def _corpus_sql() -> str:
    cov = ", ".join(f"NOT bool_or({e}) AS {m}" for m, e in _FAIL_SQL.items())
    known = " UNION ALL ".join(
        f"SELECT unnest(['known', 'known.{m}', 'known.{m}.' || CASE WHEN {m} THEN 'yes' ELSE 'no' END]) FROM cov" for m in _FAIL_SQL
    )
    return with_ctes(
        F1_SQL,
        f"cov AS (SELECT session_id, {cov} FROM f1 GROUP BY 1)",
        f"""ks AS (SELECT 'lines' AS key FROM f1 UNION ALL SELECT unnest(['kind', 'kind.' || kind]) FROM f1 UNION ALL SELECT unnest(['bad', 'bad.' || kind]) FROM f1 WHERE bad
 UNION ALL SELECT unnest(['dropped', 'dropped.forked']) FROM f1 WHERE forked UNION ALL SELECT unnest(['dropped', 'dropped.synthetic']) FROM f1 WHERE synthetic
 UNION ALL SELECT unnest(['identity', 'identity.mismatch']) FROM f1 WHERE mismatch UNION ALL SELECT unnest(['kind', 'kind.system', 'kind.system.' || subtype]) FROM f1 WHERE subtype IS NOT NULL
 UNION ALL SELECT 'sessions' FROM cov UNION ALL {known})""",
        body="SELECT key, count(*) AS value FROM ks GROUP BY 1",
    )


@query("corpus_counts", _corpus_sql())
def _(spark, d):
    return rp.corpus_counts(f1(spark, d))


@query("write_counts", _corpus_sql())
def _(spark, d):
    path = scratch_path(spark, "counts")
    sn.write_counts(rp.corpus_counts(f1(spark, d)), path)
    return sn.read_counts(spark, path)


@query(
    "publishable_sessions",
    with_ctes(
        F1_SQL,
        "b AS (SELECT DISTINCT session_id FROM f1)",
        "cu AS (SELECT session_id FROM f1 GROUP BY 1 HAVING max(stamp) >= 1706400000000000)",
        f"u AS (SELECT session_id, usage_seq AS q FROM ({USAGE_TOTALS_SQL}))",
        """j AS (SELECT cu.session_id IS NOT NULL AS up, q FROM b LEFT JOIN cu ON cu.session_id = b.session_id LEFT JOIN u ON u.session_id = b.session_id)""",
        body="SELECT CASE WHEN up THEN 'yes' ELSE 'no' END AS caught_up, CASE WHEN up AND q IS NOT NULL THEN 'yes' ELSE 'no' END AS publishable, count(*) AS sessions FROM j GROUP BY 1, 2",
    ),
)
def _(spark, d):
    x = f1(spark, d)
    usage = us.usage_totals(x)
    bound = x.select("session_id").distinct()
    up = x.groupBy("session_id").agg(F.max("stamp").alias("m")).filter("m >= 1706400000000000")
    return rp.publishable_sessions(bound, up, usage)


@query(
    "replay_agreement",
    "SELECT 'yes' AS agree, count(DISTINCT user_id) AS sessions FROM events",
)
def _(spark, d):
    x = f1(spark, d)
    return rp.replay_agreement(us.usage_totals(x), us.usage_totals(x, span=512))
