"""Record classification and telemetry rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F0_SQL, F1_SQL, NOW_S, NOW_US, f0, f1, table, with_ctes
from ..operators import classify as cl
from ..operators import telemetry as tm
from .registry import query

# ------------------------------------------------------------------ telemetry
_T = {
    "seq": "stamp",
    "event": "CASE k % 4 WHEN 0 THEN 'turn' WHEN 1 THEN 'tool-start' WHEN 2 THEN 'idle' ELSE event_type END",
    "phase": "CASE WHEN k % 10 = 0 THEN event_type ELSE 'working' END",
    "tool": "CASE WHEN k % 2 = 0 THEN 'mcp-x' ELSE event_type END",
    "model": "concat('model/', event_type)",
    "result": "CASE WHEN k % 3 = 0 THEN 'error' ELSE event_type END",
    "input": "CAST(floor(value) AS BIGINT)",
    "output_tokens": "k",
    "cache_read": "CAST(floor(value / 2) AS BIGINT)",
    "cache_write": "k % 5",
    "context": "CAST(floor(value) AS BIGINT)",
    "window": "CASE WHEN k % 6 > 0 THEN (k % 6) * 90 - 90 END",
    "usage_seq": "CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN stamp + 86400000000 * 20 ELSE stamp - k END",
    "total_input": "CAST(floor(value * 2) AS BIGINT)",
    "total_output": "k * 10",
    "total_cache_read": "k * 8",
    "total_cache_write": "k",
    "total_uncached_input": "CAST(floor(value * 2) AS BIGINT) - k * 8",
    "compactions": "k % 3",
    "context_percent": "k * 2",
    "subagent_starts": "CASE WHEN k % 11 = 0 THEN 1000 ELSE k % 4 END",
    "subagent_stops": "k % 3",
    "subagent_seq": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN stamp + 1 ELSE stamp - 1 END",
    "subagent_total": "CASE WHEN k % 13 = 0 THEN 129 ELSE k % 4 + k % 3 + k % 2 + 2 END",
    "subagent_done": "k % 4",
    "subagent_status_seq": "CASE WHEN k % 9 = 0 THEN 0 ELSE stamp - 5 END",
    "subagent_running": "k % 3",
    "subagent_completed": "k % 4",
    "subagent_interrupted": "CASE WHEN k % 7 = 0 THEN 5 ELSE k % 2 END",
    "subagent_failed": "CAST(1 AS BIGINT)",
    "subagent_unknown": "CAST(1 AS BIGINT)",
    "usage_source": "CASE WHEN k % 8 = 0 AND k % 3 = 0 THEN NULL WHEN k % 8 = 2 THEN event_type ELSE 'pi-extension' END",
    "secret": "event_type",
}
TEL_SQL = F0_SQL + ",\ntel AS (SELECT session_id, ord, " + ", ".join(f'{e} AS "{n}"' for n, e in _T.items()) + " FROM f0)"


def telemetry(spark, d):
    return f0(spark, d).select("session_id", "ord", *[F.expr(e).alias(n) for n, e in _T.items()])


def _blank(cond: str, names, src: str, extra: str = "") -> str:
    rep = ", ".join(f'CASE WHEN NOT coalesce({cond}, false) THEN "{n}" END AS "{n}"' for n in names)
    return f"SELECT * REPLACE ({rep}) FROM {src}{extra}"


_COH = [
    f"""u1 AS ({_blank(f'(usage_seq IS NOT NULL OR usage_source IS NOT NULL) AND coalesce(usage_seq > {NOW_US - 15 * 86400000000}, true)', [*tm.NUMBERS, 'usage_source'], '{src}')})""",
    f"u2 AS ({_blank('context_percent > 100', ['context_percent'], 'u1')})",
    f"u3 AS ({_blank('total_cache_read > total_input', ['total_input', 'total_cache_read', 'total_uncached_input'], 'u2')})",
    f"""u4 AS ({_blank('"window" = 0 OR coalesce(context > "window", false)', ['context', 'window', 'context_percent'], 'u3')})""",
]


def coh(src: str) -> list[str]:
    return [c.replace("{src}", src) for c in _COH]


_HOOK = "NOT coalesce(subagent_starts IS NOT NULL AND subagent_stops IS NOT NULL AND coalesce(subagent_seq <= seq, true) AND (subagent_starts = 0 AND subagent_stops = 0 OR subagent_seq IS NOT NULL), false)"
_DONE = "coalesce(subagent_done <= subagent_total AND subagent_status_seq > 0 AND subagent_status_seq <= seq, false)"
_WHOLE = "subagent_running + subagent_completed + subagent_interrupted + subagent_failed + subagent_unknown = subagent_total AND subagent_completed = subagent_done"
_CHILD = ["subagent_total", "subagent_done", "subagent_status_seq"]


def _out_sql(src: str) -> list[str]:
    rep = [f"CASE WHEN d_ THEN {n} END AS {n}" for n in _CHILD] + [
        f"CASE WHEN d_ AND w_ THEN {n} END AS {n}" for n in tm.OUTCOMES
    ]
    return [
        f"o1 AS (SELECT *, {_DONE} AS d_, coalesce({_WHOLE}, false) AS w_ FROM {src})",
        f"o2 AS (SELECT * EXCLUDE (d_, w_) REPLACE ({', '.join(rep)}) FROM o1)",
    ]


@query("allowlist", with_ctes(TEL_SQL, body="SELECT ord, " + ", ".join(f'"{n}"' for n in tm.CONTRACT) + " FROM tel"))
def _(spark, d):
    return tm.allowlist(telemetry(spark, d), tm.CONTRACT, "ord")


@query("usage_coherence", with_ctes(TEL_SQL, *coh("tel"), body="SELECT ord, " + ", ".join(f'"{n}"' for n in [*tm.NUMBERS, "usage_source"]) + " FROM u4"))
def _(spark, d):
    out = tm.usage_coherence(telemetry(spark, d), NOW_US - 15 * 86400000000)
    return out.select("ord", *tm.NUMBERS, "usage_source")


@query("outcome_partition", with_ctes(TEL_SQL, *_out_sql("tel"), body="SELECT ord, " + ", ".join([*_CHILD, *tm.OUTCOMES]) + " FROM o2"))
def _(spark, d):
    return tm.outcome_partition(telemetry(spark, d)).select("ord", *_CHILD, *tm.OUTCOMES)


_H = ["subagent_starts", "subagent_stops", "subagent_seq"]


@query("hook_counters_valid", with_ctes(TEL_SQL, f"h AS ({_blank(_HOOK, _H, 'tel')})", body="SELECT ord, " + ", ".join(_H) + " FROM h"))
def _(spark, d):
    return tm.hook_counters_valid(telemetry(spark, d)).select("ord", *_H)


@query(
    "telemetry_view",
    with_ctes(
        TEL_SQL,
        f"""g AS (SELECT * REPLACE (CASE WHEN tool LIKE 'mcp%' THEN 'mcp-tool' ELSE 'custom-tool' END AS tool,
   CASE WHEN result = 'error' THEN result END AS result, CASE WHEN usage_source = 'pi-extension' THEN usage_source END AS usage_source)
   FROM tel WHERE seq <= {NOW_US - 15 * 86400000000} AND event IN ('turn', 'tool-start', 'idle') AND phase = 'working')""",
        f"h AS ({_blank(_HOOK, _H, 'g')})",
        *_out_sql("h"),
        *coh("o2"),
        body="SELECT ord, " + ", ".join(f'"{n}"' for n in tm.CONTRACT) + " FROM u4",
    ),
)
def _(spark, d):
    return tm.telemetry_view(telemetry(spark, d), NOW_US - 15 * 86400000000).select("ord", *tm.CONTRACT)


_TT = {
    "active": "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "started_at_s": "CASE WHEN k % 3 = 0 AND k % 10 > 0 THEN CASE WHEN k % 7 = 0 THEN (stamp - stamp % 1000000) / 1000000 + 50 ELSE (stamp - stamp % 1000000) / 1000000 - k END END",
    "observed_at_s": "stamp / 1000000",
    "complete": "CASE WHEN k % 17 = 0 THEN NULL ELSE k % 4 > 0 END",
    "last_duration_s": "CASE WHEN k % 5 > 0 THEN k END",
    "total_finished_duration_s": "CASE WHEN k % 6 > 0 THEN k * (k % 3) END",
    "last_outcome": "CASE WHEN k % 5 > 0 THEN CASE WHEN k % 8 = 0 THEN event_type WHEN k % 2 = 0 THEN 'aborted' ELSE 'completed' END END",
    "freshness_seconds": "CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k * 2 + 6 AS DOUBLE) END",
}
_TT_COLS = ["active", "started_at_s", "observed_at_s", "complete", "last_duration_s", "total_finished_duration_s", "last_outcome", "freshness_seconds"]


@query(
    "turn_timing_valid",
    with_ctes(
        F0_SQL,
        "t0 AS (SELECT ord, " + ", ".join(f"{e} AS {n}" for n, e in _TT.items()) + " FROM f0)",
        """t1 AS (SELECT * REPLACE (coalesce(freshness_seconds, 12.0)::DOUBLE AS freshness_seconds,
   CASE WHEN last_outcome IN ('completed', 'aborted') THEN last_outcome END AS last_outcome,
   CASE WHEN complete THEN total_finished_duration_s END AS total_finished_duration_s) FROM t0)""",
        body=f"""SELECT ord, active, CAST(started_at_s AS BIGINT) AS started_at_s, round(observed_at_s, 3) AS observed_at_s, complete, last_duration_s, total_finished_duration_s, last_outcome, freshness_seconds FROM t1
 WHERE observed_at_s > 0 AND observed_at_s <= {NOW_S - 8 * 86400} AND complete IS NOT NULL AND coalesce(started_at_s > 0 AND started_at_s <= observed_at_s, true)
 AND coalesce(active, false) = (started_at_s IS NOT NULL) AND (NOT complete OR total_finished_duration_s IS NOT NULL)
 AND coalesce(last_duration_s <= total_finished_duration_s, true) AND (last_duration_s IS NULL) = (last_outcome IS NULL) AND freshness_seconds BETWEEN 12 AND 180""",
    ),
)
def _(spark, d):
    x = f0(spark, d).select("ord", *[F.expr(e).alias(n) for n, e in _TT.items()])
    out = tm.turn_timing_valid(x, NOW_S - 8 * 86400)
    return out.select(
        "ord", *_TT_COLS
    ).withColumns(
        {"started_at_s": F.col("started_at_s").cast("long"), "observed_at_s": F.round("observed_at_s", 3)}
    )


# -------------------------------------------------------------------- records
@query(
    "identity_filter",
    with_ctes(
        F1_SQL,
        """i AS (SELECT session_id, ord, CASE WHEN k = 23 THEN 'absent' WHEN mismatch THEN 'mismatch' ELSE 'match' END AS identity FROM f1)""",
        body="""SELECT session_id, ord, identity, max(CASE WHEN identity = 'mismatch' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord) = 1 AS poisoned FROM i""",
    ),
)
def _(spark, d):
    x = f1(spark, d).withColumn(
        "named",
        F.expr("CASE WHEN k = 23 THEN NULL WHEN mismatch THEN 'elsewhere' ELSE CAST(session_id AS STRING) END"),
    )
    return cl.identity_filter(x, "named").select("session_id", "ord", "identity", "poisoned")


@query("drop_forked", with_ctes(F1_SQL, body="SELECT session_id, count(*) AS n FROM f1 WHERE NOT forked GROUP BY 1"))
def _(spark, d):
    return cl.drop_forked(f1(spark, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("drop_synthetic", with_ctes(F1_SQL, body="SELECT session_id, count(*) AS n FROM f1 WHERE NOT synthetic GROUP BY 1"))
def _(spark, d):
    return cl.drop_synthetic(f1(spark, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


_RAW = {
    "type": "CASE WHEN k = 99 THEN 'file-history' ELSE kind END",
    "stop_reason": "CASE WHEN k % 6 = 0 THEN 'max_tokens' ELSE stop END",
    "stop_present": "k % 50 <> 1",
    "has_message": "k <> 3",
    "iterations_bad": "k = 53",
    "origin": "CASE k % 7 WHEN 0 THEN 'human' WHEN 1 THEN 'peer' WHEN 2 THEN 'weird' WHEN 3 THEN 'task-notification' END",
    "agent_id": "CASE WHEN k % 10 = 0 THEN 'not ok!' ELSE child_key END",
    "tool_status": "CASE WHEN k % 3 = 0 THEN 'async_launched' ELSE 'ok' END",
    "duration_ms": "k * 1000",
    "model": "CASE WHEN synthetic THEN '<synthetic>' ELSE model END",
}


@query(
    "classify_record",
    with_ctes(
        F1_SQL,
        "raw AS (SELECT session_id, ord, stamp, subtype, message_id, operation, " + ", ".join(f"{e} AS {n}" for n, e in _RAW.items()) + " FROM f1)",
        """c AS (SELECT *, CASE WHEN type IN ('assistant','user','system','queue-operation') THEN type END AS kind FROM raw)""",
        body="""SELECT session_id, ord, stamp, kind, CASE WHEN kind = 'system' THEN subtype END AS subtype, CASE WHEN kind = 'assistant' AND regexp_full_match(message_id, '[A-Za-z0-9_-]+') THEN message_id END AS message_id,
  CASE WHEN kind = 'assistant' THEN CASE WHEN stop_reason IS NULL THEN 'null' WHEN stop_reason IN ('end_turn','tool_use') THEN stop_reason ELSE 'other' END END AS stop,
  CASE WHEN kind = 'assistant' AND model <> '<synthetic>' THEN model END AS model, coalesce(kind = 'assistant' AND model = '<synthetic>', false) AS synthetic,
  CASE WHEN kind = 'user' THEN CASE WHEN origin = 'weird' THEN 'other' ELSE origin END END AS origin,
  CASE WHEN kind = 'queue-operation' THEN operation END AS operation, CASE WHEN kind = 'user' AND agent_id <> 'not ok!' THEN agent_id END AS child_key,
  coalesce(kind = 'user' AND tool_status = 'async_launched', false) AS spawn,
  CASE WHEN kind = 'system' AND subtype = 'turn_duration' THEN duration_ms END AS elapsed_ms,
  coalesce(kind = 'assistant' AND (NOT has_message OR message_id IS NULL OR NOT stop_present OR iterations_bad), false) AS bad FROM c""",
    ),
)
def _(spark, d):
    x = f1(spark, d).select("session_id", "ord", "stamp", "subtype", "message_id", "operation", *[F.expr(e).alias(n) for n, e in _RAW.items()])
    return cl.classify_record(x)


_ROLE = {
    "kind": "CASE WHEN k % 20 = 4 THEN 'attachment' ELSE kind END",
    "queued": "k % 40 = 4",
    "mode": "CASE WHEN k % 80 = 4 THEN 'task-notification' ELSE 'prompt' END",
    "interrupt": "abort AND k % 2 = 0",
    "interrupted": "abort AND k % 2 = 1",
    "aborted": "k = 61",
    "origin": "CASE k % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'mystery' END",
    "meta": "k % 5 = 0",
    "tool": "p = 4",
    "summary": "k = 71",
    "lead": "CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'bash-stdout' WHEN 2 THEN 'command-name' END",
}


@query(
    "classify_turn_role",
    with_ctes(
        F1_SQL,
        "r AS (SELECT session_id, ord, subtype, " + ", ".join(f"{e} AS {n}" for n, e in _ROLE.items()) + " FROM f1)",
        body="""SELECT session_id, ord, CASE WHEN interrupt OR interrupted OR aborted THEN 'abort' WHEN kind = 'assistant' THEN 'assistant' WHEN kind = 'queue-operation' THEN 'queue'
  WHEN kind = 'system' AND subtype = 'turn_duration' THEN 'end' WHEN kind = 'system' AND subtype = 'stop_hook_summary' THEN 'silent'
  WHEN kind = 'user' AND origin = 'human' THEN 'trigger' WHEN kind = 'attachment' AND queued AND mode = 'task-notification' THEN 'trigger'
  WHEN kind = 'user' AND origin IS NOT NULL THEN 'unknown' WHEN kind = 'user' AND (meta OR tool OR summary) THEN 'ignored'
  WHEN kind = 'user' AND lead IS NULL THEN 'unknown' WHEN kind = 'user' AND lead IN ('none', 'command-name') THEN 'trigger' ELSE 'ignored' END AS role FROM r""",
    ),
)
def _(spark, d):
    x = f1(spark, d).select("session_id", "ord", "subtype", *[F.expr(e).alias(n) for n, e in _ROLE.items()])
    return cl.classify_turn_role(x).select("session_id", "ord", "role")


# ----------------------------------------------------------------------- text
_F5 = """CASE conv_id % 8
  WHEN 0 THEN concat('<command-name>', text) WHEN 1 THEN concat('<', role, '>', text)
  WHEN 2 THEN concat('<task-notification>\n<task-id>t', CAST(conv_id AS {s}), '</task-id> <status>', CASE turn % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'killed' WHEN 3 THEN 'blocked' ELSE 'odd' END, '</status></task-notification>\n')
  WHEN 3 THEN concat('<task-notification><summary>', replace(text, '<', ''), '</summary><task-id>x', CAST(turn AS {s}), '</task-id></task-notification>', CASE WHEN turn % 2 = 0 THEN text ELSE '' END)
  WHEN 4 THEN CASE WHEN turn % 2 = 0 THEN '[Request interrupted by user]' ELSE concat('[Request interrupted by user]', text) END
  WHEN 5 THEN concat('<task-notification><task-id>a</task-id><task-id>b</task-id><status>completed</status></task-notification>')
  WHEN 6 THEN concat('<task-notification>stray<task-id>c</task-id></task-notification>')
  ELSE text END"""


@query(
    "classify_text",
    f"""WITH f5 AS (SELECT conv_id, turn, text AS orig, {_F5.format(s='VARCHAR')} AS t, conv_id % 3 + 1 AS blocks FROM conversations),
l AS (SELECT *, regexp_extract(t, '^<([a-z0-9_-]{{1,32}})>', 1) AS tag FROM f5),
m AS (SELECT *, CASE WHEN tag = '' THEN 'none' WHEN tag IN ('command-name','task-notification') THEN tag ELSE 'other' END AS lead,
  CASE conv_id % 8 WHEN 2 THEN 't' || conv_id WHEN 3 THEN CASE WHEN turn % 2 = 1 OR regexp_full_match(orig, '\\s*') THEN 'x' || turn END END AS task FROM l)
SELECT conv_id, turn, lead, t = '[Request interrupted by user]' AS interrupt, CASE WHEN task IS NOT NULL AND blocks <= 1 THEN sha256(task) END AS task,
 CASE WHEN lead = 'task-notification' THEN CASE WHEN conv_id % 8 = 2 THEN CASE turn % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'errored' WHEN 2 THEN 'interrupted' ELSE 'unknown' END ELSE 'unknown' END END AS task_status FROM m""",
)
def _(spark, d):
    x = table(spark, d, "conversations").select(
        "conv_id", "turn", F.expr(_F5.format(s="STRING")).alias("t"), F.expr("conv_id % 3 + 1").alias("blocks")
    )
    return cl.classify_text(x, "t", "blocks").select("conv_id", "turn", "lead", "interrupt", "task", "task_status")


# ----------------------------------------------------------------- iterations
_ITER = [
    ("CASE k % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'advisor_message' ELSE 'compaction' END", "k"),
    ("CASE k % 4 WHEN 0 THEN 'fallback_message' WHEN 1 THEN 'message' WHEN 2 THEN 'advisor_message' ELSE 'odd' END", "k + 1"),
    ("CASE k % 5 WHEN 0 THEN 'message' WHEN 1 THEN 'compaction' WHEN 2 THEN 'advisor_message' ELSE 'fallback_message' END", "CASE WHEN k % 7 > 0 THEN k + 2 END"),
]


@query(
    "select_iteration",
    with_ctes(
        F1_SQL,
        "it AS (SELECT ord, k, input, output, list_filter(["
        + ", ".join(f"{{'type': {t}, 'v': {v}}}" for t, v in _ITER)
        + "][1:k % 4], lambda i: i.type NOT IN ('advisor_message', 'compaction')) AS real_, list_filter(["
        + ", ".join(f"{{'type': {t}, 'v': {v}}}" for t, v in _ITER)
        + "][1:k % 4], lambda i: i.type = 'compaction') AS comp FROM f1)",
        "l AS (SELECT ord, input, output, list_last(real_) AS x, len(comp) > 0 AS compaction FROM it)",
        "u AS (SELECT *, coalesce(x.type IN ('message', 'fallback_message') AND x.v * 2 > 0, false) AS use FROM l)",
        body="SELECT ord, compaction, CASE WHEN use THEN x.v ELSE input END AS input, CASE WHEN use THEN 0 ELSE output END AS output FROM u",
    ),
)
def _(spark, d):
    items = [
        F.struct(
            F.expr(t).alias("type"),
            F.expr(v).alias("input"),
            F.lit(0).cast("long").alias("output"),
            F.expr(v).alias("cache_read"),
            F.lit(0).cast("long").alias("cache_write"),
        )
        for t, v in _ITER
    ]
    x = f1(spark, d).select(
        "ord",
        F.slice(F.array(*items), F.lit(1), (F.col("k") % 4).cast("int")).alias("its"),
        F.struct("input", "output", "cache_read", "cache_write").alias("top"),
    )
    u = cl.select_iteration(F.col("its"), F.col("top"))
    return x.select("ord", cl.has_compaction(F.col("its")).alias("compaction"), u.alias("u")).select(
        "ord", "compaction", "u.input", "u.output"
    )


_PEER_NOW = NOW_US - 15 * 86400000000


@query(
    "revalidate_remote",
    with_ctes(
        TEL_SQL,
        f"""r AS (SELECT tel.*, greatest({_PEER_NOW}, seq - output_tokens * 1000000) + 8000000 AS lim,
   CASE WHEN usage_source = 'pi-extension' THEN usage_source END AS src FROM tel WHERE event IN ('turn', 'tool-start', 'idle') AND phase = 'working')""",
        body="""SELECT ord, seq, CASE WHEN usage_seq <= lim THEN usage_seq END AS usage_seq, CASE WHEN usage_seq <= lim OR (usage_seq IS NULL AND src IS NULL) THEN input END AS input FROM r WHERE seq <= lim""",
    ),
)
def _(spark, d):
    x = telemetry(spark, d).withColumn("sampled", F.col("seq") - F.col("output_tokens") * 1000000)
    return tm.revalidate_remote(x, _PEER_NOW, "sampled").select("ord", "seq", "usage_seq", "input")


@query(
    "usage_reading",
    with_ctes(
        TEL_SQL,
        f"""x AS (SELECT *, coalesce(usage_seq, seq) AS st FROM tel),
y AS (SELECT *, coalesce(seq > 0 AND seq <= {_PEER_NOW} AND st > 0 AND st <= seq, false) AS ok,
  coalesce(total_cache_read <= total_input AND total_uncached_input <= total_input - total_cache_read AND total_input - total_cache_read - total_uncached_input = coalesce(total_cache_write, 0), false) AS part FROM x)""",
        body=f"""SELECT ord, CASE WHEN ok AND "window" > 0 AND context <= "window" THEN round(coalesce(CASE WHEN context_percent BETWEEN 0 AND 100 THEN context_percent END, context * 100.0 / "window")::DOUBLE, 6) END AS shown_context_percent,
 CASE WHEN ok THEN total_input END AS shown_input, CASE WHEN ok AND part THEN total_uncached_input END AS shown_uncached,
 CASE WHEN ok AND part AND total_input > 0 THEN round((total_cache_read * 100.0 / total_input)::DOUBLE, 6) END AS shown_cache_percent,
 CASE WHEN ok THEN compactions END AS shown_compactions, ok AND {_PEER_NOW} - st > 120000000 AS shown_stale FROM y""",
    ),
)
def _(spark, d):
    # Whole tokens are split exactly on some samples, so both branches show.
    out = tm.usage_reading(telemetry(spark, d), _PEER_NOW)
    return out.select(
        "ord", F.round("shown_context_percent", 6).alias("shown_context_percent"), "shown_input", "shown_uncached",
        F.round("shown_cache_percent", 6).alias("shown_cache_percent"), "shown_compactions", "shown_stale",
    )
