"""Turn interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F1_SQL, NOW_S, f0, f1, with_ctes
from ..operators import turns as tn
from .registry import query
from .turns_oracle import gates_sql, joins_sql, summary_sql

TRIG_SQL = """tg AS (SELECT *, last_value(CASE WHEN p = 0 THEN stamp END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord) AS trig FROM f1)"""


# ------------------------------------------------------------------- format A
_A = {
    "opens": "p = 0",
    "key": "CASE WHEN k = 2 THEN NULL WHEN k = 7 THEN concat('t', CAST(c - 1 AS {s})) ELSE concat('t', CAST(c AS {s})) END",
    "start": "{sec} + CASE WHEN p = 7 AND k % 10 = 9 THEN 1 WHEN p = 0 AND k = 31 THEN -4000 ELSE 0 END",
    "end": "CASE WHEN p = 7 THEN {sec2} END",
    "outcome": "CASE WHEN p = 7 THEN CASE WHEN event_type = 'error' THEN 'aborted' ELSE 'completed' END END",
}


def records_a(spark, d):
    x = f1(spark, d).filter("p IN (0, 7)")
    exprs = {
        n: e.format(s="STRING", sec="trig div 1000000", sec2="stamp div 1000000") for n, e in _A.items()
    }
    return tn.turn_records_a(
        x.select("session_id", "ord", *[F.expr(e).alias(n) for n, e in exprs.items()]), NOW_S
    )


A_SQL = (
    F1_SQL
    + ",\n"
    + TRIG_SQL
    + ",\na0 AS (SELECT session_id, ord, "
    + ", ".join(
        f'{e.format(s="VARCHAR", sec="trig // 1000000", sec2="stamp // 1000000")} AS "{n}"' for n, e in _A.items()
    )
    + """ FROM tg WHERE p IN (0, 7)),
a1 AS (SELECT *, coalesce(key IS NOT NULL AND start > 0 AND start <= """
    + str(NOW_S)
    + """ AND (opens OR ("end" >= start AND "end" <= """
    + str(NOW_S)
    + """)), false) AS ok FROM a0),
a2 AS (SELECT *, first_value(CASE WHEN ok AND NOT opens THEN ord END IGNORE NULLS) OVER (PARTITION BY session_id, key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM a1),
ar AS (SELECT a2.*, b.start AS p_start, b."end" AS p_end, b.outcome AS p_outcome, row_number() OVER (PARTITION BY a2.session_id ORDER BY a2.ord) AS n
  FROM a2 LEFT JOIN a1 b ON b.session_id = a2.session_id AND b.ord = a2.po)"""
)


@query(
    "turn_pairs",
    with_ctes(
        A_SQL,
        body="""SELECT session_id, key, min(start) AS start, arg_min("end", ord) FILTER (NOT opens) AS "end", arg_min(outcome, ord) FILTER (NOT opens) AS outcome,
 count(*) FILTER (opens) AS starts, count(*) FILTER (NOT opens) AS ends,
 min(start) = max(start) AND coalesce(min("end") = max("end"), true) AND coalesce(min(outcome) = max(outcome), true) AS agrees
 FROM ar WHERE ok GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return tn.turn_pairs(records_a(spark, d))


# One row per record is folded by a recursive query over the row number.
FOLD_A_SQL = (
    A_SQL
    + """,
st AS (
  SELECT session_id, 0::BIGINT AS n, NULL::VARCHAR AS ak, NULL::BIGINT AS ast, false AS known, NULL::BIGINT AS le, NULL::BIGINT AS ld, NULL::VARCHAR AS lo, false AS lost
  FROM (SELECT DISTINCT session_id FROM ar)
  UNION ALL
  SELECT session_id, n, CASE WHEN act = 'open' THEN key WHEN act IN ('reset') OR clear1 OR clear2 THEN NULL ELSE ak END,
    CASE WHEN act = 'open' THEN start WHEN act IN ('reset') OR clear1 OR clear2 THEN NULL ELSE ast END,
    CASE WHEN act = 'open' THEN true WHEN act = 'reset' THEN false WHEN clear2 THEN false WHEN act = 'close' AND matched THEN true WHEN clear1 THEN false ELSE known END,
    CASE WHEN takes THEN "end" ELSE le END, CASE WHEN takes THEN "end" - start ELSE ld END, CASE WHEN takes THEN outcome ELSE lo END,
    lost OR act IN ('reset', 'late') OR (act = 'open' AND ak IS NOT NULL) OR (act = 'close' AND (NOT matched OR over))
  FROM (SELECT *, act = 'close' AND (matched OR (ak IS NOT NULL AND "end" > ast)) AS clear1,
      act = 'close' AND NOT matched AND over AND le < "end" AS clear2,
      act = 'close' AND NOT (NOT matched AND over AND le < "end") AND (le IS NULL OR ("end" > le AND (matched OR start >= le))) AS takes
    FROM (SELECT r.*, s.ak, s.ast, s.known, s.le, s.ld, s.lo, s.lost,
        coalesce(s.ak = r.key AND s.ast = r.start, false) AS matched, coalesce(r.start < s.le, false) AS over,
        CASE WHEN NOT r.ok THEN 'reset'
          WHEN r.opens THEN CASE WHEN p_start IS NOT NULL THEN CASE WHEN p_start <> r.start THEN 'reset' ELSE 'skip' END
            WHEN s.ak = r.key THEN CASE WHEN s.ast <> r.start THEN 'reset' ELSE 'skip' END
            WHEN s.ak IS NOT NULL AND r.start < s.ast THEN 'late' WHEN r.start < s.le THEN 'reset' ELSE 'open' END
          WHEN p_start IS NOT NULL THEN CASE WHEN p_start = r.start AND p_end = r."end" AND p_outcome = r.outcome THEN 'skip' ELSE 'reset' END
          ELSE 'close' END AS act
      FROM st s JOIN ar r ON r.session_id = s.session_id AND r.n = s.n + 1))),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC) AS q FROM st) WHERE q = 1),
tot AS (SELECT session_id, count(*) AS turns, sum("end" - start) AS total FROM ar WHERE ok AND NOT opens AND p_start IS NULL GROUP BY 1)"""
)


def _summary_a(cap: str) -> str:
    return "WITH RECURSIVE " + FOLD_A_SQL + f"""
SELECT fin.session_id, coalesce(turns, 0) AS turns, CAST(CASE WHEN NOT lost AND {cap} THEN coalesce(total, 0) END AS BIGINT) AS total_s, NOT lost AND {cap} AS complete,
  CASE WHEN known THEN ak IS NOT NULL END AS active, CASE WHEN known THEN ast END AS started_at_s, ld AS last_duration_s, le AS last_end_s, lo AS last_outcome
FROM fin LEFT JOIN tot ON fin.session_id = tot.session_id"""


@query("turn_summary", _summary_a("true"))
def _(spark, d):
    return tn.turn_summary_a(records_a(spark, d), extent=f0(spark, d))


@query("capped_turns", _summary_a("coalesce(turns, 0) <= 5"))
def _(spark, d):
    return tn.turn_summary_a(records_a(spark, d), cap=5, extent=f0(spark, d))


@query(
    "turn_overlaps",
    with_ctes(
        A_SQL,
        """t AS (SELECT session_id, ord, start, "end" FROM ar WHERE ok AND NOT opens AND p_start IS NULL),
o AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM t)""",
        body='SELECT session_id, ord, start, "end", prev_end, coalesce(start < prev_end, false) AS overlaps FROM o',
    ),
)
def _(spark, d):
    t = records_a(spark, d).filter("ok AND NOT opens AND p_start IS NULL").select("session_id", "ord", "start", "end")
    return tn.turn_overlaps(t).select("session_id", "ord", "start", "end", "prev_end", "overlaps")


@query(
    "end_floor",
    with_ctes(
        F1_SQL,
        body="""SELECT session_id, ord, max(CASE WHEN p = 7 THEN stamp // 1000000 END) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM f1""",
    ),
)
def _(spark, d):
    x = f1(spark, d).selectExpr("session_id", "ord", "p = 7 AS ends", "stamp div 1000000 AS sec")
    return tn.end_floor(x, "ends", "sec").select("session_id", "ord", "floor")


# ------------------------------------------------------------------- format B
_B = {
    "role": """CASE WHEN abort THEN 'abort' WHEN kind = 'assistant' THEN 'assistant' WHEN kind = 'queue-operation' THEN 'queue'
      WHEN subtype = 'turn_duration' THEN 'end' WHEN subtype = 'stop_hook_summary' THEN 'silent' WHEN kind = 'system' THEN 'ignored'
      WHEN p = 0 AND k = 83 THEN 'unknown' WHEN p = 0 OR (p = 6 AND k % 5 = 2) THEN 'trigger'
      WHEN p = 4 AND k % 4 = 1 THEN 'queue' ELSE 'ignored' END""",
    "key": "CASE WHEN p = 0 OR (p = 6 AND k % 5 = 2) THEN uuid END",
    "injected": "p = 0 AND k % 12 = 1",
    "command": "p = 0 AND k % 9 = 0",
    "final_stop": "coalesce(stop = 'other' OR (stop = 'end_turn' AND k % 2 = 0), false)",
    "local_output": "p = 4 AND k % 6 = 0",
    "local_command": "p = 4 AND k = 66",
    "prompt": "p = 6 AND k = 59",
    "take": "coalesce(operation IN ('dequeue', 'remove'), false) OR (p = 4 AND k % 4 = 1)",
    "elapsed_ms": "CASE WHEN subtype = 'turn_duration' AND k <> 58 THEN (stamp - trig) {div} 1000 + CASE WHEN k = 23 THEN 10000 ELSE 0 END END",
    "background": "subtype = 'turn_duration' AND k % 16 = 7",
    "masks": "coalesce(child_event IN ('launch', 'resume', 'unknown'), false)",
}


def records_b(spark, d, where="true"):
    x = f1(spark, d).filter(where)
    x = x.select("*", *[F.expr(e.format(div="div")).alias(n) for n, e in _B.items()])
    # A queued prompt keeps the stamp of the moment it was typed.
    x = x.withColumn("stamp", F.expr("CASE WHEN p = 6 AND k % 5 = 2 AND trig > 0 THEN trig ELSE stamp END"))
    return tn.turn_records_b(x)


@query("turn_summary_b", summary_sql(TRIG_SQL, _B))
def _(spark, d):
    return tn.turn_summary_b(tn.turn_events_b(records_b(spark, d), extent=f0(spark, d)))


@query("turn_gate_stats", gates_sql(TRIG_SQL, _B))
def _(spark, d):
    return tn.turn_gate_stats(tn.turn_events_b(records_b(spark, d), extent=f0(spark, d)))


@query("queued_input_join", joins_sql(TRIG_SQL, _B))
def _(spark, d):
    return tn.queued_input_join(tn.turn_events_b(records_b(spark, d), extent=f0(spark, d)))
