"""Usage and child queries over the session records of F1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F1_SQL, NOW_US, f1, with_ctes
from ..operators import children as ch
from ..operators import usage as us
from .registry import query

SAFE = us.SAFE

LINES_SQL = """l0 AS (SELECT *, NOT bad AND message_id IS NOT NULL AS part FROM f1
  WHERE kind = 'assistant' AND NOT forked AND NOT synthetic),
l1 AS (SELECT *, lag(message_id) OVER w AS pm, lead(message_id) OVER w AS nm,
    lag(output) OVER w AS po,
    lag(coalesce(input,0) + cache_read + cache_write) OVER w AS pin
  FROM l0 WHERE part WINDOW w AS (PARTITION BY session_id ORDER BY ord)),
l2 AS (SELECT *, pm IS DISTINCT FROM message_id AS new, nm IS DISTINCT FROM message_id AS last_line FROM l1),
l3 AS (SELECT *, sum(new::INT) OVER (PARTITION BY session_id ORDER BY ord) AS island,
    max(CASE WHEN new THEN ord END) OVER (PARTITION BY session_id ORDER BY ord) AS island_start FROM l2),
ro AS (SELECT * FROM (SELECT session_id, island, message_id, ord,
    lag(island) OVER (PARTITION BY session_id, message_id ORDER BY ord) AS prev_island FROM l3 WHERE new)
  WHERE prev_island IS NOT NULL),
l4 AS (SELECT l3.*, ro.island IS NOT NULL AS reopened,
    coalesce(input + output + cache_read + cache_write <= 9007199254740991, false) AS complete
  FROM l3 LEFT JOIN ro ON l3.session_id = ro.session_id AND l3.island = ro.island),
fl AS (SELECT session_id, bool_or(mismatch) AS foreign_,
    bool_or(bad AND NOT forked AND kind = 'assistant') AS lost FROM f1 GROUP BY session_id)"""

USAGE_TOTALS_SQL = with_ctes(
    F1_SQL,
    LINES_SQL,
    """s AS (SELECT session_id, bool_or(reopened OR NOT complete) AS broken,
    max(CASE WHEN NOT reopened THEN stamp END) AS usage_seq,
    sum(CASE WHEN last_line THEN input END) AS i, sum(CASE WHEN last_line THEN output END) AS o,
    sum(CASE WHEN last_line THEN cache_read END) AS r, sum(CASE WHEN last_line THEN cache_write END) AS w
  FROM l4 GROUP BY session_id),
j AS (SELECT fl.*, s.* EXCLUDE (session_id),
   NOT foreign_ AND NOT lost AND NOT broken AND usage_seq IS NOT NULL AS known
   FROM fl LEFT JOIN s ON fl.session_id = s.session_id)""",
    body="""SELECT session_id, CAST(CASE WHEN known THEN i + r + w END AS BIGINT) AS total_input,
  CAST(CASE WHEN known THEN r END AS BIGINT) AS total_cache_read,
  CAST(CASE WHEN known THEN w END AS BIGINT) AS total_cache_write,
  CAST(CASE WHEN known THEN i END AS BIGINT) AS total_uncached_input,
  CAST(CASE WHEN known THEN o END AS BIGINT) AS total_output,
  CASE WHEN NOT foreign_ THEN usage_seq END AS usage_seq FROM j""",
)


@query("usage_totals", USAGE_TOTALS_SQL)
def _(spark, d):
    return us.usage_totals(f1(spark, d))


@query(
    "message_islands",
    with_ctes(
        F1_SQL,
        LINES_SQL,
        body="SELECT session_id, ord, CAST(island AS BIGINT) AS island, island_start, new, last_line FROM l3",
    ),
)
def _(spark, d):
    rows = us.message_islands(f1(spark, d)).filter("part")
    return rows.select("session_id", "ord", "island", "island_start", "new", "last_line")


@query(
    "reopened_groups",
    with_ctes(
        F1_SQL,
        LINES_SQL,
        body="""SELECT session_id, CAST(island AS BIGINT) AS island, message_id, ord,
  CAST(prev_island AS BIGINT) AS prev_island FROM ro""",
    ),
)
def _(spark, d):
    return us.reopened_groups(us.message_islands(f1(spark, d)))


LAST_RESPONSE_SQL = with_ctes(
    F1_SQL,
    LINES_SQL,
    """bf AS (SELECT session_id, max(ord) AS f FROM (
    SELECT session_id, ord FROM l0 WHERE NOT part
    UNION ALL SELECT session_id, ord FROM l4 WHERE reopened OR NOT complete) GROUP BY 1),
sn AS (SELECT session_id, max(stamp) AS seen FROM l4 WHERE NOT reopened GROUP BY 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS r FROM l4
  WHERE last_line AND stop IS NOT NULL AND NOT reopened AND complete),
j AS (SELECT fl.session_id, c.input + c.cache_read + c.cache_write AS ctx, c.output, c.cache_read, c.cache_write,
   c.model, NOT foreign_ AND seen IS NOT NULL AND c.island_start > coalesce(bf.f, -1) AS good
  FROM fl LEFT JOIN (SELECT * FROM cand WHERE r = 1) c ON c.session_id = fl.session_id
  LEFT JOIN bf ON bf.session_id = fl.session_id LEFT JOIN sn ON sn.session_id = fl.session_id)""",
    body="""SELECT session_id, CASE WHEN good THEN ctx END AS context, CASE WHEN good THEN output END AS output_tokens,
  CASE WHEN good THEN cache_read END AS cache_read, CASE WHEN good THEN cache_write END AS cache_write,
  CASE WHEN good THEN model END AS model FROM j""",
)


@query("last_response", LAST_RESPONSE_SQL)
def _(spark, d):
    return us.last_response(f1(spark, d))


@query(
    "running_usage",
    with_ctes(
        F1_SQL,
        LINES_SQL,
        """dl AS (SELECT session_id, ord, output - CASE WHEN new THEN 0 ELSE po END AS d_o,
    coalesce(input, 0) + cache_read + cache_write - CASE WHEN new THEN 0 ELSE pin END AS d_i,
    reopened OR NOT complete AS failed FROM l4
  UNION ALL SELECT session_id, ord, 0, 0, true FROM l0 WHERE NOT part),
rs AS (SELECT *, sum(d_o) OVER w AS so, sum(d_i) OVER w AS si, max(failed::INT) OVER w AS f
  FROM dl WINDOW w AS (PARTITION BY session_id ORDER BY ord)),
fo AS (SELECT session_id, min(ord) AS fo FROM f1 WHERE mismatch GROUP BY 1)""",
        body="""SELECT rs.session_id, ord,
  CAST(CASE WHEN f = 0 AND coalesce(ord < fo, true) THEN si END AS BIGINT) AS total_input,
  CAST(CASE WHEN f = 0 AND coalesce(ord < fo, true) THEN so END AS BIGINT) AS total_output
  FROM rs LEFT JOIN fo ON rs.session_id = fo.session_id""",
    ),
)
def _(spark, d):
    return us.running_usage(f1(spark, d))


@query(
    "dedup_stats",
    with_ctes(
        F1_SQL,
        LINES_SQL,
        body="""SELECT session_id, count(*) AS assistant_lines, count(*) FILTER (NOT new) AS merged_lines,
  count(*) FILTER (new) AS groups, count(*) FILTER (new AND reopened) AS reopened_groups FROM l4 GROUP BY session_id""",
    ),
)
def _(spark, d):
    return us.dedup_stats(f1(spark, d))


@query(
    "compactions",
    with_ctes(
        F1_SQL,
        body="""SELECT session_id, CASE WHEN NOT bool_or(mismatch)
  AND NOT bool_or(NOT forked AND compaction_iteration AND (NOT bad OR synthetic))
  AND NOT bool_or(NOT forked AND bad AND NOT synthetic AND kind IN ('assistant','system'))
  THEN count(*) FILTER (NOT forked AND NOT bad AND subtype = 'compact_boundary') END AS compactions
  FROM f1 GROUP BY session_id""",
    ),
)
def _(spark, d):
    return us.compactions_b(f1(spark, d))


# Format A reading of the same records.
_A_COLS = {
    "a_type": """CASE WHEN p = 0 THEN 'task_started' WHEN p IN (1, 2, 3) THEN 'token_count'
      WHEN p IN (4, 6) THEN 'sub_agent_activity' WHEN p = 5 AND k % 4 = 0 THEN 'context_compacted'
      WHEN p = 5 AND k % 4 = 1 THEN 'compacted' WHEN p = 7 AND event_type = 'error' THEN 'turn_aborted'
      WHEN p = 7 THEN 'task_complete' ELSE 'other' END""",
    "unreadable": "k = 3 AND session_id % 3 = 0",
    "has_info": "k <> 43",
    "has_last": "k <> 47",
    "t_input": "c * 1000 + input",
    "t_output": "c * 100 + output",
    "t_cache_read": "c * 500 + cache_read * 2",
    "window": "k * 13",
}


def f1a(spark, d):
    return f1(spark, d).select("*", *[F.expr(e).alias(n) for n, e in _A_COLS.items()])


F1A_SQL = F1_SQL + ",\nf1a AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _A_COLS.items()) + " FROM f1)"


@query(
    "compactions_marked",
    with_ctes(
        F1A_SQL,
        body="""SELECT session_id, CASE WHEN NOT bool_or(unreadable) THEN
  greatest(count(*) FILTER (a_type = 'context_compacted'), count(*) FILTER (a_type = 'compacted')) END AS compactions
  FROM f1a GROUP BY session_id""",
    ),
)
def _(spark, d):
    return us.compactions_a(f1a(spark, d))


@query(
    "latest_token_count",
    with_ctes(
        F1A_SQL,
        f"""g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS r FROM f1a
  WHERE a_type = 'token_count' AND has_info AND NOT unreadable AND (NOT has_last OR stamp IS NOT NULL)),
j AS (SELECT s.session_id, g.* EXCLUDE (session_id), g.input + g.output AS ctx,
   coalesce(has_last AND stamp <= {NOW_US}, false) AS ok
  FROM (SELECT DISTINCT session_id FROM f1a) s LEFT JOIN (SELECT * FROM g WHERE r = 1) g ON g.session_id = s.session_id),
q AS (SELECT *, "window" IS NOT NULL AND ctx IS NOT NULL AND NOT ("window" > 0 AND ctx <= "window") AS dropped FROM j)""",
        body="""SELECT session_id, CASE WHEN ok THEN stamp END AS usage_seq, CASE WHEN ok THEN input END AS input,
  CASE WHEN ok THEN output END AS output_tokens, CASE WHEN ok THEN cache_read END AS cache_read,
  CASE WHEN ok AND NOT dropped THEN ctx END AS context, CASE WHEN ok AND NOT dropped THEN "window" END AS "window",
  CAST(CASE WHEN ok AND "window" > 0 AND ctx <= "window" THEN CASE WHEN "window" <= 12000 THEN 100
    ELSE 100 - round(least(greatest(greatest("window" - 12000 - greatest(ctx - 12000, 0), 0) * 100.0 / ("window" - 12000), 0), 100)) END END AS BIGINT)
    AS context_percent,
  CASE WHEN ok THEN t_input END AS total_input, CASE WHEN ok THEN t_output END AS total_output,
  CASE WHEN ok AND t_cache_read <= t_input THEN t_input - t_cache_read END AS total_uncached_input FROM q""",
    ),
)
def _(spark, d):
    return us.latest_token_count(f1a(spark, d), NOW_US)


# Format C reading: assistant messages, plain usage entries and compactions.
_C_COLS = {
    "c_type": """CASE WHEN p IN (1, 2, 3) THEN 'assistant' WHEN p = 5 THEN 'usage'
      WHEN p = 7 AND k % 2 = 0 THEN 'compaction' ELSE 'label' END""",
    "has_usage": "k <> 3",
}


def f1c(spark, d):
    rows = f1(spark, d).select("*", *[F.expr(e).alias(n) for n, e in _C_COLS.items()])
    return rows.withColumn("output", F.expr("CASE WHEN k <> 3 THEN output END"))


F1C_SQL = (
    F1_SQL
    + ",\nf1c AS (SELECT * REPLACE (CASE WHEN k <> 3 THEN output END AS output), "
    + ", ".join(f"{e} AS {n}" for n, e in _C_COLS.items())
    + " FROM f1)"
)


@query(
    "adapter_totals",
    with_ctes(
        F1C_SQL,
        """a AS (SELECT session_id, count(*) FILTER (c_type = 'compaction') AS compactions,
    count(*) FILTER (has_usage AND c_type <> 'label') AS measured,
    CASE WHEN count(*) FILTER (c_type <> 'label' AND input IS NULL) = 0 THEN coalesce(sum(input) FILTER (c_type <> 'label'), 0) END AS i,
    CASE WHEN count(*) FILTER (c_type <> 'label' AND output IS NULL) = 0 THEN coalesce(sum(output) FILTER (c_type <> 'label'), 0) END AS o,
    coalesce(sum(cache_read) FILTER (c_type <> 'label'), 0) AS r, coalesce(sum(cache_write) FILTER (c_type <> 'label'), 0) AS w
  FROM f1c GROUP BY session_id)""",
        body="""SELECT session_id, CAST(CASE WHEN measured > 0 THEN i + r + w END AS BIGINT) AS total_input,
  CAST(CASE WHEN measured > 0 THEN o END AS BIGINT) AS total_output,
  CAST(CASE WHEN measured > 0 THEN r END AS BIGINT) AS total_cache_read,
  CAST(CASE WHEN measured > 0 THEN w END AS BIGINT) AS total_cache_write,
  CAST(CASE WHEN measured > 0 THEN i END AS BIGINT) AS total_uncached_input, compactions FROM a""",
    ),
)
def _(spark, d):
    return us.adapter_totals(f1c(spark, d))


@query(
    "adapter_latest_usage",
    with_ctes(
        F1C_SQL,
        f"""r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS rr FROM f1c),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS q FROM r WHERE c_type = 'assistant'),
lv AS (SELECT session_id, max(stamp) AS ls, max(k) AS li, min(k) AS lo FROM f1c WHERE session_id % 3 = 0 AND k < 90 GROUP BY 1),
j AS (SELECT s.session_id, n.stamp, n.input, n.output, ls, li, lo,
    coalesce(has_usage AND n.stamp <= {NOW_US}, false) AS m
  FROM (SELECT DISTINCT session_id FROM f1c) s LEFT JOIN (SELECT * FROM n WHERE q = 1) n ON n.session_id = s.session_id
  LEFT JOIN lv ON lv.session_id = s.session_id),
t AS (SELECT *, ls IS NULL OR (m AND stamp >= ls) AS take FROM j)""",
        body="""SELECT session_id, CASE WHEN take THEN CASE WHEN m THEN stamp END ELSE ls END AS usage_seq,
  CASE WHEN take THEN CASE WHEN m THEN input END ELSE li END AS input,
  CASE WHEN take THEN CASE WHEN m THEN output END ELSE lo END AS output_tokens FROM t""",
    ),
)
def _(spark, d):
    rows = f1c(spark, d)
    live = (
        rows.filter("session_id % 3 = 0 AND k < 90")
        .groupBy("session_id")
        .agg(
            F.max("stamp").alias("live_seq"),
            F.max("k").alias("live_input"),
            F.min("k").alias("live_output"),
        )
    )
    return us.adapter_latest_usage(rows, live, NOW_US)


@query(
    "merge_usage",
    with_ctes(
        F1_SQL,
        """m AS (SELECT session_id, max(CASE WHEN session_id % 4 <> 0 AND k % 7 = 0 THEN stamp END) AS usage_seq, max(k) AS output, max(cache_read) AS cache_read
  FROM f1 WHERE p < 4 GROUP BY 1),
r AS (SELECT session_id, max(CASE WHEN session_id % 5 <> 0 AND k > 50 THEN stamp END) AS usage_seq, min(k) AS output, min(cache_read) AS cache_read
  FROM f1 WHERE p >= 4 GROUP BY 1),
b AS (SELECT coalesce(m.session_id, r.session_id) AS session_id, m.usage_seq AS ms, m.output AS mo, m.cache_read AS mc,
  r.usage_seq AS rs, r.output AS ro, r.cache_read AS rc, r.usage_seq IS NOT NULL AND (m.usage_seq IS NULL OR r.usage_seq >= m.usage_seq) AS newer
  FROM m FULL JOIN r ON m.session_id = r.session_id)""",
        body="""SELECT session_id, CASE WHEN newer THEN rs ELSE ms END AS usage_seq, CASE WHEN newer THEN ro ELSE mo END AS output,
  CASE WHEN newer THEN rc ELSE mc END AS cache_read FROM b""",
    ),
)
def _(spark, d):
    rows = f1(spark, d)
    m = rows.filter("p < 4").groupBy("session_id").agg(
        F.max(F.expr("CASE WHEN session_id % 4 <> 0 AND k % 7 = 0 THEN stamp END")).alias("usage_seq"),
        F.max("k").alias("output"),
        F.max("cache_read").alias("cache_read"),
    )
    r = rows.filter("p >= 4").groupBy("session_id").agg(
        F.max(F.expr("CASE WHEN session_id % 5 <> 0 AND k > 50 THEN stamp END")).alias("usage_seq"),
        F.min("k").alias("output"),
        F.min("cache_read").alias("cache_read"),
    )
    return us.merge_usage(m, r, ["output", "cache_read"])


@query(
    "window_reading",
    with_ctes(
        F1_SQL,
        """u AS (SELECT session_id, max(cache_read) * 4 AS context FROM f1 GROUP BY 1),
w AS (SELECT session_id, sum(k) AS w, session_id % 5 = 0 AS remote FROM f1 WHERE p = 0 AND session_id % 3 <> 0 GROUP BY 1),
j AS (SELECT u.session_id, context, CASE WHEN NOT coalesce(remote, true) AND w > 0 AND context <= w THEN w END AS win
  FROM u LEFT JOIN w ON u.session_id = w.session_id)""",
        body="""SELECT session_id, context, CAST(win AS BIGINT) AS "window",
  CAST((context * 100 + win // 2) // win AS BIGINT) AS context_percent FROM j""",
    ),
)
def _(spark, d):
    rows = f1(spark, d)
    u = rows.groupBy("session_id").agg((F.max("cache_read") * 4).alias("context"))
    w = (
        rows.filter("p = 0 AND session_id % 3 <> 0")
        .groupBy("session_id")
        .agg(F.sum("k").alias("window"))
        .withColumn("remote", F.col("session_id") % 5 == 0)
    )
    return us.window_reading(u, w)


@query(
    "seq_rollup",
    with_ctes(
        F1_SQL,
        LINES_SQL,
        f"""b AS (SELECT session_id, max(stamp) AS coverage_seq FROM f1 GROUP BY 1),
u AS (SELECT session_id, max(stamp) AS usage_seq FROM l4 WHERE NOT reopened GROUP BY 1),
ce AS (SELECT *, max(CASE WHEN child_event = 'launch' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, child_key ORDER BY ord) AS kn
  FROM f1 WHERE child_event IS NOT NULL AND NOT forked AND NOT bad),
cs AS (SELECT session_id, max(stamp) AS child_seq FROM ce WHERE kn = 1 GROUP BY 1),
j AS (SELECT b.session_id, coverage_seq, usage_seq, coalesce(child_seq, coverage_seq) AS status_seq
  FROM b LEFT JOIN u ON b.session_id = u.session_id LEFT JOIN cs ON b.session_id = cs.session_id)""",
        body=f"""SELECT session_id, coverage_seq, usage_seq, status_seq, greatest(
  CASE WHEN coverage_seq BETWEEN 1 AND {NOW_US - 86400000000 * 4} THEN coverage_seq END,
  CASE WHEN usage_seq BETWEEN 1 AND {NOW_US - 86400000000 * 4} THEN usage_seq END,
  CASE WHEN status_seq BETWEEN 1 AND {NOW_US - 86400000000 * 4} THEN status_seq END) AS seq FROM j""",
    ),
)
def _(spark, d):
    return us.seq_rollup(f1(spark, d), NOW_US - 86400000000 * 4)


_LOST = "bad AND NOT forked AND NOT synthetic"
_FAIL_SQL = {
    "totals": f"mismatch OR ({_LOST} AND kind = 'assistant')",
    "compactions": f"mismatch OR ({_LOST} AND kind IN ('assistant', 'system'))",
    "children": f"mismatch OR ({_LOST} AND kind IN ('user', 'attachment'))",
    "turns": f"mismatch OR ({_LOST} AND kind IN ('assistant', 'system', 'user', 'attachment'))",
}


@query(
    "coverage_flags",
    with_ctes(
        F1_SQL,
        body="SELECT session_id, "
        + ", ".join(f"NOT bool_or({e}) AS {m}_known" for m, e in _FAIL_SQL.items())
        + " FROM f1 GROUP BY session_id",
    ),
)
def _(spark, d):
    return us.coverage_flags(f1(spark, d))


@query(
    "unknown_causes",
    with_ctes(
        F1_SQL,
        "x AS ("
        + " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, session_id, arg_min(CASE WHEN mismatch THEN 'mismatch' ELSE 'bad.' || kind END, ord) AS cause
      FROM f1 WHERE {e} GROUP BY session_id"""
            for m, e in _FAIL_SQL.items()
        )
        + ")",
        body="SELECT metric, cause, count(*) AS sessions FROM x GROUP BY 1, 2",
    ),
)
def _(spark, d):
    return us.unknown_causes(f1(spark, d))


CHILD_SQL = """ce AS (SELECT *, max(CASE WHEN child_event = 'launch' THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id, child_key ORDER BY ord) = 1 AS known
  FROM f1 WHERE child_event IS NOT NULL AND NOT forked AND NOT bad)"""


@query(
    "known_children",
    with_ctes(F1_SQL, CHILD_SQL, body="SELECT session_id, ord, child_key, child_event, known FROM ce"),
)
def _(spark, d):
    return ch.known_children(f1(spark, d))


def _outcomes_sql(valid: str) -> str:
    put = lambda c, n: f"CASE WHEN {valid} THEN coalesce({c}, 0) END AS {n}"
    counts = ", ".join(
        f"count(*) FILTER (status = '{s}' AND launched) AS {s}" for s in ch.STATUSES
    )
    return with_ctes(
        F1_SQL,
        CHILD_SQL,
        f"""pc AS (SELECT session_id, child_key, bool_or(child_event = 'launch') AS launched, bool_or(NOT known) AS early,
    arg_max(CASE WHEN child_event IN ('launch', 'resume') THEN 'running' ELSE child_event END, ord) AS status FROM ce GROUP BY 1, 2),
ps AS (SELECT session_id, {counts}, count(*) FILTER (launched) AS total, bool_or(early) AS early FROM pc GROUP BY 1),
v AS (SELECT session_id, NOT bool_or(mismatch OR (bad AND NOT forked AND kind IN ('user', 'attachment'))) AS ok FROM f1 GROUP BY 1)""",
        body=f"SELECT v.session_id, {valid} AS valid, "
        + ", ".join(put(s, s) for s in [*ch.STATUSES, "total"])
        + f", {put('completed', 'done')} FROM v LEFT JOIN ps ON v.session_id = ps.session_id",
    )


@query("child_outcomes", _outcomes_sql("ok"))
def _(spark, d):
    return ch.child_outcomes(f1(spark, d))


@query("child_outcomes_strict", _outcomes_sql("(ok AND NOT coalesce(early, false))"))
def _(spark, d):
    return ch.child_outcomes(f1(spark, d), strict=True)


@query("capped_roster", _outcomes_sql("(ok AND coalesce(total, 0) <= 3)"))
def _(spark, d):
    return ch.child_outcomes(f1(spark, d), cap=3)
