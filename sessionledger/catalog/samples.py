"""Queries over samples: episodes, as-of values, transitions and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F1_SQL, F2_SQL, F4_SQL, f1, f2, f4, with_ctes
from ..operators import samples as sm
from ..operators.usage import failing_metrics
from .registry import query
from .usage import _FAIL_SQL


@query(
    "latest_per_key",
    with_ctes(
        F2_SQL,
        body="""SELECT agent, status, project, sampled_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ord DESC) AS r FROM f2) WHERE r = 1""",
    ),
)
def _(spark, d):
    x = f2(spark, d).select("agent", "status", "project", "sampled_at", "seq", "ord")
    return sm.latest_per_key(x, ["agent"], "ord").select("agent", "status", "project", "sampled_at", "seq")


EPISODE_SQL = """e1 AS (SELECT *, lag(status) OVER w AS ps, lag(generation) OVER w AS pg, lag(online) OVER w AS po, lag(ord) OVER w AS pord
  FROM f4 WINDOW w AS (PARTITION BY agent ORDER BY ord)),
e2 AS (SELECT *, pord IS NULL OR ps IS DISTINCT FROM status OR pg IS DISTINCT FROM generation AS nw FROM e1),
e3 AS (SELECT *, sum(nw::INT) OVER (PARTITION BY agent ORDER BY ord) AS episode FROM e2)"""


@query(
    "status_episodes",
    with_ctes(
        F4_SQL,
        EPISODE_SQL,
        body="""SELECT agent, CAST(episode AS BIGINT) AS episode, any_value(status) AS status, any_value(generation) AS generation,
  min(stamp) AS started, max(stamp) AS ended, count(*) AS samples FROM e3 GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    x = f4(spark, d).select("agent", "ord", "stamp", "status", "generation")
    return sm.status_episodes(x, ["agent"], "ord", ["status", "generation"], "stamp")


@query(
    "status_since",
    with_ctes(
        F4_SQL,
        EPISODE_SQL,
        """s AS (SELECT *, max(CASE WHEN nw OR NOT po THEN ord END) OVER (PARTITION BY agent ORDER BY ord) AS o FROM e3)""",
        body="""SELECT s.agent, s.ord, s.status, s.generation, CASE WHEN s.online THEN b.stamp END AS since FROM s JOIN f4 b ON b.agent = s.agent AND b.ord = s.o""",
    ),
)
def _(spark, d):
    return sm.status_since(f4(spark, d).select("agent", "ord", "stamp", "status", "generation", "online"))


@query(
    "last_known",
    with_ctes(
        F4_SQL,
        EPISODE_SQL,
        """v AS (SELECT *, rejected OR cleared OR short AS drops, NOT missing AND NOT (rejected OR cleared OR short) AS keeps FROM e3),
ev AS (SELECT *, last_value(CASE WHEN keeps OR drops OR pg IS DISTINCT FROM generation THEN ord END IGNORE NULLS)
   OVER (PARTITION BY agent ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eo FROM v),
j AS (SELECT ev.*, b.keeps AS bk, b.stamp AS bs, b.output AS bo FROM ev JOIN v b ON b.agent = ev.agent AND b.ord = ev.eo)""",
        body="""SELECT agent, ord, CASE WHEN keeps THEN stamp WHEN missing AND NOT drops AND bk THEN bs END AS usage_stamp,
 CASE WHEN keeps THEN output WHEN missing AND NOT drops AND bk THEN bo END AS output, missing AND NOT drops AND bk AS carried FROM j""",
    ),
)
def _(spark, d):
    return sm.last_known(f4(spark, d), ["output"])


_TR = ["status", "generation", "starts", "stops", "child_stamp", "done", "done_stamp", "compactions", "stale"]


@query(
    "transitions",
    with_ctes(
        F4_SQL,
        "x AS (SELECT *, " + ", ".join(f"lag({n}) OVER w AS a_{n}" for n in _TR if n != "done_stamp") + ", lag(stamp) OVER w AS a_done_stamp FROM f4 WINDOW w AS (PARTITION BY agent ORDER BY ord))",
        """y AS (SELECT agent, ord, coalesce(a_status <> status AND a_status <> 'unknown' AND status <> 'unknown', false) AS state,
  coalesce(NOT stale AND child_stamp > a_child_stamp AND starts >= a_starts AND stops >= a_stops AND (starts > a_starts OR stops > a_stops), false)
  OR coalesce(NOT stale AND a_starts = 0 AND a_stops = 0 AND child_stamp IS NOT NULL AND (starts > 0 OR stops > 0), false)
  OR coalesce(NOT stale AND stamp > a_done_stamp AND done > a_done, false) AS children,
  coalesce(NOT stale AND compactions > a_compactions, false) AS compaction FROM x WHERE a_generation = generation)""",
        body="SELECT * FROM y WHERE state OR children OR compaction",
    ),
)
def _(spark, d):
    x = f4(spark, d).withColumn("done_stamp", F.col("stamp"))
    pairs = sm.consecutive(x, ["agent"], "ord", _TR)
    return sm.transitions(pairs, ["agent"], "ord")


@query(
    "generation_reset",
    with_ctes(
        F4_SQL,
        body="""SELECT agent, generation, count(*) AS samples, CAST(sum(output) AS BIGINT) AS output, min(ord) AS first_ord FROM f4 GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    # State restarts with the generation: it is part of the grouping key.
    return f4(spark, d).groupBy("agent", "generation").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("output").alias("output"), F.min("ord").alias("first_ord")
    )


@query(
    "revision",
    with_ctes(
        F4_SQL,
        """x AS (SELECT *, lag(status) OVER w IS DISTINCT FROM status OR lag(k // 10) OVER w IS DISTINCT FROM k // 10 AS nw FROM f4 WINDOW w AS (PARTITION BY agent ORDER BY ord))""",
        body="SELECT agent, ord, CAST(sum(nw::INT) OVER (PARTITION BY agent ORDER BY ord) AS BIGINT) AS revision FROM x",
    ),
)
def _(spark, d):
    x = f4(spark, d).selectExpr("agent", "ord", "status", "k div 10 AS k10")
    return sm.revision(x, ["agent"], "ord", ["status", "k10"]).select("agent", "ord", "revision")


@query(
    "poison_after",
    with_ctes(
        F1_SQL,
        """x AS (SELECT session_id, ord, max(mismatch::INT) OVER w = 1 AS poisoned, max(CASE WHEN bad THEN ord END) OVER w AS f,
  max(CASE WHEN p = 5 AND NOT bad THEN ord END) OVER w AS g FROM f1 WINDOW w AS (PARTITION BY session_id ORDER BY ord))""",
        body="SELECT session_id, ord, poisoned, coalesce(g > coalesce(f, -1), false) AND NOT poisoned AS last_known FROM x",
    ),
)
def _(spark, d):
    return sm.poison_after(f1(spark, d), F.col("mismatch"), F.col("bad"), F.col("p") == 5)


@query(
    "recent_context",
    with_ctes(
        F1_SQL,
        """x AS (SELECT session_id, ord, bad, list(kind) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM f1)""",
        body="SELECT session_id, ord, coalesce(array_to_string(l, ','), '') AS context FROM x WHERE bad",
    ),
)
def _(spark, d):
    return sm.recent_context(f1(spark, d).select("session_id", "ord", "kind", "bad"), F.col("bad"), "kind")


@query(
    "first_flip",
    with_ctes(
        F1_SQL,
        body=" UNION ALL ".join(
            f"SELECT session_id, '{m}' AS metric, min(ord) AS ord FROM f1 WHERE {e} GROUP BY 1" for m, e in _FAIL_SQL.items()
        ),
    ),
)
def _(spark, d):
    x = f1(spark, d)
    return sm.first_flip(x, failing_metrics(x))


@query(
    "stable_order",
    with_ctes(
        F2_SQL,
        """k AS (SELECT host, agent, min(seq) AS o, bool_or(sampled_at >= 978307200) AS cur FROM f2 GROUP BY 1, 2)""",
        body="SELECT host, agent, row_number() OVER (PARTITION BY host ORDER BY o) AS position FROM k WHERE cur",
    ),
)
def _(spark, d):
    x = f2(spark, d).select("host", "agent", "seq", "sampled_at")
    return sm.stable_order(x, "host", "agent", "seq", F.col("sampled_at") >= 978307200)


_PRES = """pr AS (SELECT DISTINCT month AS step, host, agent FROM f2),
hs AS (SELECT month AS step, host, month // 6 % 3 AS route, host % 5 <> month % 5 AS reporting FROM (SELECT DISTINCT month, host FROM f2))"""


def _presence(spark, d):
    x = f2(spark, d)
    present = x.select(F.col("month").alias("step"), "host", "agent").distinct()
    hosts = x.select("month", "host").distinct().selectExpr(
        "month AS step", "host", "month div 6 % 3 AS route", "host % 5 <> month % 5 AS reporting"
    )
    return present, hosts


@query(
    "arrivals",
    with_ctes(
        F2_SQL,
        _PRES,
        body="""SELECT step, host, agent FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr b WHERE b.step = pr.step - 1 AND b.host = pr.host AND b.agent = pr.agent)
 AND EXISTS (SELECT 1 FROM hs b JOIN hs c ON c.step = b.step + 1 AND c.host = b.host WHERE b.reporting AND b.route = c.route AND c.step = pr.step AND c.host = pr.host)""",
    ),
)
def _(spark, d):
    return sm.arrivals(*_presence(spark, d)).select("step", "host", "agent")


# ------------------------------------------------------------ acknowledgements
ACK_SQL = """th AS (SELECT agent AS thread, host, status, generation || ':' || month AS episode, sampled_at FROM (
  SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ord DESC) AS r FROM f2) WHERE r = 1),
ak AS (SELECT thread, CASE WHEN thread % 8 = 0 THEN episode ELSE 'old' END AS episode FROM th WHERE thread % 4 = 0 UNION ALL SELECT -1, 'gone')"""


def threads(spark, d):
    x = f2(spark, d).select("agent", "host", "status", "project", "generation", "month", "sampled_at", "ord")
    t = sm.latest_per_key(x, ["agent"], "ord")
    return t.select(
        F.col("agent").alias("thread"), "host", "status", "project", F.concat_ws(":", "generation", "month").alias("episode"), "sampled_at"
    )


def acks(spark, d):
    t = threads(spark, d).filter("thread % 4 = 0").selectExpr(
        "thread", "CASE WHEN thread % 8 = 0 THEN episode ELSE 'old' END AS episode"
    )
    return t.unionByName(t.sparkSession.sql("SELECT CAST(-1 AS BIGINT) AS thread, 'gone' AS episode"))


@query(
    "unacknowledged_done",
    with_ctes(
        F2_SQL,
        ACK_SQL,
        body="""SELECT thread, episode FROM th WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM ak WHERE ak.thread = th.thread AND ak.episode = th.episode)""",
    ),
)
def _(spark, d):
    return sm.unacknowledged_done(threads(spark, d), acks(spark, d)).select("thread", "episode")


@query(
    "reconcile_acks",
    with_ctes(
        F2_SQL,
        ACK_SQL,
        body="""SELECT ak.thread, ak.episode FROM ak LEFT JOIN th ON th.thread = ak.thread WHERE th.thread IS NULL OR (th.status = 'done' AND th.episode = ak.episode)""",
    ),
)
def _(spark, d):
    return sm.reconcile_acks(acks(spark, d), threads(spark, d))


@query(
    "acknowledge",
    with_ctes(
        F2_SQL,
        ACK_SQL,
        """tg AS (SELECT thread, CASE WHEN thread % 7 = 0 THEN 'older' ELSE episode END AS episode FROM th WHERE thread % 3 = 0),
ok AS (SELECT tg.* FROM tg JOIN th ON th.thread = tg.thread AND th.episode = tg.episode AND th.status = 'done')""",
        body="SELECT * FROM ok UNION ALL SELECT * FROM ak WHERE thread NOT IN (SELECT thread FROM ok)",
    ),
)
def _(spark, d):
    t = threads(spark, d)
    targets = t.filter("thread % 3 = 0").selectExpr(
        "thread", "CASE WHEN thread % 7 = 0 THEN 'older' ELSE episode END AS episode"
    )
    return sm.acknowledge(acks(spark, d), targets, t)
