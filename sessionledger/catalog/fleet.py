"""Fleet, host and thread list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F2_SQL, F6_SQL, SNAP_NOW, f2, f6, table, with_ctes
from ..functions import guards as g
from ..operators import fleet as fl
from ..operators import samples as sm
from .registry import query
from .samples import ACK_SQL, acks, threads


# ------------------------------------------------------------------ inventory
def _inv(where_dup: str):
    return f"""i AS (SELECT CASE WHEN {where_dup} THEN 'p1' ELSE id END AS id, target, label, enabled FROM f6),
per AS (SELECT id, count(*) AS n, bool_and(regexp_full_match(id, '[A-Za-z0-9_-]+') AND length(id) <= 40 AND regexp_full_match(target, '[A-Za-z0-9_.@:][A-Za-z0-9_.@:-]*')
   AND length(target) <= 1024 AND enabled IS NOT NULL) AS ok FROM i GROUP BY 1),
v AS (SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (NOT ok) AS invalid FROM per)"""


@query("inventory_checks", with_ctes(F6_SQL, _inv("num % 10 = 1"), body="SELECT *, duplicates = 0 AND invalid = 0 AS accepted FROM v"))
def _(spark, d):
    x = f6(spark, d).withColumn("id", F.expr("CASE WHEN num % 10 = 1 THEN 'p1' ELSE id END"))
    return fl.inventory_checks(x)


@query("inventory_limit", with_ctes(F6_SQL, _inv("false"), body="SELECT *, duplicates = 0 AND invalid = 0 AND rows <= 64 AS accepted FROM v"))
def _(spark, d):
    return fl.inventory_checks(f6(spark, d), limit=64)


CONFIG_SQL = """cfg AS (SELECT 'h' || s_suppkey AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'p' || s_suppkey END AS profile_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'local' ELSE 'ssh' END AS transport, 'own-' || (s_suppkey % 30) AS target, 'default' AS session, 'L' AS label FROM supplier WHERE s_suppkey % 2 = 0),
pf AS (SELECT id AS profile_id, target, session, label FROM f6 WHERE enabled),
eff AS (SELECT * FROM cfg WHERE profile_id IS NULL
 UNION ALL SELECT host, cfg.profile_id, 'ssh', pf.target, pf.session, pf.label FROM cfg JOIN pf ON cfg.profile_id = pf.profile_id
 UNION ALL SELECT profile_id, profile_id, 'ssh', target, session, label FROM pf WHERE profile_id NOT IN (SELECT profile_id FROM cfg WHERE profile_id IS NOT NULL))"""


def config(spark, d):
    return table(spark, d, "supplier").filter("s_suppkey % 2 = 0").selectExpr(
        "concat('h', CAST(s_suppkey AS STRING)) AS host",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat('p', CAST(s_suppkey AS STRING)) END AS profile_id",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'local' ELSE 'ssh' END AS transport",
        "concat('own-', CAST(s_suppkey % 30 AS STRING)) AS target",
        "'default' AS session",
        "'L' AS label",
    )


@query("effective_fleet", with_ctes(F6_SQL, CONFIG_SQL, body="SELECT host, profile_id, transport, target, session, label FROM eff"))
def _(spark, d):
    return fl.effective_fleet(config(spark, d), f6(spark, d))


@query("ambiguous_routes", with_ctes(F6_SQL, CONFIG_SQL, body="SELECT target, session, count(*) AS hosts FROM eff WHERE transport = 'ssh' GROUP BY 1, 2 HAVING count(*) > 1"))
def _(spark, d):
    eff = fl.effective_fleet(config(spark, d), f6(spark, d))
    return fl.ambiguous_routes(eff.filter("transport = 'ssh'"))


@query("fleet_union", with_ctes(F6_SQL, CONFIG_SQL, body="SELECT host, target, label FROM cfg UNION ALL SELECT id, target, NULL FROM f6 WHERE enabled"))
def _(spark, d):
    found = f6(spark, d).filter("enabled").select(F.col("id").alias("host"), "target")
    return fl.fleet_union(config(spark, d).select("host", "target", "label"), found)


@query("distinct_targets", with_ctes(F6_SQL, CONFIG_SQL, body="SELECT DISTINCT target FROM (SELECT target FROM f6 UNION ALL SELECT target FROM eff WHERE transport = 'ssh')"))
def _(spark, d):
    inv = f6(spark, d)
    return fl.distinct_targets(inv, fl.effective_fleet(config(spark, d), inv))


MONTH_SQL = """mk AS (SELECT DISTINCT month, agent AS key, host % 4 + month // 12 % 2 AS route FROM f2)"""


def _month_keys(spark, d):
    return f2(spark, d).selectExpr("month", "agent AS key", "host % 4 + month div 12 % 2 AS route").distinct()


@query(
    "retired_keys",
    with_ctes(
        F2_SQL,
        MONTH_SQL,
        body="""SELECT key, route FROM (SELECT DISTINCT key, route FROM mk WHERE month % 2 = 0) a WHERE NOT EXISTS (SELECT 1 FROM mk b WHERE b.month % 2 = 1 AND b.key = a.key AND b.route = a.route)""",
    ),
)
def _(spark, d):
    x = _month_keys(spark, d)
    before = x.filter("month % 2 = 0").select("key", "route").distinct()
    return fl.retired_keys(before, x.filter("month % 2 = 1"))


@query(
    "surviving_keys",
    with_ctes(F2_SQL, MONTH_SQL, body="SELECT key FROM mk WHERE month % 2 = 0 INTERSECT SELECT key FROM mk WHERE month % 2 = 1"),
)
def _(spark, d):
    x = _month_keys(spark, d)
    return fl.surviving_keys(x.filter("month % 2 = 0"), x.filter("month % 2 = 1"))


@query(
    "coverage_subset",
    with_ctes(
        F2_SQL,
        """ret AS (SELECT DISTINCT agent % 97 AS host, agent AS key FROM f2 WHERE status <> 'blocked'), req AS (SELECT DISTINCT agent % 97 AS host, agent AS key FROM f2 WHERE seq % 50 > 0),
pan AS (SELECT DISTINCT agent % 97 AS host, agent AS key FROM f2 WHERE status = 'done'),
hs AS (SELECT host FROM ret UNION SELECT host FROM pan)""",
        body="""SELECT host, NOT EXISTS (SELECT 1 FROM ret WHERE ret.host = hs.host AND NOT EXISTS (SELECT 1 FROM req WHERE req.host = ret.host AND req.key = ret.key))
 AND NOT EXISTS (SELECT 1 FROM pan WHERE pan.host = hs.host AND NOT EXISTS (SELECT 1 FROM ret WHERE ret.host = pan.host AND ret.key = pan.key)) AS covered FROM hs""",
    ),
)
def _(spark, d):
    x = f2(spark, d).selectExpr("agent % 97 AS host", "agent AS key", "status", "seq")
    keys = lambda w: x.filter(w).select("host", "key").distinct()
    return fl.coverage_subset(keys("status <> 'blocked'"), keys("seq % 50 > 0"), keys("status = 'done'"))


# ---------------------------------------------------------------------- joins
@query(
    "join_workspace",
    with_ctes(
        F2_SQL,
        """ws AS (SELECT c_custkey % 16 AS host, c_custkey % 200 AS workspace_id, first(CASE WHEN c_custkey % 9 <> 0 THEN c_name || chr(9) || c_mktsegment END ORDER BY c_custkey) AS l
   FROM customer GROUP BY 1, 2)""",
        body="""SELECT seq, substr(regexp_replace(coalesce(l, 'Untitled'), '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 160) AS label FROM f2
 LEFT JOIN ws ON ws.host = f2.host AND ws.workspace_id = f2.agent % 200""",
    ),
)
def _(spark, d):
    ws = table(spark, d, "customer").selectExpr(
        "c_custkey % 16 AS host", "c_custkey % 200 AS workspace_id", "CASE WHEN c_custkey % 9 <> 0 THEN concat(c_name, '\\t', c_mktsegment) END AS label", "c_custkey AS ord"
    )
    a = f2(spark, d).selectExpr("seq", "host", "agent % 200 AS workspace_id")
    return fl.join_workspace(a, ws).select("seq", "label")


@query(
    "bind_session",
    """WITH u AS (SELECT sha256('agent:id:' || user_id) AS binding, count(*) AS events, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS output FROM events GROUP BY 1)
SELECT o_orderkey, binding, events, output FROM orders JOIN u ON u.binding = sha256('agent:id:' || o_custkey) WHERE o_orderkey % 5 <> 0""",
)
def _(spark, d):
    ev = table(spark, d, "events")
    sessions = (
        ev.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("output"))
        .select(F.sha2(F.concat(F.lit("agent:id:"), F.col("user_id").cast("string")), 256).alias("binding"), "events", "output")
    )
    agents = table(spark, d, "orders").select(
        "o_orderkey",
        F.lit("agent").alias("harness"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'source:other' ELSE 'source:agent' END").alias("source"),
        F.lit("id").alias("kind"),
        F.col("o_custkey").cast("string").alias("value"),
    )
    return fl.bind_session(agents, sessions).select("o_orderkey", "binding", "events", "output")


_P = """CASE page_id % 4 WHEN 0 THEN concat('/', split_part(split_part(url, '//', 2), '?', 1)) WHEN 1 THEN concat('/srv/', split_part(split_part(url, '//', 2), '#', 1), '/..')
 WHEN 2 THEN url ELSE concat('//', split_part(split_part(url, '//', 2), '?', 1), '/') END"""
_ROOT = "concat('/', split_part(split_part(split_part(url, '//', 2), '?', 1), '/', 1), CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END)"


@query(
    "path_category",
    f"""WITH a AS (SELECT page_id AS agent, page_id % 3 AS host, {_P} AS path FROM pages), r AS (SELECT DISTINCT page_id % 3 AS host, rtrim({_ROOT}, '/') AS root, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS rk FROM pages),
n AS (SELECT agent, host, path, path LIKE '/%' AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AS ok, '/' || trim(path, '/') AS norm FROM a)
SELECT agent, n.host, path, CASE WHEN min(rk) = 1 THEN 'work' ELSE 'personal' END AS category FROM n
LEFT JOIN r ON ok AND r.host = n.host AND (norm = root OR starts_with(norm, root || '/')) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    p = table(spark, d, "pages")
    a = p.select(F.col("page_id").alias("agent"), F.expr("page_id % 3").alias("host"), F.expr(_P).alias("path"))
    r = p.select(
        F.expr("page_id % 3").alias("host"), F.expr(_ROOT).alias("root"), F.expr("CASE WHEN page_id % 5 = 0 THEN 'personal' ELSE 'work' END").alias("category")
    )
    return fl.path_category(a, r.distinct())


# ------------------------------------------------------------------- liveness
DAY = 86400
HOST_SQL = f"""hn AS (SELECT host, max(sampled_at) AS sampled_at, host % 7 <> 3 AS online, CASE host % 11 WHEN 5 THEN 'setup_needed' WHEN 6 THEN 'connecting' ELSE 'connected' END AS connection_state FROM f2 GROUP BY 1),
hr AS (SELECT *, connection_state <> 'setup_needed' AND coalesce(online AND {SNAP_NOW} - sampled_at < 60 * {DAY}, false) AS reporting FROM hn)"""


def hosts(spark, d):
    h = (
        f2(spark, d)
        .groupBy("host")
        .agg(F.max("sampled_at").alias("sampled_at"))
        .selectExpr("*", "host % 7 <> 3 AS online", "CASE host % 11 WHEN 5 THEN 'setup_needed' WHEN 6 THEN 'connecting' ELSE 'connected' END AS connection_state")
    )
    return fl.host_reporting(h, SNAP_NOW, F.lit(60 * DAY))


@query(
    "host_reporting",
    with_ctes(
        F2_SQL,
        HOST_SQL,
        body="""SELECT host, sampled_at, reporting, CASE WHEN connection_state = 'setup_needed' THEN 'setup_needed' WHEN connection_state = 'connecting' THEN 'connecting' WHEN reporting THEN 'connected' ELSE 'unreachable' END AS connection FROM hr""",
    ),
)
def _(spark, d):
    return hosts(spark, d).select("host", "sampled_at", "reporting", "connection")


@query(
    "sample_guard",
    with_ctes(
        F2_SQL,
        f"""a AS (SELECT seq, host, sampled_at, CASE WHEN seq % 997 = 0 THEN -1 ELSE host END AS agent_host FROM f2),
ok AS (SELECT host, sampled_at FROM a GROUP BY 1, 2 HAVING sampled_at BETWEEN 1 AND {SNAP_NOW - 400 * DAY} + 1 AND NOT bool_or(agent_host <> host))""",
        body="SELECT seq, a.host, a.sampled_at FROM a JOIN ok ON ok.host = a.host AND ok.sampled_at = a.sampled_at",
    ),
)
def _(spark, d):
    a = f2(spark, d).selectExpr("seq", "host", "sampled_at", "CASE WHEN seq % 997 = 0 THEN -1 ELSE host END AS agent_host")
    return fl.sample_guard(a, SNAP_NOW - 400 * DAY).select("seq", "host", "sampled_at")


@query(
    "liveness_gaps",
    with_ctes(
        F2_SQL,
        f"""dd AS (SELECT host, sampled_at, count(*) AS n FROM f2 GROUP BY 1, 2),
x AS (SELECT *, coalesce(sampled_at - lag(sampled_at) OVER (PARTITION BY host ORDER BY sampled_at) > {4 * DAY}, true) AS nw FROM dd),
y AS (SELECT *, sum(nw::INT) OVER (PARTITION BY host ORDER BY sampled_at) AS stretch FROM x)""",
        body=f"SELECT host, CAST(stretch AS BIGINT) AS stretch, min(sampled_at) AS live_from, max(sampled_at) AS last_seen, max(sampled_at) + {4 * DAY} AS unreachable_at, CAST(sum(n) AS BIGINT) AS samples FROM y GROUP BY 1, 2",
    ),
)
def _(spark, d):
    return fl.liveness_gaps(f2(spark, d).select("host", "sampled_at"), 4 * DAY)


# -------------------------------------------------------------------- reports
@query(
    "fleet_counts",
    with_ctes(
        F2_SQL,
        HOST_SQL,
        ACK_SQL,
        """c AS (SELECT count(*) FILTER (reporting) AS rp, count(*) FILTER (NOT reporting) AS missing FROM hr),
w AS (SELECT count(*) AS w FROM th JOIN hr ON th.host = hr.host WHERE reporting AND status = 'working')""",
        body="""SELECT CASE WHEN rp > 0 THEN w END AS working, missing, missing > 0 AS partial,
 CASE WHEN rp = 0 THEN 'No sources reporting' WHEN missing = 1 THEN '1 source unavailable' WHEN missing > 1 THEN missing || ' sources unavailable' ELSE 'All sources reporting' END AS note FROM c, w""",
    ),
)
def _(spark, d):
    return fl.fleet_counts(hosts(spark, d), threads(spark, d))


@query(
    "dominant_state",
    with_ctes(
        F2_SQL,
        ACK_SQL,
        """j AS (SELECT th.thread // 3 AS grp, CASE WHEN status = 'blocked' THEN 3 WHEN status = 'working' THEN 2 WHEN status = 'done' AND ak.thread IS NULL THEN 1 ELSE 0 END AS r
  FROM th LEFT JOIN ak ON ak.thread = th.thread AND ak.episode = th.episode)""",
        body="SELECT grp, CASE max(r) WHEN 3 THEN 'blocked' WHEN 2 THEN 'working' WHEN 1 THEN 'done' ELSE 'idle' END AS state FROM j GROUP BY 1",
    ),
)
def _(spark, d):
    t = threads(spark, d).withColumn("grp", F.expr("thread div 3"))
    return fl.dominant_state(t, acks(spark, d), "grp")


@query(
    "diagnostics",
    with_ctes(
        F2_SQL,
        ACK_SQL,
        """t AS (SELECT CASE WHEN thread % 3 > 0 THEN thread END AS input_tokens, CASE WHEN thread % 4 > 0 THEN thread END AS elapsed, thread % 5 = 0 AS active,
  CASE WHEN thread % 6 > 0 THEN thread % 6 = 1 END AS stale, CASE WHEN thread % 7 > 0 THEN 1 END AS total FROM th)""",
        body="""SELECT count(*) AS threads, count(input_tokens) AS usage_reported, count(elapsed) AS timing_reported, count(*) FILTER (active AND NOT stale AND elapsed IS NOT NULL) AS timing_current,
 count(total) AS timing_totals, count(*) FILTER (stale) AS timing_stale FROM t""",
    ),
)
def _(spark, d):
    t = threads(spark, d).selectExpr(
        "CASE WHEN thread % 3 > 0 THEN thread END AS input_tokens",
        "CASE WHEN thread % 4 > 0 THEN thread END AS elapsed",
        "thread % 5 = 0 AS active",
        "CASE WHEN thread % 6 > 0 THEN thread % 6 = 1 END AS stale",
        "CASE WHEN thread % 7 > 0 THEN 1 END AS total",
    )
    return fl.diagnostics(t)


@query(
    "group_by_host",
    with_ctes(
        F2_SQL,
        HOST_SQL,
        ACK_SQL,
        """t AS (SELECT host, count(*) AS t, count(*) FILTER (status <> 'done') AS m FROM th GROUP BY 1)""",
        body="""SELECT hr.host, CASE WHEN reporting THEN coalesce(t, 0) ELSE 0 END AS total, CASE WHEN reporting THEN coalesce(m, 0) ELSE 0 END AS matching, hr.host % 4 = 2 AS collapsed,
 CASE WHEN reporting AND hr.host % 4 <> 2 THEN coalesce(m, 0) ELSE 0 END AS shown FROM hr LEFT JOIN t ON t.host = hr.host""",
    ),
)
def _(spark, d):
    return fl.group_by_host(threads(spark, d), hosts(spark, d), ["done"], F.col("host") % 4 == 2)


@query(
    "visible_rows",
    with_ctes(
        F2_SQL,
        HOST_SQL,
        ACK_SQL,
        body="SELECT th.host, thread, status FROM th JOIN hr ON hr.host = th.host WHERE status <> 'done' AND reporting AND th.host % 4 <> 2",
    ),
)
def _(spark, d):
    shown = fl.visible_rows(threads(spark, d), hosts(spark, d), ["done"], F.col("host") % 4 == 2)
    return fl.thread_order(shown, "thread").select("host", "thread", "status")


@query("thread_order", with_ctes(F2_SQL, ACK_SQL, body="SELECT thread, status FROM th"))
def _(spark, d):
    return fl.thread_order(threads(spark, d), "thread").select("thread", "status")


@query(
    "per_host_head",
    with_ctes(F2_SQL, body="SELECT host, agent, seq, position FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS position FROM f2) WHERE position <= 32"),
)
def _(spark, d):
    x = fl.per_host_head(f2(spark, d).select("host", "agent", "seq", "ord"))
    return x.select("host", "agent", "seq", F.col("position").cast("long").alias("position"))


@query("bounded_keys", with_ctes(F2_SQL, ACK_SQL, body="SELECT thread, episode FROM ak ORDER BY thread DESC LIMIT 256"))
def _(spark, d):
    return fl.bounded_keys(acks(spark, d), "thread")


@query(
    "checkout_leaf",
    f"""WITH x AS (SELECT page_id, {_P} AS wt, concat('/home/u', page_id % 7, '/src') AS cwd, page_id % 2 AS a, page_id % 3 % 2 AS b FROM pages),
y AS (SELECT *, CASE WHEN wt LIKE '/%' AND NOT regexp_matches(wt, '(^|/)\\.\\.(/|$)') THEN substr(list_last(string_split(rtrim(wt, '/'), '/')), 1, 80) ELSE '' END AS leaf FROM x)
SELECT page_id, CASE WHEN a = b AND leaf <> '' THEN CASE WHEN contains(leaf, '\\') OR leaf IN ('.', '..') THEN '' ELSE leaf END ELSE 'src' END AS leaf FROM y""",
)
def _(spark, d):
    x = table(spark, d, "pages").select(
        "page_id", F.expr(_P).alias("wt"), F.expr("concat('/home/u', CAST(page_id % 7 AS STRING), '/src')").alias("cwd"),
        F.expr("page_id % 2").alias("a"), F.expr("page_id % 3 % 2").alias("b"),
    )
    return x.select("page_id", g.checkout_leaf(F.col("wt"), F.col("a"), F.col("cwd"), F.col("b")).alias("leaf"))
