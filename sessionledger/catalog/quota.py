"""Quota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F3_SQL, QUOTA_NOW, f3, table, with_ctes
from ..functions import labels as lb
from ..functions import scalars as sc
from ..operators import fleet as fl
from ..operators import quota as q
from .registry import query

DAY = 86400
FRESH = 365 * DAY
PLAN_LIST = ", ".join(f"'{p}'" for p in q.PLANS)

SAN_SQL = f"""s0 AS (SELECT *, 100 - used AS weekly_remaining FROM f3 WHERE sampled_at > 0 AND {QUOTA_NOW} - sampled_at BETWEEN -1 AND {FRESH}),
s1 AS (SELECT * REPLACE (CASE WHEN plan IN ({PLAN_LIST}) THEN plan END AS plan, CASE WHEN weekly_remaining BETWEEN 0 AND 100 THEN weekly_remaining END AS weekly_remaining,
  CASE WHEN reset_count BETWEEN 0 AND 10000 THEN reset_count END AS reset_count) FROM s0),
sn AS (SELECT seq, account_key, provider, sampled_at, plan, lifetime_tokens, peak_daily_tokens, CASE WHEN resets_at > {QUOTA_NOW} THEN weekly_remaining END AS weekly_remaining,
  CASE WHEN resets_at > {QUOTA_NOW} THEN resets_at END AS weekly_resets_at, CASE WHEN coalesce(reset_expires_at > {QUOTA_NOW}, true) THEN reset_count END AS reset_count,
  CASE WHEN coalesce(reset_expires_at > {QUOTA_NOW}, true) THEN reset_expires_at END AS reset_expires_at FROM s1)"""
_SAN = ["seq", "account_key", "provider", "sampled_at", "plan", "lifetime_tokens", "peak_daily_tokens", "weekly_remaining", "weekly_resets_at", "reset_count", "reset_expires_at"]


def sanitised(spark, d):
    x = f3(spark, d).withColumn("weekly_remaining", F.expr("100 - used")).withColumnRenamed("resets_at", "weekly_resets_at")
    return q.quota_sanitise(x, QUOTA_NOW, FRESH).select(*_SAN)


def accounts(spark, d):
    return table(spark, d, "customer").filter("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("account_key"), F.lower("c_mktsegment").alias("provider"), F.col("c_name").alias("label"), (F.col("c_custkey") * 7 % 1009).alias("position")
    )


@query("quota_sanitise", with_ctes(F3_SQL, SAN_SQL, body="SELECT " + ", ".join(_SAN) + " FROM sn"))
def _(spark, d):
    return sanitised(spark, d)


NEW_SQL = """nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY sampled_at DESC, seq) AS r FROM sn) WHERE r = 1)"""


@query("newest_per_account", with_ctes(F3_SQL, SAN_SQL, NEW_SQL, body="SELECT account_key, seq, sampled_at, weekly_remaining FROM nw"))
def _(spark, d):
    return q.newest_per_account(sanitised(spark, d)).select("account_key", "seq", "sampled_at", "weekly_remaining")


@query(
    "all_observations",
    with_ctes(
        F3_SQL,
        SAN_SQL,
        """u AS (SELECT seq, account_key, sampled_at, plan FROM sn UNION ALL SELECT seq, account_key, sampled_at, NULL FROM sn)""",
        body="SELECT account_key, seq, sampled_at, plan FROM u",
    ),
)
def _(spark, d):
    s = sanitised(spark, d).select("account_key", "seq", "sampled_at", "plan")
    return q.all_observations(s, s.drop("plan"))


ROWS_SQL = f"""ac AS (SELECT c_custkey AS account_key, lower(c_mktsegment) AS provider, c_name AS label, c_custkey * 7 % 1009 AS position FROM customer WHERE c_custkey % 3 = 0),
rw AS (SELECT ac.account_key, ac.provider, ac.label, CASE WHEN nw.sampled_at IS NOT NULL THEN 'available' ELSE 'unavailable' END AS status, plan, sampled_at, reset_count, reset_expires_at,
  CASE WHEN sampled_at IS NOT NULL THEN 100 - weekly_remaining END AS used_percent, weekly_resets_at AS resets_at, CASE WHEN sampled_at IS NOT NULL THEN CAST({q.WEEK_S} AS BIGINT) END AS duration_s
  FROM ac LEFT JOIN nw ON nw.account_key = ac.account_key)"""


def rows(spark, d):
    return q.account_rows(accounts(spark, d).drop("position"), sanitised(spark, d).drop("provider"))


@query("account_rows", with_ctes(F3_SQL, SAN_SQL, NEW_SQL, ROWS_SQL, body="SELECT * FROM rw"))
def _(spark, d):
    return rows(spark, d)


@query("account_order", with_ctes(F3_SQL, SAN_SQL, NEW_SQL, ROWS_SQL, body="SELECT account_key, status FROM rw"))
def _(spark, d):
    return q.account_order(rows(spark, d)).select("account_key", "status")


# The pace view uses the fixture's own long windows.
VIEW_SQL = f"""vw AS (SELECT account_key, status, CASE WHEN resets_at > {QUOTA_NOW} THEN 100 - used_percent END AS remaining,
   CASE WHEN resets_at > {QUOTA_NOW} AND resets_at - {QUOTA_NOW} <= {400 * DAY} THEN (resets_at - {QUOTA_NOW}) * 100.0::DOUBLE / {400 * DAY} END AS tr,
   CASE WHEN resets_at > {QUOTA_NOW} THEN resets_at END AS reset_at, CASE WHEN coalesce(reset_expires_at > {QUOTA_NOW}, true) THEN reset_count END AS reset_count FROM rw),
pv AS (SELECT *, floor(abs(remaining - tr) * 10 + 1e-9 + 0.5) / 10 AS m FROM vw),
pr AS (SELECT *, CASE WHEN remaining - tr < 0 AND m <> 0 THEN -m ELSE m END AS pace FROM pv)"""


def views(spark, d):
    r = rows(spark, d).withColumn("duration_s", F.when(F.col("duration_s").isNotNull(), F.lit(400 * DAY)))
    # Only a year-long window can hold the fixture's resets.
    r = r.withColumn("duration_s", F.least(F.col("duration_s"), F.lit(31_622_400)))
    return q.account_view(r, QUOTA_NOW, FRESH)


@query(
    "account_pace",
    with_ctes(F3_SQL, SAN_SQL, NEW_SQL, ROWS_SQL, VIEW_SQL.replace(str(400 * DAY), "31622400"), body="""SELECT account_key, remaining, round(tr, 6) AS time_remaining, round(pace, 6) AS pace,
 CASE WHEN pace IS NULL THEN 'unknown' WHEN pace >= 0 THEN 'surplus' WHEN pace >= -5 THEN 'caution' WHEN pace > -10 THEN 'warning' ELSE 'deficit' END AS band, reset_count, reset_at FROM pr"""),
)
def _(spark, d):
    return views(spark, d).select(
        "account_key", "remaining", F.round("time_remaining", 6).alias("time_remaining"), F.round("pace", 6).alias("pace"), "band", "reset_count", "reset_at"
    )


@query(
    "account_report",
    with_ctes(F3_SQL, SAN_SQL, NEW_SQL, ROWS_SQL, VIEW_SQL.replace(str(400 * DAY), "31622400"), body="""SELECT account_key,
 CASE WHEN pace IS NULL THEN '—' ELSE CASE WHEN pace > 0 THEN '+' WHEN pace < 0 THEN '−' ELSE '' END || CAST(floor(abs(pace) * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(abs(pace) * 10 + 0.5) AS BIGINT) % 10 || '%' END AS pace,
 CASE WHEN remaining IS NULL OR tr IS NULL THEN 'Pace unavailable' ELSE remaining || '% left · ' || CAST(floor(tr * 10 + 0.5) AS BIGINT) // 10 || CASE WHEN CAST(floor(tr * 10 + 0.5) AS BIGINT) % 10 = 0 THEN '' ELSE '.' || CAST(floor(tr * 10 + 0.5) AS BIGINT) % 10 END || '% expected' END AS pace_text FROM pr"""),
)
def _(spark, d):
    return views(spark, d).select(
        "account_key", lb.pace_label(F.col("pace")).alias("pace"), lb.pace_text(F.col("remaining"), F.col("time_remaining")).alias("pace_text")
    )


@query(
    "pace_reading",
    f"""WITH x AS (SELECT o_orderkey, (o_orderkey % 401) / 20.0::DOUBLE - 10 AS dlt FROM orders), y AS (SELECT *, floor(abs(dlt) * 10 + 1e-9 + 0.5) / 10 AS m FROM x),
z AS (SELECT o_orderkey, CASE WHEN dlt < 0 AND m <> 0 THEN -m ELSE m END AS pace FROM y)
SELECT o_orderkey, round(pace, 6) AS pace, CASE WHEN pace >= 0 THEN 'surplus' WHEN pace >= -5 THEN 'caution' WHEN pace > -10 THEN 'warning' ELSE 'deficit' END AS band FROM z""",
)
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.expr("(o_orderkey % 401) / 20.0D - 10D").alias("dlt"))
    pace = sc.pace_reading(F.col("dlt"))
    return x.select("o_orderkey", F.round(pace, 6).alias("pace"), sc.pace_band(pace).alias("band"))


_WIN = """CASE WHEN o_orderkey % 10 = 9 THEN 'BAD KIND' ELSE 'weekly' END"""


@query(
    "pacing_window",
    f"""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS n, o_orderkey % 3 = 0 AS p1, o_orderkey % 4 = 0 AS p2, {_WIN} AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 604800 END AS dur FROM orders),
y AS (SELECT *, CASE WHEN p1 AND NOT (p2 AND n > 1) AND n > 0 THEN 1 WHEN p2 AND n > 1 AND NOT p1 THEN 2 END AS pick FROM x)
SELECT o_orderkey, CASE WHEN pick = 1 AND kind = 'weekly' AND dur >= 1 THEN o_orderkey % 101 WHEN pick = 2 THEN o_orderkey % 77 END AS used_percent FROM y""",
)
def _(spark, d):
    w = lambda kind, pacing, used, dur: F.struct(
        kind.alias("kind"), F.lit("Label").alias("label"), used.alias("used_percent"), dur.alias("duration_s"), pacing.alias("pacing")
    )
    k = F.col("o_orderkey")
    two = F.array(
        w(F.expr(_WIN), k % 3 == 0, k % 101, F.when(k % 7 == 0, 0).otherwise(604800)),
        w(F.lit("daily"), k % 4 == 0, k % 77, F.lit(86400)),
    )
    x = table(spark, d, "orders").select("o_orderkey", F.slice(two, F.lit(1), F.least(k % 5, F.lit(2)).cast("int")).alias("ws"))
    return x.select("o_orderkey", sc.pacing_window(F.col("ws")).used_percent.alias("used_percent"))


@query("account_activity", with_ctes(F3_SQL, SAN_SQL, NEW_SQL, body="SELECT account_key, lifetime_tokens, peak_daily_tokens FROM nw"))
def _(spark, d):
    return q.account_activity(sanitised(spark, d))


@query("top_accounts", with_ctes(F3_SQL, SAN_SQL, NEW_SQL, body="SELECT account_key, sampled_at FROM nw ORDER BY sampled_at DESC, seq LIMIT 4"))
def _(spark, d):
    return q.top_accounts(q.newest_per_account(sanitised(spark, d))).select("account_key", "sampled_at")


@query(
    "daily_usage",
    """WITH x AS (SELECT o_custkey AS account_key, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE o_orderkey % 1000 END AS t, o_orderkey FROM orders),
y AS (SELECT account_key, CASE WHEN day <= DATE '2001-07-01' THEN day END AS day, t FROM x),
v AS (SELECT account_key FROM (SELECT account_key, day, count(*) AS n, count(*) FILTER (t IS NULL) AS b FROM y GROUP BY 1, 2) GROUP BY 1 HAVING NOT bool_or(n > 1 OR day IS NULL OR b > 0))
SELECT account_key, CAST(day AS VARCHAR) AS date, t AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY day DESC) AS r FROM y WHERE account_key IN (SELECT account_key FROM v)) WHERE r <= 30""",
)
def _(spark, d):
    x = table(spark, d, "orders").select(
        F.col("o_custkey").alias("account_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.expr("CASE WHEN o_orderkey % 301 = 0 THEN 'true' ELSE CAST(o_orderkey % 1000 AS STRING) END").alias("tokens"),
    )
    return q.daily_usage(x, "2001-07-01")


@query(
    "last_days",
    """WITH y AS (SELECT DISTINCT o_custkey AS account_key, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT account_key, CAST(day AS VARCHAR) AS date FROM (SELECT *, row_number() OVER (PARTITION BY account_key ORDER BY day DESC) AS r FROM y) WHERE r <= 5""",
)
def _(spark, d):
    x = table(spark, d, "orders").select(
        F.col("o_custkey").alias("account_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("1").alias("tokens")
    )
    return q.daily_usage(x.distinct(), "2001-08-02", k=5, cap=None).select("account_key", "date")


@query(
    "group_by_provider",
    with_ctes(F3_SQL, SAN_SQL, NEW_SQL, ROWS_SQL, body="SELECT rw.provider, min(position) AS first_position, count(*) AS accounts, count(*) FILTER (status = 'available') AS available FROM rw JOIN ac ON ac.account_key = rw.account_key GROUP BY 1"),
)
def _(spark, d):
    r = rows(spark, d).join(accounts(spark, d).select("account_key", "position"), "account_key")
    return fl.group_by_provider(r)


@query(
    "identity_map",
    """WITH x AS (SELECT o_custkey AS account_key, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || o_orderkey || '@mail.org' WHEN o_orderkey % 3 = 1 THEN 'nobody' ELSE 'a b@c.d' END AS email FROM orders)
SELECT account_key, arg_max(email, seq) AS email FROM x WHERE seq % 3 = 0 AND account_key IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1""",
)
def _(spark, d):
    x = table(spark, d, "orders").selectExpr(
        "o_custkey AS account_key", "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('u', CAST(o_orderkey AS STRING), '@mail.org') WHEN o_orderkey % 3 = 1 THEN 'nobody' ELSE 'a b@c.d' END AS email",
    )
    return q.identity_map(x, accounts(spark, d))


# ---------------------------------------------------------------- raw replies
def replies(spark, d):
    """Rate-limit replies as JSON text, one per order."""
    k = "o_orderkey"
    win = lambda mins, used, reset: (
        f"concat('{{\"windowDurationMins\":', {mins}, ',\"usedPercent\":', {used}, ',\"resetsAt\":', {reset}, '}}')"
    )
    used = f"CASE {k} % 5 WHEN 0 THEN 'true' WHEN 1 THEN '12.5' ELSE CAST({k} % 130 AS STRING) END"
    reset = f"CAST(unix_date(CAST(o_orderdate AS DATE)) * 86400 + {k} % 2500 * 86400 AS STRING)"
    primary = win(f"CASE WHEN {k} % 3 = 0 THEN '300' ELSE '10080' END", used, reset)
    secondary = win(f"CASE WHEN {k} % 4 = 0 THEN '10080' ELSE '60' END", "'40'", "'996800000'")
    bucket = f"concat('{{\"limitId\":', CASE WHEN {k} % 11 = 0 THEN '\"other\"' WHEN {k} % 11 = 1 THEN 'null' ELSE '\"codex\"' END, ',\"planType\":\"', CASE WHEN {k} % 2 = 0 THEN 'pro' ELSE 'gold' END, '\",\"primary\":', {primary}, ',\"secondary\":', {secondary}, '}}')"
    named = f"CASE WHEN {k} % 6 = 0 THEN concat('\"rateLimitsByLimitId\":{{\"codex\":', {bucket}, '}},\"rateLimits\":null') ELSE concat('\"rateLimits\":', {bucket}) END"
    credit = lambda i: (
        f"concat('{{\"id\":\"', CASE WHEN {k} % 7 = 0 THEN 'same' ELSE 'c{i}' END, '\",\"status\":\"', CASE WHEN ({k} + {i}) % 4 = 0 THEN 'used' ELSE 'available' END, '\",\"resetType\":\"codexRateLimits\",\"expiresAt\":', CASE WHEN ({k} + {i}) % 9 = 0 THEN 'null' ELSE CAST({QUOTA_NOW} + ({k} % 97 - 3) * 86400 * ({i} + 1) AS STRING) END, '}}')"
    )
    credits = f"concat('{{\"availableCount\":', CAST({k} % 3 AS STRING), ',\"credits\":[', {credit(0)}, ',', {credit(1)}, ']}}')"
    text = f"concat('{{\"accountId\":\"a', CAST(o_custkey AS STRING), '\",', {named}, ',\"rateLimitResetCredits\":', {credits}, '}}')"
    return table(spark, d, "orders").select(F.col(k).alias("seq"), F.expr(text.replace("{{", "{").replace("}}", "}")).alias("reply"))


def parsed(spark, d):
    return replies(spark, d).select("seq", q.parse_reply(F.col("reply")).alias("r"))


@query(
    "read_quota",
    f"""WITH x AS (SELECT o_orderkey AS seq, o_custkey, o_orderkey % 3 > 0 AS p, o_orderkey % 4 = 0 AS s, CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 130 <= 100 THEN o_orderkey % 130 END AS pu,
   epoch(o_orderdate)::BIGINT + o_orderkey % 2500 * 86400 AS pr FROM orders WHERE o_orderkey % 11 <> 0),
y AS (SELECT *, CASE WHEN p AND NOT s THEN pu WHEN s AND NOT p THEN 40 END AS u, CASE WHEN p AND NOT s THEN pr WHEN s AND NOT p THEN 996800000 END AS r FROM x)
SELECT seq, 'a' || o_custkey AS account, sha256('account-v1:a' || o_custkey) AS account_key, CASE WHEN seq % 2 = 0 THEN 'pro' END AS plan,
 CASE WHEN u IS NOT NULL AND r > {QUOTA_NOW} THEN 100 - u END AS weekly_remaining, CASE WHEN u IS NOT NULL AND r > {QUOTA_NOW} THEN r END AS weekly_resets_at FROM y""",
)
def _(spark, d):
    return q.read_quota(parsed(spark, d), QUOTA_NOW)


@query(
    "credits_summary",
    f"""WITH x AS (SELECT o_orderkey AS seq, o_orderkey % 3 AS n, o_orderkey % 4 > 0 AS a0, (o_orderkey + 1) % 4 > 0 AS a1,
  CASE WHEN o_orderkey % 9 > 0 THEN {QUOTA_NOW} + (o_orderkey % 97 - 3) * 86400 END AS e0, CASE WHEN (o_orderkey + 1) % 9 > 0 THEN {QUOTA_NOW} + (o_orderkey % 97 - 3) * 86400 * 2 END AS e1 FROM orders),
y AS (SELECT *, a0::INT + a1::INT = n AND NOT (a0 AND a1 AND seq % 7 = 0) AS sound, CASE WHEN a0 THEN e0 END AS t0, CASE WHEN a1 THEN e1 END AS t1 FROM x),
z AS (SELECT *, sound AND (coalesce(t0 <= {QUOTA_NOW}, false) OR coalesce(t1 <= {QUOTA_NOW}, false)) AS expired FROM y)
SELECT seq, CASE WHEN NOT expired THEN n END AS reset_count, CASE WHEN sound AND NOT expired THEN least(t0, t1) END AS reset_expires_at FROM z""",
)
def _(spark, d):
    return q.credits_summary(parsed(spark, d), QUOTA_NOW)
