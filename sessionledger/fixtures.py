"""Views F1 to F6: the library's inputs derived from the given tables.

Each view exists twice, as a DataFrame and as oracle SQL (``*_SQL``, a list of
common table expressions), and both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import Run, default_span, running, written_table
from .plans.scan import CHUNK, chunk_number

NOW_US = 1706832000000000  # 2024-02-02, past every event
NOW_S = NOW_US // 1_000_000
QUOTA_NOW = 996710400  # 2001-08-02
SNAP_NOW = 996710400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ------------------------------------------------------------------ F0 / F1
def f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines: microsecond stamp, the integer in props, line number.

    This is the ingestion step: the numbered lines are written once per
    application and every record view below reads that table.
    """

    def build():
        ev = table(spark, sf_dir, "events").select(
            F.col("user_id").alias("session_id"),
            F.col("event_id").alias("ord"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )
        numbered = running(ev, ["session_id"], "ord", {"rn": Run("sum", F.lit(1), before=True)})
        return numbered.drop(CHUNK)

    return written_table(spark, f"lines:{sf_dir}:{default_span(spark)}", build)


F0_SQL = """f0 AS (
  SELECT user_id AS session_id, event_id AS ord, epoch_us(ts) AS stamp, event_type, value,
         CAST(props->>'k' AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn
  FROM events)"""

_KIND = """CASE WHEN p IN (0, 4) AND k IN (8, 41, 74) THEN 'queue-operation'
  WHEN p IN (1, 2, 3, 5) THEN 'assistant' WHEN p = 7 AND event_type <> 'error' THEN 'system'
  ELSE 'user' END"""
# One expression list for both engines; DIV marks integer division.
_F1_COLS = {
    "kind": _KIND,
    "bad": "k = 3",
    "forked": "k = 13",
    "synthetic": "k = 17 AND p IN (1, 2, 3, 5)",
    "mismatch": "k = 19 AND session_id % 7 = 0",
    "message_id": """CASE WHEN p NOT IN (1, 2, 3, 5) THEN NULL
      WHEN p = 5 AND k = 7 THEN concat('m', CAST(2 * c - 4 AS STRING))
      WHEN p = 5 THEN concat('m', CAST(2 * c + 1 AS STRING)) ELSE concat('m', CAST(2 * c AS STRING)) END""",
    "input": "CASE WHEN k = 11 THEN NULL ELSE CAST(floor(value) AS BIGINT) END",
    "output": "k",
    "cache_read": "CAST(floor(value / 2) AS BIGINT)",
    "cache_write": "k % 5",
    "stop": """CASE WHEN p NOT IN (1, 2, 3, 5) OR p = 1 THEN NULL WHEN k = 29 THEN 'other'
      WHEN p = 5 THEN 'end_turn' ELSE 'tool_use' END""",
    "model": "CASE WHEN k = 31 THEN NULL ELSE concat('model-', CAST(k % 3 AS STRING)) END",
    "subtype": """CASE WHEN p <> 7 OR event_type = 'error' THEN NULL
      WHEN k % 20 = 19 THEN 'compact_boundary' WHEN k % 20 = 18 THEN 'stop_hook_summary' ELSE 'turn_duration' END""",
    "compaction_iteration": "k = 37 AND session_id % 5 = 0 AND p IN (1, 2, 3, 5)",
    "child_key": "CASE WHEN p IN (4, 6) THEN concat('ch', CAST(c % 4 AS STRING)) END",
    "child_event": """CASE WHEN p = 4 THEN 'launch' WHEN p = 6 THEN CASE ord % 5 WHEN 0 THEN 'completed'
      WHEN 1 THEN 'errored' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'unknown' ELSE 'resume' END END""",
    "uuid": "CASE WHEN k = 5 THEN 'u-dup' ELSE concat('u', CAST(ord AS STRING)) END",
    "operation": "CASE k WHEN 8 THEN 'enqueue' WHEN 41 THEN 'dequeue' WHEN 74 THEN 'remove' END",
    "abort": "p = 7 AND event_type = 'error'",
}


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session log records, written once per application like ``f0``.

    ``trig`` is the stamp of the latest cycle start at or before the record.
    """

    def build():
        base = f0(spark, sf_dir).withColumns({"c": F.expr("rn div 8"), "p": F.col("rn") % 8})
        made = base.select("*", *[F.expr(e).alias(n) for n, e in _F1_COLS.items()])
        start = F.when(F.col("p") == 0, F.col("stamp"))
        return running(made, ["session_id"], "ord", {"trig": Run("last", start)}).drop(CHUNK)

    return written_table(spark, f"records:{sf_dir}:{default_span(spark)}", build)


F1_SQL = (
    F0_SQL
    + """,
f1b AS (SELECT *, rn // 8 AS c, rn % 8 AS p FROM f0),
f1 AS (SELECT *, """
    + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in _F1_COLS.items())
    + " FROM f1b)"
)

# ----------------------------------------------------------------------- F2
_F2 = {
    "agent": "o_custkey",
    "host": "o_custkey % 16",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'working' ELSE 'blocked' END",
    "project": "o_orderpriority",
    "seq": "o_orderkey",
}


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host samples: each order is one sighting of an agent.

    ``ord`` sorts by day, then order key. Chunks follow the same order and hold
    ``16 * span`` order keys of one day, so a hot agent or host stays split.
    """
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    span = 16 * default_span(spark)
    return o.select(
        *[F.expr(e).alias(n) for n, e in _F2.items()],
        (day * 86400).alias("sampled_at"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month"),
        F.year("o_orderdate").cast("long").alias("generation"),
        (day * F.lit(1 << 40) + F.col("o_orderkey")).alias("ord"),
        (day * F.lit(1 << 20) + chunk_number("o_orderkey", span)).alias(CHUNK),
    )


F2_SQL = (
    "f2 AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _F2.items())
    + """, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS sampled_at,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month, CAST(year(o_orderdate) AS BIGINT) AS generation,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1099511627776 + o_orderkey AS ord FROM orders)"""
)

# ----------------------------------------------------------------------- F3
_F3 = {
    "account_key": "o_custkey",
    "provider": "lower(c_mktsegment)",
    "used": "o_orderkey % 101",
    "plan": "CASE o_orderkey % 5 WHEN 0 THEN 'pro' WHEN 1 THEN 'team' WHEN 2 THEN 'gold' WHEN 3 THEN 'free' END",
    "reset_count": "CASE WHEN o_orderkey % 7 = 0 THEN 20000 WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderkey % 7 END",
    "lifetime_tokens": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * 1000 END",
    "peak_daily_tokens": "o_orderkey % 100000",
}


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota observations of mapped and unmapped accounts."""
    o, cu = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400
    j = o.join(cu, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("seq"),
        *[F.expr(e).alias(n) for n, e in _F3.items()],
        day.alias("sampled_at"),
        (day + (F.col("o_orderkey") % 400 + 1) * 86400).alias("resets_at"),
        F.expr("CASE WHEN o_orderkey % 4 > 0 THEN 1 END * 86400").cast("long").alias("_e"),
    ).withColumn("reset_expires_at", F.col("sampled_at") + F.col("_e") * (F.col("seq") % 300)).drop("_e")


F3_SQL = (
    "f3 AS (SELECT o_orderkey AS seq, "
    + ", ".join(f"{e} AS {n}" for n, e in _F3.items())
    + """, epoch(o_orderdate)::BIGINT AS sampled_at, epoch(o_orderdate)::BIGINT + (o_orderkey % 400 + 1) * 86400 AS resets_at,
  CASE WHEN o_orderkey % 4 > 0 THEN epoch(o_orderdate)::BIGINT + (o_orderkey % 300) * 86400 END AS reset_expires_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
)

# ----------------------------------------------------------------------- F4
_F4 = {
    "status": "CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'working' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'blocked' ELSE 'unknown' END",
    "output": "CASE WHEN k % 4 > 0 THEN k END",
    "missing": "k % 4 = 0",
    "rejected": "k = 50",
    "short": "k = 52",
    "cleared": "k = 53",
    "online": "k <> 60",
    "starts": "k % 4",
    "stops": "k % 3",
    "child_stamp": "CASE WHEN k % 4 + k % 3 > 0 THEN stamp - k * 1000 END",
    "done": "k % 5",
    "compactions": "CASE WHEN k % 6 > 0 THEN k % 6 END",
    "stale": "k % 9 = 0",
}


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples of one agent per user."""
    base = f0(spark, sf_dir).withColumn("generation", F.expr("rn div 20"))
    return base.withColumnRenamed("session_id", "agent").select(
        "agent", "ord", "stamp", "k", "rn", "generation", *[F.expr(e).alias(n) for n, e in _F4.items()]
    )


F4_SQL = F0_SQL + (
    ",\nf4 AS (SELECT session_id AS agent, ord, stamp, k, rn, rn // 20 AS generation, "
    + ", ".join(f"{e} AS {n}" for n, e in _F4.items())
    + " FROM f0)"
)

# ----------------------------------------------------------------------- F6
_F6 = {
    "id": "concat('p', CAST(s_suppkey AS {s}))",
    "target": "replace(s_name, '#', '-')",
    "label": "n_name",
    "session": "CASE WHEN s_suppkey % 5 = 0 THEN 'night' ELSE 'default' END",
    "enabled": "s_suppkey % 3 <> 0",
    "num": "s_suppkey",
}


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine inventory."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(*[F.expr(e.format(s="STRING")).alias(c) for c, e in _F6.items()])


F6_SQL = (
    "f6 AS (SELECT "
    + ", ".join(f"{e.format(s='VARCHAR')} AS {c}" for c, e in _F6.items())
    + " FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)
