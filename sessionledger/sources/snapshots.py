"""Nested snapshot documents, packed metrics, adapter events and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards as g
from ..operators.telemetry import NUMBERS

SNAPSHOT_SCHEMA = (
    "at double, interval double, heartbeat_seconds bigint, hosts array<struct<id:string,label:string,online:boolean,"
    "connection_state:string,sampled_at:double,agents:array<struct<id:string,host:string,status:string,project:string>>>>"
)
ADAPTER_SCHEMA = (
    "session_id string, event string, phase string, seq bigint, model string, tool string, result string, "
    "context bigint, window bigint, context_percent bigint, usage_seq bigint, usage_source string"
)
# Packed layouts: comma groups of numbers, then tuples with digit widths.
GROUPS = [
    ["input", "output_tokens", "cache_read", "cache_write"],
    ["context", "window", "usage_seq", "total_input"],
    ["total_output", "total_cache_read", "total_cache_write", "total_uncached_input"],
    ["compactions", "context_percent"],
]
TUPLES = {
    "completion": (["subagent_total", "subagent_done", "subagent_status_seq"], [3, 3, 16]),
    "outcomes": (
        ["subagent_running", "subagent_completed", "subagent_interrupted", "subagent_failed", "subagent_unknown"],
        [3, 3, 3, 3, 3],
    ),
    "children": (["subagent_starts", "subagent_stops", "subagent_seq"], [3, 3, 16]),
}


# ------------------------------------------------------------------ snapshots
def explode_snapshot(df: DataFrame) -> DataFrame:
    """One row per agent of a snapshot; hosts without agents keep one row."""
    h = df.select("at", F.explode("hosts").alias("h"))
    a = h.select("at", "h", F.explode_outer("h.agents").alias("a"))
    return a.select(
        "at",
        F.col("h.id").alias("host"),
        F.col("h.online").alias("online"),
        F.col("h.connection_state").alias("connection_state"),
        F.col("h.sampled_at").alias("sampled_at"),
        F.col("a.id").alias("agent"),
        F.col("a.status").alias("status"),
        F.col("a.project").alias("project"),
    )


def nest_snapshot(agents: DataFrame, limit: int | None = None, max_hosts: int | None = None) -> DataFrame:
    """Snapshot documents, one per ``at``: hosts in order, agents in order.

    A document holds its whole fleet, so it is as large as the fleet at one
    instant. Where ``limit`` is given, a host sample of more agents is invalid
    and comes without agents and offline; where ``max_hosts`` is, a fleet of
    more hosts is no valid snapshot.
    """
    size = agents.groupBy("at", "host").agg(F.count(F.lit(1)).alias("_n"))
    if max_hosts is not None:
        fits = size.groupBy("at").agg(F.count(F.lit(1)).alias("_h")).filter(F.col("_h") <= max_hosts)
        size = size.join(fits, "at", "left_semi")
    if limit is not None:
        agents = agents.join(size.filter(F.col("_n") <= limit), ["at", "host"], "left_semi")
    lists = (
        agents.groupBy("at", "host")
        .agg(F.array_sort(F.collect_list(F.struct("agent", "status", "project"))).alias("agents"))
    )
    hosts = size.join(lists, ["at", "host"], "left").select(
        "at",
        F.struct(
            F.col("host").alias("id"),
            F.col("agents").isNotNull().alias("online"),
            F.coalesce("agents", F.array().cast("array<struct<agent:bigint,status:string,project:string>>")).alias("agents"),
        ).alias("h"),
    )
    return hosts.groupBy("at").agg(F.array_sort(F.collect_list("h")).alias("hosts"))


def write_snapshot(docs: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON line per document."""
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def read_snapshot(spark: SparkSession, path: str, schema: str = SNAPSHOT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_adapter_events(spark: SparkSession, path: str) -> DataFrame:
    """Adapter feed with a fixed schema; rows of unknown events or phases drop."""
    rows = spark.read.schema(ADAPTER_SCHEMA).json(path)
    return rows.filter(F.col("event").isin(*g.EVENTS) & F.col("phase").isin(*g.PHASES))


def write_counts(df: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted ``key<TAB>value`` report."""
    df.orderBy("key").select("key", "value").write.mode(mode).option("sep", "\t").csv(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("key string, value bigint").csv(path)


# ---------------------------------------------------------------- packed codec
def _digits(text: Column, width: int) -> Column:
    return F.when(g.full(text, f"[0-9]{{1,{width}}}"), text.try_cast("bigint"))


def encode_packed(df: DataFrame) -> DataFrame:
    """Version 2 strings: numbers in comma groups, unknown as empty."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    out = {"obs_v": F.lit("2"), "obs_seq": F.col("seq").cast("string")}
    for i, names in enumerate(GROUPS):
        out[f"obs_n{i}"] = F.concat_ws(",", *[text(n) for n in names])
    for name, (fields, _) in TUPLES.items():
        whole = F.concat_ws(",", *[text(n) for n in fields])
        out[f"obs_{name}"] = F.when(F.col(fields[0]).isNotNull(), whole)
    return df.withColumns(out)


def decode_packed(df: DataFrame, binding: str, *keys: str) -> DataFrame:
    """Numbers of a packed sample; one version is used, never a mix.

    A foreign binding, an unknown version or a malformed group drops the row.
    A malformed tuple leaves only its own fields unknown.
    """
    c = F.col
    v2 = c("obs_v") == "2"
    ok = c("obs_v").isin("1", "2") & (c("obs_bind") == c(binding))
    fields = {}
    for i, names in enumerate(GROUPS):
        group = c(f"obs_n{i}")
        parts = F.split(group, ",", -1)
        shape = g.full(group, ",".join(["[0-9]{0,16}"] * len(names)))
        ok = ok & (~v2 | F.coalesce(shape & (F.length(group) <= 67), F.lit(False)))
        for j, n in enumerate(names):
            packed = _digits(F.get(parts, F.lit(j)), 16)
            ok = ok & (~v2 | F.coalesce(packed <= g.SAFE, F.lit(True)))
            fields[n] = F.when(v2, packed).otherwise(g.bounded(_digits(c(f"obs_{n}"), 16), g.SAFE))
    for name, (names, widths) in TUPLES.items():
        value = c(f"obs_{name}")
        parts = F.split(value, ",", -1)
        shapes = [f"[0-9]{{1,{w}}}" for w in widths]
        if name == "children":
            shapes[2] = f"[0-9]{{0,{widths[2]}}}"
        good = v2 & g.full(value, ",".join(shapes))
        for j, (n, w) in enumerate(zip(names, widths)):
            fields[n] = F.when(good, _digits(F.get(parts, F.lit(j)), w))
    fields["seq"] = g.bounded(_digits(c("obs_seq"), 16), g.SAFE)
    rows = df.filter(F.coalesce(ok, F.lit(False)))
    order = ["seq", *NUMBERS, *[n for names, _ in TUPLES.values() for n in names]]
    return rows.select(*keys, *[fields[n].alias(n) for n in order])


# -------------------------------------------------------------- legacy replies
LEGACY_SCHEMA = (
    "array<struct<account_key:string,sampled_at:double,plan:string,weekly_remaining:string,weekly_resets_at:string,"
    "reset_count:string,reset_expires_at:string>>"
)


def read_legacy_quota(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Known fields of the rows in an old cache or peer reply ``value``; a reply
    of more than ``limit`` rows, where one is given, is refused whole."""
    rows = df.select("reply_id", F.from_json("value", LEGACY_SCHEMA).alias("r"))
    if limit is not None:
        rows = rows.filter(F.size("r") <= limit)
    x = rows.select("reply_id", F.posexplode("r").alias("position", "x"))
    count = lambda n, top=g.SAFE: g.safe_counter(F.col(f"x.{n}"), top).alias(n)
    return x.select(
        "reply_id",
        F.col("position").cast("long").alias("position"),
        F.col("x.account_key").alias("account_key"),
        F.col("x.sampled_at").alias("sampled_at"),
        F.col("x.plan").alias("plan"),
        count("weekly_remaining", 100),
        count("weekly_resets_at"),
        count("reset_count", 10_000),
        count("reset_expires_at"),
    )


# ----------------------------------------------------------------- dimensions
INVENTORY_SCHEMA = "id string, target string, session string, label string, enabled boolean"
ACCOUNT_SCHEMA = "account_key string, id string, label string, category string, window_seconds bigint"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Machine inventory rows with the default session and label; check the
    whole with ``inventory_checks`` before use."""
    rows = spark.read.schema(INVENTORY_SCHEMA).json(path)
    return rows.withColumns(
        {"session": F.coalesce("session", F.lit("default")), "label": F.coalesce("label", F.col("id"))}
    )


def read_account_map(spark: SparkSession, path: str) -> DataFrame:
    """Mapped accounts; check the whole with ``account_map_checks`` before use."""
    return spark.read.schema(ACCOUNT_SCHEMA).json(path)


def account_map_checks(rows: DataFrame) -> DataFrame:
    """One verdict row: any invalid or repeated account rejects the whole map."""
    c = F.col
    ok = (
        g.hex_id(c("account_key"), 64).isNotNull()
        & g.safe_id(c("id"), 40).isNotNull()
        & g.full(c("label"), r"[A-Za-z0-9][A-Za-z0-9 _.-]{0,39}")
        & c("category").isin("Personal", "Work")
        & F.coalesce(c("window_seconds") == 604_800, F.lit(True))
    )
    per = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")
    )
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if((F.col("n") > 1) | ~F.col("ok")).alias("rejected"),
    ).withColumn("accepted", F.col("rejected") == 0)
