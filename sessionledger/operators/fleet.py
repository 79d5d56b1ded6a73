"""Hosts, inventory, thread lists and reports over the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions import scalars as sc

PRIORITY = {"unknown": 0, "idle": 0, "done": 1, "working": 2, "blocked": 3}
ORDER = {"working": 0, "blocked": 1, "idle": 2, "done": 3, "unknown": 4}


def _rank(col: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in table.items():
        out = F.when(col == name, value).otherwise(out)
    return out


# ----------------------------------------------------------------- inventory
def inventory_checks(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One verdict row: an inventory with any invalid or repeated row is
    rejected whole. Counting is a distributed aggregate over ids."""
    c = F.col
    target_ok = g.full(c("target"), r"[A-Za-z0-9_.@:][A-Za-z0-9_.@:-]*") & (F.octet_length("target") <= 1024)
    label_ok = (F.octet_length("label") <= 512) & ~c("label").rlike(r"[\x00-\x1f\x7f-\x{9f}]")
    ok = g.safe_id(c("id"), 40).isNotNull() & target_ok & F.coalesce(label_ok, F.lit(True)) & c("enabled").isNotNull()
    per_id = df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")
    )
    out = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(~F.col("ok")).alias("invalid"),
    )
    good = (F.col("duplicates") == 0) & (F.col("invalid") == 0)
    if limit is not None:
        good = good & (F.col("rows") <= limit)
    return out.withColumn("accepted", good)


def ambiguous_routes(hosts: DataFrame) -> DataFrame:
    """Routes claimed by more than one host: such a fleet is rejected."""
    return (
        hosts.groupBy("target", "session")
        .agg(F.count(F.lit(1)).alias("hosts"))
        .filter("hosts > 1")
    )


def effective_fleet(config: DataFrame, inventory: DataFrame) -> DataFrame:
    """Hosts to collect: plain hosts as configured, bound hosts on their
    profile's route, and enabled profiles no host is bound to."""
    profiles = inventory.filter("enabled").select(
        F.col("id").alias("profile_id"), "target", "session", "label"
    )
    plain = config.filter("profile_id IS NULL").select(
        "host", "profile_id", "transport", "target", "session", "label"
    )
    bound = (
        config.filter("profile_id IS NOT NULL")
        .select("host", "profile_id")
        .join(profiles, "profile_id")
        .select("host", "profile_id", F.lit("ssh").alias("transport"), "target", "session", "label")
    )
    free = profiles.join(config.select("profile_id"), "profile_id", "left_anti").select(
        F.col("profile_id").alias("host"), "profile_id", F.lit("ssh").alias("transport"), "target", "session", "label"
    )
    return plain.unionByName(bound).unionByName(free)


def fleet_union(config: DataFrame, discovered: DataFrame) -> DataFrame:
    return config.unionByName(discovered, allowMissingColumns=True)


def distinct_targets(sources: DataFrame, hosts: DataFrame) -> DataFrame:
    """Unique collection targets of explicit sources and remote hosts, sorted."""
    remote = hosts.filter(F.col("transport") == "ssh").select("target")
    return sources.select("target").union(remote).distinct().orderBy("target")


def retired_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of ``before`` that are gone or re-routed: their state is dropped."""
    return before.select("key", "route").join(after.select("key", "route"), ["key", "route"], "left_anti")


def surviving_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("key").distinct().join(after.select("key"), "key", "left_semi")


def coverage_subset(returned: DataFrame, requested: DataFrame, panes: DataFrame) -> DataFrame:
    """Per host: every returned key was requested, and every pane has one."""
    unasked = (
        returned.join(requested, ["host", "key"], "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("unasked"))
    )
    lacking = (
        panes.join(returned, ["host", "key"], "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("lacking"))
    )
    hosts = returned.select("host").union(panes.select("host")).distinct()
    j = hosts.join(unasked, "host", "left").join(lacking, "host", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return j.select(
        "host", ((zero("unasked") == 0) & (zero("lacking") == 0)).alias("covered")
    )


# --------------------------------------------------------------------- joins
def join_workspace(agents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Label of the first workspace with the agent's id on its host."""
    first = workspaces.groupBy("host", "workspace_id").agg(F.min_by("label", "ord").alias("label"))
    j = agents.join(first, ["host", "workspace_id"], "left")
    return j.withColumn("label", g.clean_text(F.col("label"), "Untitled"))


def bind_session(agents: DataFrame, sessions: DataFrame, prefix: str = "source") -> DataFrame:
    """Copy each session's result to every agent bound to it. The agent's
    session must come from its own harness."""
    own = F.col("source") == F.concat(F.lit(prefix + ":"), F.col("harness"))
    key = sc.session_binding(F.col("harness"), F.col("kind"), F.col("value"))
    bound = agents.withColumn("binding", F.when(own, key)).filter("binding IS NOT NULL")
    return bound.join(sessions, "binding")


def path_category(agents: DataFrame, roots: DataFrame) -> DataFrame:
    """Category of the agent's path by the roots of its host, compared whole
    components at a time; personal wins over work and is the default.

    Every ancestor of the path is looked up by equality, so the join is a hash
    join however many roots there are.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    whole = F.concat(F.lit("/"), F.array_join(parts, "/"))
    depth = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    plain = g.is_plain_path(F.col("path"))
    tries = (
        agents.filter(plain)
        .select("agent", "host", F.explode(F.array_distinct(F.concat(F.array(F.lit("/"), whole), depth))).alias("root"))
    )
    named = roots.select(
        "host",
        F.concat(F.lit("/"), F.array_join(F.filter(F.split("root", "/"), lambda p: p != ""), "/")).alias("root"),
        F.when(F.col("category") == "personal", 0).otherwise(1).alias("_rank"),
    )
    hit = tries.join(named, ["host", "root"]).groupBy("agent").agg(F.min("_rank").alias("_rank"))
    return agents.join(hit, "agent", "left").select(
        "agent", "host", "path", F.when(F.col("_rank") == 1, "work").otherwise("personal").alias("category")
    )


# ------------------------------------------------------------------ liveness
def host_reporting(df: DataFrame, now, max_age: Column) -> DataFrame:
    """``reporting`` and ``connection`` of each host's newest sample."""
    c = F.col
    age = sc.age_seconds(c("sampled_at"), now)
    setup = F.coalesce(c("connection_state") == "setup_needed", F.lit(False))
    reporting = ~setup & F.coalesce(c("online") & (age < max_age), F.lit(False))
    connection = (
        F.when(setup, "setup_needed")
        .when(c("connection_state") == "connecting", "connecting")
        .when(reporting, "connected")
        .otherwise("unreachable")
    )
    return df.withColumns({"reporting": reporting, "connection": connection})


def sample_guard(df: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Rows of accepted samples: a sample from the future, beyond ``limit``
    agents where one is given, or naming another host's agent is rejected whole."""
    per = df.groupBy("host", "sampled_at").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("agent_host") != F.col("host")).alias("_other")
    )
    ok = (
        (F.col("sampled_at") > 0)
        & (F.col("sampled_at") <= F.lit(now) + 1)
        & ~F.col("_other")
    )
    if limit is not None:
        ok = ok & (F.col("_n") <= limit)
    return df.join(per.filter(ok), ["host", "sampled_at"], "left_semi")


def liveness_gaps(df: DataFrame, gap: int, span: int | None = None) -> DataFrame:
    """Stretches in which a host stayed live, split where no sample came for
    ``gap`` seconds."""
    from ..plans import Run, running

    days = df.groupBy("host", "sampled_at").agg(F.count(F.lit(1)).alias("samples"))
    rows = running(
        days, ["host"], "sampled_at", {"_p": Run("last", F.col("sampled_at"), before=True)}, span
    )
    new = F.coalesce(F.col("sampled_at") - F.col("_p") > gap, F.lit(True))
    rows = running(rows.withColumn("_new", new), ["host"], "sampled_at", {"stretch": Run("sum", F.col("_new").cast("long"))}, span)
    return rows.groupBy("host", "stretch").agg(
        F.min("sampled_at").alias("live_from"),
        F.max("sampled_at").alias("last_seen"),
        (F.max("sampled_at") + gap).alias("unreachable_at"),
        F.sum("samples").alias("samples"),
    )


# ------------------------------------------------------------------- reports
def fleet_counts(hosts: DataFrame, threads: DataFrame) -> DataFrame:
    """One row: working threads (NULL when no host reports), missing sources."""
    working = threads.filter(F.col("status") == "working").join(
        hosts.filter("reporting"), "host", "left_semi"
    )
    facts = hosts.select("reporting", F.lit(False).alias("_w")).unionByName(
        working.select(F.lit(None).cast("boolean").alias("reporting"), F.lit(True).alias("_w"))
    )
    j = facts.agg(
        F.count_if("reporting").alias("reporting"),
        F.count_if(~F.col("reporting")).alias("missing"),
        F.count_if("_w").alias("_w"),
    )
    note = (
        F.when(F.col("reporting") == 0, "No sources reporting")
        .when(F.col("missing") == 1, "1 source unavailable")
        .when(F.col("missing") > 1, F.concat(F.col("missing").cast("string"), F.lit(" sources unavailable")))
        .otherwise("All sources reporting")
    )
    return j.select(
        F.when(F.col("reporting") > 0, F.col("_w")).alias("working"),
        "missing",
        (F.col("missing") > 0).alias("partial"),
        note.alias("note"),
    )


def dominant_state(threads: DataFrame, acks: DataFrame, group: str) -> DataFrame:
    """Most urgent state per group; acknowledged completions do not count, and
    a group with nothing urgent is idle."""
    acked = acks.select("thread", "episode", F.lit(True).alias("_a"))
    j = threads.join(acked, ["thread", "episode"], "left")
    counts = ~((F.col("status") == "done") & F.coalesce("_a", F.lit(False)))
    rank = F.when(counts, _rank(F.col("status"), PRIORITY)).otherwise(0)
    top = j.groupBy(group).agg(F.max(rank).alias("_r"))
    names = F.when(F.col("_r") == 3, "blocked").when(F.col("_r") == 2, "working").when(F.col("_r") == 1, "done")
    return top.select(group, names.otherwise("idle").alias("state"))


def diagnostics(threads: DataFrame) -> DataFrame:
    """Counts of what the threads report. Input: input_tokens, elapsed, active,
    stale, total; NULL elapsed and stale mean no timing source."""
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    return threads.agg(
        F.count(F.lit(1)).alias("threads"),
        F.count_if(c("input_tokens").isNotNull()).alias("usage_reported"),
        F.count_if(c("elapsed").isNotNull()).alias("timing_reported"),
        F.count_if(no(c("active") & ~c("stale")) & c("elapsed").isNotNull()).alias("timing_current"),
        F.count_if(c("total").isNotNull()).alias("timing_totals"),
        F.count_if(no(c("stale"))).alias("timing_stale"),
    )


def group_by_host(threads: DataFrame, hosts: DataFrame, hidden: list[str], collapsed: Column) -> DataFrame:
    """Totals and matching counts per host; empty hosts are kept."""
    t = threads.groupBy("host").agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(~F.col("status").isin(*hidden)).alias("_m")
    )
    j = hosts.join(t, "host", "left")
    seen = lambda n: F.when(F.col("reporting"), F.coalesce(n, F.lit(0))).otherwise(0).cast("long")
    return j.select(
        "host",
        seen("_t").alias("total"),
        seen("_m").alias("matching"),
        collapsed.alias("collapsed"),
        F.when(collapsed, 0).otherwise(seen("_m")).cast("long").alias("shown"),
    )


def visible_rows(threads: DataFrame, hosts: DataFrame, hidden: list[str], collapsed: Column) -> DataFrame:
    """Rows shown: of reporting, uncollapsed hosts and states not hidden. Group
    members stay rows, ordered by ``thread_order``, however large a host is."""
    open_hosts = hosts.filter(F.col("reporting") & ~collapsed)
    return threads.filter(~F.col("status").isin(*hidden)).join(open_hosts, "host", "left_semi")


def thread_order(threads: DataFrame, *ties: str) -> DataFrame:
    """Most active first, then project in binary order."""
    return threads.orderBy(_rank(F.col("status"), ORDER), "project", *ties)


def per_host_head(df: DataFrame, k: int = 32) -> DataFrame:
    """First ``k`` agents of each host in source order. The rank filter is
    applied per task before the shuffle."""
    w = Window.partitionBy("host").orderBy("ord")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def bounded_keys(df: DataFrame, order: str, k: int = 256) -> DataFrame:
    """The newest ``k`` acknowledgements."""
    return df.orderBy(F.col(order).desc()).limit(k)


def group_by_provider(rows: DataFrame) -> DataFrame:
    """Accounts per provider, providers in order of first appearance."""
    return rows.groupBy("provider").agg(
        F.min("position").alias("first_position"),
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("status") == "available").alias("available"),
    )
