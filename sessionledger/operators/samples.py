"""Samples over time: episodes, last-known values, changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Run, running, with_chunk
from ..plans.scan import CHUNK


def latest_per_key(df: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """The newest row of every key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ord).alias("_r")).select(*keys, "_r.*")


def _changed(df: DataFrame, keys, ord, fields: list[str], span=None) -> DataFrame:
    """``_prev`` row fields and ``_new``: differs from the previous row."""
    rows = running(df, keys, ord, {"_prev": Run("last", F.struct(*fields), before=True)}, span)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_prev.{f}"))
    return rows.withColumn("_new", F.col("_prev").isNull() | ~same)


def status_episodes(
    df: DataFrame, keys: list[str], ord: str, fields: list[str], stamp: str, span: int | None = None
) -> DataFrame:
    """Runs of equal ``fields`` per key: start, end and number of samples."""
    rows = _changed(df, keys, ord, fields, span)
    rows = running(rows, keys, ord, {"episode": Run("sum", F.col("_new").cast("long"))}, span)
    return rows.groupBy(*keys, "episode").agg(
        *[F.first(f).alias(f) for f in fields],
        F.min(stamp).alias("started"),
        F.max(stamp).alias("ended"),
        F.count(F.lit(1)).alias("samples"),
    )


def status_since(df: DataFrame, span: int | None = None) -> DataFrame:
    """Carry the first stamp of the current status while status and generation
    stay equal and the host stayed online."""
    rows = running(
        df,
        ["agent"],
        "ord",
        {"_prev": Run("last", F.struct("status", "generation", "online"), before=True)},
        span,
    )
    p = F.col("_prev")
    same = (
        p.online
        & (p.status == F.col("status"))
        & p.generation.eqNullSafe(F.col("generation"))
    )
    fresh = ~F.coalesce(same, F.lit(False))
    out = running(
        rows.withColumn("_fresh", fresh),
        ["agent"],
        "ord",
        {"since": Run("last", F.when(F.col("_fresh"), F.col("stamp")))},
        span,
    )
    return out.select("agent", "ord", "status", "generation", F.when(F.col("online"), F.col("since")).alias("since"))


def last_known(df: DataFrame, fields: list[str], span: int | None = None) -> DataFrame:
    """As-of: a sample without telemetry takes the latest earlier known values
    of its session generation, with their original stamp.

    A rejected or cleared sample and short coverage drop what was kept; so does
    a change of generation, even when the old one returns later.
    """
    rows = _changed(df, ["agent"], "ord", ["generation"], span)
    drops = F.col("rejected") | F.col("cleared") | F.col("short")
    keeps = ~F.col("missing") & ~drops
    event = F.when(
        keeps | drops | F.col("_new"),
        F.struct(keeps.alias("keeps"), "stamp", "generation", *fields),
    )
    rows = running(rows, ["agent"], "ord", {"_at": Run("last", event)}, span)
    at = F.col("_at")
    held = F.col("missing") & ~drops & at.keeps
    use = F.when(keeps, F.struct("stamp", *fields)).when(held, F.struct(at.stamp.alias("stamp"), *[at.getField(f).alias(f) for f in fields]))
    return rows.select(
        "agent",
        "ord",
        use.stamp.alias("usage_stamp"),
        *[use.getField(f).alias(f) for f in fields],
        F.coalesce(held, F.lit(False)).alias("carried"),
    )


def consecutive(df: DataFrame, keys: list[str], ord: str, fields: list[str], span=None) -> DataFrame:
    """Each sample beside the previous one of its key, as ``a`` and ``b``."""
    rows = running(df, keys, ord, {"a": Run("last", F.struct(*fields), before=True)}, span)
    return rows.filter("a IS NOT NULL").select(*keys, ord, "a", F.struct(*fields).alias("b"))


def transitions(pairs: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """Measured changes between two snapshots of one thread.

    ``a`` and ``b`` carry status, generation, starts, stops, child_stamp, done,
    done_stamp, compactions, stale. Other generations and a stale after-side
    show nothing; unknown is never a change.
    """
    a, b = F.col("a"), F.col("b")
    live = ~b.stale
    state = (a.status != b.status) & (a.status != "unknown") & (b.status != "unknown")
    grew = (b.starts >= a.starts) & (b.stops >= a.stops) & ((b.starts > a.starts) | (b.stops > a.stops))
    hooks = live & (b.child_stamp > a.child_stamp) & grew
    first = live & (a.starts == 0) & (a.stops == 0) & b.child_stamp.isNotNull() & ((b.starts > 0) | (b.stops > 0))
    done = live & (b.done_stamp > a.done_stamp) & (b.done > a.done)
    compaction = live & (b.compactions > a.compactions)
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        pairs.filter(a.generation == b.generation)
        .select(
            *keys,
            ord,
            no(state).alias("state"),
            (no(hooks) | no(first) | no(done)).alias("children"),
            no(compaction).alias("compaction"),
        )
        .filter("state OR children OR compaction")
    )


def revision(df: DataFrame, keys: list[str], ord: str, content: list[str], span=None) -> DataFrame:
    """Counter that advances only when content other than the sample time changes."""
    rows = df.withColumn("_h", F.xxhash64(*content))
    rows = _changed(rows, keys, ord, ["_h"], span)
    return running(rows, keys, ord, {"revision": Run("sum", F.col("_new").cast("long"))}, span).drop(
        "_h", "_prev", "_new", CHUNK
    )


def poison_after(df: DataFrame, poison: Column, fail: Column, good: Column, span=None) -> DataFrame:
    """Per record: unknown for good from the first ``poison`` on, and unknown
    from a ``fail`` until the next ``good`` record."""
    out = running(
        df,
        ["session_id"],
        "ord",
        {
            "poisoned": Run("max", F.coalesce(poison, F.lit(False))),
            "_fail": Run("max", F.when(fail, F.col("ord"))),
            "_good": Run("max", F.when(good & ~fail, F.col("ord"))),
        },
        span,
    )
    recovered = F.coalesce(F.col("_good") > F.coalesce("_fail", F.lit(-1)), F.lit(False))
    return out.select("session_id", "ord", "poisoned", (recovered & ~F.col("poisoned")).alias("last_known"))


def recent_context(df: DataFrame, at: Column, label: str, n: int = 4, span=None) -> DataFrame:
    """Labels of the ``n`` records before each record where ``at`` holds.

    A chunk hands its last ``n`` records on, so no window spans a whole key.
    """
    rows = with_chunk(df, "ord", span)
    part = Window.partitionBy("session_id", CHUNK)
    tails = (
        rows.select("session_id", CHUNK, "ord", label)
        .withColumn("_r", F.row_number().over(part.orderBy(F.col("ord").desc())))
        .filter(F.col("_r") <= n)
    )
    before = F.collect_list(label).over(
        Window.partitionBy("session_id").orderBy(CHUNK, "ord").rowsBetween(-n, -1)
    )
    # The earliest kept record of a chunk sees exactly the records before it.
    handed = (
        tails.withColumn("_before", before)
        .groupBy("session_id", CHUNK)
        .agg(F.min_by("_before", "ord").alias("_before"))
    )
    local = F.collect_list(label).over(part.orderBy("ord").rowsBetween(-n, -1))
    size = F.row_number().over(part.orderBy("ord"))
    marked = rows.withColumns({"_local": local, "_n": size, "_at": at}).filter("_at")
    both = marked.join(handed, ["session_id", CHUNK], "left")
    early = F.when(F.col("_n") <= n, F.col("_before")).otherwise(F.array().cast("array<string>"))
    joined = F.concat(F.coalesce(early, F.array().cast("array<string>")), F.col("_local"))
    last = F.slice(joined, F.greatest(F.size(joined) - n + 1, F.lit(1)), F.lit(n))
    return both.select("session_id", "ord", F.concat_ws(",", last).alias("context"))


def first_flip(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """First record at which each cumulative flag turns, per session."""
    firsts = df.groupBy("session_id").agg(
        *[F.min(F.when(c, F.col("ord"))).alias(m) for m, c in flags.items()]
    )
    return firsts.unpivot("session_id", list(flags), "metric", "ord").filter("ord IS NOT NULL")


def stable_order(df: DataFrame, group: str, key: str, first_seen: str, current: Column, span=None) -> DataFrame:
    """Position of every current key: survivors keep their first-seen order and
    arrivals follow."""
    keys = (
        df.groupBy(group, key)
        .agg(F.min(first_seen).alias("ord"), F.bool_or(current).alias("_now"))
        .filter("_now")
    )
    return running(keys, [group], "ord", {"position": Run("sum", F.lit(1))}, span).select(
        group, key, "position"
    )


def arrivals(present: DataFrame, hosts: DataFrame) -> DataFrame:
    """Threads new in a snapshot on hosts that reported the one before on the
    same route. ``present``: step, host, agent; ``hosts``: step, host, route,
    reporting."""
    earlier = present.select((F.col("step") + 1).alias("step"), "host", "agent")
    live = (
        hosts.filter("reporting")
        .select((F.col("step") + 1).alias("step"), "host", F.col("route").alias("_old"))
        .join(hosts.select("step", "host", "route"), ["step", "host"])
        .filter(F.col("_old") == F.col("route"))
    )
    return present.join(earlier, ["step", "host", "agent"], "left_anti").join(
        live, ["step", "host"], "left_semi"
    )


def unacknowledged_done(threads: DataFrame, acks: DataFrame) -> DataFrame:
    """Done threads whose completion episode has not been acknowledged."""
    return threads.filter(F.col("status") == "done").join(acks, ["thread", "episode"], "left_anti")


def reconcile_acks(acks: DataFrame, threads: DataFrame) -> DataFrame:
    """Drop an acknowledgement once its listed thread left that episode; keep
    those of threads that are not listed."""
    t = threads.select("thread", F.col("status").alias("_s"), F.col("episode").alias("_e"))
    stale = (F.col("_s") != "done") | (F.col("_e") != F.col("episode"))
    return acks.join(t, "thread", "left").filter(~F.coalesce(stale, F.lit(False))).select("thread", "episode")


def acknowledge(acks: DataFrame, targets: DataFrame, threads: DataFrame) -> DataFrame:
    """Add targets still done in the same episode; the new episode wins."""
    ok = targets.join(
        threads.filter(F.col("status") == "done"), ["thread", "episode"], "left_semi"
    ).select("thread", "episode")
    return acks.join(ok, "thread", "left_anti").unionByName(ok)
