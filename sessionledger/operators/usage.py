"""Token usage from ordered log records, with unknown kept apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Run, running, with_chunk
from ..plans.scan import CHUNK, chunk_number

SAFE = 9_007_199_254_740_991  # largest exact counter, 2^53 - 1
RESERVE = 12_000  # context tokens format A keeps back
COUNTERS = ["input", "output", "cache_read", "cache_write"]


def poison_sum(value: Column, where: Column | None = None) -> Column:
    """Aggregate sum that is NULL when any value is NULL or the sum is unsafe."""
    where = F.lit(True) if where is None else where
    missing = F.count_if(where & value.isNull())
    total = F.coalesce(F.sum(F.when(where, value)), F.lit(0))
    return F.when((missing == 0) & (total <= SAFE), total)


def _lines(df: DataFrame) -> DataFrame:
    """Assistant rows that feed usage; ``part`` marks the classifiable ones."""
    rows = df.filter(
        (F.col("kind") == "assistant") & ~F.col("forked") & ~F.col("synthetic")
    )
    part = ~F.col("bad") & F.col("message_id").isNotNull() & F.col("stamp").isNotNull()
    return rows.withColumn("part", part)


def message_islands(df: DataFrame, span: int | None = None) -> DataFrame:
    """Number the runs of lines that carry one message id.

    Adds ``new`` (opens a run), ``last_line``, ``island`` and ``island_start``.
    Other record kinds do not close a run.

    Runs are found inside each chunk first, its first line counting as new. One
    summary row per chunk then tells whether that line continues the run before
    it, and how many runs came earlier, so two passes over the lines are enough.
    """
    c = F.col
    # As a struct the session is never NULL, so that lines without one join too.
    rows = with_chunk(_lines(df), "ord", span).withColumn("_key", F.struct("session_id"))
    parts = ["_key", CHUNK]
    inside = Window.partitionBy(*parts).orderBy("ord")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*parts).orderBy(c("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(c("part"), F.struct("message_id", *COUNTERS))
    differs = lambda other: ~F.coalesce(other == c("message_id"), F.lit(False))
    base = [n for n in rows.columns if n != "_key"]
    local = rows.select(
        "*",
        F.last(mark, ignorenulls=True).over(past).alias("_prev"),
        F.last(F.when(c("part"), c("message_id")), ignorenulls=True).over(future).alias("_next"),
    ).withColumn("_new", c("part") & differs(c("_prev.message_id")))
    local = local.select(
        "*",
        F.sum(c("_new").cast("long")).over(upto).alias("_n"),
        F.max(F.when(c("_new"), c("ord"))).over(upto).alias("_start"),
    )
    at = F.when(c("part"), c("ord"))
    chunks = local.groupBy(*parts).agg(
        F.min_by("message_id", at).alias("_first"),
        F.max_by(mark, at).alias("_last"),
        F.sum(c("_new").cast("long")).alias("_runs"),
        F.max(F.when(c("_new"), c("ord"))).alias("_last_start"),
    )
    order = Window.partitionBy("_key").orderBy(CHUNK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy("_key").orderBy(c(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    chunks = chunks.select(
        "*",
        F.last("_last", ignorenulls=True).over(before).alias("_c_prev"),
        F.last("_first", ignorenulls=True).over(after).alias("_c_next"),
    ).withColumn("_joins", F.coalesce(c("_c_prev.message_id") == c("_first"), F.lit(False)).cast("long"))
    chunks = chunks.select(
        *parts,
        "_c_prev",
        "_c_next",
        "_joins",
        F.coalesce(F.sum(c("_runs") - c("_joins")).over(before), F.lit(0)).alias("_c_runs"),
        F.last(F.when(c("_runs") > c("_joins"), c("_last_start")), ignorenulls=True).over(before).alias("_c_start"),
    )
    joined = local.join(chunks, parts, "left")
    # The chunk's first run is the one carried in when it joins, or none yet.
    carried_in = c("_n") <= c("_joins")
    return joined.select(
        *base,
        F.coalesce("_prev", "_c_prev").alias("_prev"),
        (c("_new") & ~((c("_joins") == 1) & c("_prev").isNull())).alias("new"),
        (c("part") & differs(F.coalesce("_next", "_c_next"))).alias("last_line"),
        (c("_c_runs") + c("_n") - F.least(c("_n"), c("_joins"))).alias("island"),
        F.when(carried_in, c("_c_start")).otherwise(c("_start")).alias("island_start"),
    )


def reopened_groups(lines: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Islands whose message id closed before; with ``ring``, within that many
    islands before it, which is all a source of so short a memory can tell.

    Without it the islands of an id are looked through in chunks. With it, island numbers are cut into blocks of ``ring`` and every group start is also
    shown to the next block, so an earlier group within reach always shares a
    block and no window group holds more than two blocks of starts.
    """
    starts = lines.filter("new").select("session_id", "message_id", "ord", "island")
    if ring is None:
        past = Run("last", F.col("island"), before=True)
        rows = running(starts, ["session_id", "message_id"], "ord", {"prev_island": past}, span)
        return rows.filter("prev_island IS NOT NULL").select("session_id", "island", "message_id", "ord", "prev_island")
    starts = (
        starts.withColumn("_own", chunk_number("island", ring))
        .withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    )
    w = Window.partitionBy("session_id", "message_id", "_block").orderBy("island")
    gap = F.col("island") - F.col("prev_island")
    return (
        starts.withColumn("prev_island", F.lag("island").over(w))
        .filter((F.col("_block") == F.col("_own")) & gap.between(2, ring))
        .select("session_id", "island", "message_id", "ord", "prev_island")
    )


def _reopened(lines: DataFrame, ring: int | None, span: int | None) -> DataFrame:
    """``lines`` with ``_hit`` on those of a reopened island. Without a ring that is any island but
    the first of its message, and few messages have several, so nothing is ordered and
    only those take part in the join."""
    if ring is not None:
        place = F.struct("session_id", "island").alias("_place")
        hits = reopened_groups(lines, ring, span).select(place, F.lit(True).alias("_hit"))
        return lines.select("*", place).join(hits, "_place", "left").drop("_place")
    message = F.struct("session_id", "message_id").alias("_message")
    several = (
        lines.filter("new").groupBy(message).agg(F.min("island").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("_message", "_first")
    )
    joined = lines.select("*", message).join(several, "_message", "left")
    return joined.withColumn("_hit", F.col("island") > F.col("_first")).drop("_message", "_first")


def usage_lines(df: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Islands with ``reopened`` and ``complete`` decided per line."""
    lines = message_islands(df, span)
    whole = F.lit(0)
    for name in COUNTERS:
        whole = whole + F.col(name)
    return (
        _reopened(lines, ring, span)
        .withColumn("reopened", F.coalesce("_hit", F.lit(False)) & F.col("part"))
        .withColumn("complete", F.coalesce(whole <= SAFE, F.lit(False)))
        .drop("_hit")
    )


def _session_flags(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(
        F.bool_or("mismatch").alias("foreign"),
        F.bool_or(F.col("bad") & ~F.col("forked") & (F.col("kind") == "assistant")).alias("lost"),
    )


def _with_flags(df: DataFrame, sums: DataFrame) -> DataFrame:
    """Every session's flags and, where it has lines, its ``sums``; the NULL session too."""
    own = sums.withColumnRenamed("session_id", "_session")
    return _session_flags(df).join(own, F.col("session_id").eqNullSafe(F.col("_session")), "left").drop("_session")


def usage_totals(df: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Totals per session: the last line of every group counts, once."""
    lines = usage_lines(df, ring, span)
    ok = F.count_if(~F.col("part") | F.col("reopened") | ~F.col("complete")) == 0
    used = F.col("last_line")
    sums = lines.groupBy("session_id").agg(
        ok.alias("_ok"),
        F.max(F.when(F.col("part") & ~F.col("reopened"), F.col("stamp"))).alias("usage_seq"),
        *[poison_sum(F.col(n), used).alias(f"_{n}") for n in COUNTERS],
    )
    joined = _with_flags(df, sums)
    known = ~F.col("foreign") & ~F.col("lost") & F.col("_ok") & F.col("usage_seq").isNotNull()
    put = lambda c: F.when(known, c)
    total = F.col("_input") + F.col("_cache_read") + F.col("_cache_write")
    return joined.select(
        "session_id",
        put(F.when(total <= SAFE, total)).alias("total_input"),
        put(F.col("_cache_read")).alias("total_cache_read"),
        put(F.col("_cache_write")).alias("total_cache_write"),
        put(F.col("_input")).alias("total_uncached_input"),
        put(F.col("_output")).alias("total_output"),
        F.when(~F.col("foreign"), F.col("usage_seq")).alias("usage_seq"),
    )


def last_response(df: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Latest response of a group begun after the last failure.

    Group starts rise with ``ord``, so only the latest candidate can qualify
    and one aggregation is enough.
    """
    lines = usage_lines(df, ring, span)
    failed = ~F.col("part") | F.col("reopened") | ~F.col("complete")
    candidate = F.col("last_line") & F.col("stop").isNotNull() & ~failed
    # The response reports its selected iteration where the source has one.
    chosen = [
        (F.col(f"selected.{n}") if "selected" in lines.columns else F.col(n)).alias(n) for n in COUNTERS
    ]
    best = F.struct("island_start", "model", *chosen)
    agg = lines.groupBy("session_id").agg(
        F.max(F.when(failed, F.col("ord"))).alias("_fail"),
        F.max_by(best, F.when(candidate, F.col("ord"))).alias("_best"),
        F.max(F.when(F.col("part") & ~F.col("reopened"), F.col("stamp"))).alias("_seen"),
    )
    joined = _with_flags(df, agg)
    good = (
        ~F.col("foreign")
        & F.col("_seen").isNotNull()
        & (F.col("_best.island_start") > F.coalesce("_fail", F.lit(-(1 << 62))))
    )
    put = lambda c: F.when(good, c)
    context = F.col("_best.input") + F.col("_best.cache_read") + F.col("_best.cache_write")
    return joined.select(
        "session_id",
        put(context).alias("context"),
        put(F.col("_best.output")).alias("output_tokens"),
        put(F.col("_best.cache_read")).alias("cache_read"),
        put(F.col("_best.cache_write")).alias("cache_write"),
        put(F.col("_best.model")).alias("model"),
    )


def running_usage(df: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Totals the source would publish after each usage line."""
    lines = usage_lines(df, ring, span)
    same = F.col("_prev.message_id") == F.col("message_id")

    def delta(name):
        old = F.when(F.coalesce(same, F.lit(False)), F.coalesce(F.col(f"_prev.{name}"), F.lit(0)))
        return F.when(F.col("part"), F.coalesce(name, F.lit(0)) - F.coalesce(old, F.lit(0)))

    failed = ~F.col("part") | F.col("reopened") | ~F.col("complete")
    out = running(
        lines,
        ["session_id"],
        "ord",
        {
            "_out": Run("sum", delta("output")),
            "_in": Run("sum", delta("input") + delta("cache_read") + delta("cache_write")),
            "_failed": Run("max", failed),
        },
        span,
    )
    foreign = (
        df.filter("mismatch").groupBy("session_id").agg(F.min("ord").alias("_foreign_ord"))
    )
    out = out.join(foreign, "session_id", "left")
    dead = F.col("_failed") | F.coalesce(F.col("ord") >= F.col("_foreign_ord"), F.lit(False))
    return out.select(
        "session_id",
        "ord",
        F.when(~dead, F.col("_in")).alias("total_input"),
        F.when(~dead, F.col("_out")).alias("total_output"),
    )


def dedup_stats(df: DataFrame, ring: int | None = None, span: int | None = None) -> DataFrame:
    """Counted lines, merged lines, groups and reopened groups per session."""
    lines = usage_lines(df, ring, span).filter("part")
    return lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("assistant_lines"),
        F.count_if(~F.col("new")).alias("merged_lines"),
        F.count_if("new").alias("groups"),
        F.count_if(F.col("new") & F.col("reopened")).alias("reopened_groups"),
    )


# --------------------------------------------------------------- compactions
def compactions_b(df: DataFrame) -> DataFrame:
    live = ~F.col("forked")
    return df.groupBy("session_id").agg(
        F.when(
            ~F.bool_or("mismatch")
            & ~F.bool_or(live & F.col("compaction_iteration") & (~F.col("bad") | F.col("synthetic")))
            & ~F.bool_or(
                live & F.col("bad") & ~F.col("synthetic") & F.col("kind").isin("assistant", "system")
            ),
            F.count_if(live & ~F.col("bad") & (F.coalesce("subtype", F.lit("")) == "compact_boundary")),
        ).alias("compactions")
    )


def compactions_a(df: DataFrame) -> DataFrame:
    """The larger of marker and summary counts; unknown with an unreadable line."""
    return df.groupBy("session_id").agg(
        F.when(
            ~F.bool_or("unreadable"),
            F.greatest(
                F.count_if(F.col("a_type") == "context_compacted"),
                F.count_if(F.col("a_type") == "compacted"),
            ),
        ).alias("compactions")
    )


# ------------------------------------------------------------------ format A
def context_percent_a(context: Column, window: Column) -> Column:
    """Percent of the window used, counted beyond a fixed reserve."""
    room = window - RESERVE
    left = F.greatest(room - F.greatest(context - RESERVE, F.lit(0)), F.lit(0))
    percent = F.when(window <= RESERVE, F.lit(100)).otherwise(
        100 - F.round(F.least(F.greatest(left * 100.0 / room, F.lit(0.0)), F.lit(100.0)))
    )
    valid = (window > 0) & (context <= window)
    return F.when(valid, percent.cast("long"))


def latest_token_count(df: DataFrame, now_us: int) -> DataFrame:
    """Format A: the newest token report with an info object, in log order.

    The newest report decides alone: if it is from the future or carries no
    last-usage object, the session has no usage.
    """
    seen = (F.col("a_type") == "token_count") & F.col("has_info") & ~F.col("unreadable")
    fields = ["stamp", "has_last", *COUNTERS, "t_input", "t_output", "t_cache_read", "window"]
    # A report without a stamp is passed over, unless it has no usage object.
    decides = seen & (~F.col("has_last") | F.col("stamp").isNotNull())
    rows = df.groupBy("session_id").agg(
        F.max_by(F.struct(*fields), F.when(decides, F.col("ord"))).alias("r")
    )
    r = F.col("r")
    ok = r.has_last & (r.stamp <= now_us)
    put = lambda c: F.when(ok, c)
    context = r.input + r.output
    fits = (r.window > 0) & (context <= r.window)
    drop = r.window.isNotNull() & context.isNotNull() & ~fits
    return rows.select(
        "session_id",
        put(r.stamp).alias("usage_seq"),
        put(r.input).alias("input"),
        put(r.output).alias("output_tokens"),
        put(r.cache_read).alias("cache_read"),
        put(F.when(~drop, context)).alias("context"),
        put(F.when(~drop, r.window)).alias("window"),
        put(context_percent_a(context, r.window)).alias("context_percent"),
        put(r.t_input).alias("total_input"),
        put(r.t_output).alias("total_output"),
        put(F.when(r.t_cache_read <= r.t_input, r.t_input - r.t_cache_read)).alias(
            "total_uncached_input"
        ),
    )


# ------------------------------------------------------------------ format C
def adapter_totals(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Sum adapter entries; one missing or unsafe value poisons its column.

    ``cap`` is the entry count beyond which a session has no totals.
    """
    counted = F.col("c_type").isin("assistant", "usage", "compaction")
    names = COUNTERS
    agg = df.groupBy("session_id").agg(
        *[poison_sum(F.col(n), counted).alias(f"_{n}") for n in names],
        F.count_if(F.col("c_type") == "compaction").alias("compactions"),
        F.count_if(counted & F.col("has_usage")).alias("_measured"),
        F.count(F.lit(1)).alias("_entries"),
    )
    if cap is not None:
        agg = agg.filter(F.col("_entries") <= cap)
    put = lambda c: F.when(F.col("_measured") > 0, c)
    total = F.col("_input") + F.col("_cache_read") + F.col("_cache_write")
    return agg.select(
        "session_id",
        put(F.when(total <= SAFE, total)).alias("total_input"),
        put(F.col("_output")).alias("total_output"),
        put(F.col("_cache_read")).alias("total_cache_read"),
        put(F.col("_cache_write")).alias("total_cache_write"),
        put(F.col("_input")).alias("total_uncached_input"),
        "compactions",
    )


def adapter_latest_usage(
    df: DataFrame, live: DataFrame, now_us: int, depth: int | None = None
) -> DataFrame:
    """Usage of the newest assistant entry, of the last ``depth`` entries where
    one is given.

    ``live`` holds one already measured value per session; it stays only while
    its stamp is newer than the log's, or the log has none. The ranking filter
    is a per-task group limit before the shuffle, so a hot session is cheap.
    """
    if depth is not None:
        newest = Window.partitionBy("session_id").orderBy(F.col("ord").desc())
        df = df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= depth)
    recent = df.groupBy("session_id").agg(
        F.max_by(
            F.struct("stamp", *COUNTERS, "has_usage"),
            F.when(F.col("c_type") == "assistant", F.col("ord")),
        ).alias("n")
    )
    joined = recent.join(live, "session_id", "left")
    measured = F.col("n.has_usage") & (F.col("n.stamp") <= now_us)
    take = F.col("live_seq").isNull() | F.coalesce(
        measured & (F.col("n.stamp") >= F.col("live_seq")), F.lit(False)
    )

    def pick(new, old):
        return F.when(take, F.when(measured, new)).otherwise(old)

    return joined.select(
        "session_id",
        pick(F.col("n.stamp"), F.col("live_seq")).alias("usage_seq"),
        pick(F.col("n.input"), F.col("live_input")).alias("input"),
        pick(F.col("n.output"), F.col("live_output")).alias("output_tokens"),
    )


# ------------------------------------------------------- joins over readings
def merge_usage(metadata: DataFrame, replay: DataFrame, fields: list[str]) -> DataFrame:
    """Per session, the replay's field group replaces the metadata's when the
    metadata has no stamp or the replay's is not older; never field by field."""
    m = metadata.select("session_id", F.struct("usage_seq", *fields).alias("m"))
    r = replay.select("session_id", F.struct("usage_seq", *fields).alias("r"))
    both = m.join(r, "session_id", "full_outer")
    newer = F.col("r.usage_seq").isNotNull() & (
        F.col("m.usage_seq").isNull() | (F.col("r.usage_seq") >= F.col("m.usage_seq"))
    )
    pick = F.when(newer, F.col("r")).otherwise(F.col("m"))
    return both.select("session_id", pick.alias("u")).select(
        "session_id", "u.usage_seq", *[F.col(f"u.{f}").alias(f) for f in fields]
    )


def context_percent_b(context: Column, window: Column) -> Column:
    """Integer percent rounded half up; unknown unless 0 < window >= context."""
    half = F.floor(window / 2)
    value = F.floor((context * 100 + half) / window)
    return F.when((window > 0) & (context <= window), value.cast("long"))


def window_reading(usage: DataFrame, windows: DataFrame) -> DataFrame:
    """Attach the reported window; one smaller than the context, or reported by
    a remote source, is dropped with its percentage."""
    j = usage.join(windows, "session_id", "left")
    keep = ~F.coalesce("remote", F.lit(True)) & (F.col("window") > 0) & (
        F.col("context") <= F.col("window")
    )
    window = F.when(keep, F.col("window"))
    return j.select(
        "session_id",
        "context",
        window.alias("window"),
        context_percent_b(F.col("context"), window).alias("context_percent"),
    )


# ------------------------------------------------------------------ roll-ups
def seq_rollup(df: DataFrame, now_us: int, ring: int | None = None) -> DataFrame:
    """Coverage, usage and child stamps per session, and the newest usable."""
    usage = (
        usage_lines(df, ring)
        .groupBy("session_id")
        .agg(F.max(F.when(F.col("part") & ~F.col("reopened"), F.col("stamp"))).alias("usage_seq"))
    )
    base = df.groupBy("session_id").agg(F.max("stamp").alias("coverage_seq"))
    # An event before its child's first launch is not accepted, so the newest
    # accepted stamp is taken per child from the launch on.
    child = running(
        df.filter("child_event IS NOT NULL AND NOT forked AND NOT bad"),
        ["session_id", "child_key"],
        "ord",
        {"_known": Run("max", F.col("child_event").isin("launch", "sync"))},
    )
    child = (
        child.filter("_known").groupBy("session_id").agg(F.max("stamp").alias("child_seq"))
    )
    j = base.join(usage, "session_id", "left").join(child, "session_id", "left")
    status = F.coalesce("child_seq", "coverage_seq")

    def usable(c):
        return F.when((c > 0) & (c <= now_us), c)

    return j.select(
        "session_id",
        "coverage_seq",
        "usage_seq",
        status.alias("status_seq"),
        F.greatest(
            usable(F.col("coverage_seq")), usable(F.col("usage_seq")), usable(status)
        ).alias("seq"),
    )


FAILS = {
    "assistant": ["totals", "compactions", "turns"],
    "system": ["compactions", "turns"],
    "user": ["children", "turns"],
    "attachment": ["children", "turns"],
}
METRICS = ["totals", "compactions", "children", "turns"]


def failing_metrics(df: DataFrame) -> dict[str, Column]:
    """Per metric, whether the record makes it unknown."""
    lost = F.col("bad") & ~F.col("forked") & ~F.col("synthetic")
    out = {}
    for metric in METRICS:
        kinds = [k for k, hit in FAILS.items() if metric in hit]
        out[metric] = F.col("mismatch") | (lost & F.col("kind").isin(kinds))
    return out


def coverage_flags(df: DataFrame) -> DataFrame:
    """Which metrics survive every record of the session."""
    return df.groupBy("session_id").agg(
        *[(~F.bool_or(c)).alias(f"{m}_known") for m, c in failing_metrics(df).items()]
    )


def unknown_causes(df: DataFrame) -> DataFrame:
    """Category of the record at which each metric first became unknown."""
    flags = failing_metrics(df)
    cause = F.when(F.col("mismatch"), F.lit("mismatch")).otherwise(
        F.concat(F.lit("bad."), F.col("kind"))
    )
    firsts = df.groupBy("session_id").agg(
        *[F.min_by(cause, F.when(c, F.col("ord"))).alias(m) for m, c in flags.items()]
    )
    return (
        firsts.unpivot("session_id", METRICS, "metric", "cause")
        .filter(F.col("cause").isNotNull())
        .groupBy("metric", "cause")
        .agg(F.count(F.lit(1)).alias("sessions"))
    )
