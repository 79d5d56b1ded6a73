"""Subagent outcomes per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Run, running

STATUSES = ["running", "completed", "interrupted", "errored", "unknown"]


def status_of(event: str = "child_event"):
    e = F.col(event)
    return (
        F.when(e.isin("launch", "resume"), "running")
        .when(e == "sync", "completed")
        .when(e.isin(*STATUSES), e)
        .otherwise("unknown")
    )


def launches(event: str = "child_event"):
    """Events that create a child: a background launch or a finished call."""
    return F.col(event).isin("launch", "sync")


def lost_roster(df: DataFrame):
    """Records after which the roster can no longer be trusted."""
    hurt = F.col("mismatch") | (
        F.col("bad") & ~F.col("forked") & F.col("kind").isin("user", "attachment")
    )
    return hurt | (F.col("child_lost") & ~F.col("forked")) if "child_lost" in df.columns else hurt


def _events(df: DataFrame) -> DataFrame:
    return df.filter(F.col("child_event").isNotNull() & ~F.col("forked") & ~F.col("bad"))


def known_children(df: DataFrame, span: int | None = None) -> DataFrame:
    """Child events with whether their child was launched earlier in the log."""
    return running(
        _events(df),
        ["session_id", "child_key"],
        "ord",
        {"known": Run("max", launches())},
        span,
    ).select("session_id", "ord", "child_key", "child_event", "known")


def child_outcomes(df: DataFrame, strict: bool = False, cap: int | None = None) -> DataFrame:
    """Counts per final child status.

    A child exists once launched, and its status is that of its last event. An
    event before the launch is ignored, or with ``strict`` makes the session's
    roster unknown. Beyond ``cap`` children the roster is unknown too.
    """
    per_child = (
        _events(df)
        .groupBy("session_id", "child_key")
        .agg(
            F.max_by(status_of(), "ord").alias("status"),
            F.bool_or(launches()).alias("launched"),
            (~F.min_by(launches(), "ord")).alias("early"),
        )
    )
    per_session = per_child.groupBy("session_id").agg(
        *[F.count_if(F.col("launched") & (F.col("status") == s)).alias(s) for s in STATUSES],
        F.count_if("launched").alias("total"),
        F.bool_or("early").alias("early"),
    )
    flags = df.groupBy("session_id").agg((~F.bool_or(lost_roster(df))).alias("valid"))
    own = per_session.withColumnRenamed("session_id", "_session")
    j = flags.join(own, F.col("session_id").eqNullSafe(F.col("_session")), "left")
    valid = F.col("valid")
    if strict:
        valid = valid & ~F.coalesce("early", F.lit(False))
    if cap is not None:
        valid = valid & (F.coalesce("total", F.lit(0)) <= cap)
    put = lambda n: F.when(valid, F.coalesce(n, F.lit(0))).alias(n)
    return j.select(
        "session_id",
        valid.alias("valid"),
        *[put(s) for s in STATUSES],
        put("total"),
        F.when(valid, F.coalesce("completed", F.lit(0))).alias("done"),
    )


def rollout_outcomes(events: DataFrame) -> DataFrame:
    """Outcomes of rollout logs, where an event before its child's start breaks the roster, and
    the stamp of the newest event in log order."""
    newest = events.groupBy(F.col("session_id").alias("_s")).agg(
        F.max_by("child_stamp", F.when(F.col("child_stamp").isNotNull(), F.col("ord"))).alias("child_seq")
    )
    counts = child_outcomes(events, strict=True)
    j = counts.join(newest, F.col("session_id").eqNullSafe(F.col("_s")), "left")
    return j.withColumn("child_seq", F.when(F.col("valid"), F.col("child_seq"))).drop("_s")
