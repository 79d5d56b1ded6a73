"""Corpus-level counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .usage import METRICS, coverage_flags


def corpus_counts(df: DataFrame) -> DataFrame:
    """Counters by dotted category; every prefix of a category is counted too.

    Each record yields a few keys, counted with map-side combine; session-level
    yes/no answers are added from one row per session.
    """
    c = F.col
    keys = F.array_compact(
        F.array(
            F.lit("lines"),
            F.concat(F.lit("kind."), F.coalesce("kind", F.lit("other"))),
            F.when(c("bad"), F.concat(F.lit("bad."), F.coalesce("kind", F.lit("other")))),
            F.when(c("forked"), "dropped.forked"),
            F.when(c("synthetic"), "dropped.synthetic"),
            F.when(c("mismatch"), "identity.mismatch"),
            F.when(c("subtype").isNotNull(), F.concat(F.lit("kind.system."), c("subtype"))),
        )
    )
    per_record = df.select(F.explode(keys).alias("key"))
    flags = coverage_flags(df)
    answers = F.array(
        F.lit("sessions"),
        *[
            F.concat(F.lit(f"known.{m}."), F.when(c(f"{m}_known"), "yes").otherwise("no"))
            for m in METRICS
        ],
    )
    per_session = flags.select(F.explode(answers).alias("key"))
    counted = per_record.unionByName(per_session).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Prefixes are added on the few counted keys, not on the records.
    parts = F.split("key", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")
    )
    return counted.select(F.explode(prefixes).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("value"))


def publishable_sessions(bindings: DataFrame, caught_up: DataFrame, usage: DataFrame) -> DataFrame:
    """Counts of bound sessions by caught up and by usage known."""
    j = bindings.select("session_id").join(
        caught_up.select("session_id", F.lit(True).alias("_c")).distinct(), "session_id", "left"
    ).join(usage.select("session_id", "usage_seq"), "session_id", "left")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    up = F.coalesce("_c", F.lit(False))
    return j.groupBy(yes(up).alias("caught_up"), yes(up & F.col("usage_seq").isNotNull()).alias("publishable")).agg(
        F.count(F.lit(1)).alias("sessions")
    )


def replay_agreement(a: DataFrame, b: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions on which two replays agree, NULL equal to NULL."""
    fields = [n for n in a.columns if n != key]
    j = a.select(key, F.struct(*fields).alias("_a")).join(
        b.select(key, F.struct(*fields).alias("_b")), key, "full_outer"
    )
    agree = F.when(F.col("_a").eqNullSafe(F.col("_b")), "yes").otherwise("no")
    return j.groupBy(agree.alias("agree")).agg(F.count(F.lit(1)).alias("sessions"))
