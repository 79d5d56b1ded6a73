"""Ordered running values per key that survive a hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here each
key is cut into chunks of at most ``span`` consecutive order values, windows
run per ``(key, chunk)``, and only one summary row per chunk is ordered per
key. The summary is a map-side combined aggregate, so a key holding a third of
all rows costs ``rows / span`` summary rows in its largest task. What earlier
chunks hand on enters a chunk as a row before its first, so no join is needed
and a NULL key is carried like any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN_CONF = "sessionledger.scan.span"
DEFAULT_SPAN = 1 << 24
CHUNK = "_chunk"
ROW = "_row"  # false on the row that brings in what earlier chunks hand on


class Run(NamedTuple):
    """One running value.

    ``how``: ``sum`` (NULL counts as nothing, 0 when empty), ``max``, ``min``,
    ``last`` / ``first`` (latest / earliest non-NULL so far) or ``next``
    (nearest later non-NULL). ``before`` leaves the current row out; ``next``
    always does. Wrap a nullable value in a struct to tell "row takes part,
    value NULL" from "row does not take part".
    """

    how: str
    value: Column
    before: bool = False


def default_span(spark: SparkSession) -> int:
    return int(spark.conf.get(SPAN_CONF, str(DEFAULT_SPAN)))


def chunk_number(ord: str | Column, span: int) -> Column:
    """Floor of ``ord / span`` in whole numbers, exact beyond 2^53."""
    at = (F.col(ord) if isinstance(ord, str) else ord).cast("long")
    return F.call_function("div", at - F.pmod(at, F.lit(span)), F.lit(span))


def with_chunk(df: DataFrame, ord: str, span: int | None = None) -> DataFrame:
    """Add the chunk number of integer order column ``ord`` unless present."""
    if CHUNK in df.columns:
        return df
    span = span or default_span(df.sparkSession)
    return df.withColumn(CHUNK, chunk_number(ord, span))


def _local(run: Run, parts: list[str], ord: str) -> Column:
    asc = Window.partitionBy(*parts).orderBy(F.col(ROW), F.col(ord))
    value = F.when(F.col(ROW), run.value)
    frame = asc.rowsBetween(Window.unboundedPreceding, -1 if run.before else 0)
    # A frame that ends at unbounded following is re-read for every row, so
    # "next" looks back over the reversed order instead.
    back = Window.partitionBy(*parts).orderBy(F.col(ROW).desc(), F.col(ord).desc())
    return {
        "sum": lambda: F.coalesce(F.sum(value).over(frame), F.lit(0)),
        "max": lambda: F.max(value).over(frame),
        "min": lambda: F.min(value).over(frame),
        "last": lambda: F.last(value, ignorenulls=True).over(frame),
        "first": lambda: F.first(value, ignorenulls=True).over(frame),
        "next": lambda: F.last(value, ignorenulls=True).over(
            back.rowsBetween(Window.unboundedPreceding, -1)
        ),
    }[run.how]()


def _summary(run: Run, ord: str) -> Column:
    at = F.when(run.value.isNotNull(), F.col(ord))
    return {
        "sum": lambda: F.sum(run.value),
        "max": lambda: F.max(run.value),
        "min": lambda: F.min(run.value),
        "last": lambda: F.max_by(run.value, at),
        "first": lambda: F.min_by(run.value, at),
        "next": lambda: F.min_by(run.value, at),
    }[run.how]()


def _carry(how: str, name: str, keys: list[str]) -> Column:
    order = F.col(CHUNK).desc() if how == "next" else F.col(CHUNK)
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    col = F.col(name)
    if how in ("last", "next"):
        return F.last(col, ignorenulls=True).over(past)
    if how == "first":
        return F.first(col, ignorenulls=True).over(past)
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](col).over(past)


def _combine(how: str, local: Column, carry: Column) -> Column:
    return {
        "sum": lambda: local + F.coalesce(carry, F.lit(0)),
        "max": lambda: F.greatest(local, carry),
        "min": lambda: F.least(local, carry),
        "last": lambda: F.coalesce(local, carry),
        "next": lambda: F.coalesce(local, carry),
        "first": lambda: F.coalesce(carry, local),
    }[how]()


def running(
    df: DataFrame,
    keys: list[str],
    ord: str,
    outs: dict[str, Run],
    span: int | None = None,
) -> DataFrame:
    """``df`` plus one column per entry of ``outs``; keeps the chunk column so
    a following call reuses the same partitioning."""
    df = with_chunk(df, ord, span)
    parts = [*keys, CHUNK]
    base = df.columns
    carry = {n: f"_c_{n}" for n in outs}
    summary = df.groupBy(*parts).agg(*[_summary(r, ord).alias(carry[n]) for n, r in outs.items()])
    carried = summary.select(
        *parts, F.lit(False).alias(ROW), *[_carry(r.how, carry[n], keys).alias(carry[n]) for n, r in outs.items()]
    )
    rows = df.withColumn(ROW, F.lit(True)).unionByName(carried, allowMissingColumns=True)
    head = Window.partitionBy(*parts).orderBy(F.col(ROW), F.col(ord)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *base,
        ROW,
        *[_local(r, parts, ord).alias(f"_l_{n}") for n, r in outs.items()],
        *[F.first(carry[n]).over(head).alias(carry[n]) for n in outs],
    )
    return local.filter(ROW).select(
        *base,
        *[_combine(r.how, F.col(f"_l_{n}"), F.col(carry[n])).alias(n) for n, r in outs.items()],
    )
