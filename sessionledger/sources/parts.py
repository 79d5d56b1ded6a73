"""Logs of many sessions written as parts without shuffling their text.

Every task writes its own lines as one part. A small manifest says, for each
session that lies in several parts, where each part comes in its order and how
many lines lie before it. Readers number lines within the files they read and
set the parts of a session right by the manifest once the text is parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .logs import SEGMENT, log_order

RUNS = "session_id string, part bigint, place bigint, lines bigint, before bigint"


def session_runs(lines: DataFrame) -> DataFrame:
    """(session_id, part, low, high, place, lines, before) of sessions in more
    than one partition: a partition's ``place`` in the order of the session's
    and the number of lines in the ones before. Text is not read, and counts
    are combined before the shuffle."""
    held = lines.groupBy(F.col("session_id").cast("string").alias("session_id"), F.spark_partition_id().cast("bigint").alias("part")).agg(
        F.min("ord").alias("low"), F.max("ord").alias("high"), F.count(F.lit(1)).alias("lines")
    )
    order = Window.partitionBy("session_id").orderBy("low", "high", "part")
    runs = held.withColumns(
        {
            "place": F.row_number().over(order).cast("bigint") - 1,
            "before": F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_last": F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "_parts": F.count(F.lit(1)).over(Window.partitionBy("session_id")),
        }
    )
    return runs.filter("_parts > 1")


def in_place(lines: DataFrame) -> bool:
    """Whether partitions are those of a scan, so that a second job cuts them
    alike. Adaptive execution may cut shuffled ones otherwise each time."""
    return "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()


def write_log_parts(lines: DataFrame, path: str, mode: str = "error") -> bool:
    """Write ``value`` rows under ``path/lines``, the manifest under ``path/runs``.

    A session may lie in several partitions of ``lines`` if these follow each
    other in ``ord``, as those of time-ordered or chunked tables do. Where two
    overlap, or ``lines`` comes out of a shuffle, it is range-partitioned by
    (session_id, ord) instead. Returns whether text stayed in place. Lines of
    no ``ord`` come first in their part; a NULL session is one session; lines
    of equal ``ord`` keep no order; other columns are not written.
    """
    spark, runs = lines.sparkSession, f"{path}/runs"
    kept = in_place(lines)
    if kept:
        session_runs(lines.select("session_id", "ord")).write.mode(mode).parquet(runs)
        kept = spark.read.parquet(runs).filter("low IS NULL OR low <= _last").isEmpty()
    if not kept:
        # Range partitions ascend with their numbers, so no part is out of place.
        spark.createDataFrame([], RUNS).write.mode("overwrite").parquet(runs)
        lines = lines.repartitionByRange("session_id", "ord")
    lines.sortWithinPartitions("session_id", "ord").select("value").write.mode(mode).text(f"{path}/lines")
    return kept


def read_log_parts(spark: SparkSession, path: str, session_path: str = "$.sessionId") -> DataFrame:
    """Lines of :func:`write_log_parts`; the session id is inside the record.
    ``ord`` follows the files; parse, then call :func:`in_session_order`."""
    rows = log_order(spark.read.text(f"{path}/lines")).filter(F.length("value") > 0)
    return rows.withColumn("session_id", F.get_json_object("value", session_path))


def in_session_order(records: DataFrame, path: str) -> DataFrame:
    """Records with the part in ``ord`` replaced by its place in the session.

    Records have no text any more, so this join moves little; a hot session is
    split by its parts, and without runs there is no join."""
    runs = records.sparkSession.read.schema(RUNS).parquet(f"{path}/runs")
    if runs.isEmpty():
        return records
    part = F.call_function("div", F.col("ord"), F.lit(SEGMENT))
    keys = runs.select(F.col("session_id").alias("_session"), F.col("part").alias("_part"), F.col("place").alias("_place"))
    on = F.col("_session").eqNullSafe(F.col("session_id").cast("string")) & (F.col("_part") == part)
    moved = F.coalesce("_place", part) * SEGMENT + F.pmod("ord", F.lit(SEGMENT))
    return records.join(keys, on, "left").withColumn("ord", moved).drop("_session", "_part", "_place")
