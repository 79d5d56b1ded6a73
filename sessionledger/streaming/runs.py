"""Streams over segment files, and windowed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Run, running, scratch_path
from ..plans.scan import chunk_number


def land_segments(
    df: DataFrame, key: str, ord: str, parts: int = 4, rows_per_segment: int = 50_000_000, files: int | None = None
) -> str:
    """Land ``df`` as segments in ``ord`` order, as producers would.

    One pass cuts the data by segment; each segment is then landed from its own
    folder, so no segment re-reads the rest. All rows of a key are in one file
    of a segment, so file order is log order, and a segment bounds what one key
    can bring to a task. A segment has ``files`` files at most, by default
    what Spark makes of it. Returns the folder.
    """
    spark = df.sparkSession
    staging, path = scratch_path(spark, "staging"), scratch_path(spark, "landing")
    low, high, rows = df.agg(F.min(ord), F.max(ord), F.count(F.lit(1))).first()
    parts = max(parts, -(-rows // rows_per_segment))
    step = (high - low) // parts + 1
    segment = chunk_number(F.col(ord) - F.lit(low), step)
    cut = df.withColumn("_segment", segment).repartition("_segment", key)
    cut.write.partitionBy("_segment").parquet(staging)
    for i in range(parts):
        piece = spark.read.schema(df.schema).parquet(f"{staging}/_segment={i}")
        piece = piece.repartition(files, key) if files else piece.repartition(key)
        piece.write.mode("append").parquet(path)
    return path


def stream_segments(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Follow landed segments. Appended files are never re-read, so growth must
    land as new segments."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_session_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """Follow text logs that grow, one file each: ``value`` lines with ``session_id``, ``ord`` and
    ``file``; see :mod:`.growing`."""
    from . import growing

    return growing.session_lines(growing.follow_logs(spark, path, **options))


STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch uploads what it changed, not the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def started(writer, spark: SparkSession):
    """Start a stream whose state is in RocksDB: it may outgrow memory, and map states need it."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        return writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run a stream over all that has landed into a Parquet sink; read it back. With the ``out`` of
    an earlier run it goes on where that one ended."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", out + "-checkpoint")
    )
    started(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ------------------------------------------------------------------- windows
def activity_windows(
    df: DataFrame, at: str, length: str, slide: str | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Tokens, turns and aborts per tumbling or sliding window; batch or stream
    (a stream needs its watermark set before)."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return (
        df.groupBy(w.alias("w"), *keys)
        .agg(
            F.sum("tokens").alias("tokens"),
            F.count_if("is_turn").alias("turns"),
            F.count_if("is_abort").alias("aborts"),
        )
        .select(F.unix_micros("w.start").alias("start_us"), *keys, "tokens", "turns", "aborts")
    )


def activity_sessions(df: DataFrame, at_us: str, gap_us: int, key: str, span: int | None = None) -> DataFrame:
    """Activity per stretch without a pause longer than ``gap_us``.

    Batch form by chunked order, so one busy key is not one task; ``df`` needs
    a unique ``ord`` that follows time.
    """
    rows = running(df, [key], "ord", {"_p": Run("last", F.col(at_us), before=True)}, span)
    new = F.coalesce(F.col(at_us) - F.col("_p") >= gap_us, F.lit(True))
    rows = running(rows.withColumn("_new", new), [key], "ord", {"stretch": Run("sum", F.col("_new").cast("long"))}, span)
    return rows.groupBy(key, "stretch").agg(
        F.min(at_us).alias("start_us"),
        F.max(at_us).alias("end_us"),
        F.sum("tokens").alias("tokens"),
        F.count_if("is_turn").alias("turns"),
        F.count_if("is_abort").alias("aborts"),
    )


def dedup_stream(df: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Repeats of a key within the watermark delay are no-ops."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


# --------------------------------------------------------------------- batch
def dedup_reports(df: DataFrame, key: str, ord: str, seq: str, span: int | None = None) -> DataFrame:
    """Reports whose sequence is newer than every earlier one of their key."""
    rows = running(df, [key], ord, {"_top": Run("max", F.col(seq), before=True)}, span)
    return rows.filter(F.coalesce(F.col(seq) > F.col("_top"), F.lit(True))).drop("_top")


def late_and_future(df: DataFrame, limit: Column, span: int | None = None) -> DataFrame:
    """Per record: whether its stamp is accepted, and the newest accepted stamp
    so far. File order stays; an older stamp never lowers the mark."""
    ok = F.coalesce(F.col("stamp") <= limit, F.lit(False))
    rows = df.withColumn("accepted", ok)
    return running(
        rows, ["session_id"], "ord", {"newest": Run("max", F.when(F.col("accepted"), F.col("stamp")))}, span
    ).select("session_id", "ord", "accepted", "newest")


def upsert_latest(
    table: DataFrame, batch: DataFrame, key: str = "account_key", k: int | None = None
) -> DataFrame:
    """The table after ``batch``: the newest observation per key wins, an older
    or equal one is refused, and ``k`` keeps the newest rows overall."""
    both = table.withColumn("_src", F.lit(0)).unionByName(batch.withColumn("_src", F.lit(1)))
    rest = [c for c in table.columns if c != key]
    order = F.struct(F.col("sampled_at"), -F.col("_src"), -F.col("seq"))
    out = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    if k is not None:
        out = out.orderBy(F.col("sampled_at").desc(), "seq").limit(k)
    return out
