"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionledger.plans.ship import ship_package
from sessionledger.plans.store import ensure_checkpoint_dir


#: DuckDB SQL: crc32 of the bytes of the hex string ``{hex}``, bit by bit.
CRC32_SQL = """xor(list_reduce([4294967295::bigint] || list_transform(range(0, length({hex}) // 2),
      lambda i: ('0x' || substr({hex}, 2 * i + 1, 2))::bigint),
    lambda c, b: list_reduce([xor(c, b)] || range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs do not
    compute it again, and it outlives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; NULL has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows."""
    n = len(columns[0])
    if n == 0:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` plus ``rank``: the place of a row, from 0, within the integer
    column ``group`` in ``order`` (rows equal in both in any order).

    Rows are range-partitioned by group and order, so a group of any size
    spreads over tasks; each task numbers its own runs and only one count per
    task and group is summed up.
    """
    ranged = (
        df.withColumn("_tie", F.rand(11))
        .repartitionByRange(group, *order, "_tie")
        .sortWithinPartitions(group, *order, "_tie")
        .drop("_tie")
    )
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def local(batches):
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            g = batch.column(group).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            starts = run_starts(g)
            sizes = np.diff(np.append(starts, len(g)))
            at = np.arange(len(g)) - np.repeat(starts, sizes)
            if last is not None and g[0] == last:
                at[: sizes[0]] += count
            last, count = g[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(at, pa.int64())],
                names=[*batch.schema.names, "_part", "_at"],
            )

    rows = landed(in_arrow(ranged, local, schema), name)
    past = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(group, "_part")
        .agg(F.count("*").alias("_n"))
        .select(group, "_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_base"))
    )
    return (
        rows.join(bases, [group, "_part"])
        .withColumn("rank", F.col("_base") + F.col("_at"))
        .select(*df.columns, "rank")
    )
