"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, numbered

SEED = 7
PLACES = {"home": T.IntegerType(), "shard": T.IntegerType(), "slot": T.LongType()}


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points and the shard that owns each."""
    points = [
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(n_shards)
        for v in range(vnodes)
    ]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(total: int, home: list[int], epsilon: float) -> list[int]:
    """Rows each shard may take: the same for all, ``(1 + epsilon)`` of the
    mean; with 0 exactly the rows there are, the fullest shards one more."""
    n = len(home)
    if epsilon > 0:
        return [-(-int(total * (1 + epsilon) * 1_000_000) // (n * 1_000_000)) + 1] * n
    extra = sorted(range(n), key=lambda s: (-home[s], s))[: total % n]
    return [total // n + (s in extra) for s in range(n)]


def fill(demand: np.ndarray, owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int]]:
    """Which rows of which arc go where: ``(first row, count, shard)`` over the
    rows of all arcs laid end to end. Each arc offers its rows to the shard at
    its end; what finds no room goes on clockwise, arc by arc."""
    start = np.concatenate([[0], np.cumsum(demand)[:-1]])
    left, room, parts = demand.copy(), list(room), []
    for step in range(len(owner)):
        open_arcs = np.flatnonzero(left)
        if not len(open_arcs):
            break
        for a in open_arcs:
            shard = int(owner[(a + step) % len(owner)])
            take = min(int(left[a]), room[shard])
            if take:
                parts.append((int(start[a] + demand[a] - left[a]), take, shard))
                left[a] -= take
                room[shard] -= take
    return sorted(parts)


def shard_rows(
    rows: DataFrame, key: str, n_shards: int, vnodes: int = 128, epsilon: float = 0.0
) -> DataFrame:
    """``rows`` plus ``home`` (the ring's shard for the key), ``shard`` (where
    the row goes under the load bound) and ``slot`` (its place there, gapless).

    Only the count of rows per ring arc (``n_shards * vnodes`` numbers) reaches
    the driver. Within an arc rows overflow in key-hash order. Any row counts
    as one, so repeated rows are spread like others; a NULL key is a key; an
    empty input gives an empty result. With ``epsilon`` 0 counts are at most
    one apart; a larger one moves fewer rows. ``rows`` should be narrow.
    Own columns named ``home``, ``shard`` or ``slot`` are replaced; other names
    cannot clash, as columns go by their place in between. Rows equal in key and
    all plain columns are placed in any order among themselves.
    """
    points, owner = ring(n_shards, vnodes)
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in PLACES]
    names = [f"c{i}" for i in range(len(own))]
    placed = rows.select(*[rows[f"`{c}`"].alias(n) for c, n in zip(own, names)], F.xxhash64(F.lit(SEED), rows[f"`{key}`"]).alias("_pos"))
    schema = T.StructType([*placed.schema, T.StructField("_arc", T.LongType())])

    def arcs(batches):
        for batch in batches:
            pos = batch.column("_pos").to_numpy(zero_copy_only=False)
            arc = np.searchsorted(points, pos) % len(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int64())], names=[*batch.schema.names, "_arc"])

    order = ["_pos", *[n for n in names if not isinstance(placed.schema[n].dataType, (T.MapType, T.ArrayType, T.StructType))]]
    ranked = numbered(in_arrow(placed, arcs, schema), "_arc", order, "ring")
    demand = np.zeros(len(points), np.int64)
    for arc, n in ranked.groupBy("_arc").agg(F.max("rank") + 1).collect():
        demand[arc] = n
    home = [int(demand[owner == s].sum()) for s in range(n_shards)]
    parts = fill(demand, owner, capacities(int(demand.sum()), home, epsilon))
    first = np.array([p[0] for p in parts], np.int64)
    shard_of = np.array([p[2] for p in parts], np.int64)
    base, used = np.zeros(len(parts), np.int64), [0] * n_shards
    for i, (_, count, shard) in enumerate(parts):
        base[i], used[shard] = used[shard], used[shard] + count
    begin = np.concatenate([[0], np.cumsum(demand)[:-1]])
    out = T.StructType([*[placed.schema[n] for n in names], *[T.StructField(n, t) for n, t in PLACES.items()]])

    def assign(batches):
        for batch in batches:
            arc = batch.column("_arc").to_numpy(zero_copy_only=False)
            at = begin[arc] + batch.column("rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(owner[arc].astype(np.int32)),
                    pa.array(shard_of[i].astype(np.int32)),
                    pa.array(base[i] + at - first[i], pa.int64()),
                ],
                names=[*names, *PLACES],
            )

    result = in_arrow(ranked, assign, out) if parts else spark.createDataFrame([], out)
    return result.toDF(*own, *PLACES)
