"""Stretches in which a host is heard, as a stream that also tells who is live now.

Tasks first join the samples they hold to stretches, so a busy host brings few rows to
its state. The state keeps the stretches that the watermark has not passed; a timer at
last sample plus gap closes one when nothing more can reach it. Each change is told
as the host's open stretches under a rising number, so that the newest of them
stands for the host, and a closed one for itself.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.ship import ship_package

OUT = "host long, seq long, open boolean, live_from long, last_seen long, samples long"


def joined(stretches: list[list[int]], gap: int) -> list[list[int]]:
    """Stretches (first, last, samples) in order, those no more than ``gap`` apart made one."""
    out: list[list[int]] = []
    for first, last, n in sorted(stretches):
        if out and first - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += n
        else:
            out.append([first, last, n])
    return out


def local_stretches(df: DataFrame, gap: int) -> DataFrame:
    """Samples (host, ts) as stretches of what a task holds at once: (host, first, last, n, ts)."""

    def run(batches):
        for batch in batches:
            host = batch.column("host").to_numpy(zero_copy_only=False)
            at = batch.column("second").to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            order = np.lexsort((at, host))
            host, at = host[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (host[1:] != host[:-1]) | (at[1:] - at[:-1] > gap)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(host[begin]), pa.array(at[begin]), pa.array(at[end - 1]), pa.array(end - begin)], names=["host", "first", "last", "n"]
            )

    rows = df.filter("host IS NOT NULL AND ts IS NOT NULL").select(F.col("host").cast("long").alias("host"), F.unix_seconds("ts").alias("second"))
    found = rows.mapInArrow(run, "host long, first long, last long, n long")
    return found.withColumn("ts", F.timestamp_seconds("last"))


class Liveness(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "text string")

    def load(self) -> tuple[int, list]:
        seq, stretches = json.loads(self.state.get()[0]) if self.state.exists() else (0, [])
        return seq + 1, stretches

    def told(self, host: int, seq: int, closed: list, open_: list) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for last in {s[1] for s in open_}:
            self.handle.registerTimer((last + self.gap) * 1000)
        self.state.update((json.dumps([seq, open_]),))
        rows = [(host, seq, False, *s) for s in closed] + [(host, seq, True, *s) for s in open_]
        return pd.DataFrame(rows, columns=["host", "seq", "open", "live_from", "last_seen", "samples"])

    def handleInputRows(self, key, rows, timerValues):
        seq, stretches = self.load()
        for frame in rows:
            stretches += [list(map(int, s)) for s in zip(frame["first"], frame["last"], frame["n"])]
        yield self.told(int(key[0]), seq, [], joined(stretches, self.gap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seq, stretches = self.load()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        closed = [s for s in stretches if (s[1] + self.gap) * 1000 <= passed]
        yield self.told(int(key[0]), seq, closed, [s for s in stretches if s not in closed])

    def close(self) -> None:
        pass


def host_liveness(df: DataFrame, gap: int, delay: str) -> DataFrame:
    """Stream of changes from samples (host, ts): see :func:`live_now`. A sample that is later than
    ``delay`` allows may be refused; NULL hosts and times are no samples."""
    ship_package(df.sparkSession)
    stretches = local_stretches(df, gap).withWatermark("ts", delay)
    return stretches.groupBy("host").transformWithStateInPandas(Liveness(gap), OUT, "Append", "EventTime")


def live_now(changes: DataFrame, gap: int) -> DataFrame:
    """Every stretch so far: closed ones, and what each host's newest change says is open."""
    newest = changes.groupBy("host").agg(F.max("seq").alias("_seq"))
    rows = changes.join(newest, "host").filter(~F.col("open") | (F.col("seq") == F.col("_seq")))
    return rows.select("host", "live_from", (F.col("last_seen") + gap).alias("unreachable_at"), "samples", "open")
