"""Folds over rows that come out of order: late, repeated and future ones are told, not lost.

A log's own order is ``ord``; micro-batches may bring it shuffled. Each key has a mark
that only rises, its highest ``ord`` so far less ``slack``. Rows at or below it are
settled: they went through the fold in order and never change. Rows above it are held,
one entry of a map state each, and told as they stand now, under the number of the
micro-batch; the newest number of a key replaces the ones before. A row that comes when
the mark has passed it, comes again or has no order is refused, with its reason, as a side
output. Spark's own watermark is one for all keys and drops late rows unseen, so it
would tell neither which rows were refused nor let a slow key lag behind a fast one.

A key holds as many rows as lie within ``slack`` of its newest; all else is constant.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..plans.ship import ship_package


class OrderedFold(NamedTuple):
    """What is made of a key's rows in order. ``step`` and ``open`` return lists of told rows."""

    inputs: list[str]
    told: str  # schema of a told row
    start: Callable[[], dict]
    step: Callable[[dict, int, list], list[tuple]]
    open: Callable[[dict], list[tuple]]  # what stands until more rows come


class Ordered(StatefulProcessor):
    def __init__(self, fold: OrderedFold, slack: int, names: list[str], width: int):
        self.fold, self.slack, self.names, self.width = fold, slack, names, width

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "text string")
        self.held = handle.getMapState("held", "ord long", "text string")

    def handleInputRows(self, key, rows, timerValues):
        fold, event = self.fold, Row(*self.names)
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"seq": 0, "top": None, "fold": fold.start()}
        s["seq"] += 1
        mark = None if s["top"] is None else s["top"] - self.slack
        held = {k[0]: json.loads(v[0]) for k, v in self.held.iterator()}
        fresh = {}
        for row in rows:
            at, content = row["ord"], [row[c] for c in fold.inputs]
            if at is None:
                why = "unordered"
            elif mark is not None and at <= mark:
                why = "late"
            elif at in held:
                why = "repeat"
            else:
                held[at] = fresh[at] = content
                continue
            yield event(key[0], s["seq"], True, why, at, Row(*fold.inputs)(*content), *[None] * self.width)
        if held:
            s["top"] = max(held) if s["top"] is None else max(s["top"], max(held))
        order = sorted(held)
        cut = sum(at <= s["top"] - self.slack for at in order) if order else 0
        for at in order[:cut]:
            for told in fold.step(s["fold"], at, held[at]):
                yield event(key[0], s["seq"], True, None, at, None, *told)
            if at not in fresh:
                self.held.removeKey((at,))
        for at in order[cut:]:
            if at in fresh:
                self.held.updateValue((at,), (json.dumps(held[at]),))
        self.state.update((json.dumps(s),))
        now, last = copy.deepcopy(s["fold"]), None
        for last in order[cut:]:
            for told in fold.step(now, last, held[last]):
                yield event(key[0], s["seq"], False, None, last, None, *told)
        for told in fold.open(now):
            yield event(key[0], s["seq"], False, None, last, None, *told)

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, key: str, fold: OrderedFold, slack: int) -> DataFrame:
    """Events of ``fold`` per ``key`` over rows with ``ord``, unique in a key, whatever their order
    within ``slack`` (at least 0). Read them with :func:`standing` and :func:`refused`.

    NULL keys are a key. Of rows with one ``ord`` the first to come counts. The stream needs the
    RocksDB state store, which ``run_to_table`` sets."""
    if slack < 0:
        raise ValueError("slack is at least 0")
    ship_package(rows.sparkSession)
    told = T.StructType.fromDDL(fold.told)
    narrow = rows.select(key, "ord", *fold.inputs)
    fields = [
        narrow.schema[key],
        T.StructField("seq", T.LongType()),
        T.StructField("settled", T.BooleanType()),
        T.StructField("refused", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("row", T.StructType([narrow.schema[c] for c in fold.inputs])),
        *told,
    ]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    processor = Ordered(fold, slack, [f.name for f in out], len(told))
    return narrow.groupBy(key).transformWithState(processor, out, "Append", "None")


def standing(events: DataFrame, key: str) -> DataFrame:
    """Told rows as they stand: settled ones, and of each key those of its newest micro-batch."""
    rest = [c for c in events.columns if c not in ("seq", "refused", "row")]
    told = events.filter("refused IS NULL")
    newest = events.groupBy(F.col(key).alias("_key")).agg(F.max("seq").alias("_seq"))
    now = told.filter(~F.col("settled")).join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col("seq") == F.col("_seq")), "left_semi")
    return told.filter("settled").select(rest).unionByName(now.select(rest))


def refused(events: DataFrame, key: str) -> DataFrame:
    """The side output: rows that were not let in, and why (``late``, ``repeat``, ``unordered``)."""
    return events.filter("refused IS NOT NULL").select(key, "ord", "refused", "row.*")


# --------------------------------------------------------------------- machines
def marks(limit: int) -> OrderedFold:
    """Per record whether its stamp is accepted, and the newest accepted stamp so far: a stamp past
    ``limit`` is refused, an older one never lowers the mark. Twin of ``late_and_future``."""

    def step(s, at, row):
        accepted = row[0] is not None and row[0] <= limit
        if accepted and (s["newest"] is None or row[0] > s["newest"]):
            s["newest"] = row[0]
        return [(accepted, s["newest"])]

    return OrderedFold(["stamp"], "accepted boolean, newest long", lambda: {"newest": None}, step, lambda s: [])


def _reset(s, at, row):
    generation, output = row
    done = []
    if s["now"] is not None and s["now"][0] != generation:
        done, s["now"] = [tuple(s["now"])], None
    if s["now"] is None:
        s["now"] = [generation, 0, None, at]
    s["now"][1] += 1
    if output is not None:
        s["now"][2] = (s["now"][2] or 0) + output
    return done


#: The state of a key restarts when its generation changes; a generation is told when it ends.
GENERATIONS = OrderedFold(
    ["generation", "output"],
    "generation long, samples long, output long, first_ord long",
    lambda: {"now": None},
    _reset,
    lambda s: [tuple(s["now"])] if s["now"] else [],
)


def generation_totals(events: DataFrame, key: str) -> DataFrame:
    """One row per key and generation; one that came back after another is summed up."""
    return standing(events, key).groupBy(key, "generation").agg(
        F.sum("samples").alias("samples"), F.sum("output").alias("output"), F.min("first_ord").alias("first_ord")
    )
