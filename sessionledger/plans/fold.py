"""Sequential state machines over ordered keys, split so no key sits in one task.

A key of more than ``span`` rows is cut into chunks of at most ``span`` consecutive order
values; any other key is one chunk, however far its orders lie apart. Keys
of one chunk are replayed once; of longer keys each chunk's entry state is found
first, in one of two ways, and then all chunks are replayed side by side.

* A machine with a ``Prefix`` reads every chunk once as a function from any entry state
  to its exit state. Functions of neighbouring chunks are composed ``FAN`` at a time
  up to one per key, and entry states are handed down again: twice the logarithm of
  the number of chunks in steps, over rows as small as one function.
* Any other machine replays chunks from a guessed entry state. A chunk whose guess
  differs from its predecessor's exit is replayed again, until every entry equals the
  exit before it; by induction over the chunks the result is then exactly the
  sequential one. What such a machine never forgets moves on one chunk a pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scan import CHUNK, chunk_number
from .ship import ship_package
from .store import ensure_checkpoint_dir

SPAN_CONF = "sessionledger.fold.span"
DEFAULT_SPAN = 1 << 20


FAN = 16


class Prefix(NamedTuple):
    """Chunks as functions of their entry state, as text.

    ``stretch(highest)`` makes a reader with ``step(row)`` and ``text()``; ``composed(texts)`` is
    the function of chunks in order; ``walked(entry, high, texts)`` gives each chunk's
    entry and its ``high``. ``bound()`` is a column whose running maximum bounds the ``high`` entry.

    What a machine must know of a key's whole past is no state but a fact of the data: rows where
    ``asks`` is true ask whether an event ``event`` with their ``key`` as its text came earlier,
    and get the answer as the input ``answer``, NULL where the state itself knows.
    """

    stretch: Callable
    composed: Callable[[list[str]], str]
    walked: Callable
    bound: Callable[[], Column]
    asks: str
    key: str
    event: str
    answer: str


class Machine(NamedTuple):
    """A replayable machine.

    ``start()`` makes a state (a JSON-able dict); ``step(state, row, emit)``
    advances it over ``row`` (values of ``inputs`` in order, ``ord`` first) and
    calls ``emit(ord, event, a, b, text)``. ``high`` names the one state entry
    that only ever rises; it is carried as a running maximum over chunks, so it
    settles in one pass. ``memory`` names mappings that grow with the key, which ``start()`` leaves
    out: a stream gives them to ``step`` as parts of the state and keeps each
    of their entries as a row of its state store.
    """

    inputs: list[str]
    start: Callable[[], dict]
    step: Callable[[dict, tuple, Callable], None]
    high: str
    memory: tuple[str, ...] = ()
    prefix: Prefix | None = None


KEY = "_key"  # the keys as one struct, which is never NULL: NULL keys join like others
STATE = "state"  # the event that carries a chunk's exit state
EVENT_FIELDS = [
    T.StructField("ord", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType()),
    T.StructField("text", T.StringType()),
]


def dump_state(machine: Machine, state: dict) -> str:
    return json.dumps({k: v for k, v in state.items() if k != machine.high}, sort_keys=True)


def load_state(machine: Machine, text: str | None, high: int | None) -> dict:
    state = machine.start()
    if text is not None:
        state.update(json.loads(text))
    if high is not None:
        state[machine.high] = max(state[machine.high], high)
    return state


def _inputs(machine: Machine) -> list[str]:
    return [*machine.inputs, machine.prefix.answer] if machine.prefix else machine.inputs


def _grouped(rows: DataFrame, keys: list[str], machine: Machine, schema: T.StructType, run: Callable) -> DataFrame:
    """``run`` over the rows of every (key, chunk) group, in order.

    The row number is what keeps a chunk whole: its window obliges Spark to
    bring each group to one task in order, where an explicit repartition may be
    planned away by an adaptive join. Tasks stream through many groups, a new
    one starting at each number 1.
    """
    number = F.row_number().over(Window.partitionBy(KEY, CHUNK).orderBy(machine.inputs[0]))
    return (
        rows.select(*keys, CHUNK, KEY, "entry", "entry_hi", *_inputs(machine))
        .withColumn("_n", number)
        .drop(KEY)
        .mapInArrow(run, schema)
    )


def _rows(batch: pa.RecordBatch, lead: list[str], inputs: list[str]):
    """Per row: its number in the group, the group, what it is entered with, the inputs."""
    data = batch.to_pydict()
    entries = zip(data["entry"], data["entry_hi"])
    return zip(data["_n"], zip(*[data[k] for k in lead]), entries, zip(*[data[c] for c in inputs]))


def _replay(rows: DataFrame, keys: list[str], machine: Machine, events: bool) -> DataFrame:
    """Replay every (key, chunk) group; yield its events, or its exit state."""
    lead, inputs = [*keys, CHUNK], _inputs(machine)
    spark_keys = [T.StructField(k, rows.schema[k].dataType) for k in lead]
    if events:
        schema = T.StructType([*spark_keys, *EVENT_FIELDS])
    else:
        schema = T.StructType(
            [*spark_keys]
            + [T.StructField(n, T.StringType()) for n in ("entry", "exit")]
            + [T.StructField(n, T.LongType()) for n in ("entry_hi", "exit_hi")]
        )
    out_schema = to_arrow_schema(schema)

    def run(batches):
        group, entry, state, last = None, None, None, None
        out: list[tuple] = []

        def emit(*event):
            out.append((*group, *event))

        sink = emit if events else (lambda *event: None)

        def close():
            if group is None:
                return
            text, high = dump_state(machine, state), state[machine.high]
            if events:
                emit(last, STATE, None, high, text)
            else:
                out.append((*group, entry[0], text, entry[1], high))

        def flush():
            columns = list(zip(*out)) if out else [[] for _ in out_schema]
            out.clear()
            arrays = [pa.array(c, t) for c, t in zip(columns, out_schema.types)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        for batch in batches:
            for n, g, e, row in _rows(batch, lead, inputs):
                if n == 1:
                    close()
                    group, entry, state = g, e, load_state(machine, *e)
                machine.step(state, row, sink)
                last = row[0]
            yield flush()
        close()
        yield flush()

    return _grouped(rows, keys, machine, schema, run)


def _functions(rows: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """Of every (key, chunk) group its function: (keys, chunk, text)."""
    lead, inputs = [*keys, CHUNK], _inputs(machine)
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in lead], T.StructField("text", T.StringType())])
    out_schema = to_arrow_schema(schema)

    def run(batches):
        group, stretch, out = None, None, []

        def flush():
            columns = list(zip(*out)) if out else [[] for _ in out_schema]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_schema.types)], schema=out_schema)

        for batch in batches:
            for n, g, (_, highest), row in _rows(batch, lead, inputs):
                if n == 1:
                    if group is not None:
                        out.append((*group, stretch.text()))
                    group, stretch = g, machine.prefix.stretch(highest)
                stretch.step(row)
            yield flush()
        if group is not None:
            out.append((*group, stretch.text()))
        yield flush()

    return _grouped(rows, keys, machine, schema, run)


def _prefix_entries(hot: DataFrame, keys: list[str], machine: Machine, long_keys: DataFrame, chunks: int) -> DataFrame:
    """What each chunk of the long keys is entered with: (key, chunk, entry, entry_hi)."""
    composed = F.pandas_udf(lambda texts: texts.map(lambda t: machine.prefix.composed(list(t))), T.StringType())
    entry_type = T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("entry_hi", T.LongType())]))

    @F.pandas_udf(entry_type)
    def walked(entry: pd.Series, high: pd.Series, texts: pd.Series) -> pd.Series:
        found = [machine.prefix.walked(None if pd.isna(e) else e, int(h), list(t)) for e, h, t in zip(entry, high, texts)]
        return pd.Series([[{"entry": a, "entry_hi": b} for a, b in x] for x in found])

    at = [KEY, CHUNK]
    past = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        hot.groupBy(*at).agg(F.max(machine.prefix.bound()).alias("_top"))
        .select(*at, F.greatest(F.coalesce(F.max("_top").over(past), F.lit(0)), F.lit(0)).alias("entry_hi"))
    )
    read = _functions(hot.join(bounds, at).withColumn("entry", F.lit(None).cast("string")), keys, machine)
    level = read.withColumn(KEY, F.struct(*keys)).join(long_keys, KEY).select(KEY, (F.col(CHUNK) - F.col("_lo")).alias("pos"), "text").checkpoint()
    levels = []
    while chunks > 1:
        members = F.array_sort(F.collect_list(F.struct("pos", "text")))
        groups = level.groupBy(KEY, F.floor(F.col("pos") / FAN).alias("_g")).agg(members.alias("members"))
        level = groups.select(KEY, F.col("_g").alias("pos"), "members", composed("members.text").alias("text")).checkpoint()
        levels.append(level)
        chunks = -(-chunks // FAN)
    entries = level.select(KEY, "pos", F.lit(None).cast("string").alias("entry"), F.lit(0).cast("long").alias("entry_hi"))
    for level in reversed(levels):
        found = walked("entry", "entry_hi", "members.text")
        each = level.join(entries, [KEY, "pos"]).select(KEY, F.explode(F.arrays_zip(F.col("members.pos").alias("pos"), found.alias("at"))).alias("m"))
        entries = each.select(KEY, "m.pos", "m.at.entry", "m.at.entry_hi")
    return entries.join(long_keys, KEY).select(KEY, (F.col("pos") + F.col("_lo")).alias(CHUNK), "entry", "entry_hi").checkpoint()


def _prefix_fold(rows: DataFrame, keys: list[str], machine: Machine, long_keys: DataFrame, chunks: int) -> DataFrame:
    """Events of a machine with a ``Prefix``. Answers are found by asking again with those of the
    last round until none changes; without rows that ask there is one round."""
    how, ord, whole = machine.prefix, machine.inputs[0], F.struct(*keys)
    hot = rows.join(long_keys.select(KEY), KEY, "left_semi").checkpoint()
    asking = hot.filter(F.coalesce(F.col(how.asks), F.lit(False))).select(KEY, ord, F.col(how.key).alias("_asked"))
    answered = None
    while True:
        ready = hot
        if answered is not None:
            ready = hot.drop(how.answer).join(answered, [KEY, ord], "left")
        ready = ready.withColumn(how.answer, F.coalesce(how.answer, F.lit(False)))
        entries = _prefix_entries(ready, keys, machine, long_keys, chunks)
        if asking.isEmpty():
            break
        told = _replay(ready.join(entries, [KEY, CHUNK]), keys, machine, events=True).filter(F.col("event") == how.event)
        first = told.groupBy(whole.alias(KEY), F.col("text").alias("_asked")).agg(F.min("ord").alias("_first"))
        now = asking.join(first, [KEY, "_asked"]).filter(F.col("_first") < F.col(ord)).select(KEY, ord, F.lit(True).alias(how.answer)).checkpoint()
        before = hot.limit(0).select(KEY, ord, how.answer) if answered is None else answered
        if now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty():
            break
        answered = now
    if answered is not None:
        rows = rows.drop(how.answer).join(answered, [KEY, ord], "left")
    at = entries.withColumn("_long", F.lit(True))
    ready = rows.join(at, [KEY, CHUNK], "left")
    # The state of a short key knows the key's whole past; that of a chunk does not.
    answer = F.when(F.col("_long"), F.coalesce(how.answer, F.lit(False)))
    return _replay(ready.withColumn(how.answer, answer), keys, machine, events=True)


def chunked_fold(
    df: DataFrame,
    keys: list[str],
    machine: Machine,
    span: int | None = None,
    extent: DataFrame | None = None,
) -> DataFrame:
    """Events of ``machine`` replayed over each key of ``df`` in order, and one
    ``state`` event at the end of each chunk (the latest is the key's state).

    Only keys longer than one chunk run the settling passes; their rows and the
    small per-chunk states are checkpointed between passes. Which keys are long
    is read from ``extent`` where given, a cheaper frame with the same keys and
    orders (a superset will do). A long key has more than ``span`` rows, so there
    are few of them, however many keys there are.
    """
    spark = df.sparkSession
    ship_package(spark)
    span = span or int(spark.conf.get(SPAN_CONF, str(DEFAULT_SPAN)))
    ord = machine.inputs[0]
    whole = F.struct(*keys)
    rows = df.select(*keys, whole.alias(KEY), *machine.inputs)
    if machine.prefix:
        rows = rows.withColumn(machine.prefix.answer, F.lit(None).cast("boolean"))
    at = [KEY, CHUNK]
    ensure_checkpoint_dir(spark)
    long_keys = (
        (rows if extent is None else extent)
        .groupBy(whole.alias(KEY))
        .agg(chunk_number(F.min(ord), span).alias("_lo"), chunk_number(F.max(ord), span).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
        .filter((F.col("_lo") < F.col("_hi")) & (F.col("_rows") > span))
        .checkpoint()
    )
    chunks = long_keys.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0]
    if chunks is None:
        none = {CHUNK: F.lit(0).cast("long"), "entry": F.lit(None).cast("string"), "entry_hi": F.lit(None).cast("long")}
        return _replay(rows.withColumns(none), keys, machine, events=True)

    cut = F.broadcast(long_keys.select(KEY, F.lit(True).alias("_cut")))
    rows = rows.join(cut, KEY, "left").withColumn(CHUNK, F.when(F.col("_cut"), chunk_number(ord, span)).otherwise(0)).drop("_cut")
    if machine.prefix:
        return _prefix_fold(rows, keys, machine, long_keys.select(KEY, "_lo"), chunks)
    hot = rows.join(long_keys.select(KEY), KEY, "left_semi").checkpoint()
    guess = hot.withColumns(
        {"entry": F.lit(None).cast("string"), "entry_hi": F.lit(None).cast("long")}
    )
    cur = _replay(guess, keys, machine, events=False).withColumn(KEY, whole).checkpoint()
    order = Window.partitionBy(KEY).orderBy(CHUNK)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        todo = (
            cur.withColumns(
                {"_e": F.lag("exit").over(order), "_h": F.max("exit_hi").over(past)}
            )
            .filter(~(F.col("entry").eqNullSafe(F.col("_e")) & F.col("entry_hi").eqNullSafe(F.col("_h"))))
            .select(*at, F.col("_e").alias("entry"), F.col("_h").alias("entry_hi"))
            .checkpoint()
        )
        if todo.isEmpty():
            break
        redo = _replay(hot.join(todo, at), keys, machine, events=False).withColumn(KEY, whole)
        cur = cur.join(todo.select(*at), at, "left_anti").unionByName(redo).checkpoint()
    entries = cur.select(*at, "entry", "entry_hi")
    return _replay(rows.join(entries, at, "left"), keys, machine, events=True)
