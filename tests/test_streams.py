"""Streams over several micro-batches equal the batch operators, with state rows of constant size."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionledger.fixtures import f1
from sessionledger.operators import children as ch
from sessionledger.operators import turns as tn
from sessionledger.operators import usage as us
from sessionledger.plans import STATE, ensure_checkpoint_dir
from sessionledger.streaming import folds as fo
from sessionledger.streaming import runs as ru

from .conftest import SF

SCHEMA = (
    "session_id string, ord long, kind string, stamp long, message_id string, input long, output long, cache_read long, "
    "cache_write long, stop string, model string, bad boolean, forked boolean, synthetic boolean, mismatch boolean"
)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """State stores are opened per partition and micro-batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def landed_in(spark, df, parts):
    """``df`` as a stream of one file a micro-batch, ``parts`` of them."""
    path = ru.land_segments(df, "session_id", "ord", parts=parts, files=1)
    return ru.stream_segments(spark, path, df.schema, files_per_trigger=1)


def batches(spark, name):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    newest = max(glob.glob(f"{root}/out/{name}-*-checkpoint"), key=lambda p: len(glob.glob(f"{p}/commits/*")))
    return len([f for f in glob.glob(f"{newest}/commits/*")])


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def lines(spark, n, seed):
    """Sessions of lines: few ids that come back, missing counters, lost and foreign records."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["a", "b", "c", None, "long"])
        odd = rng.random() < (0.02 if s in ("a", None) else 0)
        fresh = s in ("long", "b") or rng.random() < 0.9
        m = f"m{i // 9}" if fresh else f"m{rng.randrange(max(1, i // 9))}"
        counts = [rng.randrange(100) for _ in range(4)]
        if s == "c" and rng.random() < 0.05:
            counts[rng.randrange(4)] = rng.choice([None, us.SAFE])
        kind = rng.choice(["assistant", "assistant", "user"])
        rows.append((s, i, kind, i + 1, m, *counts, rng.choice([None, "end_turn"]), rng.choice([None, "x", "y"]), odd, rng.random() < 0.05, rng.random() < 0.05, False))
    rows.append(("gone", n, "assistant", 5, "m", 1, 1, 1, 1, "s", "m", False, False, False, True))
    return spark.createDataFrame(rows, SCHEMA)


def usage_twin(df):
    last = us.last_response(df).select(F.col("session_id").alias("_s"), "context", "model")
    return us.usage_totals(df).join(last, F.col("session_id").eqNullSafe(F.col("_s"))).drop("_s")


@pytest.fixture(scope="module")
def told(spark):
    """Lines, and what the batch operators make of them."""
    df = lines(spark, 1500, 1)
    return df, rows_of(usage_twin(df))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_usage_in_micro_batches(spark, told, parts):
    df, want = told
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, df, parts), "session_id", fo.MACHINE_USAGE), f"usage{parts}")
    assert rows_of(fo.usage_view(events)) == want
    assert batches(spark, f"usage{parts}") == parts
    sizes = events.filter(F.col("event") == STATE).agg(F.max(F.length("text"))).first()[0]
    assert sizes < 700  # whatever the number of messages


def test_selected_iteration_in_the_stream(spark):
    df = lines(spark, 300, 1).withColumn("selected", F.struct(*[(F.col(c) + 1000).alias(c) for c in fo.COUNTS]))
    want = usage_twin(df)
    wide = fo.with_selected(df).drop("selected")
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, wide, 3), "session_id", fo.usage_machine(selected=True)), "selected")
    assert rows_of(fo.usage_view(events)) == rows_of(want)
    assert want.filter("context >= 3000").count() > 0


def test_unsafe_sums_in_the_stream(spark):
    rows = [("s", i, "assistant", i + 1, f"m{i}", us.SAFE - 1, 1, 0, 0, "e", "m", False, False, False, False) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, df, 2), "session_id", fo.MACHINE_USAGE), "unsafe")
    got = fo.usage_view(events)
    assert rows_of(got) == rows_of(usage_twin(df)) and got.first().total_input is None and got.first().total_output == 2


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_children_in_micro_batches(spark, parts):
    df = f1(spark, SF).select("session_id", *fo.CHILD_INPUTS)
    # One session with many children, each of which changes its status.
    many = spark.range(3000).selectExpr(
        "-1L AS session_id", "id * 30 AS ord", "'user' AS kind", "concat('c', id % 700) AS child_key",
        "CASE WHEN id < 700 THEN IF(id % 3 = 0, 'sync', 'launch') ELSE element_at(array('completed', 'resume', 'errored', 'unknown'), CAST(id % 4 + 1 AS INT)) END AS child_event",
        "false AS bad", "false AS forked", "false AS mismatch",
    )
    df = df.unionByName(many)
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, df, parts), "session_id", fo.MACHINE_CHILDREN), f"children{parts}")
    got = fo.children_view(events)
    assert rows_of(got) == rows_of(ch.child_outcomes(df).select(got.columns))
    assert batches(spark, f"children{parts}") == parts
    assert events.filter(F.col("event") == STATE).agg(F.max(F.length("text"))).first()[0] < 200


@pytest.fixture(scope="module")
def turns(spark):
    from sessionledger.catalog.turns import records_b

    return rows_of(tn.turn_summary_b(tn.turn_events_b(records_b(spark, SF))))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_inferred_turns_in_micro_batches(spark, turns, parts):
    from sessionledger.catalog.streams import b_stream_records

    df = b_stream_records(spark, SF).select("session_id", *fo.B_STREAM)
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, df, parts), "session_id", fo.MACHINE_B_STREAM), f"turns{parts}")
    assert rows_of(tn.turn_summary_b(events)) == turns
    assert batches(spark, f"turns{parts}") == parts
    assert events.filter(F.col("event") == STATE).agg(F.max(F.length("text"))).first()[0] < 500


def test_finished_keys_are_remembered_across_micro_batches(spark):
    """A key that ended a turn opens none in a later micro-batch."""
    base = dict(lost=None, foreign=False, key=None, stamp=0, injected=False, command=False, final_stop=False, local_output=False, local_command=False, prompt=False, take=False, elapsed_ms=None, background=False, masks=False, kind="user", bad=False, mismatch=False, child_key=None, child_event=None)
    rows = []
    for turn, key in enumerate(["a", "b", "a", "c"]):
        for i, (role, more) in enumerate([("trigger", {"key": key}), ("assistant", {}), ("end", {"elapsed_ms": 2000})]):
            rows.append({"session_id": "s", "ord": turn * 10 + i, "role": role, **base, **more, "stamp": (100 * (turn + 1) + i) * 1_000_000})
    schema = (
        "session_id string, ord long, role string, lost string, foreign boolean, key string, stamp long, injected boolean, command boolean, final_stop boolean, "
        "local_output boolean, local_command boolean, prompt boolean, take boolean, elapsed_ms long, background boolean, masks boolean, kind string, bad boolean, "
        "mismatch boolean, child_key string, child_event string"
    )
    df = spark.createDataFrame(rows, schema)
    events = ru.run_to_table(fo.stream_fold(landed_in(spark, df, 4), "session_id", fo.MACHINE_B_STREAM), "again")
    assert sorted(e.a for e in events.filter("event = 'turn'").collect()) == [100, 200, 400]


@pytest.mark.parametrize("name", ["stream_usage", "stream_children", "stream_turns_a", "stream_turns_b"])
def test_registered_streams_run_several_micro_batches(spark, duck, name):
    from .test_oracles import check

    check(spark, duck, name)
    assert batches(spark, {"stream_usage": "usage", "stream_children": "children"}.get(name, name.removeprefix("stream_").replace("_", "-"))) > 1


class CountedStore:
    """A map state in memory that counts its calls."""

    def __init__(self, held):
        self.held, self.calls = {(k,): (v,) for k, v in held.items()}, []

    def iterator(self):
        self.calls.append("iterator")
        return iter(list(self.held.items()))

    def getValue(self, key):
        self.calls.append("getValue")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.held[key] = value

    def removeKey(self, key):
        self.calls.append("removeKey")
        self.held.pop(key, None)


@pytest.mark.parametrize("entries, rows, reads", [(0, 9, []), (3, 9, ["iterator"]), (3, 2, ["getValue"] * 4), (None, 9, ["getValue"] * 4)])
def test_memory_asks_the_store_little(entries, rows, reads):
    held = {} if entries == 0 else {"a": "1", "b": "2", "c": "3"}
    store = CountedStore(held)
    memory = fo.Memory(store, entries, rows)
    assert [memory.get(k) for k in ("a", "b", "c", "d", "a")] == [json.loads(held.get(k, "null")) for k in ("a", "b", "c", "d", "a")]
    assert store.calls == reads
    store.calls.clear()
    memory["a"], memory["e"], memory["c"] = 1, 5, None
    memory.flush()
    assert store.held == {("a",): ("1",), ("e",): ("5",)} | ({} if entries == 0 else {("b",): ("2",)})
    assert memory.entries in (None, len(store.held))
    assert len(store.calls) == 2
