"""Stateful streams: the batch machines, over state of constant size per key.

What a machine remembers of a key is one small state, and *memories*: maps such as
message id to group or child to status, which grow with the key. A memory is a map
state, so each entry is a row of the state store; a step reads and writes only the
entries it names. Each machine sees the rows of a key in ``ord`` order
within a micro-batch; micro-batches follow file order. A key's share of one
micro-batch is bounded by the source's trigger limit, whatever the size of the key.
The event rows are those of the batch fold, so the same summaries read both.
"""

from __future__ import annotations

import json
import operator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import inferred
from ..operators.turns import B_INPUTS, MACHINE_B, a_start, a_step
from ..plans import STATE, Machine
from ..plans.fold import EVENT_FIELDS
from ..plans.ship import ship_package

SAFE = 9_007_199_254_740_991


class Memory:
    """A map state as a mapping, written at the end of a micro-batch. Each call of the store costs
    a round trip, so nothing is asked of an empty one, one of at most ``rows`` entries, the rows at
    hand, is read in one go when first asked, and a larger one entry by entry. ``entries``: at
    least as many as the store has; None if that is not known."""

    def __init__(self, store, entries: int | None = None, rows: int = 0):
        self.store, self.entries, self.rows = store, entries, rows
        self.read, self.held, self.changed, self.whole = {}, {}, set(), entries == 0

    def get(self, key: str):
        if key not in self.read:
            if not self.whole and self.entries is not None and self.entries <= self.rows:
                self.held.update({k[0]: v[0] for k, v in self.store.iterator()})
                self.whole = True
            if not self.whole and key not in self.held and (found := self.store.getValue((key,))) is not None:
                self.held[key] = found[0]
            self.read[key] = json.loads(self.held[key]) if key in self.held else None
        return self.read[key]

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __setitem__(self, key: str, value) -> None:
        self.read[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            was, text = self.held.get(key), None if self.read[key] is None else json.dumps(self.read[key])
            if text == was and (was is not None or self.whole):
                continue
            if text is None:
                self.store.removeKey((key,))
            else:
                self.store.updateValue((key,), (text,))
            if self.entries is not None:
                self.entries += (text is not None and was is None) - (text is None and was is not None)


ENTRIES = "_entries"  # beside a state that is kept: the sizes of its memories


class FoldProcessor(StatefulProcessor):
    """Runs a machine over the rows of a key, micro-batch after micro-batch."""

    def __init__(self, machine: Machine, names: list[str], idle_ms: int | None):
        self.machine, self.names, self.idle_ms = machine, names, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "text string")
        self.memories = {m: handle.getMapState(m, "id string", "text string") for m in self.machine.memory}

    def handleInputRows(self, key, rows, timerValues):
        machine = self.machine
        current, sizes = machine.start(), dict.fromkeys(self.memories, 0)
        if (kept := self.state.get()) is not None:
            current.update(json.loads(kept[0]))
            sizes = current.pop(ENTRIES, {})
        pick = operator.itemgetter(*machine.inputs)
        taken = sorted((pick(r) for r in rows), key=operator.itemgetter(0))
        memories = {m: Memory(store, sizes.get(m), len(taken)) for m, store in self.memories.items()}
        current.update(memories)
        events, event = [], Row(*self.names)
        for row in taken:
            machine.step(current, row, lambda *e: events.append(event(key[0], *e)))
        state = {k: v for k, v in current.items() if k not in memories}
        text = json.dumps(state, sort_keys=True)
        for memory in memories.values():
            memory.flush()
        self.state.update((json.dumps(state | {ENTRIES: {m: x.entries for m, x in memories.items()}}),))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        events.append(event(key[0], taken[-1][0], STATE, None, current.get(machine.high), text))
        yield from events

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        for store in self.memories.values():
            store.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_fold(
    records: DataFrame, key: str, machine: Machine, idle_timeout_ms: int | None = None
) -> DataFrame:
    """Append-mode events of ``machine`` per ``key``, and its state after every
    micro-batch, without its memories. With a timeout, a key idle that long loses its state.
    The stream needs the RocksDB state store, which ``run_to_table`` sets."""
    ship_package(records.sparkSession)
    fields = [records.schema[key], *EVENT_FIELDS]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    mode = "None" if idle_timeout_ms is None else "ProcessingTime"
    return (
        records.select(key, *machine.inputs)
        .groupBy(key)
        .transformWithState(FoldProcessor(machine, [f.name for f in out], idle_timeout_ms), out, "Append", mode)
    )


def final_state(events: DataFrame, key: str, schema: str) -> DataFrame:
    """The newest state of every key, parsed."""
    at = F.when(F.col("event") == STATE, F.col("ord"))
    return (
        events.groupBy(key)
        .agg(F.max_by("text", at).alias("_s"))
        .select(key, F.from_json("_s", schema).alias("s"))
    )


# ---------------------------------------------------------------------- usage
COUNTS = ["input", "output", "cache_read", "cache_write"]
USAGE_INPUTS = [
    "ord", "kind", "stamp", "message_id", *COUNTS, "stop", "model",
    "bad", "forked", "synthetic", "mismatch",
]
SELECTED = [f"selected_{c}" for c in COUNTS]  # counters of the iteration that a response reports


def with_selected(records: DataFrame) -> DataFrame:
    """``records`` with the counters of ``selected`` as columns, for ``usage_machine(selected=True)``."""
    return records.select("*", *[F.col(f"selected.{c}").alias(f"selected_{c}") for c in COUNTS])


class Line(NamedTuple):
    """A line that feeds usage."""

    id: str | None
    stamp: int | None
    usage: list
    answer: dict | None  # what the line reports as a response

    @property
    def complete(self) -> bool:
        return None not in self.usage and sum(self.usage) <= SAFE


def u_start() -> dict:
    return {
        "known": True,  # no line has spoilt the totals
        "foreign": False,
        "seq": 0,
        "sums": [0, 0, 0, 0],  # over closed messages
        "open": None,  # the message whose lines are coming in
        "last": None,  # the newest response of a closed message since the last failure
        "groups": 0,
        "recent": [],  # with a ring, the messages it holds
    }


def u_close(s: dict, line: Line, ring: int | None) -> None:
    """The open message counts with its last line and is remembered as closed."""
    done = s["open"]
    if done is None:
        return
    s["open"] = None
    s["groups"] += 1
    s["sums"] = [a + b for a, b in zip(s["sums"], done["usage"])]
    s["last"] = done["answer"] or s["last"]
    s["closed"][done["id"]] = s["groups"]
    if ring is not None:
        s["recent"].append([done["id"], s["groups"]])
        for old, number in s["recent"][:-ring]:
            if s["closed"].get(old) == number:
                s["closed"][old] = None
        s["recent"] = s["recent"][-ring:]


def u_open(s: dict, line: Line, ring: int | None) -> None:
    s["open"] = {"id": line.id, "usage": [0, 0, 0, 0], "answer": None, "spoilt": False}


def u_take(s: dict, line: Line, ring: int | None) -> None:
    """Each line of a message replaces what the one before it said."""
    now = s["open"]
    s["seq"] = max(s["seq"], line.stamp)
    if line.complete:
        now.update(usage=line.usage, answer=None if now["spoilt"] else line.answer)
    else:
        now["usage"] = [0, 0, 0, 0]
        u_fail(s, line, ring)


def u_fail(s: dict, line: Line | None, ring: int | None) -> None:
    """Totals are unknown for good, responses until the next whole message."""
    s.update(known=False, last=None)
    if s["open"] is not None:
        s["open"].update(spoilt=True, answer=None)


LINE_EFFECTS = {
    "unreadable": [u_fail],
    "goes_on": [u_take],
    "opens": [u_close, u_open, u_take],
    "reopens": [u_close, u_fail],
}


def line_effect(s: dict, line: Line, ring: int | None) -> str:
    if line.id is None or line.stamp is None:
        return "unreadable"
    if s["open"] is not None and s["open"]["id"] == line.id:
        return "goes_on"
    return "reopens" if line.id in s["closed"] else "opens"


def usage_machine(ring: int | None = None, selected: bool = False) -> Machine:
    """Every closed message id of a session is remembered, or the last ``ring``. With ``selected``
    a response reports the counters of its selected iteration."""
    inputs = [*USAGE_INPUTS, *SELECTED] if selected else USAGE_INPUTS

    def step(s: dict, row: tuple, emit) -> None:
        r = dict(zip(inputs, row))
        if s["foreign"] or r["mismatch"]:
            s.update(foreign=True, known=False, last=None)
            return
        if r["kind"] != "assistant" or r["forked"] or r["synthetic"]:
            return
        answer = {"usage": [r[c] for c in (SELECTED if selected else COUNTS)], "model": r["model"]}
        line = Line(None if r["bad"] else r["message_id"], r["stamp"], [r[c] for c in COUNTS], answer if r["stop"] is not None else None)
        for effect in LINE_EFFECTS[line_effect(s, line, ring)]:
            effect(s, line, ring)

    return Machine(inputs, u_start, step, "seq", ("closed",))


MACHINE_USAGE = usage_machine()


def usage_view(events: DataFrame) -> DataFrame:
    """Totals and last response from the newest usage states. A sum beyond what is exact is unknown."""
    schema = (
        "sums array<bigint>, open struct<usage:array<bigint>,answer:struct<usage:array<bigint>,model:string>>, "
        "known boolean, last struct<usage:array<bigint>,model:string>, seq bigint, foreign boolean"
    )
    x = final_state(events, "session_id", schema)
    s = F.col("s")
    total = F.zip_with(
        s.sums, F.coalesce(s.open.usage, F.array(*[F.lit(0)] * 4).cast("array<bigint>")), lambda a, b: a + b
    )
    known = s.known & (s.seq > 0)
    exact = lambda c: F.when(c <= SAFE, c)
    at = lambda i: exact(F.get(total, F.lit(i)))
    put = lambda c: F.when(known, c)
    response = F.when(~s.foreign, F.coalesce(s.open.answer, s.last))
    use = lambda i: F.get(response.usage, F.lit(i))
    return x.select(
        "session_id",
        put(exact(at(0) + at(2) + at(3))).alias("total_input"),
        put(at(2)).alias("total_cache_read"),
        put(at(3)).alias("total_cache_write"),
        put(at(0)).alias("total_uncached_input"),
        put(at(1)).alias("total_output"),
        F.when(~s.foreign & (s.seq > 0), s.seq).alias("usage_seq"),
        (use(0) + use(2) + use(3)).alias("context"),
        response.model.alias("model"),
    )


# ------------------------------------------------------------------- children
CHILD_INPUTS = [
    "ord", "kind", "child_key", "child_event", "bad", "forked", "mismatch",
]
_RUNNING = ("launch", "resume")


def c_start() -> dict:
    return {"counts": {}, "valid": True, "seq": 0}


def apply_child(s: dict, key: str | None, event: str) -> None:
    """Update one child and how many there are of each status; only launched children exist."""
    name = json.dumps(key)
    old = s["roster"].get(name)
    if old is None and event not in ("launch", "sync"):
        return
    new = "running" if event in _RUNNING else "completed" if event == "sync" else event
    if new != old:
        s["roster"][name] = new
        for status, change in ((old, -1), (new, 1)):
            if status is not None:
                s["counts"][status] = s["counts"].get(status, 0) + change


def c_step(s: dict, row: tuple, emit) -> None:
    r = dict(zip(CHILD_INPUTS, row))
    s["seq"] = r["ord"]
    if r["mismatch"]:
        s["valid"] = False
    if r["forked"]:
        return
    if r["bad"]:
        s["valid"] = s["valid"] and r["kind"] not in ("user", "attachment")
    elif r["child_event"] is not None:
        apply_child(s, r["child_key"], r["child_event"])


MACHINE_CHILDREN = Machine(CHILD_INPUTS, c_start, c_step, "seq", ("roster",))


def children_view(events: DataFrame) -> DataFrame:
    from ..operators.children import STATUSES

    x = final_state(events, "session_id", "counts map<string,bigint>, valid boolean")
    count = lambda st: F.coalesce(F.try_element_at("s.counts", F.lit(st)), F.lit(0).cast("long"))
    total = F.aggregate(F.map_values("s.counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    valid = F.col("s.valid")
    return x.select(
        "session_id",
        valid.alias("valid"),
        *[F.when(valid, count(st)).alias(st) for st in STATUSES],
        F.when(valid, total).alias("total"),
        F.when(valid, count("completed")).alias("done"),
    )


# ---------------------------------------------------------------------- turns
A_STREAM = [
    "ord", "opens", "ok", "key", "start", "end", "outcome",
]


def turn_machine_a(cap: int | None = None) -> Machine:
    """Format A with its finished turns as a memory. Beyond ``cap`` of them, where one is given,
    the total is unknown."""

    def start():
        return {**a_start(), "turns": 0}

    def step(s, row, emit):
        ord, opens, ok, key, begin, end, outcome = row
        past = (s["finished"].get(key) if key is not None else None) or [None, None, None]
        a_step(s, (*row, *past), emit)
        if ok and not opens and past[0] is None:
            if cap is None or s["turns"] < cap:
                s["turns"] += 1
                s["finished"][key] = [begin, end, outcome]
                emit(ord, "turn", begin, end, outcome)
            else:
                emit(ord, "lost", None, None, None)

    return Machine(A_STREAM, start, step, "last_end", ("finished",))


def turn_view_a(events: DataFrame) -> DataFrame:
    c = F.col
    when = lambda e: F.when(c("event") == e, c("ord"))
    x = events.groupBy("session_id").agg(
        F.count_if(c("event") == "turn").alias("turns"),
        F.coalesce(F.sum(F.when(c("event") == "turn", c("b") - c("a"))), F.lit(0)).alias("total"),
        F.max_by(F.struct("a", "b", "text"), when("last")).alias("l"),
        F.max_by("text", when(STATE)).alias("s"),
        F.bool_or(c("event") == "lost").alias("lost"),
    )
    known = F.get_json_object("s", "$.known") == "true"
    return x.select(
        "session_id",
        "turns",
        F.when(~c("lost"), c("total")).alias("total_s"),
        (~c("lost")).alias("complete"),
        F.when(known, F.get_json_object("s", "$.key").isNotNull()).alias("active"),
        F.when(known, F.get_json_object("s", "$.start").cast("long")).alias("started_at_s"),
        c("l.a").alias("last_duration_s"),
        c("l.b").alias("last_end_s"),
        c("l.text").alias("last_outcome"),
    )


B_STREAM = [n for n in B_INPUTS if n not in ("repeated", "children_ok", "children_running")] + [
    "kind", "bad", "mismatch", "child_key", "child_event",
]


def _b_stream_start() -> dict:
    return {**inferred.start(), "counts": {}, "roster_ok": True}


def _b_stream_step(s: dict, row: tuple, emit) -> None:
    r = dict(zip(B_STREAM, row))
    if r["mismatch"] or (r["bad"] and r["kind"] in ("user", "attachment")):
        s["roster_ok"] = False
    if r["child_event"] is not None and not r["bad"]:
        apply_child(s, r["child_key"], r["child_event"])
    # A stream cannot see later repeats, so every finished key is remembered.
    asks = r["role"] == "trigger" and r["key"] is not None
    r |= {
        "repeated": True, "children_ok": s["roster_ok"], "children_running": s["counts"].get("running", 0),
        inferred.SPENT: asks and r["key"] in s["spent"],
    }

    def tell(ord, event, a, b, text):
        if event == "used":
            s["spent"][text] = True
        else:
            emit(ord, event, a, b, text)

    inferred.step(s, tuple(r[n] for n in (*B_INPUTS, inferred.SPENT)), tell)
    s["used"] = []


MACHINE_B_STREAM = Machine(B_STREAM, _b_stream_start, _b_stream_step, MACHINE_B.high, ("roster", "spent"))


# ----------------------------------------------------------------- last known
KNOWN_INPUTS = [
    "ord", "stamp", "generation", "missing", "rejected", "cleared", "short", "output",
]


def k_start() -> dict:
    return {"held": None, "generation": None, "seq": 0}


def k_step(s: dict, row: tuple, emit) -> None:
    """Carry the latest known value; see the batch ``last_known`` for the rules."""
    r = dict(zip(KNOWN_INPUTS, row))
    s["seq"] = r["ord"]
    if r["generation"] != s["generation"]:
        s.update(generation=r["generation"], held=None)
    if r["rejected"] or r["cleared"] or r["short"]:
        s["held"] = None
        emit(r["ord"], "sample", None, None, "own")
    elif not r["missing"]:
        s["held"] = [r["stamp"], r["output"]]
        emit(r["ord"], "sample", *s["held"], "own")
    elif s["held"] is not None:
        emit(r["ord"], "sample", *s["held"], "carried")
    else:
        emit(r["ord"], "sample", None, None, "own")


MACHINE_KNOWN = Machine(KNOWN_INPUTS, k_start, k_step, "seq")

# --------------------------------------------------------- newest, changes only
NEWEST_INPUTS = [
    "ord", "sampled_at", "seq", "value",
]


def n_start() -> dict:
    return {"best": None, "seq": 0}


def n_step(s: dict, row: tuple, emit) -> None:
    """Keep the newest observation; an older or equal one changes nothing."""
    ord, at, seq, value = row
    s["seq"] = ord
    if s["best"] is None or at > s["best"]:
        s["best"] = at
        emit(ord, "newest", at, value, str(seq))


MACHINE_NEWEST = Machine(NEWEST_INPUTS, n_start, n_step, "seq")

CHANGE_INPUTS = [
    "ord", "content", "stamp",
]


def x_start() -> dict:
    return {"content": None, "revision": 0, "seq": 0}


def x_step(s: dict, row: tuple, emit) -> None:
    ord, content, stamp = row
    s["seq"] = ord
    if content != s["content"] or s["revision"] == 0:
        s["content"] = content
        s["revision"] += 1
        emit(ord, "change", s["revision"], stamp, content)


MACHINE_CHANGES = Machine(CHANGE_INPUTS, x_start, x_step, "seq")
