"""Wall-clock turn intervals from ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import STATE, Machine, Prefix, Run, chunked_fold, running, with_chunk
from . import inferred
from .children import launches, lost_roster, status_of

SECOND = inferred.SECOND


# ------------------------------------------------------- format A: keyed turns
# What a record does: does it cost the total, and what becomes of the current turn.
KEEP, OPEN, CLOSED, UNKNOWN = "keep", "open", "closed", "unknown"
EFFECTS = {
    "repeat": (False, KEEP),  # says what is known already
    "conflict": (True, UNKNOWN),  # contradicts what is known, or cannot be read
    "late": (True, KEEP),  # a start from before the current turn
    "opens": (False, OPEN),
    "replaces": (True, OPEN),  # a start while another turn has not ended
    "ends": (False, CLOSED),
    "ends_overlapping": (True, CLOSED),
    "outlasts": (True, UNKNOWN),  # the end of an unseen turn that hides what is current
    "strays": (True, KEEP),  # the end of an unseen turn from before
}


def a_start() -> dict:
    return {"key": None, "start": None, "known": False, "last_end": 0}


def start_effect(s: dict, key: str, start: int) -> str:
    if key == s["key"]:
        return "repeat" if start == s["start"] else "conflict"
    running = s["key"] is not None
    if running and start < s["start"]:
        return "late"
    if start < s["last_end"]:
        return "conflict"
    return "replaces" if running else "opens"


def end_effect(s: dict, key: str, start: int, end: int) -> str:
    overlapping = start < s["last_end"]
    if (key, start) == (s["key"], s["start"]):
        return "ends_overlapping" if overlapping else "ends"
    # Whatever it came after or covers is no longer the newest thing known.
    newest = [x for x in (s["start"], s["last_end"] if overlapping else None) if x is not None]
    return "outlasts" if any(end > x for x in newest) else "strays"


def a_step(s: dict, row: tuple, emit) -> None:
    """Advance over one start or end record.

    The last three values are the interval already finished for this key, if
    any; knowing it from the data keeps the state small. ``lost`` tells that the
    total is unknown from here; the intervals stay recorded.
    """
    ord, opens, ok, key, start, end, outcome, *past = row
    if ok and past[0] is None:
        what = start_effect(s, key, start) if opens else end_effect(s, key, start, end)
    else:
        same = past[:1] == [start] if opens else past == [start, end, outcome]
        what = "repeat" if ok and same else "conflict"
    lost, current = EFFECTS[what]
    if lost:
        emit(ord, "lost", None, None, None)
    newer = not opens and past[0] is None and ok and end > s["last_end"]
    if newer and (current == CLOSED or start >= s["last_end"]):
        emit(ord, "last", end - start, end, outcome)
        s["last_end"] = end
    if current == OPEN:
        s.update(key=key, start=start, known=True)
    elif current != KEEP:
        s.update(key=None, start=None, known=current == CLOSED)


MACHINE_A = Machine(
    ["ord", "opens", "ok", "key", "start", "end", "outcome", "p_start", "p_end", "p_outcome"],
    a_start,
    a_step,
    "last_end",
)


def turn_records_a(df: DataFrame, now_s: int, span: int | None = None) -> DataFrame:
    """Start and end records with validity and the interval already finished
    for the same turn key. Input: ord, opens, key, start, end, outcome."""
    c = F.col
    start_ok = c("key").isNotNull() & (c("start") > 0) & (c("start") <= now_s)
    end_ok = (c("end") >= c("start")) & (c("end") <= now_s)
    rows = df.withColumn("ok", F.coalesce(start_ok & (c("opens") | end_ok), F.lit(False)))
    done = F.when(c("ok") & ~c("opens"), F.struct("start", "end", "outcome"))
    rows = running(
        rows, ["session_id", "key"], "ord", {"_p": Run("first", done, before=True)}, span
    )
    return rows.select(
        "session_id", "ord", "opens", "ok", "key", "start", "end", "outcome",
        c("_p.start").alias("p_start"), c("_p.end").alias("p_end"), c("_p.outcome").alias("p_outcome"),
    )


def turn_pairs(records: DataFrame) -> DataFrame:
    """One row per turn key: its interval, and whether its records agree."""
    c = F.col
    good = records.filter("ok")
    return good.groupBy("session_id", "key").agg(
        F.min("start").alias("start"),
        F.min_by("end", F.when(~c("opens"), c("ord"))).alias("end"),
        F.min_by("outcome", F.when(~c("opens"), c("ord"))).alias("outcome"),
        F.count_if("opens").alias("starts"),
        F.count_if(~c("opens")).alias("ends"),
        (
            (F.min("start") == F.max("start"))
            & F.coalesce(F.min("end") == F.max("end"), F.lit(True))
            & F.coalesce(F.min("outcome") == F.max("outcome"), F.lit(True))
        ).alias("agrees"),
    )


def turn_summary_a(
    records: DataFrame, span: int | None = None, cap: int | None = None, extent: DataFrame | None = None
) -> DataFrame:
    """Per session: finished turns, last interval, and a total that is NULL
    unless every record could be placed. ``cap`` makes the total unknown
    beyond that many turns instead of dropping any."""
    c = F.col
    finished = (
        records.filter("ok AND NOT opens AND p_start IS NULL")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("turns"), F.sum(c("end") - c("start")).alias("total"))
    )
    events = chunked_fold(records, ["session_id"], MACHINE_A, span, extent)
    last = F.max_by(F.struct("a", "b", "text"), F.when(c("event") == "last", c("ord")))
    state = F.max_by("text", F.when(c("event") == STATE, c("ord")))
    folded = events.groupBy("session_id").agg(
        last.alias("l"), state.alias("s"), F.bool_or(c("event") == "lost").alias("lost")
    )
    j = folded.join(finished, "session_id", "left")
    complete = ~c("lost")
    if cap is not None:
        complete = complete & (F.coalesce("turns", F.lit(0)) <= cap)
    known = F.get_json_object("s", "$.known") == "true"
    open_key = F.get_json_object("s", "$.key")
    return j.select(
        "session_id",
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.when(complete, F.coalesce("total", F.lit(0))).alias("total_s"),
        complete.alias("complete"),
        F.when(known, open_key.isNotNull()).alias("active"),
        F.when(known, F.get_json_object("s", "$.start").cast("long")).alias("started_at_s"),
        c("l.a").alias("last_duration_s"),
        c("l.b").alias("last_end_s"),
        c("l.text").alias("last_outcome"),
    )


# -------------------------------------------------- format B: inferred turns
B_INPUTS = inferred.INPUTS


def proven_second() -> Column:
    """Only these records can raise the newest proven end."""
    return F.when(F.col("role").isin("abort", "end", "queue"), F.call_function("div", F.col("stamp"), F.lit(SECOND)))


MACHINE_B = Machine(
    B_INPUTS,
    inferred.start,
    inferred.step,
    "floor",
    prefix=Prefix(inferred.Stretch, inferred.composed, inferred.walked, proven_second, "repeated", "key", "used", inferred.SPENT),
)


def turn_records_b(df: DataFrame, span: int | None = None) -> DataFrame:
    """Inputs of the format B machine from classified records.

    Adds to each record whether the child roster is still valid and how many
    children run at that point, and which trigger keys occur more than once.
    Forked records are dropped.
    """
    c = F.col
    rows = with_chunk(df.filter(~c("forked")), "ord", span)
    # Children: the change each accepted event makes to the running count.
    is_event = c("child_event").isNotNull() & ~c("bad")
    runs = status_of() == "running"
    events = running(
        rows.filter(is_event),
        ["session_id", "child_key"],
        "ord",
        {
            "_launched": Run("max", launches()),
            "_before": Run("max", launches(), before=True),
            "_prev": Run("last", runs, before=True),
        },
        span,
    )
    was = F.coalesce(c("_before") & c("_prev"), F.lit(False))
    delta = F.when(c("_launched"), runs.cast("long") - was.cast("long")).otherwise(0)
    events = events.withColumn("_delta", delta).drop("_launched", "_before", "_prev")
    others = rows.filter(~is_event).withColumn("_delta", F.lit(0).cast("long"))
    rows = others.unionByName(events)
    hurt = lost_roster(rows)
    rows = running(
        rows,
        ["session_id"],
        "ord",
        {"children_running": Run("sum", c("_delta")), "_hurt": Run("max", hurt)},
        span,
    )
    # Only triggers carry a key worth matching; the rest stay out of the join.
    trigger = (c("role") == "trigger") & c("key").isNotNull()
    keys = (
        rows.filter(trigger)
        .groupBy("session_id", "key")
        .agg((F.count(F.lit(1)) > 1).alias("repeated"))
        .filter("repeated")
    )
    triggers = rows.filter(trigger).join(keys, ["session_id", "key"], "left")
    rows = (
        rows.filter(~F.coalesce(trigger, F.lit(False)))
        .withColumn("repeated", F.lit(False))
        .unionByName(triggers)
    )
    lost = F.when(
        c("bad") & ~c("synthetic") & c("kind").isNotNull(),
        F.when(c("kind") == "queue-operation", "queue").otherwise("record"),
    )
    return rows.select(
        "session_id", "ord", "role", lost.alias("lost"), c("mismatch").alias("foreign"), "key",
        F.coalesce("repeated", F.lit(False)).alias("repeated"), "stamp", "injected", "command", "final_stop",
        "local_output", "local_command", "prompt", "take", "elapsed_ms", "background", "masks",
        (~c("_hurt")).alias("children_ok"), "children_running",
    )


def turn_events_b(
    records: DataFrame, span: int | None = None, extent: DataFrame | None = None
) -> DataFrame:
    return chunked_fold(records, ["session_id"], MACHINE_B, span, extent)


def turn_summary_b(events: DataFrame) -> DataFrame:
    """Published view per session: a value is true or unknown, never a guess."""
    c = F.col
    turn = F.when(c("event") == "turn", c("ord"))
    folded = events.groupBy("session_id").agg(
        F.count_if(c("event") == "turn").alias("turns"),
        F.coalesce(F.sum(F.when(c("event") == "turn", c("b") - c("a"))), F.lit(0)).alias("total"),
        F.max_by(F.struct("a", "b", "text"), turn).alias("l"),
        F.bool_or(c("event") == "lost").alias("lost"),
        F.max_by("text", F.when(c("event") == STATE, c("ord"))).alias("s"),
    )
    flag = lambda n: F.get_json_object("s", f"$.{n}") == "true"
    text = lambda n: F.get_json_object("s", f"$.{n}")
    fact = lambda n: f"control[{inferred.Control._fields.index(n)}]"
    phase = text(fact("phase"))
    foreign = phase == inferred.GONE
    complete = ~c("lost") & flag("seen") & ~flag(fact("silent")) & ~foreign
    dated = flag(fact("clean")) & flag("children_ok") & (text("children_running").cast("long") == 0)
    known = (
        flag(fact("known")) & dated & ~flag(fact("silent")) & ~flag(fact("gap")) & ~flag(fact("local"))
        & (phase != inferred.PENDING) & ~foreign
    )
    put = lambda col: F.when(~foreign, col)
    return folded.select(
        "session_id",
        put(c("turns")).alias("turns"),
        F.when(complete, c("total")).alias("total_s"),
        complete.alias("complete"),
        F.when(known, phase == inferred.RUNNING).alias("active"),
        F.when(known, text("start").cast("long")).alias("started_at_s"),
        put(c("l.b") - c("l.a")).alias("last_duration_s"),
        put(c("l.b")).alias("last_end_s"),
        put(c("l.text")).alias("last_outcome"),
    )


def turn_gate_stats(events: DataFrame) -> DataFrame:
    """Joins, and end and abort records kept, rejected or without a duration."""
    return (
        events.filter(F.col("event") == "gate")
        .groupBy(F.col("text").alias("gate"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def queued_input_join(events: DataFrame) -> DataFrame:
    """Triggers that joined the running turn, by taken input that existed by then."""
    return events.filter(F.col("event") == "joined").select(
        "session_id", "ord", F.col("a").alias("turn_start_s"), F.col("b").alias("trigger_s")
    )


# ------------------------------------------------------------ window operators
def end_floor(df: DataFrame, is_end: str, second: str, span: int | None = None) -> DataFrame:
    """Newest proven end before each record."""
    value = F.when(F.col(is_end), F.col(second))
    return running(df, ["session_id"], "ord", {"floor": Run("max", value, before=True)}, span)


def turn_overlaps(turns: DataFrame, span: int | None = None) -> DataFrame:
    """Intervals that begin before an earlier one of the session has ended."""
    rows = running(
        turns, ["session_id"], "ord", {"prev_end": Run("max", F.col("end"), before=True)}, span
    )
    return rows.withColumn("overlaps", F.coalesce(F.col("start") < F.col("prev_end"), F.lit(False)))
