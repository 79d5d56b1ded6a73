"""Turn machines: a chunked replay equals an unbroken one, and published
intervals and totals are true or unknown on logs whose truth is known."""

import random

import pytest
from pyspark.sql import functions as F

from sessionledger.operators import turns as tn
from sessionledger.plans import STATE, chunked_fold

B_SCHEMA = (
    "session_id long, ord long, role string, lost string, foreign boolean, key string, repeated boolean, stamp long, "
    "injected boolean, command boolean, final_stop boolean, local_output boolean, local_command boolean, prompt boolean, "
    "take boolean, elapsed_ms long, background boolean, masks boolean, children_ok boolean, children_running long"
)
WHOLE = 10**9


def record(session, ord, role, second, **more):
    base = dict(
        session_id=session, ord=ord, role=role, lost=None, foreign=False, key=None, repeated=False,
        stamp=second * 1_000_000 + 1, injected=False, command=False, final_stop=False, local_output=False,
        local_command=False, prompt=False, take=False, elapsed_ms=None, background=False, masks=False,
        children_ok=True, children_running=0,
    )
    return tuple({**base, **more}.values())


def true_log(rng, session, turns, noise):
    """Records of real turns, and the true intervals. Noise loses records, adds
    queued input, local commands and records nothing is known about."""
    rows, truth, now, ord = [], [], 1_000, 0

    def put(role, second, **more):
        nonlocal ord
        ord += 1
        lost = rng.random() < noise / 3
        rows.append(record(session, ord, role, second, **{**more, "lost": "record" if lost else None}))

    for i in range(turns):
        now += rng.randrange(1, 30)
        if rng.random() < noise:
            put("trigger", now, key=f"c{session}-{i}", command=True)
            put("ignored", now + 1, local_output=True)
            now += 2
        start = now
        if rng.random() > noise / 4:
            put("trigger", start, key=f"k{session}-{i}", injected=rng.random() < noise / 2)
        for _ in range(rng.randrange(1, 4)):
            now += rng.randrange(0, 5)
            put("assistant", now)
            if rng.random() < noise:
                put("queue", now, take=True)
                put("trigger", now - 1, key=f"q{session}-{ord}")
            if rng.random() < noise / 3:
                put("silent", now)
        now += rng.randrange(1, 9)
        if rng.random() < noise / 3:
            put("abort", now)
            truth.append((start, now, "aborted"))
        elif rng.random() > noise / 5:
            put("end", now, elapsed_ms=(now - start) * 1000)
            truth.append((start, now, "completed"))
        if rng.random() < noise / 6:
            put("unknown", now)
    return rows, truth


def logs(seed, sessions=60, turns=12):
    rng = random.Random(seed)
    out = {}
    for s in range(sessions):
        out[s] = true_log(rng, s, turns, rng.choice([0, 0, 0.05, 0.2, 0.5]))
    return out


def frame(spark, made):
    return spark.createDataFrame([r for rows, _ in made.values() for r in rows], B_SCHEMA)


def plain(events):
    keep = [c for c in events.columns if c != "_chunk"]
    return sorted(map(str, events.filter(F.col("event") != STATE).select(*keep).collect()))


@pytest.mark.parametrize("span", [200, 7])
def test_chunked_replay_equals_whole_replay(spark, span):
    df = frame(spark, logs(1))
    whole, cut = tn.turn_events_b(df, WHOLE), tn.turn_events_b(df, span)
    assert plain(cut) == plain(whole)
    got = sorted(map(str, tn.turn_summary_b(cut).collect()))
    assert got == sorted(map(str, tn.turn_summary_b(whole).collect()))


def test_one_key_with_every_row(spark):
    """A key of hundreds of chunks settles to the unbroken result."""
    rng = random.Random(4)
    rows, _ = true_log(rng, 1, 400, 0.2)
    df = spark.createDataFrame(rows, B_SCHEMA)
    cut = chunked_fold(df, ["session_id"], tn.MACHINE_B, 10)
    assert cut.filter(F.col("event") == STATE).count() > 200
    assert plain(cut) == plain(chunked_fold(df, ["session_id"], tn.MACHINE_B, WHOLE))


def test_few_rows_far_apart_are_one_chunk(spark):
    """A key is cut by its rows, not by how far its orders lie apart."""
    made = logs(5, sessions=8)
    df = frame(spark, made)
    wide = df.withColumn("ord", F.col("ord") * 1000)
    cut = tn.turn_events_b(wide, 1000)
    assert cut.filter(F.col("event") == STATE).count() == len(made)
    near = cut.withColumn("ord", F.expr("ord div 1000"))
    assert plain(near) == plain(tn.turn_events_b(df, WHOLE))
    # Rows told by an extent count, and a long key is cut beside short ones.
    rows, _ = true_log(random.Random(6), 99, 40, 0.2)
    both = df.unionByName(spark.createDataFrame(rows, B_SCHEMA))
    span = max(len(r) for r, _ in made.values())
    mixed = tn.turn_events_b(both, span, both)
    states = {r[0]: r[1] for r in mixed.filter(F.col("event") == STATE).groupBy("session_id").count().collect()}
    assert states.pop(99) > 1 and set(states.values()) == {1}
    assert plain(mixed) == plain(tn.turn_events_b(both, WHOLE))


def test_published_turns_are_true_or_unknown(spark):
    made = logs(2, sessions=150)
    events = tn.turn_events_b(frame(spark, made), 50)
    turns = {}
    for r in events.filter("event = 'turn'").collect():
        turns.setdefault(r["session_id"], []).append((r["a"], r["b"], r["text"]))
    views = {r["session_id"]: r for r in tn.turn_summary_b(events).collect()}
    whole = 0
    for s, (_, truth) in made.items():
        assert set(turns.get(s, [])) <= set(truth), s
        if views[s]["complete"]:
            whole += 1
            assert views[s]["total_s"] == sum(b - a for a, b, _ in truth), s
            assert (views[s]["last_duration_s"], views[s]["last_end_s"]) == (truth[-1][1] - truth[-1][0], truth[-1][1])
    assert whole >= 40


def test_hand_made_inferred_turns(spark):
    k = dict(key="a")
    cases = {
        # one finished turn
        1: ([("trigger", 10, k), ("assistant", 12, {}), ("end", 13, dict(elapsed_ms=3000))], (1, 3, True)),
        # the end's own duration disagrees by more than two seconds
        2: ([("trigger", 10, k), ("assistant", 12, {}), ("end", 13, dict(elapsed_ms=9000))], (0, None, False)),
        # taken input joins the running turn
        3: (
            [("trigger", 10, k), ("assistant", 11, {}), ("queue", 12, dict(take=True)), ("trigger", 11, dict(key="b")),
             ("assistant", 13, {}), ("end", 15, dict(elapsed_ms=5000))],
            (1, 5, True),
        ),
        # a second prompt without taken input is ambiguous until an end
        4: (
            [("trigger", 10, k), ("assistant", 11, {}), ("trigger", 12, dict(key="b")), ("assistant", 13, {}),
             ("end", 15, dict(elapsed_ms=5000)), ("trigger", 20, dict(key="c")), ("assistant", 21, {}),
             ("end", 24, dict(elapsed_ms=4000))],
            (1, None, False),
        ),
        # a slash command that ran locally opens no turn
        5: (
            [("trigger", 5, dict(key="s", command=True)), ("ignored", 6, dict(local_output=True)), ("trigger", 10, k),
             ("assistant", 12, {}), ("end", 13, dict(elapsed_ms=3000))],
            (1, 3, True),
        ),
        # the turn may be over after a final stop, so its total is not published
        6: ([("trigger", 10, k), ("assistant", 12, dict(final_stop=True))], (0, None, False)),
    }
    rows = [
        record(s, i, role, second, **more)
        for s, (log, _) in cases.items()
        for i, (role, second, more) in enumerate(log)
    ]
    got = tn.turn_summary_b(tn.turn_events_b(spark.createDataFrame(rows, B_SCHEMA)))
    for r in got.collect():
        assert (r["turns"], r["total_s"], r["complete"]) == cases[r["session_id"]][1], r


A_SCHEMA = "session_id long, ord long, opens boolean, key string, start long, `end` long, outcome string"


def test_hand_made_keyed_turns(spark):
    cases = {
        1: ([(True, "a", 10, None), (False, "a", 10, 15)], (1, 5, True)),
        # a repeated identical end counts once
        2: ([(True, "a", 10, None), (False, "a", 10, 15), (False, "a", 10, 15)], (1, 5, True)),
        # an end without a start is recorded, but the total is unknown
        3: ([(False, "a", 10, 15)], (1, None, False)),
        # two ends of one turn that disagree
        4: ([(True, "a", 10, None), (False, "a", 10, 15), (False, "a", 10, 16)], (1, None, False)),
        # overlap with the previous interval
        5: ([(True, "a", 10, None), (False, "a", 10, 15), (True, "b", 12, None), (False, "b", 12, 20)], (2, None, False)),
    }
    rows = [
        (s, i, opens, key, start, end, None if opens else "completed")
        for s, (log, _) in cases.items()
        for i, (opens, key, start, end) in enumerate(log)
    ]
    df = spark.createDataFrame(rows, A_SCHEMA)
    for span in (WHOLE, 2):
        got = tn.turn_summary_a(tn.turn_records_a(df, 1_000, span), span)
        for r in got.collect():
            assert (r["turns"], r["total_s"], r["complete"]) == cases[r["session_id"]][1], (r, span)
