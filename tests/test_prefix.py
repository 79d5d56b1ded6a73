"""Chunks as functions: composed in any grouping they give what one replay gives."""

import json
import math
import random

import pytest

from sessionledger.operators import inferred as inf
from sessionledger.operators import turns as tn
from sessionledger.plans import STATE, chunked_fold

from .test_oracles import check
from .test_turn_folds import B_SCHEMA, WHOLE, plain, record, true_log


def any_record(rng, ord, now, keys):
    """Any mixture of roles, losses and flags, likely or not."""
    role = rng.choice(["ignored", "queue", "silent", "assistant", "assistant", "trigger", "trigger", "abort", "end", "end", "unknown", None])
    stamp = rng.choice([None, 0, 5]) if rng.random() < 0.03 else now * 1_000_000 + rng.randrange(3)
    chance = lambda p: rng.random() < p
    return record(
        1, ord, role, 0, stamp=stamp, lost=rng.choice(["queue", "record"]) if chance(0.03) else None, foreign=chance(0.002),
        key=None if chance(0.02) else rng.choice(keys) if chance(0.2) else f"u{ord}", injected=chance(0.1), command=chance(0.2),
        final_stop=chance(0.1), local_output=chance(0.2), local_command=chance(0.05), prompt=chance(0.05), take=chance(0.6),
        elapsed_ms=rng.randrange(9000) if role == "end" and chance(0.9) else None, background=chance(0.1), masks=chance(0.03),
        children_ok=chance(0.98), children_running=int(chance(0.05)),
    )


def any_log(rng, n):
    now, rows = 100, []
    for i in range(n):
        now = max(1, now + (rng.choice([0, 1, 2, 3, -2]) if rng.random() < 0.9 else rng.choice([-20, 20])))
        rows.append(any_record(rng, i, now, ["k1", "k2", "entry"]))
    asked = [r[5] for r in rows if r[2] == "trigger" and r[5] is not None]
    return [(*r[:6], r[2] == "trigger" and asked.count(r[5]) > 1, *r[7:]) for r in rows]


@pytest.mark.parametrize("seed", range(6))
def test_functions_of_stretches_equal_a_replay(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [r[1:] for r in any_log(rng, rng.choice([5, 30, 120]))]
        state, states, told = inf.start(), [], []
        for i, r in enumerate(rows):
            states.append(json.loads(json.dumps(state)))
            rows[i] = (*r, bool(r[5] and r[4] in state["used"]))
            inf.step(state, r, lambda *e: told.append(e))
        cuts = sorted({0, *rng.sample(range(len(rows)), 4)})
        texts = []
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            top = max((r[6] // 1_000_000 for r in rows[:a] if r[6] is not None and r[1] in ("abort", "end", "queue")), default=0)
            stretch = inf.Stretch(rng.choice([None, max(top, 0)]))
            for r in rows[a:b]:
                stretch.step(r)
            texts.append(stretch.text())
        for (entry, floor), a in zip(inf.walked(None, 0, texts), cuts):
            got, want = json.loads(entry), states[a]
            assert got["control"] == want["control"]
            if got["control"][0] != inf.GONE:
                assert (floor, *[got[k] for k in ("start", "taken", "seen")]) == (want["floor"], *[want[k] for k in ("start", "taken", "seen")])
        at = rng.randrange(1, len(texts))
        halves = [inf.composed(texts[:at]), inf.composed(texts[at:])]
        assert inf.walked(None, 0, [*halves, texts[0]])[2] == inf.walked(None, 0, [*texts, texts[0]])[-1]


@pytest.fixture
def checkpoints(spark, monkeypatch):
    made, kind = [], type(spark.range(0))
    cut = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: made.append(1) or cut(self, *a, **k))
    return made


@pytest.mark.parametrize("chunks", [20, 200])
def test_log_many_checkpoints(spark, checkpoints, chunks):
    rows, _ = true_log(random.Random(chunks), 1, 60, 0.2)
    other = [(None, *r[1:]) for r in true_log(random.Random(1), 1, 60, 0.3)[0]]
    df = spark.createDataFrame(rows + other, B_SCHEMA)
    span = -(-len(rows) // chunks) if chunks < 200 else 1
    cut = chunked_fold(df, ["session_id"], tn.MACHINE_B, span)
    n = len(rows) // span + 1
    assert n >= chunks and 0 < len(checkpoints) <= math.log2(n) + 2
    got = plain(cut)
    assert cut.filter(f"event = '{STATE}'").count() >= chunks
    assert got == plain(chunked_fold(df, ["session_id"], tn.MACHINE_B, WHOLE))


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_that_come_back_across_chunks(spark, seed):
    """A key that finished a turn in one chunk is known as spent in a later one."""
    rows = [r for r in any_log(random.Random(seed), 500) if not r[4]]
    log = [record(2, i, *r) for i, r in enumerate([("trigger", 10), ("assistant", 11), ("end", 12), ("trigger", 20), ("assistant", 21), ("end", 22)] * 12)]
    for i, r in enumerate(log):
        more = dict(key="again" if i % 36 < 18 else f"k{i}", repeated=i % 36 < 18) if r[2] == "trigger" else {}
        second = 100 * (i // 3) + r[7] // 1_000_000
        elapsed = {"elapsed_ms": 2000} if r[2] == "end" else {}
        log[i] = record(2, i, r[2], (second if r[7] // 1_000_000 < 20 else second - 10), **more, **elapsed)
    df = spark.createDataFrame([*rows, *log], B_SCHEMA)
    whole = plain(chunked_fold(df, ["session_id"], tn.MACHINE_B, WHOLE))
    assert any("'used'" in e for e in whole) and plain(chunked_fold(df, ["session_id"], tn.MACHINE_B, 7)) == whole


@pytest.mark.parametrize("name", ["turn_summary_b", "turn_gate_stats", "queued_input_join"])
def test_inferred_turns_in_small_chunks(spark, duck, small_chunks, name):
    check(spark, duck, name)
