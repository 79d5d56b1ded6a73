"""Children of rollout logs: what counts, and what makes a roster unknown."""

import hashlib
import json

import pytest

from sessionledger.operators import children as ch
from sessionledger.sources import logs as lg

from .test_oracles import check

NOW = 10**12


def live(path, kind, ms=1000, **more):
    return {"type": "event_msg", "payload": {"type": "sub_agent_activity", "agent_path": path, "kind": kind, "occurred_at_ms": ms, **more}}


def done(path, kind, ms=2000, thread="s", item="SubAgentActivity"):
    inner = {"type": item, "agent_path": path, "kind": kind}
    return {"type": "event_msg", "payload": {"type": "item_completed", "thread_id": thread, "completed_at_ms": ms, "item": inner}}


GOOD = [live("/root/a", "started"), live("/root/a/b-1", "started"), live("/root/c", "started"), live("/root/a", "interacted"), done("/root/c", "failed", 3000)]
CASES = {
    "good": (GOOD, (True, 2, 0, 0, 1, 3, 3_000_000)),
    "ends": ([*GOOD, done("/root/a", "completed"), live("/root/a/b-1", "interrupted", 4000)], (True, 0, 1, 1, 1, 3, 4_000_000)),
    "none": ([{"type": "session_meta"}], (True, 0, 0, 0, 0, 0, None)),
    "other item": ([*GOOD, done("/root/x", "completed", item="Message")], (True, 2, 0, 0, 1, 3, 3_000_000)),
    "no event": ([*GOOD, {"type": "response_item", "payload": {"type": "sub_agent_activity"}}], (True, 2, 0, 0, 1, 3, 3_000_000)),
    "early": ([*GOOD, done("/root/late", "completed")], None),
    "other thread": ([*GOOD, done("/root/c", "completed", thread="t")], None),
    "path": ([*GOOD, live("/home/a", "started")], None),
    "empty part": ([*GOOD, live("/root/a//b", "started")], None),
    "no name": ([*GOOD, live("/root/", "started")], None),
    "dots": ([*GOOD, live("/root/../a", "started")], None),
    "long": ([*GOOD, live("/root/" + "a" * 507, "started")], None),
    "kind": ([*GOOD, live("/root/a", "paused")], None),
    "no time": ([*GOOD, live("/root/a", "completed", 0)], None),
    "future": ([*GOOD, live("/root/a", "completed", NOW)], None),
    "text time": ([*GOOD, live("/root/a", "completed", "5")], None),
    "torn": ([*GOOD, '{"type":"event_msg","payl'], None),
}


@pytest.fixture(scope="module")
def events(spark):
    rows = [("s" if name == "good" else name, i, x if isinstance(x, str) else json.dumps(x).replace('"thread_id": "s"', f'"thread_id": "{"s" if name == "good" else name}"')) for name, (lines, _) in CASES.items() for i, x in enumerate(lines)]
    rows.append((None, 0, json.dumps(live("/root/a", "started"))))
    lines = spark.createDataFrame(rows, "session_id string, ord long, value string")
    return lg.rollout_children(lines, NOW)


def test_rosters(events):
    got = {r.session_id: r for r in ch.rollout_outcomes(events).collect()}
    assert len(got) == len(CASES) + 1
    for name, (_, want) in CASES.items():
        r = got["s" if name == "good" else name]
        assert r.valid == (want is not None), name
        if want is not None:
            assert (r.valid, r.running, r.completed, r.interrupted, r.errored, r.total, r.child_seq) == want, name
        else:
            assert r.total is None and r.child_seq is None
    assert got[None].running == got[None].total == 1


def test_known_children_and_keys(events):
    rows = {(r.session_id, r.ord): r for r in ch.known_children(events).collect()}
    assert rows["early", 5].known is False and rows["s", 4].known is True
    assert rows["s", 0].child_key == hashlib.sha256(b"/root/a").hexdigest()


def test_no_lines(spark):
    none = spark.createDataFrame([], "session_id string, ord long, value string")
    assert ch.rollout_outcomes(lg.rollout_children(none, NOW)).count() == 0


def test_rollout_files(spark, tmp_path):
    sid = "0198-ab"
    (tmp_path / f"rollout-2024-01-02T03-04-05-{sid}.jsonl").write_text("\n".join(json.dumps(x).replace('"thread_id": "s"', f'"thread_id": "{sid}"') for x in GOOD) + "\n")
    (tmp_path / "rollout-plain.jsonl").write_text("{}\n")
    got = {r.session_id: r.total for r in ch.rollout_outcomes(lg.rollout_children(lg.read_rollout_log(spark, str(tmp_path)), NOW)).collect()}
    assert got == {sid: 3, "plain": 0}


@pytest.mark.parametrize("name", ["rollout_children", "rollout_turns", "identity_keys"])
def test_registered(spark, duck, name):
    check(spark, duck, name)
