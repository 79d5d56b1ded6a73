"""Real log files: split lines, strict numbers, identities and order."""

import json
import random

from pyspark.sql import functions as F

from sessionledger.operators import turns as tn
from sessionledger.operators import usage as us
from sessionledger.operators.children import child_outcomes
from sessionledger.sources import logs as lg


def stamp(second):
    return f"1970-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def answer(sid, mid, second, usage, stop="tool_use", **more):
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    message = {"id": mid, "model": "model-1", "stop_reason": stop, "usage": dict(zip(names, usage))}
    return {"type": "assistant", "sessionId": sid, "timestamp": stamp(second), "message": message, **more}


def prompt(sid, second, text="hello", **more):
    return {
        "type": "user", "sessionId": sid, "uuid": f"u{second}", "timestamp": stamp(second),
        "message": {"content": text}, **more,
    }


def write(folder, sid, lines):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    (folder / f"{sid}.jsonl").write_text(text + "\n")


def records(spark, path):
    lines = lg.read_session_log(spark, str(path))
    return lg.transcript_records(lg.parse_transcript(lines, 10**15))


def by_session(df):
    return {r["session_id"]: r.asDict() for r in df.collect()}


def test_small_transcripts(spark, tmp_path):
    p = tmp_path / "project"
    good = [
        prompt("s1", 10),
        answer("s1", "msg-1", 11, [100, 20, 1000, 50]),
        answer("s1", "msg-2", 12, [10, 5, 1100, 0], "end_turn"),
        {"type": "system", "subtype": "turn_duration", "sessionId": "s1", "timestamp": stamp(13), "durationMs": 3000},
    ]
    write(p, "s1", good)
    # one response over three lines counts once, by its last line
    write(p, "s2", [answer("s2", "m", s, [1, s, 0, 0]) for s in (1, 2, 3)])
    # a closed message that reopens
    write(p, "s3", [answer("s3", m, i, [1, 1, 0, 0]) for i, m in enumerate(["a", "b", "a"], 1)])
    # booleans, floats and text are no counters
    for n, bad in enumerate([True, 1.0, "1", None]):
        write(p, f"n{n}", [answer(f"n{n}", "a", 1, [bad, 1, 0, 0], "end_turn")])
    write(p, "s5", [answer("s5", "a", 1, [1, 1, 0, 0]), answer("other", "b", 2, [1, 1, 0, 0])])
    write(p, "s6", [answer("s6", "a", 1, [1, 1, 0, 0]), "{broken"])
    write(p, "s7", [answer("s7", "a", 1, [1, 1, 0, 0]), answer("s7", "b", 2, [5, 5, 5, 5], forkedFrom={"a": 1})])
    synthetic = answer("s8", "b", 2, [9, 9, 9, 9])
    synthetic["message"]["model"] = "<synthetic>"
    write(p, "s8", [answer("s8", "a", 1, [1, 1, 0, 0]), synthetic])
    repeated = json.dumps(answer("s9", "b", 2, [1, 1, 0, 0]))[:-1] + ', "type": "assistant"}'
    write(p, "s9", [answer("s9", "a", 1, [1, 1, 0, 0]), repeated])

    rec = records(spark, tmp_path).persist()
    totals = by_session(us.usage_totals(rec))
    t1 = totals["s1"]
    assert (t1["total_output"], t1["total_input"], t1["total_cache_read"]) == (25, 2260, 2100)
    assert (t1["total_cache_write"], t1["total_uncached_input"]) == (50, 110)
    assert totals["s2"]["total_output"] == 3
    for s in ("s3", "n0", "n1", "n2", "n3", "s5", "s6", "s9"):
        assert totals[s]["total_input"] is None, s
    assert totals["s7"]["total_input"] == totals["s8"]["total_input"] == 1
    assert by_session(us.last_response(rec))["s1"]["context"] == 1110
    turns = by_session(tn.turn_summary_b(tn.turn_events_b(tn.turn_records_b(rec))))
    assert (turns["s1"]["turns"], turns["s1"]["total_s"]) == (1, 3)
    assert turns["s6"]["turns"] is None
    rec.unpersist()


def test_iterations_and_compactions(spark, tmp_path):
    p = tmp_path / "project"
    a = answer("i1", "a", 1, [7, 7, 7, 7], "end_turn")
    it = lambda kind, n: {
        "type": kind, "input_tokens": n, "output_tokens": n, "cache_read_input_tokens": n, "cache_creation_input_tokens": 0,
    }
    a["message"]["usage"]["iterations"] = [it("message", 3), it("advisor_message", 9)]
    write(p, "i1", [a, {"type": "system", "subtype": "compact_boundary", "sessionId": "i1", "timestamp": stamp(2)}])
    b = answer("i2", "a", 1, [7, 7, 7, 7], "end_turn")
    b["message"]["usage"]["iterations"] = [it("compaction", 3)]
    write(p, "i2", [b])
    c = answer("i3", "a", 1, [7, 7, 7, 7], "end_turn")
    c["message"]["usage"]["iterations"] = "odd"
    write(p, "i3", [c])
    rec = records(spark, tmp_path)
    last = by_session(us.last_response(rec))
    assert (last["i1"]["context"], last["i1"]["output_tokens"]) == (6, 3)
    assert last["i2"]["context"] == 21 and last["i3"]["context"] is None
    comp = by_session(us.compactions_b(rec))
    assert (comp["i1"]["compactions"], comp["i2"]["compactions"]) == (1, None)


def test_children_of_a_transcript(spark, tmp_path):
    sid = "c1"
    note = lambda task, status: prompt(
        sid, 30, f"<task-notification>\n<task-id>{task}</task-id>\n<status>{status}</status></task-notification>",
        origin={"kind": "task-notification"},
    )
    launch = lambda task: prompt(sid, 20, "x", toolUseResult={"status": "async_launched", "agentId": task})
    lines = [launch("a"), launch("b"), launch("c"), note("a", "completed"), note("b", "killed"), note("zz", "failed")]
    lines.append(prompt(sid, 40, "y", toolUseResult={"resumedAgentId": "b", "success": True}))
    lines.append(prompt(sid, 41, "z", toolUseResult={"status": "completed", "agentId": "d", "totalDurationMs": 5}))
    write(tmp_path / "project", sid, lines)
    write(tmp_path / "project", "c2", [prompt("c2", 1, "<task-notification>no id", origin={"kind": "task-notification"})])
    got = by_session(child_outcomes(records(spark, tmp_path)))
    r = got["c1"]
    assert (r["running"], r["completed"], r["interrupted"], r["total"]) == (2, 2, 0, 4)
    assert got["c2"]["valid"] is False and got["c2"]["total"] is None


def test_order_holds_when_a_file_is_split(spark, tmp_path):
    lines = [answer("big", f"m{i}", i % 3000, [i, 0, 0, 0]) for i in range(6000)]
    write(tmp_path / "project", "big", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        raw = lg.read_session_log(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 8
        rows = lg.parse_transcript(raw).select("ord", "message_id", F.col("input").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["ord"] for r in rows}) == 6000
    assert [r["n"] for r in sorted(rows, key=lambda r: r["ord"])] == list(range(6000))


def test_rollout_log(spark, tmp_path):
    sid = "abc"
    event = lambda kind, second=0, **p: {"type": "event_msg", "timestamp": stamp(second), "payload": {"type": kind, **p}}
    usage = lambda i, c: {"input_tokens": i, "output_tokens": 5, "cached_input_tokens": c, "total_tokens": i + 5}
    lines = [
        {"type": "session_meta", "timestamp": stamp(0), "payload": {"id": sid}},
        event("task_started", 10, turn_id="t1", started_at=10),
        event("token_count", 11, info={"last_token_usage": usage(10, 2), "total_token_usage": usage(100, 40), "model_context_window": 112_000}),
        event("token_count", 12, info={"last_token_usage": usage(61_995, 2), "total_token_usage": usage(200, 90), "model_context_window": 112_000}),
        event("task_complete", 14, turn_id="t1", started_at=10, completed_at=14),
        {"type": "compacted"},
        event("context_compacted"),
        event("context_compacted"),
    ]
    folder = tmp_path / "2024" / "01"
    folder.mkdir(parents=True)
    (folder / f"rollout-{sid}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    raw = lg.read_session_log(spark, str(tmp_path), "A", r"rollout-([A-Za-z0-9-]+)\.jsonl$")
    assert lg.verify_header(raw, "A").count() == len(lines)
    rec = lg.parse_rollout(raw)
    u = us.latest_token_count(rec, 10**15).first()
    assert (u["total_input"], u["total_uncached_input"], u["context"], u["context_percent"]) == (200, 110, 62_000, 50)
    assert us.compactions_a(rec).first()["compactions"] == 2
    turns = tn.turn_records_a(rec.filter("opens OR closes").select("session_id", "ord", "opens", "key", "start", "end", "outcome"), 10**6)
    assert tn.turn_summary_a(turns).first()["total_s"] == 4


def test_hot_directory_of_predecessors(spark):
    """A third of all files lie in one directory; its rows are dealt over many tasks."""
    rng = random.Random(2)
    files = [("hot" if i % 3 == 0 else f"d{i % 40}", i, rng.randrange(500), rng.choice(["named", "clear", "clear", "unknown", "ended"] if i % 3 else ["named", "clear"])) for i in range(900)]
    files += [("hot", 900, 450, "unknown"), ("hot", 901, 470, "ended"), ("hot", 902, 460, "ended"), ("hot", 903, 470, "clear")]
    files = [(d, s, m, state, rng.randrange(900) if state == "named" else None) for d, s, m, state in files]
    heads = spark.createDataFrame(files, "dir string, session_id long, modified long, state string, named long")
    plain = {}
    for d, s, m, _, _ in files:
        others = [f for f in files if f[0] == d and f[1] != s and f[2] >= m]
        poor = any(f[3] == "unknown" or f[4] == s for f in others)
        plain[s] = "unknown" if poor else "growing" if any(f[3] == "ended" for f in others) else "clear"
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = lg.predecessor_check(heads).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.session_id: r.verdict for r in got} == plain and len(set(plain.values())) == 3
    assert len({r.task for r in got if r.dir == "hot"}) > 4
