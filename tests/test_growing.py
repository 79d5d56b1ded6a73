"""A log that grows is read on from its last whole line."""

import json
import random

import pytest
from pyarrow import fs

from sessionledger.operators import usage as us
from sessionledger.sources import logs as lg
from sessionledger.streaming import folds as fo
from sessionledger.streaming import growing as gr
from sessionledger.streaming import runs as ru

from .test_logs import answer, prompt
from .test_oracles import check
from .test_streams import few_partitions, rows_of  # noqa: F401


@pytest.mark.parametrize("seed", range(30))
def test_splits_own_each_line_once(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(gr, "BLOCK", rng.choice([1, 3, 7, 1000]))
    data = b"".join(bytes(rng.choices(b"ab\xc3\xa9\r", k=rng.randrange(6))) + b"\n" for _ in range(60))
    open_end = rng.choice([b"", b"no end yet"])
    (tmp_path / "x.jsonl").write_bytes(data + open_end)
    store, file = fs.FileSystem.from_uri(str(tmp_path / "x.jsonl"))
    end = gr.last_line_end(store, file, 0, len(data + open_end))
    assert end == len(data)
    begin = rng.choice([0, data.index(b"\n") + 1])
    reader = gr.GrowingReader(str(tmp_path), ".jsonl", rng.choice([1, 2, 5, 17, 10_000]))
    got = [x for p in reader.partitions({file: begin}, {file: end}) for x in gr.lines_of(store, p.span)]
    want, at = [], begin
    for line in data[begin:].split(b"\n")[:-1]:
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert got == want
    assert gr.last_line_end(store, file, end, len(data + open_end)) == end


def test_totals_after_three_appends(spark, tmp_path):
    """One file grows three times, once in the middle of a line; another comes later."""
    rng = random.Random(3)
    lines = []
    for i in range(200):
        lines.append(json.dumps(answer("s1", f"m{i // 3}", i + 1, [rng.randrange(50) for _ in range(4)], rng.choice(["end_turn", "tool_use"]))))
        if i % 10 == 0:
            lines.append(json.dumps(prompt("s1", i + 1, "é" * 50)))
    data = ("\n".join(lines) + "\n").encode()
    log, out = tmp_path / "logs" / "s1.jsonl", str(tmp_path / "out")
    log.parent.mkdir()
    cuts = [0, len(data) // 3 + 7, 2 * len(data) // 3 + 11, len(data)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        with log.open("ab") as f:
            f.write(data[a:b])
        if i == 1:
            (log.parent / "s2.jsonl").write_text(json.dumps(answer("s2", "m", 5, [1, 2, 3, 4], "end_turn")) + "\n\n")
        stream = ru.stream_session_log(spark, str(log.parent), split=5000)
        assert stream.isStreaming and set(stream.columns) == {"file", "ord", "value", "session_id"}
        events = ru.run_to_table(fo.stream_fold(gr.record_stream(stream, 10**15), "session_id", fo.MACHINE_USAGE), "grow", out)
    batch = lg.transcript_records(lg.parse_transcript(lg.read_session_log(spark, str(log.parent)), 10**15))
    got, want = fo.usage_view(events), us.usage_totals(batch)
    assert rows_of(got.select(want.columns)) == rows_of(want) and want.filter("total_output > 0").count() == 2
    last = us.last_response(batch).select("session_id", "context", "model")
    assert rows_of(got.select("session_id", "context", "model")) == rows_of(last)
    # Nothing new: no lines come twice.
    again = ru.run_to_table(fo.stream_fold(gr.record_stream(stream, 10**15), "session_id", fo.MACHINE_USAGE), "grow", out)
    assert rows_of(fo.usage_view(again)) == rows_of(got)


def test_shorter_file_is_an_error(tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    (tmp_path / "_hidden.jsonl").write_text("no\n")
    (tmp_path / "a.txt").write_text("no\n")
    reader = gr.GrowingReader(str(tmp_path), ".jsonl", 100)
    assert list(reader.latestOffset().values()) == [8]
    (tmp_path / "a.jsonl").write_text("one\n")
    with pytest.raises(ValueError):
        reader.latestOffset()
    with pytest.raises(ValueError):
        gr.GrowingReader(str(tmp_path), ".jsonl", 100).partitions({"a": 8}, {"a": 4})
    assert gr.GrowingReader(str(tmp_path / "none"), ".jsonl", 100).latestOffset() == {}


def test_registered_text_stream(spark, duck):
    check(spark, duck, "stream_session_log")
