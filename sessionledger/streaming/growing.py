"""A streaming source over logs that grow.

The offset is a byte position per file, behind its last whole line, so a file that
got longer is read on from there and a line still being written waits for its
end. What is new in a file is cut into splits of bytes that tasks read side by side;
a split owns the lines that begin in it. A line's place is the byte it begins
at, which is known without counting the lines before it.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.ship import ship_package
from ..sources.logs import SESSION_FROM_NAME, parse_transcript, transcript_records

BLOCK = 1 << 20
SPLIT = 64 << 20


class Span(NamedTuple):
    """Bytes ``[start, end)`` of a file; ``inside``: its first byte may lie within a line."""

    file: str
    start: int
    end: int
    inside: bool


class Split(InputPartition):
    def __init__(self, span: Span):
        self.span = span


def last_line_end(store: fs.FileSystem, file: str, start: int, size: int) -> int:
    """Position behind the last line end in ``[start, size)``, else ``start``; read from the back."""
    with store.open_input_file(file) as f:
        high = size
        while high > start:
            low = max(start, high - BLOCK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def lines_of(store: fs.FileSystem, span: Span):
    """(position, line) of the lines that begin in the span, without their line ends."""
    with store.open_input_file(span.file) as f:
        at = span.start - 1 if span.inside else span.start
        f.seek(at)
        rest, first = b"", span.inside
        while True:
            block = f.read(BLOCK)
            *whole, rest = (rest + block).split(b"\n")
            if not block:
                return
            for line in whole:
                # From one byte before the span on, the first line end shows where a line begins.
                if not first and at >= span.end:
                    return
                if not first:
                    yield at, line.removesuffix(b"\r")
                first = False
                at += len(line) + 1
            if at >= span.end and not first:
                return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split
        self.seen: dict[str, tuple[int, int]] = {}  # file: size and last line end when last looked at

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for x in found:
            if not x.is_file or not x.path.endswith(self.suffix) or x.base_name[0] in "._":
                continue
            size, end = self.seen.get(x.path, (0, 0))
            if x.size < end:
                raise ValueError(f"{x.path} got shorter than what has been read of it")
            if x.size != size:
                self.seen[x.path] = (x.size, last_line_end(store, x.path, end, x.size))
        return {file: end for file, (_, end) in sorted(self.seen.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0)
            if stop < begin:
                raise ValueError(f"{file} got shorter than what has been read of it")
            out += [Split(Span(file, a, min(a + self.split, stop), a > begin)) for a in range(begin, stop, self.split)]
        return out

    def read(self, partition: Split):
        store, _ = self.store()
        rows, held = [], 0
        schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("value", pa.string())])

        def batch():
            at, text = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([partition.span.file] * len(rows)), pa.array(at, pa.int64()), pa.array(text, pa.string())], schema=schema)

        for at, line in lines_of(store, partition.span):
            if line.strip():
                rows.append((at, line.decode("utf-8", "replace")))
                held += len(line)
            if held > BLOCK:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs")``: file, position, value. Options: ``path`` (any
    scheme that pyarrow opens), ``suffix`` of the file names, ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> GrowingReader:
        o = self.options
        return GrowingReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("split", SPLIT)))


def follow_logs(spark: SparkSession, path: str, suffix: str = ".jsonl", split: int = SPLIT) -> DataFrame:
    """Lines of all logs under ``path``: file, position, value. Blank lines are left out, bytes
    that are no UTF-8 replaced. A file may grow, and more may come; one that gets shorter
    than what has been read of it ends the stream with an error. The offset has an entry per
    file, so a folder should hold what is still being written, not an archive."""
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("suffix", suffix).option("split", split).load(path)


def session_lines(lines: DataFrame, fmt: str = "B", pattern: str | None = None) -> DataFrame:
    """Lines with ``ord`` and the session id of the file name, where each log is a file."""
    session = F.regexp_extract("file", pattern or SESSION_FROM_NAME[fmt], 1)
    return lines.select("file", F.col("position").alias("ord"), "value", F.when(session != "", session).alias("session_id"))


def segment_lines(lines: DataFrame, session: Column) -> DataFrame:
    """Lines of segment files that many logs share, ``round/part-n``: ``ord`` follows round, part and byte."""
    number = lambda i: F.regexp_extract("file", r"([0-9]+)/part-([0-9]+)", i).cast("long")
    ord = (number(1) * 100_000 + number(2)) * F.lit(1 << 40) + F.col("position")
    return lines.select("file", ord.alias("ord"), "value", session.alias("session_id"))


def record_stream(lines: DataFrame, horizon_us: int | None = None) -> DataFrame:
    """Records of a stream of lines, as every fold reads them."""
    return transcript_records(parse_transcript(lines, horizon_us))
