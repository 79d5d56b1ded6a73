"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents, each ended by one id, are laid end to end and cut into sequences of
``length`` ids. A keyed Feistel network permutes the sequence numbers (cycle
walking keeps them below the count), so any slot can be computed without a
table. Sequences travel to the task of their shard range and are written in
slot order: sequence ``s`` lies at byte ``(s % per_shard) * length * 2`` of
shard ``s // per_shard``, so a reader can start at any step.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import in_arrow, landed, mix64, shared_folder
from .tokens import token_ids

LENGTH, PER_SHARD, ROUNDS = 2048, 1024, 4
TOGETHER = 256  # documents whose ids are compressed as one
LEVEL = 6


class Feistel:
    """A keyed permutation of ``0 .. n - 1``."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [
            np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little"))
            for r in range(ROUNDS)
        ]

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix64(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (left << self.half) | right

    def _all(self, x, back: bool) -> np.ndarray:
        x = self._walk(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._walk(x[out], back)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._all(sequence, False)

    def sequence(self, slot) -> np.ndarray:
        return self._all(slot, True)


def tokenised(docs: DataFrame, key: str, text: str, tokenizer: str, end: int) -> DataFrame:
    """Landed: per some documents their task, ids before them in the task, and
    keys, counts and compressed ids."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("total", T.LongType()),
            T.StructField("keys", T.ArrayType(narrow.schema["key"].dataType)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                ids = [token_ids(tokenizer, value.as_py(), end) for value in batch.column(1)]
                flat = np.concatenate(ids)
                if flat.max(initial=0) > 0xFFFF:
                    raise ValueError("an id does not fit two bytes")
                keys = pa.ListArray.from_arrays([0, len(ids)], batch.column(0))
                row = [[part], [before], [len(flat)], keys, [[len(x) for x in ids]], [press.compress(flat.astype("<u2").tobytes())]]
                types = (pa.int32(), pa.int64(), pa.int64(), keys.type, pa.list_(pa.int64()), pa.binary())
                before += len(flat)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(row, types)], names=schema.names)

    return landed(in_arrow(narrow, run, schema), "ids")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def uri(path: str) -> str:
    """``file:/x`` as Hadoop writes it, in the form other readers take."""
    return "file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path


def materialise(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 0,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    seed: str = "order",
) -> DataFrame:
    """Write the shards to ``folder`` and return, per stretch of a document in
    a sequence: key, start (ids of the document before it), n, sequence, offset
    in it, slot, shard, byte offset in the shard and ids_crc32.

    ``folder`` must be reachable from all executors by a scheme that pyarrow
    opens. Vocabularies of up to 65,536 ids fit two bytes an id, little-endian;
    a larger id raises. NULL text is just ``end``; repeated rows are written
    each; the last sequence is filled up with ``end`` in the file. An empty
    input writes no shard. The order before the permutation is that of the
    input's partitions; sort ``docs`` first for one of your own. A shard is
    written under another name and moved, so lost tasks leave no part of one.
    """
    rows = tokenised(docs, key, text, tokenizer, end)
    # One row per task of the reading stage, landed so that its size is known.
    sums = landed(rows.groupBy("part").agg(F.sum("total").alias("m")), "sums")
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = landed(sums.select("part", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("base")), "bases")
    total = sums.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    n_seq = -(-total // length)
    key_type = docs.schema[key].dataType
    stretch = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType())])
    moved = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("shard", "slot", "sequence", "offset")]
        + [T.StructField("stretches", T.ArrayType(stretch)), T.StructField("ids", T.BinaryType())]
    )
    feistel = Feistel(n_seq, seed)

    def cut(batches):
        press, plain = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            first = batch.column("base").to_numpy(zero_copy_only=False) + batch.column("before").to_numpy(zero_copy_only=False)
            counts = batch.column("counts").to_pylist()
            for r, (at, packed) in enumerate(zip(first.tolist(), batch.column("ids").to_pylist())):
                flat = np.frombuffer(plain.decompress(packed), "<u2")
                keys = batch.column("keys").slice(r, 1).flatten()
                # Sequences these documents touch, and what of each they hold.
                seq = np.arange(at // length, -(-(at + len(flat)) // length))
                lo = np.maximum(seq * length - at, 0)
                hi = np.minimum((seq + 1) * length - at, len(flat))
                ends = np.cumsum(counts[r])
                cuts = np.union1d(ends, hi)
                begin = np.concatenate([[0], cuts[:-1]])
                of = np.searchsorted(ends, begin, "right")
                parts = pa.StructArray.from_arrays(
                    [keys.take(pa.array(of)), pa.array(begin - (ends - counts[r])[of]), pa.array((cuts - begin).astype(np.int32))],
                    names=stretch.names,
                )
                split = np.append(np.searchsorted(begin, lo), len(begin)).astype(np.int32)
                slot = feistel.slot(seq)
                data = [press.compress(flat[s:e].tobytes()) for s, e in zip(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(c) for c in (slot // per_shard, slot, seq, at + lo - seq * length)],
                        pa.ListArray.from_arrays(pa.array(split), parts),
                        pa.array(data, pa.binary()),
                    ],
                    names=moved.names,
                )

    out = T.StructType(
        [T.StructField("key", key_type)]
        + [T.StructField(c, T.LongType()) for c in ("start", "n", "sequence", "offset", "slot", "shard", "byte_offset", "ids_crc32")]
    )
    folder = uri(folder)

    def write(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        plain = zstandard.ZstdDecompressor()
        shard, stream, temp, size, at = None, None, None, 0, 0

        def close():
            if stream is not None:
                if at < size:
                    stream.write(np.full(size - at, end, "<u2").tobytes())
                stream.close()
                fs.move(temp, f"{top}/shard-{shard:08d}.bin")

        for batch in batches:
            rows = []
            for s, slot, seq, off, parts, packed in zip(*(batch.column(c).to_pylist() for c in moved.names)):
                if s != shard:
                    close()
                    shard, at = s, 0
                    size = min(per_shard, n_seq - s * per_shard) * length
                    temp = f"{top}/_{s}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temp)
                data = np.frombuffer(plain.decompress(packed), "<u2")
                place = slot % per_shard * length + off
                if at < place:  # the last sequence of all ended early
                    stream.write(np.full(place - at, end, "<u2").tobytes())
                stream.write(data.tobytes())
                at, pos = place + len(data), 0
                for x in parts:
                    n = x["n"]
                    crc = zlib.crc32(data[pos : pos + n].astype("<u4").tobytes())
                    rows.append((x["key"], x["start"], n, seq, off + pos, slot, s, (place + pos) * 2, crc))
                    pos += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), to_arrow_schema(out).types)] if rows else [pa.array([], t) for t in to_arrow_schema(out).types],
                names=out.names,
            )
        close()

    sequences = in_arrow(rows.join(bases, "part"), cut, moved)
    ordered = sequences.repartitionByRange("shard").sortWithinPartitions("slot", "offset")
    result = landed(in_arrow(ordered, write, out), "index")
    return result.withColumnRenamed("key", key)


def read_shards(spark: SparkSession, folder: str, slots: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The ids of the wanted ``slot`` rows, read straight at their place."""
    folder = uri(folder)

    def read(batches):
        fs, top = file_system(folder)
        for batch in batches:
            slot = batch.column(0).to_pylist()
            ids = []
            for s in slot:
                with fs.open_input_file(f"{top}/shard-{s // per_shard:08d}.bin") as f:
                    f.seek(s % per_shard * length * 2)
                    ids.append(np.frombuffer(f.read(length * 2), "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "ids"])

    return in_arrow(slots.select(F.col("slot").cast("long")), read, "slot long, ids array<int>")


__all__ = ["Feistel", "materialise", "read_shards", "shared_folder"]
