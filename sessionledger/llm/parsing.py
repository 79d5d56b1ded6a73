"""Repeated byte strings by prefix-free parsing.

The corpus is parsed into phrases at rolling-hash triggers: the trigger of a
100-byte string is its 40-byte substring of least hash, and a phrase is what
the strings with one and the same trigger cover. Equal strings thus lie at
equal places of phrases with equal triggers.

* Dictionary and parse: phrases are brought together by trigger. Of phrases
  that are equal throughout, the first in corpus order is the dictionary entry;
  all strings in the others start earlier too.
* Dictionary suffixes: entries that share a trigger but differ elsewhere are
  compared by their suffixes' first 100 bytes; suffixes that agree there are
  brought together by hash, and the parse gives the first in corpus order.

No order of all suffixes of the corpus is built: only which of them agree in
100 bytes, and which of those is first, decides what is removed. Whatever
moves between tasks is packed in compressed columns, and each task first
drops what it has seen itself, so a passage that many documents hold sends one
row per task.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, landed, mix64, run_starts, utf8
from .shingles import BYTE, ODD, Rolling

LENGTH, TRIGGER = 100, 40
SEGMENT = 1 << 20  # bytes parsed at a time; longer texts are parsed in segments
FLUSH = 64 << 20  # bytes of text after which a task sends what it has found
LOWEST = -(1 << 63)

BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
PARSE, COVER, ASK, TEXT = 0, 1, 2, 3


def pack(doc_key: np.ndarray, doc_hash: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers of rows and the document of each, compressed
    by byte planes; every document is held once."""
    order = np.lexsort((doc_hash, doc_key))
    first = run_starts(doc_key[order], doc_hash[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    docs = [doc_key[order][first], doc_hash[order][first]]
    flat = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (*docs, number, *columns))
    return struct.pack("<qqq", len(number), len(first), len(columns)) + zstandard.ZstdCompressor(level=1).compress(flat)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Document key and hash of each row, then its columns, as signed numbers."""
    n, n_docs, n_columns = struct.unpack_from("<qqq", blob)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[24:]), np.uint8)
    out, at = [], 0
    for size in (n_docs, n_docs, n, *[n] * n_columns):
        out.append(np.ascontiguousarray(flat[at : at + 8 * size].reshape(8, size).T).view(np.int64).ravel())
        at += 8 * size
    key, text, number, *rest = out
    return [key[number], text[number], *rest]


def gather(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpack, blobs))]


def bucket_of(doc_key: np.ndarray, doc_hash: np.ndarray, n: int) -> np.ndarray:
    return (doc_key ^ doc_hash) % n


def by_bucket(bucket: np.ndarray, kind: int, doc_key, doc_hash, *columns):
    """Blob rows, one per bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    starts = run_starts(bucket[order])
    for s, e in zip(starts, np.append(starts[1:], len(order))):
        rows = order[s:e]
        yield int(bucket[rows[0]]), kind, pack(doc_key[rows], doc_hash[rows], *[c[rows] for c in columns])


def merged(doc_key, doc_hash, start, stop):
    """Touching and overlapping intervals of each document joined."""
    if not len(start):
        return doc_key, doc_hash, start, stop
    order = np.lexsort((start, doc_hash, doc_key))
    doc_key, doc_hash, start, stop = doc_key[order], doc_hash[order], start[order], stop[order]
    first = run_starts(doc_key, doc_hash)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
    # Documents laid apart, one running maximum serves all of them.
    lift = number * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return doc_key[at], doc_hash[at], start[at], reach[last] - lift[last]


def first_of_each(one, two, doc_key, doc_hash, start):
    """Rows sorted by code and corpus order, and which of them open a code.
    A row that repeats the very same place opens none and is left out."""
    order = np.lexsort((start, doc_hash, doc_key, two, one))
    place = run_starts(one[order], two[order], doc_key[order], doc_hash[order], start[order])
    order = order[place]
    opens = np.zeros(len(order), bool)
    opens[run_starts(one[order], two[order])] = True
    return order, opens


def phrases(raw: np.ndarray, at: np.ndarray, length: int, k: int):
    """(text, offset, more starts, trigger hash, phrase hash) of each phrase."""
    n, width = len(raw), length - k + 1
    if n < length:
        return [np.empty(0, np.int64)] * 5
    roll = Rolling(raw)
    hashes = mix64((roll.sums[k:] - roll.sums[:-k]) * roll.inverse[: n - k + 1])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - k + 1, dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 2, np.int64)
    whole = np.diff(at) >= length
    np.add.at(edge, at[:-1][whole], 1)
    np.add.at(edge, at[1:][whole] - length + 1, -1)
    valid = np.cumsum(edge)[: len(trigger)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    old = valid.copy()
    old[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
    p, q = np.flatnonzero(new), np.flatnonzero(old)
    text = np.searchsorted(at, p, "right") - 1
    return text, p - at[text], q - p, hashes[trigger[p]].view(np.int64), roll.of(p, q + length).view(np.int64)


def segments(raw: np.ndarray, at: np.ndarray, length: int):
    """Groups of stretches of texts, about SEGMENT bytes each: bytes, their
    offsets, and text number and base offset of each stretch. A longer text is
    cut so that each of its strings lies in one stretch."""
    parts, size = [], 0

    def group():
        data = [raw[at[d] + s : at[d] + e] for d, s, e in parts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in data])])
        return np.concatenate(data), ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for d, n in enumerate(np.diff(at).tolist()):
        for s in range(0, max(n - length + 1, 0), SEGMENT):
            e = min(n, s + SEGMENT + length - 1)
            parts.append((d, s, e))
            size += e - s
            if size >= SEGMENT:
                yield group()
                parts, size = [], 0
    if parts:
        yield group()


def emit(rows):
    rows = list(rows)
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=BLOB.names)


def send(found: list, n: int):
    """Blobs of what a task has found (doc key, doc hash, code one, code two,
    start, more starts): what it holds twice itself is covered already."""
    key, text, one, two, start, more, length = found
    order, opens = first_of_each(one, two, key, text, start)
    kept, gone = order[opens], order[~opens]
    bucket = (mix64(one[kept].view(np.uint64)) % np.uint64(n)).astype(np.int64)
    yield from by_bucket(bucket, PARSE, key[kept], text[kept], one[kept], two[kept], start[kept], more[kept])
    cover = merged(key[gone], text[gone], start[gone], start[gone] + more[gone] + length)
    yield from by_bucket(bucket_of(cover[0], cover[1], n), COVER, *cover)


def parsed(texts: DataFrame, n: int, length: int, k: int) -> DataFrame:
    """Blobs of all phrases of ``texts`` (doc_key, doc_hash, text)."""

    def run(batches):
        found, size = [], 0
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            keys, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_key", "doc_hash"))
            for data, ends, doc, base in segments(raw, at, length):
                text, off, more, trigger, phrase = phrases(data, ends, length, k)
                found.append((keys[doc[text]], hashes[doc[text]], trigger, phrase, base[text] + off, more))
                size += len(data)
                if size >= FLUSH:
                    yield emit(send([*map(np.concatenate, zip(*found)), length], n))
                    found, size = [], 0
        if found:
            yield emit(send([*map(np.concatenate, zip(*found)), length], n))

    return in_arrow(texts, run, BLOB)


def resolved(blobs: DataFrame, n: int, length: int, ask: bool) -> DataFrame:
    """Per bucket of codes: COVER blobs of all but the first place of each
    (code one, code two), and with ``ask`` ASK blobs of the first places of
    those that share code one but not code two. COVER blobs pass through."""
    rows = blobs.repartition("bucket", "kind").sortWithinPartitions("kind", "bucket")

    def bucket(held):
        key, text, one, two, start, more = gather(held)
        order = np.argsort(one)
        twice = np.zeros(len(one), bool)
        same = one[order][1:] == one[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        key, text, one, two, start, more = (c[twice] for c in (key, text, one, two, start, more))
        order, opens = first_of_each(one, two, key, text, start)
        gone, kept = order[~opens], order[opens]
        cover = merged(key[gone], text[gone], start[gone], start[gone] + more[gone] + length)
        yield from by_bucket(bucket_of(cover[0], cover[1], n), COVER, *cover)
        if ask and len(kept):
            at = run_starts(one[kept])
            many = np.repeat(np.diff(np.append(at, len(kept))), np.diff(np.append(at, len(kept)))) > 1
            kept = kept[many]
            yield from by_bucket(bucket_of(key[kept], text[kept], n), ASK, key[kept], text[kept], start[kept], more[kept])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for b, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind != PARSE:
                    yield emit([(b, kind, blob)])
                    continue
                if b != now and held:
                    yield emit(bucket(held))
                    held = []
                now = b
                held.append(blob)
        if held:
            yield emit(bucket(held))

    return in_arrow(rows, run, BLOB)


def beside(docs: DataFrame, blobs: DataFrame, n: int, fn, schema) -> DataFrame:
    """``fn(index, rows)`` over the rows of ``docs`` (doc_key, doc_hash, text,
    any others) that have been brought to the blobs of their documents.
    ``index``: (key, hash) to the slices of ``columns``; see _Held."""
    names = docs.columns
    bucket = F.pmod(F.col("doc_key").bitwiseXOR(F.col("doc_hash")), F.lit(n)).cast("int")
    row = F.struct(*[F.col(c) for c in names])
    left = docs.select(bucket.alias("bucket"), F.lit(TEXT).alias("kind"), F.lit(None).cast("binary").alias("blob"), row.alias("row"))
    right = blobs.select("bucket", "kind", "blob", F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    rows = left.unionByName(right).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches):
        now, held, index = None, [], None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            starts = run_starts(bucket, kind)
            for s, e in zip(starts, np.append(starts[1:], len(bucket))):
                if bucket[s] != now:
                    now, held, index = bucket[s], [], None
                part = batch.slice(s, e - s)
                if kind[s] != TEXT:
                    held += part.column("blob").to_pylist()
                    continue
                if index is None:
                    index, held = _Held(held), []
                yield from fn(index, pa.RecordBatch.from_struct_array(part.column("row")))

    return in_arrow(rows, run, schema)


class _Held:
    """Rows of blobs, found by document."""

    def __init__(self, blobs: list[bytes]):
        self.columns, self.at = [], {}
        if blobs:
            key, text, *rest = gather(blobs)
            order = np.lexsort((rest[0], text, key))
            key, text = key[order], text[order]
            self.columns = [c[order] for c in rest]
            starts = run_starts(key, text)
            self.at = dict(zip(zip(key[starts].tolist(), text[starts].tolist()), zip(starts.tolist(), np.append(starts[1:], len(key)).tolist())))

    def of(self, key: int, text: int) -> list[np.ndarray]:
        s, e = self.at.get((key, text), (0, 0))
        return [c[s:e] for c in self.columns] or [np.empty(0, np.int64)] * 2


def suffixes(texts: DataFrame, asked: DataFrame, n: int, length: int) -> DataFrame:
    """Blobs of the first ``length`` bytes of the suffixes asked for."""

    def run(index, rows):
        found, data, size = [], [], 0

        def windows():
            raw = np.concatenate(data)
            key, text, start, more, base = (np.array(c, np.int64) for c in zip(*found))
            of = np.repeat(np.arange(len(key)), more + 1)
            step = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            p = base[of] + step
            one = Rolling(raw).of(p, p + length).view(np.int64)
            two = (Second(raw).of(p, p + length) & np.uint64(0xFFFF)).view(np.int64)
            return emit(send([key[of], text[of], one, two, start[of] + step, np.zeros(len(of), np.int64), length], n))

        raw, at = utf8(rows.column("text"))
        keys, hashes = (rows.column(c).to_pylist() for c in ("doc_key", "doc_hash"))
        for i, (key, text) in enumerate(zip(keys, hashes)):
            for start, more in zip(*(c.tolist() for c in index.of(key, text))):
                part = raw[at[i] + start : at[i] + start + more + length]
                found.append((key, text, start, more, size))
                data.append(part)
                size += len(part)
                if size >= 4 * SEGMENT:
                    yield windows()
                    found, data, size = [], [], 0
        if found:
            yield windows()

    return beside(texts, asked, n, run, BLOB)


class Second(Rolling):
    """A hash independent of Rolling's, over scrambled bytes."""

    def __init__(self, raw: np.ndarray):
        super().__init__(SCRAMBLE[raw])


SCRAMBLE = np.argsort(mix64(BYTE ^ np.uint64(ODD))).astype(np.uint8)


def covers(texts: DataFrame, length: int, k: int) -> DataFrame:
    """COVER blobs of all bytes of ``texts`` (doc_key, doc_hash, text) that lie
    in a string of ``length`` bytes that also starts earlier."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = landed(resolved(parsed(texts, n, length, k), n, length, True), "phrases")
    second = resolved(suffixes(texts, first.filter(F.col("kind") == ASK), n, length), n, length, False)
    return first.filter(F.col("kind") == COVER).unionByName(second.filter(F.col("kind") == COVER))


def order_key(column: Column, kind: T.DataType) -> Column:
    """A key as a number: integers as they are, other types by their hash, NULL first."""
    number = column.cast("long") if isinstance(kind, T.IntegralType) else F.when(column.isNotNull(), F.xxhash64(column.cast("string")))
    return F.coalesce(number, F.lit(LOWEST))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        order_key(F.col(key), docs.schema[key].dataType).alias("doc_key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc_hash"),
        F.col(text).alias("text"),
    )


def _spans(index: _Held, key: int, text: int) -> tuple[np.ndarray, np.ndarray]:
    start, stop = index.of(key, text)
    none = np.zeros(len(start), np.int64)
    return merged(none, none, start, stop)[2:]


def _kept(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if not len(start):
        return raw
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return raw[np.cumsum(edge)[:-1] == 0]


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = TRIGGER) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, and the removed
    ``spans`` as pairs of byte offsets.

    Documents are ordered by key, NULL first, then by text hash; keys that are no
    integers are ordered by their hash; rows with
    equal key and text are one document and get equal results. NULL text is
    empty; a text shorter than ``length`` keeps all. Only key and text are read.
    """
    texts = keyed(docs, key, text)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    key_type = docs.schema[key].dataType
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("raw_text")).select(
        order_key(F.col("key"), key_type).alias("doc_key"),
        F.xxhash64(F.coalesce("raw_text", F.lit(""))).alias("doc_hash"),
        F.col("raw_text").alias("text"),
        "key",
    )
    schema = T.StructType(
        [T.StructField("key", key_type)]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)]
    )
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(index, rows):
        raw, at = utf8(rows.column("text"))
        out = [[] for _ in range(5)]
        for i, (k1, k2) in enumerate(zip(rows.column("doc_key").to_pylist(), rows.column("doc_hash").to_pylist())):
            own = raw[at[i] : at[i + 1]]
            start, stop = _spans(index, k1, k2)
            kept = _kept(own, start, stop)
            values = (len(own), len(own) - len(kept), len(start), hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())])
            for c, v in zip(out, values):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), arrow_span)
        yield pa.RecordBatch.from_arrays([rows.column("key"), *[pa.array(c, t) for c, t in zip(out, types)]], names=schema.names)

    return beside(named, covers(texts, length, k), n, run, schema).withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = TRIGGER) -> DataFrame:
    """``docs``, all columns as they are but ``text`` without its repeated
    bytes. Bytes of a character of which a part was removed go with it; NULL
    text stays NULL. Rules as in ``repeat_report``."""
    texts = keyed(docs, key, text)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, at_text = docs.columns, docs.columns.index(text)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    named = whole.select(
        order_key(F.col(f"whole.`{key}`"), docs.schema[key].dataType).alias("doc_key"),
        F.xxhash64(F.coalesce(F.col(f"whole.`{text}`"), F.lit(""))).alias("doc_hash"),
        "whole",
    )

    def run(index, rows):
        columns = rows.column("whole").flatten()
        raw, at = utf8(columns[at_text])
        null = columns[at_text].is_null().to_pylist()
        out = []
        for i, (k1, k2) in enumerate(zip(rows.column("doc_key").to_pylist(), rows.column("doc_hash").to_pylist())):
            kept = _kept(raw[at[i] : at[i + 1]], *_spans(index, k1, k2))
            out.append(None if null[i] else kept.tobytes().decode("utf-8", "ignore"))
        columns[at_text] = pa.array(out, columns[at_text].type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return beside(named, covers(texts, length, k), n, run, docs.schema)
