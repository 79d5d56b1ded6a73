"""Best-fit packing of documents into sequences by bin completion.

Pieces of one length are interchangeable, so the search works on counts per
length, at most ``limit`` numbers, and its plan says which ranks of a length go
to which sequences. Text and tokens never move between tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, landed, numbered
from .tokens import token_ids

LIMIT = 2048
STEPS = 32


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Martello and Toth's bound: for any cut, pieces above ``limit - cut``
    stand alone, those above half share with none of their kind, and the small
    ones fill what is left. At least the total over the limit."""
    best = -(-sum(n * c for n, c in counts.items()) // limit)
    for cut in sorted({0, *[n for n in counts if 2 * n <= limit]}):
        big = sum(c for n, c in counts.items() if n > limit - cut)
        mid = [(n, c) for n, c in counts.items() if limit // 2 < n <= limit - cut]
        small = sum(n * c for n, c in counts.items() if cut <= n <= limit // 2)
        n_mid = sum(c for _, c in mid)
        gap = n_mid * limit - sum(n * c for n, c in mid)
        best = max(best, big + n_mid + max(0, -(-(small - gap) // limit)))
    return best


def fillings(room: int, counts: dict[int, int], width: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first, at most ``width``.

    One piece that fits exactly dominates all others, and a filling is closed
    only when nothing more fits, since one with a further piece dominates it.
    Of any number of pieces: each of the 8 ``width`` largest lengths begins up
    to ``width`` that differ in their last pieces, looked for in STEPS steps
    each after the greedy one, and one whose second piece takes half the rest."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    if not lengths:
        return [()]
    if lengths[0] == room:
        return [(room,)]
    down = -np.array(lengths)
    found: set[tuple[int, ...]] = set()

    def first(rest: int) -> int:
        """Place of the largest length that fits."""
        return int(np.searchsorted(down, -rest))

    def begun(chosen: list[tuple[int, int]], rest: int, at: int, most: int):
        """Fillings that go on with pieces from place ``at``, the greedy one
        first: of each length as many as fit, then ever fewer."""
        # One frame per length: its pieces so far, the room left, the next place.
        stack, n_found, after = [(chosen, rest, at)], 0, None
        while stack and n_found < most and after != 0:
            chosen, rest, at = stack.pop()
            after = after and after - 1
            at = max(at, first(rest))
            if at == len(lengths):
                after = STEPS * most if after is None else after
                taken: dict[int, int] = {}
                for n, k in chosen:
                    taken[n] = taken.get(n, 0) + k
                if all(counts[n] <= taken.get(n, 0) for n in lengths[first(rest) :]):
                    filling = tuple(sorted((n for n, k in chosen for _ in range(k)), reverse=True))
                    n_found += 1
                    found.add(filling)
                    if not rest:
                        return
                continue
            n = lengths[at]
            free = counts[n] - sum(k for m, k in chosen if m == n)
            for k in range(max(min(rest // n, free), 0) + 1):
                stack.append(([*chosen, (n, k)] if k else chosen, rest - n * k, at + 1))

    for at, n in enumerate(lengths[: 8 * width]):
        begun([(n, 1)], room - n, at, width)
        for half in {first((room - n) // 2)} - {at, len(lengths)}:
            begun([(n, 1), (lengths[half], 1)], room - n - lengths[half], 0, 1)
    ranked = sorted(found, key=lambda s: (room - sum(s), len(s), [-x for x in s]))
    return ranked[:width]


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill bin after bin, the largest piece first, then always the largest
    that still fits; equal bins are closed together."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    asc = sorted(left)
    while asc:
        room, one = limit, {}
        for n in reversed(asc):
            take = min(room // n, left[n])
            if take:
                one[n] = take
                room -= take * n
            if not room:
                break
        times = min(left[n] // k for n, k in one.items())
        for n, k in one.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        asc = sorted(left)
        plan.append((tuple(n for n, k in one.items() for _ in range(k)), times))
    return plan


def n_bins(plan) -> int:
    return sum(t for _, t in plan)


def complete_bins(
    counts: dict[int, int], limit: int, width: int = 6, nodes: int = 3000
) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, covering ``counts`` exactly.

    Branch and bound: around the largest piece left, try its undominated
    fillings; a branch ends when the room wasted so far already rules out
    fewer bins than the incumbent has, which at first is the best-fit packing.
    The search stops at the lower bound, or after ``nodes`` fillings with the
    best packing found. A filling is applied as often as the counts allow.
    """
    best = best_fit(counts, limit)
    bound = lower_bound(counts, limit)
    total = sum(n * c for n, c in counts.items())
    tried = 0
    # One frame per open choice: counts before it, fillings not yet tried.
    left = {n: c for n, c in counts.items() if c}
    path: list[tuple[tuple[int, ...], int]] = []
    waste, used = 0, 0
    stack: list[tuple[dict, list, int, int, int]] = []

    def open_node():
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        stack.append((dict(left), [(largest, *f) for f in fillings(limit - largest, rest, width)], waste, used, len(path)))

    if left and n_bins(best) > bound:
        open_node()
    while stack and n_bins(best) > bound and tried < nodes:
        before, options, waste0, used0, depth = stack[-1]
        if not options:
            stack.pop()
            continue
        tried += 1
        pattern = options.pop(0)
        left, waste, used = dict(before), waste0, used0
        del path[depth:]
        need = {n: pattern.count(n) for n in pattern}
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        path.append((pattern, times))
        used += times
        waste += times * (limit - sum(pattern))
        if not left:
            if used < n_bins(best):
                best = list(path)
            continue
        # Bins in the end are at least what all pieces and the waste so far need.
        if max(-(-(total + waste) // limit), used + -(-sum(n * c for n, c in left.items()) // limit)) >= n_bins(best):
            continue
        open_node()
    return best


def pieces_of(docs: DataFrame, key: str, text: str, tokenizer: str, end: int, limit: int) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", narrow.schema["key"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def cut(batches):
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = token_ids(tokenizer, value.as_py(), end)
                first = len(ids) % limit or limit  # a full cut, the rest in front
                at = 0
                for p, stop in enumerate(range(first, len(ids) + 1, limit)):
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["key", "piece", "start", "length", "ids_crc32"],
            )

    return in_arrow(narrow, cut, schema)


def pack_pieces(pieces: DataFrame, length: str = "length", limit: int = LIMIT, order: list[str] | None = None) -> DataFrame:
    """``pieces`` (narrow, landed) plus ``sequence_id`` and ``offset``.

    Lengths must be 1 to ``limit``. Equal pieces are interchangeable; an empty
    table gives an empty result. The driver sees one count per length.
    """
    ranked = numbered(pieces, length, order or [], "pieces")
    counts = {int(n): int(c) for n, c in ranked.groupBy(length).agg(F.max("rank") + 1).collect()}
    out = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not counts:
        return pieces.sparkSession.createDataFrame([], out)
    # Per length: from which rank on, first sequence, pieces a sequence, offset.
    rules: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    done = dict.fromkeys(counts, 0)
    base = 0
    for pattern, times in complete_bins(counts, limit):
        at = 0
        for n in dict.fromkeys(pattern):
            k = pattern.count(n)
            rules[n].append((done[n], base, k, at))
            done[n] += k * times
            at += k * n
        base += times
    flat = [(n, *r) for n in sorted(rules) for r in rules[n]]
    lens, ranks, bases, ks, offs = (np.array(c, np.int64) for c in zip(*flat))
    # One sorted key for (length, rank): ranks are below the largest count.
    big = max(counts.values()) + 1
    keys = lens * big + ranks
    names = pieces.columns

    def place(batches):
        for batch in batches:
            n = batch.column(length).to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, n * big + rank, "right") - 1
            rest = rank - ranks[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(bases[i] + rest // ks[i], pa.int64()),
                    pa.array(offs[i] + rest % ks[i] * n, pa.int64()),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return in_arrow(ranked, place, out)


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0, limit: int = LIMIT
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end``; NULL text is just ``end``, a NULL
    key stays NULL. Only a longer one is cut, into full pieces from its end, the
    first piece taking the rest. Repeated rows are packed each on its own;
    other columns are not read.
    """
    pieces = landed(pieces_of(docs, key, text, tokenizer, end, limit), "cut")
    return pack_pieces(pieces, "length", limit, ["key", "piece", "ids_crc32"]).withColumnRenamed("key", key)
