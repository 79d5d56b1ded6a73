"""Benchmark decontamination: word-pair seeds, then Smith-Waterman.

The words of all documents are searched for the word pairs of the test items:
two words in order, next to each other or with one word between them. Every pair
a document shares with an item is a seed, so its rarest one is, and how often
copies repeat it elsewhere does not matter. Around its seeds, a document's
passage is aligned with the item word by word, so copies with changed, added or
lost words score too.

No alignment that reaches the threshold is left out. Between two matches that
follow each other, an alignment pays for the longer of the two stretches it
skips. Where it pays at most 1, both sides hold the two words as a seed pair; where
it pays more, the second match gains nothing. So a score of S has at least
(S - MATCH) / MATCH seeds, and items that share fewer are not aligned, nor
those whose shared words prove the score out of reach.

Items come to the tasks in blocks of bounded size, so a benchmark of any size
is searched, one pass over the documents for each block.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow

WORD = re.compile(r"\w+")
LEAST = 3  # words of the shortest item that is searched, and of what an alignment's score must be worth
REACH = (1, 2)  # how far apart the words of a seed pair may be
BLOCK_WORDS = 1_000_000  # words of test items sent to the tasks at a time
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
ENOUGH = 25  # words whose full match scores 1 also in a longer item
THRESHOLD = 0.5


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Block(NamedTuple):
    items: list[int]
    texts: list[np.ndarray]  # word numbers, from 1
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted n-gram codes
    base: int

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the block's word pairs, ascending, and their numbers."""
        at = [np.flatnonzero((numbers[:-d] > 0) & (numbers[d:] > 0)) for d in REACH]
        code = np.concatenate([numbers[a] * self.base + numbers[a + d] for a, d in zip(at, REACH)])
        at = np.concatenate(at)
        i = np.searchsorted(self.codes, code)
        hit = np.flatnonzero(self.codes[np.minimum(i, len(self.codes) - 1)] == code)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return at[hit], i[hit]


def blocks(benchmark: DataFrame, item: str, text: str):
    """Blocks of items in the order read. Items below LEAST words are too short
    to tell and match nothing."""
    items, texts, vocabulary, size = [], [], {}, 0

    def block():
        base = len(vocabulary) + 1
        codes = np.concatenate([t[:-d] * base + t[d:] for t in texts for d in REACH])
        return Block(items, texts, vocabulary, np.unique(codes), base)

    for key, value in benchmark.select(item, text).toLocalIterator():
        found = words(value)
        if len(found) < LEAST:
            continue
        items.append(key)
        texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64))
        size += len(found)
        if size >= BLOCK_WORDS:
            yield block()
            items, texts, vocabulary, size = [], [], {}, 0
    if items:
        yield block()


class Postings(NamedTuple):
    """Where the block's word pairs lie: the items of pair g are
    ``item[start[g] : start[g + 1]]``, each once, with how often each has it
    (``times``); those of item i, with their first and last place in it, ``own[i]``."""

    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def postings(block: Block) -> Postings:
    own, times = [], []
    for text in block.texts:
        at, gram = block.grams(text)
        known, first, n = np.unique(gram, return_index=True, return_counts=True)
        times.append(n)
        last = len(gram) - 1 - np.unique(gram[::-1], return_index=True)[1]
        own.append((known, at[first], at[last]))
    gram = np.concatenate([x[0] for x in own])
    item = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
    order = np.argsort(gram, kind="stable")
    start = np.searchsorted(gram[order], np.arange(len(block.codes) + 1))
    return Postings(start, item[order], np.concatenate(times)[order], own)


def most(held: np.ndarray) -> float:
    """No alignment scores more, if ``held`` tells which words of the item the
    passage holds: within it each such word matches at best, each other costs."""
    total = np.cumsum(np.where(held, MATCH, max(MISMATCH, GAP)))
    return float((total - np.minimum.accumulate(np.append(0, total[:-1]))).max())


def align(item: np.ndarray, passage: np.ndarray, need: float = 0.0) -> tuple[float, int]:
    """Best local alignment score, and the end of it in ``passage``. Any score
    below ``need`` may be told too low: the search ends where the item's words
    still to come, as far as the passage holds them, cannot reach it."""
    held = np.isin(item, passage)
    rest = (MATCH * (held.sum() - np.cumsum(held))).tolist()
    steps = np.arange(len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for w, more in zip(item.tolist(), rest):
        new = np.zeros(len(passage) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps
        top = int(new.argmax())
        if new[top] > best:
            best, end = float(new[top]), top
        if max(best, float(new[top]) + more) < need:
            break
        row = new
    return best, end


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document row and item found in it: key, item, score from
    ``threshold`` to 1, and ``end_word``, where the passage ends.

    Score: the alignment's against a full match of the item, or of ENOUGH words
    of a longer one. What is worth less than three matched words is no copy,
    however short the item. NULL and empty texts hold nothing; without items nothing is
    found. Repeated documents and items are reported each; keys and items are of
    any plain type. Items below three words are not searched. Other columns are
    not read.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    key_type, item_type = narrow.schema["key"].dataType, items.schema["item"].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("item", item_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
    found = None
    for block in blocks(items, "item", "text"):
        part = in_arrow(narrow, _search(block, threshold, schema), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"key": key, "item": item})


def _search(block: Block, threshold: float, schema: T.StructType):
    full = [MATCH * min(len(t), ENOUGH) for t in block.texts]
    need = [max(threshold * f, LEAST * MATCH) for f in full]
    seeds = np.array([max(1, math.ceil((n - MATCH) / MATCH)) for n in need])
    item_type = to_arrow_type(schema["item"].dataType)

    def passages(numbers: np.ndarray, where: Postings, holds: np.ndarray):
        """(item number, [first word, last word] around seeds, near ones joined)."""
        at, gram = block.grams(numbers)
        if not len(at):
            return
        shared = np.unique(gram)
        sizes = where.start[shared + 1] - where.start[shared]
        place = np.repeat(where.start[shared] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        items = np.flatnonzero(np.bincount(where.item[place], where.times[place], len(seeds)) >= seeds)
        holds[numbers] = True
        holds[0] = False
        items = [i for i in items.tolist() if most(holds[block.texts[i]]) >= need[i]]
        holds[numbers] = False
        for i in items:
            known, first, last = where.own[i]
            k = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            seed = known[k] == gram
            p, k, size = at[seed], k[seed], len(block.texts[i])
            lo, hi = p - last[k] - size // 2, p - first[k] + size + size // 2
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            cut = np.flatnonzero(lo[1:] > hi[:-1])
            begin, end = np.append(0, cut + 1), np.append(cut, len(hi) - 1)
            enough = end - begin + 1 >= seeds[i]
            yield i, zip(lo[begin[enough]].tolist(), hi[end[enough]].tolist())

    def run(batches):
        where, holds = postings(block), np.zeros(block.base, bool)
        for batch in batches:
            rows, items, scores, ends = [], [], [], []
            for r, value in enumerate(batch.column(1)):
                numbers = block.numbers(value.as_py())
                for i, spans in passages(numbers, where, holds):
                    best = (0.0, 0)
                    for lo, hi in spans:
                        lo = max(lo, 0)
                        passage = numbers[lo:hi]
                        if most(np.isin(block.texts[i], passage)) < need[i]:
                            continue
                        score, end = align(block.texts[i], passage, need[i])
                        best = max(best, (score, lo + end))
                    if best[0] >= need[i]:
                        rows.append(r)
                        items.append(block.items[i])
                        scores.append(min(best[0] / full[i], 1.0))
                        ends.append(best[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())],
                names=schema.names,
            )

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has no leak.

    Each row is judged by its own text, whatever its key: rows without a key, or
    that share one, do not drop each other. NULL and empty texts stay."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    narrow = docs.select(digest(docs[text]).alias("digest"), docs[text].alias("text"))
    gone = leaks(narrow, benchmark, "digest", "text", **how).select(F.col("digest").alias("_gone")).distinct()
    return docs.join(gone, digest(docs[text]) == gone["_gone"], "left_anti")
