"""Quality rules as a short-circuit cascade.

A sample gives each rule's CPU cost and how often it rejects. Rules then run
in falling order of rejections per cost, each only on what the earlier ones
kept. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: str) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def lines(text: str) -> list[str]:
    """Lines with a word."""
    return [x for x in text.split("\n") if x.strip(BLANKS)]


def dup_lines(text: str) -> int:
    full = lines(text)
    return len(full) - len(set(full))


def repeat_words(found: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(found) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    n = len(ids)
    if n < 1 << 21:
        key = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:
        pair = np.unique(a[:-1] * n + a[1:], return_inverse=True)[1]
        key = pair[:-1] * n + a[2:]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    cover = np.zeros(len(a), bool)
    cover[:-2] |= often
    cover[1:-1] |= often
    cover[2:] |= often
    return int(cover.sum())


class Doc:
    """A text whose measures are computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.got: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.got:
            self.got[name] = MEASURES[name](self)
        return self.got[name]


MEASURES: dict[str, Callable[[Doc], object]] = {
    "words": lambda d: words(d.text),
    "n_words": lambda d: len(d["words"]),
    "word_chars": lambda d: word_chars(d.text),
    "n_symbols": lambda d: symbols(d.text),
    "n_lines": lambda d: len(lines(d.text)),
    "n_dup_lines": lambda d: dup_lines(d.text),
    "n_repeat_words": lambda d: repeat_words(d["words"]),
    "n_shouted": lambda d: sum(1 for w in d.text.split() if len(w) > 1 and w.isupper()),
}


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Doc], bool]


BASE = [
    Rule("few_words", lambda d: d["n_words"] < 50),
    Rule("repeated_words", lambda d: 100 * d["n_repeat_words"] > 50 * d["n_words"]),
]

RULES = [
    *BASE,
    Rule("word_length", lambda d: not 2 * d["n_words"] <= d["word_chars"] <= 15 * d["n_words"]),
    Rule("symbols", lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule("repeated_lines", lambda d: 2 * d["n_dup_lines"] > d["n_lines"]),
    Rule("shouting", lambda d: 10 * d["n_shouted"] > 3 * d["n_words"]),
]


def measured_order(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 2000, seed: int = 5) -> list[int]:
    """Rule numbers by falling rejections per CPU second on about
    ``sample_rows`` random rows (the bound of the sample; rule order only).
    Ties, as on an empty table, keep the given order."""
    total = docs.count()
    sample = docs.select(F.col(text).alias("text"))
    if total > sample_rows:
        sample = sample.sample(sample_rows / total, seed=seed)

    def probe(batches):
        spent, hits = [0] * len(rules), [0] * len(rules)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for i, rule in enumerate(rules):
                    doc = Doc(value)  # a fresh one: each rule pays its own cost
                    start = time.thread_time_ns()
                    hits[i] += bool(rule.rejects(doc))
                    spent[i] += time.thread_time_ns() - start
        yield pa.RecordBatch.from_pydict({"i": range(len(rules)), "ns": spent, "hits": hits}, schema=pa.schema([("i", pa.int64()), ("ns", pa.int64()), ("hits", pa.int64())]))

    rows = in_arrow(sample, probe, "i long, ns long, hits long").groupBy("i").agg(F.sum("ns"), F.sum("hits")).collect()
    gain = {i: hits / max(ns, 1) for i, ns, hits in rows}
    return sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0), i))


def rejected_by(docs: list[Doc], rules: list[Rule], order: list[int]) -> np.ndarray:
    """Per document the rule that rejects it first, -1 if none does."""
    verdict = np.full(len(docs), -1)
    left = list(range(len(docs)))
    for i in order:
        out = [j for j in left if rules[i].rejects(docs[j])]
        verdict[out] = i
        left = [j for j in left if verdict[j] < 0]
    return verdict


def keep_quality(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no rule rejects.

    NULL text counts as empty and, having fewer than 50 words, goes. Rows are
    judged one by one, so repeated rows share their fate.
    """
    rules = rules or RULES
    order = measured_order(docs, rules, text)
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            verdict = rejected_by([Doc(t) for t in batch.column(at).to_pylist()], rules, order)
            yield batch.filter(pa.array(verdict < 0))

    return in_arrow(docs, keep, docs.schema)


def quality_report(docs: DataFrame, key: str, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Per row: ``key``, the measures of METRICS, ``base_failed`` (a rule of
    BASE rejects) and ``kept`` (no rule rejects). NULL text has no words."""
    rules = rules or RULES
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = measured_order(docs, rules, text)
    schema = T.StructType(
        [T.StructField("key", narrow.schema["key"].dataType)]
        + [T.StructField(m, T.LongType()) for m in METRICS]
        + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    )

    def report(batches):
        for batch in batches:
            found = [Doc(t) for t in batch.column(1).to_pylist()]
            verdict = rejected_by(found, rules, order)
            columns = [pa.array([d[m] for d in found], pa.int64()) for m in METRICS]
            failed = [any(r.rejects(d) for r in BASE) for d in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(failed, pa.bool_()), pc.equal(pa.array(verdict), -1)],
                names=["key", *METRICS, "base_failed", "kept"],
            )

    return in_arrow(narrow, report, schema).withColumnRenamed("key", key)
