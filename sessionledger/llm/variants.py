"""Spelling variants: words one edit apart, found through pairs of trie nodes.

The words' prefixes are the nodes of a trie, their suffixes those of a trie of
the reversed words. Both tries are numbered over sorted words: a word shares
the nodes of the word before it as far as both agree and opens new ones behind.
A word is then a list of integer pairs (prefix node, suffix node):
one per place between characters, where prefix and suffix meet, and one per
character left out. A pair that one word has with a character left out and
another without is an insertion; one that two words have with a character left
out is a replacement. Numbers are exact, so nothing has to be checked again.

All rows of a pair are one string with any character put in at one
place, so a group has at most one row more than the alphabet has characters.
Counts and best neighbours are taken within it; no pairs of words are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC32_SQL, in_arrow, landed, run_starts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def runs(docs: DataFrame, text: str, letters: str, least: int, *keep: str) -> DataFrame:
    """Maximal runs of ``letters`` of at least ``least`` code points, A-Z lowered: (keep, run)."""
    low = F.translate(F.col(text), UPPER, LOWER)
    # Runs that are shorter match nowhere, longer ones match whole.
    found = F.regexp_extract_all(low, F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return docs.select(*[F.col(c) for c in keep], F.explode(found).alias("run"))


def vocabulary(docs: DataFrame, text: str = "text", letters: str = LETTERS, least: int = 1) -> DataFrame:
    """How often each run of letters occurs in ``docs``: (word, n)."""
    return runs(docs, text, letters, least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column and how many each row has."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_heads(flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code points that each word has in common with the one before it."""
    heads = np.zeros(len(size), np.int64)
    open_, depth = np.arange(1, len(size)), 0
    while len(open_):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[flat[off[open_] + depth] == flat[off[open_ - 1] + depth]]
        depth += 1
        heads[open_] = depth
    return heads


class Trie:
    """Numbers the trie nodes of words that come sorted, batch by batch, from 1.
    Only the last word and its nodes stay in memory between batches."""

    def __init__(self):
        self.last, self.nodes, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), 0

    def paths(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Per code point the node that ends there."""
        flat = np.concatenate([self.last, flat])
        size = np.concatenate([[len(self.last)], size])
        off = np.cumsum(size) - size
        heads = shared_heads(flat, off, size)
        depth = np.arange(len(flat)) - np.repeat(off, size)
        opened = depth >= np.repeat(heads, size)
        node = np.zeros(len(flat), np.int64)
        known = len(self.last)
        node[:known] = self.nodes
        fresh = np.flatnonzero(opened[known:]) + known
        node[fresh] = self.used + 1 + np.arange(len(fresh))
        self.used += len(fresh)
        # A node that is not opened here is the last one opened at its depth.
        order = np.argsort(depth, kind="stable")
        source = np.maximum.accumulate(np.where(opened[order], np.arange(len(order)), 0))
        node[order] = node[order][source]
        self.last, self.nodes = flat[off[-1] :], node[off[-1] :]
        return node[known:]


def trie_numbered(df: DataFrame, word: str, path: str, rank: str, name: str) -> DataFrame:
    """``df`` plus ``path`` (per code point of ``word`` its trie node, numbered over
    the whole table) and ``rank`` (the word's place in code-point order, from 0).

    Words are sorted over range partitions and each task numbers its own; one row
    per task (its first and last word and how many nodes it has) reaches the
    driver, which says where a task's numbers begin and which nodes of its
    first word the tasks before it have opened.
    """
    ranged = df.repartitionByRange(word).sortWithinPartitions(word)
    added = [T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_path", T.ArrayType(T.LongType()))]

    def local(batches):
        part, at, trie = TaskContext.get().partitionId(), 0, Trie()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat, size = code_points(batch.column(word))
            nodes = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pa.array(trie.paths(flat, size))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), nodes],
                names=[*batch.schema.names, "_part", "_at", "_path"],
            )
            at += n

    rows = landed(in_arrow(ranged, local, T.StructType([*df.schema, *added])), name)
    ends = (
        rows.groupBy("_part")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.max(F.array_max("_path")), F.lit(0)).alias("nodes"),
            F.min(word).alias("first"),
            F.max_by(F.struct(F.col(word).alias("word"), "_path"), "_at").alias("last"),
        )
        .orderBy("_part")
        .collect()
    )
    top = max((e._part for e in ends), default=-1) + 1
    node_base, row_base, n_shared = (np.zeros(top, np.int64) for _ in range(3))
    shared, last_word, last_path, used, seen = {}, "", [], 0, 0
    for e in ends:
        p = e._part
        node_base[p], row_base[p] = used, seen
        same = next((i for i, (a, b) in enumerate(zip(last_word, e.first)) if a != b), min(len(last_word), len(e.first)))
        n_shared[p], shared[p] = same, last_path[:same]
        last_word = e.last.word
        last_path = [last_path[x - 1] if x <= same else used + x for x in e.last._path]
        used, seen = used + e.nodes, seen + e.n
    shared_at = np.zeros(top, np.int64)
    flat_shared = [0]
    for p, nodes in shared.items():
        shared_at[p] = len(flat_shared)
        flat_shared += nodes
    flat_shared = np.array(flat_shared, np.int64)

    def whole(batches):
        for batch in batches:
            part = batch.column("_part").to_numpy()
            nodes = batch.column("_path")
            size = pc.list_value_length(nodes).to_numpy(zero_copy_only=False)
            ids, at = nodes.flatten().to_numpy(), np.repeat(part, size)
            old = ids <= n_shared[at]
            ids = np.where(old, flat_shared[np.where(old, shared_at[at] + ids - 1, 0)], node_base[at] + ids)
            path_column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], path_column, pa.array(row_base[part] + batch.column("_at").to_numpy())],
                names=[*names, path, rank],
            )

    names = df.columns
    out = T.StructType([*df.schema, T.StructField(path, T.ArrayType(T.LongType())), T.StructField(rank, T.LongType())])
    return in_arrow(rows, whole, out)


PAIR = "p long, s long, id long, n long, kind byte"
MEETS, LEFT_OUT, LEFT_OUT_ONCE = 0, 1, 2


def node_pairs(batches):
    """Of every word its pairs of nodes: where prefix and suffix meet, and with each
    character left out. Of a run of equal characters only the first is
    left out ``ONCE``: leaving out another gives the same word."""
    for batch in batches:
        flat, size = code_points(batch.column("word"))
        ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
        head, tail = (batch.column(c).flatten().to_numpy() for c in ("f", "r"))
        # One place more than there are characters; node 0 is the empty string.
        wide = size + 1
        begin, off = np.cumsum(wide) - wide, np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), wide)
        place = np.arange(len(row)) - begin[row]
        prefix, suffix = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        some = place > 0
        prefix[some] = head[(off[row] + place - 1)[some]]
        some = place < size[row]
        suffix[some] = tail[(off[row] + size[row] - place - 1)[some]]
        cut = np.flatnonzero(some)
        char = np.arange(len(flat))
        once = np.ones(len(flat), bool)
        once[1:] = (flat[1:] != flat[:-1]) | (char[1:] == np.repeat(off, size)[1:])
        kind = np.concatenate([np.full(len(row), MEETS), np.where(once, LEFT_OUT_ONCE, LEFT_OUT)]).astype(np.int8)
        who = np.concatenate([row, row[cut]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([prefix, prefix[cut]])),
                pa.array(np.concatenate([suffix, suffix[cut + 1]])),
                pa.array(ids[who]),
                pa.array(n[who]),
                pa.array(kind),
            ],
            names=["p", "s", "id", "n", "kind"],
        )


NEAR = "id long, n_near long, best_n long, best_id long"


def near_words(batches):
    """Of each row of pairs sorted by pair: how many words its word meets there
    and the one of largest ``n``, then least ``id``."""

    def done(p, s, ids, n, kind):
        starts = run_starts(p, s)
        if not len(starts):
            return None
        sizes = np.diff(np.append(starts, len(p)))
        many = np.repeat(sizes > 1, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)[many]
        ids, n, kind = ids[many], n[many], kind[many]
        g = len(starts)
        none = np.int64(-1)

        def best(mask, nth):
            """Per group the row of ``mask`` that is ``nth`` by n and id, or -1."""
            rows = np.flatnonzero(mask)
            rows = rows[np.lexsort((ids[rows], -n[rows], group[rows]))]
            out = np.full(g, none)
            first = run_starts(group[rows])
            at = first + nth
            ok = at < np.append(first[1:], len(rows))
            out[group[rows[at[ok]]]] = rows[at[ok]]
            return out

        out_any, out_once, meets = kind != MEETS, kind == LEFT_OUT_ONCE, kind == MEETS
        any1, any2, once1, whole = best(out_any, 0), best(out_any, 1), best(out_once, 0), best(meets, 0)
        n_any, n_once = np.bincount(group[out_any], minlength=g), np.bincount(group[out_once], minlength=g)
        row = np.arange(len(ids))
        other = np.where(any1[group] == row, any2[group], any1[group])
        one = np.where(meets, once1[group], other)
        two = np.where(out_once, whole[group], none)
        count = np.where(meets, n_once[group], n_any[group] - 1) + (two >= 0)
        if not len(ids):
            return None
        a, b = (np.where(x >= 0, n[x], none) for x in (one, two))
        pick = np.where((b > a) | ((b == a) & (ids[two] < ids[one])), two, one)
        has = count > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[has]), pa.array(count[has]), pa.array(n[pick[has]]), pa.array(ids[pick[has]])],
            names=["id", "n_near", "best_n", "best_id"],
        )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "s", "id", "n", "kind")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        # The last pair may go on in the next batch.
        end = run_starts(now[0], now[1])[-1]
        held = [x[end:] for x in now]
        if (out := done(*[x[:end] for x in now])) is not None:
            yield out
    if held is not None and (out := done(*held)) is not None:
        yield out


def spelling_variants(words: DataFrame, ratio: int = 10, word: str = "word", n: str = "n") -> DataFrame:
    """Groups spelling variants of a vocabulary: one row per distinct word with
    word, form, root (string), n, n_near, form_n (long).

    Two words are near if one inserted, deleted or replaced code point makes
    one the other. ``form`` is the near word of largest ``n`` (ties: the least in
    code-point order) if that is above and at least ``ratio`` times the word's own;
    ``root`` is where the chain of forms ends. ``ratio`` must be above 1, so
    chains have no circles and grow with the logarithm of the largest count.

    A word given twice counts the sum of its rows, a NULL ``n`` counts 0, a NULL
    word is none, the empty word is one like others. Words may be of any length. An
    empty table gives an empty one. Other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    given = (
        words.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n"))
        .filter("word is not null")
        .groupBy("word")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    heads = trie_numbered(landed(given, "words"), "word", "f", "id", "heads")
    both = trie_numbered(heads.withColumn("_back", F.reverse("word")), "_back", "r", "_rank", "tails")
    ranked = landed(both.select("word", "n", "id", "f", "r"), "tries")
    pairs = in_arrow(ranked, node_pairs, PAIR).repartition("p", "s").sortWithinPartitions("p", "s")
    near = (
        in_arrow(pairs, near_words, NEAR)
        .groupBy("id")
        .agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("at"))).alias("best"))
    )
    own = landed(
        ranked.select("word", "n", "id")
        .join(near, "id", "left")
        .select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when((F.col("best.best_n") >= ratio * F.col("n")) & (F.col("best.best_n") > F.col("n")), F.struct((-F.col("best.at")).alias("id"), F.col("best.best_n").alias("n"))).alias("form"),
        ),
        "forms",
    )
    chain = own.filter("form is not null").select("id", F.col("form.id").alias("to"))
    while True:
        # Each word's end so far takes over that word's own end: chains halve.
        ends = chain.select(F.col("id").alias("to"), F.col("to").alias("further"))
        longer = landed(chain.join(ends, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.isnotnull("further").alias("moved")), "chain")
        if longer.filter("moved").isEmpty():
            break
        chain = longer.select("id", "to")
    name = lambda c: own.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    return (
        own.select("id", "word", "n", "n_near", F.col("form.id").alias("form_id"), F.col("form.n").alias("form_n"))
        .join(chain.select("id", F.col("to").alias("root_id")), "id", "left")
        .join(name("form"), "form_id", "left")
        .join(name("root"), "root_id", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def worn_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 31, least: int = 7, least_n: int = 2) -> DataFrame:
    """The vocabulary of ``docs`` with slips put in: of every ``one_in``-th (document,
    run), by crc32, one code point is left out. Then words of at least
    ``least`` code points that occur ``least_n`` times: (word, n). A NULL key
    is the empty string, a NULL text has no words."""
    found = runs(docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(text).alias("_text")), "_text", LETTERS, least, "_key")
    hit = F.crc32(F.concat_ws(":", "_key", "run").cast("binary"))
    cut = F.pmod(hit, F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    word = F.when(F.pmod(hit, F.lit(one_in)) == 0, slip).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


ORACLE = f"""
with found as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) as run from documents),
counted as (select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h
  from found where length(run) >= 7 group by doc_id, run),
hit as (select run, n, {CRC32_SQL.format(hex="h")} as c from counted),
worn as (select case when c % 31 = 0 then left(run, (c % length(run))::bigint) || substr(run, (c % length(run))::bigint + 2) else run end as word, n
  from hit),
words as (select word, sum(n)::bigint as n from worn where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cuts as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from places),
near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
own as (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near,
    case when b.other_n >= 10 * w.n then b.other end as form, case when b.other_n >= 10 * w.n then b.other_n end as form_n
  from words w left join best b using (word)),
ends as (
  with recursive walk as (
    select word, word as place, 0 as step from own
    union all
    select k.word, o.form, k.step + 1 from walk k join own o on o.word = k.place where o.form is not null)
  select word, arg_max(place, step) as root from walk group by word)
select word, form, root, n, n_near, form_n from own join ends using (word)"""
