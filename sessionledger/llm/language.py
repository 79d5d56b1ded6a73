"""Language identification by interpolated Kneser-Ney character models.

One model per language over character 4-grams of lower-cased letters, with
runs of anything else as one blank. Counts are gathered from all labelled
texts. Log probabilities of all languages lie side by side in one array per
order, found by sorted 64-bit hashes of the n-grams; an n-gram that no
language knows goes down an order. The language of least mean cross-entropy
per character wins; its certainty is calibrated on all labelled texts.

No n-gram is left out. The n-grams of orders 4 and 3 are cut into blocks by the
two characters that stand before the last but one and before the last, which
are in every n-gram and context of these orders that a place looks up. A block
has a bounded number of cells; the documents are read once for each, and the
sums of log probabilities of a text are added up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, landed, mix64, run_starts

ORDER = 4
CELLS = 1 << 23  # n-grams times languages of one block of a model
HEATS = [2.0**k for k in np.arange(0, 9.1, 0.5)]  # tried for the certainty
GRID = 4096  # steps per unit of entropy in which texts are counted
SLICE = 2 << 20  # characters scored at a time
EDGE = 2  # stands before a text
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point itself if a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    points = [c for c in range(0x110000) if chr(c).isalpha()]
    table[points] = points
    table[EDGE] = EDGE
    return table


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 edges, and where each begins."""
    pad = chr(EDGE) * (ORDER - 1)
    parts = [pad + t.replace(chr(EDGE), " ").lower() + " " for t in texts]
    at = np.cumsum([0, *map(len, parts)])
    s = letter_table()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | ((s[:-1] != 32) & (s[:-1] != EDGE))
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def block_of(x, y, n_blocks: int):
    """Block of the characters before the last of an n-gram; of columns or arrays."""
    return (x * 1000003 + y * 2654435761) % n_blocks


def codes(columns) -> np.ndarray:
    """Hashes of n-grams given by their characters, first to last."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return h


def packed(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First two and last two characters of the n-gram ending at each place."""
    s = s.astype(np.int64)
    return s[at - 3] << 21 | s[at - 2], s[at - 1] << 21 | s[at]


def scored_places(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s != EDGE)


def text_slices(texts: list[str | None]):
    """Index ranges of about SLICE characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _sum_up(parts):
    hi, lo, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    at = run_starts(hi, lo)
    return hi[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, hi, lo, n) over all rows of ``labelled`` (lang, text)."""

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text or "")
            for lang, texts in by.items():
                for lo, hi in text_slices(texts):
                    s, _ = letters(texts[lo:hi])
                    places = scored_places(s)
                    first, last = packed(s, places)
                    key = mix64(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.astype(np.uint64))
                    _, i, n = np.unique(key, return_index=True, return_counts=True)
                    held.setdefault(lang, []).append((first[i], last[i], n))
                if len(held.get(lang, ())) >= 16:
                    held[lang] = [_sum_up(held[lang])]
        for lang, parts in held.items():
            hi, lo, n = _sum_up(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(hi), pa.array(lo), pa.array(n)], names=["lang", "hi", "lo", "n"])

    rows = in_arrow(labelled.select("lang", "text"), run, "lang string, hi long, lo long, n long")
    return rows.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


class OneLanguage:
    """Kneser-Ney tables of one language: per order sorted n-gram hashes with
    discounted shares, sorted context hashes with the weight of the order below.

    ``grams``: characters (four columns) and counts of one block; ``pairs``: the
    same of all of order 2, where a count is the number of distinct characters
    in front; ``discounts`` per order, over all blocks."""

    def __init__(self, grams: tuple, pairs: tuple, discounts: dict[int, float]):
        self.levels = {}
        for order in range(ORDER, 0, -1):
            if order in (ORDER, 2):
                chars, counts = grams if order == ORDER else pairs
            else:
                _, i, counts = np.unique(codes(chars[:, 1:].T), return_index=True, return_counts=True)
                chars = chars[i, 1:]
            d = discounts[order]
            context = codes(chars[:, :-1].T) if order > 1 else np.zeros(len(chars), np.uint64)
            sort = np.argsort(context, kind="stable")
            at = run_starts(context[sort])
            total = np.add.reduceat(counts[sort], at) if len(at) else counts[:0]
            kinds = np.diff(np.append(at, len(sort)))
            of = np.searchsorted(context[sort][at], context)
            share = (counts - d) / total[of]
            hashes = codes(chars.T)
            by = np.argsort(hashes)
            self.levels[order] = (hashes[by], share[by], context[sort][at], d * kinds / total)

    def prob(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probability of the last column after the others; ends at even
        chances over all code points."""
        order = len(columns)
        hashes, share, _, _ = self.levels[order]
        i, hit = look(hashes, codes(columns))
        p = np.zeros(len(hit))
        p[hit] = share[i[hit]]
        lower = self.prob(columns[1:]) if order > 1 else np.full(len(p), 1 / 0x110000)
        return p + self.weight(columns[:-1], order, len(p)) * lower

    def weight(self, columns: list[np.ndarray], order: int, n: int) -> np.ndarray:
        """Weight of the order below after ``n`` contexts; 1 after unknown ones."""
        _, _, contexts, rest = self.levels[order]
        i, hit = look(contexts, codes(columns) if order > 1 else np.zeros(n, np.uint64))
        out = np.ones(n)
        out[hit] = rest[i[hit]]
        return out


def look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


class Block:
    """All languages side by side: per order, n-gram hashes with a row of log
    probabilities, context hashes with a row of log weights."""

    def __init__(self, number: int, n_blocks: int, one: list[OneLanguage], grams: np.ndarray, pairs: np.ndarray):
        self.number, self.n_blocks, self.n_langs = number, n_blocks, len(one)
        self.tables = {}
        for order in range(ORDER, 0, -1):
            own = grams[:, ORDER - order :] if order > 2 else pairs[:, 2 - order :]
            key, i = np.unique(codes(own.T), return_index=True)
            columns = list(own[i].T)
            logs = np.log(np.stack([m.prob(columns) for m in one], 1)).astype(np.float32)
            ckey, j = np.zeros(1, np.uint64), np.zeros(1, np.int64)
            if order > 1:
                ckey, j = np.unique(codes(own[:, :-1].T), return_index=True)
            contexts = list(own[j][:, :-1].T) if order > 1 else []
            weights = np.log(np.stack([m.weight(contexts, order, len(ckey)) for m in one], 1)).astype(np.float32)
            self.tables[order] = (key, logs, ckey, weights)

    def logs(self, s: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability in each language of the symbols at ``at``."""
        if order == 0:
            return np.full((len(at), self.n_langs), -np.log(0x110000), np.float32)
        key, logs, ckey, weights = self.tables[order]
        i, hit = look(key, codes([s[at - k] for k in range(order - 1, -1, -1)]))
        out = np.zeros((len(at), self.n_langs), np.float32)
        out[hit] = logs[i[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = at[miss]
            j, known = look(ckey, codes([s[rest - k] for k in range(order - 1, 0, -1)]) if order > 1 else np.zeros(len(rest), np.uint64))
            weight = np.zeros((len(rest), self.n_langs), np.float32)
            weight[known] = weights[j[known]]
            out[miss] = weight + self.logs(s, rest, order - 1)
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of log probabilities of the block's places, text by language;
        number of places of all blocks; has the text a letter."""
        s, at = letters(texts)
        places = scored_places(s)
        bounds = np.searchsorted(places, at)
        n = np.diff(bounds)
        found = np.diff(np.concatenate([[0], np.cumsum(s[places] != 32)])[bounds]) > 0
        if self.n_blocks > 1:
            own = block_of(s[places - 2].astype(np.int64), s[places - 1].astype(np.int64), self.n_blocks) == self.number
            places = places[own]
            bounds = np.searchsorted(places, at)
        logs = self.logs(s, places)
        full = np.vstack([logs, np.zeros((1, logs.shape[1]), logs.dtype)]).astype(np.float64)
        sums = np.add.reduceat(full, np.minimum(bounds[:-1], len(logs)), axis=0)
        sums[np.diff(bounds) == 0] = 0
        return sums, n, found


class Model:
    """Languages, blocks as broadcast values, and the calibration."""

    def __init__(self, langs: list[str], blocks: list):
        self.langs, self.blocks = langs, blocks
        self.heat, self.ceiling = 1.0, np.full(len(langs), np.inf)

    def calibrate(self, rows: DataFrame) -> None:
        """The heat that makes the labels of ``rows`` (lang, _entropy) likeliest, and per language
        the entropy that 999 of 1000 of its texts stay below.

        Every row counts. The driver gets one sum per heat and two values per language; a
        language's texts are counted per step, whose number the entropy bounds."""
        langs = self.langs

        def run(batches):
            sums = np.zeros(len(HEATS))
            for batch in batches:
                if batch.num_rows:
                    entropy = batch.column("_entropy").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
                    true = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
                    above = entropy - entropy.min(1, keepdims=True)
                    own = above[np.arange(len(true)), true]
                    sums += [(np.log(np.exp(-heat * above).sum(1)) + heat * own).sum() for heat in HEATS]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(HEATS)), pa.int32()), pa.array(sums)], names=["heat", "loss"])

        losses = in_arrow(rows.select("lang", "_entropy"), run, "heat int, loss double").groupBy("heat").agg(F.sum("loss").alias("loss"))
        loss = {r.heat: r.loss for r in losses.collect()}
        self.heat = HEATS[min(loss, key=lambda i: (loss[i], i))] if any(loss.values()) else 1.0
        at = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
        own = rows.select("lang", F.element_at("_entropy", at).alias("own")).withColumn("step", F.floor(F.col("own") * GRID))
        # The quantile lies between two ranks: first the steps that hold them, then their values.
        every = Window.partitionBy("lang")
        ranked = lambda df, order, before: df.withColumn("low", before + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        steps = ranked(own.groupBy("lang", "step").agg(F.count("*").alias("n")), every.orderBy("step"), F.lit(0)).withColumn("of", F.sum("n").over(every))
        steps = steps.withColumn("rank", F.expr("(of - 1) * 999 div 1000"))
        holds = "low <= least(rank + 1, of - 1) AND low + n > rank"
        there = steps.filter(holds).select("lang", "step", "of", "rank", F.col("low").alias("before"))
        values = own.join(there, ["lang", "step"]).groupBy("lang", "step", "of", "rank", "before", "own").agg(F.count("*").alias("n"))
        found: dict[str, list] = {}
        for r in ranked(values, Window.partitionBy("lang", "step").orderBy("own"), F.col("before")).filter(holds).collect():
            found.setdefault(r.lang, []).append((r.own, r.of))
        for lang, ends in found.items():
            low, high = min(ends), max(ends)
            self.ceiling[langs.index(lang)] = float(np.quantile([low[0], high[0]], (low[1] - 1) * 999 % 1000 / 1000))


def discounts_of(counts: DataFrame) -> dict[str, float]:
    """Per language the discount of (lang, n): ones / (ones + 2 twos), in 0.1 to 0.9."""
    number = lambda k: F.count(F.when(F.col("n") == k, 1))
    rows = counts.groupBy("lang").agg(number(1).alias("ones"), number(2).alias("twos")).collect()
    return {r.lang: min(max(r.ones / max(r.ones + 2 * r.twos, 1), 0.1), 0.9) for r in rows}


def fitted(labelled: DataFrame, cells: int = CELLS) -> Model | None:
    """The model of ``labelled`` (lang, text; no NULL lang), calibrated on all of it; None without any."""
    model = learned(labelled, cells)
    if model is not None:
        model.calibrate(landed(with_entropy(labelled, model, "text", ["lang"]).filter("_known").select("lang", "_entropy"), "entropies"))
    return model


def learned(labelled: DataFrame, cells: int = CELLS) -> Model | None:
    """The model of ``labelled``, not calibrated.

    The driver holds one block at a time, of about ``cells`` cells, and the
    pairs of characters that occur, whose number the alphabet bounds.
    """
    spark = labelled.sparkSession
    low = (1 << 21) - 1
    split = {
        "w": F.shiftright("hi", 21), "x": F.col("hi").bitwiseAND(F.lit(low)),
        "y": F.shiftright("lo", 21), "z": F.col("lo").bitwiseAND(F.lit(low)),
    }
    counts = landed(gram_counts(labelled).select("lang", *[c.cast("long").alias(k) for k, c in split.items()], "n"), "grams")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # Below the top a count is the number of distinct characters in front.
    triples = counts.groupBy("lang", "x", "y", "z").agg(F.count("*").alias("n"))
    couples = landed(triples.groupBy("lang", "y", "z").agg(F.count("*").alias("n")), "couples")
    singles = couples.groupBy("lang", "z").agg(F.count("*").alias("n"))
    levels = {ORDER: counts, 3: triples, 2: couples, 1: singles}
    discounts = {order: discounts_of(rows) for order, rows in levels.items()}

    def by_lang(rows: DataFrame, columns: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        table = rows.toPandas()
        parts = (table[table["lang"] == lang] for lang in langs)
        return [(part[columns].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for part in parts]

    pairs = by_lang(couples, ["y", "z"])
    n_blocks = -(-sum(sizes.values()) * len(langs) // cells)
    blocks = []
    for number in range(n_blocks):
        own = counts.filter(block_of(F.col("x"), F.col("y"), n_blocks) == number)
        grams = by_lang(own, ["w", "x", "y", "z"])
        one = [OneLanguage(g, p, {o: d[lang] for o, d in discounts.items()}) for lang, g, p in zip(langs, grams, pairs)]
        both = (np.concatenate([chars for chars, _ in parts]) for parts in (grams, pairs))
        blocks.append(spark.sparkContext.broadcast(Block(number, n_blocks, one, *both)))
    return Model(langs, blocks)


def block_sums(docs: DataFrame, block, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_n``, ``_known`` and ``_sums`` by one block of ``_text``."""
    own = {"_n": T.LongType(), "_known": T.BooleanType(), "_sums": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, t) for c, t in own.items()]])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for lo, hi in text_slices(texts):
                sums, n, found = block.value.sums(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                made = [pa.array(n, pa.int64()), pa.array(found), pa.array(list(sums), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=schema.names)

    return in_arrow(docs.select(*keep, "_text"), run, schema)


def with_entropy(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_known`` and ``_entropy``, the mean cross-entropy per
    symbol in each language. With several blocks the sums of equal texts are
    added up by a hash of the text: sums and places grow alike."""
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    if len(model.blocks) == 1:
        rows = block_sums(narrow, model.blocks[0], keep)
    else:
        named = narrow.withColumn("_tid", F.md5(F.coalesce("_text", F.lit("")).cast("binary")))
        parts = [block_sums(named, block, ["_tid"]) for block in model.blocks]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sums = F.array(*[F.sum(F.col("_sums")[i]) for i in range(len(model.langs))])
        places = (F.sum("_n") / len(parts)).alias("_n")
        added = every.groupBy("_tid").agg(places, F.max("_known").alias("_known"), sums.alias("_sums"))
        rows = named.select(*keep, "_tid").join(added, "_tid")
    per_place = F.transform("_sums", lambda s: -s / F.greatest(F.col("_n"), F.lit(1)))
    return rows.select(*keep, "_known", per_place.alias("_entropy"))


def identified(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """``predicted`` by the model ``fitted`` to the documents where ``learn`` is true and lang is
    not NULL, with every text scored once for both."""
    known = learn & F.col("lang").isNotNull()
    model = learned(docs.filter(known).select("lang", F.col(text).alias("text")), cells)
    if model is None:
        return predicted(docs, None, key, text, keep)
    own = [key, *(keep or [])]
    label = F.when(known, F.col("lang")).alias("_label")
    rows = landed(with_entropy(docs.select("*", label), model, text, [*own, "_label"]), "entropies")
    model.calibrate(rows.filter("_known AND _label IS NOT NULL").select(F.col("_label").alias("lang"), "_entropy"))
    return judged(rows, model, own)


def predicted(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: key, columns ``keep``, lang_pred, score, rejected.

    ``lang_pred`` is ``und`` with score 0 where text is NULL, has no letter, or
    there is no model. ``rejected``: the text fits its language worse than 999
    of 1000 labelled ones, or its certainty is below one half.
    """
    out = [key, *(keep or [])]
    if model is None:
        nothing = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)}
        return docs.select(*out, *[c.alias(n) for n, c in nothing.items()])
    return judged(with_entropy(docs, model, text, out), model, out)


def judged(rows: DataFrame, model: Model, out: list[str]) -> DataFrame:
    """Columns ``out``, lang_pred, score and rejected of scored ``rows``."""
    rows = rows.withColumn("_least", F.array_min("_entropy"))
    rows = rows.withColumn("_at", F.array_position("_entropy", F.col("_least")).cast("int"))
    odds = F.transform("_entropy", lambda e: F.exp(-F.lit(float(model.heat)) * (e - F.col("_least"))))
    rows = rows.withColumn("_score", 1 / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    of_lang = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_at"))
    unfit = (F.col("_least") > of_lang(model.ceiling.tolist())) | (F.col("_score") < 0.5)
    return rows.select(
        *out,
        F.when(F.col("_known"), of_lang(model.langs)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_known"), F.col("_score")).otherwise(0.0).alias("score"),
        (unfit | ~F.col("_known")).alias("rejected"),
    )
