"""Near duplicates by BagMinHash signatures, bands and exact verification.

A text is the bag of its five-word shingles. Each shingle of weight ``w`` owns
Poisson processes over the dyadic intervals of ``(0, w]``; a point has a time,
a signature place and a weight, and counts if its weight lies below ``w``. A
signature place keeps its earliest time, so two bags agree there with the
probability of their weighted Jaccard similarity. Points are made in time
order and only until every place of a text is surely filled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, landed, mix64, utf8
from .components import components
from .shingles import bags, shingles, word_hashes

BANDS, ROWS = 25, 5  # a pair at 0.8 shares no band once in 20,000 pairs
BLOCK = 1024  # texts outside a group's main component compared at a time
SLICE = 1024  # texts of the group they are compared with in one task
HEAVY = 2000  # groups of at least a 2000th of all rows are joined where the rows are
TEXT_BYTES = 4 << 20  # texts hashed at a time


def slices(batch: pa.RecordBatch, column: str):
    """Stretches of rows that together hold about TEXT_BYTES of text."""
    _, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TEXT_BYTES, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bags(column: pa.Array, size: int):
    raw, at = utf8(column)
    words, doc = word_hashes(raw, at)
    return bags(*shingles(words, doc, len(column), size), len(column))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def bag_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Earliest times, ``n_docs`` by ``m``; rows of empty bags stay infinite."""
    total = np.bincount(doc, weight, n_docs)
    best = np.full(n_docs * m, np.inf)
    # Level 0 is the weight interval [0, 1), level j is [2^(j-1), 2^j).
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    of = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    span = np.maximum(low, 1.0)
    seed = mix64(element[of] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    owner, top = doc[of], weight[of]
    horizon = np.divide(np.log(m) + 3, total, out=np.zeros(n_docs), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        due = np.zeros(n_docs, bool)
        due[todo] = True
        live = np.flatnonzero(due[owner])
        time, step = np.zeros(len(live)), 0
        while len(live):
            x = mix64(seed[live] + np.uint64((2 * step + 1) * 0xA0761D6478BD642F % (1 << 64)))
            time = time - np.log(unit(x)) / (span[live] * m)
            within = time <= horizon[owner[live]]
            live, time, x = live[within], time[within], x[within]
            y = mix64(x ^ np.uint64(0x8EBC6AF09C88C6E3))
            place = ((y >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            at = low[live] + (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * span[live]
            hit = at < top[live]
            np.minimum.at(best, owner[live[hit]] * m + place[hit], time[hit])
            step += 1
        open_docs = np.isinf(best.reshape(n_docs, m)[todo]).any(axis=1)
        todo = todo[open_docs]
        horizon[todo] *= 2
    return best.reshape(n_docs, m)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.zeros((len(times), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key ^ bits[:, :, r])
    return key.view(np.int64)


def signature_bands(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(key, tid) per band of each text of ``texts`` (tid, text) with a word; a
    text that comes again in the same task is passed over."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                tid = batch.column("tid").to_pylist()
                new = np.array([not (t in seen or seen.add(t)) for t in tid], bool)
                batch = batch.filter(pa.array(new))
                element, weight, doc = text_bags(batch.column("text"), size)
                n = batch.num_rows
                full = np.flatnonzero(np.bincount(doc, minlength=n) > 0)
                keys = band_keys(bag_signatures(element, weight, doc, n, bands * rows)[full], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), batch.column("tid").take(pa.array(np.repeat(full, bands)))], names=["key", "tid"]
                )

    return in_arrow(texts, run, T.StructType([T.StructField("key", T.LongType()), T.StructField("tid", T.BinaryType())]))


def bag_features(texts: DataFrame, size: int) -> DataFrame:
    """(tid, bag) of the texts of ``texts``, see ``bag_bytes``."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                tid = batch.column("tid").to_pylist()
                new = np.array([not (t in seen or seen.add(t)) for t in tid], bool)
                batch = batch.filter(pa.array(new))
                element, weight, doc = text_bags(batch.column("text"), size)
                at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                data = [bag_bytes(element[s:e], weight[s:e]) for s, e in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(data, pa.binary())], names=["tid", "bag"])

    schema = T.StructType([T.StructField("tid", T.BinaryType()), T.StructField("bag", T.BinaryType())])
    return in_arrow(texts, run, schema)


def bag_bytes(element: np.ndarray, weight: np.ndarray) -> bytes:
    """Distinct shingle hashes, and place and count of those held more than once."""
    more = np.flatnonzero(weight > 1)
    return np.concatenate([np.array([len(element)], np.uint64), element, more.astype(np.uint64), weight[more].astype(np.uint64)]).tobytes()


def bag_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.uint64)
    n = int(flat[0])
    weight = np.ones(n, np.int64)
    more, count = flat[n + 1 :].reshape(2, -1)
    weight[more.astype(np.int64)] = count
    return flat[1 : n + 1], weight


def bag_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    (xa, wa), (xb, wb) = bag_of(a), bag_of(b)
    _, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = int(np.minimum(wa[i], wb[j]).sum())
    return both / (int(wa.sum()) + int(wb.sum()) - both)


def verified(pairs: DataFrame, features: DataFrame, salts: int = 64) -> DataFrame:
    """``pairs`` (tid, leader) plus ``sim``. The bag of a leader goes once to
    each of its salted groups, not along with every pair."""
    salt = F.pmod(F.xxhash64("tid"), F.lit(salts)).cast("int")
    members = pairs.join(features, "tid").select("leader", salt.alias("salt"), F.lit(1).alias("kind"), "tid", "bag")
    groups = pairs.select("leader", salt.alias("salt")).distinct()
    leaders = groups.join(features.withColumnRenamed("tid", "leader"), "leader").select(
        "leader", "salt", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("tid"), "bag"
    )
    rows = leaders.unionByName(members).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")

    def run(batches):
        own = None
        for batch in batches:
            tids, heads, sims = [], [], []
            for leader, kind, tid, bag in zip(*(batch.column(c).to_pylist() for c in ("leader", "kind", "tid", "bag"))):
                if kind == 0:
                    own = bag
                else:
                    tids.append(tid)
                    heads.append(leader)
                    sims.append(bag_similarity(own, bag))
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(heads, pa.binary()), pa.array(sims, pa.float64())], names=["tid", "leader", "sim"])

    schema = T.StructType([T.StructField("tid", T.BinaryType()), T.StructField("leader", T.BinaryType()), T.StructField("sim", T.DoubleType())])
    return in_arrow(rows, run, schema)


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (tid, comp) after joining the components that ``links`` tie."""
    ends = (
        links.select("tid", "leader")
        .join(labels, "tid")
        .select(F.col("leader").alias("tid"), F.col("comp").alias("a"))
        .join(labels, "tid")
        .select("a", F.col("comp").alias("b"))
    )
    new = components(ends).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return landed(labels.join(new, "comp", "left").select("tid", F.coalesce("to", "comp").alias("comp")), "labels")


class Block:
    """Bags side by side, compared with others all at once. An element of
    weight ``w`` is ``w`` units, so overlaps of bags are overlaps of sets."""

    def __init__(self, data: list[bytes]):
        own = [units(x) for x in data]
        self.sizes = np.array([len(u) for u in own])
        of = np.repeat(np.arange(len(own)), self.sizes)
        self.known, i, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        common = n > max(1, len(own) // 50)  # a matrix for these, lists for the rest
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), len(own)), np.float32)
        dense = common[i]
        self.matrix[self.column[i[dense]], of[dense]] = 1
        order = np.argsort(i[~dense], kind="stable")
        self.listed = of[~dense][order]
        self.first = np.searchsorted(i[~dense][order], np.arange(len(n) + 1))

    def similarities(self, data: list[bytes]) -> np.ndarray:
        """Weighted Jaccard similarities, the given bags by the block's."""
        own = [units(x) for x in data]
        sizes = np.array([len(u) for u in own])
        of, all_units = np.repeat(np.arange(len(own)), sizes), np.concatenate(own)
        i = np.minimum(np.searchsorted(self.known, all_units), len(self.known) - 1)
        hit = self.known[i] == all_units
        of, i = of[hit], i[hit]
        dense = self.column[i] >= 0
        rows = np.zeros((len(own), len(self.matrix)), np.float32)
        rows[of[dense], self.column[i[dense]]] = 1
        both = rows @ self.matrix
        of, i = of[~dense], i[~dense]
        count = self.first[i + 1] - self.first[i]
        at = np.repeat(self.first[i] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        np.add.at(both, (np.repeat(of, count), self.listed[at]), 1)
        return both / (sizes[:, None] + self.sizes[None, :] - both)


def units(data: bytes) -> np.ndarray:
    x, w = bag_of(data)
    of = np.repeat(np.arange(len(x)), w)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(w, dtype=np.int64) - w, w)
    return np.where(nth == 0, x[of], mix64(x[of] + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def joined_by_size(rows: DataFrame, table: DataFrame, on: str, size: str, wanted: Column) -> DataFrame:
    """``rows`` joined with the ``wanted`` rows of ``table``, which has one row a
    value of ``on`` and the number of ``rows`` that hold it.

    No more than HEAVY values can hold a HEAVY-th of all rows each, so these are
    broadcast, at most HEAVY narrow rows, and their rows stay where they are.
    The others are shuffled: none brings a task more than a HEAVY-th of all."""
    total = rows.count()
    heavy = F.col(size) * HEAVY >= total
    hot = rows.join(F.broadcast(table.filter(heavy & wanted)), on)
    rest = rows.join(F.broadcast(table.filter(heavy).select(on)), on, "left_anti")
    return hot.unionByName(rest.join(table.filter(~heavy & wanted), on))


def block_links(groups: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Links (tid, leader) that tie the components of each group.

    ``groups`` (leader, tid, comp). All texts outside a group's largest
    component are compared with all texts of the group, in blocks of about BLOCK
    of the former by slices of about SLICE of the latter, so a task's share is
    bounded whatever the group; it yields one link for two components at most.
    """
    groups = landed(groups, "placed")
    sizes = groups.groupBy("leader", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("leader").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("top"))
    laid = landed(largest, "sizes").withColumns(
        {"blocks": F.ceil((F.col("total") - F.col("top")) / BLOCK).cast("int"), "slices": F.ceil(F.col("total") / SLICE).cast("int")}
    )
    own = {"block": F.pmod(F.xxhash64("tid"), F.col("blocks")), "slice": F.pmod(F.hash("tid"), F.col("slices"))}
    mixed = joined_by_size(groups, laid, "leader", "total", F.col("top") < F.col("total"))
    placed = mixed.select(
        "leader", "tid", "comp", "main", "blocks", "slices", *[c.cast("int").alias(n) for n, c in own.items()]
    )
    full = landed(placed, "mixed").join(features, "tid")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = full.filter("comp <> main").select("leader", "block", each("slices").alias("slice"), F.lit(0).alias("kind"), "tid", "comp", "bag")
    others = full.select("leader", each("blocks").alias("block"), "slice", F.lit(1).alias("kind"), "tid", "comp", "bag")
    place = ["leader", "block", "slice"]
    rows = strays.unionByName(others).repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches):
        state = {"at": None, "held": [], "block": None, "tids": [], "comps": None, "done": set()}

        def links(tids, comps, bags):
            if state["block"] is None:
                state["block"] = Block([b for _, _, b in state["held"]])
                state["tids"] = [t for t, _, _ in state["held"]]
                state["comps"] = [c for _, c, _ in state["held"]]
                state["held"] = []
            for lo in range(0, len(bags), 256):
                sims = state["block"].similarities(bags[lo : lo + 256])
                for m, s in zip(*np.nonzero(sims >= threshold)):
                    pair = tuple(sorted((comps[lo + m], state["comps"][s])))
                    if pair[0] != pair[1] and pair not in state["done"]:
                        state["done"].add(pair)
                        yield tids[lo + m], state["tids"][s]

        for batch in batches:
            found = []
            at = list(zip(*(batch.column(c).to_pylist() for c in place)))
            kind = batch.column("kind").to_pylist()
            tid, comp, bag = (batch.column(c).to_pylist() for c in ("tid", "comp", "bag"))
            lo = 0
            while lo < len(kind):
                hi = lo + 1
                while hi < len(kind) and (at[hi], kind[hi]) == (at[lo], kind[lo]):
                    hi += 1
                if state["at"] != at[lo]:
                    state.update(at=at[lo], held=[], block=None, done=set())
                if kind[lo] == 0:
                    state["held"] += zip(tid[lo:hi], comp[lo:hi], bag[lo:hi])
                elif state["held"] or state["block"] is not None:
                    found += links(tid[lo:hi], comp[lo:hi], bag[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["tid", "leader"])

    return in_arrow(rows, run, T.StructType([T.StructField("tid", T.BinaryType()), T.StructField("leader", T.BinaryType())]))


def near_components(texts: DataFrame, reps: DataFrame, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """(tid, comp) of the texts of ``texts`` (key, tid, text) that share a band
    with another text. ``reps`` (tid, rep): the key of one row of each text.

    The leader of a bucket is its text with most companions over all bands, so
    the original among its edited copies. A group is what shares a bucket with
    one leader; it holds every two texts of such a bucket. Texts are compared
    with their leaders, then in each group that is not yet one component, those
    outside its largest one with all: no two texts of one bucket stay apart that
    are similar, and a group whose copies resemble the original costs one
    comparison for each.
    """
    bucketed = landed(signature_bands(texts.select("tid", "text"), size, bands, rows), "bands").distinct()
    shared = bucketed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    live = landed(bucketed.join(shared, "key"), "live")
    labels = landed(live.groupBy("tid").agg(F.sum("n").alias("company")).withColumn("comp", F.col("tid")), "labels")
    heads = live.join(labels, "tid").groupBy("key").agg(F.max_by("tid", F.struct("company", "tid")).alias("leader"))
    groups = landed(live.join(heads, "key").select("leader", "tid").distinct(), "groups")
    # One row of each text, found by its key, so that a text held by any number
    # of rows stays spread. A merge join at every size: texts are never broadcast.
    wanted = reps.join(labels, "tid", "left_semi").select(F.col("tid").alias("_tid"), F.col("rep").alias("_rep")).hint("merge")
    one = (texts["key"].eqNullSafe(F.col("_rep"))) & (texts["tid"] == F.col("_tid"))
    features = landed(bag_features(texts.join(wanted, one, "left_semi").select("tid", "text"), size), "bags")
    labels = labels.drop("company")
    tested = verified(groups.filter("tid <> leader"), features)
    labels = relabel(labels, landed(tested.filter(F.col("sim") >= threshold), "links"))
    placed = groups.join(labels, "tid").select("leader", "tid", "comp")
    return relabel(labels, landed(block_links(placed, features, threshold), "links"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``class_id``, the smallest key
    of its class.

    Classes are the connected components of "similarity of ``threshold`` or
    more", equal texts included. NULL text counts as empty; texts without a
    word have no shingles and are only joined by equality. A text below
    ``size`` words is one shingle. A NULL key is in a class like others but
    never its name unless all of the class are NULL. Only key and text are read.
    """
    tid = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    texts = docs.select(F.col(key).alias("key"), tid.alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = landed(texts.select("key", "tid"), "tids")
    reps = landed(named.groupBy("tid").agg(F.min("key").alias("rep")), "reps")
    labels = near_components(texts, reps, threshold, size, bands, rows)
    reps = landed(reps.join(labels, "tid", "left").select("tid", "rep", F.coalesce("comp", "tid").alias("comp")), "reps")
    classes = reps.groupBy("comp").agg(F.min("rep").alias("class_id"))
    by_text = landed(reps.join(classes, "comp").select("tid", "class_id"), "classes")
    return named.join(by_text, "tid").select(F.col("key").alias(key), "class_id")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Exactly one row of each class, all columns as they are: the one of least
    key, NULL last, then of least text hash; of rows equal in both any one.

    Rows are told apart by key and text, so rows that share a key, or have none,
    do not stand for each other."""
    tid = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))
    own = lambda d: F.struct(d[key].isNull().alias("none"), d[key].alias("key"), tid(d[text]).alias("tid"))
    named = docs.select(own(docs).alias("id"), docs[text].alias("text"))
    classes = near_duplicates(named, "id", "text", **how)
    stays = classes.filter(F.col("id") == F.col("class_id")).groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    stays = landed(stays.select("id.*", "_n"), "stays")
    same = docs[key].eqNullSafe(stays["key"]) & (tid(docs[text]) == stays["tid"])
    kept = docs.join(stays, same, "left_semi")
    if stays.filter("_n > 1").isEmpty():
        return kept
    # Repeated rows: one of each, combined before the shuffle.
    whole = F.struct(*[kept[c] for c in kept.columns])
    one = landed(kept.select(own(kept).alias("id"), whole.alias("row")), "kept").groupBy("id").agg(F.first("row").alias("row"))
    return one.select("row.*")
