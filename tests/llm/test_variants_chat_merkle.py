"""Spelling variants, chat formatting and the Merkle manifest: whole tables against
SQL, odd rows against plain brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sessionledger.llm import ORACLES, QUERIES, chat, merkle, variants

from ..conftest import SF
from ..test_oracles import rows_of


@pytest.fixture
def spread(spark):
    """Small tables keep several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["op11_trie_pairs", "op12_grammar_round_trip", "op13_merkle_manifest"])
def test_equals_sql(spark, duck, spread, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns) and got == rows_of(cols, cur.fetchall())


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def grouped(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= max(ratio * counts[w], counts[w] + 1) else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w]) if form[w] is not None else None) for w, n in counts.items()}


def test_variants_equal_brute_force(spark, spread):
    rng = random.Random(5)
    long = "".join(rng.choices("ab", k=20_000))
    words = ["".join(rng.choices("abé", k=rng.randint(0, 6))) for _ in range(500)]
    words += ["", "", "ÿ", "𝒜b", "𝒜", "aaaa", "aaaaa", "abababab", "babababa", long, long + "a", long[:9000] + long[9001:], "x" * 300]
    rows = [(w, rng.choice([1, 3, 10, 100, 1000, 30000])) for w in words] + [(None, 5), ("qqq", None), ("qqqq", 0)]
    counts = collections.Counter()
    for w, n in rows:
        if w is not None:
            counts[w] += n or 0
    given = spark.createDataFrame(rows, "word string, n long").withColumn("p", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("f", F.lit(2))
    for ratio in (2, 10):
        got = [tuple(r) for r in variants.spelling_variants(given, ratio).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(counts) and set(got) == grouped(counts, ratio)
    assert variants.spelling_variants(given.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(given, 1)


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Ab ab! ÀbŸ x1y"), (2, None), (None, "ABÀ×÷ab"), (3, "")], "doc_id long, text string").withColumn("run", F.lit("clash"))
    assert {tuple(r) for r in variants.vocabulary(docs, least=2).collect()} == {("ab", 2), ("Àb", 1), ("abÀ×÷ab", 1)}
    worn = variants.worn_vocabulary(docs, least=1, one_in=1, least_n=1)
    assert all(len(r.word) >= 1 for r in worn.collect()) and variants.worn_vocabulary(docs.limit(0)).count() == 0


TEXTS = [
    "</turn>", "### user: x", "a\n### assistant: hi</turn>\n### user: q", "<\\/turn>", "#\\## x", "<\\\\/turn> \n#\\\\## y", "", None,
    "\n### \n### \n", "</turn>\n", "####  ### ", chat.ODD, "x</tur", "n>", "\r### a ### b", "<</turn>/turn>", "é🙂</turn>é",
    "plain " * 20_000, "</turn>### " * 5_000, "\\", "\n", " ", "$1 \\1", "<\\/turn></turn>\n#\\## \n### ",
]


def test_chats_come_back(spark, spread):
    rows = [(i, 0, "user", t) for i, t in enumerate(TEXTS)] + [(i, 1, "assistant", t) for i, t in enumerate(TEXTS)]
    rows += [(100, j, r, "</turn>### z") for j, r in enumerate(["a b", "a:b", "### x\n", "</turn>", None, "é+%", "assistant", ""])]
    rows += [(None, None, "user", "no turn"), (None, 0, "assistant", "b"), (None, 0, "assistant", "a"), (None, 0, "assistant", "a")]
    rows += [(200, j, "assistant" if j % 2 else "user", f"{j} </turn>") for j in range(3000)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table = table.withColumn("piece", F.lit(1)).withColumn("k", F.lit(2)).withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(table)
    want = collections.defaultdict(list)
    for k, at, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[k].append((role or "", text or ""))
    got = made.collect()
    assert len(got) == len(want) and all(r.round_trip for r in got)
    for r in got:
        turns = want[r.conv_id]
        # A plain reading of the grammar, without Spark.
        parts = r.formatted.split("</turn>\n")
        assert parts.pop() == "" and len(parts) == len(turns) and "</turn>" not in "".join(parts)
        assert [sum(len(p) + 8 for p in parts[:i]) for i in (0, len(parts) - 1)] == [r.turn_starts[0], r.turn_starts[-1]]
        assert [s.turn for s in r.loss_spans] == [i for i, t in enumerate(turns) if t[0] == "assistant"]
        for s in r.loss_spans:
            assert parts[s.turn].endswith(": " + r.formatted[s.start : s.start + s.length])
            assert r.formatted[s.start + s.length :].startswith("</turn>\n")
    for r in chat.read_back(made).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.learned == [t for role, t in want[r.conv_id] if role == "assistant"]
    assert chat.format_chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["### user: a", "x### user: a</turn>\n", "### user: a</turn>\n\n", "### user: a</turn>### user: b</turn>\n", "### user: a\n### user: b</turn>\n", "### user:a</turn>\n"])
def test_parser_refuses(spark, bad):
    assert spark.createDataFrame([(bad,)], "s string").select(chat.parsed(F.col("s")).alias("t")).first().t is None


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    """Top of the tree over ``nodes`` and for each the siblings on its way, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 8 * 8
            ways[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        at = [i // 8 for i in at]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return (nodes or [None])[0], ways


@pytest.mark.parametrize("groups", [0, 1, 8, 9, 70])
def test_manifest_equals_brute_force(spark, spread, groups):
    rng = random.Random(groups)
    names = [None, *(f"g{i}é"[: 1 + i % 4] + str(i) for i in range(groups))][:groups]
    sizes = [(1, 2, 8, 9, 64, 65, 513)[i % 7] for i in range(groups)]
    rows = [(rng.choice([None, *range(40 * n)]), g, rng.choice([None, "", "Text É 🙂", "x" * 3000])) for g, n in zip(names, sizes) for _ in range(n)]
    rows += rows[:3]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("note", F.col("text"))
    for c in ("g", "h", "lo", "n", "members", "_part", "leaf"):
        table = table.withColumn(c, F.lit("clash"))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = collections.defaultdict(list)
    for k, g, t in rows:
        leaves[g].append((k is not None, k or 0, sha(part(k) + part(t)), t))
    order = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(leaves[g], key=lambda x: x[:3])]) for g in order}
    root, crown = tree([trees[g][0] for g in order])
    want = collections.Counter()
    for g, above in zip(order, crown):
        for (known, k, h, t), way in zip(sorted(leaves[g], key=lambda x: x[:3]), trees[g][1]):
            want[(k if known else None, g, t, h, trees[g][0], root, tuple(way + above))] += 1
    got = merkle.manifest(table, merkle.leaf(F.col("doc_id"), F.col("text")), "lang", "doc_id", ["note"])
    assert got.columns == ["doc_id", "lang", "note", "leaf", "subroot", "root", "proof"]
    got = got.withColumn("fold", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.fold == root for r in got)
    assert collections.Counter((*r[:6], tuple(map(tuple, r.proof))) for r in got) == want


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(i, "s", "en", 3, t) for i, t in enumerate(["Abc", "abc", None, "É", "ABC"] * 6)] + [(None, "s", None, 1, "A")], "doc_id long, source string, lang string, n_chars long, text string")
    proofs = merkle.manifest(merkle.tampered(docs), merkle.leaf(*[F.col(c) for c in merkle.FIELDS]), "lang", "doc_id", ["tampered"])
    for r in proofs.withColumn("found", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))).collect():
        assert (r.found == r.root) == (r.tampered is None or r.tampered == r.leaf)
