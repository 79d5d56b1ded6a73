"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing
column names: each has the result its docstring states."""

import hashlib
import random

import public_tokenizers
import pytest

from sessionledger.llm import articles, bagminhash, decontaminate, language, materialise, packing, parsing, quality, ring, urls
from sessionledger.llm.common import shared_folder

TOK = public_tokenizers.path("byte_bpe_50k.json")
SENTENCE = "The quick brown fox number {} jumps over the lazy dog while {} cats watch quietly from an old garden wall. "
RNG = random.Random(4)
LONG = " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(7000)) + " " + SENTENCE.format(3, 21)
SCHEMA = "doc_id long, text string, lang string, kept string, rank int, bucket string, tid string, _part int"


def rows():
    base = [(1, LONG), (2, None), (3, ""), (None, "a short text without a key"), (5, LONG), (5, LONG), (6, " \n\t "), (7, "x" * 30_000), (8, "one"), (None, None)]
    return [(k, t, "en" if t and len(t) > 9 else None, "k", 1, "b", "t", 0) for k, t in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    got = quality.quality_report(docs, "doc_id").collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_words == by[3].n_words == by[6].n_words == 0 and not by[2].kept and by[1].kept
    assert [r.doc_id for r in quality.keep_quality(docs).collect()] == [1, 5, 5]
    assert quality.keep_quality(docs).columns == docs.columns
    assert quality.quality_report(none, "doc_id").count() == 0 and quality.keep_quality(none).count() == 0


def test_near_duplicates(docs, none):
    got = bagminhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    assert {r.class_id for r in got if r.doc_id in (1, 5)} == {1}
    assert {r.class_id for r in got if r.doc_id in (2, 3)} == {2}
    kept = sorted(str(r.doc_id) for r in bagminhash.one_per_class(docs).collect())
    assert kept == sorted(["1", "2", "None", "6", "7", "8"])  # the second NULL key has the empty text of 2
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.one_per_class(none).count() == 0


def test_one_row_per_class(spark):
    """Rows without a key, rows given more than once and one key with two texts."""
    a, b = SENTENCE.format(1, 2), " ".join(LONG.split()[:40])
    rows = [(None, a, 1), (None, a, 2), (4, b, 3), (4, b, 4), (4, "other words of the same key here", 5), (3, "other words of the same key here", 6), (9, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    got = bagminhash.one_per_class(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert kept == sorted([("None", a), ("4", b), ("3", "other words of the same key here"), ("9", None)])


def test_parsing(docs, none):
    got = parsing.repeat_report(docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows())
    assert by[1].n_removed == 0 and by[5].n_removed == by[5].n_bytes == len(LONG) and by[5].n_spans == 1
    assert by[7].n_removed == 30_000 - 100 and by[7].spans[0].start == 1 or by[7].n_removed == 30_000 - 1
    assert by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    told = [r for r in parsing.repeat_report(named).collect() if r.doc_id in ("1", "5")]
    assert sorted(r.n_removed for r in told) == [0, len(LONG), len(LONG)] or sorted(r.n_removed for r in told) == [0, 0, len(LONG)]
    assert parsing.without_repeats(named).count() == len(rows())
    left = parsing.without_repeats(docs)
    assert left.columns == docs.columns and {r.text for r in left.collect() if r.doc_id == 2} == {None}
    assert parsing.repeat_report(none).count() == 0 and parsing.without_repeats(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, TOK).collect()
    assert sum(r.length for r in got if r.doc_id in (2, 3)) == 2
    assert packing.pack_documents(none, TOK).count() == 0


def test_materialise(spark, docs, none):
    index = materialise.materialise(docs, shared_folder(spark, "t"), TOK, length=64, per_shard=4).collect()
    assert {r.slot for r in index} == set(range(max(r.slot for r in index) + 1))
    assert materialise.materialise(none, shared_folder(spark, "t"), TOK).count() == 0


def test_ring(docs, none):
    got = ring.shard_rows(docs.select("doc_id", "tid"), "doc_id", 4).collect()
    counts = [sum(r.shard == s for r in got) for s in range(4)]
    assert len(got) == len(rows()) and max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    clash = docs.withColumnsRenamed({"lang": "_at", "kept": "_arc", "bucket": "_pos"}).selectExpr("*", "1 AS _n", "2 AS _base", "3 AS _tie", "4 AS home", "5 AS `a.b`")
    placed = ring.shard_rows(clash, "doc_id", 4)
    assert placed.columns == [c for c in clash.columns if c != "home"] + ["home", "shard", "slot"]
    again = placed.collect()
    assert {(r._n, r._base, r._tie, r["a.b"], r.rank) for r in again} == {(1, 2, 3, 5, 1)}
    assert sorted((str(r.doc_id), r.home) for r in again) == sorted((str(r.doc_id), r.home) for r in got)
    assert ring.shard_rows(none.select("doc_id"), "doc_id", 4).count() == 0


def test_language(docs, none):
    model = language.fitted(docs.filter("lang is not null").select("lang", "text"))
    got = language.predicted(docs, model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 6)} == {"und"} and {r.lang_pred for r in got if r.doc_id == 1} == {"en"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language.fitted(none.select("lang", "text")) is None
    assert language.predicted(none, model).count() == 0
    assert {r.lang_pred for r in language.predicted(docs, None).collect()} == {"und"}


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, SENTENCE.format(3, 21))], "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 4), (5, 4)}
    assert sorted(str(r.doc_id) for r in decontaminate.without_leaks(docs, items).collect()) == sorted(["2", "3", "None", "6", "7", "8", "None"])
    named = decontaminate.leaks(docs, items.selectExpr("concat('i', item_id) AS item_id", "text")).collect()
    assert {(r.doc_id, r.item_id) for r in named} == {(1, "i4"), (5, "i4")}
    # A leak without a key, or under a shared one, takes no other row with it.
    more = docs.unionByName(docs.filter("doc_id = 1").withColumn("doc_id", docs.doc_id * 0 + 8)).unionByName(docs.filter("doc_id = 1").selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:]))
    assert sorted(str(r.doc_id) for r in decontaminate.without_leaks(more, items).collect()) == sorted(["2", "3", "None", "6", "7", "8", "None"])
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no mark"), (4, "http://A.Example.NET/en/x?q"), (4, "http://A.Example.NET/en/x?q"), (5, "http://example.com"), (6, "http://x.net/?a#b"), (7, "s://fr.org/fr/" + "a" * 5000), (None, "http://casino-x.org/")],
        "page_id long, url string",
    ).withColumn("token", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    rules = [*(urls.place_rule(*r) for r in urls.PLACE_RULES), *map(urls.pattern_rule, urls.PATTERNS)]
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {
        (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "a.example.net", "example.net/en/", "allow"),
        (5, "example.com", None, "allow"), (6, "x.net", "net/", "block"), (7, "fr.org", "org/fr/", "allow"), (None, "casino-x.org", None, "block"),
    }
    assert urls.judge_urls(pages, rules).count() == 9 and urls.judge_urls(pages.limit(0), rules).count() == 0


def test_articles(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav>"
        "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>One <b>bold\n  word<br><p>Two&nbsp;x<script>var a='<p>no</p>'</script>"
        "<form>f</form><div id=comments><p>nice</div></article><aside>side</aside><footer>&copy; f</footer></body></html>"
    )
    site = [(i, f"http://h.org/{i}", f"<body><div>Own text {i} of it</div><div><p>Same box</p></div></body>") for i in range(10, 40)]
    pages = spark.createDataFrame([(1, "http://a.org/1", page), (2, None, None), (3, "x", ""), (4, "http://a.org/4", "<p>open <b>text"), *site], "page_id long, url string, html string")
    got = {r.page_id: r for r in articles.main_text(pages).collect()}
    assert got[1].text == "Head & line\nOne bold word\nTwo x" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "open text"
    assert got[12].text == "Own text 12 of it"
    assert articles.main_text(pages.limit(0)).count() == 0


def test_articles_of_layouts_and_small_hosts(spark):
    """No menu is on half of the large host's pages; the small one has five pages."""
    body = "<body><div><p>Menu {0} a<p>Menu {0} b</div><div><p>Own {1} text {2}</p></div><div><p>Notice {0}</div></body>"
    rows = [(i, f"http://big.org/{i}", body.format(i % 3, "big", i)) for i in range(60)]
    rows += [(i, f"http://huge.org/{i}", body.format(i % 60, "huge", i)) for i in range(1000, 7600)]
    rows += [(i, f"http://tiny.org/{i}", body.format(9, "tiny", i)) for i in range(8000, 8005)]
    # Two pages are no template, nor copies of one; nor are few of a larger host.
    rows += [(i, f"http://two.org/{i}", body.format(8, "two", i)) for i in (8100, 8101)]
    rows += [(i, f"http://copy.org/{i}", body.format(7, "copy", 0)) for i in range(8200, 8230)]
    rows += [(i, f"http://some.org/{i}", f"<body><div><p>Own some text {i}</div>{'<div><p>Quote</div>' * (i < 8305)}</body>") for i in range(8300, 8330)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in articles.main_text(pages).collect()}
    assert len(got) == len(rows)
    for name, ids in (("big", range(60)), ("huge", range(1000, 7600)), ("tiny", range(8000, 8005))):
        assert all(got[i] == f"Own {name} text {i}" for i in ids)
    assert got[8100] == "Menu 8 a\nMenu 8 b\nOwn two text 8100\nNotice 8"
    assert all(got[i] == "Menu 7 a\nMenu 7 b\nOwn copy text 0\nNotice 7" for i in range(8200, 8230))
    assert got[8304] == "Own some text 8304\nQuote" and got[8305] == "Own some text 8305"
