"""Main text of pages: markup cases that lost text, templates against plain counts."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sessionledger.llm import articles as ar

STORY = "A story of some length that goes on for a while. " * 4


def texts(page):
    return [w for w, _ in ar.page_blocks(page)]


def test_quotes_open_values_only():
    assert texts("<p title=it's>One</p><p>Two it's</p><p>Three") == ["One", "Two it's", "Three"]
    assert texts("""<p title="a>b">One</p><p title='c>"d'>Two</p><p title="open>Three</p><p>Four""") == ["One", "Two", "Three", "Four"]
    assert texts("""<div data-class="ad" title="class=ad id='menu'">One</div><div CLASS = 'ad box'>No</div><div id=menu>No</div>""") == ["One"]
    assert texts("<div hidden>No</div><div data-hidden=1>One</div><div style='color:red; display : none'>No</div><p aria-hidden='true'>No") == ["One"]


def test_a_teaser_does_not_hide_the_story():
    beside = f"<body><article><h2>Teaser</h2><p>Short</article><div><p>{STORY}</p></div></body>"
    assert texts(beside) == ["Teaser", "Short", STORY.strip()]
    # Links and captions beside an article are no prose, however many.
    links = "".join(f"<li><a href=/{i}>Some other headline {i}</a>" for i in range(40))
    assert texts(f"<body><ul>{links}</ul><article><p>{STORY}</article></body>") == [STORY.strip()]
    assert texts(f"<main><h1>Title</h1><article>Teaser</article><p>{STORY}</p></main><div>out</div>") == ["Title", "Teaser", STORY.strip()]


def test_ordinary_words_in_names_of_an_article():
    def kept(name, inside=True):
        page = f"<p>One</p><div class='{name}'>Part</div>"
        return "Part" in texts(f"<article>{page}</article>" if inside else page)

    assert all(kept(n) for n in ("share-price-note", "menu-of-the-day", "notice-period", "related-work-section", "promo2-case", "lead"))
    assert not any(kept(n) for n in ("share-buttons", "social", "related-posts", "widget_area box", "skip-to-content", "comments-2", "x ad-slot", "cookie-bar"))
    assert not any(kept(n, False) for n in ("share-price-note", "menu", "site-header"))


def plain(rows):
    """Templates by counting the contents that hold each subtree, in memory."""
    pages = {(k, u): (u.split("/")[2] if u else "", ar.page_blocks(h or "")) for k, u, h in rows}
    contents, holds = defaultdict(set), defaultdict(set)
    for host, blocks in pages.values():
        content = tuple(w for w, _ in blocks)
        if blocks:
            contents[host].add(content)
        for _, trees in blocks:
            for t in trees:
                holds[host, t].add(content)

    def template(host, tree):
        n, all_of = len(holds[host, tree]), len(contents[host])
        rules = [(ar.MIN_PAGES, ar.MIN_SHARE), (ar.MANY, ar.MANY_SHARE), (ar.MASS, ar.MASS_SHARE)]
        return any(n >= least and n >= share * all_of for least, share in rules)

    return Counter(
        (k, u, "\n".join(w for w, trees in pages[k, u][1] if not any(template(pages[k, u][0], t) for t in trees))) for k, u, _ in rows
    )


def test_templates_equal_plain_counts(spark):
    """Hosts of 1 to 700 pages, menus of their own, copies, repeated and NULL rows, a very long page."""
    rng, rows = random.Random(4), []
    sizes = [1, 2, 3, 7, 40, 150, 700]
    for h, size in enumerate(sizes):
        menus = [f"<div><p>Menu {h} {m}<p>About us {h}</div>" for m in range(rng.choice([1, 3, 9]))]
        for i in range(size):
            own = "".join(f"<p>Own words {rng.randrange(3 * size)} of host {h}</p>" for _ in range(rng.randrange(4)))
            quote = "<blockquote><p>Quote</blockquote>" if rng.random() < 0.015 else ""
            rows.append((len(rows), f"http://h{h}.org/{i}", f"<body>{rng.choice(menus)}<section>{own}{quote}</section><div>Notice {h}</div></body>"))
    rows += rows[:5] + rows[60:75] + [(None, None, None), (None, None, ""), (None, "http://h4.org/null", rows[50][2])]
    rows.append((10_000, "http://h5.org/long", "<body>" + "".join(f"<p>Long text {i}</p>" for i in range(20_000)) + "</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumns({n: F.lit(1) for n in ("key", "host", "content", "blocks", "tree", "template", "n", "pages", "text")})
    got = Counter((r.page_id, r.url, r.text) for r in ar.main_text(clash).collect())
    assert got == plain(rows)
    bare = {r.page_id: "\n".join(texts(r.html or "")) for r in pages.collect()}
    assert sum(t != bare[k] for k, _, t in got) > 800
