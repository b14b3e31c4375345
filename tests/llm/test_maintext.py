"""Main text: parsing goldens, the given pages, and pages of other make."""

import html
import random
import re
import time

import numpy as np
import pytest

from mailweave.llm.blocks import Paths, blocks_of
from mailweave.llm.maintext import main_text, op1_main_text, train_labeller

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return train_labeller(spark.read.parquet(f"{SF}/pages.parquet"))


def blocks(page):
    return [(b.tags[-1][0] if b.tags else "", b.text) for b in blocks_of(page, Paths(), with_tags=True)]


def test_blocks():
    assert blocks("<p>a<b>b</b> c<br>d<p>e &amp; f&nbsp;g") == [("p", "ab c d"), ("p", "e & f g")]
    assert blocks("<ul><li>a<li>b</ul>x<td>y") == [("li", "a"), ("li", "b"), ("", "x"), ("td", "y")]
    assert blocks("<script>var a='<p>no</p>';</script><style>p{}</style>t<!-- <p>no</p> -->u") == [("", "tu")]
    assert blocks("a < b &lt;c&gt; <3") == [("", "a < b <c> <3")]
    assert blocks("<div title='a>b' data=\"x'>\">in</div></p></div>out") == [("div", "in"), ("", "out")]
    assert blocks("text<p class='cut") == [("", "text")]
    assert blocks("<p>a</p><!--><p>b</p><!-- x --><p>c</p><!---><p>d</p>") == [("p", x) for x in "abcd"]
    assert blocks("<script>never closed <p>x") == [] == blocks("") == blocks(None)
    assert [b.linked for b in blocks_of("<li><a href=x>four</a></li><p>none", Paths())] == [4, 0]


def test_dropped_elements_end_where_they_end():
    assert blocks('<p>a <svg class="i"/> b</p><p>c</p>') == [("p", "a b"), ("p", "c")]
    assert blocks("<title-card>x</title-card><object-list>y</object-list><style-guide>z</style-guide>") == [("title-card", "x"), ("object-list", "y"), ("style-guide", "z")]
    for tag in ("svg", "object", "template"):
        assert blocks(f"<p>a<{tag} x=1><g>no</g><{tag}>no</{tag}>no</{tag}>b</p>c</{tag}>d") == [("p", "ab"), ("", "cd")]
    assert blocks("<div><svg><path d='M0'></div><p>in") == [("p", "in")]
    assert blocks("<svg><text>no</text><p>in</p>") == [("p", "in")]
    assert blocks("<svg><foreignObject><p>no</p></foreignObject><desc/>no</svg>in") == [("", "in")]
    assert blocks("<object><p>no</p><svg/>no</object>in<title>no</title>") == [("", "in")]
    began = time.process_time()
    for page in ("<svg>" * 30_000 + "</object>" * 30_000, "<object><svg>" * 20_000 + "</object>" * 20_000, "<svg><p>" * 20_000):
        blocks(page)
    assert time.process_time() - began < 10


def test_long_pages_are_linear():
    began = time.process_time()
    for page in ("<p>x" * 30_000, "<div>" * 30_000, "<a \"" * 30_000, "</p>" * 50_000, "<" * 100_000, "<!--" * 30_000, "<b>x" * 50_000, "<li><ul>" * 15_000, "<a b='" * 30_000):
        blocks_of(page, Paths())
    assert time.process_time() - began < 20


def expected(page):
    """The article of a given page, by its markup."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    inner = re.sub(r"<(?:br|/?p|/?h1)>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_given_pages(spark):
    rows = {r.page_id: r for r in op1_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    wrong = [p.page_id for p in pages if rows[p.page_id].text != expected(p.html)]
    assert len(wrong) <= len(pages) // 100
    assert all(rows[p.page_id].url == p.url and rows[p.page_id].n_chars == len(rows[p.page_id].text) for p in pages)


def other_pages(texts):
    rng = random.Random(7)
    for i in range(60):
        good = [" ".join(rng.choice(texts).split()[:60]) for _ in range(rng.randint(3, 8))]
        side = [" ".join(rng.choice(texts).split()[:14]) for _ in range(8)]
        body = f"<h1>{good[0][:60]}</h1>" + "".join(f"<p>{html.escape(g)}</p>" for g in good[1:])
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<main><article class="post">{}</article></main>', '<div id="content"><section>{}</section></div>'])
        menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">{s.split()[0]}</a></li>' for k, s in enumerate(side)) + "</ul></nav>"
        page = (
            f'<html><head><title>t</title></head><body><header class="site-header"><p>{side[0]}</p></header>{menu}<div class="cookie-notice"><p>{side[1]}</p></div>'
            + box.format(body)
            + f'<aside class="sidebar"><h3>{side[2]}</h3><p>{side[3]}</p></aside><div class="advert">{side[4]}</div><form class="newsletter"><label>{side[5]}</label></form>'
            + f'<section class="comments"><div class="comment"><p>{side[6]}</p></div></section><footer><p>{side[7]}</p></footer></body></html>'
        )
        yield i, page, " ".join([good[0][:60].strip(), *good[1:]])


def test_pages_of_other_make(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect() if len(r.text.split()) > 60]
    pages = list(other_pages(texts))
    rows = {r.page_id: r.text for r in main_text(spark.createDataFrame([(i, "u", p) for i, p, _ in pages], "page_id long, url string, html string"), model).collect()}
    right = sum(rows[i] == " ".join(want.split()) for i, _, want in pages)
    assert right >= 54, right


def test_pages_that_name_no_article(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect() if len(r.text.split()) > 60]
    pages = [(i, "u", re.sub("<(/?)(?:article|main)", r'<\1div', p), want) for i, p, want in other_pages(texts)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    model = train_labeller(df)
    assert model is not None
    rows = {r.page_id: r.text for r in main_text(df, model).collect()}
    menus = sum(html.unescape(re.search(r"<footer><p>(.*?)</p>", p)[1]) in rows[i] for i, _, p, _ in pages)
    held = sum(len(set(want.split()) & set(rows[i].split())) > 0.8 * len(set(want.split())) for i, _, _, want in pages)
    assert menus <= 6 and held >= 54, (menus, held)


def test_pages_that_name_their_article_come_first(spark):
    from mailweave.llm import maintext

    named = [(i, f"<main><p>Article {i} has a few words.</p></main><nav>menu</nav>") for i in range(3)]
    df = spark.createDataFrame(named + [(i, f"<p>page {i} of few words</p>") for i in range(3, 900)], "page_id long, html string")
    rows = maintext._sample(df, 1)
    assert [r.names_it for r in rows] == [True] * 3 + [False] * (maintext.SAMPLE_PAGES - 3)


def test_large_pages_are_learned_from(spark):
    """Pages of over 100 kB, most of it comments and one long list, and many pages without any text."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect() if len(r.text.split()) > 60]
    pages = [(i, "u", p.replace("<body>", "<body><!--" + "x" * 150_000 + "-->"), want) for i, p, want in other_pages(texts)]
    df = spark.createDataFrame([p[:3] for p in pages] + [(i, "u", "<p></p>") for i in range(100, 2500)], "page_id long, url string, html string")
    model = train_labeller(df)
    rows = {r.page_id: r.text for r in main_text(df, model).collect()}
    assert sum(rows[i] == " ".join(want.split()) for i, _, _, want in pages) >= 50
    assert all(rows[i] == "" for i in range(100, 2500))


def test_some_page_with_text_is_always_found(spark):
    from mailweave.llm import maintext

    blank = [(i, "<article></article>") for i in range(600)]
    df = spark.createDataFrame([*blank, (1000, "<p>one page has words</p>")], "page_id long, html string")
    assert [b.text for r in maintext._sample(df, 1) for b in r.blocks] == ["one page has words"]
    assert train_labeller(df) is not None


def test_a_long_page_is_not_padded_to(model):
    import tracemalloc

    rng = np.random.default_rng(1)
    inputs = [rng.normal(size=(n, 8 * model.h)).astype(np.float32) for n in (20_000, *[5] * 63)]
    alone = [model.predict([x])[0] for x in inputs]
    tracemalloc.start()
    together = model.predict(inputs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(alone, together))


def test_odd_rows(spark, model):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "u", "<article><p>Some words here.</p></article>", "t")], "page_id long, url string, html string, text string")
    for m in (model, train_labeller(pages)):
        rows = main_text(pages, m).collect()
        assert sorted(map(repr, ((r.page_id, r.url, r.n_chars) for r in rows))) == sorted(map(repr, [(1, None, 0), (2, "u", 0), (2, "u", 0), (None, "u", 16)]))
    assert main_text(pages.limit(0), model).count() == 0
    assert train_labeller(pages.limit(0)) is None and main_text(pages.limit(3), None).count() == 3
    with pytest.raises(Exception, match="no page had text"):
        main_text(pages, None).collect()
