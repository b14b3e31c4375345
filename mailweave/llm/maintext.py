"""Main text of web pages: a recurrent labeller classifies every leaf block with the whole page in view."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bilstm import BiLstm
from .blocks import Block, Paths, blocks_of, numbers_of
from .common import load, plain, slices

SAMPLE_PAGES = 300
SAMPLE_BLOCKS, SAMPLE_TEXT = 400, 2_000
VARIANTS = 4
STEPS = 700
PATHS = 20_000
PROSE_WORDS = 10

# fixed values: element and name of the boxes that training pages are rebuilt with
MAIN_BOXES = "article|main|div.content|div.article-body|div.post|div.entry-content|section.story|div.main-content|div.post-body|article.post|div.text|div#content|main.article|div.page-content|section.article".split("|")
OTHER_BOXES = {
    "menu": "nav|div.nav|ul.menu|div.navbar|div.breadcrumbs|div.topnav|div#menu|nav.main-menu|div.pagination|div.navigation".split("|"),
    "header": "header|div.header|div.site-header|div#header|div.masthead|div.logo|div.top-bar|header.site".split("|"),
    "footer": "footer|div.footer|div.site-footer|div#footer|div.copyright|div.bottom|footer.page".split("|"),
    "sidebar": "aside|div.sidebar|div.related|div.widget|aside.sidebar|div.recommended|div.popular|div.trending|div#sidebar|section.related|div.more-stories".split("|"),
    "notice": "div.cookie-notice|div.notice|div.alert|div.consent|div.gdpr|div.popup|div.modal|div.cookie|div#cookie-banner|section.notice|div.disclaimer|div.warning|div.message".split("|"),
    "advert": "div.ad|div.advert|div.ads|div.sponsored|div.promo|aside.ad|div.advertisement|section.promo|ins.ads|div.banner|div#ad-1|div.sponsor".split("|"),
    "form": "form|form.search|div.newsletter|form.newsletter|form.login|div.subscribe|form.contact|fieldset".split("|"),
    "comments": "section.comments|div.comments|div.comment|ol.comment-list|div.disqus|div.replies|section.discussion|div#comments|ul.comments|div.comment-body|div.reader-comments".split("|"),
    "share": "div.share|ul.social|div.tags|div.share-buttons|div.social-links".split("|"),
}
BEFORE, INSIDE, AFTER = ("menu", "header", "notice", "advert", "form", "sidebar"), ("advert", "notice", "share", "form", "sidebar", "comments"), ("sidebar", "comments", "footer", "notice", "advert", "form", "menu", "share")
_OUTSIDE = frozenset("nav header footer aside form".split()) | {n for boxes in OTHER_BOXES.values() for b in boxes for n in b.replace("#", ".").split(".")[1:]}


def _box(spec: str) -> tuple[str, tuple[str, ...]]:
    tag, _, name = spec.replace("#", ".").partition(".")
    return tag, tuple(w.rstrip("s") or w for w in name.split("-") if w.isalpha()) if name else ()


def labelled(blocks) -> list[bool] | None:
    """What a page's own elements say, where they do: inside ``article`` or ``main``, and in no box for anything else. None: no such element."""
    if not any(t in ("article", "main") for b in blocks for t, _ in b.tags):
        return None
    out = []
    for b in blocks:
        main = [i for i, (t, _) in enumerate(b.tags) if t in ("article", "main")]
        out.append(bool(main) and not any(t in _OUTSIDE or _OUTSIDE & set(names) for t, names in b.tags[main[0] :]))
    return out


def supposed(blocks) -> list[bool]:
    """Where no element names the article: blocks that read like prose, outside links and boxes for anything else; if none does, the longest block outside of links."""
    out = [not any(t in _OUTSIDE or _OUTSIDE & set(names) for t, names in b.tags) and 2 * b.linked < len(b.text) and len(b.text.split()) >= PROSE_WORDS for b in blocks]
    if not any(out):
        free = [i for i, b in enumerate(blocks) if 2 * b.linked < len(b.text)]
        if free:
            out[max(free, key=lambda i: len(blocks[i].text))] = True
    return out


def _rebuilt(rng: random.Random, good: list[str], other: list[str], paths: Paths):
    """A page with the same texts in other boxes: path numbers, texts, linked characters and labels."""
    rows = []

    def add(chain, text, link, y):
        number = 0
        for tag, names in chain:
            number = paths.step(number, tag, names)
        rows.append((number, text, link, y))

    def section(kind, base):
        chain = [*base, _box(rng.choice(OTHER_BOXES[kind]))]
        for _ in range(rng.choice((1, 1, 2, 3, 6, 8) if kind in ("menu", "sidebar", "share", "comments") else (1, 1, 1, 2, 3))):
            text = rng.choice(other) if kind != "comments" or rng.random() < 0.3 else rng.choice(good)[:400]
            if kind in ("menu", "share"):
                text = " ".join(text.split()[: rng.randint(1, 3)])
            tags = {"menu": ("ul.", "li."), "share": ("li.",), "sidebar": rng.choice((("ul.", "li."), ("p.",), (), ("h3.",))), "comments": rng.choice((("p.",), ("div.", "p."), ("li.",), ("li.", "p."), ())), "form": rng.choice((("label.",), ("p.",), ("button.",), ())), "footer": rng.choice((("p.",), (), ("ul.", "li.")))}.get(kind, rng.choice((("p.",), (), ("span.",))))
            tags = [_box(t) for t in tags if t != "span."]
            linked = len(text) if kind in ("menu", "share") or kind == "sidebar" and rng.random() < 0.6 else 0
            if text:
                add([*chain, *tags], text, linked, False)

    base = [("html", ()), ("body", ())]
    if rng.random() < 0.4:
        base = [*base, ("div", rng.choice(((), ("wrapper",), ("container",), ("page",))))]
    for kind in rng.sample(BEFORE, rng.randint(0, 4)):
        section(kind, base)
    box = [*base, *((("div", rng.choice(((), ("row",), ("column",)))),) if rng.random() < 0.3 else ()), _box(rng.choice(MAIN_BOXES))]
    if rng.random() < 0.15:
        box = [*box, _box(rng.choice(MAIN_BOXES))]
    for i, text in enumerate(good):
        tag = rng.choice(("h1", "h1", "h2", "p")) if i == 0 else rng.choices(("p", "h2", "h3", "li", "blockquote", "pre", "td", "div", "dd"), (30, 2, 2, 3, 2, 1, 1, 3, 1))[0]
        chain = {"li": [("ul", ()), ("li", ())], "td": [("table", ()), ("tr", ()), ("td", ())], "blockquote": [("blockquote", ()), ("p", ())], "dd": [("dl", ()), ("dd", ())]}.get(tag, [(tag, ())])
        add([*box, *chain], text, 0, True)
        if rng.random() < 0.08:
            section(rng.choice(INSIDE[:5]), box)
    for kind in rng.sample(AFTER, rng.randint(0, 4)):
        section(kind, box if kind in INSIDE and rng.random() < 0.3 else base)
    return rows


_SAMPLED = "names_it boolean, mark long, blocks array<struct<chain:array<struct<tag:string,names:array<string>>>,text:string,linked:int>>"


def _sampled_blocks(pages: DataFrame, seed: int) -> DataFrame:
    """Pages as blocks with their tags, read where the pages are; of long pages a run of ``SAMPLE_BLOCKS`` blocks at a
    hashed place, of long blocks the first ``SAMPLE_TEXT`` characters."""

    def run(batches):
        for batch in batches:
            for page, mark in zip(batch.column("html").to_pylist(), batch.column("mark").to_pylist()):
                blocks = blocks_of(page, Paths(), with_tags=True)
                first = mark % max(1, len(blocks) - SAMPLE_BLOCKS + 1)
                some = [
                    {"chain": [{"tag": t, "names": list(names)} for t, names in b.tags], "text": b.text[:SAMPLE_TEXT], "linked": min(b.linked, SAMPLE_TEXT)}
                    for b in blocks[first : first + SAMPLE_BLOCKS]
                ]
                if some:
                    row = {"names_it": any(t in ("article", "main") for b in blocks for t, _ in b.tags), "mark": mark, "blocks": some}
                    yield pa.RecordBatch.from_pylist([row], schema=_SAMPLED_TYPE)

    return pages.select("html", F.xxhash64(F.lit(seed), "page_id", "html").alias("mark")).mapInArrow(run, _SAMPLED)


_SAMPLED_TYPE = pa.schema(
    [
        ("names_it", pa.bool_()),
        ("mark", pa.int64()),
        ("blocks", pa.list_(pa.struct([("chain", pa.list_(pa.struct([("tag", pa.string()), ("names", pa.list_(pa.string()))]))), ("text", pa.string()), ("linked", pa.int32())]))),
    ]
)


def _sample(pages: DataFrame, seed: int) -> list:
    """At most ``SAMPLE_PAGES`` pages with text as blocks. Where those with the smallest hashes have none, all pages are asked."""
    names_it = F.col("html").rlike(r"(?i)<(article|main)[\s/>]")
    mark = F.xxhash64(F.lit(seed), "page_id", "html")
    usable = pages.where("html IS NOT NULL").select("page_id", "html")
    # which pages is decided by their hashes alone; no other page's html travels
    first = usable.select(names_it.alias("names_it"), mark.alias("mark")).distinct().orderBy(F.desc("names_it"), "mark").limit(SAMPLE_PAGES)
    few = usable.join(F.broadcast(first.select("mark")), mark == F.col("mark"), "left_semi")
    order = [F.desc("names_it"), F.col("mark")]
    for some in (few, usable):
        found = _sampled_blocks(some, seed).dropDuplicates(["mark"]).orderBy(*order).limit(SAMPLE_PAGES).collect()
        if found:
            break
    return found


def train_labeller(pages: DataFrame, seed: int = 1) -> BiLstm | None:
    """Learn from the ``SAMPLE_PAGES`` pages with the smallest hashes, first those that name their article; of each at most ``SAMPLE_BLOCKS`` blocks.

    Their own elements give the labels. Each page is also rebuilt ``VARIANTS`` times with the same texts in other boxes, so that
    the labeller meets sidebars, notices, forms and comments. Of pages that do not name their article, taken where there are too few
    others, only the rebuilt ones are learned from: texts that read like prose are their articles, or else the longest texts. None if no page has text.
    """
    rng, paths, ready, parts = random.Random(seed), Paths(), [], []
    for row in _sample(pages, seed):
        blocks = []
        for b in row.blocks:
            number, chain = 0, tuple((step.tag, tuple(step.names)) for step in b.chain)
            for tag, names in chain:
                number = paths.step(number, tag, names)
            blocks.append(Block(number, chain, b.text, b.linked))
        y = labelled(blocks)
        if y and any(y):
            ready.append((np.array([b.path for b in blocks]), numbers_of(blocks), np.array(y)))
        else:
            y = supposed(blocks)
        if not any(y):
            y[max(range(len(blocks)), key=lambda i: len(blocks[i].text))] = True
        parts.append(([b.text for b, m in zip(blocks, y) if m], [b.text for b, m in zip(blocks, y) if not m] or ["menu"]))
    if not parts:
        return None
    others = [t for _, o in parts for t in o]
    for good, other in parts:
        for _ in range(VARIANTS):
            rows = _rebuilt(rng, good, other + rng.choices(others, k=3), paths)
            made = [Block(p, None, t, n) for p, t, n, _ in rows]
            ready.append((np.array([r[0] for r in rows]), numbers_of(made), np.array([r[3] for r in rows])))
    model = BiLstm(seed=seed)
    model.train(ready, np.array(paths.vectors), STEPS, seed=seed)
    return model


class _Labeller:
    """Blocks and labels of many pages at once; path projections are kept between calls."""

    def __init__(self, model: BiLstm | None):
        self.model, self.paths = model, Paths()

    def texts(self, pages: list[str | None]) -> list[str]:
        if len(self.paths.vectors) > PATHS:
            self.paths = Paths()
        blocks = [blocks_of(p, self.paths) for p in pages]
        flat = [x for b in blocks for x in b]
        keep = [[]] * len(pages)
        if flat and self.model is None:
            raise ValueError("no page had text when the labeller was to be trained")
        if flat:
            used, at = np.unique([x.path for x in flat], return_inverse=True)
            inputs = self.model.project(np.array([self.paths.vectors[i] for i in used]), numbers_of_pages(blocks), at)
            ends = np.cumsum([len(b) for b in blocks])
            keep = [p >= 0.5 for p in self.model.predict(np.split(inputs, ends[:-1]))]
        return [" ".join(x.text for x, k in zip(b, y) if k) for b, y in zip(blocks, keep)]


def numbers_of_pages(blocks: list[list]) -> np.ndarray:
    return np.concatenate([numbers_of(b) for b in blocks])


def main_text(pages: DataFrame, model: BiLstm | None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page, from the whole html.

    Blocks that the labeller takes for main text, character references decoded and white space made one space, joined in page
    order by one space. Null or empty html, and pages without main text, give the empty text; unclosed tags are closed as
    browsers do, a page cut off in a tag ends there. Pages of any length are read whole, one task a page. Repeated rows are read each; an empty table gives no rows; other columns are not read.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)  # about 80,000 numbers

    def run(batches):
        labeller = _Labeller(held.value)
        for batch in batches:
            for rows in slices(batch, "html", 2 << 20):
                text = labeller.texts(rows.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id").cast(pa.int64()), rows.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return plain(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return main_text(pages, train_labeller(pages))
