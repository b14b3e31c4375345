"""HTML as tables: the DOM job, selectors, subtree text and anchors.

``dom`` is the only Python step on the data path. It turns each page into one row
that holds its DOM as an array in document order plus the visible text chunks.
``node_id`` is the array index, so parent, sibling and ancestor look-ups are array
accesses, a node's text is a slice of the chunks and its descendants are a slice of
the DOM: extraction needs no join and no shuffle. ``nodes`` flattens the same thing into one row per DOM entry.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.text import let
from ..schemas import DOM_FIELDS, NODE

# fixed values: elements that never have content, and elements whose text is not shown
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN = frozenset("script style template rt rp".split())
# fixed values: kinds of elements that others look for above themselves
ABOVE = {"tr": 0, "table": 1, "ul": 2, "ol": 2, "div": 3, "span": 3, "p": 3}
COMMENT = "#comment"
TEXT = "#text"
# shared by all entries without attributes or classes; never written to
_NO_ATTRS: dict[str, str] = {}
_NO_CLASSES: list[str] = []


class _DomRows(HTMLParser):
    """Collects DOM entries as plain tuples; unclosed elements stay open to the end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def load(self, html: str) -> tuple[list[list], list[str], list[str]]:
        self.reset()
        self.rows: list[list] = []
        self.chunks: list[str] = []
        self.clean: list[str] = []
        self.above: list[list[int]] = [[-1], [-1], [-1], [-1]]
        self.nearest = [-1, -1, -1, -1]
        self.open: list[int] = []
        self.open_tags: Counter = Counter()
        self.last_child: dict[int, int] = {}
        self.pending: list[str] = []
        self.hidden = 0
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._pop()
        return self.rows, self.chunks, self.clean

    def _add(self, tag: str, attrs: dict[str, str], text: str | None) -> int:
        node = len(self.rows)
        parent = self.open[-1] if self.open else -1
        before = self.last_child.get(parent, -1)
        if before >= 0:
            self.rows[before][9] = node
        self.last_child[parent] = node
        shown, clean = len(self.chunks), len(self.clean)
        classes = attrs["class"].split() if attrs.get("class") else _NO_CLASSES
        self.rows.append(
            [
                node, parent, len(self.open), tag, attrs.get("id"), classes, attrs, None, before, -1, text, shown, shown, node,
                clean, clean, *self.nearest,
            ]
        )
        return node

    def _flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending = []
        if not text:
            return
        if text.isspace():
            text = "\n" if "\n" in text else " "
        if self.hidden:
            return
        node = self._add(TEXT, _NO_ATTRS, text)
        self.chunks.append(text)
        self.rows[node][12] = len(self.chunks)
        trimmed = text.strip()
        if trimmed:
            self.clean.append(trimmed)
            self.rows[node][15] = len(self.clean)

    def _pop(self) -> None:
        row = self.rows[self.open.pop()]
        self.open_tags[row[3]] -= 1
        row[12] = len(self.chunks)
        row[13] = len(self.rows) - 1
        row[15] = len(self.clean)
        if row[3] in ABOVE:
            kind = ABOVE[row[3]]
            self.above[kind].pop()
            self.nearest[kind] = self.above[kind][-1]
        if row[3] in HIDDEN:
            self.hidden -= 1

    def handle_starttag(self, tag, attrs):
        self._flush()
        # the last of repeated attributes wins; a bare attribute has the empty value
        node = self._add(tag, {k: v or "" for k, v in attrs} if attrs else _NO_ATTRS, None)
        if tag not in VOID:
            self.open.append(node)
            self.open_tags[tag] += 1
            if tag in ABOVE:
                self.above[ABOVE[tag]].append(node)
                self.nearest[ABOVE[tag]] = node
            if tag in HIDDEN:
                self.hidden += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        self._flush()
        if tag not in VOID and self.open_tags[tag]:
            while self.open:
                top = self.rows[self.open[-1]][3]
                self._pop()
                if top == tag:
                    break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add(COMMENT, _NO_ATTRS, None)

    handle_decl = handle_pi = unknown_decl = handle_comment

    def updatepos(self, i, j):
        # lines and columns of the markup are not kept
        return j


def _offsets(sizes) -> pa.Array:
    return pa.array(list(accumulate(sizes, initial=0)), pa.int32())


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(map(len, values)), pa.array([x for v in values for x in v], kind))


#: Where a DOM entry's field stands in the parser's rows
_PLACES = {
    "node_id": 0, "parent_id": 1, "pos": 0, "depth": 2, "tag": 3, "id_attr": 4, "classes": 5, "attrs": 6, "text": 10, "prev_id": 8, "next_id": 9,
    "last_id": 13, "t_from": 11, "t_to": 12, "c_from": 14, "c_to": 15, "row_id": 16, "table_id": 17, "list_id": 18, "box_id": 19,
}


def _node_array(pages: list[list[list]], fields=tuple(_PLACES)) -> pa.Array:
    """All pages' DOM entries as one list column, built field by field."""
    rows = [row for page in pages for row in page]
    col = list(zip(*rows)) if rows else [[]] * 20

    def built(name: str) -> pa.Array:
        values = col[_PLACES[name]]
        if name == "attrs":
            return pa.MapArray.from_arrays(
                _offsets(map(len, values)),
                pa.array([k for a in values for k in a], pa.string()),
                pa.array([v for a in values for v in a.values()], pa.string()),
            )
        if name == "classes":
            return _lists(values, pa.string())
        return pa.array(values, pa.string() if name in ("tag", "id_attr", "text") else pa.int32())

    return pa.ListArray.from_arrays(_offsets(map(len, pages)), pa.StructArray.from_arrays([built(f) for f in fields], names=list(fields)))


def _dom_batch(htmls: list[str | None], parts, fields=tuple(_PLACES)) -> list[pa.Array]:
    """Parse one Arrow batch into the wanted DOM columns."""
    parser = _DomRows()
    pages, chunk_lists, clean_lists, errors = [], [], [], []
    for html in htmls:
        found, chunks, clean, error = [], [], [], None
        if html is None:
            error = "no html"
        else:
            try:
                found, chunks, clean = parser.load(html)
            except Exception as exc:  # a broken page is reported, not fatal
                error = f"{type(exc).__name__}: {exc}"
        pages.append(found)
        chunk_lists.append(chunks)
        clean_lists.append(clean)
        errors.append(error)
    make = {
        "nodes": lambda: _node_array(pages, fields),
        "chunks": lambda: _lists(chunk_lists, pa.string()),
        "clean": lambda: _lists(clean_lists, pa.string()),
        "_error": lambda: pa.array(errors, pa.string()),
    }
    return [make[part]() for part in parts]


def dom(pages: DataFrame, html: str = "html", parts=("nodes", "chunks", "clean"), fields=None) -> DataFrame:
    """Add the DOM columns and ``_error`` to each page; the HTML itself is dropped.

    A Python step's output cannot be pruned by the optimizer, so callers that need
    only some of ``nodes``, ``chunks`` and ``clean`` say so in ``parts``, and those that need only some of a DOM entry's
    fields in ``fields``. Pages are parsed where they are read:
    a caller whose small input lies in few files deals it out first.
    """
    keep = [c for c in pages.columns if c != html]
    wanted = [f for f in DOM_FIELDS if f.name in (*parts, "_error")]
    fields = [f.name for f in NODE.fields if fields is None or f.name in fields]
    entry = T.ArrayType(T.StructType([NODE[f] for f in fields]))
    wanted = [T.StructField("nodes", entry) if f.name == "nodes" else f for f in wanted]
    names = [f.name for f in wanted]
    schema = T.StructType([pages.schema[c] for c in keep] + wanted)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(html).to_pylist()
            start = 0
            while start < batch.num_rows:
                # a few hundred pages or some MB of markup at a time keep the DOM of a batch small
                stop, budget = start, 4_000_000
                while stop < batch.num_rows and stop - start < 256 and (budget > 0 or stop == start):
                    budget -= len(htmls[stop] or "")
                    stop += 1
                part = batch.slice(start, stop - start)
                columns = [part.column(c) for c in keep] + _dom_batch(htmls[start:stop], names, fields)
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])
                start = stop

    return pages.select(*keep, html).mapInArrow(parse, schema)


def nodes(doc: DataFrame) -> DataFrame:
    """The DOM as a relation: one row per element, text chunk or comment. ``[node_id, last_id]`` is its interval."""
    others = [c for c in doc.columns if c not in ("nodes", "chunks", "clean", "_error")]
    return doc.select(*others, F.inline("nodes"))


def parse_errors(doc: DataFrame) -> DataFrame:
    """How many pages could not be parsed, by reason: ``(_error, pages)``; a page that was read twice counts once."""
    failed = doc.filter(F.col("_error").isNotNull())
    return failed.select("url", "_error").distinct().groupBy("_error").agg(F.count("*").alias("pages"))


# -- text ---------------------------------------------------------------------------


def visible_text(sep: str = " ", chunks: Column | None = None) -> Column:
    """X2 (``sep=' '``) and X3 (``sep=''``): the page's visible text."""
    return F.array_join(F.col("chunks") if chunks is None else chunks, sep)


def rows_of(df: DataFrame, keys, array: Column, required: str) -> DataFrame:
    """One row per struct of ``array``.

    The outer form keeps the optimizer from adding a size test on the array, which
    would evaluate the whole extraction a second time.
    """
    return df.select(*keys, F.inline_outer(array)).filter(F.col(required).isNotNull())


def subtree_text(node: Column, sep: str = " ", clean: Column | None = None) -> Column:
    """A node's text, each chunk trimmed and empty ones dropped."""
    return F.array_join(own_chunks(node, clean), sep)


def own_chunks(node: Column, clean: Column | None = None, most: int | None = None) -> Column:
    """A node's trimmed chunks, or the first ``most`` of them."""
    n = node["c_to"] - node["c_from"]
    return F.slice(F.col("clean") if clean is None else clean, node["c_from"] + 1, n if most is None else F.least(n, F.lit(most)))


def raw_subtree_text(node: Column, sep: str = "", chunks: Column | None = None) -> Column:
    """A node's text without trimming its chunks."""
    chunks = F.col("chunks") if chunks is None else chunks
    return F.array_join(F.slice(chunks, node["t_from"] + 1, node["t_to"] - node["t_from"]), sep)


def node_at(index: Column, all_nodes: Column | None = None) -> Column:
    """The DOM entry with this id; NULL for -1 (no such neighbour)."""
    all_nodes = F.col("nodes") if all_nodes is None else all_nodes
    return F.get(all_nodes, index)


def climb(depth: Column, state: Column, step) -> Column:
    """Fold ``step`` over a node and its ancestors: one call for each of the ``depth + 1`` entries on the way up."""
    return F.aggregate(F.sequence(F.lit(0), depth), state, lambda s, _: step(s))


# -- selectors ----------------------------------------------------------------------

_SIMPLE = re.compile(
    r"""(?P<tag>^[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$]?=)\s*["']?(?P<val>[^"'\]]*?)["']?\s*(?P<ci>(?<=["'\s])i)?\s*)?\]""",
    re.X,
)


def _compound(step: str):
    """One step such as ``div.card[data-x*="y" i]`` as a predicate over a DOM entry."""
    tests, at = [], 0
    for m in _SIMPLE.finditer(step):
        if m.start() != at:
            break
        at = m.end()
        tests.append(m.groupdict())
    if at != len(step) or not tests:
        raise ValueError(f"selector step not supported: {step!r}")

    def predicate(n: Column) -> Column:
        out = ~n["tag"].startswith("#")
        for g in tests:
            if g["tag"]:
                out = out & (n["tag"] == g["tag"].lower())
            elif g["cls"]:
                out = out & F.array_contains(n["classes"], g["cls"])
            elif g["id"]:
                out = out & (n["id_attr"] == g["id"])
            else:
                value = F.get(F.filter(F.map_entries(n["attrs"]), lambda e: e["key"] == g["attr"].lower()), F.lit(0))["value"]
                out = out & _attr_test(value, g)
        return F.coalesce(out, F.lit(False))

    return predicate


def _attr_test(value: Column, g: dict) -> Column:
    if not g["op"]:
        return value.isNotNull()
    want = g["val"]
    if g["ci"]:
        value, want = F.lower(value), want.lower()
    if g["op"] == "=":
        return value == want
    if not want:
        return F.lit(False)
    if g["op"] == "*=":
        return F.contains(value, F.lit(want))
    return value.startswith(want) if g["op"] == "^=" else value.endswith(want)


def _chains(selector: str) -> list[list]:
    """The alternatives of a comma list, each as the predicates of its descendant steps."""
    return [[_compound(s) for s in _split_outside_brackets(part, " ")] for part in _split_outside_brackets(selector, ",")]


def matches(node: Column, selector: str) -> Column:
    """X6 for a selector without descendant steps: does the DOM entry match one of its alternatives?

    Supported: tag, ``.class``, ``#id``, ``[attr]``, ``[attr=x]``, ``[attr*="x" i]``, ``^=``, ``$=`` and comma lists;
    :func:`select_nodes` also takes descendant steps.
    """
    chains = _chains(selector)
    if any(len(steps) > 1 for steps in chains):
        raise ValueError(f"descendant steps need the whole page: {selector!r}")
    return _any_of([steps[0] for steps in chains])(node)


def _any_of(tests: list):
    def test(n: Column) -> Column:
        out = tests[0](n)
        for other in tests[1:]:
            out = out | other(n)
        return out

    return test


def _chain_ids(steps: list, all_nodes: Column) -> Column:
    """Ids of the entries that match a chain of descendant steps, in document order.

    One sweep over the entries that match any step. For each step but the last, the state holds how far the
    entries reach that match the chain up to it: entries come in document order and their intervals nest, so an entry
    stands inside one of them if its id is not beyond that reach.
    """
    names = [f"r{i}" for i in range(len(steps) - 1)]

    def visit(state: Column, n: Column) -> Column:
        inside = [F.lit(True), *[n["node_id"] <= state[name] for name in names]]
        reach = [
            F.when(step(n) & within, F.greatest(state[name], n["last_id"])).otherwise(state[name]).alias(name)
            for name, step, within in zip(names, steps, inside)
        ]
        found = F.when(steps[-1](n) & inside[-1], F.concat(state["found"], F.array(n["node_id"]))).otherwise(state["found"])
        return F.struct(*reach, found.alias("found"))

    start = F.struct(*[F.lit(-1).alias(name) for name in names], F.array().cast("array<int>").alias("found"))
    return F.aggregate(F.filter(all_nodes, _any_of(steps)), start, visit, lambda state: state["found"])


def _split_outside_brackets(text: str, sep: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "[") - (ch == "]")
        if ch == sep and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current] if p.strip()]


def select_nodes(selector: str, all_nodes: Column | None = None) -> Column:
    """All matching DOM entries of the page, in document order; each page is swept once for each alternative."""
    all_nodes = F.col("nodes") if all_nodes is None else all_nodes
    chains = _chains(selector)
    plain = [steps[0] for steps in chains if len(steps) == 1]
    if len(plain) == len(chains):
        return F.filter(all_nodes, _any_of(plain))
    ids = [_chain_ids(steps, all_nodes) for steps in chains if len(steps) > 1]
    if plain:
        ids.append(F.transform(F.filter(all_nodes, _any_of(plain)), lambda n: n["node_id"]))
    wanted = ids[0] if len(ids) == 1 else F.array_sort(F.array_distinct(F.concat(*ids)))
    return F.transform(wanted, lambda i: node_at(i, all_nodes))


def select_texts(selector: str, sep: str = " ") -> Column:
    return F.transform(select_nodes(selector), lambda n: subtree_text(n, sep))


def first_text(selector: str, sep: str = " ") -> Column:
    """Text of the first match only; NULL when nothing matches or its text is empty."""
    first = F.get(select_nodes(selector), F.lit(0))
    return let(first, lambda n: F.when(n.isNotNull(), let(subtree_text(n, sep), t.blank_to_null)))


def tagged(*tags: str, all_nodes: Column | None = None) -> Column:
    """Entries with one of the tags, in document order."""
    all_nodes = F.col("nodes") if all_nodes is None else all_nodes
    return F.filter(all_nodes, lambda n: n["tag"].isin(*tags))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def subtree(node: Column, all_nodes: Column | None = None) -> Column:
    """All entries below the node, in document order: a slice of the DOM array."""
    all_nodes = F.col("nodes") if all_nodes is None else all_nodes
    return F.slice(all_nodes, node["node_id"] + 2, node["last_id"] - node["node_id"])


def descendants(outer: Column, *tags: str) -> Column:
    return F.filter(subtree(outer), lambda n: n["tag"].isin(*tags))


def numbered(branches: list[Column], fields: tuple[str, ...]) -> Column:
    """Concatenate struct arrays, adding ``branch`` (from 1) and ``idx`` (position inside it)."""

    def one(number: int, branch: Column) -> Column:
        head = F.lit(number).alias("branch")
        return F.transform(branch, lambda c, i: F.struct(head, i.alias("idx"), *[c[f].alias(f) for f in fields]))

    return F.concat(*[one(no, b) for no, b in enumerate(branches, 1)])


# -- anchors ------------------------------------------------------------------------


#: What :func:`anchor_structs` reads of a DOM entry
LINK_FIELDS = ("pos", "tag", "attrs", "c_from", "c_to")
#: the ampersand comes last, so that nothing is decoded twice
_REFERENCES = (("quot", '"'), ("apos", "'"), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def anchor_structs(sep: str = " ") -> Column:
    """X4 as an array of ``(href, text, pos)``."""
    found = F.filter(F.col("nodes"), lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull())
    return F.transform(
        found,
        lambda n: F.struct(attr(n, "href").alias("href"), subtree_text(n, sep).alias("text"), n["pos"].alias("pos")),
    )


def anchors(doc: DataFrame, keys=("page_id", "url"), sep: str = " ") -> DataFrame:
    """One row per ``<a href>``."""
    return rows_of(doc, keys, anchor_structs(sep), "href")


def anchor_links(pages: DataFrame, keys=("page_id", "url"), html: str = "html") -> DataFrame:
    """X4, links only: hrefs straight from the markup, with no parser.

    A value ends at the quote it began with, or at white space if it has none. Pages whose hrefs hold
    character references beyond the five of XML go to the parser. Good for link graphs; hrefs inside
    comments or scripts count too, so use :func:`anchors` where that matters.
    """
    value = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    rare = r"""(?i)<a\b[^>]*?\shref\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)&(?!(?:amp|quot|apos|lt|gt|#39);)(?:#[0-9]|#x[0-9a-f]|[a-z]+;)"""
    plain = pages.filter(~F.coalesce(F.col(html).rlike(rare), F.lit(False)))
    hrefs = F.regexp_extract_all(F.col(html), F.lit(value), F.lit(1))
    href = F.regexp_replace("raw", r"""^["']|["']$""", "")
    for name, sign in _REFERENCES:
        href = F.replace(href, F.lit(f"&{name};"), F.lit(sign))
    fast = plain.select(*keys, F.posexplode(hrefs).alias("pos", "raw")).select(*keys, href.alias("href"), "pos")
    parsed = dom(pages.filter(F.col(html).rlike(rare)).select(*keys, html), html, ("nodes", "clean"))
    return fast.unionByName(anchors(parsed, keys).select(*keys, "href", "pos"))


#: A block of one level is 2**_BITS blocks of the level below; node ids have 31 bits
_BITS, _LEVELS = 4, 8


def _blocks(first: Column, last: Column) -> Column:
    """An interval of node ids as aligned blocks ``(level, block)``: few, disjoint and complete."""

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        up = F.shiftright(low + (2**_BITS - 1), _BITS)
        down = F.shiftright(high, _BITS)
        ends = (up >= down) | (level == _LEVELS - 1)
        inner = F.array(F.array(low, F.shiftleft(up, _BITS)), F.array(F.shiftleft(down, _BITS), high))

        def listed(edge: Column) -> Column:
            ids = F.when(edge[0] < edge[1], F.sequence(edge[0], edge[1] - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(ids, lambda b: F.struct(level.alias("level"), b.alias("block")))

        found = F.flatten(F.transform(F.when(ends, F.array(F.array(low, high))).otherwise(inner), listed))
        nothing = F.lit(0).cast("bigint")
        return F.struct(
            F.when(ends, nothing).otherwise(up).alias("low"), F.when(ends, nothing).otherwise(down).alias("high"),
            F.concat(state["blocks"], found).alias("blocks"),
        )

    start = F.struct(
        first.cast("bigint").alias("low"), (last + 1).cast("bigint").alias("high"),
        F.array().cast("array<struct<level:int,block:bigint>>").alias("blocks"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), start, step, lambda s: s["blocks"])


def subtree_members(dom_nodes: DataFrame, roots: DataFrame, keys=("page_id",)) -> DataFrame:
    """Entries inside the given roots: the entries' columns and ``root_id``, one row for each root above an entry.

    ``roots`` need ``node_id`` and ``last_id``. An interval join by buckets: a root's interval falls into few aligned blocks, an
    entry lies in one block of each level, and the two meet in an equi-join on ``(page, level, block)``. A pair meets
    in one block only; entries and roots are never compared pairwise, whatever the depth.
    """
    inside = F.col("node_id") + 1
    spans = roots.select(*keys, "node_id", "last_id").distinct().filter(F.col("last_id") >= inside)
    spans = spans.select(*keys, F.col("node_id").alias("root_id"), F.inline(_blocks(inside, F.col("last_id"))))
    levels = F.posexplode(F.array(*[F.shiftright(F.col("node_id").cast("bigint"), _BITS * i) for i in range(_LEVELS)])).alias("level", "block")
    return dom_nodes.select("*", levels).join(spans, [*keys, "level", "block"]).select(*dom_nodes.columns, "root_id")
