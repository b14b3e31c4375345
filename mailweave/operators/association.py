"""Who does this address belong to? Climb from the address through the DOM.

Candidates are tried lazily from the node outwards, by following parent pointers; table rows and boxes above an entry
are pointers too. Texts with too many words are told by their first chunks and are not built, so the work of a climb
grows with the depth, not with the texts on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from . import dedup
from . import html as H


def _null() -> Column:
    return F.lit(None).cast("string")


def _first_found(items: Column, attempt) -> Column:
    """Lazy first non-NULL of ``attempt(item)`` over an array."""
    return F.aggregate(items, _null(), lambda acc, x: F.when(acc.isNotNull(), acc).otherwise(attempt(x)))


def _text_without(text: Column, email: Column) -> Column:
    """The text with the address taken out, whatever its case."""
    pattern = F.concat(F.lit(r"(?i)\Q"), email, F.lit(r"\E"))

    def cut(x: Column) -> Column:
        return (
            F.when(F.contains(x, email), t.text_without(x, email))
            .when(F.contains(x, F.lit("@")) & F.contains(F.lower(x), email), t.strip(F.regexp_replace(x, pattern, F.lit(""))))
            .otherwise(x)
        )

    return H.let(text, cut)


def _page_text() -> Column:
    """Text of the whole document, the last ancestor of every node."""
    return F.array_join("clean", " ")


def _name(text: Column) -> Column:
    """F6 with its intermediate text evaluated once."""
    return H.let(text, t.normalize_name)


def climb_name(node: Column, email: Column) -> Column:
    """Text of the nearest ancestor-or-self with three to eight words besides the address.

    An ancestor's text holds its child's, so words only get more: the climb is over at the first text with three or more,
    and an ancestor that adds no chunk is passed by.
    """

    def judged(text: Column, use) -> Column:
        return H.let(_text_without(text, email), lambda rest: H.let(t.word_count(rest), lambda n: use(rest, n)))

    def step(s: Column) -> Column:
        def at_entry(e: Column) -> Column:
            def state(name: Column, done: Column) -> Column:
                return F.struct(e["parent_id"].alias("at"), e["c_from"].alias("c_from"), e["c_to"].alias("c_to"), name.alias("name"), done.alias("done"))

            known = (e["c_from"] == s["c_from"]) & (e["c_to"] == s["c_to"])
            looked = judged(H.subtree_text(e), lambda rest, n: state(F.when(n.between(3, 8), rest), n >= 3))
            return F.when(known, state(_null(), F.lit(False))).otherwise(looked)

        return F.when(s["done"], s).otherwise(H.let(H.node_at(s["at"]), at_entry))

    start = F.struct(
        node["node_id"].alias("at"), F.lit(-1).alias("c_from"), F.lit(-1).alias("c_to"), _null().alias("name"), F.lit(False).alias("done")
    )
    whole = judged(_page_text(), lambda rest, n: F.when(n.between(3, 8), rest))
    found = H.let(H.climb(node["depth"], start, step), lambda s: F.when(s["done"], s["name"]).otherwise(whole))
    return F.when(node["node_id"].isNotNull(), found)


#: What names and contacts are found with
CONTACT_FIELDS = (
    "node_id", "parent_id", "pos", "depth", "tag", "attrs", "text", "prev_id", "next_id", "last_id", "c_from", "c_to", "row_id", "table_id", "box_id",
)
#: Names have at most so many words; so many chunks are looked at to tell that a text has more
_NAME_WORDS, _LOOK = 8, 64


def _lowered() -> Column:
    """The page's chunks to look for addresses in: in lower case where they have an at-sign."""
    return F.transform("clean", lambda c: F.when(F.contains(c, F.lit("@")), F.lower(c)).otherwise(c))


def near_name(node: Column, email: Column, lowered: Column) -> Column:
    """Ordered look-ups around the node, then around each ancestor in turn.

    Around an ancestor, its own text and its siblings were tried one step earlier as
    the parent's, so from the second step on only the parent's side is new. ``lowered``: the page's :func:`_lowered`.
    """

    def many_words(chunks: Column) -> Column:
        # every chunk that does not hold the address has a word
        return F.size(F.filter(chunks, lambda c: ~F.contains(c, email))) > _NAME_WORDS

    def name_of(chunks: Column, text: Column) -> Column:
        return F.when(~many_words(chunks), _name(_text_without(text, email)))

    def name_at(index: Column) -> Column:
        # -1 is a missing neighbour, -2 stands for the document itself
        page = name_of(F.slice(lowered, 1, _LOOK), _page_text())
        entry = H.let(H.node_at(index), lambda n: name_of(H.own_chunks(n, lowered, _LOOK), H.subtree_text(n)))
        return F.when(index == -2, page).when(index >= 0, entry)

    def first_name(*indexes: Column) -> Column:
        return _first_found(F.array(*indexes), name_at)

    def from_row(parent: Column) -> Column:
        # the cells of the row above that do not hold the address
        def cell_name(c: Column) -> Column:
            text = H.let(H.subtree_text(c), lambda x: F.when(~F.contains(F.lower(x), email), _name(x)))
            return F.when(~many_words(H.own_chunks(c, lowered, _LOOK)), text)

        found = H.let(H.node_at(parent["row_id"]), lambda r: F.when(r.isNotNull(), _first_found(H.descendants(r, "td", "th"), cell_name)))
        return F.when(parent["tag"].isin("td", "th"), found)

    def from_container(entry: Column, places: Column) -> Column:
        # the last words before the address in the box above; a chunk has a word at least, so four before it suffice
        def before(hit: Column, first: Column) -> Column:
            since = F.greatest(first, hit - 4)
            left = F.slice("clean", since + 1, hit - since)
            return F.array_join(F.concat(left, F.array(t.text_before(F.get("clean", hit), email))), " ")

        def words(container: Column) -> Column:
            hit = F.get(F.filter(places, lambda p: (p >= container["c_from"]) & (p < container["c_to"])), F.lit(0))
            text = H.let(hit, lambda h: F.when(h.isNotNull(), t.strip(before(h, container["c_from"]))))
            return H.let(text, lambda b: t.last_words(b))

        found = H.let(H.node_at(entry["box_id"]), lambda c: F.when(c.isNotNull(), words(c)))
        return H.let(found, lambda w: F.when(t.word_count(w) >= 2, _name(w)))

    def around(entry: Column, parent: Column, places: Column) -> Column:
        holder = F.when(entry["parent_id"] >= 0, entry["parent_id"]).otherwise(-2)
        none = F.lit(-1)
        return F.coalesce(
            first_name(F.coalesce(parent["prev_id"], none), F.coalesce(parent["next_id"], none), holder),
            from_row(parent),
            from_container(entry, places),
        )

    def climbed(places: Column) -> Column:
        def step(s: Column) -> Column:
            def at_entry(e: Column) -> Column:
                name = H.let(H.node_at(e["parent_id"]), lambda p: around(e, p, places))
                return F.struct(e["parent_id"].alias("at"), name.alias("name"))

            return F.when(s["name"].isNotNull(), s).otherwise(H.let(H.node_at(s["at"]), at_entry))

        start = F.struct(node["node_id"].alias("at"), _null().alias("name"))
        return H.climb(node["depth"], start, step)["name"]

    here = first_name(node["node_id"], node["prev_id"], node["next_id"])
    holds = F.transform(lowered, lambda c, i: F.when(F.contains(c, email), i))
    above = H.let(F.filter(holds, lambda i: i.isNotNull()), climbed)
    return F.when(node["node_id"].isNotNull(), F.coalesce(here, above))


def _clean_email(raw: Column, domains=None, strict: bool = True) -> Column:
    """F1, or F2 where domains are given, with the address looked for once."""
    return H.let(em.clean_email(raw), lambda e: e if domains is None else F.when(em.at_domains(e, domains, strict), e))


def mailto_links(domains=None, strict: bool = True) -> Column:
    """Mailto anchors as ``(email, node)``; restricted to ``domains`` when given."""
    links = F.filter(F.col("nodes"), lambda n: (n["tag"] == "a") & H.attr(n, "href").startswith("mailto:"))

    def pair(n: Column) -> Column:
        raw = F.replace(H.attr(n, "href"), F.lit("mailto:"), F.lit(""))
        return F.struct(_clean_email(raw, domains, strict).alias("email"), n.alias("node"))

    return F.filter(F.transform(links, pair), lambda p: p["email"].isNotNull())


def text_emails(domains=None, strict: bool = True) -> Column:
    """Addresses of the page's glued text with the element whose text holds them (NULL if split)."""
    found = em.find_all(H.visible_text(""))
    cleaned = F.transform(found, lambda e: _clean_email(e, domains, strict))
    known = F.array_distinct(F.filter(cleaned, lambda e: e.isNotNull()))
    texts = F.filter(F.col("nodes"), lambda n: (n["tag"] == H.TEXT) & F.contains(n["text"], F.lit("@")))
    lowered = F.transform(texts, lambda n: F.struct(F.lower(n["text"]).alias("text"), n["parent_id"].alias("parent_id")))

    def holder(places: Column, email: Column) -> Column:
        hit = F.get(F.filter(places, lambda n: F.contains(n["text"], email)), F.lit(0))
        return F.struct(email.alias("email"), H.node_at(hit["parent_id"]).alias("node"))

    return H.let(lowered, lambda places: F.transform(known, lambda e: holder(places, e)))


def staff_rows(domains, strict: bool = True) -> Column:
    """Per staff-table row the last address and the last multi-word cell's name.

    A later multi-word cell that is no name resets the name to NULL.
    """
    rows = F.filter(H.tagged("tr"), lambda r: r["table_id"] >= 0)

    def from_row(row: Column) -> Column:
        cells = F.transform(H.descendants(row, "td", "th"), lambda c: H.subtree_text(c, sep=""))
        return H.let(
            F.transform(cells, lambda c: F.struct(c.alias("text"), _clean_email(c, domains, strict).alias("email"))), pick
        )

    def pick(pairs: Column) -> Column:
        emails = F.filter(pairs, lambda p: p["email"].isNotNull())
        names = F.filter(pairs, lambda p: p["email"].isNull() & (t.word_count(p["text"]) >= 2))
        email = F.when(F.size(pairs) >= 2, F.try_element_at(emails, F.lit(-1))["email"])
        name = F.when(F.size(emails) > 0, _name(F.try_element_at(names, F.lit(-1))["text"]))
        return F.struct(email.alias("email"), name.alias("profesor"))

    return F.filter(F.transform(rows, from_row), lambda p: p["email"].isNotNull())


def _named(mailto: Column, text: Column, find) -> Column:
    """Name both kinds of hits; ``find`` is built once for the two branches together."""

    def tagged(pairs: Column, from_text: bool) -> Column:
        return F.transform(pairs, lambda p: F.struct(p["email"].alias("email"), p["node"].alias("node"), F.lit(from_text).alias("from_text")))

    both = F.concat(tagged(mailto, False), tagged(text, True))
    return F.transform(
        both, lambda p: F.struct(p["email"].alias("email"), find(p["node"], p["email"]).alias("profesor"), p["from_text"].alias("from_text"))
    )


def _hits(named: Column, rows: Column | None = None) -> Column:
    """``(branch, idx, profesor, email)`` for each hit: mailto links are branch 1, text 2, table rows 3.

    Pages without an address in their text or links have none, without further work.
    """
    hits = F.transform(
        named,
        lambda c, i: F.struct(F.when(c["from_text"], 2).otherwise(1).alias("branch"), i.alias("idx"), c["profesor"].alias("profesor"), c["email"].alias("email")),
    )
    if rows is not None:
        third = F.transform(rows, lambda c, i: F.struct(F.lit(3).alias("branch"), i.alias("idx"), c["profesor"].alias("profesor"), c["email"].alias("email")))
        hits = F.concat(hits, third)
    in_text = F.exists("clean", lambda c: F.contains(c, F.lit("@")))
    in_link = F.exists("nodes", lambda n: (n["tag"] == "a") & H.attr(n, "href").startswith("mailto:"))
    return F.when(in_text | in_link, hits)


def climbed_hits() -> Column:
    """X11 + X9 + X28 for one page."""
    return _hits(_named(mailto_links(), text_emails(), climb_name))


def near_hits(domains, strict: bool = True) -> Column:
    """X32's branches for one page: mailto links (1) and text (2) with X29 names, staff-table rows (3)."""

    def named(lowered: Column) -> Column:
        return _named(mailto_links(domains, strict), text_emails(domains, strict), lambda node, email: near_name(node, email, lowered))

    return _hits(H.let(_lowered(), named), staff_rows(domains, strict))


def climbed_contacts(doc: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """X11 + X9 + X28 for each page: every mailto link (branch 1), then text addresses (branch 2).

    Both branches are whole; see :func:`drop_known_text_emails` for rule J5.
    """
    return H.rows_of(doc, keys, climbed_hits(), "email")


def drop_known_text_emails(rows: DataFrame, group: str, order) -> DataFrame:
    """A text address stays only where nothing of its group came before it; mailto rows all stay.

    A text row survives exactly when it is its group's first row for that address.
    """
    firsts = dedup.first_per_key(rows, [group, "email"], order)
    return rows.filter(F.col("branch") == 1).unionByName(firsts.filter(F.col("branch") != 1).select(*rows.columns))


def near_names(doc: DataFrame, domains, keys=("page_id", "url"), strict: bool = True) -> DataFrame:
    """The branches of X32 as found, as rows."""
    return H.rows_of(doc, keys, near_hits(domains, strict), "email")


def near_contacts(doc: DataFrame, domains, keys=("page_id", "url"), strict: bool = True) -> DataFrame:
    """X32 before de-duplication: missing names are inferred from the address."""
    return with_inferred(near_names(doc, domains, keys, strict))


def with_inferred(rows: DataFrame) -> DataFrame:
    """F7 for rows ``(…, profesor, email)`` without a name."""
    return rows.withColumn("profesor", F.coalesce("profesor", t.infer_name(F.col("email"))))


def page_contacts(doc: DataFrame, domains, keys=("page_id", "url"), strict: bool = True) -> DataFrame:
    """First contact per address of a page."""
    rows = near_contacts(doc, domains, keys, strict)
    return dedup.first_per_key(rows, [*keys, "email"], ["branch", "idx"]).select(*keys, "branch", "idx", "profesor", "email")
