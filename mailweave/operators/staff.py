"""Who does this address belong to? Page layout first: table rows, list items,
profile blocks, then the lines of text before the address.

Each branch is an array expression over one page's DOM, so a page is read once and
nothing is shuffled until contacts are de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..siteprofile import PROFILE_BLOCK_SELECTORS
from . import dedup
from . import html as H

LISTS_WANTED_BELOW = 5  # list items are read only while fewer contacts were found


def _contact(name: Column, email: Column) -> Column:
    return F.struct(name.alias("nombre"), F.lower(email).alias("correo"))


def _good(contacts: Column) -> Column:
    return F.filter(contacts, lambda c: t.good_name_length(c["nombre"]))


def _per_email(text: Column, make) -> Column:
    return F.transform(em.find_all(text), make)


def row_contacts() -> Column:
    """The name stands before the address in its cell, in the cell before, or in the row."""

    def from_cells(cells: Column) -> Column:
        return H.let(F.array_join(cells, " "), lambda joined: _per_email(joined, lambda email: contact(cells, joined, email)))

    def contact(cells: Column, joined: Column, email: Column) -> Column:
        at = F.array_position(F.transform(cells, lambda c: F.contains(F.lower(c), F.lower(email))), F.lit(True)).cast("int")
        in_cell = t.strip(F.call_function("substring_index", F.get(cells, at - 1), email, F.lit(1)))
        before_cell = F.when(at > 1, F.get(cells, at - 2))
        in_row = t.collapse_ws(t.strip(t.text_before(joined, email)))
        name = F.coalesce(t.blank_to_null(in_cell), t.blank_to_null(before_cell), t.blank_to_null(in_row))
        return _contact(t.strip_symbols(name), email)

    def from_row(row: Column) -> Column:
        cells = F.transform(H.descendants(row, "td", "th"), lambda c: H.subtree_text(c))
        found = H.let(cells, lambda cs: F.when(F.size(cs) >= 2, from_cells(cs)))
        # rows without an address are skipped before their cells are put together
        return F.when(_mentions_at(row), F.coalesce(found, _nothing())).otherwise(_nothing())

    rows = F.filter(H.tagged("tr"), lambda r: r["table_id"] >= 0)
    return _good(F.flatten(F.transform(rows, from_row)))


def _mentions_at(node: Column) -> Column:
    return F.exists(H.own_chunks(node), lambda x: F.contains(x, F.lit("@")))


def _nothing() -> Column:
    return F.array().cast("array<struct<nombre:string,correo:string>>")


def list_contacts() -> Column:
    """The text of the list item before the address."""

    def from_item(item: Column) -> Column:
        found = H.let(H.subtree_text(item), lambda x: _per_email(x, lambda e: _contact(t.strip_symbols(t.text_before(x, e)), e)))
        return F.when(_mentions_at(item), found).otherwise(_nothing())

    items = F.filter(H.tagged("li"), lambda i: i["list_id"] >= 0)
    return _good(F.flatten(F.transform(items, from_item)))


def block_contacts(selectors=PROFILE_BLOCK_SELECTORS) -> Column:
    """A heading inside the profile block, else the last words before the address."""

    def contact(text: Column, heading: Column, email: Column) -> Column:
        tail = H.let(
            t.strip_symbols(t.text_before(text, email)), lambda b: F.when(t.word_count(b) > 4, t.last_words(b)).otherwise(b)
        )
        return _contact(F.coalesce(heading, tail), email)

    def from_block(block: Column) -> Column:
        headings = F.transform(H.descendants(block, "h1", "h2", "h3", "h4", "h5", "strong", "b"), lambda h: H.subtree_text(h))
        first = F.get(F.filter(headings, lambda h: ~F.contains(h, F.lit("@")) & t.good_name_length(h)), F.lit(0))
        found = H.let(
            F.struct(H.subtree_text(block).alias("text"), first.alias("heading")),
            lambda b: _per_email(b["text"], lambda e: contact(b["text"], b["heading"], e)),
        )
        return F.when(_mentions_at(block), found).otherwise(_nothing())

    blocks = F.flatten(F.array(*[H.select_nodes(s) for s in selectors]))
    return _good(F.flatten(F.transform(blocks, from_block)))


def free_text_contacts() -> Column:
    """The nearest plausible line in the 300 characters before, else the last four words of 80."""

    def name_before(context: Column) -> Column:
        lines = F.split(context, "\n")
        near = F.transform(F.slice(lines, F.greatest(F.size(lines) - 7, F.lit(1)), F.lit(8)), t.strip)
        cleaned = F.transform(F.filter(F.reverse(near), t.plausible_line), t.strip_symbols)
        line = F.get(F.filter(cleaned, t.good_name_length), F.lit(0))
        # a plausible line that cleans to one or two letters blocks the fallback, an empty one does not
        stub = t.blank_to_null(F.try_element_at(cleaned, F.lit(-1)))
        words = t.strip_symbols(t.last_words(F.substr(context, F.greatest(F.length(context) - 79, F.lit(1)), F.lit(80))))
        return F.coalesce(line, stub, words)

    def from_text(x: Column) -> Column:
        def contact(email: Column) -> Column:
            at = F.instr(x["low"], F.lower(email))
            context = F.substr(x["text"], F.greatest(at - 300, F.lit(1)), F.least(at - 1, F.lit(300)))
            return _contact(F.when(at > 1, H.let(context, name_before)), email)

        return _per_email(x["text"], contact)

    text = H.visible_text(" ")
    return _good(H.let(F.struct(text.alias("text"), F.lower(text).alias("low")), from_text))


def page_hits(doc: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """X31 for each page as an array ``hits`` of ``(branch, idx, nombre, correo)``: all branches with their gates.

    Pages without an address anywhere in their text skip the layout work.
    """
    dom_columns = ("nodes", "chunks", "clean")
    some = F.exists("clean", lambda c: F.contains(c, F.lit("@")))

    def gated(test: Column, contacts: Column) -> Column:
        return F.when(test, contacts).otherwise(_nothing())

    step = doc.select(*keys, *dom_columns, some.alias("_some"))
    step = step.select("*", gated(F.col("_some"), row_contacts()).alias("_rows"), gated(F.col("_some"), block_contacts()).alias("_blocks"))
    few = F.col("_some") & (F.size("_rows") < LISTS_WANTED_BELOW)
    step = step.select("*", gated(few, list_contacts()).alias("_items"))
    none = F.col("_some") & (F.size("_rows") + F.size("_blocks") + F.size("_items") == 0)
    step = step.select(*keys, "_rows", "_items", "_blocks", gated(none, free_text_contacts()).alias("_free"))
    branches = [F.col(b) for b in ("_rows", "_items", "_blocks", "_free")]
    return step.select(*keys, H.numbered(branches, ("nombre", "correo")).alias("hits"))


def first_hits(hits: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """W2 over :func:`page_hits`: the first contact per address of a page."""
    rows = H.rows_of(hits, keys, F.col("hits"), "correo")
    return dedup.first_per_key(rows, [*keys, "correo"], ["branch", "idx"]).select(*keys, "branch", "idx", "nombre", "correo")


def page_contacts(doc: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """All branches of a page with their gates, first contact per address."""
    return first_hits(page_hits(doc, keys), keys)


def branch_contacts(doc: DataFrame, branch: Column, keys=("page_id", "url")) -> DataFrame:
    """One branch on its own, as rows: ``(nombre, correo)`` in page order ``idx``."""
    return H.rows_of(doc, keys, H.numbered([branch], ("nombre", "correo")), "correo").drop("branch")
