"""The DOM job, selectors and page-level extraction on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from mailweave import siteprofile as sp
from mailweave.operators import association as A
from mailweave.operators import departments as DP
from mailweave.operators import directory as D
from mailweave.operators import extract as X
from mailweave.operators import html as H
from mailweave.operators import staff

SITE = sp.UC3M


@pytest.fixture(scope="module")
def parse(spark):
    def run(*pages, url="https://www.uc3m.es/p"):
        rows = [(i, url, h) for i, h in enumerate(pages)]
        return H.dom(spark.createDataFrame(rows, "page_id long, url string, html string"))

    return run


def test_text_of_broken_pages(parse):
    doc = parse("a <b>b</b> c<br><p>d<p>e", "<script>x@y.es</script><!-- z@y.es --><p>ok", "", None, "<p>&amp; &eacute; &#64;", "a</i>b</p>")
    got = [r[0] for r in doc.orderBy("page_id").select(H.visible_text("|")).collect()]
    assert got == ["a |b| c|d|e", "ok", "", "", "& é @", "a|b"]
    assert H.parse_errors(doc).collect()[0]["_error"] == "no html"


def test_structure(parse):
    doc = parse("<div id=m class='a b'><p>x<br>y</p> <i>z</i></div><img src=q>")
    rows = {r["node_id"]: r for r in H.nodes(doc).collect()}
    tags = [rows[i]["tag"] for i in sorted(rows)]
    assert tags == ["div", "p", "#text", "br", "#text", "#text", "i", "#text", "img"]
    assert rows[0]["classes"] == ["a", "b"] and rows[0]["id_attr"] == "m" and rows[0]["last_id"] == 7
    assert rows[4]["parent_id"] == 1 and rows[1]["last_id"] == 4 and rows[4]["box_id"] == 1 and rows[6]["prev_id"] == 5 and rows[1]["next_id"] == 5
    assert rows[0]["next_id"] == 8 and rows[8]["attrs"] == {"src": "q"}


SELECTOR_CASES = {
    "p": 3, ".a": 2, "div.a": 1, "[class*=prof]": 1, "a[href]": 2, '[data-x*="PER" i]': 1, '[data-x*="PER"]': 0, "div p": 2, "div.a p, span": 2,
    "section div p": 1, "#k": 1, "div.a.b": 1, "a[href='/q']": 1, "a[href^='/']": 2, "a[href$=q]": 1, "p p": 0,
}


def test_selectors(parse):
    page = """<section><div class="a b" id="k"><p>1</p><a href="/q">x</a></div></section><div class="profile"><p>2</p></div>
    <p class="a" data-x="xPerson">3</p><span>s</span><a href="/z">z</a><a name="n">n</a>"""
    doc = parse(page)
    got = doc.select(*[F.size(H.select_nodes(s)).alias(str(i)) for i, s in enumerate(SELECTOR_CASES)]).collect()[0]
    assert dict(zip(SELECTOR_CASES, got)) == SELECTOR_CASES
    with pytest.raises(ValueError):
        H.select_nodes("div > p")
    with pytest.raises(ValueError):
        H.matches(F.col("x"), "div p")


def test_anchor_paths_agree(parse, spark):
    page = '<a href="/x?a=1&amp;b=2">t</a><a class=c href=\'y\'>u</a><a name=z>v</a>'
    slow = sorted((r["href"], r["text"]) for r in H.anchors(parse(page)).collect())
    assert slow == [("/x?a=1&b=2", "t"), ("y", "u")]
    fast = H.anchor_links(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    assert sorted(r["href"] for r in fast.collect()) == ["/x?a=1&b=2", "y"]


def names(df):
    return sorted((r["nombre"], r["correo"]) for r in df.collect())


def test_table_rows(parse):
    page = """<table><tr><th>Ana Gil</th><th>ana@x.es</th></tr><tr><td>Eva: eva@x.es</td><td>z</td></tr>
    <tr><td>Bo Li</td><td>a1@x.es a2@x.es</td></tr><tr><td>solo@x.es</td></tr><tr><td>dup@x.es</td><td>dup@x.es</td></tr></table>"""
    got = names(staff.branch_contacts(parse(page), staff.row_contacts()))
    # two addresses in a cell: the second one's name is the text before it in that cell
    assert got == [("Ana Gil", "ana@x.es"), ("Bo Li", "a1@x.es"), ("Eva", "eva@x.es"), ("a1x.es", "a2@x.es")]


def test_list_gate_and_branch_order(parse):
    rows = "".join(f"<tr><td>Name N{i}</td><td>n{i}@x.es</td></tr>" for i in range(5))
    items = "<ul><li>Late One late@x.es</li><li>first@x.es starts</li></ul>"
    full = staff.page_contacts(parse(f"<table>{rows}</table>{items}"))
    assert full.count() == 5
    few = staff.page_contacts(parse(f"<table>{rows[: len(rows) // 5 * 4]}</table>{items}"))
    assert ("Late One", "late@x.es") in names(few) and few.count() == 5


def test_profile_blocks(parse):
    page = """<div class="person"><h3>Ana Gil</h3>ana@x.es</div><div class="our-staff-list">Head of the very long office Eva Sanz eva@x.es</div>
    <div class="faculty"><b>x@x.es</b><strong>Bo Li</strong> bo@x.es</div>"""
    got = set(names(staff.branch_contacts(parse(page), staff.block_contacts())))
    assert got == {("Ana Gil", "ana@x.es"), ("long office Eva Sanz", "eva@x.es"), ("Bo Li", "x@x.es"), ("Bo Li", "bo@x.es")}


def test_free_text(parse):
    page = "<pre>Dean\nProf. Ana Gil\nTel 91\n12345\n ana@x.es\n</pre>"
    assert names(staff.branch_contacts(parse(page), staff.free_text_contacts())) == [("Prof. Ana Gil", "ana@x.es")]
    inline = parse("<p>one two three four five six@x.es</p>")
    assert names(staff.branch_contacts(inline, staff.free_text_contacts())) == [("one two three four five", "six@x.es")]


def people(df):
    return sorted((r["profesor"], r["email"]) for r in df.collect())


def test_climb(parse):
    page = '<div><p>Prof Ana Gil <a href="mailto:Ana@x.es?subject=hi">mail</a></p></div><p>many words stand here so that the page is long</p>'
    assert people(A.climbed_contacts(parse(page))) == [("Prof Ana Gil mail", "ana@x.es")]


def test_near_strategies(parse):
    cases = {
        "self": '<p><a href="mailto:s@uc3m.es">Ana Gil</a></p>',
        "previous": '<p><b>Ana Gil</b><a href="mailto:s@uc3m.es">mail</a></p>',
        "next": '<p><a href="mailto:s@uc3m.es">mail</a><b>ana GIL</b></p>',
        "parent": '<p>Ana <a href="mailto:s@uc3m.es">Gil</a></p>',
        "row": '<table><tr><td>Ana Gil</td><td>' + "w " * 9 + '</td><td><i>a b c d e f g h i</i><a href="mailto:s@uc3m.es">mail</a></td></tr></table>',
        "item": '<ul><li>Ana Gil: <a href="mailto:s@uc3m.es">s@uc3m.es</a></li></ul>',
        "container": '<div>a b c d e f g h i j Ana Gil <i><a href="mailto:s@uc3m.es">s@uc3m.es</a></i> <u>k l m n o p q</u></div>',
    }
    got = {r["page_id"]: (r["profesor"], r["email"]) for r in A.page_contacts(parse(*cases.values()), SITE.email_domains).collect()}
    want = dict.fromkeys(cases, ("Ana Gil", "s@uc3m.es")) | {"container": ("I J Ana Gil", "s@uc3m.es")}
    assert {kind: got[i] for i, kind in enumerate(cases)} == want


def test_near_falls_back_to_the_address(parse):
    page = "<pre>" + "word " * 12 + "ana.perez@uc3m.es " + "word " * 12 + "</pre><p>other@gmail.com</p>"
    assert people(A.page_contacts(parse(page), SITE.email_domains)) == [("Ana Perez", "ana.perez@uc3m.es")]


def test_mixed_case_address_in_text(parse):
    page = "<div><p>Ana Gil Ana.Gil@UC3M.es</p></div>"
    assert people(A.page_contacts(parse(page), SITE.email_domains)) == [("Ana Gil", "ana.gil@uc3m.es")]


def test_glued_suffix_is_kept(parse):
    page = "<td>ana@uc3m.es.</td><td>Ficha</td>"
    assert [r["email"] for r in A.page_contacts(parse(page), SITE.email_domains, strict=False).collect()] == ["ana@uc3m.es.ficha"]
    assert A.page_contacts(parse(page), SITE.email_domains).count() == 0


def test_staff_rows_reset_the_name(parse):
    page = "<table>\n<tr>\n<td>Ana Gil</td>\n<td>a@uc3m.es</td>\n<td>" + "w " * 9 + "</td>\n</tr></table>"
    rows = A.near_names(parse(page), SITE.email_domains).filter("branch = 3").collect()
    assert [(r["profesor"], r["email"]) for r in rows] == [(None, "a@uc3m.es")]


def test_cards_and_titles(parse):
    page = """<div class="view-content"><div class="views-row"><h3><a href="/people/ana">Ana Gil</a></h3><a href="#x">t</a></div>
    <div class="views-row"><h3>Solo</h3><div class="field--name-title">One Two Three Four Five</div></div>
    <div class="views-row"><div class="field--name-title"><a href="/news">Eva Sanz Ruiz</a></div></div></div>"""
    doc = parse(page)
    assert sorted(r["full_name"] for r in D.card_names(doc).collect()) == ["Ana Gil", "Eva Sanz Ruiz"]
    assert [r["link"] for r in D.card_links(doc, "uc3m.es").collect()] == ["https://www.uc3m.es/people/ana"]
    titled = parse("<h1> </h1><h1>second</h1><h2>Head</h2>", '<div itemscope itemtype="x/PERSON"><b itemprop="name">Ana</b></div>', "<p>none</p>")
    assert [r[0] for r in titled.orderBy("page_id").select(D.page_title()).collect()] == ["Head", "Ana", None]


def test_page_department(parse):
    doc = parse(
        '<dl><dt>Department of</dt><dd>Physics</dd></dl>', '<div class="field">Affiliation X</div><div class="sidebar">department: Maths  more</div>',
        '<p class="department">Law</p>', '<div class="field">no such word</div>', '<div class="field">Department: ' + "x" * 201 + "</div>",
    )
    assert [r[0] for r in doc.orderBy("page_id").select(D.page_department()).collect()] == ["Physics", "Maths", "Law", "", ""]


def test_department_cards(parse):
    card = """<a href="mailto:Fis@uc3m.es?subject=a">Fis Mail</a><dl><dt>Web del departamento</dt><dd><a href="/one">1</a></dd>
    <dt>Otro</dt><dd>x</dd><dt>Web del departamento (2)</dt><dd><p><a href="two">2</a></p></dd></dl>"""
    doc = parse(card, "<dl><dt>Web del departamento</dt></dl>", "<a href='mailto:x@gmail.com'>x</a>")
    rows = DP.cards(doc, SITE).orderBy("page_id").collect()
    assert [(r["mail"], r["web"]) for r in rows] == [("fis@uc3m.es", "https://www.uc3m.es/two"), (None, None), (None, None)]
    assert DP.cards(doc, SITE, from_text=True).orderBy("page_id").collect()[0]["mail"] == "Fis Mail"


def test_department_lists(parse):
    page = """<a href="/d/Detalle/Organismo_C/1/a">Física</a><a href="/d/Detalle/Organismo_C/2/b">abc</a>
    <a href="/d/Detalle/Organismo_C/1/a">Física bis</a><a href="https://other.es/x">Economía</a>"""
    doc = parse(page)
    assert [r["dept_name"] for r in DP.by_marker_named(doc, SITE).collect()] == ["Física"]
    assert DP.by_marker(doc, SITE).count() == 2
    assert [(r["dep_id"], r["nombre"]) for r in DP.id_names(doc, SITE).collect()] == [("1", "Física bis")]
    assert [r["dept_name"] for r in DP.by_keyword(doc, SITE).collect()] == ["Física bis"]


def test_usable_pages(spark):
    rows = [(1, 200, "text/html; x"), (2, 404, "text/html"), (3, 200, "application/pdf")]
    df = spark.createDataFrame(rows, "page_id int, status int, content_type string")
    assert [r["page_id"] for r in X.usable_pages(df).collect()] == [1]


def test_contacts_need_few_fields_of_an_entry(spark):
    page = '<table><tr><td>Ana Gil</td><td>ANA@uc3m.es</td></tr></table><p>Eva Ruiz <a href="mailto:eva@uc3m.es">e-mail</a></p><div class="x"><h3>José Mas</h3> <i>jo@uc3m.es</i></div>'
    pages = spark.createDataFrame([(1, "u", page), (2, "v", None)], "page_id long, url string, html string")
    hits = A.near_hits(("uc3m.es",))
    whole = H.dom(pages).select("url", "_error", H.anchor_structs(""), hits).collect()
    few = H.dom(pages, fields=(*H.LINK_FIELDS, *A.CONTACT_FIELDS))
    assert few.select("url", "_error", H.anchor_structs(""), hits).collect() == whole and len(whole[0][3]) == 3
    assert H.dom(pages, parts=("nodes", "clean"), fields=H.LINK_FIELDS).select("url", "_error", H.anchor_structs("")).collect() == [r[:3] for r in whole]
    assert set(few.schema["nodes"].dataType.elementType.names) == {*H.LINK_FIELDS, *A.CONTACT_FIELDS}
