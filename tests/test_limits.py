"""What grows with the data stays whole: walks, the index, suffix rules, upsert runs, look-alike domains, links, plans."""

import inspect
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from mailweave.functions import emails as em
from mailweave.functions import urls as u
from mailweave.operators import association, departments, extract, html, lookup, robots, walk
from mailweave.plans import email_index
from mailweave.siteprofile import SiteProfile
from mailweave.sources import sinks, tables
from mailweave.streaming import upsert

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SITE = SiteProfile("a.es", "https://www.a.es", ("a.es",), "University A", "A")


def test_a_long_chain_is_walked_whole(spark):
    n = 40  # beyond two compactions of the levels
    links = spark.createDataFrame([(f"http://h/{i}", f"http://h/{i + 1}", 0) for i in range(n)], "url string, target string, pos int")
    seeds = spark.createDataFrame([("w", "http://h/0", 0)], "walk string, url string, seed_no int")
    assert "max_levels" not in inspect.signature(walk.walk).parameters
    assert walk.walk(links, seeds, None).count() == n + 1


def test_an_empty_walk_has_no_rows(spark):
    links = spark.createDataFrame([], "url string, target string, pos int")
    seeds = spark.createDataFrame([], "walk string, url string, seed_no int")
    assert walk.walk(links, seeds, 5).count() == 0


def test_index_parts_are_ranges_of_the_sorted_urls(spark):
    pairs = spark.createDataFrame([("hot@x.es", f"u{i:03}") for i in range(50)] * 2 + [("a@x.es", "u2"), ("a@x.es", "u1")], "email string, url string")
    for size in (7, 25, 50, 100_000):
        rows = {(r.email, r.part): r.urls for r in extract.url_sets(pairs, urls_per_row=size).collect()}
        assert rows[("a@x.es", 0)] == ["u1", "u2"]
        hot = [rows[("hot@x.es", p)] for p in range(-(-50 // size))]
        assert sum(hot, []) == [f"u{i:03}" for i in range(50)] and all(len(p) == min(size, 50) for p in hot[:-1])
        assert len(rows) == len(hot) + 1
    assert extract.inverted_index(pairs).columns == ["email", "part", "found_on_urls"]
    assert extract.url_sets(pairs.limit(0)).count() == 0


def test_suffix_rules(spark, evaluate, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\n\ncom\njp\n*.kawasaki.jp\n!city.kawasaki.jp\na.b.c.d.com  trailing\n")
    rules = tables.read_suffixes(spark, str(tmp_path / "rules.dat"))
    assert set(rules) == {"com", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "a.b.c.d.com"}
    cases = {
        "http://x.y.com/": "y.com", "http://www.x.foo.kawasaki.jp": "x.foo.kawasaki.jp", "http://www.city.kawasaki.jp": "city.kawasaki.jp",
        "http://city.kawasaki.jp": "city.kawasaki.jp", "http://p.q.a.b.c.d.com": "q.a.b.c.d.com", "http://z.unknown": "z.unknown", "http://one": "one", "": "", None: None,
    }
    assert evaluate(lambda c: u.registered_domain(c, rules), list(cases)) == list(cases.values())


def test_one_domain_rule(evaluate):
    mails = ["z@a.es", "z@inf.a.es", "z@a.es.evil.com", "z@nota.es", "z@b.es"]
    ours = [True, True, False, False, False]
    assert evaluate(lambda c: em.at_domains(c, ("a.es",)), mails) == ours
    assert evaluate(lambda c: ~em.foreign(c, "a.es"), mails) == ours
    assert evaluate(lambda c: em.clean_domain_email(c, ("a.es",)).isNotNull(), mails) == ours


def test_look_alikes_are_refused_everywhere(spark):
    page = '<h1>x</h1><p>Ana Gil <a href="mailto:ana@a.es.evil.com">m</a></p><p>Eva Ruiz eva@inf.a.es</p>'
    pages = spark.createDataFrame([(1, "http://p", page)], "page_id long, url string, html string")
    assert {r.email for r in association.page_contacts(html.dom(pages), SITE.email_domains, ("url",), SITE.strict).collect()} == {"eva@inf.a.es"}
    assert {r.email for r in extract.clean_emails_in_text(pages, "html", SITE.email_domains, ("url",)).collect()} == {"eva@inf.a.es"}
    assert departments.cards(html.dom(pages), SITE, ("url",)).first().mail is None
    loose = SiteProfile("a.es", "https://www.a.es", ("a.es",), "A", "A", strict=False)
    assert departments.cards(html.dom(pages), loose, ("url",)).first().mail == "ana@a.es.evil.com"


def test_site_fields_have_no_default_of_another_site():
    with pytest.raises(TypeError):
        SiteProfile(domain="x.edu")


def test_fast_links_equal_the_parser(spark):
    markup = [
        """<a href="/o'neil/x">a</a><a class=q href=/plain>b</a><a href='/single"q'>c</a>""",
        '<a href="/a?x=1&amp;y=2">d</a><a href="/q?&quot;&lt;&gt;&#39;">e</a><a name="n">no</a>',
        '<a href="/caf&eacute;/&#233;">f</a><a href=/x&copy;>g</a>',
        "<p>none</p>",
    ]
    pages = spark.createDataFrame(list(enumerate(markup)), "page_id long, html string").withColumn("url", F.lit("u"))
    fast = {(r.page_id, r.href) for r in html.anchor_links(pages).collect()}
    assert fast == {(r.page_id, r.href) for r in html.anchors(html.dom(pages)).collect()}


def test_robots_rules_are_one_join(spark):
    urls = spark.createDataFrame([("http://h/a/x",), ("http://h/b",), ("http://free/x",), ("http://none/x",), ("http://h/a/ok/1",)], "url string")
    rows = [("h", "*", "/a/ok", True, 1), ("h", "*", "/a", False, 2), ("free", "other", "/", False, 1)]
    rules = spark.createDataFrame(rows, "host string, agent string, path_prefix string, allow boolean, rule_no int")
    assert {r.url for r in robots.allowed(urls, rules, "bot/1").collect()} == {"http://h/b", "http://free/x", "http://h/a/ok/1"}
    ready = spark.createDataFrame(robots.prepared(rules, "bot").collect(), robots.prepared(rules, "bot").schema)
    plan = robots.allowed_by(urls, ready)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_map_written_is_map_read(spark, tmp_path):
    names = [("1", "Física"), ("2", 'quo"te, brace}'), ("x y", "Depar{tamento"), ("3", None)]
    sinks.write_department_map(spark.createDataFrame(names, "dep_id string, nombre string"), str(tmp_path / "m"))
    assert sorted(map(tuple, tables.read_department_map(spark, str(tmp_path / "m")).collect()), key=repr) == sorted(names, key=repr)
    (tmp_path / "one.json").write_text('{"1": "a", "2": "b"}')
    assert sorted(map(tuple, tables.read_department_map(spark, str(tmp_path / "one.json")).collect())) == [("1", "a"), ("2", "b")]


COLS = "source_url string, full_name string, first_name string, last_name string, university string, department string, seq long"


def _stream(spark, rows, folder, sink, checkpoint):
    spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(folder)
    upsert.upsert_stream(stream, sink, checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    path, sink = str(tmp_path / "t"), upsert.profile_sink(str(tmp_path / "t"))
    _stream(spark, [("a", "A", None, None, None, None, 9)], str(tmp_path / "in1"), sink, str(tmp_path / "c1"))
    _stream(spark, [("a", None, "F", None, None, None, 9)], str(tmp_path / "in1"), sink, str(tmp_path / "c1"))  # the same run goes on
    _stream(spark, [("b", "B", None, None, None, None, 1), ("a", "A2", None, None, None, None, 1)], str(tmp_path / "in2"), sink, str(tmp_path / "c2"))
    got = {r.source_url: (r.full_name, r.first_name) for r in upsert.current_profiles(spark, path).collect()}
    assert got == {"a": ("A2", "F"), "b": ("B", None)}
    base = str(tmp_path / "base")
    upsert.compact_profiles(spark, path, base)
    _stream(spark, [("c", "C", None, None, None, None, 1)], str(tmp_path / "in3"), upsert.profile_sink(base), str(tmp_path / "c3"))
    assert {r.source_url for r in upsert.current_profiles(spark, base).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("few, listed", [(200_000, 64), (3, 64), (3, 0), (0, 1)])
def test_html_is_not_shuffled_for_a_set_of_urls(spark, tmp_path, monkeypatch, few, listed):
    monkeypatch.setattr(lookup, "LISTED", listed)
    monkeypatch.setattr(lookup, "BITS_PER_KEY", 2)  # many pass by mistake, so that several filters are needed
    pages = [(i, f"u{i % 500}" if i % 7 else None, f"<p>{i}</p>") for i in range(2000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    keys = spark.createDataFrame([(f"u{i}",) for i in range(0, 900, 3)] * 3 + [(None,)], "url string")
    found = lookup.rows_among(table, keys, "url", few)
    want = {i for i, u, _ in pages if u and int(u[1:]) % 3 == 0}
    got = found.collect()
    assert found.columns == table.columns and sorted(r.page_id for r in got) == sorted(want)
    assert lookup.rows_among(table, keys.limit(0), "url", few).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("html#") and not any("html" in line for line in plan.splitlines() if "Exchange" in line)


def test_two_million_urls_are_one_scan(spark, tmp_path):
    spark.range(3000).selectExpr("id AS page_id", "concat('https://h/', id * 1000) AS url", "repeat('<p>', 50) AS html").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    keys = spark.range(2_000_000).selectExpr("concat('https://h/', id) AS url")
    found = extract.pages_among(pages, keys)
    assert found.count() == 2000 and found.agg(F.sum(F.length("html"))).first()[0] == 2000 * 150
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("FileScan" in line and "html" in line for line in lines) == 1
    assert not any("Exchange" in line and "html" in line for line in lines)


def test_the_index_reads_pages_once(spark):
    pages = spark.createDataFrame([(1, "https://www.a.es/", '<a href="/p">p</a> x@a.es <a href="mailto:y&#64;a.es">y</a>'), (2, "https://www.a.es/p", "z@a.es x@a.es"), (3, "https://www.a.es/q", "no@a.es")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://www.a.es/", 0)], "url string, seed_no int")
    rows = {(r.email, r.part): r.found_on_urls for r in email_index.email_index(pages, seeds, SITE, None).index.collect()}
    assert rows == {("x@a.es", 0): "https://www.a.es/ | https://www.a.es/p", ("y@a.es", 0): "https://www.a.es/", ("z@a.es", 0): "https://www.a.es/p"}


def test_entry_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert e.entry(spark).count() > 0
assert e.queries()["x1_elements_by_tag"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=300)


def _page(spark, html_text):
    return html.dom(spark.createDataFrame([(1, "u", html_text)], "page_id long, url string, html string"))


def test_pages_of_unclosed_tags_are_linear(spark):
    n = 50_000
    began = time.monotonic()
    rows = html.nodes(_page(spark, "<p>x" * n)).select("page_id", "node_id", "last_id", "depth", "tag").cache()
    assert rows.agg(F.count("*"), F.max("depth")).first() == (2 * n, n)
    roots = rows.filter("tag = 'p' AND node_id % 5000 = 0")
    found = {r.root_id: r["count"] for r in html.subtree_members(rows, roots).groupBy("root_id").count().collect()}
    assert found == {i: 2 * n - 1 - i for i in range(0, 2 * n, 5000)}
    row = _page(spark, "<p>x" * n + "<b>y").select(F.size(html.select_nodes("p p b")).alias("b"), F.size(html.select_nodes("p i, b")).alias("i")).first()
    assert (row.b, row.i) == (1, 1) and time.monotonic() - began < 90


def test_intervals_meet_every_descendant_once(spark):
    import random

    rng, parts = random.Random(4), []
    for _ in range(700):
        parts.append(rng.choice(["<div>", "<p>", "</div>", "</p>", "x", "<br>", "<i>y</i>"]))
    rows = html.nodes(_page(spark, "".join(parts))).select("page_id", "node_id", "parent_id", "last_id").collect()
    parent = {r.node_id: r.parent_id for r in rows}
    want = set()
    for i in parent:
        up = parent[i]
        while up >= 0:
            want.add((up, i))
            up = parent[up]
    df = spark.createDataFrame(rows)
    got = [(r.root_id, r.node_id) for r in html.subtree_members(df.select("page_id", "node_id"), df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("step, rest", [("<div>", ""), ("<p>x", "Ana Gil "), ("<div>\n<span>", "Ana Gil ")])
def test_climbs_are_linear_in_depth(spark, step, rest):
    depth = 20_000
    page = step * depth + rest + '<a href="mailto:a@a.es">a@a.es</a> b@a.es'
    began = time.monotonic()
    climbed = association.climbed_contacts(_page(spark, page), ("url",)).collect()
    near = association.page_contacts(_page(spark, page), ("a.es",), ("url",)).collect()
    assert {r.email for r in climbed} == {r.email for r in near} == {"a@a.es", "b@a.es"}
    assert time.monotonic() - began < 60


def test_nothing_beside_the_arguments_decides_the_plan(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    assert "Exchange" not in html.dom(pages)._jdf.queryExecution().executedPlan().toString()
