"""Look-ups, walks, streams and reports whose work must not grow with what is already there."""

import random

import pytest
from pyspark.sql import functions as F

from mailweave.functions import urls as u
from mailweave.operators import dedup, domains, html, report, robots, walk
from mailweave.plans import departments, directory, email_index
from mailweave.registry import core, streams, webs
from mailweave.siteprofile import SiteProfile
from mailweave.sources import sinks, tables
from mailweave.streaming import first_seen, upsert

RULES = ["com", "at", "ac.at", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "a.b.c.d.com", "*.ck", "!www.ck"]


def test_longest_match_join_equals_the_expression(spark):
    rng = random.Random(3)
    labels = ["com", "at", "ac", "jp", "kawasaki", "city", "a", "b", "c", "d", "ck", "www", "x"]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 7))) + "/p" for _ in range(600)] + ["", None, "http://u@X.AC.AT:8080/"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "i int, url string")
    rules = domains.suffix_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))
    one = {r.i: r.domain for r in domains.registered_domains(df, "url", rules).collect()}
    two = {r.i: r.domain for r in df.withColumn("domain", u.registered_domain(F.col("url"), RULES)).collect()}
    assert one == two and one[len(urls) - 1] == "x.ac.at"
    assert domains.registered_domains(df.limit(0), "url", rules).columns == ["i", "url", "domain"]


@pytest.mark.parametrize("domain, host, other", [("x.ac.at", "www.x.ac.at", "www.y.ac.at"), ("uni.z.kawasaki.jp", "d.uni.z.kawasaki.jp", "z.kawasaki.jp"), ("city.kawasaki.jp", "www.city.kawasaki.jp", "www.x.kawasaki.jp")])
def test_directory_by_a_table_of_suffixes(spark, tmp_path, domain, host, other):
    (tmp_path / "rules.dat").write_text("// list\n" + "\n".join(RULES))
    rules = tables.read_suffix_table(spark, str(tmp_path / "rules.dat"))
    site = SiteProfile(domain, f"https://www.{domain}", (domain,), "X", "X")
    pages = [(1, f"https://{host}/l", f'<div class="view-content"><div class="views-row"><h3>Ana Gil</h3> a@{domain}</div></div>'), (2, f"https://{other}/l", f"b@{domain}"), (3, f"https://{host}/none", None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = directory.extract_directory(pages, pages.select("url"), site, suffixes=rules)
    assert {r.email_found for r in found.contacts.collect() if r.email_found} == {f"a@{domain}"}
    assert [tuple(r) for r in found.failed.collect()] == [("no html", 1)]


SITE = SiteProfile("a.es", "https://www.a.es", ("a.es",), "A", "A")
MARK = SITE.department_marker
WEB = [
    (1, "https://www.a.es/list", f'<ul><li><a href="{MARK}/7/x">Física</a></li><li><a href="/other">Derecho Penal</a></li></ul>'),
    (2, f"https://www.a.es{MARK}/7/x", '<a href="mailto:fis@a.es">m</a><dl><dt>Web del departamento</dt><dd><a href="https://f.a.es/">w</a></dd></dl><a href="/personal/1">Personal</a>'),
    (3, "https://f.a.es/", '<p>Ana Gil ana@a.es</p>\n<a href="https://f.a.es/broken">b</a> <a href="https://f.a.es/staff">staff</a>'),
    (4, "https://f.a.es/broken", None),
    (5, "https://f.a.es/staff", "<ul><li>Eva Ruiz eva@a.es</li></ul>"),
    (6, "https://www.a.es/personal/1", "<table><tr><td>Bo Li</td><td>bo@a.es</td></tr></table>"),
    (7, "https://www.a.es/dir", None),
]


def test_plans_report_pages_that_fail(spark):
    pages = spark.createDataFrame(WEB, "page_id long, url string, html string")
    lists, dirs = pages.filter("page_id = 1").select("url"), pages.filter("page_id IN (1, 7)").select("url")
    seeds = spark.createDataFrame([("https://f.a.es/", 0)], "url string, seed_no int")
    runs = [
        (departments.contacts_by_structure(pages, lists, dirs, SITE), {"bo@a.es"}),
        (departments.contacts_by_walk(pages, lists, SITE), {"fis@a.es", "ana@a.es", "eva@a.es"}),
        (departments.contacts_clean(pages, lists, SITE), {"fis@a.es", "ana@a.es", "eva@a.es"}),
    ]
    for run, want in runs:
        column = "correo" if "correo" in run.contacts.columns else "email"
        assert {r[column] for r in run.contacts.collect()} == want
        assert [tuple(r) for r in run.failed.collect()] == [("no html", 1)]
    index = email_index.email_index(pages, seeds, SITE, None)
    assert {r.email for r in index.index.collect()} == {"ana@a.es", "eva@a.es"}
    assert [tuple(r) for r in index.failed.collect()] == [("no html", 2)]


def test_plans_read_a_page_once_for_links_and_contacts(spark, tmp_path, monkeypatch):
    spark.createDataFrame(WEB, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages, calls = spark.read.parquet(str(tmp_path / "p")), []
    real = html.dom
    monkeypatch.setattr(html, "dom", lambda *a, **k: calls.append(1) or real(*a, **k))
    lists = pages.filter("page_id = 1").select("url")
    for plan, scans in ((departments.contacts_by_structure, 3), (departments.contacts_by_walk, 3), (departments.contacts_clean, 3)):
        calls.clear()
        plan(pages, lists, *([None] if plan is departments.contacts_by_structure else []), SITE)
        assert len(calls) == scans


def test_a_step_is_counted_while_it_runs(spark):
    runs = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    raw = spark.range(100).mapInArrow(rows, "id long")
    after, figures = report.counted_step(raw, lambda df: df.filter("id % 3 = 0"))
    assert after.count() == 34 and [tuple(r) for r in figures.collect()] == [(100, 34, 66)] and runs.value == 100
    empty = report.counted_step(raw.filter("id < 0"), lambda df: df)[1]
    assert [tuple(r) for r in empty.collect()] == [(0, 0, 0)]


def test_ranks_over_ranges(spark, monkeypatch):
    rows = [(k, i) for k, n in (("hot", 5000), ("a", 3), ("b", 1)) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = dedup.ranked_per_key(df, "k", "v")
        assert ranked.filter("rank <> v + 1").count() == 0 and ranked.count() == len(rows)
        monkeypatch.setattr(dedup, "RANKED_IN_ONE_TASK", 10)
        first = dedup.first_n_per_key(df, "k", "v", 700)
        assert first.groupBy("k").agg(F.max("rank")).collect() and first.count() == 704
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_visited_pages_are_only_added_to(spark):
    links = [(f"h{i}", f"h{j}", k) for i in range(24) for k, j in enumerate((i + 1, max(0, i - 3), i // 2)) if j < 24]
    links = spark.createDataFrame(links, "url string, target string, pos int")
    seeds = spark.createDataFrame([("w", "h0", 0), ("v", "h12", 0)], "walk string, url string, seed_no int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    merged = {(r.walk, r.url): (r.level, tuple(r.trail), r.ord) for r in walk.walk(walk.co_locate(links), seeds, 9, compact_every=2).collect()}
    plain = {(r.walk, r.url): (r.level, tuple(r.trail), r.ord) for r in walk.walk(links, seeds, 9, compact_every=100).collect()}
    assert merged == plain and len(merged) == 18 and spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_visited_is_not_shuffled(spark):
    visited, level = walk._Visited(fan=2), spark.createDataFrame([("w", "a"), ("w", "b")], "walk string, url string")
    for _ in range(4):
        visited.add(level)
    assert [size for size, _ in visited.runs] == [2] and not visited.levels
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = visited.without(spark.createDataFrame([("w", "a"), ("w", "c")], "walk string, url string"))
        assert [r.url for r in left.collect()] == ["c"]
        assert left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_clean_files_are_one_write_in_order(spark, tmp_path):
    rows = [(d, n, f"{d}{n}@x") for d in "cab" for n in ("z", None, "a", "m")] * 2
    sinks.write_clean(spark.createDataFrame(rows, "departamento string, profesor string, email string").repartition(3), str(tmp_path / "k"))
    everything, named = tables.read_clean(spark, str(tmp_path / "k")), tables.read_clean(spark, str(tmp_path / "k"), True)
    key = lambda r: (r[0], r[1] is None, r[1] or "", r[2])
    assert sorted(map(tuple, everything.collect()), key=key) == sorted(rows, key=key)
    assert sorted(map(tuple, named.collect())) == sorted(r for r in rows if r[1])
    lines = [line for f in sorted((tmp_path / "k" / "has_name=true").glob("*.csv")) for line in f.read_text().splitlines()[1:]]
    assert lines == sorted(lines) and len(lines) == 18


COLS = "ts timestamp, text string"


def _emails(spark, folder, out, state, delay):
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(folder)
    found = first_seen.first_seen_emails(stream, "text", *(("ts", delay) if delay else ()))
    run = found.select("email").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    return first_seen.LateRows(run.trigger(availableNow=True).start()).wait()


def _append(spark, rows, folder):
    spark.createDataFrame(rows, "ts string, text string").selectExpr("CAST(ts AS timestamp) AS ts", "text").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("delay, late, again", [("1 hour", 1, 2), (None, 0, 0)])
def test_first_seen_reports_late_rows_and_restarts(spark, tmp_path, delay, late, again):
    first_seen.keep_state_on_disk(spark)
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    _append(spark, [("2024-01-01 10:00:00", "a@x.es b@x.es"), ("2024-01-01 10:10:00", "a@x.es")], src)
    assert _emails(spark, src, out, state, delay) == 0
    _append(spark, [("2024-01-01 18:00:00", "c@x.es")], src)
    assert _emails(spark, src, out, state, delay) == 0
    _append(spark, [("2024-01-01 11:00:00", "late@x.es"), ("2024-01-01 18:30:00", "d@x.es c@x.es")], src)  # a new process, the same checkpoint
    assert _emails(spark, src, out, state, delay) == late
    got = sorted(r.email for r in spark.read.parquet(out).collect())
    assert got == sorted(["a@x.es", "b@x.es", "c@x.es", "d@x.es"] + (["late@x.es"] if not late else []))


def test_an_event_time_needs_a_delay(spark):
    with pytest.raises(ValueError):
        first_seen.first_seen_emails(spark.createDataFrame([], COLS), "text", "ts")


CONTACT = "source_url string, full_name string, first_name string, last_name string, email_found string, email_generated string, method string, confidence double, notes string, seq long"


def _contact(i, seq=0):
    return (f"u{i}", f"N{i}", None, None, f"e{i}@x.es", None, "m", 1.0, None, seq)


def test_a_batch_of_contacts_reads_its_buckets(spark, tmp_path):
    path, base = str(tmp_path / "t"), str(tmp_path / "base")
    sink = upsert.contact_sink(path, buckets=16)
    sink(spark.createDataFrame([_contact(i) for i in range(200)] * 2, CONTACT), 0)
    sink(spark.createDataFrame([_contact(5, 1), _contact(500, 1), _contact(500, 2)], CONTACT), 1)
    sink(spark.createDataFrame([_contact(5, 1), _contact(500, 1)], CONTACT), 1)  # a replay
    now = upsert.current_contacts(spark, path)
    assert now.count() == now.select("id").distinct().count() == 201
    assert len(list((tmp_path / "t" / "run=0" / "batch_id=0").glob("bucket=*"))) == 16
    assert len(list((tmp_path / "t" / "run=0" / "batch_id=1").glob("bucket=*"))) == 1
    upsert.compact_contacts(spark, path, base)
    assert upsert.current_contacts(spark, base).count() == 201
    assert all(len(list(b.glob("*.parquet"))) == 1 for b in (tmp_path / "base" / "run=-1" / "batch_id=0").glob("bucket=*"))
    upsert.contact_sink(base, buckets=4)(spark.createDataFrame([_contact(7), _contact(900)], CONTACT), 0)  # the table's own number of buckets holds
    assert upsert.current_contacts(spark, base).count() == 202


def test_first_seen_texts_stay_in_their_splits(spark, tmp_path, monkeypatch):
    docs = [(i, f"s{i}", f"u{i % 9}@x.es and w{i}@y.es") for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "http://p", "<p>p@x.es</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = []
    monkeypatch.setattr(streams, "scratch", lambda s: made.append(core.scratch(s)) or made[-1])
    for few, least in ((core._FEW, 1), (0, 5)):
        monkeypatch.setattr(core, "_FEW", few)
        made.clear()
        found = sorted(r.email for r in streams.st1(spark, str(tmp_path)).collect())
        assert found == sorted({*(f"u{i % 9}@x.es" for i in range(24)), *(f"w{i}@y.es" for i in range(24)), "p@x.es"})
        assert len(spark.read.parquet(made[0]).inputFiles()) >= least


def test_a_log_is_split_by_many_tasks_and_streams_in_order(spark, tmp_path):
    spark.range(1000).selectExpr("id AS event_id").write.parquet(str(tmp_path / "events.parquet"))
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        parts, schema = streams._split_log(spark, str(tmp_path), "SELECT event_id AS seq FROM {events}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    rows = [sorted(r.seq for r in spark.read.parquet(p).collect()) for p in parts]
    assert sum(rows, []) == list(range(1000)) and all(100 < len(r) < 400 for r in rows)
    assert all(len(spark.read.parquet(p).inputFiles()) == 3 for p in parts)
    seen = []
    streams._run_twice(spark, parts, schema, lambda batch, number: seen.append((number, sorted(r.seq for r in batch.collect()))))
    assert seen == list(zip((0, 1, 0, 1), rows))


def test_a_bucket_of_a_batch_is_not_a_file_from_every_task(spark, tmp_path):
    batch = spark.createDataFrame([_contact(i) for i in range(200)], CONTACT)
    upsert.contact_sink(str(tmp_path / "t"), buckets=4)(batch, 0)
    assert len(list((tmp_path / "t").glob("run=0/batch_id=0/bucket=*/*.parquet"))) == 4


def test_robots_rules_of_one_host_are_rows(spark):
    ends = ["", *"abcdefgh"]
    rules = [("h", "*", f"/{a}{b}", (i + j) % 3 == 0, (7 * i + 5 * j) % 11) for i, a in enumerate(ends) for j, b in enumerate(ends) if a or not b]
    rules += [("h", "*", None, False, 0), ("h", "*", "/a/b/c", None, -1), ("free", "other", "/", False, 1)]
    df = spark.createDataFrame(rules, "host string, agent string, path_prefix string, allow boolean, rule_no int")
    urls = [f"http://h/{a}{b}{c}" for a in ends for b in ends for c in ("", "x", "/b/c")] + ["http://free/x", "http://none/x", "http://h", None, "http://h/q", "http://h/q"]

    def allowed(url):
        host, _, path = (url or "http://none")[7:].partition("/")
        own = sorted((no, prefix, allow) for h, agent, prefix, allow, no in rules if h == host and agent == "*" and prefix is not None and f"/{path}".startswith(prefix))
        return host in ("h", "free") and (not own or own[0][2] is not False)

    ready = robots.prepared(df, "bot")
    assert ready.count() == len({r[2] for r in rules if r[0] == "h" and r[2] is not None}) + 2  # no host has a list
    got = robots.allowed_by(spark.createDataFrame([(u,) for u in urls], "url string"), ready)
    assert sorted(r.url for r in got.collect()) == sorted(u for u in urls if allowed(u))


def test_derived_pages_of_large_tables_lie_in_equal_parts(spark, tmp_path, monkeypatch):
    for name, columns in (("customer", "id AS c_custkey, id % 3 AS c_nationkey"), ("supplier", "id AS s_suppkey"), ("nation", "id AS n_nationkey, 'N' AS n_name")):
        rows = spark.range({"customer": 900, "supplier": 60, "nation": 3}[name]).selectExpr(*columns.split(", "))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "customer.parquet").glob("part-*"))
    monkeypatch.setattr(core, "_FEW", size // (2 * spark.sparkContext.defaultParallelism))  # a large table: twice as much for each core
    pages = webs.everything(spark, str(tmp_path))
    parts = [r["count"] for r in pages.groupBy(F.input_file_name()).count().collect()]
    assert len(parts) > spark.sparkContext.defaultParallelism and max(parts) < 2 * sum(parts) / len(parts)
    assert pages.count() == webs.everything.make(spark, str(tmp_path)).count()
