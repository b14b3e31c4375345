"""De-duplication, merges, index, streams, sources and sinks: properties that must hold."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mailweave import schemas
from mailweave.operators import dedup, extract, merge, report
from mailweave.plans import crm, curate, quality
from mailweave.sources import sinks, tables
from mailweave.streaming import first_seen, upsert

CONTACT_COLUMNS = "source_url string, full_name string, first_name string, last_name string, email_found string, email_generated string, method string, confidence double, notes string, seq long"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def people(spark):
    data = [(i % 7, None if i % 3 == 0 else f"n{i % 5}", i) for i in range(200)]
    return spark.createDataFrame(data, "k int, name string, seq int")


@pytest.mark.parametrize("op", [
    lambda d: dedup.first_per_key(d, "k", "seq"),
    lambda d: dedup.first_named_per_email(d, "k", "name"),
    lambda d: dedup.best_named_per_email(d, "k", "name"),
])
def test_dedup_is_idempotent_and_ignores_row_order(people, op):
    once = op(people)
    assert rows(op(once)) == rows(once)
    assert rows(op(people.orderBy(F.desc("seq")).repartition(13))) == rows(once)
    assert once.count() == 7


def test_top_n_is_exact_for_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("v"))
    got = dedup.first_n_per_key(df, "k", "v", 20, salts=5).filter("k = 1").orderBy("rank").collect()
    want = sorted(-i for i in range(5000) if i % 3 > 0 or i == 1)[:20]
    assert [r["v"] for r in got] == want and [r["rank"] for r in got] == list(range(1, 21))


def test_index_splits_hot_addresses_without_losing_urls(spark):
    pairs = spark.createDataFrame([("hot@x.es", f"u{i:03}") for i in range(50)] * 2 + [("a@x.es", "u2"), ("a@x.es", "u1")], "email string, url string")
    whole = {r["email"]: r["found_on_urls"] for r in extract.inverted_index(pairs).collect()}
    assert whole["a@x.es"] == "u1 | u2" and len(whole["hot@x.es"].split(" | ")) == 50
    split = extract.inverted_index(pairs, urls_per_row=7).collect()
    parts = [r["found_on_urls"].split(" | ") for r in split if r["email"] == "hot@x.es"]
    assert len(parts) > 1 and sorted(u for p in parts for u in p) == [f"u{i:03}" for i in range(50)]


def contacts(spark, n=30):
    data = [(f"u{i % 4}", None if i % 2 else f"Name {i % 3}", None, None, f"e{i % 5}@x.es", None, "m", 1.0, "n", i) for i in range(n)]
    return spark.createDataFrame(data, CONTACT_COLUMNS)


def test_contact_upsert_composes(spark):
    df = contacts(spark)
    a, b = df.filter("seq < 12"), df.filter("seq >= 12")
    whole = merge.upsert_contacts(None, df)
    first = merge.upsert_contacts(None, a)
    then = first.unionByName(merge.upsert_contacts(first, b))
    assert rows(then) == rows(whole)
    assert merge.upsert_contacts(whole, df).count() == 0


def test_profile_upsert_keeps_the_newest_known_value(spark):
    cols = "source_url string, full_name string, first_name string, last_name string, university string, department string, seq long"
    old = spark.createDataFrame([("u", "A B", "A", None, "U", "D", 900)], cols)
    new = spark.createDataFrame([("u", None, "X", "Y", None, None, 1), ("u", "C D", None, None, None, None, 2), ("v", None, None, None, None, None, 3)], cols)
    got = {r["source_url"]: tuple(r)[1:] for r in merge.upsert_profiles(old, new).collect()}
    assert got == {"u": ("C D", "X", "Y", "U", "D"), "v": (None,) * 5}


def test_crm_keeps_found_and_guessed_apart(spark):
    data = [
        ("u1", "Ana Gil", "Ana", "Gil", None, "agil@d.edu", "g", 0.5, "", 1), ("u1", None, None, None, "agil@d.edu", None, "f", 1.0, "", 2),
        ("u2", None, None, None, None, None, "x", 0.25, "", 3),
    ]
    c = merge.upsert_contacts(None, spark.createDataFrame(data, CONTACT_COLUMNS))
    p = spark.createDataFrame([("u2", "Eva Sanz Ruiz", None, None, None, None)], schemas.PROFILES)
    out = crm.export_crm(c, p, "U").collect()
    assert [f.name for f in schemas.CRM] == list(out[0].asDict())
    by_mail = {r["Email"]: r for r in out}
    assert by_mail["agil@d.edu"]["Nombre"] == "Ana" and (by_mail[""]["Nombre"], by_mail[""]["Apellidos"]) == ("Eva", "Ruiz")
    assert crm.export_crm(c, p, "U", found_only=True).count() == 1


def test_numeric_department_ids_meet_the_map(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text('departamento,profesor,email\n137,Ana Gil,ana@x.es\n138,,"b.perez, eva.ruiz@x.es"\n139,"Gil ""P"" Bo",no\n', encoding="utf-8")
    (tmp_path / "map.json").write_text(json.dumps({"137": "Física"}, ensure_ascii=False, indent=2), encoding="utf-8")
    raw = tables.read_contacts_csv(spark, str(csv)).withColumn("seq", F.monotonically_increasing_id())
    assert dict(raw.dtypes)["departamento"] == "string" and raw.filter("profesor IS NULL").count() == 1
    dep_map = tables.read_department_map(spark, str(tmp_path / "map.json"))
    out = [tuple(r) for r in curate.curate(raw, dep_map).collect()]
    assert out == [("138", "Eva Ruiz", "eva.ruiz@x.es"), ("Física", "Ana Gil", "ana@x.es")]


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", "x" if i < 1 else None, "e") for i in range(16)] + [("b", None, "e"), ("c", "x", "e")], "departamento string, profesor string, email string")
    got = {r["departamento"]: r["%_con_nombre"] for r in report.coverage(df).collect()}
    assert got == {"a": 6.2, "b": 0.0, "c": 100.0}  # 6.25 exactly


def test_quality_report_figures(spark):
    df = spark.createDataFrame([("d", "A B", "a@x.es"), ("d", None, "b@uc3m.es"), (None, None, "c@uc3m.es.ficha")], "departamento string, profesor string, email string")
    got = {(r["section"], r["item"]): r["value"] for r in quality.quality_report(df, "uc3m.es").collect()}
    assert got[("summary", "foreign_emails")] == 2 and got[("summary", "malformed_emails")] == 1
    assert got[("summary", "departamentos_unicos")] == 1 and got[("coverage", "d")] == 50.0 and got[("size", "d")] == 2


def test_seeds(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" http://a \n\n\t\nhttp://b\n")
    assert [r[0] for r in tables.read_seeds(spark, str(tmp_path / "s.txt")).collect()] == ["http://a", "http://b"]
    assert tables.default_seeds(spark).count() == 3


def test_sorted_csv_files_read_back_in_order(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lpad((F.col("id") * 7919 % 2000).cast("string"), 4, "0"), F.lit("@x.es")).alias("email"), F.lit('a | "b"').alias("found_on_urls"))
    sinks.write_email_index(df, str(tmp_path / "out"))
    lines = []
    for name in sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part")):
        lines += (tmp_path / "out" / name).read_text().splitlines()[1:]
    assert lines == sorted(lines) and len(lines) == 2000 and lines[0] == '0000@x.es,"a | ""b"""'


def test_map_is_written_only_when_something_changed(spark, tmp_path):
    m = spark.createDataFrame([("1", "Física")], "dep_id string, nombre string")
    assert sinks.write_department_map(m, str(tmp_path / "m"), m.filter("false")) is False
    assert not os.path.exists(tmp_path / "m")
    assert sinks.write_department_map(m, str(tmp_path / "m"), m) is True


def test_streamed_contacts_equal_the_batch_and_replays_change_nothing(spark, tmp_path):
    df = contacts(spark)
    sink, path = upsert.contact_sink(str(tmp_path / "t")), str(tmp_path / "t")
    for batch, part in enumerate((df.filter("seq < 10"), df.filter("seq BETWEEN 10 AND 19"), df.filter("seq > 19"))):
        sink(part, batch)
    once = rows(spark.read.parquet(path).select("id", "seq"))
    assert once == rows(merge.upsert_contacts(None, df).select("id", "seq"))
    sink(df.filter("seq > 19"), 2)  # the last batch again, as after a failure
    assert rows(spark.read.parquet(path).select("id", "seq")) == once


def test_profile_log_over_batches(spark, tmp_path):
    cols = "source_url string, full_name string, first_name string, last_name string, university string, department string, seq long"
    path = str(tmp_path / "p")
    sink = upsert.profile_sink(path)
    sink(spark.createDataFrame([("u", "A", "F", None, None, None, 9)], cols), 0)
    sink(spark.createDataFrame([("u", None, "G", None, None, None, 1), ("u", None, "H", None, None, None, 2)], cols), 1)
    sink(spark.createDataFrame([("u", None, "G", None, None, None, 1), ("u", None, "H", None, None, None, 2)], cols), 1)
    assert tuple(upsert.current_profiles(spark, path).collect()[0])[:3] == ("u", "A", "H")
    upsert.compact_profiles(spark, path, str(tmp_path / "q"))
    assert rows(upsert.current_profiles(spark, str(tmp_path / "q"))) == rows(upsert.current_profiles(spark, path))


def test_first_seen_stream(spark, tmp_path):
    texts = [(1, "a@x.es b@x.es"), (2, "A@X.es c@x.es"), (3, "none"), (4, "b@x.es")]
    for i, row in enumerate(texts):
        spark.createDataFrame([row], "id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (first_seen.first_seen_emails(stream, "text").writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert sorted(r["email"] for r in spark.read.parquet(str(tmp_path / "out")).select("email").collect()) == ["a@x.es", "b@x.es", "c@x.es"]
