"""Sharding: laws of the shards, order and repeatability."""

import zlib

import pytest
from pyspark.sql import functions as F

from mailweave.llm.sharding import grown_shard, op3_sharding, shard_of, shuffle_into_shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, None if i % 7 == 0 else "same" if i % 3 == 0 else f"text é {i}" * (i % 5), "shard", i) for i in range(400)]
    rows += [(None, "x", "a", 1), (None, None, None, None), (5, "again", "a", 1), (5, "again", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")


def test_every_record_once_and_slots_gapless(spark, docs, tmp_path):
    out = shuffle_into_shards(docs, str(tmp_path / "a"), bucket_bytes=200).collect()
    assert sorted(map(repr, (tuple(r.record) for r in out))) == sorted(map(repr, map(tuple, docs.collect())))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_repeatable_and_mixed(spark, docs, tmp_path):
    one, two = (sorted((r.shard, r.slot, repr(tuple(r.record))) for r in shuffle_into_shards(d, str(tmp_path / n), bucket_bytes=400).collect()) for n, d in (("b", docs), ("c", docs.repartition(7))))
    assert one == two
    many = shuffle_into_shards(spark.range(2000).selectExpr("id AS doc_id", "'t' AS text"), str(tmp_path / "d"), shards=1).orderBy("slot").collect()
    ids = [r.record.doc_id for r in many]
    assert ids != sorted(ids) and sum(abs(i - k) for k, i in enumerate(ids)) / 2000 > 500  # about a third of the length if uniform


def test_written_order_is_slot_order(spark, docs, tmp_path):
    shuffle_into_shards(docs, str(tmp_path / "e"))
    for part in (tmp_path / "e").glob("shard=*/*.parquet"):
        rows = spark.read.parquet(str(part)).select("bucket", "pos").collect()
        assert rows == sorted(rows)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(5000)
    for n in (1, 4, 24):
        rows = df.select(shard_of(df.id, n).alias("a"), grown_shard(df.id, n).alias("b"), shard_of(df.id, n + 1).alias("c")).collect()
        assert all(b in (a, n) and b == c for a, b, c in rows)
        assert 0.5 < sum(b == n for _, b, _ in rows) * (n + 1) / 5000 < 1.5


def test_query(spark):
    out = {r.doc_id: r for r in op3_sharding(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        assert (out[d.doc_id].size, out[d.doc_id].text_crc32, out[d.doc_id].law) == (len(raw) + 8, zlib.crc32(raw), "key")


@pytest.mark.parametrize("hot", ["record", "key", "empty"])
def test_buckets_keep_their_size(spark, tmp_path, hot):
    """A third of the rows are one record, one key, or without text but with another long column."""
    rows = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", f"CASE WHEN id % 3 <> 0 THEN concat('text ', id) WHEN '{hot}' = 'record' THEN repeat('same ', 20) WHEN '{hot}' = 'key' THEN concat(id, repeat(' key', 25)) END AS text",
        f"CASE WHEN '{hot}' = 'empty' THEN concat(id, repeat('.', 90)) END AS other",
    )
    size = 20_000
    out = shuffle_into_shards(rows, str(tmp_path / "a"), bucket_bytes=size)
    assert out.count() == 9000 and out.select("record").exceptAll(rows.selectExpr("struct(*) AS record")).count() == 0
    files = spark.read.parquet(str(tmp_path / "a"))
    bytes_of = F.expr("64 + coalesce(octet_length(record.text), 0) + coalesce(octet_length(record.other), 0)")
    largest = files.groupBy("bucket").agg(F.sum(bytes_of).alias("bytes")).agg(F.max("bytes")).first()[0]
    assert largest < 2 * size
    slots = {}
    for r in out.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shuffle_into_shards(rows.repartition(5), str(tmp_path / "b"), bucket_bytes=size)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_empty(spark, docs, tmp_path):
    assert shuffle_into_shards(docs.limit(0), str(tmp_path / "f")).count() == 0


def test_no_python_on_the_main_path(spark, tmp_path):
    plan = shuffle_into_shards(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "g"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
