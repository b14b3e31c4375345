"""The pipeline's stages on their own inputs, and the add-on's place in the repository."""

import os
import subprocess
import sys

import corpus_pipeline as c
from mailweave.llm.decontam import contamination
from mailweave.llm.pii import find, masked

from .test_packing import check
from .test_simhash import brute_print, brute_roots

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.abspath(c.__file__))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        was, now = ({r.doc_id: r for r in d.collect()} for d in (before, after))
        if i < 4:
            assert after.columns == docs.columns and set(now) <= set(was)
        if name == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(bad & set(now)) <= 0.1 * len(bad) and len(good & set(now)) >= 0.98 * len(good & set(was))
        if name == "SimHash near-dedup":
            want = brute_roots({d: brute_print(was[d].text) for d in sorted(was)})
            assert set(now) == {d for d, r in want.items() if d == r}
        if name == "benchmark decontamination":
            hit = {r.doc_id for r in contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert hit and set(now) == set(was) - hit
        if name == "PII":
            assert now.keys() == was.keys()
            assert all(now[d].text == masked(was[d].text, sum(find(was[d].text), [])) and now[d].n_chars == len(now[d].text) for d in was)
        if name == "packing":
            assert check(after.collect(), {d: r.text for d, r in was.items()}) > 0.98
        before = after


def test_run_is_the_stages(spark, tmp_path):
    rows = c.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_near_duplicates_leave_one_row_of_each_group(spark):
    same = "the same words in every copy of this text"
    rows = [(2, same, 0), (2, same, 0), (1, same, 1), (1, same, 1), (1, "quite another text under a kept id", 2), (None, same, 3), (None, same, 3), (None, "a text that only null ids have", 4), (None, "a text that only null ids have", 4), (9, None, 5), (3, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = c.near_duplicates(spark, docs, SF)
    assert out.schema == docs.schema
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, same, 1), (1, "quite another text under a kept id", 2), (None, "a text that only null ids have", 4), (3, "", 6)]))


def test_odd_documents(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, "mail me at a@b.co " * 50, "en", "s", 900)]
    before = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES[1:]:
        before = stage(spark, before, SF)
    assert before.count() >= 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_entry_works_without_the_add_on(tmp_path):
    os.makedirs(tmp_path / "mailweave")
    for name in os.listdir(f"{ROOT}/mailweave"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/mailweave/{name}", tmp_path / "mailweave" / name)
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "entry_link")
    with open(f"{ROOT}/__spark_entry__.py") as f, open(tmp_path / "__spark_entry__.py", "w") as out:
        out.write(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'x1_elements_by_tag' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry_has_every_operator():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
