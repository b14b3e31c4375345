"""Classifiers: held-out accuracy on the given tables, and odd input."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailweave.llm.calibrate import fitted, fitted_over, labelled_sample
from mailweave.llm.quality import good_documents, op10_quality, open_labels, quality_scores, train_quality
from mailweave.llm import toxicity
from mailweave.llm.toxicity import WORD_DISCOUNT, Counts, KneserNey, op2_toxicity, toxicity_scores, train_toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, folds, out, least, recalls", [(op2_toxicity, "toxic", 5, 0, 0.97, (0.98, 0.85)), (op10_quality, "quality", 3, 1, 0.985, (0.95, 0.985))])
def test_held_out(spark, query, label, folds, out, least, recalls):
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) >= least
    for c in (0, 1):
        own = [b for a, b in held if a == c]
        assert sum(b == c for b in own) / len(own) >= recalls[c]


def test_labels_held_out_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality_scores(docs, train_quality(docs, open_labels(x))).collect()} for x in (labels, other))
    assert one == two


ROWS = [(i, ("good words of plain text " if i % 2 else "BAD!! JUNK!! $$$ %%% ") * (3 + i % 5) + f" n{i}", "score", 0.5) for i in range(80)]
ODD = [(100, None, None, None), (101, "", "", 0.0), (101, "", "", 0.0), (None, "good words", "", 0.0), (102, "x" * 300_000, "", 0.0), (103, "good words of plain text", "", 0.0)]


@pytest.mark.parametrize("train, score, label", [(train_quality, quality_scores, "quality"), (train_toxicity, toxicity_scores, "toxic")])
def test_odd_rows(spark, train, score, label):
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (None, 1), (2, None), (3, 7), (999, 1)], f"doc_id long, {label} int")
    model = train(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == len(ROWS) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert sum((by[i] >= 0.5) == i % 2 for i in range(80)) >= 76
    assert by[100] == by[101] and by[103] >= 0.5
    assert score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where(f"{label} = 1")):
        assert all(0 <= r.score <= 1 for r in score(docs, train(docs, few)).collect())
    assert score(docs, train(docs.limit(0), labels)).count() == len(rows)


def test_good_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    kept = good_documents(docs, train_quality(docs, labels))
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(1, 80, 2))) >= 38 and len(ids & set(range(0, 80, 2))) <= 2


def test_sample_is_of_documents_that_are_here(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, x string, score double")
    known = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    many = known.unionByName(spark.range(1000, 101_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality"))
    sample, sizes = labelled_sample(docs, many, "quality", 40, 10)
    assert sample.count() == 80 and sizes == {0: 40, 1: 40}
    assert good_documents(docs, train_quality(docs, many, rows=40)).count() == 40


def test_a_hot_id_is_one_row_of_the_sample(spark):
    hot = spark.range(5000).selectExpr("7L AS doc_id", "concat('hot text ', id) AS text")
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string").unionByName(hot)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    for rows in (2, 40):
        sample, sizes = labelled_sample(docs, labels, "toxic", rows, 3)
        ids = [r.doc_id for r in sample.collect()]
        assert len(ids) == len(set(ids)) <= 2 * rows and sizes == {0: 40, 1: 40}
    one, two = (sorted(labelled_sample(d, labels, "toxic", 40, 3)[0].collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_nothing_is_rejected_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="none is rejected"):
        assert good_documents(docs, train_quality(docs, labels)).count() == docs.count()


def test_class_models_share_backoff():
    ordinary = {"^^^^a": 5, "^^^ab": 5, "^^ab$": 5, "^^^^c": 5, "^^^c$": 5}
    toxic = {"^^^^z": 5, "^^^zq": 5, "^^zq$": 5}
    m = KneserNey({0: Counts(ordinary, {"ab": 5, "c": 5}), 1: Counts(toxic, {"zq": 5})})
    assert m["zq"] > 3 and m["ab"] < -3
    assert abs(m["kkkk"]) < abs(m["zqq"]) + 5
    spread = sum(m._lower(ch) for ch in "abcqz$") + (256 - 6) * m._lower("~")
    assert spread == pytest.approx(1, abs=1e-9)  # a distribution over 256 letters


def test_words_of_a_class_have_probability_one():
    words = {"ab": 2, "c": 9, "once": 1}
    model = KneserNey({c: Counts({"^^^^a": 3, "^^^ab": 3, "^^ab$": 3}, words, 4) for c in (0, 1)})
    assert sum(max(n - WORD_DISCOUNT, 0) for n in words.values()) / model.mass[0] + model.free[0] == pytest.approx(1)


def test_caches_are_bounded_by_entries(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_GRAMS", 5_000)
    model = KneserNey({c: Counts({"^^^^a": 3}, {}, 1) for c in (0, 1)})
    model.features(" ".join("".join(chr(0x4E00 + (i * j) % 20_000) for j in range(1, 100)) for i in range(300)))
    assert len(model.lower) + len(model.spelled) < 6_000 and len(model) == 0


def test_too_many_ngrams_are_an_error(spark):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="n-grams"):
        train_toxicity(docs, labels, most_grams=10)


def test_models_are_repeatable(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for train, score in ((train_quality, quality_scores), (train_toxicity, toxicity_scores)):
        one, two = ({r.doc_id: r.score for r in score(docs, train(d, labels)).collect()} for d in (docs, docs.repartition(5)))
        assert one == pytest.approx(two, abs=1e-9)


def test_word_values_are_of_all_labelled_texts(spark):
    docs = [(i, f"{'vile rotten' if i % 2 else 'kind sunny'} words {'abcdefgh'[i % 8] * (1 + i % 5)} only{i % 37}x" + " again" * (i % 3)) for i in range(5000)]
    docs = spark.createDataFrame([*docs, (0, docs[0][1]), (None, "kind"), (9000, None)], "doc_id long, text string")
    labels = spark.range(4900).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    sample, sizes = labelled_sample(docs, labels, "toxic", None, 2)
    rows = sample.collect()
    assert sizes == {0: 2450, 1: 2450} and {r.text for r in rows} == {r.text for r in docs.where("doc_id < 4900").collect()}
    counts = {(f, c): (Counter(), Counter()) for f in (0, 1) for c in (0, 1)}
    for r in rows:
        texts, grams = counts[r.fold, r.label]
        texts.update(set(toxicity.words_of(r.text)))
        grams.update(g for w in toxicity.words_of(r.text) for g in toxicity.grams(w))
    both = {c: [counts[0, c][i] + counts[1, c][i] for i in (0, 1)] for c in (0, 1)}
    plain = {m: KneserNey({c: Counts(dict(counts[m, c][1]), dict(counts[m, c][0])) for c in (0, 1)}) for m in (0, 1)}
    plain[2] = KneserNey({c: Counts(dict(both[c][1]), dict(both[c][0])) for c in (0, 1)})
    words = [*both[0][0], *both[1][0], "vilest", "qqq", "\u4e2d\u6587", "x" * 5000]
    asked = spark.createDataFrame(sorted({(toxicity._key(w), w) for w in words}), "key long, word string")
    found = {r.key: r for r in toxicity.word_values(asked, toxicity._count(sample), (0, 1, 2)).collect()}
    assert len(found) == asked.count()
    for w in words:
        assert [found[toxicity._key(w)][f"v{m}"] for m in (0, 1, 2)] == pytest.approx([plain[m][w] for m in (0, 1, 2)], abs=1e-9)


def test_a_large_vocabulary_goes_in_rounds(spark):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = train_toxicity(docs, labels)
    one, two = ({r.doc_id: r.score for r in toxicity_scores(docs, model, most_words=n).collect()} for n in (1000, 6))
    assert len(one) == 80 and one == pytest.approx(two, abs=1e-9)


def test_calibration_in_passes_equals_the_one_in_memory(spark):
    rows = [(i % 2, [((i * 7) % 11) / 3 + i % 2, float((i * 5) % 13)]) for i in range(300)] + [(0, [0.0, 0.0])] * 50
    passes = fitted_over(spark.createDataFrame(rows, "label int, x array<double>"), {0: 900, 1: 100})
    whole = fitted(np.array([x for _, x in rows]), np.array([y for y, _ in rows]), {0: 900, 1: 100})
    assert passes.w == pytest.approx(whole.w, abs=1e-7)


def test_ngrams_of_words_are_not_written_word_by_word(spark, monkeypatch):
    docs = [(i, " ".join("".join("abcd"[(40 * i + j) * 7919 >> 2 * k & 3] for k in range(10)) for j in range(40))) for i in range(1000)]
    docs = [(i, f"{'vile' if i % 2 else 'kind'} {text}") for i, text in docs] + [(2000, None), (2001, "\u4e2d\u6587 new\U00010400"), (2002, "vile " + "x" * 5000)]
    labels = spark.range(800).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = []
    with monkeypatch.context() as m:
        m.setattr(toxicity, "written", lambda df, label: rows.append(df.count()) or df.localCheckpoint())
        model = train_toxicity(docs, labels)
        some = {r.doc_id: r.score for r in toxicity_scores(docs, model).collect()}
    words = len({w for r in docs.collect() for w in toxicity.words_of(r.text or "")})
    assert words > 30_000 and max(rows) <= words  # an n-gram for each letter of each word would be a dozen times as many
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 100)
    joined = {r.doc_id: r.score for r in toxicity_scores(docs, train_toxicity(docs, labels)).collect()}
    assert len(some) == 1003 and some == pytest.approx(joined, abs=1e-9)


def test_texts_are_split_many_at_a_time(spark, monkeypatch):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd = ["", "Ab_c1d2 \u00c9 \u00df \u0130x \u0391\u03a3 \u0391\u03a3. \u03a3\u0391", "\u4e2d\u6587 new\U00010400 x\U0001d7d8y \u00b2b \u2167 \u0663a", "x" * 5000, "\n", "a", "1", "a a b", every, " ".join(every)]
    for texts in ([], [""], ["", "1"], odd, odd[::-1]):
        words, which, begins = toxicity.split(texts)
        assert [words[which[a:b]].tolist() for a, b in zip(begins[:-1], begins[1:])] == [toxicity.words_of(t) for t in texts] and len(set(words)) == len(words)
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    real, passes = toxicity.map_slices, []
    monkeypatch.setattr(toxicity, "map_slices", lambda df, fn, schema: passes.append((set(df.columns), fn)) or real(df, fn, schema))
    toxicity_scores(docs, train_toxicity(docs, labels))
    monkeypatch.setattr(toxicity, "words_of", lambda text: pytest.fail("one text at a time"))
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["good words", None], "fold": [0, 1], "label": [1, 0]})
    over_texts = [fn for columns, fn in passes if columns <= {*rows.schema.names}]
    assert len(over_texts) == 4 and all(fn(rows).num_rows for fn in over_texts)  # counting, features of both halves, n-grams, features


def test_features_from_numbers_are_those_of_words():
    words = "to be or not to be that is the question that is to be".split()
    value = {w: (-1) ** i * len(w) / (i + 1) for i, w in enumerate(dict.fromkeys(words))}.get
    strongest = sorted(map(value, set(words)), reverse=True)[:3]
    runs = [max(sum(map(value, words[i : i + n])) for i in range(len(words) - n + 1)) / size for size in toxicity.WINDOWS for n in [min(size, len(words))]]
    for some, best in ((words, strongest), (["to"] * 3, [value("to")]), ([], [])):
        found = toxicity.features(some, value)
        assert found[1] == pytest.approx(sum(best) / 3) and len(found) == 6
    assert toxicity.features(words, value) == pytest.approx([sum(map(value, words)) / len(words), sum(strongest) / 3, *runs, np.log(1 + len(words))])
