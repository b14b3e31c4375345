"""Decontamination against a plain search, and in SQL terms on the given tables."""

import hashlib
import random
import re

import numpy as np

from mailweave.llm.decontam import TestSuffixes as Suffixes
from mailweave.llm.decontam import contamination, decontaminated, op9_decontamination, words_of

SF = "/root/testdata/sf0.01"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    def words(t):
        return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def rows_of(df):
    from pyspark.sql import functions as F

    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect())


def test_words():
    for text in ("A-b c9é_x", "", "日本 x", "\x7f\x80a"):
        assert [w.decode() for w in words_of(text.encode())] == _WORD.findall(text.lower())


def test_random_texts(spark):
    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice("a b c") for _ in range(n))

    items = [(i, text(rng.choice((1, 4, 9, 10, 11, 14, 20)))) for i in range(2, 12)] + [(1, None), (2, ""), (None, text(12)), (3, "--"), (4, "z"), (4, "z")]
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(7, None), (7, ""), (None, "z y z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 3):
        want = brute(docs, items, window)
        assert rows_of(contamination(d, b, window)) == want
        assert rows_of(contamination(d.repartition(3), b, window, block_bytes=20)) == want
    kept = decontaminated(d, b)
    assert kept.schema == d.schema
    clean = {r.doc_id for r in contamination(d, b).where("NOT contaminated").collect()}
    assert {r.doc_id for r in kept.collect()} == clean


def test_runs_are_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x y {item} z {' '.join(item.split()[5:17])}")], "doc_id long, text string")
    row = contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(2, 30), (33, 12)] and row.longest == 30


def test_matches_have_item_place_and_length(spark):
    """Two short items side by side are two matches; an item whose windows repeat goes on where it went on before."""
    words = [f"w{i}" for i in range(40)]
    items = [(1, "p q"), (2, "r s t"), (3, " ".join(words)), (4, "u " * 14), (None, " ".join(words[:11]))]
    text = " ".join(["x", "p", "q", "r", "s", "t", *words[3:25], "y", *words[20:33], *["u"] * 16])
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 10):
        rows = {r.doc_id: r for r in contamination(docs, bench, block_bytes=size).collect()}
        got = [tuple(m) for m in rows[1].matches]
        assert [m for m in got if m[0] != "4"] == [("1", 0, 1, 2), ("2", 0, 3, 3), ("3", 3, 6, 22), ("3", 20, 29, 13)]
        assert [m for m in got if m[0] == "4"][0] == ("4", 0, 42, 14) and rows[1].longest == 22
        assert rows[2].matches == rows[3].matches == []
    found = contamination(docs, bench).first()
    for m in found.matches:  # verbatim, and not to be extended
        item, doc = dict((str(i), t.split()) for i, t in items)[m.item], text.split()
        assert item[m.at : m.at + m.words] == doc[m.first : m.first + m.words]


def test_suffixes_are_sorted():
    test = Suffixes([(1, b"a b a b c")], 3)
    ids = np.array([test.vocabulary.get(w, 0) for w in b"a b a x b a b c a b a b c".split()], np.int32)
    keys, place = test.suffix_array(ids)
    assert list(keys) == sorted(keys) and len(set(place.tolist())) == len(place)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(repr(tuple(r)) for r in op9_decontamination(spark, SF).collect())
    assert got == brute(docs, items)
    assert any("True" in r for r in got)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, b).collect()] == [(1, 2, 0, 0)]
    assert contamination(d.limit(0), b).count() == 0
