"""Ranked search against a plain reading of its formula."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailweave.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text)) if text else []


def brute(docs, items, top=20):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in dict.fromkeys(i for i in items if i[1] is not None):
        found = []
        for d, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m))
                for w in words(text)
                if w in bag
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, m int")
    items = spark.createDataFrame([(*i, 2) for i in items], "item_id string, text string, rank int")
    return sorted((tuple(r) for r in search.ranked_search(docs, items, **how).collect()), key=str)


DOCS = [(i, f"the cat {'sat ' * (i % 3)}on mat{i % 4} Ünd {'und' * (i % 2)}") for i in range(30)]
ODD = [(None, "the cat on mat0 Ünd "), (None, None), (41, ""), (42, "...!"), (7, "the mat3"), (7, "the mat3"), (43, "mat1 " * 3000 + "dog" * 3000), (44, "the"), (45, "THE")]
ITEMS = [("a", "the cat mat3"), ("b", "mat1 mat1 dog"), ("c", None), ("d", ""), ("d", "nowhere"), (None, "mat2 Ünd ÜND"), ("a", "the cat mat3"), ("a", "the sat")]


@pytest.mark.parametrize("how", [{}, {"top": 3}, {"block_bytes": 8}])
def test_equals_brute_force(spark, how):
    docs = DOCS + ODD
    assert run(spark, docs, ITEMS, **how) == brute(docs, ITEMS, how.get("top", 20))


def test_one_class_of_many_members(spark):
    docs = [(1000 - i, "red fish") for i in range(300)] + [(2000, "red red"), (5, "blue fish here")]
    assert run(spark, docs, [("q", "red fish")]) == brute(docs, [("q", "red fish")])


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == []
    assert run(spark, [(1, None), (2, "")], ITEMS) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ09é漢 \n-_\x00", max_size=60))
def test_words(text):
    counts = Counter()
    assert search.count_words(text.encode(), counts) == len(words(text))
    assert {k.decode(): n for k, n in counts.items()} == Counter(words(text))


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(search, "_PART", 7)
    counts = Counter()
    assert search.count_words(b"one two, three four aaaaaaaaaaaaaaaaaaaaaa b", counts) == 6
    assert counts[b"aaaaaaaaaaaaaaaaaaaaaa"] == 1
