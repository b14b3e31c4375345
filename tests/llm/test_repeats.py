"""Suffix arrays against sorting, removal of repeats against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailweave.llm import induced, repeats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.sampled_from([0, 48]))
def test_suffix_array(values, wave):
    before, induced._WAVE = induced._WAVE, wave  # both ways to induce
    try:
        found = induced.suffix_array(np.array(values, np.int64), 4).tolist()
    finally:
        induced._WAVE = before
    assert found == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 for x in b)))
def test_permuted_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    sa = induced.suffix_array(text, 256)
    found = induced.permuted_prefixes(text, sa, 200, np.array([0]))
    assert found[sa[0]] == 0
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert found[b] == n


def brute(docs, length):
    """docs in their order: (doc_id, text); rows with equal ids in the given order."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), [None] * len(docs)
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = [False] * len(data)
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = [True] * length
            seen.add(data[a : a + length])
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (docs[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([12, 40, 90]))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcxyzß") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        out.append((i * 7 % n, "".join(parts)))
    return out


ODD = [(None, None), (None, "ab" * 60), (500, ""), (501, "a" * 300), (501, "b" * 19), (502, None), (503, "ab" * 60), (504, "\x00" * 90), (505, "漢字" * 40)]


@pytest.mark.parametrize(
    "how",
    [
        {},
        {"part_bytes": 64, "shard_bytes": 500, "slice_bytes": 300},  # texts in many parts, many shards
        {"hot": 1},  # every repeated anchor by whole windows
        {"hot": 1, "part_bytes": 37, "gram": 3, "slice_bytes": 900},
    ],
)
def test_equals_brute_force(spark, how):
    docs = texts(3, 60) + ODD
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, slice string, place int").coalesce(1)
    found = repeats.repeated_removed(df, length=20, keep=True, **{"gram": 8, **how})
    assert sorted((tuple(r)[:5] + (bytes(r.kept),) for r in found.collect()), key=str) == brute(docs, 20)


def test_copies_over_partitions(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(2000))
    near = [(i, text[:500] + str(i) * 3 + text[500:]) for i in range(40)]
    docs = [(100 + i, text) for i in range(40)] + near
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = repeats.repeated_removed(df, keep=True, hot=5)
    assert sorted((tuple(r)[:5] + (bytes(r.kept),) for r in found.collect()), key=str) == brute(docs, 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated_removed(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert repeats.repeated_removed(df).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    other = np.concatenate([rng.integers(97, 100, 33).astype(np.uint8), base[50:300]])
    of = {}
    for text in (base, other):
        found = repeats.Pieces(text, np.array([len(text)]), 100, 8)
        assert found.windows.sum() == len(text) - 99
        for first, n, gram in zip(found.first.tolist(), found.windows.tolist(), found.gram.tolist()):
            for at in range(first, first + n):
                assert of.setdefault(text[at : at + 100].tobytes(), gram) == gram
