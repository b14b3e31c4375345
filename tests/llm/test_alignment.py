"""Alignment of tokenizers against whole texts tokenised at once."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest

from mailweave.llm import alignment as al
from mailweave.llm.tokens import default_path

PATHS = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
SIGNS = [" ", " ", "  ", "\n", "\t", "the", "and", "naïve", "É", "'s", "don't", "123", "...", "--", "漢字", "🙂", "\xa0", "\x1c", "x", "<s>", "<|endoftext|>", "\r\n", "-----", " ", "zzq", "\x00", "İ"]


@pytest.fixture(scope="module")
def pair():
    return al.pair_of(*PATHS)


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.choice([0, 1, 2, 5, 30, 400]))) for _ in range(n)]


def ranges(ids, spelling):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelling[i]), i))
        at += len(spelling[i])
    return out


def brute(pair, rows):
    counts, found = Counter(), []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = ranges(pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes) if text else []
        b = ranges(pair.b.encode(text), pair.b_bytes) if text else []
        if not text or any(b"".join(s[i] for _, _, i in x) != whole for x, s in ((a, pair.a_bytes), (b, pair.b_bytes))):
            found.append((doc_id, None))
            continue
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = []
        for low, high in zip([0, *common], common):
            groups.append("|".join(",".join(str(x[2]) for x in t if low < x[1] <= high) for t in (a, b)))
        counts.update(links)
        found.append((doc_id, (len(a), len(b), len(common), links, ";".join(groups))))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            sums = sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)
            out.append((doc_id, *x[:3], len(links), *sums, hashlib.sha256(x[4].encode()).hexdigest()))
    return sorted(out, key=str)


def test_units_tokenise_alone(pair):
    for text in random_texts(1, 1500):
        if not text:
            continue
        keys = al.units(text)
        assert "".join(" " + k for k in keys) == " " + text
        found = pair.encode(keys)
        assert [i for u in found for i in u.a] == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in found for i in u.b] == pair.b.encode(text)


def test_words_tokenise_together(pair):
    keys = sorted({k for t in random_texts(9, 400) for k in al.units(t) if al.is_word(k)})
    for some in (keys, keys + ["a▁b"], keys[:1]):
        one, two = pair.word_entries(some), pair.encode(some)
        assert one == [al.unit_entry(u) for u in two]
        for entry, unit in zip(one, two, strict=True):
            if unit.good:
                found = al.fragment(al.Open(unit.a, unit.a_ends, unit.b, unit.b_ends), 0)
                assert entry == al.entry_of([found.head, *(g for _, g in found.closed)])


def test_fragments_compose_associatively(pair):
    rng = random.Random(2)
    for text in random_texts(3, 60):
        if not text:
            continue
        (unit,) = pair.encode([text])
        cuts = sorted({0, unit.a_ends[-1], *(rng.randint(0, unit.a_ends[-1]) for _ in range(6))})
        parts = [al.fragment(al._within(unit, 0, low, high), i) for i, (low, high) in enumerate(zip(cuts, cuts[1:]))]
        left = reduce(al.Fragment.__add__, parts)
        right = reduce(lambda x, y: y + x, parts[::-1])
        whole = al.fragment(al._within(unit, 0, 0, unit.a_ends[-1]), 0)
        assert left == right
        assert [left.head, *(g for _, g in left.closed)] == [whole.head, *(g for _, g in whole.closed)]
        assert left.tail == al.Open()


ODD = [(900, None), (901, ""), (902, "a▁b " * 300), (903, "a▁b"), (None, "null id " * 50), (5, "again"), (5, "again"), (904, "x" * 700 + " y"), (905, "漢字" * 400), (906, " " * 300), (907, "\n" * 100 + " "), (908, " ")]


@pytest.mark.parametrize("chunk_bytes", [64 << 10, 200, 7])
def test_equals_brute_force(spark, pair, chunk_bytes):
    rows = [*enumerate(random_texts(4, 80)), *ODD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, slice string").repartition(3)
    found = sorted((tuple(r) for r in al.aligned(df, *PATHS, chunk_bytes).collect()), key=str)
    assert found == brute(pair, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.aligned(df, *PATHS).collect() == []


def test_only_misspelt(spark):
    df = spark.createDataFrame([(1, "▁" * 50), (2, None)], "doc_id long, text string")
    found = sorted(tuple(r) for r in al.aligned(df, *PATHS, 20).collect())
    assert found == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
