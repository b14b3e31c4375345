"""Packing: exact round trip of all ids, capacity and little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from mailweave.llm.packing import cut, fit_rest, harmonic_pack
from mailweave.llm.tokens import default_path, word_cache

SF = "/root/testdata/sf0.01"


def plain_ids(texts):
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_cache_equals_the_tokenizer():
    odd = ["a b c  d\n\n\te", "é ́x İSTANBUL ΣΑΣ ΟΔΟΣ", "don't I'LL 123,45 <|endoftext|> it's 'sun 't", "ᄀ ᅡ", "x\r\ny\x0bz\x0c\x85w", " ", "", "...Hello!! |a| (b) -é- <ǅ> ﬁ, ª² x²", "a̸ ≮ =", "Wort! wort?? WORT", "日本語 テスト。", " a b", "'s's ''s `a`"]
    cache = word_cache(default_path())
    assert [np.frombuffer(cache.ids(t), "<u4").tolist() for t in odd] == plain_ids(odd)


def test_words_with_every_letter_that_has_two_cases():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c))]
    texts = [form.format(c) for c in letters for form in ("{}", "{}{{", "({}", "a{}b", "{0}{0}'s", "{}1")]
    cache = word_cache(default_path())
    assert [np.frombuffer(cache.ids(t), "<u4").tolist() for t in texts] == plain_ids(texts)


def test_cuts():
    for n in (*range(1, 4200), 100_000):
        at = 0
        for start, length, k in cut(n):
            assert start == at and length >= 1 and k == 2048 // length
            assert length * k * 32 >= 2048 * 31 or length == 2048 // k
            at += length
        assert at == n
    assert cut(0) == []


def test_rest_fits():
    pieces = [(2048 // n, i, n) for i, n in enumerate((2000, 1000, 1000, 48, 40, 40, 8, 1, 1, 2048))]
    bins = defaultdict(list)
    for k, i, b, offset in fit_rest(pieces):
        bins[b].append((offset, pieces[i][2]))
    assert len(bins) == 4
    for rows in bins.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048


def check(rows, texts):
    ids = {d: i + [1] for d, i in zip(texts, plain_ids([t or "" for t in texts.values()]))}
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    used = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert docs.keys() == ids.keys()
    for d, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d]))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    return used / (2048 * len(seqs))


@pytest.mark.parametrize("parts", [1, 8])
def test_given_documents(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    rows = harmonic_pack(docs, default_path()).collect()
    assert check(rows, {r.doc_id: r.text for r in docs.collect()}) > 0.99
    assert {r.sequence_id for r in rows} == set(range(max(r.sequence_id for r in rows) + 1))


def test_odd_documents(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 5000, 5), (4, "a", 5), (-7, "b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    check(harmonic_pack(docs, default_path()).collect(), {r[0]: r[1] for r in rows})
    twice = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string")
    assert sorted(r.length for r in harmonic_pack(twice, default_path()).collect()) == [1, 3, 3]
    assert harmonic_pack(docs.limit(0), default_path()).count() == 0
