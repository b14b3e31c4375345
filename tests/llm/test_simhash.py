"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import xxhash

from mailweave.llm.simhash import fingerprint, fingerprint_components, near_links, one_of_each_group, op8_simhash, simhash_groups

SF = "/root/testdata/sf0.01"


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius=2):
    names = list(prints)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def test_prints_equal_spark_hash_and_brute_force(spark):
    for text in ("", "one", "One TWO", "a b c", "é x b\x0bc d", "a b a b a b", "x " * 40_000):
        assert fingerprint(text.encode()) == brute_print(text)
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h & (2**64 - 1) == brute_print("a b c")


def test_components_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 0xFFFF]
    prints = set(base)
    for b in base:
        for _ in range(12):
            b ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))  # chains of steps of one or two bits
            prints.add(b)
        for _ in range(4):
            prints.add(b ^ (7 << rng.randrange(60)))
    signed = {p - (p >> 63 << 64): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_roots(dict(sorted(signed.items())))
    for tile in (4096, 5):
        got = {r.node: r.root for r in fingerprint_components(df, tile=tile).collect()}
        assert {s: got.get(s, s) for s in signed} == want


def test_links_are_a_forest():
    a = np.arange(64, dtype=np.int64)
    u, v = near_links(a, a, 64, True)
    assert len(u) == 63 and set(v.tolist()) == {0}


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.orderBy("doc_id").collect()}
    want = brute_roots(prints)
    rows = op8_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    kept = {r.doc_id for r in one_of_each_group(docs).collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_odd_rows(spark):
    rows = [(4, None, 1), (3, "", 1), (9, " \n", 1), (7, "a b c d", 1), (8, "a b c d", 1), (8, "a b c d", 1), (None, "a b c d", 1), (None, "zz", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(repr, ((r.doc_id, r.component_id) for r in simhash_groups(docs).collect())))
    assert got == sorted(map(repr, [(4, 3), (3, 3), (9, 3), (7, 7), (8, 7), (8, 7), (None, 7), (None, None)]))
    assert sorted(repr(r.doc_id) for r in one_of_each_group(docs).collect()) == sorted(map(repr, [3, 7, None, None]))
    assert one_of_each_group(docs).columns == docs.columns
    assert simhash_groups(docs.limit(0)).count() == 0
