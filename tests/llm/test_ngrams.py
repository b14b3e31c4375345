"""Language model scores against counting in one place."""

from collections import Counter
from math import log

import numpy as np
import pytest

from mailweave.llm.ngrams import START, op7_lm_scores, stupid_backoff
from mailweave.llm.tokens import default_path, word_cache

SF = "/root/testdata/sf0.001"


def brute(rows, backoff=0.4):
    cache = word_cache(default_path())
    tokens = [np.frombuffer(cache.ids(t or ""), "<u4").tolist() for _, t in rows]
    pairs = [Counter(zip([START, *t], t)) for t in tokens]
    all_pairs, before, own = Counter(), Counter(), Counter()
    for p in pairs:
        all_pairs.update(p)
    for (a, b), n in all_pairs.items():
        before[a] += n
        own[b] += n
    total = sum(own.values())
    out = []
    for (doc, _), t, p in zip(rows, tokens, pairs):
        score = sum(k * log((all_pairs[a, b] - k) / before[a] if all_pairs[a, b] > k else backoff * own[b] / total) for (a, b), k in p.items())
        out.append((doc, len(t), score))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted(((r.doc_id, r.n_tokens, r.log_score, r.mean_log_score) for r in got), key=repr)
    assert len(got) == len(want)
    got, want = (sorted(x, key=lambda r: (repr(r[0]), r[1], r[2])) for x in (got, want))
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and g[3] == pytest.approx(w[2] / max(1, w[1]), abs=1e-9)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(op7_lm_scores(spark, SF).collect(), brute(rows))


def test_odd_rows_buckets_and_salts(spark):
    rows = [(1, "a b c a b"), (2, "a b c a b"), (3, None), (4, ""), (5, "x " * 5000), (6, "a b"), (6, "a b"), (None, "b c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    want = brute(rows)
    for buckets, size in ((16, 32 << 20), (3, 500)):
        same(stupid_backoff(docs.repartition(3), default_path(), buckets=buckets, group_bytes=size).collect(), want)
    assert stupid_backoff(docs.limit(0), default_path()).count() == 0
