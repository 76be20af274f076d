import math
import re
from collections import Counter

import numpy as np
import pytest

from media_analytics.llm import lexical

from .fixtures import documents, empty_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=20):
    """Every document scored against every item."""
    texts = [(i, Counter(plain_terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in texts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), size in zip(texts, lengths):
            score = 0
            for w, q in Counter(plain_terms(text)).items():
                if c[w]:
                    m = 100 - 25 + 25 * size * n // total
                    score += q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (
                        1000000000 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return out


def rows(df):
    return sorted(map(str, map(tuple, df.select("item_id", "rank", "doc_id", "score").collect())))


def test_terms():
    text = "A-b_C9é x\u0085Ünï ٣ &<>@[`{\x7f~ \U0001f600"
    assert [w.decode() for w in lexical.terms(text.encode())] == plain_terms(text)
    assert lexical.terms(None) == lexical.terms(b"") == []


@pytest.mark.parametrize("seed", range(6))
def test_shards_equal_brute_force_and_stop_early(seed):
    """Random lists with many ties; a bar only leaves out what is below it."""
    rng = np.random.default_rng(seed)
    docs, n_terms = 400, 12
    tf = (rng.random((docs, n_terms)) < rng.random(n_terms)) * rng.geometric(0.5, (docs, n_terms))
    m = rng.choice([75, 80, 100, 300], docs)
    d, t = np.nonzero(tf)
    ids, known = rng.permutation(docs) // 2, rng.random(docs) < 0.9
    shard = lexical.Shard(ids, known, m, d, t, tf[d, t], n_terms)
    asked = [(int(k), int(rng.integers(0, 9) * 1000 ** rng.integers(0, 2))) for k in rng.permutation(n_terms)[:7]]
    score = sum(c * np.where(tf[:, k] > 0, lexical.impact(tf[:, k], m), 0) for k, c in asked)
    best = sorted((-int(score[i]), not known[i], int(ids[i])) for i in range(docs) if score[i] > 0)
    for bar in (0, -best[10][0], -best[0][0] + 1):
        found, got, _ = shard.search(asked, bar)
        want = [b for b in best[:20] if -b[0] >= bar]
        assert [(-int(s), not known[i], int(ids[i])) for i, s in zip(found, got)][:len(want)] == want
    assert len(shard.search([])[0]) == 0


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(2)
    docs = 5000
    tf = np.ones((docs, 3), np.int64)
    tf[:50, 0] = 30
    d, t = np.nonzero(tf)
    m = np.where(np.arange(docs) < 50, 75, rng.integers(200, 400, docs))  # the best documents are short
    _, _, read = lexical.Shard(np.arange(docs), np.ones(docs, bool), m, d, t, tf[d, t], 3).search([(0, 5000), (1, 20), (2, 10)])
    assert read < 0.5 * len(d)


def test_blocks_and_shards_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(str, brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])))
    assert rows(lexical.search(docs, items)) == want
    assert rows(lexical.search(docs, items, item_bytes=1500, shard=300)) == want


def test_dirty_tables(spark):
    docs = documents(spark)
    items = [(1, "the CAT and the dog"), (1, "the CAT and the dog"), (2, None), (3, ""), (None, "Hund one"), (4, "-- !"),
             (5, "x" * 70_000), (6, "unknown word")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert rows(lexical.search(docs, benchmark)) == sorted(map(str, want))
    assert lexical.search(empty_documents(spark), benchmark).count() == 0
    assert lexical.search(docs, benchmark.limit(0)).count() == 0
