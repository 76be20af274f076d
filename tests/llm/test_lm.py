import math
import zlib
from collections import Counter

import numpy as np
import pytest

from media_analytics.llm import lm

from .fixtures import documents, empty_documents, texts


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def check_counts(rows, got):
    tokens = [(i, lm.tokens((t or "").encode())) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held_out(i), len(ws), sum(w in c for w in ws), n,
                   round(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert all(abs(a[5] - b[5]) < 1e-4 + 1e-9 * abs(a[5]) for a, b in zip(want, have))


def test_dirty_documents(spark):
    df = documents(spark)
    got = lm.score(df).collect()
    check_counts(texts(df), got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return texts(docs), lm.score(docs).collect()


def test_counts_and_held_out_gain(scored):
    rows, got = scored
    check_counts(rows, got)
    for part in (True, False):
        s = [r for r in got if r.held_out is part]
        n = sum(r.n_tokens for r in s)
        assert sum(r.score for r in s) / n > sum(r.base_score for r in s) / n + 0.1


def test_rare_tokens_through_the_join_score_the_same(spark, scored, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 1 + lm.OWN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_counts(texts(docs), lm.score(docs).collect())


def test_probabilities_are_normalised(spark):
    docs = documents(spark, extra=False).selectExpr("text")
    counts = lm.count_tokens(docs)
    scorer, n, v = lm.learn(docs.selectExpr("monotonically_increasing_id() doc_id", "text"), counts)
    table = 10.0 ** scorer.model.log10_table()
    assert np.allclose(table.sum(1), 1, atol=1e-4)
    within = np.zeros(lm.CLASSES)  # known tokens of each class and its share for unseen ones
    rows = counts.collect()
    for r in rows:
        within[scorer.classes.of(bytes(r.token))] += r.c + lm.ALPHA
    used = within > 0
    within[lm.OWN:] += lm.ALPHA
    assert v == len(rows) == len(scorer.common) + 1 and np.allclose(within[used], scorer.mass[used])


def test_nce_learns_a_cycle():
    classes = np.tile(np.arange(5), 4000)
    model = lm.LogBilinear(np.ones(5))
    model.fit(classes[:-2], classes[1:-1], classes[2:])
    table = model.log10_table()
    assert all(table[a * 5 + (a + 1) % 5].argmax() == (a + 2) % 5 for a in range(5))


def test_every_training_triple_and_pair_is_counted(spark, monkeypatch):
    df = documents(spark)
    common = lm.commonest(lm.count_tokens(df))
    ids = lm.Ids(lm.Classes(common), common)
    want, pairs, end = Counter(), Counter(), ids.classes.of(lm.END)
    for _, t in texts(df):
        words = lm.tokens((t or "").encode())
        c = [end, end, *map(ids.classes.of, words)]
        want.update((a * lm.CLASSES + b) * lm.CLASSES + x for a, b, x in zip(c, c[1:], c[2:]))
        pairs.update(((ids.classes.of(w) - lm.OWN) % lm.SHARDS, ids.of(b) * 65536 + ids.of(w))
                     for b, w in zip([lm.END, *words], words) if ids.classes.of(w) >= lm.OWN)
    for most in (lm.MAX_PAIRS, 20):  # also sent on in pieces
        monkeypatch.setattr(lm, "MAX_PAIRS", most)
        rows = lm.count_contexts(df, spark.sparkContext.broadcast(ids)).collect()
        assert {r.key: r.c for r in rows if r.part < 0} == want
        assert {(r.part, r.key): r.c for r in rows if r.part >= 0} == pairs


def learned(spark, docs):
    """(scorer, counts) of the training documents of ``docs``."""
    train = [(i, t) for i, t in texts(docs) if not held_out(i)]
    df = spark.createDataFrame(train, "doc_id long, text string")
    counts = lm.count_tokens(df)
    return lm.learn(df, counts)[0], {bytes(r.token): r.c for r in counts.collect()}


def probability(scorer, counts, two, one, token):
    """log10 P(token | two tokens before), by definition, one number at a time."""
    of, model, v = scorer.classes.of, scorer.model, scorer.vectors
    place = {t: i for i, (t, _) in enumerate(scorer.common[:lm.VECTORS])}
    id_of = lambda t: place.get(t, lm.VECTORS + of(t))
    h = [a * p + b * q for a, p, b, q in zip(model.context[of(two)].tolist(), model.scale[0].tolist(),
                                             model.context[of(one)].tolist(), model.scale[1].tolist())]
    s = [sum(x * y for x, y in zip(h, row)) + b for row, b in zip(model.target.tolist(), model.bias.tolist())]
    k = of(token)
    out = s[k] - math.log(sum(math.exp(x) for x in s))
    if k < lm.OWN:
        return out / math.log(10)
    members = [i for t, i in place.items() if of(t) == k] + [lm.VECTORS + k]
    known = {i: counts[t] + lm.ALPHA for t, i in place.items() if of(t) == k}
    rest = sum(c + lm.ALPHA for t, c in counts.items() if of(t) == k and t not in place) + lm.ALPHA
    c = v.context[(k - lm.OWN) % lm.SHARDS, id_of(one)].astype(float).tolist()
    raw = {i: known.get(i, rest) * math.exp(sum(x * y for x, y in zip(c, v.target[i].tolist())) + float(v.bias[i])) for i in members}
    i = id_of(token)
    inside = (counts.get(token, 0) + lm.ALPHA) / known.get(i, rest)
    return (out + math.log(raw[i] / sum(raw.values())) + math.log(inside)) / math.log(10)


def test_score_by_definition(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).union(
        spark.createDataFrame([(10 ** 6, "never seen zzyx wordsqq"), (10 ** 6 + 1, None), (10 ** 6 + 2, "")],
                              "doc_id long, text string").selectExpr("doc_id", "text", "'x'", "'x'", "0l"))
    rows = [(r.doc_id, r.text and " ".join(r.text.split()[:60])) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "TABLE", 600)  # some tokens are counted by the join
    scorer, counts = learned(spark, docs)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, t in rows[-6:]:
        words = [lm.END, lm.END, *lm.tokens((t or "").encode())]
        want = sum(probability(scorer, counts, a, b, w) for a, b, w in zip(words, words[1:], words[2:]))
        assert got[i] == pytest.approx(want, abs=1e-3, rel=1e-4)


def test_tokens_are_normalised_after_any_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scorer, counts = learned(spark, docs)
    ids = lm.Ids(scorer.classes, scorer.common)
    assert abs(scorer.vectors.target).max() > 0.1  # fitted
    rng = np.random.default_rng(1)
    share = ids.shares(scorer.common, scorer.mass)
    for one in rng.choice(lm.IDS, 20):
        live = np.flatnonzero((ids.cls >= lm.OWN) & (share > 0))
        gain = scorer.vectors.gain(live, np.full(len(live), one), ids.cls[live])
        sums = np.bincount(ids.cls[live], weights=share[live] * 10.0 ** gain, minlength=lm.CLASSES)
        assert np.allclose(sums[lm.OWN:], np.bincount(ids.cls[live], weights=share[live], minlength=lm.CLASSES)[lm.OWN:], atol=1e-4)
        assert np.allclose(sums[np.unique(ids.cls[live])], 1, atol=1e-4)


def test_token_vectors_learn_the_token_before():
    """Two contexts that each go on with a token of the same class."""
    cls = np.concatenate([np.full(lm.VECTORS, lm.OWN), np.arange(lm.CLASSES)])
    share = np.zeros(lm.IDS)
    share[:4] = 0.25
    share[lm.VECTORS + lm.OWN:] = 1e-6
    got = lm.fit_tokens(0, np.array([0, 1, 2, 3] * 500), np.array([1, 0, 3, 2] * 500), np.ones(2000), cls, share, passes=60)
    mine = np.flatnonzero((cls >= lm.OWN) & ((cls - lm.OWN) % lm.SHARDS == 0) & (share > 0))
    s = got["context"][:4].astype(float) @ got["target"][:4].T + got["bias"][:4]
    assert (mine[:4] == np.arange(4)).all() and s.argmax(1).tolist() == [1, 0, 3, 2]


def test_long_documents_are_learned(spark):
    # most tokens in a few long documents, each with an order of its own
    ids = [i for i in range(20) if not held_out(i)][:6]
    words = [[f"{chr(97 + k)}{j}" for j in range(3)] for k in range(6)]
    df = spark.createDataFrame([(i, " ".join(ws) + (" " + " ".join(ws)) * 250_000) for i, ws in zip(ids, words)],
                               "doc_id long, text string")
    got = lm.score(df).collect()
    assert len(got) == 6 and all(r.score / r.n_tokens > -0.3 for r in got)


def test_empty(spark):
    assert lm.score(empty_documents(spark)).count() == 0


def test_counts_move_as_one_long(spark):
    """The exchange of the counts carries a long and its count, not a column for the part."""
    df = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    common = [(b"a", 3), (b"b", 2), (lm.END, 1)]
    ids = lm.Ids(lm.Classes(common), common)
    got = lm.count_contexts(df, spark.sparkContext.broadcast(ids))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(code" in plan
    assert dict(got.dtypes) == {"part": "int", "key": "bigint", "c": "bigint"}
