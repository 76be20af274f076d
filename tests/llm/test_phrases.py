import re
from collections import Counter

import numpy as np
import pytest

from media_analytics.llm import phrases

from .fixtures import documents, empty_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    """Everything counted, every cut scored; docs: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            own.update(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {q for p, a in kept.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  for q in [p[i:i + k]] if a >= kept[q]}
        found = []
        for p, a in kept.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def made(seed, n=150):
    """Texts of few words with repeated passages, so that counts tie and phrases nest."""
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "C", "dd", "é", "f'", "ﬀ", " x", "(y)", "z9"]
    passages = [" ".join(rng.choice(vocabulary, 6)) for _ in range(4)]
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 30)), p=[.3, .2, .1, .1, .05, .05, .05, .05, .05, .05]))
        for k in range(len(words)):
            words[k] += str(rng.choice(["", "", "", ".", ",", "\t", "\n", " ;"]))
        if rng.random() < 0.5:
            words.insert(0, passages[rng.integers(4)] + ".")
        out.append((["en", "de", None, "und"][i % 4], "  ".join(words) if i % 9 else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    want = brute(docs, 5, 40)
    assert len(want) > 60
    assert rows(phrases.mine(df, least=5, top=40)) == want
    # words numbered by a join, and many small batches, change nothing
    assert rows(phrases.mine(df, least=5, top=40, dictionary=4, first_batch=50, batch=400)) == want


def test_small_top_settles_early(spark, monkeypatch):
    """Frequent first words are not expanded when the best phrases have rare words."""
    docs = [("en", f"the of the of and the of. rare{k % 30} pair{k % 30}") for k in range(600)]
    df = spark.createDataFrame(docs, "lang string, text string")
    expanded, real = [], phrases.grown
    monkeypatch.setattr(phrases, "grown", lambda numbers, words, least: expanded.append(len(words)) or real(numbers, words, least))
    got = rows(phrases.mine(df, least=5, top=10, first_batch=1200, batch=1000))
    assert got == brute(docs, 5, 10)
    assert sum(expanded) == 60  # of 63 words


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 10)
    text = b"Alpha beta gamma. delta epsilon  zeta\teta! theta"
    words = [w for run in phrases.word_runs(text) for w in run if w]
    assert words == b"alpha beta gamma \n delta epsilon zeta eta \n theta".replace(b" \n ", b" \\n ").replace(b"\\n", b"\n").split(b" ")
    assert list(phrases.word_runs(None)) == list(phrases.word_runs(b"")) == []


def test_scores_beyond_64_bits():
    big = np.array([10 ** 12], np.int64)
    score, x, y = phrases.lowest_cuts(big, np.array([10 ** 13]), [big * 2, big], [big, big * 2])
    assert (score[0], x[0], y[0]) == (1000 * 10 ** 25 // (2 * 10 ** 24), 2 * 10 ** 12, 10 ** 12)


def test_dirty_and_empty(spark):
    df = documents(spark)
    want = brute([(r.lang, r.text) for r in df.collect()], 2, 50)
    assert rows(phrases.mine(df, least=2, top=50)) == want
    assert rows(phrases.mine(df, least=2, top=50, dictionary=3)) == want
    assert phrases.mine(empty_documents(spark)).count() == 0
    assert phrases.mine(df.where("doc_id = 6")).count() == 0
