import hashlib
import itertools
import re

import numpy as np
import pytest

from media_analytics.llm import pii

from .fixtures import documents, empty_documents, texts

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    """(kind number, start, end) by the plain patterns."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def check_base(rows, got):
    want = sorted((str(i), *np.bincount([k for k, _, _ in brute(t)], minlength=4).tolist(),
                   hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest())
                  for i, t in rows)
    assert want == sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    for r in got:  # every base span stays, the others have kinds of their own
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert sum(not k.startswith("crf_") for k in kinds) == r.n_email + r.n_ip + r.n_card + r.n_phone
        assert sum(k.startswith("crf_") for k in kinds) == r.n_crf


CASES = ["a@b.c@d.e", "a@b.c.@d.e.f", "x.y+z%_-@h-o.st.", "@a.b a@b a@@b.c é@é.é", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.256.1.1.1.1",
         "0001.002.03.4 1.2.3.0256", "4111 1111 1111 1111", "4111-1111-1111-1111 5 4111111111111111", "2020 4111 1111 1111 1111",
         "4111  1111 1111 1111", "+1 (988) 555-2485.", "+12345 +1234567+12345678", "++1 234 567 8 (9) +1-", "+1.2.3.4 190.137.223.20",
         "١٢٣.1.1.1.1", "a@1.2.3.4", "+" + "1 " * 15, "9" * 40, "1.1" * 30]


def test_rules():
    rng = np.random.default_rng(1)
    some = ["".join(rng.choice(list("a1+.@- ()5"), 60)) for _ in range(3000)]
    some += ["".join(rng.choice(list("0123456789 -"), 80, p=[.095] * 10 + [.025] * 2)) for _ in range(300)]
    for c in CASES + some:
        assert pii.rule_spans(c) == brute(c), c


def test_long_runs_take_linear_time():
    long = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "@" * 50_000 + "+1 " * 50_000
    assert isinstance(pii.scan_all([long], None)[0], list)


@pytest.fixture(scope="module")
def field(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def found(text, field):
    return [(pii.SPAN_KINDS[k], text[a:b]) for k, a, b in pii.scan_all([text], field)[0]]


def test_distant_tokens_share_their_label(field):
    text = "Call +1 (988) 555-2485 today." + " The rest is plain." * 200 + " Her number was 988-555-2485, or 555-2485 here."
    assert found(text, field) == [("phone", "+1 (988) 555-2485"), ("crf_phone", "988-555-2485"), ("crf_phone", "555-2485")]
    alone = "The rest is plain. Order 9885552485 came"
    assert found(alone, field) == []  # the same digits without the finding
    both = "Call +19885552485 today. Order 9885552485 came"
    assert found(both, field) == [("phone", "+19885552485"), ("crf_phone", "9885552485")]
    assert ("crf_email", "joan.miller77") in found("To joan.miller77@host.example.com now. And joan.miller77 said so", field)


def test_other_ways_to_write(field):
    assert found("it was 42-144-35-254 then", field) == [("crf_ip", "42-144-35-254")]
    assert found("paid by 4041.8949.7460.8795 then", field) == [("crf_card", "4041.8949.7460.8795")]
    text = "In 2024-01-02 at 12:30, v3.1.4 of CC BY-NC 4.0. cost $1,234.50, 99% of 1990-2020; see No. 42 and 978-3-16-148410-0"
    assert found(text, field) == []


def test_held_out_drawn_texts(field):
    drawn = pii._drawn(np.random.default_rng(99), 1500)
    hit, asked, wrong = np.zeros(4), np.zeros(4), 0
    for (text, spans), got in zip(drawn, pii.scan_all([t for t, _ in drawn], field)):
        rules = pii.rule_spans(text)
        for k, a, b in spans:
            if (k, a, b) not in rules:
                asked[k] += 1
                hit[k] += any(x >= 4 and c < b and a < d for x, c, d in got)
        wrong += sum(x >= 4 and not any(c < b and a < d for _, a, b in spans) for x, c, d in got)
    assert (hit / asked >= 0.9).all()
    assert wrong <= 0.02 * len(drawn)


def test_marginals_are_exact_without_loops():
    """Sum-product equals the sum over all labellings where runs and stars form trees."""
    rng = np.random.default_rng(3)
    field = pii.Field()
    field.w = rng.normal(0, 1, field.w.shape) / 5
    field.t = rng.normal(0, 1, field.t.shape)
    field.s = rng.uniform(0, 2, field.s.shape)
    # a run of two, and two tokens tied to its second by both kinds of key
    text = "1a 98765432 word word2 98765432 word3 0098765432"
    at = [p for p in pii.tokens(text) if text[p[0]:p[1]] not in ("word2", "word3")]
    b = pii.Batch([text], [at])
    assert b.n == 4 and len(b.left) == 1 and sorted(b.which) == [0, 0, 1, 1, 1]
    star = [k for k in range(len(b.token)) if b.which[k] == 0]  # the star of equal tokens alone is a tree
    b.token, b.key, b.which = b.token[star], np.zeros(2, int), b.which[star]
    b.keys = 1
    pair = np.exp(field.ties()[0] * 2) + pii.LABELS - 1  # two tokens of one label, against two labels of tie 1
    assert field.ties().shape == (2, pii.LABELS) and (pair > pii.LABELS).all()
    held = np.array([-1, -1, 4, -1])
    u, want = field.unary(b), np.zeros((b.n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=b.n):
        if y[2] != 4:
            continue
        base = sum(u[i, y[i]] for i in (0, 1, 3)) + field.t[y[0], y[1]]
        total = sum(np.exp(base + sum(field.ties()[0, node] * (y[i] == node) for i in b.token)) for node in range(pii.LABELS))
        for i in range(b.n):
            want[i, y[i]] += total
    want /= want.sum(1, keepdims=True)
    assert np.allclose(field.marginals(b, held), want, atol=1e-6)


def test_texts_of_a_block_are_scanned_as_alone(field):
    some = [t for t, _ in pii._drawn(np.random.default_rng(3), 60)] + CASES + ["", "no number"]
    assert pii.scan_all(some, field) == [pii.scan_all([t], field)[0] for t in some]


def test_large_group_of_equal_tokens(field):
    text = "+1 (988) 555-2485 " + "and 988-555-2485 " * 5000
    assert [k for k, _ in found(text, field)].count("crf_phone") == 5000


def test_whole_table_and_dirty_documents(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_base(texts(docs), pii.scan_documents(docs, field).collect())
    df = documents(spark)
    check_base(texts(df), pii.scan_documents(df, field).collect())
    assert pii.scan_documents(empty_documents(spark), pii.learn(empty_documents(spark))).count() == 0


def test_same_field_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = pii.learn(docs), pii.learn(docs.repartition(5))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.threshold, b.threshold)
