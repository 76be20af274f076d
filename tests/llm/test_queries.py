"""The registered queries over a whole table, against brute force (op7 and op9 have
SQL and are compared in tests/test_oracle.py)."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from media_analytics.llm import decontam

from .fixtures import texts
from .test_ann import brute as brute_neighbours
from .test_decontam import naive_tiling
from .test_lm import check_counts
from .test_packing import want_rows
from .test_pii import check_base as check_personal
from .test_secret_scan import check_base
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(texts(spark.read.parquet(f"{SF}/documents.parquet")))


def run(spark, name):
    return E.queries()[name](spark, SF).collect()


def test_one_query_per_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"op7_chat_quotes", "op9_mixing", "op11_collocations", "op12_lexical_search"} <= set(E.oracle_sql())


def test_op1(spark, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {(i, f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, brute_components(fps))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op1_simhash")} == want


def test_op2(spark, rows):
    check_counts(rows, run(spark, "op2_lm_score"))


def test_op3(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(e.ids) for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = [(i, len(t.encode()), k, k > 1024) for (i, t), k in zip(rows, n)]
    assert sorted(map(tuple, run(spark, "op3_token_counts"))) == want


def test_op4(spark, rows):
    check_base(rows, run(spark, "op4_secrets"))


def test_op5(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op5_language")}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == dict(rows).keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([r.lang_pred == lang[i] for i, r in got.items() if r.held_out]) >= 0.95


def test_op6(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, got = brute_neighbours(vectors), {}
    for r in run(spark, "op6_ann"):
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {x[1] for x in want[q]}) / 20 for q in want]) >= 0.9


def test_op8(spark, rows):
    assert sorted(map(tuple, run(spark, "op8_token_ids"))) == want_rows(rows)


def test_op10(spark, rows):
    items = {r.item_id: decontam.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for i, t in rows:
        text = decontam.words(t)
        seen = set(zip(*[text[k:] for k in range(decontam.MIN_MATCH)]))
        for item, words in items.items():
            if seen.isdisjoint(zip(*[words[k:] for k in range(decontam.MIN_MATCH)])):
                continue  # no tile without a shared seed
            near = [k for k, w in enumerate(text) if w in set(words)]
            part = text[max(0, near[0] - 1):near[-1] + 2]
            if len(part) > 600:
                continue  # the quadratic definition is too slow; judged by containment below
            if sum(n for n, _, _ in naive_tiling(words, part, decontam.MIN_MATCH)) >= decontam.THRESHOLD * len(words):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in run(spark, "op10_decontamination")}
    assert want <= got
    text = {i: " ".join(decontam.words(t)) for i, t in rows}
    assert all((i, k) in want or " ".join(items[k]) in text[i] for i, k in got)


def test_op13(spark, rows):
    check_personal(rows, run(spark, "op13_pii"))
