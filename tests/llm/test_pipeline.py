import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from media_analytics.llm import decontam, mixing, packing

from .fixtures import documents, empty_documents
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def key(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def steps(spark):
    """(docs, result) of each stage as run() chains them."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        result = stage(spark, docs, SF)
        rows = result.collect()
        out.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, result.schema)
    return out


def test_registered_and_ordered():
    assert E.queries()["pipeline"] is P.run
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "mix_sources", "token_ids"]


def test_language_keeps_documents_of_a_language(spark, steps):
    """All documents of the tables are in a language; planted mash goes."""
    docs, kept = steps[0]
    assert key(kept) == key(d for d in docs if any(c.isalpha() for c in d.text or ""))
    mash = "sdkfjh qwoeiru zxmcnb aslkdj qpwoei mznxbc fghjdk " * 4
    planted = {"doc_id": 10 ** 9, "text": mash, "lang": "en", "source": "web", "n_chars": len(mash)}
    more = spark.createDataFrame([*map(tuple, docs), tuple(planted[c] for c in docs[0].__fields__)], docs[0].__fields__)
    after = P.language_id(spark, more, SF).collect()
    assert key(after) == key(kept)


def test_near_duplicates_against_brute_force(steps):
    docs, kept = steps[1]
    docs = sorted(docs, key=lambda d: d.doc_id)
    comp = brute_components([brute_fingerprint(d.text) for d in docs])
    assert key(kept) == key(docs[c] for c in set(comp))


def test_decontamination_against_containment(spark, steps):
    docs, kept = steps[2]
    items = [" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = [d for d in docs if any(i in " ".join(decontam.words(d.text)) for i in items)]
    assert not {d.doc_id for d in holds} & {d.doc_id for d in kept}
    assert len(docs) - len(kept) == len(holds)  # the planted passages are whole


def test_mix_takes_what_the_operator_says(spark, steps):
    docs, taken = steps[3]
    df = spark.createDataFrame(docs)
    times = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert key(taken) == key(d for d in docs for _ in range(times[d.doc_id]))


def test_token_ids_against_the_library(steps):
    docs, got = steps[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = [len(library.encode(d.text, add_special_tokens=False).ids) + 1 for d in docs]
    assert sorted(r.n_tokens for r in got) == sorted(n)
    assert sorted(got, key=lambda r: r.start)[-1].start + sorted(got, key=lambda r: r.start)[-1].n_tokens == sum(n)


def test_run_equals_the_chained_stages(spark, steps):
    assert key(P.run(spark, SF).collect()) == key(steps[-1][1])


def test_dirty_documents_pass_every_stage(spark):
    for _, stage in P.STAGES:
        df = documents(spark)
        out = stage(spark, df, SF)
        assert out.columns == df.columns or stage is P.token_ids
        assert out.count() > 0
        assert stage(spark, empty_documents(spark), SF).count() == 0
