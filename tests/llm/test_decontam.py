import random

from media_analytics.llm import decontam

from .fixtures import documents, empty_documents


def naive_tiling(item, text, least):
    """Greedy string tiling as defined, quadratic: the longest unmarked match first."""
    marked_i, marked_t, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k]
                       and i + k not in marked_i and j + k not in marked_t):
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        out.append((n, i, j))
        marked_i.update(range(i, i + n))
        marked_t.update(range(j, j + n))


def test_tiling_equals_the_definition():
    rng = random.Random(4)
    for _ in range(150):
        words = "abc" if rng.random() < 0.5 else "abcdefghij"
        item = [rng.choice(words) for _ in range(rng.randint(3, 25))]
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5 and len(item) > 12:
            text[5:5] = item[6:] + ["z"] + item[:6]
        b = decontam.Benchmark([(1, " ".join(item))], 3)
        found, _ = b.matches(" ".join(text))
        got = b.tiles(found.get(0, []))
        want = naive_tiling(item, text, 3)
        assert sum(n for n, _, _ in got) == sum(n for n, _, _ in want) and sorted(got) == sorted(want)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_noisy_and_clean(spark):
    w = PASSAGE.split()
    docs = spark.createDataFrame([
        (1, "before words " + PASSAGE.upper() + " after"), (2, " ".join(w[10:] + ["mid"] + w[:10])),
        (3, "***" + "!!! ".join(w) + "***"), (4, " ".join(w[:6])), (5, "nothing of it here"), (6, None), (6, ""),
        (None, PASSAGE), (7, " ".join(w[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(100, PASSAGE), (101, None), (102, "too short"), (None, "")], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 100), (2, 100), (3, 100), (None, 100)}
    assert {r.doc_id: r.reordered for r in got}[2] and all(r.coverage == 1 for r in got)
    kept = decontam.clean(docs, bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [4, 5, 6, 6, 7]))


def test_long_passages_of_long_items_and_short_items(spark):
    item = [f"word{k}" for k in range(300)]
    docs = spark.createDataFrame([
        (1, "x " + " ".join(item[100:240]) + " y"), (2, " ".join(item[50:63])), (3, " ".join(item[50:62])),
        (4, "It is, Forty-Two! they said"), (5, "two forty"), (6, "forty"), (7, "say Ninety please"), (8, None)],
        "doc_id long, text string")
    bench = spark.createDataFrame([(100, " ".join(item)), (101, "forty two"), (102, "ninety"), (103, " .. ")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 100): (300, 140), (2, 100): (300, 13), (4, 101): (2, 2), (7, 102): (1, 1)}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 5, 6, 8]


def test_slices_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    many = sorted(map(tuple, decontam.contaminated(docs, bench, slice_words=400).collect()))
    assert one == many and one
    assert decontam.clean(docs, bench, slice_words=400).count() == docs.count() - len({r[0] for r in one})


def test_dirty_and_empty(spark):
    bench = spark.createDataFrame([(1, "cat sat on the mat and looked")], "item_id long, text string")
    df = documents(spark)
    assert sorted(r.doc_id for r in decontam.contaminated(df, bench).collect()) == [1, 2, 2]
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontam.contaminated(empty_documents(spark), bench).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == df.count()


def test_scripts_without_spaces(spark):
    """An item in the middle of a sentence without spaces is found; every character is a word."""
    item = "机器学习模型在大规模语料上训练后可以生成流畅的文本"
    assert decontam.words("ab机器 cd_学1") == ["ab", "机", "器", "cd", "学", "1"]
    docs = spark.createDataFrame([(1, f"我们知道{item}并且很有用"), (2, "今天的天气很好所以我们去公园散步"), (3, "plain words here")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.coverage) for r in decontam.contaminated(docs, items).collect()] == [(1, 1.0)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [2, 3]


def test_short_answers_do_not_empty_a_corpus(spark):
    docs = spark.createDataFrame([(1, "yes a b"), (2, "no way at all"), (3, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Yes"), (2, "way at all"), (3, "a")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (1, 3), (2, 2)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [3]
    assert sorted(r.doc_id for r in decontam.clean(docs, items, least_item=2).collect()) == [1, 3]


def test_repeated_ids_are_dealt_over_the_slices(spark):
    items = spark.createDataFrame([(None, f"alpha{k} beta gamma delta{k} eps zeta") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so alpha{k} beta gamma delta{k} eps zeta it is") for k in range(40)], "doc_id long, text string")
    slices = [len(s.value.items) for s in decontam._slices(items, decontam.MIN_MATCH, 60)]
    assert sum(slices) == 40 and max(slices) < 25
    assert decontam.contaminated(docs, items, slice_words=60).select("doc_id").distinct().count() == 40
