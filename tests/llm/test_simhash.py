import random

import numpy as np
import xxhash
from media_analytics.llm import common, simhash

from .fixtures import documents, empty_documents, texts


def brute_fingerprint(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    values = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype="<u8")
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(values))


def brute_components(fps, radius=4):
    """Position of the first member of each position's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_dirty_documents_against_brute_force(spark):
    df = documents(spark)
    rows = texts(df)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = sorted(((i, f, least[c]) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


def test_hash_is_the_engines(spark):
    rows = ["", "a", "abc", "x" * 31, "é" * 40]
    got = spark.createDataFrame([(x,) for x in rows], "s string").selectExpr("s", "xxhash64(s) h").collect()
    assert all(r.h % (1 << 64) == xxhash.xxh64_intdigest(r.s.encode(), 42) for r in got)


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 30])):  # chains and balls of near copies
            out.append(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out))[:n]


def test_trees_and_tiles_find_every_link(spark):
    for n, shard, segments in ((700, 1 << 16, 3), (700, 40, 3), (300, 8, 2), (300, 16, 1)):
        fps = clustered(n, n + shard)
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
        got = {}
        for r in simhash.linked(nodes, segments=segments, shard=shard, sample=200).collect():
            got.setdefault(r.root, set()).add(r.node)
        want = {}
        for f, c in zip(signed, brute_components(fps)):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(300)}


def test_prefix_sums_over_a_hot_group(spark):
    rows = [(g, i, i % 7) for g, n in ((None, 20), ("a", 500), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r.g, r.i): r.s for r in common.prefix_sums(df, ["g"], ["i"], "v", "s", partitions=5).collect()}
    assert got == {(g, i): sum(j % 7 for j in range(i)) for g, i, _ in rows}


def test_keep_one(spark):
    df = documents(spark)
    found = simhash.near_duplicates(df).collect()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({r.component for r in found})
    assert sum(r.text is not None and r.text.startswith("The cat") for r in rows) == 1
    assert {r.doc_id for r in rows if r.text and r.text.startswith("The cat")} == {1}


def test_empty(spark):
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.keep_one(empty_documents(spark)).count() == 0
