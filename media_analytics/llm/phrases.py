"""Phrase collocations by best-first branch-and-bound growth.

Texts (A-Z lower-cased) are split at ``.,;:!?`` and line ends into pieces, these at spaces and
tabs into words. Per language, n counts the words and f(phrase) the occurrences of a
phrase inside pieces, overlaps included. Candidates have 2 to 5 words and a = f >= ``LEAST``.
Cut after its first k words a candidate has l = f(first part), r = f(rest) and the score
floor(1000*a*n / (l*r)); its lowest cut counts. A candidate goes if a longer one that
contains it is as frequent.

* **Words** are counted over all texts. Only words with f >= ``LEAST`` can be part of a
  candidate; they get numbers, and the texts are written once as numbers (rarer
  words and ends of pieces are 0). The ``DICTIONARY`` commonest are numbered in the
  workers, the others by a join, so the vocabulary may have any size.
* **Bound**: for every phrase that begins with the word w, the cut after w gives
  a*n / (f(w) * r) <= n / f(w), since a <= r. floor(1000*n / f(w)) is thus an upper bound for
  all phrases that grow from w.
* **Growth**: first words are expanded best bound first, in batches of at most ``BATCH``
  occurrences (one word more, and fewer in the first batch), so at most a hundredth as many phrases
  of each length come from a batch. Its phrases grow word by word: each pass counts the
  one-word extensions of the phrases that reached ``LEAST``. Another pass counts the rests
  of all cuts and tells whether all occurrences of a phrase follow the same word.
* **End**: a language is settled when its next bound is below its 2000th surviving
  score (an equal bound could still tie). Only languages that are not settled go on.

Scores are exact whole numbers of any size. Null or empty texts have no words; a
null lang is ``und``. Repeated rows count each; a word may be of any length. Empty
tables, or ones without a frequent phrase, give an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, new_folder, prefix_sums, ship, text_blocks

LEAST = 100
TOP = 2000
LONGEST = 5
DICTIONARY = 1_000_000   # numbered words that a worker holds
DICTIONARY_BYTES = 64    # of one of these words
FIRST_BATCH = 1 << 24    # occurrences of the first words that are expanded together
BATCH = 1 << 27
ROW = 1 << 12            # numbers in one row of the written texts, about
CHUNK = 1 << 20          # characters whose words are held as Python objects
HELD = 4_000_000         # keys that a task sorts at once

END = b"\n"
# A-Z to a-z, ends of pieces to one character, tabs to spaces
SPLIT = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in LOWER)


def word_runs(text: bytes | None):
    """Lists of a text's words and ``END`` marks (and empty strings), a chunk at a time."""
    data = (text or b"").translate(SPLIT)
    a = 0
    while a < len(data):
        b = len(data) if len(data) - a <= CHUNK else data.find(b" ", a + CHUNK)
        b = len(data) if b < 0 else b
        yield data[a:b].replace(END, b" \n ").split(b" ")
        a = b + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f); the row without a word holds the language's n."""
    import pyarrow as pa

    def work(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, c in held.items():
                for skip in (b"", END):
                    c.pop(skip, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(c) + 1)), pa.array([*c, None], pa.binary()).cast(pa.string()),
                     pa.array([*c.values(), sum(c.values())], pa.int64())], ["lang", "word", "f"])
            held.clear()

        for batch, texts in text_blocks(batches):
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                for words in word_runs(t):
                    held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > 500_000:
                yield from rows()
        yield from rows()

    return (docs.mapInArrow(work, "lang string, word string, f long")
            .groupBy("lang", "word").agg(F.sum("f").alias("f")))


def write_numbers(docs: DataFrame, words: DataFrame, n_words: int, dictionary: int) -> DataFrame:
    """The texts as rows of little-endian 4-byte word numbers, each row ending with 0."""
    import pyarrow as pa

    spark = docs.sparkSession
    short = words.where(F.octet_length("word") <= DICTIONARY_BYTES)
    whole = n_words <= dictionary and not words.where(F.octet_length("word") > DICTIONARY_BYTES).head(1)
    common = (short if whole else short.orderBy(F.col("f").desc(), "id").limit(dictionary)).select("lang", "word", "id")
    numbers: dict[str, dict[bytes, int]] = {}
    for r in common.collect():
        numbers.setdefault(r.lang, {b"": -1, END: 0})[r.word.encode()] = r.id
    shared = spark.sparkContext.broadcast(numbers)
    path = new_folder(spark, "phrase-numbers")

    def work(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for batch, texts in text_blocks(batches):
            runs, langs, unknown, other = [np.zeros(1, np.int64)], [], [], {}
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                own = shared.value.get(lang)
                if own is None and whole:
                    continue
                own = own or {b"": -1, END: 0}
                for tokens in word_runs(t):
                    if whole:
                        ids = [own.get(w, 0) for w in tokens]
                    else:  # words beyond the dictionary are -2, -3, ... in the order of ``unknown``
                        ids = [own[w] if w in own else -2 - other.setdefault((lang, w), len(other)) for w in tokens]
                    runs.append(np.array(ids, np.int64))
                runs.append(np.zeros(1, np.int64))
            a = np.concatenate(runs)
            a = a[a != -1]
            zero = a == 0
            a = a[1:][~(zero[1:] & zero[:-1])]  # one 0 between pieces
            if not len(a):
                continue
            ends = np.flatnonzero(a == 0) + 1
            cuts = [0, *ends[np.flatnonzero(np.diff((ends - 1) // ROW, append=1 << 60))].tolist()]
            unknown = list(other)
            out = [], [], [], []
            for x, y in zip(cuts, cuts[1:]):
                own = a[x:y]
                asked = np.unique(own[own < -1])[::-1] if not whole else own[:0]
                if len(asked):
                    at = np.full(len(unknown), -1, np.int64)
                    at[-2 - asked] = np.arange(len(asked))
                    own = np.where(own < -1, -1 - at[np.maximum(-2 - own, 0)], own)  # -1, -2, ... in ``langs`` and ``words``
                out[0].append((part << 33) + row)
                out[1].append(own.astype("<i4").tobytes())
                out[2].append([unknown[-2 - k][0] for k in asked])
                out[3].append([unknown[-2 - k][1].decode() for k in asked])
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.string())),
                 pa.array(out[3], pa.list_(pa.string()))], ["row", "ids", "langs", "words"])

    docs.mapInArrow(work, "row long, ids binary, langs array<string>, words array<string>").write.parquet(path)
    found = spark.read.parquet(path)
    if whole:
        return found.select("ids")
    # a rarer word stands in at most as many rows as it has occurrences
    asked = found.select("row", F.posexplode(F.arrays_zip("langs", "words")).alias("k", "w"))
    known = (asked.join(words.select("lang", "word", "id"),
                        (F.col("w.langs") == F.col("lang")) & (F.col("w.words") == F.col("word")))
             .groupBy("row").agg(F.collect_list("k").alias("k"), F.collect_list("id").alias("id")))

    def fill(batches):
        for batch in batches:
            rows = []
            for ids, k, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "k", "id"))):
                a = np.frombuffer(ids, "<i4")
                table = np.zeros(1 + max(0, int(-a.min())), "<i4")  # words not found are rare: 0
                table[1 + np.array(k or [], np.int64)] = own or []
                rows.append(np.where(a < 0, table[np.maximum(-a, 0)], a).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    filled = new_folder(spark, "phrase-numbers")
    found.select("row", "ids").join(known, "row", "left").mapInArrow(fill, "ids binary").write.parquet(filled)
    return spark.read.parquet(filled)


# ---- passes over the written texts ------------------------------------------------

def _runs(batches):
    """Arrays of about ``HELD`` numbers, each beginning and ending with 0."""
    held, size = [np.zeros(1, "<i4")], 0
    for batch in batches:
        for ids in batch.column("ids").to_pylist():
            held.append(np.frombuffer(ids, "<i4"))
            size += len(held[-1])
            if size >= HELD:
                yield np.concatenate(held)
                held, size = [np.zeros(1, "<i4")], 0
    if size:
        yield np.concatenate(held)


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Index of each of ``asked`` in the sorted ``keys``, -1 where it is not."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _follow(a: np.ndarray, first: np.ndarray, levels: list[np.ndarray]):
    """Walks the tree from every place of ``a``: yields, per level, the places that reach it and
    their nodes. ``first``: node of each word (-1: none); a level's sorted keys are parent << 32 | word."""
    place = np.flatnonzero(a[:-1])
    node = first[np.minimum(a[place], len(first) - 1)]
    place, node = place[node >= 0], node[node >= 0]
    yield place, node
    for depth, keys in enumerate(levels, 1):
        node, word = node[a[place + depth] > 0], place[a[place + depth] > 0]
        place, word = word, a[word + depth].astype(np.int64)
        node = _find(keys, (node.astype(np.int64) << 32) | word)
        place, node = place[node >= 0], node[node >= 0]
        yield place, node


def _first_nodes(words: np.ndarray) -> np.ndarray:
    table = np.full(int(words.max(initial=0)) + 2, -1, np.int64)
    table[words] = np.arange(len(words))
    return table


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def extensions(numbers: DataFrame, words: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the one-word extensions of the last level's phrases that occur ``least`` times."""
    import pyarrow as pa

    shared = numbers.sparkSession.sparkContext.broadcast((words, levels))

    def work(batches):
        words, levels = shared.value
        first, depth, parts, size = _first_nodes(words), 1 + len(levels), [], 0
        for a in _runs(batches):
            *_, (place, node) = _follow(a, first, levels)
            word = a[place + depth].astype(np.int64)
            parts.append(np.unique((node[word > 0] << 32) | word[word > 0], return_counts=True))
            size += len(parts[-1][0])
            if size > 2 * HELD:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > HELD:
                    yield from _batches(*parts.pop())
                    size = 0
        if parts:
            yield from _batches(*_merged(parts))

    def _batches(keys, counts):
        for k in range(0, len(keys), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 20)]), pa.array(counts[k:k + (1 << 20)])], ["key", "n"])

    found = (numbers.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least).toPandas().sort_values("key"))
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def occurrences(numbers: DataFrame, words: np.ndarray, levels: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level (single words first): the counts of the nodes, and the word before all their
    occurrences (0 if none or several)."""
    import pyarrow as pa

    sizes = [len(words), *map(len, levels)]
    start = np.concatenate([[0], np.cumsum(sizes)])
    shared = numbers.sparkSession.sparkContext.broadcast((words, levels))

    def work(batches):
        words, levels = shared.value
        first = _first_nodes(words)
        n, low, high = (np.zeros(start[-1], np.int64) for _ in range(3))
        low += 1 << 40
        for a in _runs(batches):
            for depth, (place, node) in enumerate(_follow(a, first, levels)):
                node = node + start[depth]
                n += np.bincount(node, minlength=len(n))
                if depth and len(node):
                    before = a[place - 1].astype(np.int64)
                    order = np.argsort(node, kind="stable")
                    node, before = node[order], before[order]
                    at = np.flatnonzero(np.diff(node, prepend=-1))
                    low[node[at]] = np.minimum(low[node[at]], np.minimum.reduceat(before, at))
                    high[node[at]] = np.maximum(high[node[at]], np.maximum.reduceat(before, at))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (at, n[at], low[at], high[at]))), ["node", "n", "low", "high"])

    found = (numbers.mapInArrow(work, "node long, n long, low long, high long").groupBy("node")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas())
    n, same = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int64)
    at = found["node"].to_numpy(np.int64)
    n[at] = found["n"]
    same[at] = np.where(found["low"] == found["high"], found["high"], 0)
    return ([n[x:y] for x, y in zip(start, start[1:])], [same[x:y] for x, y in zip(start, start[1:])])


# ---- growth -----------------------------------------------------------------------

def _tree(phrases: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(first words, keys of each level, node of each phrase) of the tree of phrases, given as
    one matrix of word numbers per length from 1."""
    words = np.unique(np.concatenate([p[:, 0] for p in phrases]))
    nodes = [np.searchsorted(words, p[:, 0]) for p in phrases]
    levels = []
    for depth in range(1, len(phrases)):
        own = [(nodes[k] << 32) | phrases[k][:, depth] for k in range(depth, len(phrases))]
        levels.append(np.unique(np.concatenate(own)))
        for k, keys in zip(range(depth, len(phrases)), own):
            nodes[k] = np.searchsorted(levels[-1], keys)
    return words, levels, nodes


def grown(numbers: DataFrame, words: np.ndarray, least: int):
    """The candidates that begin with one of ``words``: per length from 2 (phrases as rows of
    word numbers, their counts, whether a one-word longer candidate is as frequent, and l and r of
    each cut as lists of arrays)."""
    levels, counts, phrases = [], [], [words[:, None]]
    while len(levels) < LONGEST - 1:
        keys, n = extensions(numbers, words, levels, least)
        if not len(keys):
            break
        levels.append(keys)
        counts.append(n)
        phrases.append(np.concatenate([phrases[-1][keys >> 32], (keys & 0xFFFFFFFF)[:, None]], axis=1))
    if not levels:
        return []
    # count single words, the rests of all cuts, and what the candidates follow
    every = [[p] if p.shape[1] < LONGEST else [] for p in phrases]
    every += [[] for _ in range(LONGEST - len(every))]
    for p in phrases[1:]:
        for k in range(1, p.shape[1]):
            every[p.shape[1] - k - 1].append(p[:, k:])
    deep = max(k for k, x in enumerate(every) if x) + 1
    tree_words, tree_levels, nodes = _tree([np.concatenate(x) for x in every[:deep]])
    n, same = occurrences(numbers, tree_words, tree_levels)
    out, taken = [], [0] * deep

    def take(length: int, rows: int) -> np.ndarray:
        at = taken[length - 1]
        taken[length - 1] += rows
        return nodes[length - 1][at:at + rows]

    own = [take(p.shape[1], len(p)) if p.shape[1] < LONGEST else None for p in phrases]
    for level, p in enumerate(phrases[1:]):
        a = counts[level]
        inside = np.zeros(len(a), bool)
        if p.shape[1] < LONGEST:
            inside |= same[p.shape[1] - 1][own[level + 1]] > 0
        if level + 1 < len(levels):
            parent = levels[level + 1] >> 32
            inside[parent[counts[level + 1] == a[parent]]] = True
        # l of the cut after k words: the count of the node k words deep on the way here
        left, node = [None] * (p.shape[1] - 1), np.arange(len(a))
        for k in range(p.shape[1] - 1, 0, -1):
            node = levels[k - 1][node] >> 32
            left[k - 1] = counts[k - 2][node] if k > 1 else n[0][own[0][node]]
        right = [n[p.shape[1] - k - 1][take(p.shape[1] - k, len(p))] for k in range(1, p.shape[1])]
        out.append((p, a, inside, left, right))
    return out


def lowest_cuts(a: np.ndarray, n: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]):
    """(score, l, r) of the lowest-scoring cut of each candidate; equal scores: the first."""
    scores = np.array([(1000 * a.astype(object) * n.astype(object)) // (x.astype(object) * y.astype(object))
                       for x, y in zip(left, right)], object).astype(np.int64)
    k = scores.argmin(0)
    rows = np.arange(len(a))
    return scores[k, rows], np.array(left)[k, rows], np.array(right)[k, rows]


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, dictionary: int = DICTIONARY,
         first_batch: int = FIRST_BATCH, batch: int = BATCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` best phrases."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.col("text").cast("string").alias("text")).where("text <> ''")
    counted = cut(count_words(src).where(F.col("word").isNull() | (F.col("f") >= least)))
    sizes = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    frequent = counted.where("word IS NOT NULL").join(sizes, "lang").withColumn("one", F.lit(1))
    words = cut(prefix_sums(frequent, [], ["lang", "word"], "one", "id").withColumn("id", F.col("id") + 1))
    n_words = words.count()
    if n_words >= 1 << 31:
        raise ValueError("more frequent words than 4-byte numbers")
    schema = "lang string, a long, l long, r long, n long, score long, ids array<long>"
    path = new_folder(spark, "phrases")
    spark.createDataFrame([], schema).write.parquet(path)
    best: dict[str, np.ndarray] = {}  # scores of each language's best survivors
    if n_words:
        numbers = write_numbers(src, words, n_words, dictionary)
        # numbers of a language are in one range
        ranges = words.groupBy("lang", "n").agg(F.min("id").alias("id")).toPandas().sort_values("id")
        langs, first_id, n_of = (ranges[c].to_numpy() for c in ("lang", "id", "n"))
        # best bound first: the lowest share of the language's words
        ranked = words.select("id", "f", (F.col("f") / F.col("n")).alias("share"))
        ranked = cut(prefix_sums(ranked, [], ["share", "id"], "f", "before").withColumn(
            "batch", F.when(F.col("before") < first_batch, 0)
            .otherwise(1 + ((F.col("before") - first_batch) / batch).cast("long"))))
        for k in [r.batch for r in ranked.groupBy("batch").count().orderBy("batch").collect()]:
            asked = ranked.where(F.col("batch") == k).select("id", "f").toPandas().sort_values("id")
            own, f = asked["id"].to_numpy(np.int64), asked["f"].to_numpy(np.int64)
            lang = np.searchsorted(first_id, own, "right") - 1
            bar = np.array([best[x][-1] if len(best.get(x, ())) == top else 0 for x in langs], np.int64)
            bound = (1000 * n_of[lang].astype(object)) // f
            own = own[np.array(bound >= bar[lang], bool)]
            if not len(own):
                continue
            for phrases, a, inside, left, right in grown(numbers, own, least):
                lang = np.searchsorted(first_id, phrases[:, 0], "right") - 1
                score, x, y = lowest_cuts(a, n_of[lang], left, right)
                keep = ~inside & (score >= bar[lang])
                for g in np.unique(lang[keep]):
                    more = np.concatenate([best.get(langs[g], np.zeros(0, np.int64)), score[keep & (lang == g)]])
                    best[langs[g]] = np.sort(more)[::-1][:top]
                own_n, ids = n_of[lang[keep]].astype(np.int64), phrases[keep]
                rows = pa.table({"lang": langs[lang[keep]].tolist(), "a": a[keep], "l": x[keep], "r": y[keep], "n": own_n,
                                 "score": score[keep], "ids": pa.array(ids.tolist(), pa.list_(pa.int64()))})
                if rows.num_rows:
                    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    bars = spark.createDataFrame([(x, int(s[-1]) if len(s) == top else 0) for x, s in best.items()], "lang string, bar long")
    kept = (spark.read.schema(schema).parquet(path).join(bars, "lang").where(F.col("score") >= F.col("bar")).drop("bar")
            .withColumn("phrase_id", F.expr("concat_ws(',', transform(ids, i -> cast(i as string)))")))
    # the words' numbers back to the words
    spelled = (kept.select("phrase_id", F.posexplode("ids").alias("k", "id")).join(words.select("id", "word"), "id")
               .groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
               .select("phrase_id", F.array_join(F.col("w.word"), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (kept.join(spelled, "phrase_id").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, k.k, unnest(range(1, len(ws) - k.k + 2)) AS s
           FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS k) k WHERE len(ws) >= k.k),
counts AS (SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY 1, 2, 3),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j.j, n, l.f AS l, r.f AS r,
         CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM frequent c JOIN (SELECT unnest([1, 2, 3, 4]) AS j) j ON j.j < c.k JOIN sizes ON sizes.lang = c.lang
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j.j], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j.j + 1:c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
  SELECT lang, f, array_to_string(ws[1:k - 1], ' ') AS phrase FROM frequent WHERE k > 2
  UNION ALL SELECT lang, f, array_to_string(ws[2:k], ' ') FROM frequent WHERE k > 2),
inside AS (SELECT lang, phrase, max(f) AS f FROM parts GROUP BY 1, 2),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank,
         c.phrase, a, l, r, n, score
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * a)
SELECT * FROM ranked WHERE rank <= 2000
"""
