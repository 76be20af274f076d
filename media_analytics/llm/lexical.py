"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Terms are the maximal runs of digits, letters A-Z (lower-cased) and characters beyond
ASCII. A document's score for an item is the sum over the item's terms (repeats
included) of the term's weight times the term's impact in the document; weights and
impacts are whole numbers (``weight``, ``impact``, ``length_factor``).

* **Lists**: one pass over the documents counts their terms and writes, per document,
  its length and the counts of the terms that any item asks for. From these come
  N, L and df (sums in the tasks, then one group-by).
* **Shards**: every task cuts its documents into shards of about ``SHARD`` postings, so
  no list, however common its term, is held or sorted by one task. In a shard each term's
  postings are sorted by impact.
* **NRA**: per item and shard the lists are read in falling order of what they can
  still add. A document's lower bound is what was read of it; its upper bound adds, for
  each list that it was not read from, the next value of the list, unless even one
  occurrence would stand before that value (its length gives its least impact). Reading
  goes on until no unread document can reach the 20th lower bound, and every document
  whose upper bound reaches it has equal bounds: membership, ties and scores are then
  exact. The best of earlier shards of a task raise the bound to reach.
* The best 20 of each task are merged in two steps (per group of tasks, then over all).

The items are the query set, taken in blocks of ``ITEM_BYTES`` of text, so what is
broadcast is bounded; each block is searched against all documents.

Null or empty texts have no terms and are not found; items without terms find
nothing. Repeated documents are ranked each on their own (null ids last among
equal scores), repeated items are answered each. Empty tables give an empty result;
other columns are not read. A word of any length is one term.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, new_folder, prefix_sums, ship, text_blocks

TOP = 20
SHARD = 2_000_000
ITEM_BYTES = 32 << 20
STEP = 0.7            # each round reads down to this share of the largest value left
GROUPS = 64           # groups of tasks whose results are merged first

# letters, digits and bytes beyond ASCII stay, all else separates terms
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // all_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """Documents with their impact-sorted lists."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray,
                 tf: np.ndarray, n_terms: int):
        """ids, known, m: of each document (known: its id is not null); doc, term, tf: postings."""
        self.ids, self.known, self.docs = ids, known, len(ids)
        self.least = impact(np.ones(len(m), np.int64), m)
        value = impact(tf, m[doc])
        order = np.lexsort((-value, term))
        self.doc, self.value = doc[order], value[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, asked: list[tuple[int, int]], bar: int = 0, top: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of the ``top`` best for an item, given as
        (term, weight times repeats). Documents below the score ``bar`` may be left out."""
        lists = [(c, self.doc[a:b], self.value[a:b]) for t, c in asked
                 for a, b in [self.first[t:t + 2]] if c > 0 and b > a]
        lower, read = np.zeros(self.docs, np.int64), 0
        seen = np.zeros((len(lists), self.docs), bool)
        at = [0] * len(lists)
        after = np.array([v[0] for _, _, v in lists], np.int64)  # next value of each list
        factor = np.array([c for c, _, _ in lists], np.int64)
        open_ = np.ones(len(lists), bool)  # lists that can still change the answer
        while True:
            target = int((factor * after)[open_].max(initial=0) * STEP)
            for k, (c, docs, values) in enumerate(lists):
                if open_[k] and at[k] < len(docs) and c * after[k] >= target:
                    # to the first value below the target; the values fall
                    end = len(docs) - int(np.searchsorted(values[at[k]:][::-1], -(-target // c))) if target else len(docs)
                    end = max(end, at[k] + 1)
                    own = docs[at[k]:end]
                    lower[own] += c * values[at[k]:end]
                    seen[k, own] = True
                    read += end - at[k]
                    at[k] = end
                    after[k] = values[end] if end < len(docs) else 0
            left = int((factor * after).sum())  # an unread document has this much at most
            found = np.flatnonzero(lower)
            reach = max(bar, 1)
            if len(found) >= top:
                reach = max(reach, int(np.partition(lower[found], -top)[-top]))
            if left and left >= reach:
                continue
            found = found[lower[found] + left >= reach]
            missing = ~seen[:, found] & (self.least[found][None, :] <= after[:, None])
            upper = lower[found] + (missing * (factor * after)[:, None]).sum(0)
            open_ = missing[:, upper >= reach].any(1)
            found, upper = found[upper >= reach], upper[upper >= reach]
            if not left or (upper == lower[found]).all():
                order = np.lexsort((self.ids[found], ~self.known[found], -lower[found]))[:top]
                return found[order], lower[found][order], read


def _lists(docs: DataFrame, vocabulary: dict[bytes, int], path: str) -> DataFrame:
    """A row per document with a term: doc_id, n, and the vocabulary's terms in it with
    their counts (arrays of 4-byte numbers). Written once."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def work(batches):
        for batch, texts in text_blocks(batches):
            number = shared.value
            keep, n, ids, tfs = [], [], [], []
            for k, t in enumerate(texts):
                words = terms(t)
                if words:
                    found = [(number[w], c) for w, c in Counter(words).items() if w in number]
                    pairs = np.array(found, "<i4").reshape(-1, 2)
                    keep.append(k)
                    n.append(len(words))
                    ids.append(pairs[:, 0].tobytes())
                    tfs.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text <> ''")
    src.mapInArrow(work, "doc_id long, n long, terms binary, tfs binary").write.parquet(path)
    return spark.read.parquet(path)


def _document_counts(lists: DataFrame, n_terms: int) -> np.ndarray:
    """df of each term of the vocabulary."""
    import pyarrow as pa

    def work(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    counted = (lists.select("terms").mapInArrow(work, "term long, df long").groupBy("term")
               .agg(F.sum("df").alias("df")).toPandas())
    out[counted["term"].to_numpy(int)] = counted["df"].to_numpy(int)
    return out


def _search_block(docs: DataFrame, items: list[tuple[int, int | None, str | None]], shard: int) -> DataFrame:
    """(row, item_id, doc_id, score) of the best of each task for each of the items."""
    import pyarrow as pa

    spark = docs.sparkSession
    counted = [Counter(terms((t or "").encode())) for _, _, t in items]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counted)))}
    size = len(vocabulary)
    lists = _lists(docs, vocabulary, new_folder(spark, "lexical-lists"))
    total = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, all_terms = total[0], total[1] or 1
    weights = [weight(n_docs, int(df)) for df in _document_counts(lists, size)]
    asked = [(row, item, [(vocabulary[w], q * weights[vocabulary[w]]) for w, q in c.items()])
             for (row, item, _), c in zip(items, counted)]
    shared = spark.sparkContext.broadcast(asked)

    def work(batches):
        # per item: (scores, ids, whether known) of the best so far
        best = {row: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for row, _, _ in shared.value}

        def close(rows):
            ids = np.array([0 if i is None else i for i, *_ in rows], np.int64)
            known = np.array([i is not None for i, *_ in rows], bool)
            m = length_factor(np.array([n for _, n, _, _ in rows], np.int64), n_docs, all_terms)
            sizes = np.array([len(t) // 4 for _, _, t, _ in rows])
            part = Shard(ids, known, m, np.repeat(np.arange(len(rows)), sizes),
                         np.frombuffer(b"".join(t for *_, t, _ in rows), "<i4"),
                         np.frombuffer(b"".join(f for *_, f in rows), "<i4").astype(np.int64), size)
            for row, _, own in shared.value:
                score, i, ok = best[row]
                found, more, _ = part.search(own, int(score[-1]) if len(score) == TOP else 0)
                if len(found):
                    score, i, ok = (np.concatenate(x) for x in ((score, more), (i, ids[found]), (ok, known[found])))
                    order = np.lexsort((i, ~ok, -score))[:TOP]
                    best[row] = score[order], i[order], ok[order]

        rows, held = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
                rows.append(r)
                held += 1 + len(r[2]) // 4
                if held >= shard:
                    close(rows)
                    rows, held = [], 0
        if rows:
            close(rows)
        for row, item, _ in shared.value:
            score, i, ok = best[row]
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(score)), pa.array([item] * len(score), pa.int64()),
                     pa.array(i, mask=~ok), pa.array(score)], ["row", "item_id", "doc_id", "score"])

    return lists.mapInArrow(work, "row long, item_id long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    items = cut(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
                .withColumn("row", F.monotonically_increasing_id())
                .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16))
    total = items.agg(F.sum("size")).first()[0] or 0
    if total > item_bytes:
        items = cut(prefix_sums(items, [], ["row"], "size", "start")
                    .withColumn("block", (F.col("start") / item_bytes).cast("long")))
    else:
        items = items.withColumn("block", F.lit(0).cast("long"))
    found = None
    for block in range(total // item_bytes + 1):
        rows = items.where(F.col("block") == block).select("row", "item_id", "text").orderBy("row").collect()
        if rows or found is None:
            part = _search_block(docs, [tuple(r) for r in rows], shard)
            found = part if found is None else found.union(part)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # the tasks' results merge per group of tasks first
    near = Window.partitionBy("row", "group").orderBy(*order)
    best = (found.withColumn("group", F.spark_partition_id() % GROUPS)
            .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= TOP).drop("rank", "group"))
    over = Window.partitionBy("row").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= TOP)
            .select("item_id", "rank", "doc_id", "score"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
words AS (
  SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
asked AS (
  SELECT i, term, count(*) AS q FROM (
    SELECT i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
  GROUP BY i, term),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
postings AS (
  SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, total GROUP BY term),
impacts AS (
  SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))) AS v
  FROM postings p JOIN lengths l ON p.r = l.r JOIN weights w ON p.term = w.term, total),
scores AS (
  SELECT i, r, CAST(sum(q * v) AS BIGINT) AS score FROM asked a JOIN impacts x ON a.term = x.term GROUP BY i, r),
ranked AS (
  SELECT items.item_id, docs.doc_id, s.score,
         CAST(row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, docs.doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores s JOIN docs ON s.r = docs.r JOIN items ON s.i = items.i WHERE s.score > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM ranked WHERE rank <= 20
"""
