"""Benchmark decontamination by greedy string tiling.

Texts become words: runs of letters and digits, lower case; in scripts that set no spaces
between words (Chinese, Japanese, Thai and their like) every character is one. For a document and
a benchmark item, greedy string tiling covers the item with non-overlapping
matches of at least ``MIN_MATCH`` words: the longest unmarked match is marked
again and again until none is left, so passages are found in any order. The
coverage is the share of the item's words inside tiles; a document is
contaminated by an item if it is ``THRESHOLD`` or more, or if one tile has
``PASSAGE_WORDS`` words or more, however long the item is. An item with fewer than
``MIN_MATCH`` words contaminates the documents that hold all its words in a row, if it
has ``least_item`` words. By default that is one; a benchmark with answers like "yes"
among its items needs more in ``clean``, or every document with that word goes.

* Seeds: Karp-Rabin hashes of ``MIN_MATCH`` successive words, rolled over each
  document and joined with those of the benchmark; a shared hash is verified
  word by word. Only words of the benchmark get numbers, so most of a clean
  document is never hashed. Seeds next to each other on a diagonal are one maximal match.
* The longest match is taken from a heap. One that meets marked words is cut
  into its unmarked parts, which go back if they are long enough. A document
  and item without a shared seed have no tile at all.

Documents are never shuffled: the benchmark's seeds go to the tasks. Its size
is measured first. One task's share is at most ``SLICE_WORDS`` words; a larger
benchmark is cut into slices by hash of id and text, with one pass over the documents each.

Nulls: a null or wordless text is clean; a null or wordless item matches nothing. Repeated rows are judged each on its own. An
empty table gives an empty result, an empty benchmark leaves every row clean.
``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_blocks

MIN_MATCH = 5
THRESHOLD = 0.5
PASSAGE_WORDS = 13  # of one tile, contaminate whatever their share of the item
SLICE_WORDS = 2_000_000
LEAST_ITEM = 1  # words of an item that is looked for, at least

# fixed values: blocks of scripts without spaces between words
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(f"[^\\W_{_NO_SPACES}]+|(?=[{_NO_SPACES}])[^\\W_]")
_JAVA_WORDS = f"[\\p{{L}}\\p{{N}}&&[^{_NO_SPACES}]]+|[{_NO_SPACES}]"
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash (mod 2^64) of each window of ``length`` numbers."""
    n = max(0, len(ids) - length + 1)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h * _BASE + ids[k:k + n].astype(np.uint64)
    return h


class Benchmark:
    """Numbers of the items' words and the places of their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH, least_item: int = 1):
        self.min_match = min_match
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}  # length -> words -> items
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int64)
            if not len(ids) or len(ids) < min(least_item, min_match):
                continue
            k = len(self.items)
            self.items.append((item_id, ids))
            if len(ids) < min_match:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids.tolist()), []).append(k)
                continue
            for at, h in enumerate(rolling(ids, min_match).tolist()):
                self.places.setdefault(h, []).append((k, at))
        self.seeds = np.array(sorted(self.places), np.uint64)

    def matches(self, text: str | None) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
        """Maximal matches (length, place in item, place in text) by item, and the
        number of words of the text."""
        tokens = words(text)
        ids = np.fromiter(map(self.number.get, tokens, repeat(0)), np.int64, len(tokens))
        m, known = self.min_match, ids > 0
        out = self._whole(ids, known)
        n = len(ids) - m + 1
        if n <= 0 or not len(self.seeds):
            return out, len(ids)
        run = known[:n].copy()
        for k in range(1, m):
            run &= known[k:k + n]
        at = np.flatnonzero(run)
        if not len(at):
            return out, len(ids)
        h = np.zeros(len(at), np.uint64)
        for k in range(m):
            h = h * _BASE + ids[at + k].astype(np.uint64)
        place = np.searchsorted(self.seeds, h)
        place[place == len(self.seeds)] = 0
        hit = self.seeds[place] == h
        open_: dict[tuple[int, int], list[int]] = {}  # (item, diagonal) -> [begin, end] in the text
        for j, key in zip(at[hit].tolist(), h[hit].tolist()):
            for k, i in self.places[key]:
                item = self.items[k][1]
                if not np.array_equal(item[i:i + m], ids[j:j + m]):
                    continue  # equal hashes of other words
                last = open_.get((k, j - i))
                if last is not None and last[1] == j + m - 1:
                    last[1] = j + m
                    continue
                if last is not None:
                    out.setdefault(k, []).append((last[1] - last[0], last[0] - (j - i), last[0]))
                open_[k, j - i] = [j, j + m]
        for (k, diagonal), (a, b) in open_.items():
            out.setdefault(k, []).append((b - a, a - diagonal, a))
        return out, len(ids)

    def _whole(self, ids: np.ndarray, known: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """The first place of each item of fewer than ``min_match`` words, by item."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for m, wanted in self.short.items():
            n = max(0, len(ids) - m + 1)
            run = known[:n].copy()
            for k in range(1, m):
                run &= known[k:k + n]
            for j in np.flatnonzero(run).tolist():
                for k in wanted.get(tuple(ids[j:j + m].tolist()), ()):
                    out.setdefault(k, [(m, 0, j)])
        return out

    def tiles(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The greedy tiling (length, place in item, place in text) of the matches."""
        heap = [(-n, i, j) for n, i, j in found]
        heapq.heapify(heap)
        in_item, in_text, out = set(), set(), []
        while heap:
            n, i, j = heapq.heappop(heap)
            free = [i + k not in in_item and j + k not in in_text for k in range(-n)]
            if all(free):
                out.append((-n, i, j))
                in_item.update(range(i, i - n))
                in_text.update(range(j, j - n))
                continue
            begin = None
            for k, ok in enumerate([*free, False]):
                if ok and begin is None:
                    begin = k
                elif not ok and begin is not None:
                    if k - begin >= self.min_match:
                        heapq.heappush(heap, (begin - k, i + begin, j + begin))
                    begin = None
        return out

    def judge(self, text: str | None, threshold: float = THRESHOLD):
        """(item_id, item words, covered words, tiles) of each item that the text
        contains to ``threshold`` or more, or ``PASSAGE_WORDS`` words in a row of."""
        out = []
        for k, found in self.matches(text)[0].items():
            item_id, ids = self.items[k]
            tiles = self.tiles(found)
            covered = sum(n for n, _, _ in tiles)
            if covered >= threshold * len(ids) or any(n >= PASSAGE_WORDS for n, _, _ in tiles):
                out.append((item_id, len(ids), covered, sorted(tiles, key=lambda t: t[1])))
        return out


def _slices(benchmark: DataFrame, min_match: int, slice_words: int, least_item: int = 1):
    """Broadcast benchmark indexes of bounded size that together hold all items."""
    spark = benchmark.sparkSession
    ship(spark)
    b = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = b.agg(F.sum(F.regexp_count("text", F.lit(_JAVA_WORDS)))).first()[0] or 0
    parts = max(1, -(-n // slice_words))
    for k in range(parts):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else b
        yield spark.sparkContext.broadcast(
            Benchmark(sorted(((r.item_id, r.text) for r in rows.toLocalIterator()),
                             key=lambda r: (r[0] is None, r[0] or 0, r[1])), min_match, least_item))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 min_match: int = MIN_MATCH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, reordered) for each
    document and item it is contaminated by."""
    import pyarrow as pa

    names = ["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "reordered"]
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _slices(benchmark, min_match, slice_words):
        def work(batches, shared=shared):
            for batch, texts in text_blocks(batches):
                rows = []
                for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts):
                    for item, n, covered, tiles in shared.value.judge((t or b"").decode(), threshold):
                        places = [j for _, _, j in tiles]
                        rows.append((doc_id, item, n, covered, covered / n, len(tiles), places != sorted(places)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        part = src.mapInArrow(work, "doc_id long, item_id long, item_words long, covered_words long, "
                                    "coverage double, n_tiles long, reordered boolean")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
          slice_words: int = SLICE_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of ``docs`` that are not contaminated by any item of ``least_item`` words or more."""
    import pyarrow as pa

    for shared in _slices(benchmark, min_match, slice_words, least_item):
        def work(batches, shared=shared):
            for batch, texts in text_blocks(batches):
                keep = pa.array([not shared.value.judge((t or b"").decode(), threshold) for t in texts], pa.bool_())
                yield batch.filter(keep)

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
