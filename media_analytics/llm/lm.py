"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Tokens of a text: its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``, then one end
token. Training documents: crc32(doc_id as text) mod 10 is not 0.

* **Counts.** Every token of every training document is counted (partial sums
  in the tasks, then one group-by). N, V, the add-0.1 unigram base score and
  n_known come from these counts.
* **Classes.** The ``OWN`` commonest tokens are classes of their own. Every other
  token belongs to a class by its last three bytes: the commonest endings have
  own classes, the rest share some by hash. P(token | context) =
  P(class | two classes before) * P(token | class, token before). Each ending class also
  holds a share for unseen tokens; the probabilities of all known tokens and of "some
  unseen token of a class" sum to one after every context.
* **Log-bilinear model of the class** (numpy) given the two classes before it:
  the predicted vector is the sum of the context vectors, each scaled by a
  diagonal matrix per position; a class scores by its product with the class
  vector plus a bias. The model sees only (class two before, class one before,
  class), so these triples are counted over all training documents (in the tasks,
  then one group-by; at most ``CLASSES`` cubed rows) and it is fitted on all of them, by
  their counts, whatever the corpus. Training by noise-contrastive estimation in
  ``PASSES`` passes over the context pairs: a pair's data are its counts, its noise is
  the expectation over the class counts; the partition function is not computed.
* **Log-bilinear model of the token in its class** given the token before it: the ``VECTORS``
  commonest tokens have vectors of their own, the others of a class share one and keep
  their shares of its counts. A token scores by its class share times exp(context vector *
  token vector + bias). The context vectors are learned for each of ``SHARDS`` groups of
  classes, which makes the groups models of their own: a task each, fitted on the
  counts of all (token before, token) pairs of all training documents, at most ids of
  tokens times ids of the group (about 17 million) whatever the corpus. Noise-contrastive estimation with
  ``DRAWN`` noise tokens drawn from the class for each batch, ``TOKEN_PASSES`` passes.
* **Scoring.** Batched matrix products over all contexts give the table of normalised class
  log-probabilities once per worker, and in the fit the normaliser of each (token
  before, class); a token is then two lookups and a product of two vectors. Tokens
  beyond the ``TABLE`` commonest get their counts by a shuffle join of (row,
  token, times), so the vocabulary may grow without bound.

Nulls: a null text has only the end token. A null doc_id counts as training
and is not held out. Repeated rows are scored each; an empty table gives an
empty result; other columns are not read. With no training document every token is unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_of_id, cut, ship, text_blocks

ALPHA = 0.1
TABLE = 200_000        # commonest tokens that every task knows
OWN = 128              # classes of single tokens
ENDINGS = 112          # classes of common endings
SHARED = 16            # classes of all other endings
CLASSES = OWN + ENDINGS + SHARED
SIZE = 32              # length of the vectors
PASSES = 20            # over all context pairs
PAIRS = 64             # context pairs in a batch
NOISE = 100            # noise draws for each token
VECTORS = 16_384       # commonest tokens with vectors of their own
IDS = VECTORS + CLASSES  # ids of tokens: these, then one for the other tokens of each class
SHARDS = 16            # groups of classes with context vectors of their own
TOKEN_PASSES = 5       # over all pairs of tokens
DRAWN = 32             # noise tokens of a batch of pairs
TOKEN_PAIRS = 2048     # pairs in a batch
MAX_PAIRS = 1_000_000  # pairs a task counts before it sends them on
TEXT_BYTES = 1 << 20   # of texts that are handled at once
MAX_KNOWN = 100_000    # ids of tokens that a task keeps
TABLE_BYTES = 64       # longer tokens stay out of that table, so its size is bounded
MAX_COUNTED = 400_000  # tokens a task counts before it sends them on
END = b""              # the end token; a word is never empty


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(LOWER).split()
    words.append(END)
    return words


# ---- counts -----------------------------------------------------------------

def count_tokens(train: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``train``; token is binary."""
    import pyarrow as pa

    ship(train.sparkSession)

    def work(batches):
        total: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()),
                                               pa.array(list(total.values()), pa.int64())], ["token", "c"])

        for _, texts in text_blocks(batches, limit=TEXT_BYTES):
            for t in texts:
                total.update(tokens(t))
            if len(total) > MAX_COUNTED:
                yield flush()
                total.clear()
        if total:
            yield flush()

    return (train.select("text").mapInArrow(work, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


# ---- classes and the model --------------------------------------------------

class Classes:
    """Class of every token, from the commonest tokens and their counts."""

    def __init__(self, common: list[tuple[bytes, int]]):
        own = [t for t, _ in common[:OWN]]
        if END not in own:
            own = [*own[:OWN - 1], END]
        self.own = {t: i for i, t in enumerate(own)}
        endings: Counter = Counter()
        for t, c in common:
            if t not in self.own:
                endings[t[-3:]] += c
        first = sorted(endings.items(), key=lambda x: (-x[1], x[0]))[:ENDINGS]
        self.ending = {e: OWN + i for i, (e, _) in enumerate(first)}

    def of(self, token: bytes) -> int:
        found = self.own.get(token)
        if found is None:
            found = self.ending.get(token[-3:])
        return OWN + ENDINGS + zlib.crc32(token[-3:]) % SHARED if found is None else found


class Ids:
    """Ids and classes of tokens: the place among the ``VECTORS`` commonest, else
    ``VECTORS`` + class."""

    def __init__(self, classes: Classes, common: list[tuple[bytes, int]]):
        self.classes = classes
        self.place = {t: i for i, (t, _) in enumerate(common[:VECTORS])}
        self.cls = np.concatenate([np.zeros(VECTORS, np.int64), np.arange(CLASSES)])
        self.cls[:len(self.place)] = [classes.of(t) for t in self.place]

    def of(self, token: bytes) -> int:
        found = self.place.get(token)
        return VECTORS + self.classes.of(token) if found is None else found

    def shares(self, common: list[tuple[bytes, int]], mass: np.ndarray) -> np.ndarray:
        """Share of every id in its class's smoothed counts ``mass``."""
        own = np.zeros(IDS)
        top = common[:VECTORS]
        own[:len(top)] = [c + ALPHA for _, c in top]
        rest = mass - np.bincount(self.cls[:len(top)], weights=own[:len(top)], minlength=CLASSES)
        own[VECTORS:] = np.where(np.arange(CLASSES) >= OWN, np.maximum(rest, ALPHA), 0)
        return own / mass[self.cls]


def shard_of(classes: np.ndarray) -> np.ndarray:
    """The group of a class that has more than one token."""
    return (classes - OWN) % SHARDS


class LogBilinear:
    """Scores of a class after two context classes."""

    FITTED = ("context", "target", "scale", "bias")

    def __init__(self, noise: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(noise)
        self.noise = noise / noise.sum()
        self.context = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.scale = np.ones((2, SIZE), np.float32)
        self.bias = np.log(self.noise).astype(np.float32)

    def fit(self, before2: np.ndarray, before1: np.ndarray, classes: np.ndarray) -> None:
        n = len(self.noise)
        self.fit_counts(np.bincount((before2 * n + before1) * n + classes, minlength=n ** 3))

    def fit_counts(self, counts: np.ndarray, passes: int = PASSES, rate: float = 0.1, seed: int = 2) -> None:
        """Noise-contrastive estimation with Adagrad from the counts of all (class two
        before, class one before, class); the noise of a pair is taken in expectation."""
        rng = np.random.default_rng(seed)
        n = len(self.noise)
        counts = counts.reshape(n * n, n)
        times = counts.sum(1, dtype=float)
        used = np.flatnonzero(times)
        if not len(used):
            return
        unit = len(used) / times.sum()  # pairs weigh one on average
        log_kq = np.log(NOISE * self.noise).astype(np.float32)
        kq = (NOISE * self.noise).astype(np.float32)
        params = {p: getattr(self, p) for p in self.FITTED}
        power = {p: np.full_like(v, 1e-4) for p, v in params.items()}
        for _ in range(passes):
            order = rng.permutation(used)
            for at in range(0, len(order), PAIRS):
                rows = order[at:at + PAIRS]
                b2, b1 = rows // n, rows % n
                data = counts[rows].astype(np.float32) * np.float32(unit)
                c2, c1 = self.context[b2], self.context[b1]
                h = c2 * self.scale[0] + c1 * self.scale[1]
                s = h @ self.target.T + self.bias - log_kq
                p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
                # derivatives of the log-likelihood of "data or noise"
                d = data * (1 - p) - data.sum(1, keepdims=True) * kq * p
                dh = d @ self.target
                grad = {"target": d.T @ h, "bias": d.sum(0), "context": np.zeros_like(self.context),
                        "scale": np.stack([(dh * c2).sum(0), (dh * c1).sum(0)])}
                np.add.at(grad["context"], b2, dh * self.scale[0])
                np.add.at(grad["context"], b1, dh * self.scale[1])
                for name, v in params.items():
                    g = grad[name] / np.float32(np.sqrt(len(rows)))
                    power[name] += g * g
                    v += rate * g / np.sqrt(power[name])

    def log10_table(self) -> np.ndarray:
        """log10 P(class | context), a row per (class two before, class one before):
        normalised, by one batch of matrix products per first class."""
        n = len(self.bias)
        out = np.empty((n, n, n), np.float32)
        for c in range(n):
            h = self.context[c] * self.scale[0] + self.context * self.scale[1]
            s = h @ self.target.T + self.bias
            s -= s.max(1, keepdims=True)
            out[c] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(n * n, n)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sums of their ``values``."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def _rise(values: np.ndarray, power: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An Adagrad step of some rows, drawn towards zero a little."""
    g = grad - np.float32(0.3) * values[rows]
    power[rows] += g * g
    values[rows] += np.float32(rate) * g / np.sqrt(power[rows])


def fit_tokens(shard: int, before: np.ndarray, token: np.ndarray, times: np.ndarray, cls: np.ndarray,
               share: np.ndarray, passes: int = TOKEN_PASSES, rate: float = 0.2) -> dict[str, np.ndarray]:
    """The vectors of a group of classes from its pairs of ids with their counts, in any
    order: context (``IDS`` rows, float16), target and bias (a row per id of the group,
    ascending) and log_z, log10 of the normaliser (``IDS`` rows, a column per class of the group)."""
    rng = np.random.default_rng(100 + shard)
    kinds = np.arange(OWN + shard, CLASSES, SHARDS)
    members = {int(k): np.flatnonzero((cls == k) & (share > 0)) for k in kinds}
    order = np.lexsort((token, before, cls[token]))
    before, token, times = before[order].astype(np.int32), token[order].astype(np.int32), times[order]
    weight = (times / max(times.mean(), 1e-9) if len(times) else times).astype(np.float32)
    # the last but one column holds the bias of the target, the last one that of the context
    context = rng.normal(0, 0.1, (IDS, SIZE + 2)).astype(np.float32)
    target = rng.normal(0, 0.1, (IDS, SIZE + 2)).astype(np.float32)
    context[:, SIZE:], target[:, SIZE:] = [1, 0], [0, 1]
    power_c, power_t = np.full_like(context, 1e-2), np.full_like(target, 1e-2)
    free_c, free_t = np.ones(SIZE + 2, np.float32), np.ones(SIZE + 2, np.float32)
    free_c[SIZE] = free_t[SIZE + 1] = 0
    ends = np.searchsorted(cls[token], kinds, side="right")
    runs = [(int(k), a, min(a + TOKEN_PAIRS, end)) for k, start, end in zip(kinds, np.concatenate([[0], ends]), ends)
            for a in range(start, end, TOKEN_PAIRS)]
    cumulated = {k: np.cumsum(share[m] / share[m].sum()) for k, m in members.items()}
    log_k = np.float32(np.log(DRAWN))
    deal = np.arange(len(token), dtype=np.int32)
    for p in range(passes):
        for start, end in zip(np.concatenate([[0], ends]), ends):
            rng.shuffle(deal[start:end])  # inside a class
        for at in rng.permutation(len(runs)):
            k, a, b = runs[at]
            rows = deal[a:b]
            c, w, x = before[rows], token[rows], weight[rows]
            drawn = members[k][np.minimum(np.searchsorted(cumulated[k], rng.random(DRAWN)), len(members[k]) - 1)]
            h, q, noise = context[c], target[w], target[drawn]
            # derivatives of the log-likelihood of "data or noise"; the class share cancels in the scores
            data = x / (1 + np.exp(np.clip((h * q).sum(1) - log_k, -30, 30)))
            other = -x[:, None] / (1 + np.exp(-np.clip(h @ noise.T - log_k, -30, 30)))
            ids, g = _row_sums(c, data[:, None] * q + other @ noise)
            step = rate * (1 - p / passes)
            up = _row_sums(np.concatenate([w, drawn]), np.concatenate([data[:, None] * h, other.T @ h]))
            for values, power, free, (i, d) in ((context, power_c, free_c, (ids, g)), (target, power_t, free_t, up)):
                fixed = values[i] * (1 - free)
                _rise(values, power, i, d * free, step)
                values[i] = values[i] * free + fixed
    vectors = context[:, :SIZE].astype(np.float16)
    mine = np.concatenate([members[int(k)] for k in kinds])
    mine.sort()
    log_z = np.empty((IDS, len(kinds)), np.float32)
    for j, k in enumerate(kinds):
        m = members[int(k)]
        s = vectors.astype(np.float32) @ target[m, :SIZE].T + target[m, SIZE]
        top = s.max(1, keepdims=True)
        log_z[:, j] = (top[:, 0] + np.log(np.exp(s - top) @ (share[m] / share[m].sum()).astype(np.float32))) / np.log(10)
    return {"context": vectors, "target": target[mine, :SIZE], "bias": target[mine, SIZE], "log_z": log_z}


class TokenVectors:
    """log10 P(token | class, token before) - log10 P(token | class)."""

    def __init__(self, ids: Ids, share: np.ndarray):
        self.cls, self.share = ids.cls, share
        self.context = np.zeros((SHARDS, IDS, SIZE), np.float16)
        self.target = np.zeros((IDS, SIZE), np.float32)
        self.bias = np.zeros(IDS, np.float32)
        self.log_z = np.zeros((IDS, CLASSES - OWN), np.float32)

    def put(self, shard: int, name: str, value: bytes) -> None:
        """An array that ``fit_tokens`` returned."""
        mine = np.flatnonzero((self.cls >= OWN) & (shard_of(self.cls) == shard) & (self.share > 0))
        if name == "context":
            self.context[shard] = np.frombuffer(value, np.float16).reshape(IDS, SIZE)
        elif name == "target":
            self.target[mine] = np.frombuffer(value, np.float32).reshape(-1, SIZE)
        elif name == "bias":
            self.bias[mine] = np.frombuffer(value, np.float32)
        else:
            self.log_z[:, shard::SHARDS] = np.frombuffer(value, np.float32).reshape(IDS, -1)

    def gain(self, ids: np.ndarray, ids_before: np.ndarray, classes: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """A value per token, 0 for one that is a class of its own."""
        out = np.zeros(len(ids))
        shared = np.flatnonzero(classes >= OWN)
        for k in range(0, len(shared), step):  # the gathered vectors of a block stay few
            at = shared[k:k + step]
            c, b, i = classes[at], ids_before[at], ids[at]
            s = np.einsum("ij,ij->i", self.context[shard_of(c), b].astype(np.float32), self.target[i]) + self.bias[i]
            out[at] = s / np.log(10) - self.log_z[b, c - OWN]
        return out


class _Places(dict):
    """Places of the common tokens, -1 for any other."""

    def __missing__(self, token: bytes) -> int:
        return -1


class Scorer:
    """Everything a task needs: the common tokens, the classes and the models."""

    def __init__(self, common: list[tuple[bytes, int]], classes: Classes, mass: np.ndarray, model: LogBilinear,
                 vectors: TokenVectors):
        self.common, self.classes, self.model, self.vectors = common, classes, model, vectors
        self.mass = mass  # smoothed count of each class
        self._ready = None

    def __getstate__(self):  # tokens and counts apart, without an object for each count
        return {**self.__dict__, "_ready": None, "common": None, "_sent": self._parts()}

    def _parts(self) -> tuple[list[bytes], np.ndarray]:
        if self.common is None:
            return self._sent
        return [t for t, _ in self.common], np.array([c for _, c in self.common], float)

    def ready(self):
        """(token -> place, class by place, log10(c + 0.1) by place, table)."""
        if self._ready is None:
            words, times = self._parts()
            place = _Places((t, i) for i, t in enumerate(words))
            cls = np.array([self.classes.of(t) for t in words] or [0], np.int64)
            logc = np.log10((times if words else np.zeros(1)) + ALPHA)
            self._sent = None
            self._ready = place, cls, logc, self.model.log10_table()
        return self._ready

    def score(self, texts: list[bytes | None]):
        """For each text: tokens, known ones among the common, the sum of log10(c + 0.1)
        of these, log10 P(token | context) - log10(c + 0.1) summed over all tokens, and the other
        tokens with their times."""
        place, cls, logc, table = self.ready()
        words = [tokens(t) for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
        c = cls[at]
        rare_at = np.flatnonzero(at < 0)
        first = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(words)), size)
        others: list[list[bytes]] = [[] for _ in words]
        of = self.classes.of
        for i, p in zip(own[rare_at].tolist(), rare_at.tolist()):
            w = words[i][p - first[i]]
            others[i].append(w)
            c[p] = of(w)
        b2, b1 = before(c, size, self.classes.of(END))
        n = len(self.model.bias)
        logp = table[b2 * n + b1, c].astype(float) - np.log10(self.mass)[c]
        ids = np.where((at >= 0) & (at < VECTORS), at, VECTORS + c)
        end_at = place.get(END, VECTORS)
        end_id = end_at if end_at < VECTORS else VECTORS + self.classes.of(END)
        logp += self.vectors.gain(ids, before(ids, size, end_id)[1], c)
        known = np.where(at >= 0, logc[at], 0.0)
        add = lambda x: np.bincount(own, weights=x, minlength=len(words))
        return size, add(at >= 0).astype(np.int64), add(known), add(logp), [Counter(o) for o in others]


def before(c: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(class two before, class one before) of the classes ``c`` of texts laid end to
    end, ``size`` tokens each; before a text stands the end of another."""
    first = np.cumsum(size) - size
    b1, b2 = np.full_like(c, end), np.full_like(c, end)
    b1[1:], b2[2:] = c[:-1], c[:-2]
    b1[first] = end
    b2[first] = end
    b2[first[size > 1] + 1] = end
    return b2, b1


class _Known(dict):
    """Ids of the tokens met, a bounded number of them."""

    def __init__(self, ids: Ids):
        self.ids = ids

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MAX_KNOWN:
            self.clear()
        found = self[token] = self.ids.of(token)
        return found


def count_contexts(train: DataFrame, shared) -> DataFrame:
    """(part, key, c) over all texts of ``train``, which end tokens precede; ``shared`` is the
    broadcast ``Ids``. Part -1 counts classes: key is (class two before * CLASSES + class
    one before) * CLASSES + class. A part from 0 on is a group of classes and counts its
    tokens: key is id of the token before * 65536 + id of the token."""
    import pyarrow as pa

    def rows(code, c):  # (part + 1) << 32 | key: one long is grouped and moved for less than two columns
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(c.astype(np.int32))], ["code", "c"])

    def work(batches):
        triples = np.zeros(CLASSES ** 3, np.int32)  # a task reads fewer tokens than an int holds
        ids = shared.value
        known, end, end_id = _Known(ids), ids.classes.of(END), ids.of(END)
        pairs, held = [], 0

        def sums():
            return _row_sums(np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs]))

        for _, texts in text_blocks(batches, limit=TEXT_BYTES):
            words = [tokens(t) for t in texts]
            size = np.fromiter(map(len, words), np.int64, len(words))
            i = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
            del words
            c = ids.cls[i]
            b2, b1 = before(c, size, end)
            met, times = np.unique((b2 * CLASSES + b1) * CLASSES + c, return_counts=True)
            triples[met] += times.astype(np.int32)
            key = ((shard_of(c) + 1 << 32) | (before(i, size, end_id)[1] << 16) | i)[c >= OWN]
            pairs.append(np.unique(key, return_counts=True))
            held += len(pairs[-1][0])
            if held > MAX_PAIRS:
                pairs = [sums()]
                held = len(pairs[0][0])
                if held > MAX_PAIRS // 2:
                    yield rows(*pairs[0])
                    pairs, held = [], 0
        if held:
            yield rows(*sums())
        met = np.flatnonzero(triples)
        for k in range(0, len(met), 1 << 18):
            part = met[k:k + (1 << 18)]
            yield rows(part, triples[part])

    return (train.select("text").mapInArrow(work, "code long, c int").groupBy("code").agg(F.sum("c").alias("c"))
            .select((F.shiftright("code", 32) - 1).cast("int").alias("part"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("key"),
                    "c"))


# ---- the operator -----------------------------------------------------------

def commonest(counts: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """The commonest tokens with their counts, at most ``most`` (default ``TABLE``): those
    at or above the lowest count bin that still fits. The bins (a thousandth of a
    power of ten) are few whatever the corpus, and only chosen tokens leave the executors."""
    most = TABLE if most is None else most
    counts = counts.where(F.length("token") <= TABLE_BYTES)
    at = F.floor(F.log10(F.col("c")) * 1000)
    bins = sorted(((r.b, r.n) for r in counts.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()),
                  reverse=True)
    lowest, fits = None, 0
    for b, n in bins:
        fits += n
        if fits > most:
            break
        lowest = b
    if lowest is None:
        return []
    got = counts.where(at >= lowest).toArrow()
    return sorted(zip(got.column("token").to_pylist(), got.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def learn(train: DataFrame, counts: DataFrame) -> tuple[Scorer, int, int]:
    """(scorer, N, V) from the training documents and all their token counts."""
    import pyarrow as pa

    spark = train.sparkSession
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total.n or 0, total.v
    common = commonest(counts)
    classes = Classes(common)
    ids = Ids(classes, common)
    shared = spark.sparkContext.broadcast(ids)

    def class_sums(batches):
        mass = np.zeros(CLASSES)
        seen = np.zeros(CLASSES, np.int64)
        for batch in batches:
            c = np.array([shared.value.classes.of(t) for t in batch.column("token").to_pylist()], np.int64)
            got = batch.column("c").to_numpy()
            mass += np.bincount(c, weights=got, minlength=CLASSES)
            seen += np.bincount(c, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(mass.astype(np.int64)),
                                          pa.array(seen)], ["class", "c", "v"])

    sums = (counts.mapInArrow(class_sums, "class int, c long, v long").groupBy("class")
            .agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect())  # a row per class
    c, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        c[r["class"]], kinds[r["class"]] = r.c, r.v
    # own classes hold one token; each ending class also holds its unseen tokens
    mass = c + ALPHA * kinds + ALPHA * (np.arange(CLASSES) >= OWN)
    mass[mass == 0] = ALPHA
    model = LogBilinear(c + 1.0)
    share = ids.shares(common, mass)
    vectors = TokenVectors(ids, share)
    if n:
        cls = ids.cls

        def packed(batches):
            """A row per batch and part, so that the fits read few rows."""
            for batch in batches:
                part, key, c = (batch.column(k).to_numpy() for k in ("part", "key", "c"))
                met = np.unique(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met), pa.array([key[part == p].astype(np.uint32).tobytes() for p in met], pa.binary()),
                     pa.array([c[part == p].astype(np.float32).tobytes() for p in met], pa.binary())],
                    ["part", "keys", "times"])

        def fit(table: pa.Table) -> pa.Table:
            """One task fits a part: the classes on at most CLASSES cubed triples, or a group of
            classes on its pairs (single-threaded products)."""
            part = table.column("part")[0].as_py()
            read = lambda column, kind: (np.frombuffer(x.as_py(), kind) for x in table.column(column))
            if part < 0:
                times = np.zeros(CLASSES ** 3, np.float32)
                for k, x in zip(read("keys", np.uint32), read("times", np.float32)):
                    times[k] = x
                model.fit_counts(times)
                got = {name: getattr(model, name) for name in LogBilinear.FITTED}
            else:
                key = np.concatenate(list(read("keys", np.uint32)))
                got = fit_tokens(part, key >> 16, key & 0xFFFF, np.concatenate(list(read("times", np.float32))), cls, share)
            return pa.table({"part": pa.array([part] * len(got), pa.int32()), "name": list(got),
                             "value": pa.array([x.tobytes() for x in got.values()], pa.binary())})

        # a row per array: bounded by the sizes of the models, about 30 MB
        fitted = (count_contexts(train, shared).mapInArrow(packed, "part int, keys binary, times binary")
                  .repartition(4 * (SHARDS + 1), "part").groupBy("part")
                  .applyInArrow(fit, "part int, name string, value binary").collect())
        for r in fitted:
            if r.part < 0:
                old = getattr(model, r["name"])
                setattr(model, r["name"], np.frombuffer(bytes(r.value), old.dtype).reshape(old.shape))
            else:
                vectors.put(r.part, r["name"], bytes(r.value))
    return Scorer(common, classes, mass, model, vectors), n, v


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"),
                      F.coalesce(crc_of_id(F.col("doc_id")) % 10 == 0, F.lit(False)).alias("held_out"))
    train = src.where(~F.col("held_out"))
    counts = cut(count_tokens(train))
    scorer, n, v = learn(train, counts)
    shared = spark.sparkContext.broadcast(scorer)
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "logp", "others", "times"]

    def work(batches):
        for batch, texts in text_blocks(batches, limit=TEXT_BYTES):
            size, known, base, logp, others = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known), pa.array(base),
                 pa.array(logp), pa.array([list(o) for o in others], pa.list_(pa.binary())),
                 pa.array([list(o.values()) for o in others], pa.list_(pa.int32()))], names)

    scored = cut(src.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, known long, base double, "
                                      "logp double, others array<binary>, times array<int>")
                 .withColumn("row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    rare = scored.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "row", F.col("o.others").alias("token"), F.col("o.times").alias("times"))
    got = F.coalesce(F.col("c"), F.lit(0))
    extra = (rare.join(counts, "token", "left")
             .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
                                 F.sum(F.col("times") * F.log10(got + F.lit(ALPHA))).alias("more_base")))
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("more_base", zero)
    return (scored.drop("others", "times").join(extra, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (base - F.col("n_tokens") * F.log10(F.lit(n + ALPHA * (v + 1)))).alias("base_score"),
                    (F.col("logp") + base).alias("score")))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return score(table(spark, sf_dir, "documents"))
