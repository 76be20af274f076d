"""Secret scans: fixed rules, and a character convolutional network over every candidate.

* **Rules** (leftmost, non-overlapping per kind): ``assign`` keyword, ``:`` or
  ``=``, value of 12 or more characters; ``access`` key ids; ``hex`` runs of 16
  or more. Their spans always stay.
* **Candidates**: every run of 12 or more characters of ``[A-Za-z0-9+/_.=-]``.
  The network reads the candidate with the ``BEFORE`` characters before it and the
  ``AFTER`` behind it, ``WIDTH`` characters in all (context has symbols of its own);
  a longer candidate is read in overlapping windows, of which the most suspicious
  counts. Equal windows of a block are scored once.
* **Network** (numpy): character embedding, one convolution with ReLU, maximum and mean
  over places, logistic output; trained by Adam. Labels: candidates that meet an
  ``assign`` or ``access`` finding, or a hexadecimal one with letters in it, are
  positive, the others negative (letters only and other ones apart), from a bounded
  sample of documents. Each positive is also shown in another context, in upper case, and
  random keys of other alphabets are drawn, letters only among them; words, long
  words, numbers and addresses are drawn as further negatives, so
  that the network learns the look of a key and not only the rule.
* **Threshold**: on the held-out fifth of the labels (by document) the scores are
  calibrated by Platt scaling. The threshold is the highest that keeps
  ``RECALL`` of the positives.
* Every candidate is scored. One over the threshold adds a span of kind ``cnn``, also where
  a rule found a part of it. It adds none where a finding says the same: one of the same extent
  (marks at the ends aside), an ``assign`` or ``access`` finding that covers it, or an ``assign``
  finding that ends it (a longer word before ``=``).

The recall of the threshold is that of all held-out keys together. By alphabet it
differs, since lower-case keys look most like words. Of 1,000 keys each in a sentence (network
of the sf0.1 table) it finds, with 20 characters unless stated: letters of both cases and digits
0.94 (32: 0.99), lower case and digits 0.88, capitals 0.99, both cases 0.95, lower case 0.91, 0.65
(12 characters), 0.80 (16) and 0.93 (24).

Offsets are code points, ends exclusive. Null or empty text: no span. Rows are
scanned each on its own (repeated ones are repeated, a null doc_id stays null);
with too few labels the network adds nothing. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_blocks

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so shorter ones need not be visited
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MARKS = "+/_.=-"

BEFORE = 16
BODY = 48              # characters of the candidate in one window
AFTER = 16
WIDTH = BEFORE + BODY + AFTER
PART_ROWS = 16_000     # training rows of a part, about
ROUNDS = 2, 10         # readings of every training row, least and most
SEEN = 300_000         # training rows to read in all rounds, if that takes no more of them
DRAWN = 6000           # keys and as many look-alikes drawn
REPEATED = 10          # times a rare kind is shown in a round, at most
# weights in a batch: keys found, drawn; other negatives, of letters only, drawn
SHARES = {1: 0.17, 3: 0.33, 0: 0.05, 2: 0.13, 4: 0.32}
RECALL = 0.98
BINS = 1000            # of a logit
FILTERS, SPAN, DEPTH = 32, 5, 12
BATCH = 128
SYMBOLS = 98           # printable ASCII, one symbol for the rest, one for padding
ALPHABET = 2 * SYMBOLS  # of the candidate and of its context


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rule findings."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows(text: str, start: int, end: int) -> list[str]:
    """What the network reads of a candidate: its context and it, in windows."""
    before = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0")
    return [before + text[k:min(end, k + BODY) + AFTER]
            for k in range(start, max(end - BODY // 2, start + 1), BODY // 2)]


IN_CANDIDATE = np.zeros(128, bool)
IN_CANDIDATE[[c for c in range(128) if re.fullmatch(r"[A-Za-z0-9+/_.=-]", chr(c))]] = True


def encode(strings: list[str]) -> np.ndarray:
    """Symbols of windows: the candidate begins behind ``BEFORE`` characters and ends at
    the first one that no candidate has; symbols of its context are ``SYMBOLS`` higher."""
    text = "".join(s[:WIDTH].ljust(WIDTH, "\0") for s in strings)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int32).reshape(len(strings), WIDTH)
    out = np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1))
    inside = np.minimum.accumulate(IN_CANDIDATE[np.minimum(codes[:, BEFORE:], 127)], axis=1)
    out[:, :BEFORE] += SYMBOLS
    out[:, BEFORE:] += np.where(inside, 0, SYMBOLS)
    return out


class Network:
    """Embedding, convolution, ReLU, maximum and mean over places, logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        first = {"e": rng.normal(0, 0.3, (ALPHABET, DEPTH)), "w": rng.normal(0, 0.15, (SPAN * DEPTH, FILTERS)),
                 "b": np.zeros(FILTERS), "v": rng.normal(0, 0.3, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in first.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def _forward(self, x: np.ndarray):
        places = WIDTH - SPAN + 1
        emb = np.take(self.p["e"], x, axis=0)
        a, b, c = emb.strides  # the vectors of successive symbols lie together
        cols = np.lib.stride_tricks.as_strided(emb, (len(x), places, SPAN * DEPTH), (a, b, c)).reshape(-1, SPAN * DEPTH)
        z = cols @ self.p["w"]
        z += self.p["b"]
        z = np.maximum(z, 0, out=z).reshape(len(x), places, FILTERS)
        top = z.argmax(1)
        h = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0],
                            np.full(places, 1 / places, np.float32) @ z], axis=1)
        return cols, z, top, h, h @ self.p["v"] + self.p["c"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        """As ``_forward``, from one table of symbols per place of the filters."""
        places = WIDTH - SPAN + 1
        taps = [(self.p["e"] @ self.p["w"][k * DEPTH:(k + 1) * DEPTH]).astype(np.float32) for k in range(SPAN)]
        taps[0] = taps[0] + self.p["b"].astype(np.float32)
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            rows = x[at:at + 256]
            z = taps[0][rows[:, :places]]
            for k in range(1, SPAN):
                z += taps[k][rows[:, k:k + places]]
            np.maximum(z, 0, out=z)
            out[at:at + 256] = np.concatenate([z.max(1), z.mean(1)], axis=1) @ self.p["v"] + self.p["c"][0]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.004, seed: int = 4,
            weight: np.ndarray | None = None) -> None:
        """Adam in batches; by default positives and negatives weigh the same."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        if weight is None:
            weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at:at + BATCH]
                seen = x[rows]
                cols, z, top, h, out = self._forward(seen)
                d = ((1 / (1 + np.exp(-np.clip(out, -50, 50))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                # derivative at each place: of the maximum where it is, of the mean everywhere
                mean = d[:, None] * (self.p["v"][FILTERS:] / z.shape[1])
                dz = (z > 0) * mean[:, None, :]
                at_top = np.where(h[:, :FILTERS] > 0, mean + d[:, None] * self.p["v"][:FILTERS], np.float32(0))
                np.put_along_axis(dz, top[:, None, :], at_top[:, None, :], 1)
                flat = dz.reshape(-1, FILTERS)
                g = {"v": h.T @ d, "c": d.sum(keepdims=True), "b": flat.sum(0), "w": cols.T @ flat}
                demb = np.zeros((*seen.shape, DEPTH), np.float32)
                for k in range(SPAN):
                    tap = self.p["w"][k * DEPTH:(k + 1) * DEPTH]
                    demb[:, k:k + dz.shape[1]] += (flat @ tap.T).reshape(*dz.shape[:2], DEPTH)
                hot = seen.ravel()
                g["e"] = np.stack([np.bincount(hot, weights=c, minlength=ALPHABET)
                                   for c in demb.reshape(-1, DEPTH).T], axis=1).astype(np.float32)
                step += 1
                for k, v in self.p.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                    v -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Of held-out rows."""
        self.calibrate_counts(np.floor(self.logit(x) * BINS), y, np.ones(len(y)), recall)

    def calibrate_counts(self, bins: np.ndarray, y: np.ndarray, times: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then the highest threshold that keeps the recall, from bins of logits and
        what each weighs."""
        s = bins / BINS
        a, b = 1.0, 0.0
        n, good = times.sum(), (times * y).sum()
        target = np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
            a, b = (a - 0.05 * ((p - target) * s * times).sum() / n, b - 0.05 * ((p - target) * times).sum() / n)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        self.threshold = 2.0
        if good:
            order = np.argsort(s[y > 0])
            below = np.cumsum(times[y > 0][order])
            least = s[y > 0][order][np.searchsorted(below, (1 - recall) * good, side="right")]
            # a little below the bin, since a logit is summed in single precision
            self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * (least - 1e-4) + self.shift, -50, 50))))


def _meets(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(a < end and start < b for a, _, b in spans)


def _said(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether a finding tells of the candidate already."""
    own = text[start:end]
    a, b = end - len(own.lstrip(MARKS)), start + len(own.rstrip(MARKS))
    return any(x <= a and b <= y or k == 0 and a < x < b <= y for x, k, y in spans)


def scan_all(texts: list[str], network: Network | None) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind number, end) of each text, sorted. Every candidate is scored,
    equal windows once."""
    spans = [rule_spans(t) for t in texts]
    if network is not None:
        number: dict[str, int] = {}
        asked = []  # (text, start, end, numbers of its windows)
        for i, text in enumerate(texts):
            for a, b in candidates(text):
                asked.append((i, a, b, [number.setdefault(w, len(number)) for w in windows(text, a, b)]))
        seen = list(number)
        over = np.zeros(len(seen), bool)
        for k in range(0, len(seen), 4096):
            over[k:k + 4096] = network.probability(encode(seen[k:k + 4096])) >= network.threshold
        rules = [list(s) for s in spans]
        for i, a, b, at in asked:
            if any(over[k] for k in at) and not _said(texts[i], a, b, rules[i]):
                spans[i].append((a, 3, b))
    return [sorted(s) for s in spans]


def scan(text: str, network: Network | None) -> list[tuple[int, int, int]]:
    return scan_all([text], network)[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- training ---------------------------------------------------------------

# a long word is a beginning, a stem and an end of these
LONG_WORDS = (
    "inter counter over under trans micro macro semi multi electro hyper super photo psycho thermo pseudo un re dis mis "
    "pre non auto bio geo neuro radio tele inner ausser vor zurueck gegen zusammen".split(),
    "nation struct develop character commun respons govern represent constitu environ establish administr "
    "recommend understand philosoph industr manufactur transport concentr demonstr investig particip wissenschaft "
    "gesellschaft verantwort entwickl geschwindig versicher".split(),
    "ization ability mentally fulness ingly ational ments istically ibilities ation lichkeit ungen liche ements "
    "iveness atively".split())


def _drawn(rng: np.random.Generator, n: int) -> tuple[list[str], list[str]]:
    """(keys, look-alikes) of other alphabets than the corpus has, from fixed rules."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    keys = [pick(a, int(rng.integers(12 if a.isalpha() else 20, 48))) for a in rng.choice(
        [lower + upper + digits, lower + upper + digits + "+/", "0123456789abcdef", "0123456789ABCDEF",
         lower, upper, lower + upper], n)]
    words = lambda: pick("aeioubcdlmnrst", int(rng.integers(3, 9)))
    near = []
    for k in range(n):
        long = "".join(rng.choice(part) for part in LONG_WORDS)
        long = [long, long, long.capitalize(), long.upper(), long + "."][rng.integers(5)]
        near.append([f"{words()}.{rng.integers(10, 99)}", f"www.{words()}{words()}.example.com/{words()}{rng.integers(9)}",
                     f"{words()}-{words()}-{rng.integers(1990, 2030)}", f"{words()}_{words()}_{words()}{rng.integers(99)}",
                     f"{rng.integers(1990, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}.{words()}{words()}",
                     long, long, pick(digits, int(rng.integers(12, 20)))][k % 8])
    return keys, near


def labelled(docs: DataFrame) -> DataFrame:
    """The distinct labelled candidates of all ``docs``: h (of the text), what the network reads,
    length and y (1: key, 0: other, 2: other of letters only)."""
    import pyarrow as pa

    ship(docs.sparkSession)
    src = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("h", F.xxhash64("text"))

    def label(batches):
        for batch, texts in text_blocks(batches):
            rows = set()
            for h, t in zip(batch.column("h").to_pylist(), texts):
                text = t.decode()
                spans = rule_spans(text)
                strong = [s for s in spans if s[1] < 2 or not text[s[0]:s[2]].isdigit()]
                for a, b in candidates(text):
                    y = 1 if _meets(a, b, strong) else 0
                    if y or not _meets(a, b, spans):
                        rows.add((h, windows(text, a, b)[0], min(b - a, BODY),
                                  y or 2 * text[a:b].rstrip(".").isalpha()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(rows))], ["h", "seen", "n", "y"])

    return src.mapInArrow(label, "h long, seen string, n long, y long").distinct()


def _shown(rng: np.random.Generator, seen: list[str], n: list[int], y: list[int], keys: list[str], near: list[str],
           times: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """What the network reads of the labelled rows, and the kind of each (see ``SHARES``): positives
    also in the context of a negative and in upper case, drawn strings in such contexts or at the end of a text.
    Kinds are repeated ``times``, with other contexts."""
    # (before, behind) of the negatives
    contexts = [(s[:BEFORE], s[BEFORE + k:]) for s, k, label in zip(seen, n, y) if label != 1] or [("\0" * BEFORE, "")]
    placed = lambda k, s: contexts[k][0] + s[:BODY] + contexts[k][1]
    out, kinds = [], []
    for s, k, label in zip(seen, n, y):
        for _ in range(times.get(label, 1)):
            shown = [s] if label != 1 else [s, placed(int(rng.integers(len(contexts))), s[BEFORE:BEFORE + k]), s.upper()]
            out += shown
            kinds += [label] * len(shown)
    for kind, strings in ((3, keys), (4, near)):
        for s in strings:
            k = int(rng.integers(len(contexts)))
            out.append(contexts[k][0] + s[:BODY] if rng.random() < 0.25 else placed(k, s))
            kinds.append(kind)
    return out, np.array(kinds, np.int64)


def _weights(rows: dict[int, int]) -> np.ndarray:
    """Weight of a row of each kind, from the rows that the kinds have: the mean weight is one and
    positives weigh as much as negatives."""
    out = np.zeros(5)
    for side in ((1, 3), (0, 2, 4)):
        whole = sum(SHARES[k] for k in side if rows.get(k))
        for k in side:
            if rows.get(k):
                out[k] = 0.5 * SHARES[k] / whole * sum(rows.values()) / rows[k]
    return out


def learn(docs: DataFrame) -> Network | None:
    """The network from all labelled candidates of ``docs``, dealt in parts to tasks."""
    import pyarrow as pa

    spark = docs.sparkSession
    held_out = F.pmod("h", F.lit(5)) == 0
    found = cut(labelled(docs))
    count = {(r.y, r.held): r["count"] for r in found.groupBy("y", held_out.alias("held")).count().collect()}
    if count.get((1, False), 0) + count.get((1, True), 0) < 5:
        return None
    total = {k: count.get((k, False), 0) for k in (0, 1, 2)}
    parts = max(1, -(-sum(total.values()) // PART_ROWS))
    rounds = int(min(max(-(-SEEN // max(1, sum(total.values()))), ROUNDS[0]), ROUNDS[1]))
    keys, near = _drawn(np.random.default_rng(5), DRAWN)
    fold = lambda strings, held: [s for k, s in enumerate(strings) if (k % 5 == 0) == held]
    # rare kinds are shown several times in a round
    often = lambda rows, share: int(min(max(share * sum(total.values()) / max(1, rows), 1), REPEATED))
    times = {1: often(3 * total[1], 0.1), 0: often(total[0], 0.04)}
    drawn = int(min(0.1 * PART_ROWS, 0.8 * DRAWN)) if parts > 1 else int(0.8 * DRAWN)  # keys that a part shows in a round
    weight = _weights({1: 3 * total[1] * times[1], 0: total[0] * times[0], 2: total[2], 3: drawn * parts, 4: drawn * parts})
    network = Network()
    text, kinds = _shown(np.random.default_rng(6), [], [], [], fold(keys, False), fold(near, False), {})
    network.fit(encode(text), (kinds == 3).astype(np.float32), epochs=3)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("seen", "h"), F.lit(parts)).cast("int"))
    strings = spark.sparkContext.broadcast((keys, near))

    def rows_of(table: pa.Table) -> tuple[int, list, list, list]:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "seen", "n", "y"))))
        return table.column("part")[0].as_py(), *([r[k] for r in rows] for k in (1, 2, 3))

    def trainer(now, turn: int):
        def train(table: pa.Table) -> pa.Table:
            part, *rows = rows_of(table)
            rng = np.random.default_rng([7, turn, part])
            some = [[s[k] for k in rng.permutation(len(s))[:drawn]] for s in (fold(x, False) for x in strings.value)]
            text, kinds = _shown(rng, *rows, *some, times)
            mine = now.value
            mine.fit(encode(text), np.isin(kinds, (1, 3)).astype(np.float32), epochs=1, rate=0.004 * (1 - turn / rounds),
                     seed=part, weight=weight[kinds])
            # whole numbers, so that the sums do not depend on their order
            sums = np.round(mine.packed().astype(float) * len(rows[0]) * 1e6).astype(np.int64)
            return pa.table({"place": np.arange(len(sums)), "value": sums, "rows": np.full(len(sums), len(rows[0]))})
        return train

    for turn in range(rounds):
        now = spark.sparkContext.broadcast(network)
        got = (dealt.where(~held_out).groupBy("part").applyInArrow(trainer(now, turn), "place long, value long, rows long")
               .groupBy("place").agg(F.sum("value").alias("value"), F.sum("rows").alias("rows")).orderBy("place").collect())
        if got:  # a row per parameter
            network.unpack(np.array([r.value / r.rows / 1e6 for r in got]))
    now = spark.sparkContext.broadcast(network)

    def score(table: pa.Table) -> pa.Table:
        part, *rows = rows_of(table)
        rng = np.random.default_rng([8, part])
        some = [s[part::parts] for s in (fold(x, True) for x in strings.value)]
        text, kinds = _shown(rng, *rows, *some, {})
        bins = np.floor(now.value.logit(encode(text)) * BINS).astype(np.int64)
        pairs, n = np.unique(np.stack([kinds, bins]), axis=1, return_counts=True)
        return pa.table({"kind": pairs[0], "bin": pairs[1], "times": n})

    got = (dealt.where(held_out).groupBy("part").applyInArrow(score, "kind long, bin long, times long")
           .groupBy("kind", "bin").agg(F.sum("times").alias("times")).orderBy("kind", "bin").collect())
    kinds, bins, n = (np.array([r[c] for r in got], np.int64) for c in ("kind", "bin", "times"))
    if not (kinds == 3).any():  # no row is held out
        text, kinds = _shown(np.random.default_rng(8), [], [], [], fold(keys, True), fold(near, True), {})
        bins, n = np.floor(network.logit(encode(text)) * BINS), np.ones(len(kinds))
    per_row = _weights({k: int(n[kinds == k].sum()) for k in range(5)})
    network.calibrate_counts(bins, np.isin(kinds, (1, 3)).astype(float), n * per_row[kinds])
    return network


def scan_documents(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans) per row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"]

    def work(batches):
        for batch, texts in text_blocks(batches):
            rows = []
            for spans in scan_all([(t or b"").decode() for t in texts], shared.value):
                n = np.bincount([k for _, k, _ in spans], minlength=4).tolist()
                base = joined([s for s in spans if s[1] < 3])
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows))], names)

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, "
                                "base_sha256 string, spans string")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, learn(docs))
