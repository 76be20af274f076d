"""Personal data: fixed rules, and a skip-chain conditional random field that adds spans.

* **Rules** (leftmost, non-overlapping per kind): ``email``, ``ip`` (four parts of at
  most 255), ``card`` (16 to 19 digits that pass Luhn), ``phone`` (``+``, 8 to 15
  digits). Their spans always stay. Each is searched from the characters that a match
  must hold, so a long run of one character costs linear time.
* **Tokens**: the words with a digit or an ``@``. All others have the label "none" by
  definition, so a document's chain falls into runs of neighbouring tokens.
* **Field**: labels none, email, ip, card, phone. Potentials: features of a token, of its
  neighbours and of the word before it; a matrix of transitions along a run; and skip
  links between distant tokens of the document. Equal tokens share the key of their letters
  and digits; similar ones share their last ``TAIL`` digits, or the part of an address
  before its ``@``. All tokens with a key are tied to one node of that key (a star), so a
  group of any size has as many links as tokens, and a learned weight per label rewards agreement.
* **Inference**: loopy sum-product over runs and stars, all documents of a block at
  once, until no message changes (``ROUNDS`` at most). Tokens inside rule findings
  are held at their kind, so a phone number written once with its ``+`` marks the
  other ways it is written in the document.
* **Training**: pseudo-likelihood by gradient steps in numpy. Labels come from the rules'
  findings in a bounded sample of documents (``SAMPLE_DOCS``, of each at most ``SAMPLE_TOKENS``
  tokens) and from drawn texts, where findings are also written without the marks
  that the rules need, beside dates, versions, prices, times and serial numbers.
* **Threshold**: per kind, the lowest probability that marks at most ``FALSE`` of the
  held-out tokens without a label (0.5 at least).
* A run of tokens with one label, outside rule findings, adds a span of kind
  ``crf_email``, ``crf_ip``, ``crf_card`` or ``crf_phone``.

Offsets are code points, ends exclusive. Null or empty text: no span. Rows are
scanned each on its own (repeated ones are repeated, a null doc_id stays null). An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, ship, text_blocks

# fixed values: kinds in the order of the digest
KINDS = ("email", "ip", "card", "phone")
SPAN_KINDS = KINDS + tuple(f"crf_{k}" for k in KINDS)
NONE, LABELS = 0, 1 + len(KINDS)

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match begins and ends with whole runs of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
GAP = 3                # white space between two tokens of a run, at most

SAMPLE_DOCS = 20_000   # documents that the rules label for training, about
SAMPLE_KEPT = 2000     # of these, with a finding and without one, each at most
SAMPLE_TOKENS = 200
DRAWN = 6000           # drawn texts
FALSE = 0.002
ROUNDS = 20
TAIL = 7
LEAST_KEY = 4
HASHED = 1 << 10       # values of a hashed feature


# ---- rules --------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rule findings, in this order."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# ---- tokens and their features --------------------------------------------------

def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words with a digit or an @."""
    out, end = [], 0
    for m in TOKEN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] not in SPACE:
            start -= 1
        end = m.end()
        out.append((start, end))
    return out


def labels(spans: list[tuple[int, int, int]], at: list[tuple[int, int]]) -> list[int]:
    """Label of each token: 1 + the first kind whose finding meets it, 0 for none."""
    out = [NONE] * len(at)
    for kind, a, b in sorted(spans, reverse=True):  # an earlier kind overwrites a later one
        low = _first_behind(at, a)
        while low < len(at) and at[low][0] < b:
            out[low] = 1 + kind
            low += 1
    return out


def _first_behind(at: list[tuple[int, int]], place: int) -> int:
    """Index of the first token that ends behind ``place``."""
    low, high = 0, len(at)
    while low < high:
        mid = (low + high) // 2
        if at[mid][1] > place:
            high = mid
        else:
            low = mid + 1
    return low


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % HASHED


_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_NOT_KEY = re.compile(r"[\W_]+")
_PAD = _hash("")


def shape(word: str) -> str:
    """Runs of digits as their length, runs of letters as ``a``, other characters as they are."""
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: str(min(9, m.end() - m.start())), word[:64]))


def token_features(word: str) -> tuple[list[int], int]:
    """(numbers of the token's own features, hash of its shape)."""
    digits = _NOT_DIGIT.sub("", word)
    parts = word.strip(".,;:!?\"'()[]<>").split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    form = _hash(shape(word))
    own = [min(len(digits), 20),
           32 + min(4, len(_LETTERS.findall(word[:256]))),
           40 + (word.find("@") > 0) + 2 * ("." in word[word.find("@"):] and "@" in word),
           48 + min(5, word.count(".")), 56 + min(5, word.count("-")), 64 + min(3, word.count(":") + word.count("/")),
           72 + {"+": 0, "(": 1, "@": 2, "$": 3}.get(word[0], 4 + word[0].isdigit()),
           80 + octets, 82 + (13 <= len(digits) <= 19 and luhn(digits)), 96 + form]
    return own, form


FEATURES = 96 + 4 * HASHED  # own ones, shape, shapes of both neighbours, word before
WIDE = 13


def keys(word: str) -> tuple[str, str]:
    """(key of equal tokens, key of similar ones); empty where too short."""
    whole = _NOT_KEY.sub("", word[:256]).lower()
    if "@" in word:
        part = _NOT_KEY.sub("", word[:word.index("@")][-256:]).lower()
    else:
        digits = _NOT_DIGIT.sub("", word)
        part = digits[-TAIL:] if len(digits) > TAIL else ""
    return (whole if len(whole) >= LEAST_KEY else ""), (part if len(part) >= LEAST_KEY else "")


class Batch:
    """Tokens of several texts as arrays: features, links along runs, links to keys."""

    def __init__(self, texts: list[str], at: list[list[tuple[int, int]]]):
        feats, joined, star, own, number = [], [], [], [], {}
        for doc, (text, places) in enumerate(zip(texts, at)):
            words = [text[a:b] for a, b in places]
            seen = [token_features(w) for w in words]
            for k, (a, _) in enumerate(places):
                near = k > 0 and a - places[k - 1][1] <= GAP and text[places[k - 1][1]:a].strip() == ""
                joined.append(near)
                feats.append([*seen[k][0], 96 + HASHED + (seen[k - 1][1] if near else _PAD), 0,
                              96 + 3 * HASHED + (_PAD if near else _before(text, a))])
                if near:
                    feats[-2][11] = 96 + 2 * HASHED + seen[k][1]
                for which, key in enumerate(keys(words[k])):
                    if key:
                        star.append((len(joined) - 1, number.setdefault((doc, key), len(number))))
                        own.append(which)
        self.x = np.array(feats, np.int64).reshape(-1, WIDE)
        self.x[self.x[:, 11] == 0, 11] = 96 + 2 * HASHED + _PAD
        self.n = len(joined)
        self.left = np.flatnonzero(np.array(joined[1:], bool)) if self.n else np.zeros(0, np.int64)
        pairs = np.array(star, np.int64).reshape(-1, 2)
        used = np.bincount(pairs[:, 1], minlength=len(number)) > 1  # a key of one token links nothing
        kept = used[pairs[:, 1]] if len(pairs) else np.zeros(0, bool)
        self.token, self.which = pairs[kept, 0], np.array(own, np.int64)[kept]
        _, self.key = np.unique(pairs[kept, 1], return_inverse=True)
        self.keys = int(self.key.max()) + 1 if len(self.key) else 0


def _before(text: str, a: int) -> int:
    words = text[max(0, a - 40):a].split()
    return _hash(words[-1].lower().strip(".,;:!?\"'()")) if words else _PAD


def _sum(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=c, minlength=n) for c in values.T], 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Field:
    """Weights of the features, transitions and skip links; thresholds of the kinds."""

    def __init__(self):
        self.w = np.zeros((FEATURES, LABELS))
        self.t = np.zeros((LABELS, LABELS))
        self.s = np.zeros((2, LABELS))  # of equal and of similar tokens with the same label
        self.threshold = np.ones(LABELS)

    def unary(self, b: Batch) -> np.ndarray:
        """Log potential of each token alone, with the "none" beyond the ends of its run."""
        u = self.w[b.x].sum(1)
        first, last = np.ones(b.n, bool), np.ones(b.n, bool)
        first[b.left + 1] = False
        last[b.left] = False
        return u + first[:, None] * self.t[NONE] + last[:, None] * self.t[:, NONE]

    def ties(self) -> np.ndarray:
        """Log potential of a token and the node of its key, for both kinds of link: two
        tokens tied to one node then agree in a label by the factor exp(s)."""
        e = np.exp(self.s)
        return np.log(e + np.sqrt(e * e + (LABELS - 2) * e - (LABELS - 1)))

    def marginals(self, b: Batch, held: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities by loopy sum-product; ``held``: label of a token that is
        known, -1 for the others."""
        u = self.unary(b)
        known = held >= 0
        u[known] = -1e3
        u[known, held[known]] = 0
        right = b.left + 1
        onward, back = np.zeros((len(right), LABELS)), np.zeros((len(right), LABELS))
        down = np.zeros((len(b.token), LABELS))  # from a key's node to a token
        tie = self.ties()[b.which][:, None, :] * np.eye(LABELS)
        for _ in range(rounds):
            belief = u.copy()
            belief[right] += onward
            belief[b.left] += back
            belief += _sum(down, b.token, b.n)
            up = _lse((belief[b.token] - down)[:, :, None] + tie, 1)
            up -= up.max(1, keepdims=True)
            new_onward = _lse((belief[b.left] - back)[:, :, None] + self.t, 1)
            new_back = _lse((belief[right] - onward)[:, None, :] + self.t, 2)
            node = _sum(up, b.key, b.keys) if b.keys else np.zeros((0, LABELS))
            new_down = _lse((node[b.key] - up)[:, :, None] + tie, 1)
            change = 0.0
            for old, new in ((onward, new_onward), (back, new_back), (down, new_down)):
                new -= new.max(1, keepdims=True)
                change = max(change, float(np.abs(new - old).max(initial=0)))
                old[:] = new
            if change < 1e-4:
                break
        belief = u + _sum(down, b.token, b.n)
        belief[right] += onward
        belief[b.left] += back
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def around(self, b: Batch, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels before and behind each token, and for both kinds of link the share of
        each label among the other tokens of its key."""
        before, behind = np.full(b.n, NONE), np.full(b.n, NONE)
        before[b.left + 1] = y[b.left]
        behind[b.left] = y[b.left + 1]
        share = np.zeros((2, b.n, LABELS))
        if b.keys:
            hot = np.eye(LABELS)[y[b.token]]
            others = (_sum(hot, b.key, b.keys)[b.key] - hot)
            others /= np.maximum(others.sum(1, keepdims=True), 1)
            for k in (0, 1):
                np.add.at(share[k], b.token[b.which == k], others[b.which == k])
        return before, behind, share

    def fit(self, b: Batch, y: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> None:
        """Pseudo-likelihood: each token's label given those around it; labels weigh
        by the root of their frequency."""
        before, behind, share = self.around(b, y)
        target = np.eye(LABELS)[y]
        weight = 1 / np.sqrt(np.maximum(target.sum(0), 1))[y]
        weight = (weight / weight.sum())[:, None]
        params = {"w": self.w, "t": self.t, "s": self.s}
        m1 = {k: np.zeros_like(v) for k, v in params.items()}
        m2 = {k: np.zeros_like(v) for k, v in params.items()}
        flat = b.x.ravel()
        for step in range(1, steps + 1):
            logit = self.w[b.x].sum(1) + self.t[before] + self.t[:, behind].T
            logit = logit + (self.s[:, None] * share).sum(0)
            p = np.exp(logit - logit.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target) * weight
            g = {"w": np.stack([np.bincount(flat, weights=np.repeat(c, WIDE), minlength=FEATURES) for c in d.T], 1),
                 "t": _sum(d, before, LABELS) + _sum(d, behind, LABELS).T,
                 "s": (d * share).sum(1)}
            for k, v in params.items():
                grad = g[k] + decay * v / len(params)
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad ** 2
                v -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(self.s, 0, out=self.s)

    def calibrate(self, b: Batch, y: np.ndarray, held: np.ndarray) -> None:
        """Per kind the lowest threshold that marks at most ``FALSE`` of the tokens of no kind."""
        p = self.marginals(b, held)
        plain = p[(y == NONE) & (held < 0)]
        for k in range(1, LABELS):
            scores = np.sort(plain[:, k])[::-1]
            allowed = int(FALSE * len(scores))
            self.threshold[k] = max(0.5, float(np.nextafter(scores[allowed], 2)) if len(scores) else 0.5)

    def decide(self, p: np.ndarray) -> np.ndarray:
        best = p[:, 1:].argmax(1) + 1
        return np.where(p[np.arange(len(p)), best] >= self.threshold[best], best, NONE)


# ---- scanning -------------------------------------------------------------------

_TRIM = ".,;:!?\"'<>[]{}"


def scan_all(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """All spans (span kind number, start, end) of each text, sorted."""
    found = [rule_spans(t) for t in texts]
    if field is None:
        return [sorted(s) for s in found]
    at = [tokens(t) for t in texts]
    asked = [i for i, places in enumerate(at) if places]
    if asked:
        batch = Batch([texts[i] for i in asked], [at[i] for i in asked])
        known = np.array([y for i in asked for y in labels(found[i], at[i])])
        y = field.decide(field.marginals(batch, np.where(known > 0, known, -1)))
        y[known > 0] = NONE  # rule findings stay as they are
        tied = np.zeros(batch.n + 1, bool)
        tied[batch.left + 1] = True  # belongs to the run of the token before
        k = 0
        for i in asked:
            places = at[i]
            j = 0
            while j < len(places):
                kind, end = int(y[k + j]), j + 1
                while kind and end < len(places) and tied[k + end] and y[k + end] == kind:
                    end += 1
                if kind:
                    span = _trimmed(texts[i], places[j][0], places[end - 1][1])
                    if span:
                        found[i].append((len(KINDS) + kind - 1, *span))
                j = end
            k += len(places)
    return [sorted(s) for s in found]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a] in _TRIM:
        a += 1
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    return (a, b) if a < b else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- training -------------------------------------------------------------------

def _drawn(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n texts by fixed rules, with the (kind, start, end) of what they hold."""
    d = lambda k, low=0: "".join(map(str, rng.integers(low, 10, k)))
    word = lambda: "".join(rng.choice(list("aeioubcdlmnrst"), int(rng.integers(2, 9))))

    def card() -> str:
        body = str(rng.integers(3, 7)) + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def personal(kind: int) -> tuple[str, list[str]]:
        """(a text the rules find, other ways to write it)."""
        if kind == 0:
            name, host = f"{word()}{rng.choice(['.', '_', ''])}{rng.choice(['', word()])}{rng.integers(10, 9999)}", word()
            return f"{name}@{host}.example.com", [f"{name}@{host}", f"{name}@@{host}.com", name, f"{name}@{host}..com"]
        if kind == 1:
            parts = [str(p) for p in rng.integers(0, 256, 4)]
            return ".".join(parts), ["-".join(parts), "[" + "][".join(parts) + "]", ":".join(parts)]
        if kind == 2:
            c = card()
            four = [c[:4], c[4:8], c[8:12], c[12:]]
            return rng.choice([c, " ".join(four), "-".join(four)]), [
                ".".join(four), "/".join(four), "  ".join(four), "_".join(four), c[:8] + "." + c[8:]]
        area, a, b = d(3, 2), d(3, 2), d(4)
        return rng.choice([f"+1 ({area}) {a}-{b}", f"+{rng.integers(30, 99)} {area} {a} {b}", f"+1{area}{a}{b}"]), [
            f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"001 {area} {a} {b}", f"{area} {a} {b}", f"{a}-{b}",
            f"{area}{a}{b}"]

    def plain() -> str:
        i = rng.integers
        return [f"{i(1900, 2030)}", f"{i(1900, 2030)}-{i(10, 13)}-{i(10, 29)}", f"{i(1, 29)}.{i(1, 13)}.{i(1990, 2030)}",
                f"{i(0, 24)}:{i(10, 60)}", f"{i(1, 9)}.{i(0, 30)}.{i(0, 30)}", f"${i(1, 999)},{d(3)}.{d(2)}",
                f"{i(1, 100)}%", f"{i(1900, 1990)}-{i(1990, 2030)}", f"{word()}-{i(100, 99999)}", f"No. {i(1, 99999)}",
                f"{d(16)}", f"{d(int(i(5, 13)))}", f"{i(2, 10)}.0.", f"v{i(1, 9)}.{i(0, 99)}", f"978-{i(1, 9)}-{d(2)}-{d(6)}-{i(1, 9)}",
                f"{d(2)}.{d(4)},{d(2)}.{d(4)}", f"{word()}{i(1, 99)}", f"AKIA{''.join(rng.choice(list('ABCDEFGH23456'), 16))}",
                "".join(rng.choice(list("0123456789abcdef"), 40)), f"{i(1, 99)} {i(1, 99)} {i(1, 99)}", f"@{word()}",
                f"{i(300, 999)}.{i(1, 999)}.{i(1, 999)}.{i(1, 999)}", f"{i(1, 20)}/{i(2, 20)}", f"x@{i(1, 9)}"][i(24)]

    out = []
    for k in range(n):
        pieces: list[tuple[int, str]] = []
        kind = int(rng.integers(len(KINDS)))
        for _ in range(int(rng.integers(0, 3))):
            p = plain()
            pieces += [(-1, p)] * int(rng.integers(1, 3))  # some stand twice
        if k % 5 < 3:
            first, ways = personal(kind)
            if k % 5 == 0:
                pieces.append((kind, first))
            # unmistakable only beside a finding: a bare name, seven digits, ten digits in a row
            beside = {0: [2], 3: [4, 5, 6]}.get(kind, [])
            alone = [w for j, w in enumerate(ways) if j not in beside]
            if k % 5 == 1:
                pieces += [(kind, first), (kind, ways[rng.integers(len(ways))])]
            elif k % 5 == 2:
                pieces.append((kind, alone[rng.integers(len(alone))]))
        text, spans = "", []
        for j in rng.permutation(len(pieces)):
            what, s = pieces[j]
            text += " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " "
            if what >= 0:
                spans.append((what, len(text), len(text) + len(s)))
            text += s + rng.choice([" ", ". ", ", ", "\n"])
        out.append((text + word(), spans))
    return out


def learn(docs: DataFrame) -> Field:
    """The field from the rules' findings in a bounded sample of ``docs`` and drawn texts."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    src = hashed_sample(src, SAMPLE_DOCS, src.count(), "text").withColumn("h", F.xxhash64("text"))

    def gather(batches):
        for batch, texts in text_blocks(batches):
            rows = []
            for h, t in zip(batch.column("h").to_pylist(), texts):
                text = t.decode()
                at = tokens(text)
                if at:
                    # the tokens with what stands before them; the text between is left out
                    short, places = "", []
                    for (a, b), last in list(zip(at, [0, *(e for _, e in at)]))[:SAMPLE_TOKENS]:
                        short += (text[last:a] if a - last <= 40 else " " + text[a - 40:a])
                        places.append((len(short), len(short) + min(b - a, 256)))
                        short += text[a:min(b, a + 256)]
                    y = labels(rule_spans(text), at)[:SAMPLE_TOKENS]
                    rows.append((h, short, [p for p, _ in places], [e for _, e in places], y, max(y) > 0))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)], ["h", "text", "starts", "ends", "y", "found"])

    seen = src.mapInArrow(gather, "h long, text string, starts array<long>, ends array<long>, y array<long>, "
                                  "found boolean").dropDuplicates(["h"])
    rows = [r for flag in (True, False)
            for r in seen.where(F.col("found") == flag).orderBy("h").limit(SAMPLE_KEPT).collect()]
    train, test = ([], [], []), ([], [], [])
    for r in rows:
        fold = test if r.h % 3 == 0 else train
        fold[0].append(r.text)
        fold[1].append(list(zip(r.starts, r.ends)))
        fold[2].extend(r.y)
    for k, (text, spans) in enumerate(_drawn(np.random.default_rng(5), DRAWN)):
        fold, at = (test if k % 3 == 0 else train), tokens(text)
        fold[0].append(text)
        fold[1].append(at)
        fold[2].extend(labels(spans + rule_spans(text), at))
    field = Field()
    field.fit(Batch(train[0], train[1]), np.array(train[2]))
    y = np.array(test[2])
    known = np.array([k for t, at in zip(test[0], test[1]) for k in labels(rule_spans(t), at)])
    field.calibrate(Batch(test[0], test[1]), y, np.where(known > 0, known, -1))
    return field


def scan_documents(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_crf, base_sha256, spans) per row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_crf", "base_sha256", "spans"]

    def work(batches):
        for batch, texts in text_blocks(batches):
            rows = []
            for spans in scan_all([(t or b"").decode() for t in texts], shared.value):
                n = np.bincount([k for k, _, _ in spans], minlength=len(SPAN_KINDS)).tolist()
                base = joined([s for s in spans if s[0] < len(KINDS)])
                rows.append((*n[:4], sum(n[4:]), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows))], names)

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_crf long, "
                                "base_sha256 string, spans string")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, learn(docs))
