"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer file is compiled into two deterministic transducers.

* **Split transducer** (12 states over 11 character classes): reads characters
  and marks where pre-tokens begin; outputs that need a character of look-ahead
  are delayed by one step. Texts are laid end to end and cut into chunks. Each
  chunk's state map (start state -> end state) is found for all start states at
  once, the maps are composed by a parallel prefix scan (log2(chunks) rounds of
  vector operations), and then all chunks run side by side from their now
  known start states.
* **Count transducer** over the bytes of a pre-token: each transition carries
  the number of tokens it adds (it can be negative: a byte may close a merge that
  replaces earlier tokens). A state holds, for every suffix of the bytes read
  that begins some token, the place in the token trie, the token before the
  suffix and the count there relative to now. The next last token is the one
  that may stand after the token before it, by the order of merges. States are
  made when first reached and kept per worker up to a bound; a run is linear in
  the bytes, also for one very long pre-token.

The counts equal the library's, with the strings of special tokens inside a
text taken as the special token (the library's default). A null text counts as
empty (0 tokens). Rows are independent: repeated rows are repeated, a null doc_id
stays null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_blocks, worker_cache

LIMIT = 1024
WINDOW = 1 << 22       # characters of one very long text that are split at once
MAX_STATES = 150_000   # made states and kept pre-tokens of a worker, at most
MAX_WORDS = 700_000
KEPT_LENGTH = 64       # longer pre-tokens are counted anew

# ---- split transducer -------------------------------------------------------

# Character classes. The letters that can end a contraction have their own.
SPACE, BLANK, QUOTE, STMD, RV, ELL, EE, LETTER, NUMBER, OTHER, END = range(11)
LETTERS = (STMD, RV, ELL, EE, LETTER)
# States: what the token being read is.
(START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK,
 APOSTROPHE, APOSTROPHE_RV, APOSTROPHE_L, CONTRACTION) = range(12)
HERE, BEFORE = 1, 2  # output: a token begins at this character / at the one before


def _begin(c: int) -> int:
    """State after the first character of a token."""
    if c in LETTERS:
        return WORD
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: APOSTROPHE, NUMBER: DIGITS, OTHER: SIGNS, END: START}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, output) of the split transducer."""
    fresh = (_begin(c), 0 if c == END else HERE)
    blank_run = {SPACE: (RUN_SPACE, 0), BLANK: (RUN_BLANK, 0)}
    if state == WORD:
        return (WORD, 0) if c in LETTERS else fresh
    if state == DIGITS:
        return (DIGITS, 0) if c == NUMBER else fresh
    if state == SIGNS:
        return (SIGNS, 0) if c in (OTHER, QUOTE) else fresh
    if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        if c in blank_run:
            return blank_run[c]
        if c == END:
            return (START, 0)
        if state in (ONE_SPACE, RUN_SPACE):  # the last space belongs to the token that follows
            joined = SIGNS if c == QUOTE else _begin(c)
            return (joined, BEFORE if state == RUN_SPACE else 0)
        return (_begin(c), HERE | (BEFORE if state == RUN_BLANK else 0))
    if state == APOSTROPHE:
        if c in (STMD, RV, ELL):
            return ({STMD: CONTRACTION, RV: APOSTROPHE_RV, ELL: APOSTROPHE_L}[c], 0)
        return (SIGNS, 0) if c in (OTHER, QUOTE) else fresh
    if state in (APOSTROPHE_RV, APOSTROPHE_L):
        if c == (EE if state == APOSTROPHE_RV else ELL):
            return (CONTRACTION, 0)
        after, out = _step(WORD, c)  # no contraction: a word began one character ago
        return (after, out | BEFORE)
    return fresh  # START, CONTRACTION


_NEXT = bytes((_step(i >> 4, i & 15)[0] << 4) if i >> 4 <= CONTRACTION and i & 15 <= END else 0 for i in range(256))
_OUT = bytes(_step(i >> 4, i & 15)[1] if i >> 4 <= CONTRACTION and i & 15 <= END else 0 for i in range(256))


def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        found = "".join(regex.findall(pattern + "+", every))
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = value
    for chars, value in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE)):
        table[[ord(c) for c in chars]] = value
    return table


def _follow(lanes: np.ndarray) -> np.ndarray:
    """Next (shifted) states of lanes that hold (shifted state | class)."""
    return np.frombuffer(lanes.tobytes().translate(_NEXT), np.uint8).reshape(lanes.shape)


def split_outputs(classes: np.ndarray) -> np.ndarray:
    """Output of the split transducer at each character, by chunks in parallel."""
    n = len(classes)
    size = max(64, int(np.ceil(np.sqrt(n))))
    chunks = -(-n // size)
    steps = np.full(chunks * size, END, np.uint8)
    steps[:n] = classes
    steps = np.ascontiguousarray(steps.reshape(chunks, size).T)  # step, chunk
    # state maps of the chunks: all start states until they meet, one lane after that
    lanes = np.repeat((np.arange(CONTRACTION + 1, dtype=np.uint8) << 4)[:, None], chunks, 1)
    at = 0
    while at < size and (lanes != lanes[0]).any():
        lanes = _follow(lanes | steps[at])
        at += 1
    if at < size:
        one = lanes[0]
        for t in range(at, size):
            one = _follow(one | steps[t])
        lanes = np.broadcast_to(one, lanes.shape)
    maps = np.ascontiguousarray((lanes >> 4).T).astype(np.intp)  # chunk, start state -> end state
    reach = 1
    while reach < chunks:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[:-1, START] << 4
    ran = np.empty_like(steps)
    for t in range(size):
        np.bitwise_or(state, steps[t], out=ran[t])
        state = _follow(ran[t])
    out = np.frombuffer(np.ascontiguousarray(ran.T).tobytes().translate(_OUT), np.uint8)
    return out[:n]


# ---- count transducer -------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files (fixed rule)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class CountTransducer:
    """Number of BPE tokens of a pre-token's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        n = max(vocab.values()) + 1
        self.rank = [-1] * n
        self.left, self.right = list(range(n)), list(range(n))
        self.merge: dict[int, int] = {}  # left << 32 | right -> rank
        reachable = [False] * n
        for i in letters:
            reachable[vocab[i]] = True
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, new = vocab[a], vocab[b], vocab[a + b]
            self.merge[x << 32 | y] = rank
            self.rank[new], self.left[new], self.right[new] = rank, x, y
            reachable[new] = reachable[x] and reachable[y] and self._stay_apart(x, y, rank)
        self.child: dict[int, int] = {}   # trie: node << 8 | byte -> node
        self.token = [-1]                 # token that ends at a node
        self.inner = [True]               # whether a node has children
        for text, t in vocab.items():
            if not reachable[t]:
                continue
            node = 0
            for c in text:
                key = node << 8 | letters[c]
                self.inner[node] = True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = t
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = ((0, -1, 0),)  # trie node, token before the suffix, count there minus count now
        self.states, self.number, self.moves = [first], {first: 0}, {}

    def _stay_apart(self, x: int, y: int, before: int) -> bool:
        """Whether no merge joins the end of token x to the start of token y before
        rank ``before``: their parts are taken apart, latest merge first, and a
        merge across counts while both parts exist."""
        rank, merge = self.rank, self.merge
        until_x = until_y = before
        while True:
            across = merge.get(x << 32 | y)
            if across is not None and across < until_x and across <= until_y:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                until_x, x = rank[x], self.right[x]
            else:  # of equal merges the left one was made first, so the right one is undone first
                until_y, y = rank[y], self.left[y]

    def _may_follow(self, x: int, y: int) -> bool:
        key = x << 32 | y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(x, y, 1 << 30)
        return known

    def _move(self, state: int, byte: int) -> int:
        """Makes a transition: next state << 8 | (tokens added + 128)."""
        alive, added, last = [], None, -1
        for node, before, count in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if added is None and t >= 0 and (before < 0 or self._may_follow(before, t)):
                added, last = count + 1, t
            if self.inner[nxt]:
                alive.append((nxt, before, count))
        key = (*((node, before, count - added) for node, before, count in alive), (0, last, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = number << 8 | (added + 128)
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._clear()
        moves, state, n = self.moves, 0, 0
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 8
            n += (move & 255) - 128
        return n


class Words(dict):
    """Pre-token -> count; computed when missing, emptied when full."""

    def __init__(self, transducer: CountTransducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self.transducer.count(word.encode())
        if len(word) <= KEPT_LENGTH:
            self[word] = n
        return n


class TokenCounter:
    """Token counts of texts for one tokenizer file."""

    def __init__(self, path: str):
        self.classes = _classes()
        self.words = Words(CountTransducer(path))
        self.special = self.words.transducer.special

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of these there are."""
        parts, n = [text], 0
        for s in self.special:
            if s in text:
                cut = [p.split(s) for p in parts]
                n += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
        return parts, n

    def _pieces(self, joined: str, ends: np.ndarray):
        """(begins of pieces, whether a piece is a text's end mark)."""
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        classes[ends] = END
        out = split_outputs(classes)
        marks = (out & HERE).astype(bool)
        marks[:-1] |= (out[1:] & BEFORE).astype(bool)
        marks[ends] = True
        at = np.flatnonzero(marks)
        return at, classes[at] == END

    def _long(self, text: str) -> int:
        """One very long text, window by window: a window starts at a token."""
        n, start, size = 0, 0, WINDOW
        while start < len(text):
            last = start + size >= len(text)
            part = text[start:start + size]
            joined = part + "\n" if last else part
            at, _ = self._pieces(joined, np.array([len(part)] if last else [], np.int64))
            if len(at) < 2:
                size *= 2  # one token is longer than the window
                continue
            bounds = at.tolist()
            n += sum(self.words[joined[a:b]] for a, b in zip(bounds, bounds[1:]))
            if last:
                break
            start, size = start + bounds[-1], WINDOW
        return n

    def counts(self, texts: list[bytes | None]) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        segments, owner = [], []
        for i, raw in enumerate(texts):
            parts, special = self._segments((raw or b"").decode())
            out[i] += special
            for p in parts:
                if len(p) > WINDOW:
                    out[i] += self._long(p)
                elif p:
                    segments.append(p)
                    owner.append(i)
        if segments:
            joined = "\n".join(segments) + "\n"
            ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
            at, is_end = self._pieces(joined, ends)
            bounds = at.tolist()
            get = self.words.__getitem__
            n = np.fromiter((get(joined[a:b]) for a, b in zip(bounds, [*bounds[1:], len(joined)])),
                            np.int64, len(bounds))
            n[is_end] = 0
            of = np.asarray(owner)[np.cumsum(is_end) - is_end]
            out += np.bincount(of, weights=n, minlength=len(out)).astype(np.int64)
        return out.tolist()


_counters: dict[str, TokenCounter] = worker_cache("token_count")


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, for the tokenizer file at
    ``path`` (a byte-level BPE in the tokenizers library's format)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def work(batches):
        for batch, texts in text_blocks(batches, keep="token_count"):
            n = counter(path).counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
