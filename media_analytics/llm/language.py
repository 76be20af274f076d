"""Language identification by error-correcting output codes.

* Features: character 2- and 3-grams of the lower-cased text (every character
  that is no letter is one blank symbol), hashed into ``BUCKETS`` buckets.
* Statistics: bucket counts per language over all training documents (text and
  lang given, crc32(doc_id) mod 4 is not 2), summed in the tasks and
  then per (lang, bucket). Only languages x buckets rows reach the driver.
* Codewords: every language gets a word of bits; all two-way splits of the
  languages for up to five, else random words with the largest least distance of several draws.
* One binary classifier per bit: log odds of each bucket between the languages
  with a 1 and those with a 0, languages weighing the same. A text's margin is
  the mean log odds times the number of its n-grams (at most ``EVIDENCE``,
  since neighbouring n-grams are not independent).
* Decoding: the codeword with the least weighted logistic loss over the bits. A
  bit weighs by how well it separates a bounded sample of training documents
  (about ``CALIBRATION`` of them, by hash of the id). score is the soft-min share of the chosen codeword; below
  ``AMBIGUOUS`` the document is flagged.

``known_language`` (the pipeline's stage) learns one codeword more, that of no language: all
buckets alike. Its bits tell the learned languages together from keyboard mash, base64
or scripts that were not learned, while a text that mixes learned languages stays near
them. A document goes if this codeword is nearest by ``CERTAIN`` of loss per bit and n-gram,
both for the whole text and for its plain words (without digits, of at most ``PLAIN`` bytes: a
key or an address in a short text is no sign of another language), or if it has no letter.

Only the text is an input of a prediction. Null text, or one without a letter:
``und`` with score 0; without any learned language every row is ``und``.
Repeated rows are judged alike, a row without an id is not learned from. An
empty table gives an empty result. ``known_language`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, hashed_sample, ship, text_blocks

BUCKETS = 1 << 13
EVIDENCE = 100
CALIBRATION = 4000
AMBIGUOUS = 0.6
PLAIN = 40             # bytes of a plain word, at most
CERTAIN = 0.25         # loss that the codeword of no language is nearer by, per bit and n-gram
SMOOTH = 0.5
WINDOW = 1 << 20       # characters whose n-grams are counted at once
UNKNOWN = "und"

_DIGIT = re.compile(rb"[0-9]")
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        import regex

        every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
        found = "".join(regex.findall(r"\p{L}+", every))
        table = np.zeros(0x110000, bool)
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = True
        _letters.append(table)
    return _letters[0]


def counts(text: bytes | None) -> np.ndarray | None:
    """Bucket counts of a text's n-grams; None if it has no letter."""
    codes = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), "<u4")
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return None
    out = np.zeros(BUCKETS, np.int64)
    step = WINDOW
    for k in range(0, len(codes), step):  # a very long text, window by window
        part, own = codes[max(0, k - 2):k + step], is_letter[max(0, k - 2):k + step]
        c = np.zeros(len(part) + (2 if k == 0 else 0) + 1, np.uint32)  # blanks around the text
        c[2 if k == 0 else 0:len(c) - 1] = part * own
        if k + step < len(codes):
            c = c[:-1]
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
        two = two[1 if k else 0:]
        for h in (two, three):
            out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=BUCKETS)
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1 / -1 bits: all distinct two-way splits for up to five languages,
    else the best of several fixed random draws."""
    if n <= 5:
        bits = max(0, 2 ** (n - 1) - 1)
        return np.array([[1 if row == 0 or not (b + 1) >> (row - 1) & 1 else -1 for b in range(bits)]
                         for row in range(n)], np.float64).reshape(n, bits)
    bits, best = math.ceil(10 * math.log2(n)), None
    for seed in range(20):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit that is the same for all
        gram = code @ code.T - 2 * bits * np.eye(n)
        if best is None or gram.max() < best[0]:
            best = (gram.max(), code)
    return best[1]


class Model:
    def __init__(self, langs: list[str], table: np.ndarray):
        """table: languages x buckets counts."""
        self.langs, self.code = langs, codewords(len(langs))
        p = (table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        for b in range(bits):
            one = self.code[:, b] > 0
            self.weights[:, b] = np.log(p[one].mean(0)) - np.log(p[~one].mean(0))
        self.bit_weight = np.ones(bits)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margin of each bit; x: documents x buckets."""
        n = np.maximum(x.sum(1), 1)
        return (x @ self.weights) * (np.minimum(n, EVIDENCE) / n)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its soft-min share)."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.bit_weight).sum(1) for word in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / share.sum(1)

    def no_language(self, text: bytes) -> bool:
        """Whether the last codeword is nearer than all others by ``CERTAIN`` per bit and n-gram, or
        the text has no letter."""
        x = counts(text)
        if x is None:
            return True
        margins = self.margins(x[None].astype(np.float32))
        loss = np.array([(np.logaddexp(0, -margins * word) * self.bit_weight).sum() for word in self.code])
        return loss[:-1].min() - loss[-1] >= CERTAIN * margins.shape[1] * min(x.sum(), EVIDENCE)

    def calibrate(self, margins: np.ndarray, truth: np.ndarray) -> None:
        """Weighs each bit by the log odds of its being right on labelled margins."""
        if not len(truth) or not margins.shape[1]:
            return
        right = ((margins > 0) == (self.code[truth] > 0)).sum(0) + 1.0
        wrong = len(truth) + 2 - right
        weight = np.maximum(np.log(right / wrong), 0.05)
        self.bit_weight = weight / weight.mean()


def learn(docs: DataFrame, no_language: bool = False) -> Model:
    """The model of the training documents of ``docs`` (doc_id, text, lang); with
    ``no_language``, the last codeword is that of no language (``UNKNOWN``)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    train = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang"))
             .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_of_id(F.col("doc_id")) % 4 != 2)))

    def gather(batches):
        total: dict[str, np.ndarray] = {}
        for batch, texts in text_blocks(batches):
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                x = counts(t)
                if x is None:
                    continue
                if lang in total:
                    total[lang] += x
                else:
                    total[lang] = x
        for lang, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)),
                                              pa.array(x[at])], ["lang", "bucket", "n"])

    sums = (train.select("lang", "text").mapInArrow(gather, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(sums["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    number = {lang: i for i, lang in enumerate(langs)}
    table[sums["lang"].map(number).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
    if no_language and langs:  # as many n-grams as a language has, dealt evenly
        model = Model([*langs, UNKNOWN], np.vstack([table, np.full(BUCKETS, table.sum() / table.size)]))
    else:
        model = Model(langs, table)
    if len(langs) > 1:
        picked = hashed_sample(train, CALIBRATION, train.count(), "doc_id")
        found = predict(picked, model, margins=True).toPandas()
        found = found[found["lang"].isin(number)]
        if len(found):
            model.calibrate(np.array(found["margins"].tolist()), found["lang"].map(number).to_numpy(int))
    return model


def judge(model: Model, texts: list[bytes | None]):
    """(positions of the texts with a letter, their margins, and for all texts the
    language, score and whether it is ambiguous)."""
    found = [counts(t) if model.langs else None for t in texts]
    at = [i for i, x in enumerate(found) if x is not None]
    margins = [model.margins(np.array([found[i] for i in at[k:k + 256]], np.float32)) for k in range(0, len(at), 256)]
    bits = np.concatenate([np.zeros((0, model.code.shape[1])), *margins])
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if at:
        best, share = model.decode(bits)
        lang[at], score[at] = [model.langs[b] for b in best], share
    unsure = np.array([s < AMBIGUOUS and x != UNKNOWN for s, x in zip(score, lang)], bool)
    return at, bits, lang, score, unsure


def predict(docs: DataFrame, model: Model, margins: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) per row; with ``margins``, (lang, margins)
    of the rows that have a letter instead."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x bits weights

    def work(batches):
        for batch, texts in text_blocks(batches):
            at, bits, lang, score, unsure = judge(shared.value, texts)
            if margins:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(at, pa.int64())),
                     pa.array(bits.astype(float).tolist(), pa.list_(pa.float64()))], ["lang", "margins"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(unsure)],
                    ["doc_id", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"),
                      *(["lang"] if margins else []))
    return src.mapInArrow(work, "lang string, margins array<double>" if margins else
                          "doc_id long, lang_pred string, score double, ambiguous boolean")


def op5_language(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    rest = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return found.select("doc_id", rest.alias("held_out"), "lang_pred", "score", "ambiguous")


def plain_words(text: bytes) -> bytes:
    return b" ".join(w for w in text.split() if len(w) <= PLAIN and not _DIGIT.search(w))


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is told, by a ``model`` with the codeword of no
    language: rows nearer to it by ``CERTAIN`` go, and rows without a letter, also if no
    language was learned. Ambiguous rows stay (they mix languages or are short)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches):
        for batch, texts in text_blocks(batches):
            if not shared.value.langs:
                keep = np.array([counts(t) is not None for t in texts], bool)
            else:
                at, _, lang, _, _ = judge(shared.value, texts)
                keep = np.zeros(len(texts), bool)
                keep[at] = [lang[i] != UNKNOWN or not (shared.value.no_language(texts[i])
                                                       and shared.value.no_language(plain_words(texts[i]))) for i in at]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
