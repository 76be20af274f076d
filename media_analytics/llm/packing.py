"""Token ids in a binary format of fixed-width packed blocks, written and read by Spark.

Format. A data set is a Parquet folder whose rows are blocks, in ascending
order of (part, seq). A block holds whole documents in ascending doc_id order,
about ``BLOCK_IDS`` ids (one document at least). Its ``payload`` is

    magic "TIB1" | bits u32 | documents u32 | ids u64
    ids of each document, u32 * documents
    packed ids: id k takes bits [k * bits, (k + 1) * bits), least bit first

so that id k of a block is found without reading the ids before it
(``unpack(payload, first, count)``), and all of them are unpacked by a few
vector operations. ``bits`` is the least width that holds every id of the vocabulary.
The row holds, beside the payload, the doc_ids (null allowed) and ``n_ids``; the offset
of a block among all ids is the sum of ``n_ids`` of the blocks before it.

Spark's own writer commits the files, so a lost executor or a task run twice
leaves each block once, and any file system Spark writes to will do.

Documents are dealt by range of (doc_id, hash of the text) before they are
encoded, so rows of one doc_id, or without one, need not share a part; they are
ordered by that hash (XXH64, signed). Encoding: the library's ids of
the text without special tokens added, then ``end_id``. The tokenizer never
joins characters across white space, so each distinct white-space-separated
piece is encoded once per worker by the library and its packed ids are reused
(checked against whole-text encoding in the tests).

Null text: an empty document (only the end id). Null doc_ids come last.
Repeated rows are encoded each. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, ship, text_blocks, worker_cache

END_ID = 2
BLOCK_IDS = 1 << 16
MAX_WORDS = 2_000_000  # encoded pieces kept by a worker
KEPT_BYTES = 64        # longer pieces are encoded anew
MAGIC = b"TIB1"
_HEAD = struct.Struct("<4sIIQ")


# ---- bit packing ------------------------------------------------------------

def width(vocab_size: int) -> int:
    """Least number of bits that holds the ids 0 .. vocab_size - 1."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, least bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for k in range(0, len(ids), 1 << 16):  # a multiple of 8 ids: whole bytes
        rows = np.unpackbits(ids[k:k + (1 << 16)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(rows[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, out of packed bytes."""
    if not count:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        size = bits // 8
        return np.frombuffer(data, f"<u{size}", count, first * size).astype("<u4")
    at = (first + np.arange(count, dtype=np.int64)) * bits
    raw = np.zeros(((first + count) * bits + 7) // 8 - (first * bits) // 8 + 8, np.uint8)
    part = np.frombuffer(data, np.uint8)[(first * bits) // 8:((first + count) * bits + 7) // 8]
    raw[:len(part)] = part
    byte = (at >> 3) - (first * bits) // 8
    value = np.zeros(count, "<u8")
    for k in range(5):  # 32 bits and a shift of up to 7 lie within five bytes
        value |= raw[byte + k].astype("<u8") << np.uint64(8 * k)
    value >>= (at & 7).astype("<u8")
    return (value & np.uint64((1 << bits) - 1)).astype("<u4")


def make_block(documents: list[np.ndarray], bits: int) -> bytes:
    lengths = np.array([len(d) for d in documents], "<u4")
    ids = np.concatenate(documents)
    return _HEAD.pack(MAGIC, bits, len(documents), len(ids)) + lengths.tobytes() + pack(ids, bits)


def block_lengths(payload: bytes) -> np.ndarray:
    """Number of ids of each document of a block."""
    magic, _, documents, _ = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    return np.frombuffer(payload, "<u4", documents, _HEAD.size)


def unpack(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids of a block, from the ``first`` on: random access inside the block."""
    _, bits, documents, n = _HEAD.unpack_from(payload)
    count = n - first if count is None else count
    if not 0 <= first <= first + count <= n:
        raise IndexError("ids outside the block")
    return unpack_bits(memoryview(payload)[_HEAD.size + 4 * documents:], bits, first, count)


# ---- encoding ---------------------------------------------------------------

_PROBES = ("a", "the", "of", "zebra", "qqqq", "internationalization", "thstnd", "x" * 40)


class Encoder(dict):
    """Ids of texts by the tokenizers library: piece -> packed ids, encoded by the
    library when first met and emptied when full."""

    def __init__(self, path: str, end_id: int = END_ID, kept: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.kept = kept
        self.library = Tokenizer.from_file(path)
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        # Letters a-z alone pass the normaliser and the splitter unchanged in tokenizers like
        # these, so the library's model can be asked for them directly. Tried on a few words.
        self.model = self.library.model
        self.direct = all([t.id for t in self.model.tokenize(w)]
                          == self.library.encode(w, add_special_tokens=False).ids for w in _PROBES)

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        if len(piece) > 1 and piece[-1] in b".,;:!?" and piece[-2:-1].isalnum():
            # a letter or digit and a sign that ends the piece are never one token
            found = self[piece[:-1]] + self[piece[-1:]]
        else:
            if self.direct and piece.isalpha() and piece.islower():  # of bytes: ASCII letters only
                ids = [t.id for t in self.model.tokenize(piece.decode())]
            else:
                ids = self.library.encode(piece.decode(), add_special_tokens=False).ids
            found = np.array(ids, self.kind).tobytes()
        if len(piece) <= KEPT_BYTES:
            self[piece] = found
        return found

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """ids (with the end id) of each text."""
        get, out = self.__getitem__, []
        for t in texts:
            t = t or b""
            if b"<|" not in t:  # special tokens are told by case; all else is lower-cased by the tokenizer
                t = t.lower()
            out.append(np.frombuffer(b"".join(map(get, t.split())) + self.end, self.kind))
        return out


_encoders: dict[tuple, Encoder] = worker_cache("packing")


def encoder(*key) -> Encoder:
    """The worker's encoder for (path, end_id, kept)."""
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


# ---- data sets --------------------------------------------------------------

_BLOCK = "part int, seq int, n_ids long, doc_ids array<bigint>, payload binary"


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
              partitions: int | None = None, kept: int = MAX_WORDS) -> None:
    """Encodes every text of ``docs`` with the tokenizer file at ``path`` and writes
    the blocks under ``folder`` in ascending doc_id order. ``kept``: pieces a worker
    keeps encoded (less memory, or fewer calls of the library)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = (src.repartitionByRange(p, *order).sortWithinPartitions(*order)
             .withColumn("part", F.spark_partition_id()))

    def work(batches):
        enc = encoder(path, end_id, kept)
        bits = width(enc.size)
        seq, part, held, ids = 0, None, [], []

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                 pa.array([sum(map(len, held))], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([make_block(held, bits)], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "payload"])

        size = 0
        for batch, texts in text_blocks(batches, keep="packing"):
            part = batch.column("part")[0].as_py()
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                held.append(found)
                ids.append(doc_id)
                size += len(found)
                if size >= block_ids:
                    yield block()
                    seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield block()

    dealt.mapInArrow(work, _BLOCK).write.parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, n_ids, start): the offset of every block among all ids. The window
    over parts has one row per part; the one inside a part, its blocks."""
    blocks = spark.read.schema(_BLOCK).parquet(folder).select("part", "seq", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"))
    return (blocks.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(parts, F.col("part") == F.col("p"))
            .select("part", "seq", "n_ids", (F.col("base") + F.col("inside")).alias("start")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, doc_id, in_block, n_tokens, ids_crc32) per document, from the files."""
    import pyarrow as pa

    ship(spark)

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column("payload")[row].as_py()
                lengths = block_lengths(payload).astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(unpack(payload).tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[row].as_py()] * k, pa.int32()),
                     pa.array([batch.column("seq")[row].as_py()] * k, pa.int32()),
                     pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                     pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "in_block", "n_tokens", "ids_crc32"])

    return (spark.read.schema(_BLOCK).parquet(folder).select("part", "seq", "doc_ids", "payload")
            .mapInArrow(work, "part int, seq int, doc_id long, in_block long, n_tokens long, ids_crc32 long"))


def read_range(spark: SparkSession, folder: str, first: int, count: int) -> list[int]:
    """Random access: ids ``first .. first + count - 1`` of the whole data set; only
    the blocks that hold them are read, and of these only the ids asked for."""
    index = read_index(spark, folder).where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first))
    blocks = spark.read.schema(_BLOCK).parquet(folder).select("part", "seq", "payload")
    out: list[int] = []
    for row in blocks.join(index, ["part", "seq"]).orderBy("start").toLocalIterator():
        a, b = max(first, row.start), min(first + count, row.start + row.n_ids)
        out.extend(unpack(bytes(row.payload), a - row.start, b - a).tolist())
    return out


def written(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None,
            kept: int = MAX_WORDS) -> DataFrame:
    """Writes the ids of ``docs`` and returns (doc_id, start, n_tokens, ids_crc32) per
    document as read back from the files."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    write_ids(docs, folder, path, end_id, kept=kept)
    found, index = read_documents(spark, folder), read_index(spark, folder)
    if index.count() <= 200_000:  # one row per 65,536 ids; beyond that a shuffle join
        index = F.broadcast(index)
    return (found.join(index.select("part", "seq", "start"), ["part", "seq"])
            .select("doc_id", (F.col("start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32"))


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
