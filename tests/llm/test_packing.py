import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from media_analytics.llm import packing

from .fixtures import documents, empty_documents, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_003).astype("<u4")
    data = packing.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (packing.unpack_bits(data, bits, 0, len(ids)) == ids).all()
    for first, count in ((0, 0), (1, 1), (131, 777), (69_990, 13)):
        assert (packing.unpack_bits(data, bits, first, count) == ids[first:first + count]).all()


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_blocks():
    docs = [np.array(x, "<u4") for x in ([5, 6, 7], [1], [9, 9])]
    block = packing.make_block(docs, 5)
    assert packing.block_lengths(block).tolist() == [3, 1, 2]
    assert packing.unpack(block).tolist() == [5, 6, 7, 1, 9, 9] and packing.unpack(block, 2, 3).tolist() == [7, 1, 9]
    with pytest.raises(IndexError):
        packing.unpack(block, 5, 2)


def text_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def want_rows(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]))):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_dirty_documents(spark):
    df = documents(spark)
    got = sorted(map(tuple, packing.written(df, PATH).collect()), key=lambda r: r[1])
    assert got == want_rows(texts(df))
    assert packing.written(empty_documents(spark), PATH).count() == 0


def test_whole_table_and_random_access(spark, tmp_dir, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = tmp_dir + "/ids"
    packing.write_ids(docs, folder, PATH, block_ids=500, partitions=3)
    rows = texts(docs)
    got = packing.read_documents(spark, folder).join(
        packing.read_index(spark, folder).select("part", "seq", "start"), ["part", "seq"]).selectExpr(
        "doc_id", "start + in_block AS start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert list(map(tuple, got)) == want_rows(rows)
    library = Tokenizer.from_file(PATH)
    every = [x for i, t in sorted(rows) for x in library.encode(t, add_special_tokens=False).ids + [2]]
    for first, count in ((0, 5), (1234, 2000), (len(every) - 3, 3)):
        assert packing.read_range(spark, folder, first, count) == every[first:first + count]


def test_pieces_equal_whole_texts():
    e, library = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for t in ("it's 'tis x. Y, 3.5 ... áb <|endoftext|>. <|ENDOFTEXT|> z", "ΣΑΣ, İ. K; ½! 中。 \x1c\x85", "a.b.c?!", "x" * 5000):
        assert e.encode([t.encode()])[0].tolist() == library.encode(t, add_special_tokens=False).ids + [2]
