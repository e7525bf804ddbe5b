import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import wavelet
from millrace.llm.tokens import encoder, vocabulary

ROWS = [(5, "The quick brown fox"), (3, None), (None, "no id"), (9, ""), (7, "Éa don't! ßx <|endoftext|> a　b"), (7, "twice"), (7, "twice"), (1, "word " * 30_000)]


def plain(text, end):
    return [*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_access_rank_select_decode():
    rng = np.random.default_rng(0)
    for ids in (rng.zipf(1.3, 5000) % 49_408, np.zeros(10), np.array([], int), np.array([7])):
        ids = ids.astype(np.uint32)
        doc_ids, lengths, tree = wavelet.read_file(wavelet.write_file([1], [len(ids)], ids))
        assert np.array_equal(tree.decode(), ids) and doc_ids == [1] and list(lengths) == [len(ids)]
        for at in rng.integers(0, len(ids), 100).tolist() if len(ids) else []:
            value = int(ids[at])
            assert tree.access(at) == value
            assert tree.rank(value, at) == np.count_nonzero(ids[:at] == value)
            assert tree.select(value, tree.rank(value, at)) == at
        assert tree.rank(60_000) == 0


def test_damaged_file_raises():
    data = bytearray(wavelet.write_file([1], [3], np.array([1, 2, 3], np.uint32)))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        wavelet.read_file(bytes(data))


def test_access_reads_a_block_of_each_plane():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.2, 400_000) % 49_408).astype(np.uint32)
    data, reads = wavelet.write_file([1], [len(ids)], ids), []

    def read(at, size):
        reads.append(size)
        return data[at : at + size]

    _, _, tree = wavelet.open_file(read)
    for at in (0, 123_456, 399_999):
        for plane in tree.planes:
            plane.held.clear()
        reads.clear()
        assert tree.access(at) == ids[at] and len(reads) <= len(tree.planes)
        assert sum(reads) < 0.2 * len(data)
    assert tree.rank(int(ids[5])) == np.count_nonzero(ids == ids[5])
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    _, _, tree = wavelet.open_file(lambda at, size: bytes(broken[at : at + size]))
    with pytest.raises(ValueError):
        tree.decode()


def test_ids_that_repeat_are_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(7, f"text number {i}") for i in range(400)] + [(k, "x") for k in range(7)], "doc_id long, text string")
    folder, manifest = wavelet.write_shards(docs, shard_tokens=100)
    assert manifest.count() > 8 and manifest.agg({"tokens": "max"}).first()[0] < 120
    got = wavelet.read_shards(spark, folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [*range(7), *[7] * 400]


def test_malformed_text(spark):
    docs = spark.sql("SELECT 1L doc_id, cast(X'6120ff62' AS string) text")
    assert [r.n_tokens for r in wavelet.roundtrip(docs).collect()] == [len(plain("a \ufffdb", 2))]


def test_encoder_equals_the_library():
    own = encoder(vocabulary())
    for text in ["don't I'll WE'RE", "a b c", "x\u0085y", "\x1c\x1d a\x1eb", "İstanbul ΑΣ ﬁ", "a​b", "é ́", "12a3 ...?! é,È;", "<|startoftext|>x", "'the 'tis (so) it' a&&& {_x_}%%% É'' -- _a_ <|a|> \\x ~ß~ `q` 'S x's! y't. <|endoftext|>, (<|endoftext|>)", "MIXED Case, ÉCLAIR! I\u0307 E\u0301 K\u212a ΣΑΣ ſ", "<|ENDOFTEXT|> UP"]:
        assert own.ids(text.encode()) == np.array(Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("shard_tokens", [50, 2_000_000])
def test_roundtrip(spark, shard_tokens):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as n", "2 as shard")
    got = wavelet.roundtrip(docs, shard_tokens=shard_tokens).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(plain(t, 2)), crc(plain(t, 2))) for i, t in ROWS)


def test_empty(spark):
    assert wavelet.roundtrip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
