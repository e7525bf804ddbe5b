import struct
import zlib

import pyarrow as pa

from millrace.llm import packing, tokens


def test_a_worker_keeps_few_words_after_its_task(monkeypatch):
    """The words of a whole task would stay beside what the worker does next."""
    monkeypatch.setattr(tokens, "KEPT", 500)
    monkeypatch.setattr(tokens, "REMEMBERED", 4000)
    tokens.encoder.cache_clear()
    path = tokens.vocabulary()
    rows = [" ".join(["common", *(f"w{k}x{i}" for k in range(50))]) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(rows)], names=["doc_id", "text"])
    once, again = (pa.Table.from_batches(packing._pieces(path, 1, 4096)(iter([batch]))) for _ in range(2))
    found = tokens.encoder(path)
    assert once == again and len(found) <= 500 and not found.older
    plain = found.tokenizer.encode(rows[7], add_special_tokens=False).ids + [1]
    assert once.column("ids_crc32")[7].as_py() == zlib.crc32(struct.pack(f"<{len(plain)}I", *plain))
    tokens.encoder.cache_clear()
