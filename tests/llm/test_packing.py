import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.tokens import vocabulary


def test_local_search_empties_bins():
    # best fit needs three bins for these; two are enough
    sizes = np.array([6, 5, 3, 2, 2, 2])
    start = np.array([0, 1, 0, 1, 1, 2])
    out = packing.improve(sizes, start, 10)
    assert len(set(out.tolist())) == 2 and np.bincount(out, weights=sizes).max() <= 10


def test_one_for_one_and_two_for_one():
    for sizes, start in (([6, 3, 5, 4], [0, 0, 1, 1]), ([7, 2, 6, 2, 1, 2], [0, 0, 1, 2, 2, 1])):
        sizes, start = np.array(sizes), np.array(start)
        out = packing.improve(sizes, start, 10)
        square = lambda b: (np.bincount(b, weights=sizes) ** 2).sum()
        assert square(out) >= square(start) and np.bincount(out, weights=sizes).max() <= 10


def test_close_to_the_bound():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 4097, 3000), np.minimum(4096, rng.lognormal(6, 1, 5000).astype(int) + 1), np.full(500, 2049)):
        out = packing.pack(sizes, 4096)
        used = np.bincount(out, weights=sizes)
        assert used.max() <= 4096
        if sizes.min() < 2000:
            assert len(set(out.tolist())) <= 1.02 * sizes.sum() / 4096 + 1
    assert len(packing.pack(np.zeros(0, np.int64), 4096)) == 0


@pytest.mark.parametrize("group", [3, 5000])
def test_documents(spark, group):
    rows = [(1, "a b c"), (2, None), (2, "x"), (2, "x"), (None, "null id"), (3, "w " * 9000), *[(10 + i, "v " * (i * 37 % 900)) for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as uid", "0 as length")
    got = packing.pack_documents(docs, group=group).collect()
    library = Tokenizer.from_file(vocabulary())
    expected = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((str(i), piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    if group == 5000:  # three pieces to a group leave no choice
        assert len(bins) <= 1.05 * sum(x[3] for x in expected) / 4096 + 1
    assert packing.pack_documents(docs.limit(0)).collect() == []
