import numpy as np
import xxhash

from millrace.llm import golay
from millrace.llm.components import components


def test_golay_code_is_perfect():
    counts = np.bincount(golay._decoder())
    assert len(counts) == 4096 and set(counts) == {2048}


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    sets = []
    for x in (a, b):
        own = [set() for _ in x]
        for key, row in golay.keys(x):
            for k, r in zip(key.tolist(), row.tolist(), strict=True):
                own[r].add(k)
        sets.append(own)
    assert all(p & q for p, q in zip(*sets, strict=True))


def test_worst_splits_share_a_key():
    rng = np.random.default_rng(2)
    for errors in [(4, 0, 0), (0, 4, 0), (0, 0, 4), (3, 1, 0), (0, 1, 3), (1, 0, 3), (2, 2, 0), (2, 1, 1), (1, 2, 1), (1, 1, 2)]:
        a = rng.integers(0, 2**63, 50, dtype=np.uint64)
        b = a.copy()
        for (at, width), n in zip(golay.CUTS, errors, strict=True):
            for i in range(len(b)):
                for bit in rng.choice(width, n, replace=False):
                    b[i] ^= np.uint64(1 << int(at + bit))
        own = [[set() for _ in a] for _ in range(2)]
        for x, sets in zip((a, b), own, strict=True):
            for key, row in golay.keys(x):
                for k, r in zip(key.tolist(), row.tolist(), strict=True):
                    sets[r].add(k)
        assert all(p & q for p, q in zip(*own, strict=True)), errors


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_judge_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghij"), rng.integers(0, 60))) for _ in range(60)]
    near = [t + " zz" for t in base[:30]]
    rows = [(i, t) for i, t in enumerate(base + near + base[:5])] + [(500, None), (501, ""), (502, "  \t"), (None, "x y"), (503, "X  Y"), (503, "X  Y"), (600, "word " * 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, golay.judge(docs).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
    least = {k: min((r[0] for r, x in zip(rows, label, strict=True) if x == k and r[0] is not None), default=None) for k in label}
    assert got == sorted([(r[0], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, label, strict=True)], key=str)
    kept = golay.dedup(docs.selectExpr("doc_id", "text", "1 as fp", "2 as n")).collect()
    assert len(kept) == len({least[k] if least[k] is not None else ("none", k) for k in label})
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "n"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert golay.judge(docs).collect() == [] and golay.dedup(docs).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long").repartition(7)
    got = {r.u: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_hot_group_is_linked_by_a_forest():
    rng = np.random.default_rng(4)
    prints = np.unique(np.array([12345 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (4000, 2))], np.uint64))
    assert len(golay.linked(prints, 4)) == len(prints) - 1
