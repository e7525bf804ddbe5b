import corpus_pipeline
import numpy as np
from millrace.llm import jaccard


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_by_brute_force(rows, least=0.8):
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= least:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {min(r[0] for r, x in zip(rows, label, strict=True) if x == k) for k in label}


def test_stage_links_from_similarity_0_8_on(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, 120))]
        rows.append((len(rows), " ".join(words)))
        for changes in range(1, 5):
            near = list(words)
            for at in rng.integers(0, len(near), changes):
                near[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  b"), (905, "a c"), (906, "word " * 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_brute_force(rows)


def test_crowded_groups_are_dealt_into_buckets(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base, rows = [f"w{x}" for x in rng.integers(0, 5000, 80)], []
    for k in range(120):
        near = list(base)
        for at in rng.integers(0, 80, 1 + k % 7):  # from close copies to texts that link through others or not at all
            near[at] = f"x{rng.integers(0, 5000)}"
        rows.append((k, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = kept_by_brute_force(rows)
    for name, value in (("BUCKET", 7), ("PROBE", 1), ("CROWD", 0), ("SALTS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert 3 < len(expected) < 110 and len(got) == len(set(got)) and set(got) == expected


def test_buckets_hold_every_pair_of_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 6)
    roots = [1] * 40 + [2] * 9 + [3] * 2 + [4] * 5
    rows = [(7, k, r) for k, r in enumerate(roots)] + [(8, 1, 1), (8, 50, 3)] + [(9, 1, 1), (9, 2, 1)]
    got = jaccard._buckets(spark.createDataFrame(rows, "g long, u long, root long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add((r.u, r.root))
    met = {(a[0], b[0]) for part in by.values() for a in part for b in part}
    assert all((i, j) in met for i, a in enumerate(roots) for j, b in enumerate(roots) if a != b)
    assert (1, 50) in met and max(map(len, by.values())) <= 30


def test_search_connects_all_that_links_connect():
    rng = np.random.default_rng(6)
    items = []
    for _ in range(30):
        now = set(rng.integers(0, 400, 60).tolist())
        for _ in range(6):
            now = (now - set(list(now)[:5])) | set(rng.integers(0, 400, 4).tolist())
            items.append(np.array(sorted(now), np.uint64))
    near = {(i, j) for i in range(len(items)) for j in range(i) if jaccard.similarity(items[i], items[j]) >= 0.8}

    def labels(edges):
        label = list(range(len(items)))
        for i, j in edges:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
        return label

    found = jaccard.linked(items, np.arange(len(items)), 0.8)
    assert all((max(e), min(e)) in near for e in found) and len(near) > 50 and labels(found) == labels(near)


def test_empty_table(spark):
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []
