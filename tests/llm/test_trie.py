import random
import zlib
from hashlib import sha256

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, d int, size int"


def brute(rows, rebuild=True):
    said = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", sha256((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in said.items()}
    whole = {}
    for c, own in said.items():
        shared = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        whole[c] = tuple(said.get(c - c % 5, [])[:shared] + own[shared:]) if rebuild else tuple(own)
    members, children, ends = {}, {}, {}
    for c, s in whole.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)

    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        below = children.get(s, [])
        leaves[s] = sum(leaves[x] for x in below) or 1
        saved[s] = sum(saved[x] for x in below) + (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
    return ordered((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), leaves[s], saved[s], sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()) for s, m in members.items())


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(-1 if x is None else x for x in r))


def told(rng, conversations, longest, texts):
    rows = []
    for c in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn % 2 else "user", rng.choice(texts), "x", 1, 2))
    return rows


def test_random_conversations_against_brute_force(spark):
    rng = random.Random(1)
    rows = told(rng, 120, 12, ["a", "b", "é" * 40, ""])
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert ordered(trie.judge(frame).collect()) == brute(rows)
    assert ordered(trie.prefix_trie(frame).collect()) == brute(rows, rebuild=False)


def test_long_paths_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 5)
    monkeypatch.setattr(trie, "PIECE", 8)
    rng = random.Random(3)
    rows = told(rng, 25, 40, ["a"]) + [(c, t, "user", f"{t}", None, None, None) for c in (100, 105, 110) for t in range(60)]
    assert ordered(trie.judge(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_odd_rows(spark):
    # nulls in each column, ties of turns, repeated rows, a family without its first conversation, one without turns of its own
    rows = [(0, None, None, None, None, None, None), (0, 1, "user", "x", None, None, None), (0, 1, "user", "x", None, None, None), (0, 1, "user", "w", None, None, None)]
    rows += [(None, 1, "user", "lost", None, None, None), (7, 0, "user", "a" * 5000, None, None, None), (13, 3, None, "b", None, None, None), (1, 0, "user", "z", None, None, None), (2, 0, "user", "z", None, None, None)]
    assert ordered(trie.judge(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    same = [(c, 0, "user", "hello", None, None, None) for c in range(0, 500, 5)]
    assert ordered(trie.judge(spark.createDataFrame(same, SCHEMA)).collect()) == brute(same)


def test_no_conversations_have_no_nodes(spark):
    found = trie.judge(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and found.columns[0] == "conv_id"
