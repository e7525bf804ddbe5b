import zlib
from hashlib import sha256

import pytest
from millrace.llm import merkle
from millrace.llm.checks import crc32

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, hash string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, pos, node):
    others = ""
    for nodes in tree[:-1]:
        first = pos // 16 * 16
        run = nodes[first : first + 16]
        others += "".join(x for i, x in enumerate(run) if first + i != pos)
        node = digest("".join(node if first + i == pos else x for i, x in enumerate(run)))
        pos //= 16
    return others, node


def brute(rows):
    def leaf(row, text):
        doc_id, _, lang, source, n_chars = row[:5]
        return digest("".join(map(field, (doc_id, source, lang, n_chars, text))))

    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((leaf(row, row[1]), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for found in by_source.values():
        found.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = [levels([h for h, _ in by_source[s]]) for s in order]
    top = levels([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for place, s in enumerate(order):
        for pos, (h, row) in enumerate(by_source[s]):
            changed = h
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                changed = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]))
            below, node = climb(trees[place], pos, changed)
            above, node = climb(top, place, node)
            out.append((row[0] if row[0] is not None else -1, h, trees[place][-1][0], root, digest(below + above), node, node == root))
    return sorted(out)


def judged(spark, rows):
    found = merkle.judge(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in found.collect())


def doc(k, text, source="a", lang="en"):
    return (k, text, lang, source, len(text or ""), "clash", 7, "other")


def test_small_trees_against_brute_force(spark):
    # sources of 1, 16 and 17 leaves, more than 16 sources, nulls everywhere, repeated rows and ids, texts that tampering leaves alone
    rows = [doc(k, f"Text {k}", "sixteen") for k in range(16)] + [doc(k, f"no capitals {k}", "seventeen") for k in range(16)] + [doc(99, "Ä" * 3000 + "A", "seventeen")]
    rows += [doc(100 + k, "Upper CASE" if k % 2 else "", f"source {k:02d} é" if k % 3 else f"😀{k}") for k in range(20)]
    rows += [doc(None, "No Id", None), doc(None, None, None, None), doc(3, None, None), doc(3, "Again", None), doc(3, "Again", None), (4, "x", None, "", None, None, None, None)]
    assert judged(spark, rows) == brute(rows)


def test_a_tree_of_several_passes_against_brute_force(spark):
    rows = [doc(k * 7, f"Row {k}", "large") for k in range(4096 + 33)] + [doc(5, "Small", "b")]
    found = judged(spark, rows)
    assert found == brute(rows)
    changed = {k for k, *_ in found if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {r[0] for r in found if not r[-1]} == changed


def test_one_row_and_none(spark):
    rows = [doc(1, "only")]
    assert judged(spark, rows) == brute(rows)
    assert judged(spark, []) == []


def test_stored_levels_and_proofs(spark, tmp_path):
    rows = [doc(k, f"Row {k}", "s" if k % 3 else "t") for k in range(300)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), path=f"file://{tmp_path}/m")
    assert [found.store.level(k).count() for k in range(found.store.height + 1)] == [300, 20, 2]
    assert all(merkle.fold(r["hash"], [s.asDict() for s in r["path"]]) == found.root() for r in merkle.proofs(found).collect())


@pytest.mark.parametrize("k", [0, 7, 12345678901, -3])
def test_crc_in_sql(k):
    import duckdb

    assert duckdb.connect().execute(f"SELECT {crc32('v')} FROM (VALUES ({k})) t(v)").fetchall() == [(zlib.crc32(str(k).encode()),)]
