"""SQL that says what the operators over trees and tries say."""

from __future__ import annotations


def crc32(value: str) -> str:
    """CRC-32 of the decimal digits of ``value``: a shift register of bits, eight for each digit."""
    bits = f"flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, x: {step}), 4294967295)"


FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in FIELDS) + ")"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TAMPERED = "sha256(" + " || ".join(FIELD.format(LOWER if c == "text" else c) for c in FIELDS) + ")"


def merkle() -> str:
    """The two folds in turn; rows are known by source and place."""
    before, after = "substr(r.run, 1, 64 * (f.at % 16))", "substr(r.run, 64 * (f.at % 16) + 65)"
    return f"""
        WITH RECURSIVE l AS (SELECT doc_id, source, {LEAF} AS leaf, CASE WHEN {crc32("doc_id")} % 5 = 0 THEN {TAMPERED} END AS changed FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        t AS (SELECT source, 0 AS level, pos, leaf AS h, n FROM p UNION ALL SELECT source, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, level, n, pos // 16),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, place AS pos, subroot AS h, (SELECT count(*) FROM s) AS n FROM s UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, n, pos // 16),
        tr AS (SELECT source AS tree, level, pos // 16 AS pos, string_agg(h, '' ORDER BY t.pos) AS run FROM t WHERE n > 1 GROUP BY source, level, t.pos // 16),
        ur AS (SELECT level, u.pos // 16 AS pos, string_agg(h, '' ORDER BY u.pos) AS run FROM u WHERE n > 1 GROUP BY level, u.pos // 16),
        f AS (SELECT source, pos, 0 AS level, pos AS at, coalesce(changed, leaf) AS h, '' AS proof FROM p UNION ALL
            SELECT f.source, f.pos, f.level + 1, f.at // 16, sha256({before} || f.h || {after}), f.proof || {before} || {after}
            FROM f JOIN tr r ON r.tree IS NOT DISTINCT FROM f.source AND r.level = f.level AND r.pos = f.at // 16),
        k AS (SELECT source, pos, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM f GROUP BY ALL),
        g AS (SELECT k.source, k.pos, 0 AS level, place AS at, h, proof FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source UNION ALL
            SELECT f.source, f.pos, f.level + 1, f.at // 16, sha256({before} || f.h || {after}), f.proof || {before} || {after}
            FROM g f JOIN ur r ON r.level = f.level AND r.pos = f.at // 16),
        z AS (SELECT source, pos, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM g GROUP BY ALL)
        SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(z.proof) AS proof_sha256, z.folded_root, z.folded_root = (SELECT h FROM u WHERE n = 1) AS verified
        FROM p JOIN z ON z.source IS NOT DISTINCT FROM p.source AND z.pos = p.pos JOIN s ON s.source IS NOT DISTINCT FROM p.source"""


def trie() -> str:
    """Nodes as lists of turns; subtrees by comparing the beginnings of lists."""
    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS said FROM t GROUP BY conv_id),
        r AS (SELECT o.conv_id, list_concat(coalesce(b.said[1:{crc32("o.conv_id")} % 9], []), coalesce(o.said[{crc32("o.conv_id")} % 9 + 1:], [])) AS said FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
        m AS (SELECT conv_id, len(said) AS whole, unnest(range(0, len(said) + 1)) AS depth, said FROM r),
        n AS (SELECT depth, said[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '') AS ends FROM m GROUP BY ALL),
        c AS (SELECT n.depth, n.path, count(k.depth) AS n_children, any_value(k.depth) AS below FROM n LEFT JOIN n k ON k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path GROUP BY ALL),
        s AS (SELECT n.depth, n.path, sum((x.n_convs - 1) * CASE WHEN x.depth = 0 THEN 0 ELSE strlen(x.path[x.depth].text) END) AS saved_tokens, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves
              FROM n JOIN n x ON x.depth >= n.depth AND x.path[1:n.depth] = n.path JOIN c y ON y.depth = x.depth AND y.path = x.path GROUP BY ALL)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN c USING (depth, path) JOIN s USING (depth, path) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]"""
