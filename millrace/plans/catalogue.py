"""The registered queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import catalogs, geometry, text
from ..functions.lazy import bound
from ..operators import audio, export, history, image, pages, recognition, selection
from ..sources import archive, classify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: (query, SQL) over files that are made up: tests run them, nothing registers them.
EXAMPLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def example(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        EXAMPLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _single(n: int) -> Column:
    """A whole number whose sums and products with single-precision values stay single; with a plain one they turn double."""
    return F.lit(n).cast("float")


def values(rows: list[tuple]) -> str:
    """SQL VALUES of Python rows."""

    def literal(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


# A beginning for each rule but those of ZIP packages, and at the borders: name, bytes in hex.
SIGNATURES = [
    ("empty.bin", ""), ("a.pdf", "255044462d312e34"), ("b.rtf", "7b5c72746631"), ("c.zip", "504b0304"), ("d.zip", "504b0506"), ("e.zip", "504b0708"),
    ("f.png", "89504e470d0a1a0a"), ("g.jpg", "ffd8ffe0"), ("h.gif", "474946383761"), ("i.gif", "474946383961"), ("j.bmp", "424d3a00"), ("k.tif", "49492a00"), ("l.tif", "4d4d002a"),
    ("m.webp", "524946460000000057454250"), ("n.heic", "000000186674797068656963"), ("o.heic", "000000186674797048454958"), ("p.m4a", "00000018667479706d346120"), ("q.m4a", "00000018667479704d344120"),
    ("r.mov", "000000146674797071742020"), ("s.mp4", "000000186674797069736f6d"), ("t.wav", "524946460000000057415645"), ("u.aiff", "464f524d0000000041494646"), ("v.flac", "664c6143"), ("w.ogg", "4f676753"),
    ("x.mp3", "49443303"), ("y.mp3", "fffb9000"), ("z.txt", "fffe68006900"), ("aa.txt", "feff00680069"), ("ab.webm", "1a45dfa3"), ("ac.avi", "524946460000000041564920"), ("ad.wmv", "3026b2758e66cf11"),
    ("ae.doc", "d0cf11e0a1b11ae1"), ("af.txt", "68656c6c6f"), ("ag.CSV", "612c620a312c32"), ("letter.docx", "071b009c"), ("ah.txt", "424d207465787420"), ("ai", "efbbbf636166c3a9"), ("aj.riff", "5249464600000000"),
    ("ak.txt", "61" * 19 + "01"), ("al.txt", "61" * 18 + "0101"),
]

_CLASSIFY_SQL = f"""
    WITH s(k, name, begins) AS (VALUES {values([(k, *x) for k, x in enumerate(SIGNATURES)])}),
    b AS (SELECT doc_id, name, begins || CASE WHEN begins = '' THEN '' ELSE lower(hex(encode(coalesce(text[1:2048], '')))) END AS h FROM documents JOIN s ON k = doc_id % {len(SIGNATURES)}),
    d AS (SELECT *, CASE WHEN h LIKE 'efbbbf%' OR h LIKE 'fffe%' OR h LIKE 'feff%' THEN true
        ELSE len(list_filter(regexp_extract_all(h[1:4096], '..'), lambda x: (x < '20' AND x NOT IN ('09', '0a', '0d')) OR x = '7f')) * 20 <= length(h[1:4096]) / 2 END AS is_text FROM b),
    r AS (SELECT doc_id, CASE
        WHEN h = '' THEN 'unsupported/empty/1'
        WHEN h LIKE '255044462d%' THEN 'document/pdf/0.99' WHEN h LIKE '7b5c727466%' THEN 'document/rtf/0.99'
        WHEN h LIKE '504b0304%' OR h LIKE '504b0506%' OR h LIKE '504b0708%' THEN 'unsupported/zip/0.5'
        WHEN h LIKE '89504e470d0a1a0a%' THEN 'image/png/0.99' WHEN h LIKE 'ffd8ff%' THEN 'image/jpeg/0.99'
        WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'image/gif/0.98' WHEN h LIKE '424d%' THEN 'image/bmp/0.98'
        WHEN h LIKE '49492a00%' OR h LIKE '4d4d002a%' THEN 'image/tiff/0.98'
        WHEN h LIKE '52494646________57454250%' THEN 'image/webp/0.99'
        WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('68656963', '48454943', '68656978', '48454958', '68656966', '6d696631', '68657663') THEN 'image/heic/0.6'
        WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('6d346120', '6d346220', '6d703461') THEN 'audio/m4a/0.9'
        WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) = '71742020' THEN 'video/mov/0.9' WHEN substr(h, 9, 8) = '66747970' THEN 'video/mp4/0.9'
        WHEN h LIKE '52494646________57415645%' THEN 'audio/wav/0.99' WHEN h LIKE '464f524d________41494646%' THEN 'audio/aiff/0.99'
        WHEN h LIKE '664c6143%' THEN 'audio/flac/0.99' WHEN h LIKE '4f676753%' THEN 'audio/ogg/0.9' WHEN h LIKE '494433%' THEN 'audio/mp3/0.99'
        WHEN regexp_matches(h, '^ff[ef]') AND h NOT LIKE 'fffe%' THEN 'audio/mp3/0.9'
        WHEN h LIKE '1a45dfa3%' THEN 'video/webm/0.9' WHEN h LIKE '52494646________41564920%' THEN 'unsupported/avi/0.9'
        WHEN h LIKE '3026b2758e66cf11%' THEN 'unsupported/wmv/0.9' WHEN h LIKE 'd0cf11e0a1b11ae1%' THEN 'document/ole/0.9'
        WHEN is_text AND lower(split_part(name, '.', -1)) = 'csv' THEN 'document/csv/0.8' WHEN is_text THEN 'text/text/0.8'
        ELSE 'unknown/unknown/0.2' END AS k FROM d)
    SELECT doc_id, split_part(k, '/', 1) AS category, split_part(k, '/', 2) AS format, CAST(split_part(k, '/', 3) AS DOUBLE) AS confidence FROM r"""


def dealt(spark: SparkSession, rows: DataFrame, key: str, cases: list[tuple], names: str) -> DataFrame:
    """``rows`` with one of the cases each, in turn of their keys."""
    numbered = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], f"_case int, {names}")
    return rows.withColumn("_case", (F.col(key) % len(cases)).cast("int")).join(F.broadcast(numbered), "_case").drop("_case")


@query(_CLASSIFY_SQL)
def classify_signatures(spark, sf_dir):
    """Documents behind the beginnings of files of all kinds; the one of no bytes stays alone."""
    rows = dealt(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", SIGNATURES, "name string, h string")
    body = F.when(F.col("h") == "", F.lit(b"")).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = rows.withColumn("content", F.concat(F.unhex("h"), body))
    return classify.classified(rows).select("doc_id", "detected.category", "detected.format", "detected.confidence")


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as text files."""
    return docs.select("doc_id", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))


@query("""
    WITH b AS (SELECT lang, encode(text) AS c, lower(hex(encode(text)[1:12])) AS h, regexp_replace(text[1:2048], '[^\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}]', '', 'g') AS ctl FROM documents)
    SELECT lang, CASE WHEN octet_length(c) = 0 THEN 'unsupported' WHEN h LIKE '424d%' THEN 'image' WHEN h LIKE '494433%' OR h LIKE '4f676753%' THEN 'audio'
        WHEN length(ctl) * 20 <= least(octet_length(c), 2048) THEN 'text' ELSE 'unknown' END AS category,
        CASE WHEN octet_length(c) = 0 THEN 'empty' WHEN h LIKE '424d%' THEN 'bmp' WHEN h LIKE '494433%' THEN 'mp3' WHEN h LIKE '4f676753%' THEN 'ogg'
        WHEN length(ctl) * 20 <= least(octet_length(c), 2048) THEN 'text' ELSE 'unknown' END AS format, count(*) AS n
    FROM b GROUP BY ALL""")
def classify_documents(spark, sf_dir):
    found = classify.classified(as_files(table(spark, sf_dir, "documents")).select("lang", "name", "content"))
    return found.groupBy("lang", F.col("detected.category").alias("category"), F.col("detected.format").alias("format")).agg(F.count("*").alias("n"))


@query("""
    WITH b AS (SELECT doc_id, encode(text) AS c, regexp_extract_all(hex(encode(text)[1:2048]), '..') AS p FROM documents)
    SELECT doc_id, octet_length(c) AS n_bytes, octet_length(c) > 0 AND len(list_filter(p, lambda x: (x < '20' AND x NOT IN ('09', '0A', '0D')) OR x = '7F')) * 20 <= len(p) AS is_text FROM b""")
def sniff_stats(spark, sf_dir):
    return as_files(table(spark, sf_dir, "documents")).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), classify.sniff_text(F.col("content")).alias("is_text"))


@query("SELECT doc_id, length('```text\n' || text || '\n```') AS md_len, md5('```text\n' || text || '\n```') AS md_md5 FROM documents")
def text_fence(spark, sf_dir):
    md = text.fence(text.decode_text(F.col("content")))
    return as_files(table(spark, sf_dir, "documents")).select("doc_id", F.length(md).cast("long").alias("md_len"), F.md5(md).alias("md_md5"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN 'error' ELSE 'ok' END AS status, CASE WHEN octet_length(encode(text)) > 4096 THEN 'too-large' END AS code FROM documents")
def size_guard(spark, sf_dir):
    from ..sources.files import too_large, within_limit

    files = as_files(table(spark, sf_dir, "documents")).withColumn("length", F.octet_length("content")).withColumn("path", F.col("doc_id").cast("string"))
    good = within_limit(files, 4096).select("doc_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("code"))
    return good.unionByName(too_large(files, 4096).select(F.col("path").cast("long").alias("doc_id"), F.lit("error").alias("status"), F.col("error.code").alias("code")))


SIZES = [(0,), (1023,), (1024,), (1587,), (1048575,), (1048576,), (5767168,), (1073741823,), (1073741824,), (3221225472,), (1342177280,)]


@query(f"""
    WITH s(n) AS (VALUES {values(SIZES)}), x AS (SELECT n FROM s UNION ALL SELECT n_chars FROM documents),
    y AS (SELECT n, CASE WHEN n < 1048576 THEN (n * 20 + 1024) // 2048 WHEN n < 1073741824 THEN (n * 20 + 1048576) // 2097152 ELSE (n * 200 + 1073741824) // 2147483648 END AS v FROM x)
    SELECT n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (v // 10) || '.' || (v % 10) || ' KB' WHEN n < 1073741824 THEN (v // 10) || '.' || (v % 10) || ' MB'
        WHEN n IS NOT NULL THEN (v // 100) || '.' || lpad(CAST(v % 100 AS VARCHAR), 2, '0') || ' GB' END AS label FROM y""")
def format_bytes(spark, sf_dir):
    rows = spark.createDataFrame(SIZES, "n long").unionByName(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("n")))
    return rows.select("n", text.format_bytes(F.col("n")).alias("label"))


SPACE = _SPACE = text.SPACE


def _raw_sql(column: str) -> str:
    """Images, links, headings, bold, italics, code, quotes, bullets, numbers and empty lines, in this order."""
    steps = [("!\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("(?m)^#{1,6}\\s+", ""), ("\\*\\*([^*]+)\\*\\*", "\\1"), ("\\*([^*]+)\\*", "\\1"), ("`([^`]+)`", "\\1"), ("(?m)^>\\s?", ""), ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*\\d+\\.\\s+", ""), ("\\n{3,}", "\n\n")]
    out = column
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({out}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


MARKDOWN = [(-1, "# Title\n\nSome **bold** and *it* with `code`\n> quote\n- item\n  * item\n12. first\n\n\n\n![alt](u) [link](v) **[x](y)**"), (-2, "  plain  "), (-3, "####### seven\n#no"), (-4, "a*b*c**d**e`")]


@query(f"WITH x AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {values(MARKDOWN)})), y AS (SELECT doc_id, {_raw_sql('text')} AS r FROM x) SELECT doc_id, md5(r) AS raw_md5, length(r) AS raw_len FROM y")
def raw_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(MARKDOWN, "doc_id long, text string"))
    raw = text.raw_text(F.col("text"))
    return rows.select("doc_id", F.md5(raw).alias("raw_md5"), F.length(raw).cast("long").alias("raw_len"))


DIRECTIONS = [(-1, "سلام"), (-2, "hello"), (-3, "mixed اردو text"), (-4, ""), (-5, "ﷺ")]


@query(f"WITH x AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {values(DIRECTIONS)})) SELECT id, CASE WHEN regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}\\x{{8A0}}-\\x{{8FF}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]') THEN 'rtl' ELSE 'ltr' END AS dir FROM x")
def text_dir(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame(DIRECTIONS, "id long, text string"))
    return rows.select("id", text.text_dir(F.col("text")).alias("dir"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS esc_md5 FROM pages")
def esc_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.esc(F.col("html"))).alias("esc_md5"))


NAMES = [(-1, "report.pdf"), (-2, "..hidden.txt"), (-3, "a/b\\c:d*e?.docx"), (-4, ""), (-5, "   "), (-6, "no extension"), (-7, ".env"), (-8, "été.tar.gz"), (-9, "x" * 300 + ".pdf"), (-10, "a__b<>c.md")]
_ENTRY = f"""regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[\\x{{00}}-\\x{{1f}}\\x{{7f}}/\\\\<>:"|?*]', '_', 'g'), '_{{2,}}', '_', 'g'), '^\\.+', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, 240), '(?s)^(.+)\\.[^.]*$', '\\1')"""


@query(f"WITH x(id, name) AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {values(NAMES)})), y AS (SELECT id, {_ENTRY} AS stem FROM x) SELECT id, CASE WHEN stem = '' THEN 'converted' ELSE stem END || '.md' AS entry FROM y")
def zip_entry_name(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name")).unionByName(spark.createDataFrame(NAMES, "id long, name string"))
    return rows.select("id", text.zip_entry_name(F.col("name")).alias("entry"))


@query("WITH x AS (SELECT doc_id, source || '.md' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.md$', '') || ' (' || k || ').md' END AS entry FROM x")
def unique_zip_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".md")).alias("name"))
    return export.unique_names(rows, "name", "doc_id").select("doc_id", "entry")


@query(f"""
    SELECT conv_id, md5(coalesce(string_agg(CASE WHEN role <> 'system' THEN '## ' || role || turn || chr(10) || chr(10) || chr(10) || chr(10) || regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') END, chr(10) || chr(10) ORDER BY turn) || chr(10), '')) AS md_md5
    FROM conversations GROUP BY conv_id""")
def combined_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    md = export.combined_markdown(F.col("turn"), F.concat("role", F.col("turn").cast("string")), F.col("text"), F.when(F.col("role") != "system", "ok").otherwise("error"))
    return c.groupBy("conv_id").agg(F.md5(md).alias("md_md5"))


def marked(spark, sf_dir) -> DataFrame:
    """Conversations as documents of pages: even turns in the text layer, odd ones recognized."""
    c = table(spark, sf_dir, "conversations").withColumn("page", (F.col("turn") + 1).cast("int"))
    part = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<!-- Page "), F.col("page").cast("string"), F.lit(" -->\n"), "text", F.lit("\n")))
    layer = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("turn", part.alias("t"))))), lambda x: x["t"]), "")
    return c.groupBy("conv_id").agg(layer.alias("markdown"), F.max("page").alias("page_count"))


@query(f"SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, md5(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS section_md5 FROM conversations WHERE turn % 2 = 0")
def page_sections(spark, sf_dir):
    return pages.page_sections(marked(spark, sf_dir), "conv_id", "markdown").select("conv_id", "page", F.md5(text.trim(F.col("text"))).alias("section_md5"))


@query(f"""
    WITH n AS (SELECT conv_id, max(turn) + 1 AS n, min(turn % 2) AS bare FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, bare, unnest(generate_series(1, n)) AS p FROM n),
    t AS (SELECT conv_id, turn, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM conversations),
    j AS (SELECT s.conv_id, p, bare, nullif(a.x, '') AS sec, nullif(b.x, '') AS ocr FROM s LEFT JOIN t a ON a.conv_id = s.conv_id AND a.turn = p - 1 AND a.turn % 2 = 0 LEFT JOIN t b ON b.conv_id = s.conv_id AND b.turn = p - 1 AND b.turn % 2 = 1),
    o AS (SELECT conv_id, p, CASE WHEN bare = 1 AND p = 1 THEN coalesce(chr(10) || chr(10) || chr(10) || chr(10) || '<!-- OCR page 1 -->' || chr(10) || chr(10) || ocr, '')
        ELSE '<!-- Page ' || p || ' -->' || coalesce(chr(10) || chr(10) || sec, '') || coalesce(chr(10) || chr(10) || chr(10) || chr(10) || '<!-- OCR -->' || chr(10) || chr(10) || ocr, '') END AS x FROM j)
    SELECT conv_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY p)) AS md_md5 FROM o GROUP BY conv_id""")
def merge_pages(spark, sf_dir):
    ocr = table(spark, sf_dir, "conversations").where("turn % 2 = 1").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")
    return pages.merge_pages(marked(spark, sf_dir), ocr, "conv_id").select("conv_id", F.md5("merged").alias("md_md5"))


def overlapping(spark, sf_dir) -> DataFrame:
    """Turns with the last four words of the turn before put in front."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    tail = bound(text.words(F.col("prev")), lambda ws: F.array_join(F.slice(ws, F.greatest(F.size(ws) - 3, F.lit(1)), 4), " "))
    return c.withColumn("prev", before).withColumn("part", F.when(F.col("prev").isNull(), F.col("text")).otherwise(F.concat_ws(" ", tail, "text")))


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{_SPACE}+'), lambda x: x <> '')"


_OVERLAP = f"""
    WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    w AS (SELECT *, {_words("prev")} AS a, {_words("prev")}[-4:] AS tail FROM c),
    p AS (SELECT conv_id, turn, text, prev, a, CASE WHEN prev IS NULL THEN text ELSE array_to_string(tail, ' ') || ' ' || text END AS part FROM w),
    q AS (SELECT *, {_words("part")} AS b FROM p)"""


_K = "coalesce(list_max(list_filter(range(2, least(len(a), len(b), 12) + 1), lambda k: lower(array_to_string(a[len(a) - k + 1:], ' ')) = lower(array_to_string(b[:k], ' ')))), 0)"
_STITCH = "CASE WHEN len(a) = 0 THEN array_to_string(b, ' ') WHEN len(b) = 0 THEN array_to_string(a, ' ') ELSE array_to_string(a, ' ') || ' ' || coalesce(array_to_string(b[k + 1:], ' '), '') END"


@query(f"{_OVERLAP}, k AS (SELECT *, {_K} AS k FROM q WHERE prev IS NOT NULL) SELECT conv_id, turn, md5({_STITCH}) AS stitched_md5 FROM k")
def stitch_pairs(spark, sf_dir):
    rows = overlapping(spark, sf_dir).where("prev IS NOT NULL")
    return rows.select("conv_id", "turn", F.md5(audio.stitch(F.col("prev"), F.col("part"))).alias("stitched_md5"))


@query(f"""{_OVERLAP.replace("WITH c", "WITH RECURSIVE c", 1)},
    n AS (SELECT conv_id, part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM q WHERE len(b) > 0),
    r AS (SELECT conv_id, i, part AS s FROM n WHERE i = 1
        UNION ALL SELECT conv_id, i, {_STITCH} FROM (SELECT *, {_K} AS k FROM (SELECT r.conv_id, n.i, {_words("r.s")} AS a, {_words("n.part")} AS b FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)))
    SELECT conv_id, md5(arg_max(s, i)) AS out_md5 FROM r GROUP BY conv_id""")
def stitch_fold(spark, sf_dir):
    return audio.transcripts(overlapping(spark, sf_dir), "conv_id", "turn", "part").select("conv_id", F.md5("text").alias("out_md5"))


@query("""
    WITH s AS (SELECT doc_id, greatest(1, n_chars * 997 + doc_id % 3) AS n FROM documents), k AS (SELECT doc_id, n, unnest(generate_series(0, CASE WHEN n <= 480000 THEN 0 ELSE CAST(ceil((n - 480000) / 448000.0) AS BIGINT) END)) AS i FROM s)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, i * 448000 AS "start", least(i * 448000 + 480000, n) AS "end" FROM k""")
def chunk_bounds(spark, sf_dir):
    """Documents as recordings of some thousand samples a character."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.col("n_chars") * 997 + F.col("doc_id") % 3).alias("n"))
    return rows.select("doc_id", F.explode(geometry.chunk_bounds(F.col("n"))).alias("c")).select("doc_id", "c.chunk_no", "c.start", "c.end")


@query("""
    WITH e AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS v, coalesce(lead(value) OVER w, value) AS nxt, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    o AS (SELECT user_id, unnest(generate_series(0, greatest(1, CAST(floor(n / 2.5 + 0.5) AS BIGINT)) - 1)) AS j FROM (SELECT DISTINCT user_id, n FROM e))
    SELECT o.user_id, o.j, CAST(CAST(v + (nxt - v) * (CAST(j AS DOUBLE) * 2.5 - floor(CAST(j AS DOUBLE) * 2.5)) AS FLOAT) AS DOUBLE) AS v FROM o JOIN e ON e.user_id = o.user_id AND e.i = least(CAST(floor(j * 2.5) AS BIGINT), n - 1)""")
def resample_linear(spark, sf_dir):
    """Each user's values as samples at 40 kHz, brought to 16 kHz."""
    from ..sources.audio import resample

    def run(batches):
        import numpy as np

        for pdf in batches:
            yield pdf.assign(v=[resample(np.asarray(v, float), 40_000) for v in pdf["v"]])

    values = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return values.mapInPandas(run, "user_id long, v array<float>").select("user_id", F.posexplode("v").alias("j", "v")).select("user_id", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def history_latest(spark, sf_dir):
    return history.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def history_delete(spark, sf_dir):
    return history.delete(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the')")
def history_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(history.matches("  The ", F.col("text"), F.col("source"))).select("doc_id")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rn FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200")
def history_top200(spark, sf_dir):
    return history.ranked(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 200, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "rn")


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE lang = 'en') GROUP BY source")
def history_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang")
    return history.combined(d, d.where("lang = 'en'")).groupBy("source").agg(F.count("*").alias("n"))


def part_lines(spark, sf_dir) -> DataFrame:
    """Labels as recognized parts: five documents a line, ten lines a page."""
    return table(spark, sf_dir, "labels").select((F.col("doc_id") / 50).cast("long").alias("page"), (F.col("doc_id") / 5).cast("long").alias("line"), ((F.col("quality") + 2 * F.col("toxic")) / 3.0).alias("confidence"))


@query("WITH l AS (SELECT doc_id // 50 AS page, avg((quality + 2 * toxic) / 3.0) AS c FROM labels GROUP BY doc_id // 50, doc_id // 5) SELECT page, round(avg(c), 9) AS mean_confidence FROM l GROUP BY page")
def mean_confidence(spark, sf_dir):
    lines = part_lines(spark, sf_dir).groupBy("page", "line").agg(F.avg("confidence").alias("c"))
    return lines.groupBy("page").agg(F.round(F.avg("c"), 9).alias("mean_confidence"))


@query("""
    WITH p AS (SELECT lang, d.doc_id // 10 AS page, avg(CASE WHEN text <> '' THEN (quality + toxic) / 2.0 END) AS m, count(CASE WHEN text <> '' THEN 1 END) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)
    SELECT lang, count(*) AS pages, count(CASE WHEN n = 0 OR coalesce(m, 0) < 0.5 THEN 1 END) AS weak_n FROM p GROUP BY lang""")
def ocr_quality_gate(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("doc_id") / 10).cast("long").alias("page"), "text", ((F.col("quality") + F.col("toxic")) / 2.0).alias("confidence"))
    return recognition.quality(lines, "lang", "page").groupBy("lang").agg(F.count("*").alias("pages"), F.count_if("weak").alias("weak_n"))


_LETTERS = "SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents"


@query(f"""
    WITH v AS (SELECT doc_id, least(unicode(ch), 255) AS v FROM ({_LETTERS}) WHERE ch <> ''), b AS (SELECT doc_id, v, count(*) AS c FROM v GROUP BY ALL),
    x AS (SELECT doc_id, v, sum(c) OVER w AS wb, sum(CAST(v AS DOUBLE) * c) OVER w AS sb, sum(c) OVER (PARTITION BY doc_id) AS n, sum(CAST(v AS DOUBLE) * c) OVER (PARTITION BY doc_id) AS s, lead(v) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY v)),
    y AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN CAST(wb AS DOUBLE) * (n - wb) * pow(sb / wb - (s - sb) / (n - wb), 2) END AS bt FROM x)
    SELECT doc_id, CAST(coalesce(arg_max(nxt - 1, (bt, v)) FILTER (bt IS NOT NULL), 128) AS INTEGER) AS threshold FROM y GROUP BY doc_id""")
def histogram_otsu(spark, sf_dir):
    """Texts as rows of pixels: their code points, 255 at most."""
    from .media import gray_letters

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInPandas(lambda b: gray_letters(b, lambda img: (image.otsu(img),), ["threshold"]), "doc_id long, threshold int")


@query(f"""
    WITH v AS (SELECT doc_id, least(unicode(ch), 255) AS v FROM ({_LETTERS}) WHERE ch <> ''), m AS (SELECT doc_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY doc_id)
    SELECT doc_id, lo, hi, CAST(sum(CASE WHEN hi - lo < 40 THEN v ELSE floor((v - lo) * (CAST(255 AS DOUBLE) / (hi - lo)) + 0.5) END) AS BIGINT) AS total FROM v JOIN m USING (doc_id) GROUP BY doc_id, lo, hi""")
def contrast_minmax(spark, sf_dir):
    """The same pixels, stretched: their sum."""
    from .media import gray_letters

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInPandas(lambda b: gray_letters(b, lambda img: (int(img.min()), int(img.max()), int(image.stretch(img).sum(dtype="int64"))), ["lo", "hi", "total"]), "doc_id long, lo int, hi int, total long")


_GAPS = "SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events"


def event_gaps(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (at - F.lag(at).over(w)).alias("g"))


@query(f"SELECT user_id, list_sort(list(g))[count(g) // 2 + 1] AS med FROM ({_GAPS}) WHERE g IS NOT NULL GROUP BY user_id")
def upper_median_gap(spark, sf_dir):
    return selection.upper_median(event_gaps(spark, sf_dir), "user_id", "g", "med")


@query(f"""
    WITH g AS ({_GAPS}), m AS (SELECT user_id, greatest(8000000, 2.5 * list_sort(list(g) FILTER (g IS NOT NULL))[count(g) // 2 + 1]) AS lim FROM g GROUP BY user_id HAVING count(g) > 0),
    s AS (SELECT g.user_id, sum(CASE WHEN g.g > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY ts, event_id) AS k FROM g JOIN m ON m.user_id = g.user_id)
    SELECT user_id, CAST(k AS BIGINT) AS session_no, count(*) AS n FROM s GROUP BY ALL""")
def gap_sessions(spark, sf_dir):
    """Events cut at gaps of over 2.5 times the middle gap, as words are cut from a line."""
    g = event_gaps(spark, sf_dir)
    limit = selection.upper_median(g, "user_id", "g").select("user_id", F.greatest(F.lit(8_000_000.0), 2.5 * F.col("median")).alias("lim"))
    k = F.sum(F.when(F.col("g") > F.col("lim"), 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return g.join(limit, "user_id").select("user_id", k.alias("session_no")).groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 3600 SECOND AS times_out, count(*) AS n FROM s GROUP BY user_id, k""")
def job_timeouts(spark, sf_dir):
    from ..streaming.jobs import active_spans

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return active_spans(events, "user_id", "ts", 3600).withColumns({"started": F.col("started").cast("timestamp_ntz"), "times_out": F.col("times_out").cast("timestamp_ntz")})


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    from ..streaming.jobs import latest_progress as latest

    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "ts")
    return latest(e, "user_id", "at").select("user_id", "event_type", "ts")


@query("""
    WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, string_agg(event_type[1:2], '' ORDER BY ts, event_id) AS decoded FROM e WHERE event_type <> (SELECT min(event_type) FROM events) AND (p IS NULL OR p <> event_type) GROUP BY user_id""")
def ctc_collapse(spark, sf_dir):
    """Each user's event types as the classes of a recognizer's steps, the first type as the blank."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]

    def run(batches):
        import numpy as np

        number = {t: k for k, t in enumerate(types)}
        for pdf in batches:
            yield pdf.assign(decoded=[image.ctc(9.0 * np.eye(len(types))[[number[t] for t in steps]], [t[:2] for t in types[1:]])[0] for steps in pdf["steps"]])[["user_id", "decoded"]]

    steps = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("steps"))
    return steps.mapInPandas(run, "user_id long, decoded string").where("decoded <> ''")


SETTINGS = [(1, "auto", "whisper-tiny", "loading onnx-community/whisper-tiny now"), (2, "hi", "moonshine-base", "PP-OCRv3 Devanagari recognition"), (3, "ur", "whisper-base", None), (4, "xx", "moonshine-tiny", "nothing known"), (5, "en", "whisper-huge", "PP-OCRv3 mobile detection and PP-OCRv5 English recognition")]


# what the catalogs say, written out: language keys, models and their sizes
_LANGUAGE_SQL = "(VALUES ('auto', 'Auto (English)', 'en'), ('en', 'English', 'en'), ('hi', 'Hindi', 'hi'), ('ur', 'Urdu', 'ur')) l(k, label, ocr)"
_SPEECH_SQL = "(VALUES ('moonshine', 'tiny', 'onnx-community/moonshine-tiny-ONNX', 28127173), ('moonshine', 'base', 'onnx-community/moonshine-base-ONNX', 62916062), ('whisper', 'tiny', 'onnx-community/whisper-tiny', 40886921), ('whisper', 'base', 'onnx-community/whisper-base', 76894612)) m(f, t, mid, b)"
_READER_SQL = "(VALUES ('en', 'PP-OCRv5 English recognition', 7830888), ('hi', 'PP-OCRv3 Devanagari recognition', 8980224), ('ur', 'PP-OCRv3 Arabic/Urdu recognition', 8978664)) r(k, nm, b)"


@query(f"""
    WITH s(id, lang, model, detail) AS (VALUES {values(SETTINGS)}),
    z AS (SELECT 0 AS o, 'PP-OCRv3 mobile detection' AS nm, 2429873 AS b UNION ALL SELECT row_number() OVER (ORDER BY k), nm, b FROM {_READER_SQL} UNION ALL SELECT 3 + row_number() OVER (ORDER BY f, t DESC), mid, b FROM {_SPEECH_SQL})
    SELECT doc_id, coalesce(label, 'English') AS lang_label, coalesce(ocr, 'en') AS ocr_key, mid AS model_id, 2429873 + coalesce(r.b, 0) AS ocr_bytes,
        (SELECT CASE WHEN count(*) > 0 THEN CAST(greatest(1, floor(arg_min(z.b, z.o) / 1048576.0 + 0.5)) AS BIGINT) || ' MB' END FROM z WHERE contains(s.detail, z.nm)) AS size_label
    FROM documents d JOIN s ON s.id = d.doc_id % 5 + 1 LEFT JOIN {_LANGUAGE_SQL} ON l.k = s.lang LEFT JOIN {_SPEECH_SQL} ON m.f = split_part(s.model, '-', 1) AND m.t = split_part(s.model, '-', 2) LEFT JOIN {_READER_SQL} ON r.k = coalesce(ocr, 'en')""")
def catalog_lookup(spark, sf_dir):
    """Documents with settings dealt to them in turn: languages, models and sizes by the catalogs."""
    rows = dealt(spark, table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SETTINGS, "id int, lang string, model string, detail string")
    rows = rows.withColumn("m", text.parse_model(F.col("model"))).select("*", "m.family", "m.tier")
    rows = catalogs.ocr_download_size(catalogs.with_language(catalogs.with_asr_model(rows, "family", "tier"), "lang"), "ocr_key")
    return rows.select("doc_id", "lang_label", "ocr_key", "model_id", "ocr_bytes", catalogs.size_in(F.col("detail")).alias("size_label"))


ENGINES = [("onnx-community/whisper-tiny",), ("onnx-community/moonshine-base-ONNX",), ("tesseract",), ("rapidocr",), ("pdf-inspector+ocr",), ("anydoc",), ("text",), ("custom",), ("",)]


@query(f"""
    WITH s(k, engine) AS (VALUES {values([(k, *x) for k, x in enumerate(ENGINES)])}) SELECT event_id, CASE WHEN contains(engine, 'whisper') THEN 'Whisper' WHEN contains(engine, 'moonshine') THEN 'Moonshine' WHEN contains(engine, 'tesseract') THEN 'Tesseract'
        WHEN contains(engine, 'rapidocr') THEN 'RapidOCR' WHEN contains(engine, 'pdf-inspector') THEN 'PDF' WHEN engine = 'anydoc' THEN 'Office' WHEN engine = 'text' THEN 'Text' ELSE engine END AS short FROM events JOIN s ON k = event_id % {len(ENGINES)}""")
def engine_label(spark, sf_dir):
    rows = dealt(spark, table(spark, sf_dir, "events").select("event_id"), "event_id", ENGINES, "engine string")
    return rows.select("event_id", text.short_engine(F.col("engine")).alias("short"))


@query("""
    WITH s AS (SELECT vec_id AS i, 17 + vec_id * 37 % 2983 AS sw, 16 + vec_id * 53 % 977 AS sh, 32 * (1 + vec_id % 30) AS pw, 32 * (1 + vec_id // 7 % 30) AS ph,
        CAST(floor((embedding[1] + 1) * 100) AS BIGINT) AS x0, CAST(floor((embedding[2] + 1) * 50) AS BIGINT) AS y0, CAST(floor((embedding[1] + embedding[3] + 3) * 100) AS BIGINT) AS x1, CAST(floor((embedding[2] + embedding[4] + 3) * 50) AS BIGINT) AS y1 FROM embeddings),
    c AS (SELECT i, sw, sh, greatest(0, least(sw, floor(x0 * (sw * CAST(1 AS DOUBLE) / pw) + 0.5))) AS a, greatest(0, least(sh, floor(y0 * (sh * CAST(1 AS DOUBLE) / ph) + 0.5))) AS b, greatest(0, least(sw, floor(x1 * (sw * CAST(1 AS DOUBLE) / pw) + 0.5))) AS c, greatest(0, least(sh, floor(y1 * (sh * CAST(1 AS DOUBLE) / ph) + 0.5))) AS d FROM s),
    o AS (SELECT *, c - a AS w, d - b AS h, CASE WHEN (c - a) + (d - b) = 0 THEN 0 ELSE floor((c - a) * (d - b) / (2.0 * ((c - a) + (d - b))) * 1.5 + 0.5) END AS f FROM c),
    e AS (SELECT *, greatest(f, floor(w * 0.1 + 0.5)) AS ex, greatest(f, floor(h * 0.4 + 0.5)) AS ey FROM o)
    SELECT i, CAST(greatest(0, a - ex) AS INTEGER) AS x0, CAST(greatest(0, b - ey) AS INTEGER) AS y0, CAST(least(sw, c + ex) AS INTEGER) AS x1, CAST(least(sh, d + ey) AS INTEGER) AS y1,
        CAST(ceil(greatest(16, floor(sw * least(1.0, 960.0 / greatest(sw, sh)) + 0.5)) / 32.0) * 32 AS INTEGER) AS det_w, CAST(ceil(greatest(8, least(480, floor(48.0 * sw / sh + 0.5))) / 8.0) * 8 AS INTEGER) AS rec_w FROM e""")
def box_geometry(spark, sf_dir):
    """Boxes made from vectors, on pages whose sizes their numbers give."""
    import pandas as pd

    from .media import text_boxes

    names = ["i", "x0", "y0", "x1", "y1", "det_w", "rec_w"]
    i, e = F.col("vec_id"), lambda k: F.element_at("embedding", k)
    at = lambda x, scale: F.floor(x * _single(scale)).cast("long")
    one, three = _single(1), _single(3)
    page = [17 + i * 37 % 2983, 16 + i * 53 % 977, 32 * (1 + i % 30), 32 * (1 + F.floor(i / 7) % 30)]
    box = [at(e(1) + one, 100), at(e(2) + one, 50), at(e(1) + e(3) + three, 100), at(e(2) + e(4) + three, 50)]
    rows = table(spark, sf_dir, "embeddings").select(i.alias("i"), *(c.alias(f"c{k}") for k, c in enumerate([*page, *box])))
    return rows.mapInPandas(lambda batches: (pd.DataFrame([text_boxes(*map(int, r)) for r in b.itertuples(index=False)], columns=names) for b in batches), "i long, " + ", ".join(f"{n} int" for n in names[1:]))


def crc_sql(column: str) -> str:
    """CRC-32 of a text's bytes: a shift register, eight steps a byte."""
    bits = f"flatten(list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"


@query(f"SELECT conv_id, turn, {crc_sql('text')} AS crc FROM conversations")
def crc_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


@query()
def crc_table(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


@query("SELECT conv_id, CASE WHEN count(CASE WHEN role <> 'system' THEN 1 END) > 0 THEN 22 + sum(CASE WHEN role <> 'system' THEN 76 + 2 * octet_length(encode(role || turn || '.md')) + octet_length(encode(text)) ELSE 0 END) END AS zip_bytes, count(CASE WHEN role <> 'system' THEN 1 END) AS entries FROM conversations GROUP BY conv_id HAVING entries > 0")
def zip_roundtrip(spark, sf_dir):
    """Turns of a conversation as an archive, read back: its size and entries whose bytes are the text's."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string"), F.lit(".txt")).alias("file_name"), F.col("text").alias("markdown"), F.when(F.col("role") != "system", "ok").otherwise("error").alias("status"))
    archive.register(spark)
    export.archives(c, "conv_id", "turn").createOrReplaceTempView("millrace_archives")
    return spark.sql("SELECT CAST(a.`group` AS BIGINT) AS conv_id, CAST(length(a.zip) AS BIGINT) AS zip_bytes, count(*) AS entries FROM millrace_archives a, LATERAL zip_entries(a.zip) e GROUP BY a.`group`, a.zip")


@query("""
    WITH r AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS e FROM embeddings), p AS (SELECT vec_id, k % 8 AS x, k // 8 AS y, CAST(floor((e + 1) * 127) AS BIGINT) & 255 AS v FROM r),
    n AS (SELECT a.vec_id, a.x, a.y, list_sort(list(b.v)) AS l FROM p a JOIN p b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
    SELECT vec_id, sum((x + 8 * y + 1) * l[len(l) // 2 + 1]) AS checksum FROM n GROUP BY vec_id""")
def median3(spark, sf_dir):
    """Each vector as an image, 8 pixels across."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x + _single(1)) * _single(127)).bitwiseAND(F.lit(255).cast("long"))).alias("px"))

    def run(batches):
        import numpy as np

        for pdf in batches:
            yield pdf.assign(checksum=[_checksum(image.median3(np.array(p, np.uint8).reshape(-1, 8))) for p in pdf["px"]])[["vec_id", "checksum"]]

    return e.mapInPandas(run, "vec_id long, checksum long")


def _checksum(img) -> int:
    return int(sum((k + 1) * int(v) for k, v in enumerate(img.ravel())))


@query()
def convert_documents(spark, sf_dir):
    """The whole conversion over documents as files; its parts have SQL of their own."""
    from .convert import convert

    files = as_files(table(spark, sf_dir, "documents")).select(F.col("name").alias("path"), "name", F.octet_length("content").cast("long").alias("length"), "content")
    return convert(files).select("id", "file_name", F.col("detected.format").alias("format"), F.md5("markdown").alias("md_md5"), "status", F.col("error.code").alias("code"))


from . import media, stores  # noqa: E402, F401  # they register their queries
