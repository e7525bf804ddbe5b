"""Registered queries over the tables, and examples over files, images and recordings that are made up (see ``samples``), through
the code that conversion uses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audio, export, history, image, ocr, recognition
from ..sources import archive, documents
from ..sources import audio as recordings
from . import samples
from .catalogue import SPACE, as_files, dealt, example, query, table, values
from .convert import convert

CONVERTED = [
    ("a.docx", "docx", "# Title\n\nHello office", "ok", None),
    ("b.xlsx", "xlsx", "## Later\n\n| 5 | 6 |\n| --- | --- |\n\n## First\n\n| 1 | 2 |\n| --- | --- |", "ok", None),
    ("c.pptx", "pptx", "## Slide 1\n\nslide text", "ok", None),
    ("d.odt", "odt", "## Head\n\npara", "ok", None),
    ("e.epub", "epub", "# Book\n\nOnce upon", "ok", None),
    ("f.rtf", "rtf", "Rich \U0001f600 text\n\nend", "ok", None),
    ("g.csv", "csv", "| a | b |\n| --- | --- |\n| 1 | 2 |", "ok", None),
    ("h.pdf", "pdf", "<!-- Page 1 -->\n\nTyped text\n\n<!-- Page 2 -->\n\n\n\n<!-- OCR -->\n\nxxx\nxxxx", "ok", None),
    ("i.bmp", "bmp", "xxxx\nxxxxx", "ok", None),
    ("j.wav", "wav", "chunk of 480000 samples in en chunk of 52000 samples in en", "ok", None),
    ("k.txt", "text", "```text\nplain\n```", "ok", None),
    ("l.zip", "unknown", "", "error", "zip"),
    ("m.bin", "text", "", "error", "unknown"),
    ("n.pdf", "unknown", "", "error", "internal"),
    ("o.docx", "unknown", "", "error", "internal"),
    ("p.png", "png", "from the fallback", "ok", None),
]
CONVERTED = [(n, "unknown" if s == "error" else f, m, s, c) for n, f, m, s, c in CONVERTED]


@example(f"SELECT * FROM (VALUES {values(CONVERTED)}) t(file_name, format, markdown, status, code)")
def convert_files(spark, sf_dir):
    """Files of all kinds, by models that are made up: readers, pages to recognize, pictures, recordings and errors."""
    files = spark.createDataFrame([(n, n, len(b), bytearray(b)) for n, b in samples.office().items()], "path string, name string, length long, content binary")
    return convert(files, samples.engines()).select("file_name", F.col("detected.format").alias("format"), "markdown", "status", F.col("error.code").alias("code"))


@query(f"""
    WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents),
    c AS (SELECT *, n = 0 OR text IS NULL AS bare, lower(hex(encode(text)[1:12])) AS h FROM d)
    SELECT doc_id, CASE WHEN bare THEN 'error' ELSE 'ok' END AS status, CASE WHEN bare THEN 'empty' END AS code, md5(CASE WHEN bare THEN '' ELSE '```text' || chr(10) || text || chr(10) || '```' END) AS md_md5, CASE WHEN bare THEN 0 ELSE n END AS size_bytes
    FROM c WHERE bare OR (h NOT LIKE '424d%' AND h NOT LIKE '494433%' AND h NOT LIKE '4f676753%'
        AND length(regexp_replace(text[1:2048], '[^\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}]', '', 'g')) * 20 <= least(n, 2048))""")
def convert_texts(spark, sf_dir):
    """The whole conversion over documents as files; the rows that it takes for text, and the empty ones."""
    files = as_files(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("content").cast("long").alias("length"), "content")
    found = convert(files).where("detected.format = 'text' OR error.code = 'empty'")
    return found.select(F.split("file_name", "[.]")[0].cast("long").alias("doc_id"), "status", F.col("error.code").alias("code"), F.md5("markdown").alias("md_md5"), F.col("metadata.size_bytes").alias("size_bytes"))


PAGES = [(1, 1, 1), (2, 2, 4), (3, 3, 2), (4, 5, 9), (5, 0, 0)]


@example(f"WITH p(id, n, m) AS (VALUES {values(PAGES)}) SELECT id, CAST(k AS INTEGER) AS line_no, repeat('x', CAST(m + k AS BIGINT)) AS text FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM p WHERE n > 0) UNION ALL SELECT 5, 0, 'from the fallback'")
def ocr_lines(spark, sf_dir):
    """Pages of bars through decoding, preprocessing, detection, cropping and recognition; a page of none by the fallback."""
    recognition.register(spark, samples.engines())
    spark.createDataFrame([(i, bytearray(samples.bmp(samples.bars(n, m)))) for i, n, m in PAGES], "id int, content binary").createOrReplaceTempView("millrace_pages")
    return spark.sql("SELECT p.id, l.line_no, l.text FROM millrace_pages p, LATERAL ocr_lines(p.content, 'en') l")


@example("SELECT * FROM (VALUES (1, 'Typed text'), (2, '')) t(page, text)")
def pdf_pages(spark, sf_dir):
    documents.register(spark)
    spark.createDataFrame([(bytearray(samples.scanned_pdf()),), (bytearray(b"no PDF"),)], "content binary").createOrReplaceTempView("millrace_pdf")
    return spark.sql("SELECT p.page, p.text FROM millrace_pdf f, LATERAL pdf_pages(f.content) p")


ANGLES = [(0.0,), (1.5,), (2.0,), (-3.5,), (5.0,), (-8.0,)]


@example(f"SELECT CAST(angle AS DOUBLE) AS angle, true AS found FROM (VALUES {values(ANGLES)}) t(angle)")
def skew_angle(spark, sf_dir):
    """Whether a page's angle is found to half a degree."""

    def run(batches):
        for pdf in batches:
            got = [image.skew(image.binarize(samples.bars(6, 4, a), 128)) for a in pdf["angle"]]
            yield pd.DataFrame({"angle": pdf["angle"], "found": [abs(a + b) <= 0.5 for a, b in zip(pdf["angle"], got, strict=True)]})

    return spark.createDataFrame(ANGLES, "angle double").mapInPandas(run, "angle double, found boolean")


@example("SELECT n, CAST(k AS INTEGER) AS box, CAST(4 AS INTEGER) AS x0, CAST(20 * k + 5 AS INTEGER) AS y0, CAST(6 + k AS INTEGER) AS x1, CAST(20 * k + 8 AS INTEGER) AS y1 FROM (SELECT CAST(n AS INTEGER) AS n, unnest(generate_series(0, n - 1)) AS k FROM generate_series(1, 40) t(n))")
def components_boxes(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            rows = [(n, k, *b) for n in pdf["n"] for k, b in enumerate(image.components(samples.rectangles(int(n))))]
            yield pd.DataFrame(rows, columns=["n", "box", "x0", "y0", "x1", "y1"])

    return spark.range(1, 41).select(F.col("id").cast("int").alias("n")).mapInPandas(run, "n int, box int, x0 int, y0 int, x1 int, y1 int")


RECORDINGS = [(1, 1000, 16_000, 16), (2, 999, 8000, 8), (3, 44_100, 44_100, 16), (4, 0, 16_000, 16), (5, 7, 48_000, 8), (6, 500_000, 16_000, 16)]


@example(f"""
    WITH r(id, n, rate, bits) AS (VALUES {values(RECORDINGS)}) SELECT id, CAST(m AS INTEGER) AS n, CASE WHEN m > 0 THEN CAST(0.5 AS DOUBLE) END AS mean, CAST(CASE WHEN m <= 480000 THEN 1 ELSE 1 + ceil((m - 480000) / 448000.0) END AS INTEGER) AS chunks, CAST(floor(m / 16000.0 + 0.5) AS BIGINT) AS seconds
    FROM (SELECT id, CASE WHEN n = 0 THEN 0 WHEN rate = 16000 THEN n ELSE greatest(1, floor(n * 16000.0 / rate + 0.5)) END AS m FROM r)""")
def wav_decode(spark, sf_dir):
    from ..functions.geometry import chunk_bounds, duration_seconds

    files = spark.createDataFrame([(i, bytearray(samples.wav(n, rate, bits))) for i, n, rate, bits in RECORDINGS], "id int, content binary")
    heard = files.withColumn("w", recordings.wav_samples("content")).withColumn("n", F.size("w.samples"))
    mean = F.when(F.col("n") > 0, F.round(F.aggregate("w.samples", F.lit(0.0), lambda acc, x: acc + x) / F.col("n"), 6))
    return heard.select("id", "n", mean.alias("mean"), F.size(chunk_bounds(F.col("n"))).alias("chunks"), duration_seconds(F.col("n")).alias("seconds"))


@query("""
    WITH e AS (SELECT epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT s, s // 28 * 28 - 28 * k AS lo FROM e, (VALUES (0), (1)) t(k))
    SELECT make_timestamp(lo * 1000000) AS start, count(*) AS n FROM w WHERE s < lo + 30 GROUP BY lo""")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return audio.event_windows(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    WITH s AS (SELECT doc_id, text, n_chars, 0 AS v FROM documents UNION ALL SELECT doc_id, 'changed', n_chars + 1, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT -1 - doc_id, 'new', 1, 1 FROM documents WHERE lang = 'fr')
    SELECT doc_id, md5(text) AS md_md5, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) AS k FROM s) WHERE k = 1""")
def history_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "lang")
    new = d.where("lang = 'fr'").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new").alias("text"), F.lit(1).cast(d.schema["n_chars"].dataType).alias("n_chars"))
    changes = d.where("lang = 'en'").select("doc_id", F.lit("changed").alias("text"), (F.col("n_chars") + 1).cast(d.schema["n_chars"].dataType).alias("n_chars")).unionByName(new)
    return history.upsert(d.drop("lang"), changes, "doc_id").select("doc_id", F.md5("text").alias("md_md5"), "n_chars")


@query(f"""
    WITH e AS (SELECT doc_id, max(text) AS t FROM (SELECT doc_id, ' edited ' || quality AS text FROM labels UNION ALL SELECT doc_id, ' again ' || toxic FROM labels) GROUP BY doc_id)
    SELECT d.doc_id, md5(CASE WHEN t IS NOT NULL AND t <> d.text THEN regexp_replace(t, '^{SPACE}+|{SPACE}+$', '', 'g') ELSE d.text END) AS md_md5 FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""")
def history_edited(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown"))
    marks = table(spark, sf_dir, "labels")
    edits = marks.select(F.col("doc_id").alias("id"), F.concat(F.lit(" edited "), "quality").alias("text")).unionByName(marks.select(F.col("doc_id").alias("id"), F.concat(F.lit(" again "), "toxic").alias("text")))
    return history.edited(rows, edits).select(F.col("id").alias("doc_id"), F.md5("markdown").alias("md_md5"))


@query(f"""
    SELECT count(*) AS n, count(CASE WHEN lang <> 'de' THEN 1 END) AS exportable, count(CASE WHEN lang = 'de' THEN 1 END) AS failed,
        CAST(coalesce(sum(CASE WHEN lang <> 'de' THEN len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '')) ELSE 0 END), 0) AS BIGINT) AS words FROM documents""")
def history_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("markdown"), F.when(F.col("lang") == "de", "error").otherwise("ok").alias("status"))
    return history.summary(rows)


@query("SELECT user_id, CAST(len(l) AS INTEGER) AS n, list_sum(l[-5:]) AS last_ids FROM (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id)")
def queued_last(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    total = F.aggregate(history.last(F.col("l"), 5), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return jobs.select("user_id", F.size("l").alias("n"), total.alias("last_ids"))


@query("SELECT conv_id, role || turn || '.md' AS name, md5(text) AS content_md5 FROM conversations WHERE role <> 'system'")
def zip_contents(spark, sf_dir):
    """Turns of a conversation as an archive, read back: the bytes of each entry."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string"), F.lit(".txt")).alias("file_name"), F.col("text").alias("markdown"), F.when(F.col("role") != "system", "ok").otherwise("error").alias("status"))
    archive.register(spark)
    export.archives(c, "conv_id", "turn").createOrReplaceTempView("millrace_contents")
    return spark.sql("SELECT CAST(a.`group` AS BIGINT) AS conv_id, e.name, md5(e.content) AS content_md5 FROM millrace_contents a, LATERAL zip_contents(a.zip) e")


@query("SELECT page_id, CASE WHEN ends_with(url, '.md') OR ends_with(url, '.txt') THEN url ELSE url || '.md' END AS name FROM pages UNION ALL SELECT -1, 'a.md' UNION ALL SELECT -2, 'b.txt' UNION ALL SELECT -3, 'c.TXT.md'")
def download_names(spark, sf_dir):
    more = spark.createDataFrame([(-1, "a.md"), (-2, "b.txt"), (-3, "c.TXT")], "page_id long, url string")
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(more).select("page_id", text.download_name(F.col("url")).alias("name"))


FORMATS = [("wav",), ("mp3",), ("flac",), ("ogg",), ("aiff",), ("m4a",), ("mp4",), ("mov",), ("webm",), ("pdf",), ("",)]


@query("""
    SELECT event_id, ['audio/wav', 'audio/mpeg', 'audio/flac', 'audio/ogg', 'audio/aiff', 'audio/mp4', 'video/mp4', 'video/quicktime', 'video/webm', '', ''][event_id % 11 + 1] AS mime FROM events""")
def mime_types(spark, sf_dir):
    rows = dealt(spark, table(spark, sf_dir, "events").select("event_id"), "event_id", FORMATS, "format string")
    return rows.select("event_id", text.mime(F.col("format")).alias("mime"))


PHASES = [("reading",), ("analyzing",), ("preprocessing",), ("ocr",), ("asr",), ("model",), ("done",), ("other",), ("",)]


@query("""
    SELECT event_id, ['Detecting…', 'Extracting text…', 'Cleaning image…', 'Recognizing pages…', 'Transcribing…', 'Downloading model…', 'Done', 'other', ''][event_id % 9 + 1] AS shown FROM events""")
def phase_labels(spark, sf_dir):
    rows = dealt(spark, table(spark, sf_dir, "events").select("event_id"), "event_id", PHASES, "phase string")
    return rows.select("event_id", text.phase_label(F.col("phase")).alias("shown"))


@query("""
    WITH m(k, v) AS (VALUES ('image/png', 'png'), ('image/jpeg', 'jpg'), ('image/webp', 'webp')), e AS (SELECT event_id, ts, 'image/' || ['png', 'jpeg', 'webp', 'x'][event_id % 4 + 1] AS mime FROM events)
    SELECT event_id, 'pasted-' || strftime(ts, '%Y-%m-%d-%H%M') || '-' || md5(CAST(event_id AS VARCHAR))[1:5] || '.' || coalesce(m.v, 'png') AS name FROM e LEFT JOIN m ON m.k = e.mime""")
def paste_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    mime = F.concat(F.lit("image/"), F.element_at(F.array(*map(F.lit, ("png", "jpeg", "webp", "x"))), (F.col("event_id") % 4 + 1).cast("int")))
    return e.select("event_id", text.paste_name(F.col("ts"), F.md5(F.col("event_id").cast("string")), mime).alias("name"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Text' WHEN doc_id % 3 = 1 THEN 'RapidOCR' ELSE 'PDF' END || ' • ' || (doc_id % 1000) || ' B' || CASE WHEN doc_id % 5 > 0 THEN ' • ' || (doc_id % 5) || '.0s duration' ELSE '' END
        || CASE WHEN doc_id % 3 = 1 THEN ' • OCR ' || (doc_id % 101) || '% conf' ELSE '' END AS line FROM documents""")
def meta_lines(spark, sf_dir):
    i = F.col("doc_id")
    engine = F.when(i % 3 == 0, "text").when(i % 3 == 1, "rapidocr").otherwise("pdf-inspector+ocr")
    line = text.meta_line(engine, i % 1000, i % 5 * 1000, F.when(i % 3 == 1, "image").otherwise("text"), (i % 101) / 100.0)
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))


def text_boxes(i: int, sw: int, sh: int, pw: int, ph: int, *box: int) -> tuple:
    (x0, y0, x1, y1), (det_w, _) = ocr.unclip(box, sw / pw, sh / ph, sw, sh), ocr.detector_dims(sw, sh)
    return i, x0, y0, x1, y1, det_w, ocr.recognizer_width(sw, sh)


def gray_letters(batches, make, names):
    """``make`` of each text's code points, 255 at most, as one row of pixels; texts without any give no row."""
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            if text:
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                rows.append((key, *make(np.minimum(codes, 255).astype(np.uint8).reshape(1, -1))))
        yield pd.DataFrame(rows, columns=["doc_id", *names])
