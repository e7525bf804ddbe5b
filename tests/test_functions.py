import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry, text
from millrace.operators import audio, export, history, pages, recognition
from millrace.sources import classify
from millrace.sources.schema import CATEGORIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def detect(spark, data, name="f", strict=False):
    df = spark.createDataFrame([(name, bytearray(data))], "name string, content binary")
    return classify.classified(df, strict).first().detected


@pytest.mark.parametrize(
    ("data", "name", "category", "format", "reason"),
    [
        (b"", "x", "unsupported", "empty", True),
        (b"%PDF-1.4", "x", "document", "pdf", False),
        (b"\x89PNG\r\n\x1a\n", "x", "image", "png", False),
        (b"RIFF\0\0\0\0WAVE", "x", "audio", "wav", False),
        (b"\x07\x1b\x00\x9c", "letter.docx", "unknown", "unknown", True),
        ("hello é".encode(), "x", "text", "text", False),
        (b"a,b\n1,2", "data.csv", "document", "csv", False),
        (bytes.fromhex("d0cf11e0a1b11ae1"), "x.doc", "document", "ole", False),
        (b"\0\0\0\x18ftypheic", "x", "image", "heic", True),
        (b"RIFF\0\0\0\0AVI ", "x", "unsupported", "avi", True),
        (b"BM is text", "x.txt", "image", "bmp", False),
        (b"ID3 is text", "x.txt", "audio", "mp3", False),
        (b"\0\0\0\x18ftypM4A ", "x", "video", "mp4", False),
    ],
)
def test_classify(spark, data, name, category, format, reason):
    got = detect(spark, data, name)
    assert (got.category, got.format, got.reason is not None) == (category, format, reason) and got.category in CATEGORIES


def test_utf16_text_is_text_unless_strict(spark):
    assert detect(spark, b"\xff\xfeh\0i\0").format == "text" and detect(spark, b"\xff\xfeh\0i\0", strict=True).format == "mp3"


def test_sniff_against_plain_python(spark):
    rng = random.Random(1)
    cases = [bytes(rng.choice([rng.randrange(256), 65]) if rng.random() < 0.15 else 97 for _ in range(rng.randrange(1, 3000))) for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = {r.i: r.s for r in df.select("i", classify.sniff_text(F.col("c")).alias("s")).collect()}
    for i, c in enumerate(cases):
        head = c[:2048]
        control = sum(b < 32 and b not in (9, 10, 13) or b == 127 for b in head)
        marked = c[:3] == b"\xef\xbb\xbf" or c[:2] in (b"\xff\xfe", b"\xfe\xff")
        assert got[i] == (marked or control / len(head) <= 0.05 and (len(head) - control) / len(head) > 0.85)


@pytest.mark.parametrize(("data", "expected"), [(b"plain", "plain"), ("﻿café".encode(), "café"), (b"\xff\xfeh\0i\0", "hi"), (b"\xfe\xff\0h\0i", "hi"), (b"a\xffb", "a�b"), (b"", "")])
def test_decode(spark, data, expected):
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(text.decode_text(F.col("c"))).first()[0] == expected


# text layer, pages, recognized pages, and what comes of them
MERGED = [
    ("<!-- Page 1 -->\nOne\n<!-- Page 2 -->\n", 2, {2: "scan two"}, "<!-- Page 1 -->\n\nOne\n\n<!-- Page 2 -->\n\n\n\n<!-- OCR -->\n\nscan two"),
    (None, 2, {1: "first", 2: "second"}, "\n\n\n\n<!-- OCR page 1 -->\n\nfirst\n\n<!-- Page 2 -->\n\n\n\n<!-- OCR -->\n\nsecond"),
    ("no markers", 1, {}, "no markers"),
    ("<!-- Page 1 -->text", 1, {1: " ocr "}, "<!-- Page 1 -->\n\ntext\n\n\n\n<!-- OCR -->\n\nocr"),
    ("preamble <!-- Page 1 -->a<!-- Page 1 -->b<!--Page 3-->", 2, {}, "<!-- Page 1 -->\n\nb\n\n<!-- Page 2 -->"),
    ("<!-- Page 0 -->zero<!-- Page 9 -->nine", 1, {}, "<!-- Page 1 -->"),
    ("x", 0, {1: "y"}, ""),
    ("no markers", 3, {3: "z"}, "no markers\n\n<!-- Page 2 -->\n\n<!-- Page 3 -->\n\n\n\n<!-- OCR -->\n\nz"),
]


def test_merge(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(MERGED)], "i int, m string, n int, o map<int,string>")
    got = {r.i: r.x for r in df.select("i", pages.merge(F.col("m"), F.col("n"), F.col("o")).alias("x")).collect()}
    assert got == {i: c[3] for i, c in enumerate(MERGED)}


def plain_stitch(left, right):
    a, b = left.split(), right.split()
    if not a or not b:
        return " ".join(a or b)
    k = next((k for k in range(min(len(a), len(b), 12), 1, -1) if " ".join(a[-k:]).lower() == " ".join(b[:k]).lower()), 0)
    return " ".join(a) + " " + " ".join(b[k:])


def test_stitch(spark):
    rng = random.Random(2)
    pairs = [("the quick brown fox", "brown fox jumps"), ("", "a b"), ("a b", ""), ("a b c", "B C"), ("one word", "word two"), ("", "")]
    pairs += [(" ".join(rng.choices("ab", k=rng.randrange(20))), " ".join(rng.choices("ab", k=rng.randrange(20)))) for _ in range(100)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", audio.stitch(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {i: plain_stitch(*p) for i, p in enumerate(pairs)}
    parts = spark.createDataFrame([(["we are going to", " ", "going to the shop", "the shop today"],), ([" "],), (["  alone  "],)], "p array<string>")
    assert [r[0] for r in parts.select(audio.stitch_all(F.col("p"))).collect()] == ["we are going to the shop today", "", "  alone  "]


def test_chunks(spark):
    for n, count in ((16_000, 1), (480_000, 1), (480_001, 2), (90 * 16_000, 4), (0, 1)):
        found = one(spark, geometry.chunk_bounds(F.lit(n)))
        assert len(found) == count and found[-1].end == n and all(a.end - b.start == 32_000 for a, b in zip(found, found[1:], strict=False))


def test_names_and_labels(spark):
    for name, expected in [("report.pdf", "report.md"), ("a/b:c?.txt", "a_b_c_.md"), ("", "converted.md"), ("...x", "x.md"), ("été.tar.gz", "été.tar.md"), (".env", "env.md"), ("a____b", "a_b.md")]:
        assert one(spark, text.zip_entry_name(F.lit(name))) == expected
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["a.md", "a.md", "a (1).md", "b", "b"])], "o int, n string")
    assert [r.entry for r in export.unique_names(rows, "n", "o").orderBy("o").collect()] == ["a.md", "a (1).md", "a (1).md", "b", "b"]
    for n, label in [(0, "0 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.00 GB")]:
        assert one(spark, text.format_bytes(F.lit(n))) == label
    assert one(spark, text.text_dir(F.lit("اردو"))) == "rtl" and one(spark, text.text_dir(F.lit(None).cast("string"))) == "ltr"
    assert one(spark, text.esc(F.lit("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"
    assert one(spark, text.trim(F.lit("  \ta ﻿\n"))) == "a"
    assert one(spark, text.download_name(F.lit("x.txt"))) == "x.txt" and one(spark, text.download_name(F.lit("x"))) == "x.md"
    assert one(spark, text.meta_line(F.lit("rapidocr"), F.lit(2048), F.lit(1500), F.lit("image"), F.lit(0.875))) == "RapidOCR • 2.0 KB • 1.5s duration • OCR 88% conf"
    assert one(spark, text.phase_label(F.lit("asr"))) == "Transcribing…" and one(spark, text.phase_label(F.lit("zz"))) == "zz"
    assert one(spark, text.mime(F.lit("mov"))) == "video/quicktime" and one(spark, text.mime(F.lit("zz"))) == ""
    assert one(spark, text.paste_name(F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit("abcdefg"), F.lit("image/jpeg"))) == "pasted-2026-01-02-0304-abcde.jpg"
    assert "<h2>T</h2>" in one(spark, text.markdown_html(F.lit("## T\n<b>")))


def test_combined_markdown(spark):
    rows = spark.createDataFrame([(1, 1, "a", " x ", "ok"), (1, 2, "b", "y", "error"), (1, 3, "c", "z", "ok"), (2, 1, "d", "w", "error")], "g int, o int, n string, m string, s string")
    got = {r.g: r.x for r in rows.groupBy("g").agg(export.combined_markdown(F.col("o"), F.col("n"), F.col("m"), F.col("s")).alias("x")).collect()}
    assert got == {1: "## a\n\n\n\nx\n\n## c\n\n\n\nz\n", 2: ""}


def test_quality_and_search(spark):
    lines = spark.createDataFrame([("a", "x", 0.9), ("a", "", 0.0), ("b", "y", 0.4), ("c", "", 0.9)], "k string, text string, confidence double")
    assert {r.k: (r.n, round(r.mean_confidence, 3), r.weak) for r in recognition.quality(lines, "k").collect()} == {"a": (1, 0.9, False), "b": (1, 0.4, True), "c": (0, 0.0, True)}
    rows = spark.createDataFrame([("A%b",), ("axb",), (None,)], "t string")
    assert [r.t for r in rows.where(history.matches(" a%B ", F.col("t"))).collect()] == ["A%b"]
    assert rows.where(history.matches("  ", F.col("t"))).count() == 3


def test_otsu_flat_and_two_levels():
    import numpy as np

    from millrace.operators import image

    def brute(vs):
        best = (-1.0, 128)
        for t in range(256):
            low, high = [v for v in vs if v <= t], [v for v in vs if v > t]
            if low and high:
                between = float(len(low)) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
                best = max(best, (between, t))
        return best[1]

    rng = random.Random(3)
    sets = [[7] * 5, [10] * 4 + [200] * 3, *([rng.randrange(0, 256, rng.choice([1, 5, 50])) for _ in range(60)] for _ in range(10))]
    got = [image.otsu(np.array(vs, np.uint8).reshape(1, -1)) for vs in sets]
    assert got == [brute(vs) for vs in sets] and got[:2] == [128, 199]


def test_boxes():
    from millrace.operators import ocr

    got = ocr.text_boxes([(10, 10, 60, 20), (5, 1, 6, 2)], 2.0, 2.0, 300, 200)
    assert got == sorted(got, key=lambda x: (x[1], x[0]))
    w, h = 100, 20
    o = math.floor(w * h / (2 * (w + h)) * 1.5 + 0.5)
    assert (20 - max(o, 10), 20 - max(o, 8), 120 + max(o, 10), 40 + max(o, 8)) in got


def test_stitch_all_folds_pair_by_pair(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(60):
        parts, text = [], [rnd.choice(["One", "two", "three", "four"]) for _ in range(30)]
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(0, 20)
            parts.append(rnd.choice(["", " ", "\n"]) + " ".join(text[at : at + rnd.randrange(0, 16)]))
        rows.append((parts,))
    found = spark.createDataFrame(rows, "parts array<string>")

    def plain(a, b):
        x, y = a.split(), b.split()
        if not x or not y:
            return " ".join(x or y)
        k = next((k for k in range(min(12, len(x), len(y)), 1, -1) if [w.lower() for w in x[-k:]] == [w.lower() for w in y[:k]]), 0)
        return " ".join(x) + " " + " ".join(y[k:])

    for r in found.select("parts", audio.stitch_all(F.col("parts")).alias("got")).collect():
        kept, out = [p for p in r.parts if p.strip()], ""
        for k, p in enumerate(kept):
            out = p if k == 0 else plain(out, p)
        assert r.got == out


def test_merge_pages_takes_the_last_text_of_a_page(spark):
    docs = spark.createDataFrame([(1, "<!-- Page 1 -->a<!-- Page 2 -->b<!-- Page 1 -->c", 3), (2, None, 0), (3, "plain", 2)], "id long, markdown string, page_count int")
    ocr = spark.createDataFrame([(1, 2, "old", 1), (1, 2, "new", 2), (1, None, "lost", 3), (3, 2, "z", 1), (9, 1, "none", 1)], "id long, page int, text string, at int")
    got = {r.id: r.merged for r in pages.merge_pages(docs, ocr, order_col="at").collect()}
    assert got[1] == "<!-- Page 1 -->\n\nc\n\n<!-- Page 2 -->\n\nb\n\n\n\n<!-- OCR -->\n\nnew\n\n<!-- Page 3 -->"
    assert got[2] == "" and got[3] == "plain\n\n<!-- Page 2 -->\n\n\n\n<!-- OCR -->\n\nz"
