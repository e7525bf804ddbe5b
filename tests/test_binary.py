import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest

from millrace.operators import image
from millrace.sources import archive, documents
from millrace.sources.audio import decode_wav, resample


def wav(samples, channels=1, rate=16_000, bits=16, kind=1, extensible=False):
    pack = {(1, 8): lambda v: struct.pack("B", int(v * 128 + 128)), (1, 16): lambda v: struct.pack("<h", int(v * 32768)), (1, 24): lambda v: struct.pack("<i", int(v * 8388608))[:3], (1, 32): lambda v: struct.pack("<i", int(v * 2147483648)), (3, 32): lambda v: struct.pack("<f", v), (3, 64): lambda v: struct.pack("<d", v)}[kind, bits]
    data = b"".join(map(pack, samples))
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, 0, channels * bits // 8, bits) + (struct.pack("<HHIH", 22, bits, 0, kind) + bytes(14) if extensible else b"")
    body = b"WAVE" + b"odd \x01\0\0\0x\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_wav_kinds(kind, bits):
    want = [0.0, 0.5, -0.5, 0.25]
    samples, rate = decode_wav(wav(want, bits=bits, kind=kind))
    assert rate == 16_000 and samples == pytest.approx(want, abs=0.01)
    assert decode_wav(wav(want, bits=bits, kind=kind, extensible=True))[0] == pytest.approx(want, abs=0.01)


def test_wav_stereo_rejects_and_truncation():
    assert decode_wav(wav([0.5, -0.5, 0.25, 0.75], channels=2))[0] == pytest.approx([0, 0.5])
    assert decode_wav(b"RIFF") is None and decode_wav(None) is None and decode_wav(b"RIFF\0\0\0\0AVI ") is None
    with pytest.raises(ValueError):
        decode_wav(wav([0.1] * 10)[:-4])


def test_resample():
    assert resample(np.array([1, 2, 3.0]), 16_000).tolist() == [1, 2, 3]
    assert len(resample(np.zeros(32), 32_000)) == 16 and resample(np.array([0, 1, 2, 3.0]), 32_000).tolist() == [0, 2]
    assert len(resample(np.zeros(0), 8000)) == 0
    assert resample(np.array([0.0, 1.0]), 8000).tolist() == [0, 0.5, 1, 1]


def test_zip_round_trip():
    files = [("a.md", b"hello"), ("é ملف.md", "ünï".encode()), ("empty.md", b"")]
    data = archive.build_zip(files)
    # no flag says that names are UTF-8, so other readers take them for CP437
    assert {n: zipfile.ZipFile(io.BytesIO(data)).read(n.encode().decode("cp437")) for n, _ in files} == dict(files)
    entries = archive.read_entries(data)
    assert [(e.name, archive.read_stored(data, e)) for e in entries] == files
    assert archive.read_entries(archive.build_zip([])) == []
    for bad in (b"", b"PK", data[:-30], b"x" * 100):
        assert archive.read_entries(bad) is None


def packed(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name) if name == "mimetype" else name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_package_kinds():
    assert archive.package_kind(packed({"word/document.xml": "<x/>"})) == "docx"
    assert archive.package_kind(packed({"ppt/presentation.xml": "<x/>"})) == "pptx"
    assert archive.package_kind(packed({"xl/workbook.xml": "<x/>"})) == "xlsx"
    assert archive.package_kind(packed({"mimetype": "application/epub+zip "})) == "epub"
    assert archive.package_kind(packed({"mimetype": "application/vnd.oasis.opendocument.spreadsheet"})) == "ods"
    assert archive.package_kind(packed({"other": "x"})) == "zip" and archive.package_kind(b"PK\x03\x04") == "zip"


def test_office_readers():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t><w:t>docx</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert documents.read(packed({"word/document.xml": doc}), "docx")[0] == "# Title\n\nHello docx\n\n| a |\n| --- |"
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>'
    book = '<workbook><sheets><sheet name="S"/></sheets></workbook>'
    assert "| one |  | 7 |" in documents.read(packed({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>one</t></si></sst>"}), "xlsx")[0]
    assert "slide text" in documents.read(packed({"ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": "<s><p><r><t>slide text</t></r></p></s>"}), "pptx")[0]
    odt = '<o xmlns:t="urn:t"><t:h t:outline-level="2">Head</t:h><t:p>para</t:p></o>'
    assert documents.read(packed({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": odt}), "odt")[0] == "## Head\n\npara"
    assert documents.read(b"a,b\n1,2", "csv")[0].splitlines()[0] == "| a | b |"
    assert documents.read(rb"{\rtf1{\fonttbl x;}Hello\par W\'e9\u233?}", "rtf")[0].startswith("Hello")
    with pytest.raises(documents.DocumentError) as e:
        documents.read(packed({"word/document.xml": f"<w:document {W}><w:body/></w:document>"}), "docx")
    assert e.value.code == "empty"


def pdf(*pages, flate=False, extra=b""):
    objects, kids = [], []
    for k, content in enumerate(pages):
        raw = zlib.compress(content) if flate else content
        kids.append(b"%d 0 R" % (10 + 2 * k))
        objects.append(b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj" % (10 + 2 * k, 11 + 2 * k))
        objects.append(b"%d 0 obj <</Length %d%s>> stream\n%s\nendstream endobj" % (11 + 2 * k, len(raw), b" /Filter /FlateDecode" if flate else b"", raw))
    return b"%PDF-1.4\n1 0 obj <</Type /Catalog>> endobj\n2 0 obj <</Type /Pages /Kids [" + b" ".join(kids) + b"]>> endobj\n" + b"\n".join(objects) + extra + b"\n%%EOF"


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    marked, count, need = documents.read(pdf(rb"BT (Hello \(x\)) Tj T* (next) Tj ET", b"q Q", flate=flate), "pdf")
    assert count == 2 and need == [2] and "Hello (x)\nnext" in marked and "<!-- Page 2 -->" in marked
    with pytest.raises(documents.DocumentError) as e:
        documents.read(pdf(b"", extra=b"\ntrailer <</Encrypt 9 0 R>>"), "pdf")
    assert e.value.code == "encrypted"


def page(lines=6, angle=0.0):
    img = np.full((120, 200), 255, np.uint8)
    for k in range(lines):
        img[15 + 16 * k : 20 + 16 * k, 30:170] = 0
    return image.rotate(img, math.radians(angle), 255) if angle else img


def test_preprocess_parts():
    assert image.gray(np.array([[[255, 0, 0], [0, 255, 0]]])).tolist() == [[76, 149]]
    assert image.stretch(np.array([[100, 120]], np.uint8)).tolist() == [[100, 120]] and image.stretch(np.array([[50, 200]], np.uint8)).tolist() == [[0, 255]]
    assert 20 <= image.otsu(np.array([[20] * 5 + [220] * 5], np.uint8)) < 220
    assert image.ink_box(image.binarize(page(), 128)) == (26, 11, 174, 104) and image.ink_box(np.zeros((9, 9))) is None
    noisy = np.full((9, 9), 255, np.uint8)
    noisy[4, 4] = 0
    assert image.median3(noisy).min() == 255
    assert image.skew(image.binarize(page(), 128)) == 0 and abs(image.skew(image.binarize(page(angle=4), 128)) + 4) <= 1
    assert image.preprocess(np.repeat(page(angle=3)[..., None], 3, 2)).shape == (120, 200, 3) and image.preprocess(np.zeros((4, 4, 3), np.uint8)).shape == (4, 4, 3)


def test_components_match_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((12, 15)) > 0.6
        boxes, seen = [], np.zeros_like(mask)
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            todo, ys, xs = [(y, x)], [], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                ys.append(a)
                xs.append(b)
                for c in range(max(0, a - 1), min(12, a + 2)):
                    for d in range(max(0, b - 1), min(15, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            if max(xs) > min(xs) or max(ys) > min(ys):
                boxes.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        assert sorted(image.components(mask.astype(float))) == sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in boxes)


def test_ctc_split_and_resize():
    logits = np.array([[0, 5, 0], [0, 5, 0], [9, 0, 0], [0, 5, 0], [0, 0, 7.0]])
    word, p = image.ctc(logits, ["a", "b"])
    assert word == "aab" and 0.9 < p < 1 and image.ctc(np.zeros((0, 0)), []) == ("", 0.0)
    line = np.full((10, 1000, 3), 255, np.uint8)
    for k in range(10):
        line[:, 100 * k + 10 : 100 * k + 80] = 0
    assert image.split_wide(line[:, :400]) == [(0, 400)] and image.split_wide(np.full((5, 600, 3), 255, np.uint8)) == [(0, 600)]
    spans = image.split_wide(line)
    assert spans[0][0] == 10 and spans[-1][1] == 980
    assert np.allclose(image.resize(np.full((4, 6, 3), 51, np.uint8), 9, 5), 0.2) and image.to_tensor(np.zeros((2, 3, 3))).shape == (3, 2, 3)


def png(img, kind=0):
    h, w = img.shape[:2]
    rows = b"".join(bytes([kind]) + (img[y] if kind == 0 else (img[y].astype(int) - (img[y - 1] if y else 0)) % 256).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_decode_image():
    img = np.random.default_rng(5).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert np.array_equal(image.decode_image(png(img)), img) and np.array_equal(image.decode_image(png(img, 2)), img)
    rows = b"".join(img[y, :, ::-1].tobytes() + b"\0" * 3 for y in reversed(range(5)))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(image.decode_image(bmp), img)
    with pytest.raises(ValueError):
        image.decode_image(b"\xff\xd8\xff")


def test_inflation_is_bounded():
    data = packed({"big": b"x" * 5000})
    entry = archive.read_entries(data)[0]
    assert archive.read_entry(data, entry, 5000) == b"x" * 5000
    with pytest.raises(ValueError):
        archive.read_entry(data, entry, 4999)


def test_rtf_code_units_and_stand_ins():
    read = lambda x: documents.read(x, "rtf")[0]
    assert read(rb"{\rtf1 it\u8217?s \u-10179?\u-8704? ok \u-10179? end}") == "it’s \U0001f600 ok � end"
    assert read(rb"{\rtf1 {\uc0\u233}x {\uc2\u233\'e9?}y \u233 ?z}") == "éx éy éz"


def test_workbook_order_and_names():
    sheet = lambda v: f'<worksheet><sheetData><row><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="Later" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/sheet1.xml": sheet(1), "xl/worksheets/sheet2.xml": sheet(2)}
    assert documents.read(packed(parts), "xlsx")[0] == "## Later\n\n| 2 |\n| --- |\n\n## First\n\n| 1 |\n| --- |"


def object_stream(objects):
    """Objects (number, body) in a compressed stream, as files since version 1.5 have them."""
    head, body = "", b""
    for key, x in objects:
        head += f"{key} {len(body)} "
        body += x + b" "
    packed_ = zlib.compress(head.encode() + body)
    return b"50 0 obj <</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj\n" % (len(objects), len(head), len(packed_), packed_)


def test_pdf_with_object_streams_fonts_and_page_tree():
    codes = b"1 beginbfchar <0003> <0416> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00e9> <d83dde00>] endbfrange"
    objects = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [6 0 R 5 0 R] /Resources <</Font <</F1 7 0 R>>>>>>"), (5, b"<</Type /Page /Contents 8 0 R>>"), (6, b"<</Type /Page /Contents [9 0 R]>>"), (7, b"<</Type /Font /ToUnicode 10 0 R>>")]
    hexed = b"BT /F1 12 Tf <000300100011001200200021> Tj ET".hex().encode() + b">"
    streams = b"8 0 obj <</Length 14>> stream\nBT (two) Tj ET\nendstream endobj\n9 0 obj <</Filter [/ASCIIHexDecode] /Length %d>> stream\n%s\nendstream endobj\n10 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(hexed), hexed, len(codes), codes)
    data = b"%PDF-1.5\n" + object_stream(objects) + streams + b"%%EOF"
    assert documents.pdf_pages(data) == ["Жabcé\U0001f600", "two"]


def test_pdf_without_pages_is_an_error():
    with pytest.raises(documents.DocumentError):
        documents.read(b"%PDF-1.7\nnothing here", "pdf")


def test_pdf_image():
    pixels = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    raw = zlib.compress(pixels.tobytes())
    data = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj 3 0 obj <</Type /Page /Resources <</XObject <</I 4 0 R>>>>>> endobj 4 0 obj <</Subtype /Image /Width 5 /Height 4 /BitsPerComponent 8 /Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj" % (len(raw), raw)
    assert np.array_equal(image.decode_image(documents.pdf_image(data, 1)), pixels)
    with pytest.raises(ValueError):
        documents.pdf_image(data, 2)
