"""Files and models that are made up, for queries whose input no table has."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from ..operators import image
from ..operators.ocr import ModelEngine
from ..operators.recognition import Engines, Line
from ..sources.archive import build_zip

W = "urn:w"


def wav(n: int, rate: int, bits: int, value: float = 0.5) -> bytes:
    """``n`` samples of one value."""
    one = struct.pack("B", int(value * 128 + 128)) if bits == 8 else struct.pack("<h", int(value * 32768))
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", n * len(one)) + one * n
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bars(lines: int, across: int, angle: float = 0.0) -> np.ndarray:
    """A white page of ``lines`` rows of dark bars, ``across`` in the first and one more in each further row."""
    img = np.full((40 + 40 * lines, 300), 255, np.uint8)
    for y in range(lines):
        for x in range(across + y):
            img[30 + 40 * y : 42 + 40 * y, 20 + 20 * x : 30 + 20 * x] = 0
    return image.rotate(img, math.radians(angle), 255) if angle else img


def rectangles(n: int) -> np.ndarray:
    """A map with ``n`` regions apart: the k-th is k + 2 wide and 3 high."""
    out = np.zeros((20 * n + 10, 60))
    for k in range(n):
        out[20 * k + 5 : 20 * k + 8, 4 : 6 + k] = 0.9
    out[0, 50] = 1.0  # a single pixel is none
    return out


def bmp(gray: np.ndarray) -> bytes:
    h, w = gray.shape
    rows = b"".join(np.repeat(gray[y], 3).tobytes() + bytes(-3 * w % 4) for y in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def dark_rows(tensor: np.ndarray) -> np.ndarray:
    """A detector: rows that have anything dark, over their whole width but the edges."""
    dark = tensor[0].mean(axis=0) < 0
    out = np.zeros(dark.shape)
    out[dark.any(axis=1), 2:-2] = 1.0
    return out


def runs(tensor: np.ndarray, language: str) -> np.ndarray:
    """A recognizer: an ``x`` for each run of dark columns."""
    dark = np.concatenate([[False], (tensor[0].mean(axis=0) < 0).any(axis=0)])
    starts = dark[1:] & ~dark[:-1]
    return np.where(np.array([[False, True]]) == starts[:, None], 9.0, 0.0)


def hear(samples: np.ndarray, language: str) -> str:
    return f"chunk of {len(samples)} samples in {language}"


def second(data: bytes, language: str) -> list[Line]:
    return [Line("from the fallback", 70.0)]


def models() -> ModelEngine:
    return ModelEngine(dark_rows, runs, {"en": ["x"]})


def engines() -> Engines:
    return Engines(models(), second, hear)


def scanned_pdf() -> bytes:
    """Two pages: one with text, one that is an image of two rows of bars; its objects are in an object stream."""
    page = bars(2, 3)
    raw = zlib.compress(page.tobytes())
    objects = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R 4 0 R]>>"), (3, b"<</Type /Page /Contents 5 0 R>>"), (4, b"<</Type /Page /Resources <</XObject <</I 6 0 R>>>>>>")]
    head, body = "", b""
    for key, x in objects:
        head += f"{key} {len(body)} "
        body += x + b" "
    packed = zlib.compress(head.encode() + body)
    text = b"BT (Typed text) Tj ET"
    return (
        b"%PDF-1.5\n"
        + b"9 0 obj <</Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
        + b"5 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(text), text)
        + b"6 0 obj <</Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj\n%%%%EOF" % (page.shape[1], page.shape[0], len(raw), raw)
    )


def office() -> dict[str, bytes]:
    """Files by name, one of each kind that there is a reader for and some that there is none for."""
    cell = lambda v: f'<worksheet><sheetData><row><c r="A1"><v>{v}</v></c><c r="B1"><v>{v + 1}</v></c></row></sheetData></worksheet>'.encode()
    book = b'<workbook xmlns:r="urn:r"><sheets><sheet name="Later" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></workbook>'
    links = b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>'
    odt = b'<o xmlns:t="urn:t"><t:h t:outline-level="2">Head</t:h><t:p>para</t:p></o>'
    package = b'<package><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>'
    return {
        "a.docx": build_zip([("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Hello office</w:t></w:r></w:p></w:body></w:document>'.encode())]),
        "b.xlsx": build_zip([("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/worksheets/sheet1.xml", cell(1)), ("xl/worksheets/sheet2.xml", cell(5))]),
        "c.pptx": build_zip([("ppt/presentation.xml", b"<x/>"), ("ppt/slides/slide1.xml", b"<s><p><r><t>slide text</t></r></p></s>")]),
        "d.odt": build_zip([("mimetype", b"application/vnd.oasis.opendocument.text"), ("content.xml", odt)]),
        "e.epub": build_zip([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", b'<c><rootfile full-path="p.opf"/></c>'), ("p.opf", package), ("c.xhtml", b"<html><body><h1>Book</h1><p>Once upon</p></body></html>")]),
        "f.rtf": rb"{\rtf1 Rich \u-10179?\u-8704? text\par end}",
        "g.csv": b"a,b\n1,2",
        "h.pdf": scanned_pdf(),
        "i.bmp": bmp(bars(2, 4)),
        "j.wav": wav(500_000, 16_000, 16),
        "k.txt": b"plain",
        "l.zip": build_zip([("x", b"y")]),
        "m.bin": b"\x01\x02\x03\x04",
        "n.pdf": b"%PDF-1.7 nothing",
        "o.docx": build_zip([("word/document.xml", b"<broken")]),
        "p.png": b"\x89PNG\r\n\x1a\nbroken",
    }
