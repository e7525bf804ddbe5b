"""Recognition engines and the policy around them. Engines are slots: none ships, as their weights are not ours, and an
empty slot gives error rows, never made-up text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources.documents import pdf_images, whole

WEAK = 0.5


class EngineError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class Line(NamedTuple):
    text: str
    confidence: float


#: image bytes and language -> lines; samples and language -> text
OcrEngine = Callable[[bytes, str], list[Line]]
AsrEngine = Callable[[np.ndarray, str], str]


def dictionary(spark: SparkSession, path: str) -> list[str]:
    """Letters of a recognizer, one a line, in order."""
    whole = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return [line.removesuffix("\r") for line in whole.removeprefix("\ufeff").split("\n")]


def model_bytes(spark: SparkSession, folder: str, name: str) -> bytes:
    """Weights kept in a folder that Spark can read; there is no download here, so a missing file is an error row's code."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("content").head(1)
    if not found:
        raise EngineError("MODEL_DOWNLOAD", f"No model {name} in {folder}.")
    return bytes(found[0][0])


def _missing(kind: str):
    def engine(*_):
        raise EngineError("MODEL_DOWNLOAD", f"No {kind} model is available.")

    return engine


def page_pictures(data: bytes) -> Callable[[int], bytes]:
    """Of a document, parsed once, the image that fills a scanned page; pages of no image need a renderer, and engines get
    the document itself."""
    image = pdf_images(data)

    def draw(page: int) -> bytes:
        try:
            return image(page)
        except ValueError:
            return data

    return draw


def page_picture(data: bytes, page: int) -> bytes:
    return page_pictures(data)(page)


@dataclass(frozen=True)
class Engines:
    """Picklable callables; ``render`` draws a page (from 1) of a document as an image. Confidences are divided by the
    scale of their engine: the fallback's are percentages."""

    ocr: OcrEngine = field(default_factory=lambda: _missing("OCR"))
    ocr_fallback: OcrEngine = field(default_factory=lambda: _missing("fallback OCR"))
    asr: AsrEngine = field(default_factory=lambda: _missing("speech"))
    asr_name: str = "whisper-tiny"
    render: Callable[[bytes, int], bytes] = page_picture
    ocr_scale: float = 1.0
    fallback_scale: float = 100.0


OCR_RESULT = "struct<text:string,mean_confidence:double,engine:string,code:string,message:string,ms:bigint>"
ASR_RESULT = "struct<text:string,code:string,message:string,ms:bigint>"


def _shaped(lines: list[Line], scale: float, engine: str) -> tuple:
    kept = [Line(x.text, x.confidence / scale) for x in lines if x.text]
    mean = sum(x.confidence for x in kept) / len(kept) if kept else 0.0
    return "\n".join(x.text for x in kept), [tuple(x) for x in kept], mean, engine, None, None


def run_ocr(image: bytes, language: str, engines: Engines) -> tuple:
    """The primary engine; the fallback if that fails, finds no line or is unsure; an error if the fallback fails."""
    try:
        first = _shaped(engines.ocr(image, language), engines.ocr_scale, "rapidocr")
        if first[1] and first[2] >= WEAK:
            return first
    except Exception:
        pass
    try:
        return _shaped(engines.ocr_fallback(image, language), engines.fallback_scale, "tesseract")
    except EngineError as e:
        return None, None, None, None, e.code, str(e)
    except Exception as e:
        return None, None, None, None, "internal", str(e)


def _ms(start: float) -> int:
    return int((time.perf_counter() - start) * 1000)


def ocr_column(engines: Engines):
    """Recognition of (image, language); null images give nulls."""

    @F.pandas_udf(OCR_RESULT)
    def recognize(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for images, languages in batches:
            rows = []
            for data, language in zip(images, languages, strict=True):
                start = time.perf_counter()
                if data is None:
                    rows.append((None,) * 6)
                    continue
                text, _, *rest = run_ocr(bytes(data), language, engines)
                rows.append((text and whole(text), *rest, _ms(start)))
            yield pd.DataFrame(rows, columns=["text", "mean_confidence", "engine", "code", "message", "ms"])

    return recognize


def drawn(data: bytes, pages: Iterable[int], engines: Engines) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(page, image, None) or (page, None, the reason why there is none), one page at a time of a document parsed once."""
    try:
        draw = page_pictures(data) if engines.render is page_picture else lambda page: engines.render(data, page)
    except Exception as e:
        reason = whole(str(e))

        def draw(page: int) -> bytes:
            raise ValueError(reason)

    for page in pages:
        try:
            yield page, draw(page), None
        except Exception as e:
            yield page, None, whole(str(e))


def asr_column(engines: Engines):
    """Transcription of (samples, language); null samples give nulls."""

    @F.pandas_udf(ASR_RESULT)
    def transcribe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for samples, languages in batches:
            rows = []
            for s, lang in zip(samples, languages, strict=True):
                start = time.perf_counter()
                if s is None:
                    rows.append((None,) * 4)
                    continue
                try:
                    rows.append((whole(engines.asr(np.asarray(s, np.float32), lang)), None, None, _ms(start)))
                except EngineError as e:
                    rows.append((None, e.code, str(e), _ms(start)))
                except Exception as e:
                    rows.append((None, "internal", whole(str(e)), _ms(start)))
            yield pd.DataFrame(rows, columns=["text", "code", "message", "ms"])

    return transcribe


class OcrLines:
    """SQL: ``FROM images, LATERAL ocr_lines(content, 'en')``: line_no, text, confidence; no rows where recognition fails."""

    engines: Engines

    def eval(self, content: bytes, language: str) -> Iterator[tuple]:
        found = run_ocr(bytes(content or b""), language, self.engines)
        for k, (text, confidence) in enumerate(found[1] or []):
            yield k, text, float(confidence)


def register(spark: SparkSession, engines: Engines) -> None:
    """Make ``ocr_lines`` known to SQL, with these engines."""
    own = type("OcrLines", (OcrLines,), {"engines": engines})
    spark.udtf.register("ocr_lines", udtf(own, returnType="line_no int, text string, confidence double"))


def quality(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines (keys, text, confidence) as n, mean_confidence (0 of none) and weak."""
    kept = F.when(F.col("text") != "", F.col("confidence"))
    out = lines.groupBy(*keys).agg(F.count(kept).alias("n"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean_confidence"))
    return out.withColumn("weak", (F.col("n") == 0) | (F.col("mean_confidence") < WEAK))
