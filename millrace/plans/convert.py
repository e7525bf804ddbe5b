"""Conversion of files to Markdown: classify, route by category, and bring all branches to one schema.

Text and refused files go straight through. All others take a second path: a reader gets the bytes of its own category;
then a file becomes rows of its own, one for what was read of it and one for each picture to recognize and each chunk
to transcribe, which are dealt over all tasks, so that one large file is many tasks' work; and the texts come
together again by one shuffle on the file, without pictures or samples. A failure is a row with an error."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import decode_text, effective_language, fence, trim
from ..operators import audio, pages
from ..operators.recognition import Engines, asr_column, drawn, ocr_column
from ..sources.audio import chunks, cut, layout
from ..sources.classify import classified
from ..sources.documents import analyze
from ..sources.files import too_large
from ..sources.schema import DETECTED, MAX_FILE_SIZE


@dataclass(frozen=True)
class Options:
    language: str = "auto"
    max_file_size: int = MAX_FILE_SIZE
    strict: bool = False


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _result(rows: DataFrame, engine: Column, markdown: Column, warnings: Column, fallbacks: Column, code: Column, message: Column, confidence: Column | None = None, spent: Column | None = None) -> DataFrame:
    """Rows (id, name, length, detected, ...) in the result schema; an error where ``code`` is not null."""
    bad = code.isNotNull()
    unknown = F.struct(F.lit("unknown").alias("category"), F.lit("unknown").alias("format"), F.lit(0.0).alias("confidence"), F.lit("—").alias("label"), _null("string").alias("reason"))
    ocr = _null("struct<mean_confidence:double>") if confidence is None else F.when(confidence.isNotNull(), F.struct(confidence.alias("mean_confidence")))
    metadata = F.struct(F.when(bad, "").otherwise(engine).alias("engine"), fallbacks.cast("array<string>").alias("fallbacks_used"), (F.lit(0) if spent is None else spent).cast("long").alias("duration_ms"), F.col("length").cast("long").alias("size_bytes"), F.when(~bad, ocr).alias("ocr"))
    return rows.select(
        "id",
        F.col("name").alias("file_name"),
        F.when(bad, unknown).otherwise(F.col("detected")).cast(DETECTED).alias("detected"),
        F.when(bad, "").otherwise(markdown).alias("markdown"),
        metadata.alias("metadata"),
        warnings.cast("array<string>").alias("warnings"),
        F.current_timestamp().alias("created_at"),
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, F.struct(code.alias("code"), message.alias("message"))).alias("error"),
    )


def _fail(rows: DataFrame, code: Column, message: Column) -> DataFrame:
    """Refused before any engine ran: no size is reported, and the message is a warning, too."""
    return _result(rows.withColumn("length", F.lit(0)), F.lit(""), F.lit(""), F.array(message), F.array(), code, message)


def convert(files: DataFrame, engines: Engines | None = None, options: Options | None = None) -> DataFrame:
    """Result rows of ``files`` (path, name, length, content). Ids are hashes of path and content, so reruns agree,
    and a file that is there twice is one result."""
    engines, options = engines or Engines(), options or Options()
    language = effective_language(F.lit(options.language))
    fits = files.where(F.col("length") <= options.max_file_size)
    keyed = classified(fits, options.strict).withColumn("id", F.sha2(F.concat_ws("|", "path", F.sha2("content", 256)), 256))
    large = too_large(files, options.max_file_size).withColumn("id", F.sha2("path", 256)).withColumn("detected", _null(DETECTED))
    out = _fail(large, F.col("error.code"), F.col("error.message"))
    none = F.array().cast("array<string>")
    kind = F.col("detected.category")
    media = kind.isin("audio", "video")
    straight = kind.isin("text", "unsupported", "unknown")
    rows, refused = keyed.where(straight), kind != "text"
    reason = F.coalesce(F.col("detected.reason"), F.concat(F.lit("Unsupported file type ("), F.col("detected.label"), F.lit(").")))
    # a file that is refused reports no size
    rows = rows.withColumn("length", F.when(refused, 0).otherwise(F.col("length")))
    out = out.unionByName(_result(rows, F.lit("text"), fence(decode_text(F.col("content"))), F.when(refused, F.array(reason)).otherwise(none), none, F.when(refused, F.col("detected.format")), reason))
    read = _gathered(_recognized(_items(keyed.where(~straight), engines), engines, language))
    scanned, pdf = F.coalesce(F.size("a.pages_needing_ocr") > 0, F.lit(False)), F.col("a.page_count").isNotNull()
    first, texts = F.get("parts", F.lit(0)), F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))
    by_page = F.map_from_arrays(F.transform("parts", lambda p: p["no"]), texts)
    said = audio.stitch_all(texts)
    markdown = (
        F.when(pdf, pages.merge(F.col("a.markdown"), F.col("a.page_count"), by_page))
        .when(kind == "document", F.col("a.markdown"))
        .when(kind == "image", F.when(first["text"] == "", "_No text detected._").otherwise(first["text"]))
        .otherwise(F.when(said == "", "_No speech detected._").otherwise(said))
    )
    engine = F.when(pdf & scanned, "pdf-inspector+ocr").when(pdf, "pdf-inspector").when(kind == "document", "anydoc").when(kind == "image", "rapidocr").otherwise(engines.asr_name)
    silent = F.when(trim(said) == "", "No speech was detected in this audio.")
    blank = F.when(trim(first["text"]) == "", "No text was detected in this image.")
    warnings = F.when(kind == "image", F.array_compact(F.array(F.col("detected.reason"), blank))).when(media, F.array_compact(F.array(silent))).otherwise(none)
    fallbacks = F.transform(F.filter("parts", lambda p: p["engine"] == "tesseract"), lambda p: F.lit("OCR: Tesseract"))
    broken = F.get(F.filter("parts", lambda p: p["code"].isNotNull()), F.lit(0))
    code, message = F.coalesce("a.code", "problem.code", broken["code"]), F.coalesce("a.message", "problem.message", broken["message"])
    spent = F.coalesce("a.ms", F.lit(0)) + F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(p["ms"], F.lit(0)))
    return out.unionByName(_result(read, engine, markdown, warnings, fallbacks, code, message, F.when(kind == "image", first["mean_confidence"]), spent))


ITEM = "struct<no:int,image:binary,samples:array<float>,message:string>"


def _items(rows: DataFrame, engines: Engines) -> DataFrame:
    """(id, base, item): of each file what is known of it, with item.no -1, and its pictures and chunks, without that. Pictures
    and chunks come one in a batch: no row or batch holds two, and of a recording no more is decoded at once."""
    kind, content = F.col("detected.category"), F.col("content")
    rows = rows.withColumn("a", analyze(F.when(kind == "document", content), F.col("detected.format")))
    base = F.struct("name", "length", "detected", "a")
    pages = F.when(kind == "document", F.col("a.pages_needing_ocr"))
    known = rows.select("id", base.alias("base"), kind.alias("kind"), F.when(kind.isin("image", "audio", "video") | (F.size(pages) > 0), content).alias("content"), pages.alias("pages"))
    schema = T.StructType([known.schema["id"], T.StructField("base", known.schema["base"].dataType), T.StructField("item", T._parse_datatype_string(ITEM)), T.StructField("problem", T.StringType())])
    (_, base_type, item_type, _) = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                number, content = row.column(0)[0].as_py(), row.column(3)[0].as_py()
                first = problem = None
                for item in _parts(row.column(2)[0].as_py(), content, row.column(4)[0].as_py() or [], engines):
                    if isinstance(item, str):
                        problem = item
                    else:
                        one = dict(zip(("no", "image", "samples", "message"), item, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, base_type), pa.array([one], item_type), pa.nulls(1, pa.string())], names=["id", "base", "item", "problem"])
                first = {"no": -1, "image": None, "samples": None, "message": None}
                yield pa.RecordBatch.from_arrays([pa.array([number]), row.column(1).cast(base_type), pa.array([first], item_type), pa.array([problem]).cast(pa.string())], names=["id", "base", "item", "problem"])

    found = known.mapInArrow(run, schema)
    problem = F.when(F.col("problem").isNotNull(), F.struct(F.lit("internal").alias("code"), F.col("problem").alias("message")))
    whole = F.struct("base.name", "base.length", "base.detected", "base.a", problem.alias("problem"))
    return found.select("id", F.when(F.col("base").isNotNull(), whole).alias("base"), "item")


def _parts(kind: str, content: bytes | None, pages: list[int], engines: Engines) -> Iterator[tuple | str]:
    """(no, image, samples, message) of what is to be recognized in a file; a text says why there is nothing."""
    if kind == "image":
        yield 0, content, None, None
    elif kind in ("audio", "video"):
        try:
            form = layout(lambda at, n: content[at : at + n], len(content))
            if form is None:
                yield "not a WAV file that can be decoded"
            elif form.samples:
                for no, start, end in chunks(form.samples):
                    yield no, None, cut(lambda at, n: content[at : at + n], form, start, end), None
        except (ValueError, KeyError, struct.error) as e:
            yield str(e)
    elif content is not None:
        for page, image, message in drawn(content, map(int, pages), engines):
            yield page, image, None, message


def _recognized(items: DataFrame, engines: Engines, language: Column) -> DataFrame:
    """(id, base, part): the text of each picture and chunk, dealt over all tasks one by one."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = items.repartition(tasks, "id", "item.no")
    read = spread.withColumn("o", ocr_column(engines)("item.image", language)).withColumn("t", asr_column(engines)("item.samples", language))
    undrawn = F.when(F.col("item.message").isNotNull(), "internal")
    part = F.struct(F.col("item.no").alias("no"), F.coalesce("o.text", "t.text").alias("text"), F.coalesce("o.code", "t.code", undrawn).alias("code"), F.coalesce("o.message", "t.message", "item.message").alias("message"), F.col("o.engine").alias("engine"), F.col("o.mean_confidence").alias("mean_confidence"), F.coalesce("o.ms", "t.ms").alias("ms"))
    return read.select("id", "base", F.when(F.col("item.no") >= 0, part).alias("part"))


def _gathered(parts: DataFrame) -> DataFrame:
    """(id, name, length, detected, a, problem, parts): files with their parts in order."""
    whole = parts.groupBy("id").agg(F.first("base", ignorenulls=True).alias("base"), F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("id", "base.*", "parts")
