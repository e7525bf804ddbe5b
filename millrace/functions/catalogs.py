"""Small fixed catalogs as tables; each has a few rows for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = [("auto", "Auto (English)", "EN", None, "en"), ("en", "English", "EN", "en", "en"), ("hi", "Hindi", "हिन्दी", "hi", "hi"), ("ur", "Urdu", "اردو", "ur", "ur")]
OCR_DETECTOR = ("PP-OCRv3 mobile detection", 2429873)
OCR_RECOGNIZERS = [("en", "PP-OCRv5 English recognition", 7830888), ("hi", "PP-OCRv3 Devanagari recognition", 8980224), ("ur", "PP-OCRv3 Arabic/Urdu recognition", 8978664)]
ASR_MODELS = [("moonshine", "tiny", "onnx-community/moonshine-tiny-ONNX", 28127173), ("moonshine", "base", "onnx-community/moonshine-base-ONNX", 62916062), ("whisper", "tiny", "onnx-community/whisper-tiny", 40886921), ("whisper", "base", "onnx-community/whisper-base", 76894612)]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "key string, label string, native string, whisper_code string, ocr_key string")


def recognizers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OCR_RECOGNIZERS, "ocr_key string, name string, size_bytes long")


def asr_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASR_MODELS, "family string, tier string, model_id string, size_bytes long")


def with_language(df: DataFrame, key: str) -> DataFrame:
    """``df`` with label and ocr_key of its language; English where the key is none of ours."""
    table = F.broadcast(languages(df.sparkSession).select(F.col("key").alias("_key"), F.col("label").alias("lang_label"), "ocr_key"))
    return df.join(table, df[key] == table["_key"], "left").withColumns({"lang_label": F.coalesce("lang_label", F.lit("English")), "ocr_key": F.coalesce("ocr_key", F.lit("en"))}).drop("_key")


def with_asr_model(df: DataFrame, family: str, tier: str) -> DataFrame:
    table = F.broadcast(asr_models(df.sparkSession).toDF("_family", "_tier", "model_id", "size_bytes"))
    return df.join(table, (df[family] == table["_family"]) & (df[tier] == table["_tier"]), "left").drop("_family", "_tier")


def ocr_download_size(df: DataFrame, ocr_key: str) -> DataFrame:
    """Bytes of detector and recognizer of a language; none counts as 0."""
    table = F.broadcast(recognizers(df.sparkSession).select(F.col("ocr_key").alias("_key"), F.col("size_bytes").alias("_size")))
    return df.join(table, df[ocr_key] == table["_key"], "left").withColumn("ocr_bytes", F.lit(OCR_DETECTOR[1]) + F.coalesce("_size", F.lit(0))).drop("_key", "_size")


def size_in(detail):
    """Size of the first known model whose name a text contains, as a label; null without any."""
    from .text import size_label

    out = None
    for name, size in [OCR_DETECTOR, *((n, b) for _, n, b in OCR_RECOGNIZERS), *((m, b) for _, _, m, b in ASR_MODELS)]:
        out = (F if out is None else out).when(F.contains(detail, F.lit(name)), size_label(F.lit(size)))
    return out
