"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_bytes
from .schema import FILES, MAX_FILE_SIZE


def scan(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content, name of the files under ``path``. A filter on length reaches the
    scan, so the bytes of excluded files are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def empty_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files of no bytes, which Spark's scans pass over; listed by the driver, a few calls for each file."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, recursive), []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), None, 0, bytearray()))
    return named(spark.createDataFrame(found, FILES))


def scan_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """The same for files that keep arriving."""
    reader = spark.readStream.format("binaryFile").schema(FILES)
    return named((reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path))


def named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def in_order(files: DataFrame, *order: str, to: str = "ordinal") -> DataFrame:
    """``files`` with a number that rises in the given order, by name and path where none is given; it has gaps."""
    return files.orderBy(*(order or ("name", "path"))).withColumn(to, F.monotonically_increasing_id())


def pasted_images(items: DataFrame) -> DataFrame:
    """Of pasted items (kind, mime, ...) the images."""
    return items.where((F.col("kind") == "file") & F.startswith("mime", F.lit("image/")))


def within_limit(files: DataFrame, limit: int = MAX_FILE_SIZE) -> DataFrame:
    return files.where(F.col("length") <= limit)


def too_large(files: DataFrame, limit: int = MAX_FILE_SIZE) -> DataFrame:
    """Files beyond the limit with their error; their content is not selected, so it is not read."""
    message = F.concat(F.lit("This file is "), format_bytes(F.col("length")), F.lit(" — the limit is "), format_bytes(F.lit(limit)), F.lit(". Split it into smaller files or reduce the resolution."))
    return files.where(F.col("length") > limit).select("path", "name", "length", F.struct(F.lit("too-large").alias("code"), message.alias("message")).alias("error"))
