"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

A url can match a rule only through one of its candidates: a suffix of its host at a dot, with a prefix of its path
as long as some rule's path. Candidates that the filter knows go to a join on the rule itself, which removes
false positives; the longest rule decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append
from .store import materialize, meet

#: A block is 8 lanes of 32 bits; a key sets one bit in each lane of its block.
LANES = 8
BITS_PER_KEY = 16
#: Bytes of a filter that are broadcast at once; a larger one is applied in ranges of its blocks, one after the other.
FILTER_BYTES = 64 << 20
_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


def lanes(found: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and lane masks (n, 8) of each hash."""
    block = (found >> np.uint64(32)) % np.uint64(blocks)
    bit = (found.astype(np.uint32)[:, None] * _SALT) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def build_filter(rules: DataFrame, blocks: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Blocks ``low`` to ``high`` of the filter of column ``key``: built by tasks, merged per block; only these blocks come
    to the driver."""
    high = blocks if high is None else high

    def run(batches):
        for batch in batches:
            block, mask = lanes(hashes(batch.column(0).to_pylist()), blocks)
            mine = (block >= low) & (block < high)
            yield pa.RecordBatch.from_arrays([pa.array(block[mine] - low), *(pa.array(mask[mine, k].astype(np.int64)) for k in range(LANES))], names=["block", *(f"m{k}" for k in range(LANES))])

    made = rules.select("key").mapInArrow(run, "block long, " + ", ".join(f"m{k} long" for k in range(LANES)))
    table = np.zeros((high - low, LANES), np.uint32)
    for row in made.groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(LANES))).toLocalIterator():
        table[row[0]] = row[1:]
    return table


def might_hold(table: np.ndarray, keys: list[str], blocks: int | None = None, low: int = 0) -> np.ndarray:
    """Which keys the part of a filter from block ``low`` on does not rule out."""
    block, mask = lanes(hashes(keys), len(table) if blocks is None else blocks)
    at = block - low
    apart = (at < 0) | (at >= len(table))
    return apart | ((table[np.where(apart, 0, at)] & mask) == mask).all(axis=1)


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.islower() else host, path


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)]


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """key, verdict of (``host/path``, verdict) pairs."""
    return canonical(spark.createDataFrame(rules, "rule string, verdict string"))


def canonical(rules: DataFrame) -> DataFrame:
    """A-Z of the host in lower case; the rule is known by ``key`` = host + path."""
    at = F.locate("/", F.col("rule"))
    host = F.when(at > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule"))
    path = F.when(at > 0, F.expr("substring(rule, locate('/', rule))")).otherwise("")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # where a rule is listed with both verdicts, it blocks
    return rules.where("rule IS NOT NULL").select(F.concat(lower, path).alias("key"), F.length(path).alias("n"), "verdict").groupBy("key", "n").agg(F.max("verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (``default`` if none fits).

    ``rules`` comes from ``rules_table`` or ``canonical``. Null urls and urls without ``://`` have empty host and path
    and fit no rule. Repeated rows come out as often as they came in."""
    spark = pages.sparkSession
    rules = materialize(rules, "url-rules")
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    blocks = max(1, 1 << (rules.count() * BITS_PER_KEY // (32 * LANES)).bit_length())
    step = max(1, filter_bytes // (4 * LANES))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    for low in range(0, blocks, step):
        shared = spark.sparkContext.broadcast(build_filter(rules, blocks, low, min(blocks, low + step)))
        rows = materialize(_passed(rows, lengths, shared, blocks, low), "url-hits")
    # each host and path once, however many pages have it; pages without a hit join nothing
    same = F.struct("host", "path").alias("same")
    asked = rows.where(F.size("hits") > 0).select(same, "hits").groupBy("same").agg(F.first("hits").alias("hits"), F.count("*").alias("pages"))
    asked = materialize(asked, "url-asked")
    keys = asked.select("same", F.explode("hits").alias("key"))
    held = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).join(rules, "key"), "url-met")
    fits = meet(keys, held, "key", "size", held.agg(F.sum("size")).first()[0] or 0)
    best = fits.groupBy("same").agg(F.max(F.struct(F.length("key").alias("length"), (F.length("key") - F.col("n")).alias("host_length"), "key", "verdict")).alias("best"))
    judged = materialize(asked.drop("hits").join(best, "same", "left"), "url-best")
    met = meet(rows.where(F.size("hits") > 0).withColumn("same", same), judged, "same", "pages", judged.agg(F.sum("pages")).first()[0] or 0)
    plain = rows.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return met.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).unionByName(plain)


def _passed(rows: DataFrame, lengths: list[int], table, blocks: int, low: int) -> DataFrame:
    """(page_id, host, path, hits) of (page_id, url), or of such rows again: the candidates that a part of the filter passes."""

    def make(batch: pa.RecordBatch) -> list:
        if low:
            own = batch.column(3).to_pylist()
        else:
            parts = [split(u) for u in batch.column(1).to_pylist()]
            own = [candidates(h, p, lengths) for h, p in parts]
        flat = [k for ks in own for k in ks]
        held = might_hold(table.value, flat, blocks, low) if flat else np.zeros(0, bool)
        hits, at = [], 0
        for ks in own:
            hits.append([k for k, ok in zip(ks, held[at : at + len(ks)], strict=True) if ok])
            at += len(ks)
        return [hits] if low else [[h for h, _ in parts], [p for _, p in parts], hits]

    field = T.StructField("passed", T.ArrayType(T.StringType()))
    if low:
        return append(rows, [field], make).select("page_id", "host", "path", F.col("passed").alias("hits"))
    fields = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), field]
    return append(rows, fields, make).select("page_id", "host", "path", F.col("passed").alias("hits"))
