"""Registered queries over stores and streams: the log of changes, archives, silences."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..operators import archives, contained, trigrams
from ..operators.offsets import running
from ..sources import audio as recordings
from ..sources import ranges
from ..sources.changelog import ChangeLog
from ..sources.scratch import scratch_path
from ..streaming import progress, timeouts
from .catalogue import crc_sql, query, table, values


@query("""
    WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'again' WHEN quality = 1 THEN 'good ' || source ELSE source END AS source, md5(d.text) AS text_md5
    FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) = 0 OR quality = 1""")
def history_merged(spark, sf_dir):
    """Documents as a keyed table that is written, changed, deleted from, merged and changed again, as it stands in the end."""
    docs, marks = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels")
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    log = ChangeLog(spark, scratch_path(spark, "history"), docs.schema, ("doc_id",), fan=3)
    log.put(docs, unique=True)
    good = docs.join(marks.where("quality = 1"), "doc_id")
    log.put(good.select("doc_id", F.concat(F.lit("good "), "source").alias("source"), "text"))
    log.delete(marks.where("toxic = 1"))
    log.merge()
    log.put(good.where("toxic = 1").select("doc_id", F.lit("again").alias("source"), "text"))
    return log.read().select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g),
    x AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 3600 SECOND AS times_out, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, 'timeout' AS code, started, times_out, n FROM x WHERE times_out <= (SELECT max(ts) FROM events) - (SELECT to_microseconds(2 * ((epoch_us(max(ts)) - epoch_us(min(ts))) // 8 // 1000000 + 1) * 1000000) FROM events)""")
def live_timeouts(spark, sf_dir):
    """Events replayed as a stream in batches; up to where its watermark comes, users' silences of an hour."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    late = 2 * ((ends.hi - ends.lo) // 8 // 1_000_000 + 1) if ends.lo is not None else 1
    stream = timeouts.replayed(events, scratch_path(spark, "replayed"))
    found = timeouts.live_timeouts(stream, "user_id", "ts", 3600, f"{late} seconds")
    found = timeouts.drained(found, scratch_path(spark, "timeouts"), scratch_path(spark, "timeouts-state"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "times_out")})


def _archived(parts, key: str, part_order: list[str], most: int = 50_000) -> str:
    """Archives of ``parts`` in a folder of their own: as many as the format's count of entries needs."""
    spark, folder = parts.sparkSession, scratch_path(parts.sparkSession, "archives")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    archives.write_archives(parts.where(F.col(key).isNotNull()), folder, F.floor(F.col(key) / most), [key], part_order)
    return folder


@query(f"""
    WITH e AS (SELECT conv_id, 'chat ' || conv_id || '.md' AS name, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
    s AS (SELECT *, octet_length(encode(body)) AS size, 30 + octet_length(encode(name)) AS head FROM e)
    SELECT conv_id, name, CAST(sum(head + size) OVER (PARTITION BY conv_id // 50000 ORDER BY conv_id) - head - size AS BIGINT) AS local_offset, size, {crc_sql("body")} AS crc, md5(body) AS content_md5 FROM s""")
def parallel_archive(spark, sf_dir):
    """Conversations as archives of 50,000 ids each, a part for each turn, each archive written by all tasks; read back by
    directory and ranges."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("chat "), F.col("conv_id").cast("string"), F.lit(".md")).alias("name"), F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8").alias("data"))
    found = ranges.entry_contents(ranges.archives_at(spark, _archived(turns, "conv_id", ["turn"])).where("name IS NOT NULL").repartition("path", "no"))
    return found.select(F.regexp_extract("name", r"(-?\d+)", 1).cast("long").alias("conv_id"), "name", "local_offset", "size", "crc", F.md5("content").alias("content_md5"))


@query("""
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS content_md5 FROM documents d
    WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def archive_entries(spark, sf_dir):
    """Documents in archives; of the directories the entries of toxic documents, and of the archives their ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("data"))
    entries = ranges.archives_at(spark, _archived(docs, "doc_id", [])).where("name IS NOT NULL").withColumn("doc_id", F.col("name").cast("long"))
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    found = ranges.entry_contents(entries.join(wanted, "doc_id", "left_semi").repartition("path", "no"))
    return found.select("doc_id", "size", F.md5("content").alias("content_md5"))


@query("""
    WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, ((CAST(floor(value * 100) AS BIGINT) & 65535) - 32768) / CAST(32768 AS DOUBLE) AS v FROM events),
    n AS (SELECT CAST(floor(count(*) / 2.5 + 0.5) AS BIGINT) AS n, count(*) AS frames FROM e),
    c AS (SELECT k AS chunk_no, k * 900 AS start, least(k * 900 + 1000, n) AS stop, frames FROM n, (SELECT unnest(generate_series(0, CASE WHEN n <= 1000 THEN 0 ELSE CAST(ceil((n - 1000) / 900.0) AS BIGINT) END)) AS k FROM n)),
    j AS (SELECT chunk_no, start, stop, frames, unnest(generate_series(start, stop - 1)) AS j FROM c)
    SELECT CAST(chunk_no AS INTEGER) AS chunk_no, start, stop, CAST(sum((j - start + 1) * CAST(floor(CAST(CAST(a.v + (b.v - a.v) * (j * CAST(2.5 AS DOUBLE) - floor(j * CAST(2.5 AS DOUBLE))) AS FLOAT) AS DOUBLE) * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS checksum
    FROM j JOIN e a ON a.i = least(CAST(floor(j * CAST(2.5 AS DOUBLE)) AS BIGINT), frames - 1) JOIN e b ON b.i = least(CAST(floor(j * CAST(2.5 AS DOUBLE)) AS BIGINT) + 1, frames - 1) GROUP BY ALL""")
def range_recording(spark, sf_dir):
    """Events' values as one recording at 40 kHz, written at offsets by all tasks; its chunks from their own ranges of bytes."""
    value = F.floor(F.col("value") * 100).bitwiseAND(F.lit(65_535).cast("long")) - 32_768
    frames = running(table(spark, sf_dir, "events").select("event_id", value.alias("v")), ["event_id"], to="i")
    n = frames.count()
    # each frame two bytes, least first, a few thousand of them a row
    two = F.hex(F.pmod("v", F.lit(65_536)))
    frame = F.lpad(two, 4, "0")
    blocks = frames.groupBy(F.floor(F.col("i") / 4096).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.substring(frame, 3, 2), F.substring(frame, 1, 2)).alias("h")))).alias("f"))
    body = blocks.select((44 + F.col("b") * 8192).alias("offset"), F.unhex(F.array_join(F.transform("f", lambda x: x["h"]), "")).alias("data"))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, 40_000, 80_000, 2, 16, b"data", 2 * n)
    first = spark.range(1).select(F.lit(0).cast("long").alias("offset"), F.lit(head).alias("data"))
    path = scratch_path(spark, "recording") + ".wav"
    archives.write_placed(body.unionByName(first), path, 44 + 2 * n)
    chunks = recordings.chunks_of(spark.createDataFrame([(path,)], "path string"), size=1000, overlap=100)
    found = recordings.samples_of(chunks.repartition("chunk_no"))
    checksum = F.aggregate(F.arrays_zip("samples", F.sequence(F.lit(1), F.size("samples"))), F.lit(0).cast("long"), lambda acc, x: acc + x["1"] * F.floor(x["samples"].cast("double") * 1_000_000 + 0.5))
    return found.where("error IS NULL AND chunk_no IS NOT NULL").select("chunk_no", "start", F.col("end").alias("stop"), checksum.alias("checksum"))


SOUGHT = ["the", "  ZUVER ", "éqx", "ing and", "zzzzqqq", "license"]


@query(f"SELECT q AS query, doc_id FROM documents, (VALUES {values([(q,) for q in SOUGHT])}) t(q) WHERE contains(lower(text), lower(trim(q))) OR contains(lower(source), lower(trim(q)))")
def indexed_search(spark, sf_dir):
    """Several searches of the history's kind over an index of trigrams in blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = trigrams.build(docs, scratch_path(spark, "trigrams"), ("text", "source"))
    out = None
    for q in SOUGHT:
        found = index.search(q).select(F.lit(q).alias("query"), "doc_id")
        out = found if out is None else out.unionByName(found)
    return out


@query("""
    WITH p AS (SELECT item_id AS o, text[1:12] AS p FROM benchmark WHERE length(text) >= 12 UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text[1:7] FROM conversations WHERE length(text) >= 7)
    SELECT doc_id, (SELECT min(o) FROM p WHERE contains(d.text, p.p)) AS entry FROM documents d""")
def first_entry(spark, sf_dir):
    """Beginnings of benchmark passages and of turns as a catalog: the first entry that each document contains."""
    bench = table(spark, sf_dir, "benchmark").where(F.length("text") >= 12).select(F.col("item_id").alias("ord"), F.substring("text", 1, 12).alias("pattern"))
    turns = table(spark, sf_dir, "conversations").where(F.length("text") >= 7).select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.substring("text", 1, 7).alias("pattern"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained.first_contained(docs, "text", bench.unionByName(turns), to="entry").select("doc_id", "entry")


@query("""
    WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), kind AS (SELECT min(event_type) AS asks FROM events),
    q AS (SELECT user_id, t FROM e, kind WHERE event_type = asks), m AS (SELECT user_id, event_id, t FROM e, kind WHERE event_type <> asks),
    j AS (SELECT m.event_id FROM m JOIN q ON q.user_id = m.user_id AND m.t >= q.t AND m.t < q.t + 600000000)
    SELECT 'answered' AS name, count(*) AS n, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS ids FROM j UNION ALL SELECT 'said', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM m""")
def stream_messages(spark, sf_dir):
    """Events as two streams: those of the first type ask, others are messages; within ten minutes behind a request they count.
    What a listener has gathered while the streams ran."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    asks = events.agg(F.min("event_type")).first()[0]
    ends = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    late = 2 * (((ends.hi or 0) - (ends.lo or 0)) // 4_000_000 + 1)
    stream = timeouts.replayed(events, scratch_path(spark, "messages"), batches=4)
    requests, messages = stream.where(F.col("event_type") == F.lit(asks)), stream.where(F.col("event_type") != F.lit(asks))
    ids = F.coalesce(F.sum("event_id"), F.lit(0).cast("long"))
    said = progress.counted(messages, "said", ids=ids)
    found = progress.counted(progress.answered(requests, said, "user_id", "ts", f"{late} seconds", "600 seconds"), "answered", ids=ids)
    with progress.Progress(spark) as seen:
        timeouts.drained(found, scratch_path(spark, "answered"), scratch_path(spark, "answered-state"))
    return spark.createDataFrame([(name, seen.sums[name, "n"], seen.sums[name, "ids"]) for name in ("answered", "said")], "name string, n long, ids long")


@query("""
    SELECT user_id, CAST(CASE WHEN t > 0 THEN greatest(0, least(100, floor(100 * d / t + 0.5))) END AS INTEGER) AS percent, n
    FROM (SELECT user_id, arg_max(event_id % 37 - 3, (ts, event_id)) AS d, CAST(arg_max(event_id % 29, (ts, event_id)) AS DOUBLE) AS t, count(*) AS n FROM events GROUP BY user_id)""")
def job_percents(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 37 - 3).alias("done"), (F.col("event_id") % 29).alias("total"))
    return progress.percents(events, "user_id", order="at")
