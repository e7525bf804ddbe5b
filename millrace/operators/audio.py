"""Transcripts: overlapping chunks and the words their transcripts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CHUNK_SECONDS, OVERLAP_SECONDS
from ..functions.lazy import bound
from ..functions.text import trim, words

LONGEST_OVERLAP, SHORTEST_OVERLAP = 12, 2


def _low(ws: Column) -> Column:
    """Words in lower case, by one call for all of them."""
    return F.split(F.lower(F.array_join(ws, " ")), " ")


def _last(ws: Column) -> Column:
    return F.slice(ws, F.greatest(F.size(ws) - LONGEST_OVERLAP + 1, F.lit(1)), LONGEST_OVERLAP)


def _shared(tail: Column, head: Column) -> Column:
    """How many words, 12 to 2, end ``tail`` and start ``head``, both in lower case and of 12 words at most; else 0."""
    most = F.least(F.size(tail), F.size(head))
    ks = F.when(most >= SHORTEST_OVERLAP, F.sequence(F.lit(SHORTEST_OVERLAP), most)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(ks, lambda k: F.slice(tail, F.size(tail) - k + 1, k) == F.slice(head, F.lit(1), k))), F.lit(0))


def _after(ws: Column, k: Column) -> Column:
    return F.slice(ws, k + 1, F.greatest(F.size(ws) - k, F.lit(0)))


def stitch(left: Column, right: Column) -> Column:
    """Two transcripts as one, without the longest run of 12 to 2 words that ends one and starts the other."""

    def joined(x: Column) -> Column:
        a, b = x["a"], x["b"]
        ends = F.struct(_low(_last(a)).alias("tail"), _low(F.slice(b, 1, LONGEST_OVERLAP)).alias("head"))
        k = bound(ends, lambda e: _shared(e["tail"], e["head"]))
        # without words on one side the other stands; words all shared leave the space before them
        return F.when(F.size(a) == 0, F.array_join(b, " ")).when(F.size(b) == 0, F.array_join(a, " ")).otherwise(F.concat_ws(" ", F.array_join(a, " "), F.array_join(_after(b, k), " ")))

    return bound(F.struct(words(left).alias("a"), words(right).alias("b")), joined)


def stitch_all(parts: Column) -> Column:
    """Fold of an ordered array of transcripts; a first part alone stays as it is. Each part's words are cut out once, and
    what is stitched so far is met by its last words only."""

    def step(acc: Column, part: Column) -> Column:
        def more(x: Column) -> Column:
            k = _shared(acc["tail"], _low(F.slice(x["b"], 1, LONGEST_OVERLAP)))
            return bound(_after(x["b"], k), lambda rest: F.struct(F.concat(acc["words"], F.array(rest)).alias("words"), _last(F.concat(acc["tail"], _low_or_none(_last(rest)))).alias("tail"), (F.size(rest) == 0).alias("open")))

        return bound(F.struct(words(part).alias("b")), more)

    def fold(kept: Column) -> Column:
        first = words(F.get(kept, F.lit(0)))
        start = F.struct(F.array(first).alias("words"), _low_or_none(_last(first)).alias("tail"), F.lit(False).alias("open"))
        # words all shared leave the space before them, if nothing follows
        whole = F.aggregate(_after(kept, F.lit(1)), start, step, lambda acc: F.concat(F.array_join(F.flatten(acc["words"]), " "), F.when(acc["open"], " ").otherwise("")))
        return F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(whole)

    return bound(F.filter(parts, lambda p: trim(p) != ""), fold)


def _low_or_none(ws: Column) -> Column:
    return F.when(F.size(ws) > 0, _low(ws)).otherwise(F.array().cast("array<string>"))


def event_windows(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(start, end, n): rows counted in the windows of recordings, 30 seconds every 28, by event time; of a stream, too."""
    over = F.window(ts, f"{CHUNK_SECONDS} seconds", f"{CHUNK_SECONDS - OVERLAP_SECONDS} seconds")
    return rows.groupBy(over.alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def transcripts(parts: DataFrame, id_col: str, order_col: str = "chunk_no", text_col: str = "text") -> DataFrame:
    """(id, text) of chunk transcripts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])
    return parts.groupBy(id_col).agg(ordered.alias("_parts")).select(id_col, stitch_all(F.col("_parts")).alias("text"))
