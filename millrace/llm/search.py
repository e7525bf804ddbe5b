"""Exact top-k search by BM25 over sharded inverted indexes with block-max WAND on aligned blocks.

Documents are dealt into shards of bounded size; texts that are equal share a place in their shard. A shard keeps
its places in blocks, similar ones together, and for each term its postings and the largest impact in each block it
occurs in. All lists of a shard are cut at the same places, so the pivot test of block-max WAND is one sum: what
the current blocks of all the query's lists can add up to. The cursors of all lists move together, in document order,
to the next pivots, blocks whose sum reaches the k-th best score so far, and skip the postings between. As Python
pays for every step, cursors take a window of pivots at a time, tested again before each. A window's places are first
scored nearly: the commonest terms of a shard are a matrix, multiplied with many queries at once in single precision,
and the others' postings are added. What the error of that leaves in the running is scored exactly, term by term.

The heap of a query lives as long as its task, over all of the task's shards, and starts from the best of the rounds
before: the first round searches some ``FIRST`` shards, each later one ``FIRST`` times as many as are done. So a query
makes some k rows for each shard of the first round and FIRST times k for each later one, however many shards there
are. Document frequencies and the mean length are global, so scores of all shards compare, and merging is exact.

Queries come in blocks of bounded size, each broadcast and run against every shard. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import small_batches, texts
from .store import materialize

K1, B = 1.2, 0.75
#: Documents and words of a shard at most, but for a single text of more words.
SHARD_DOCS, SHARD_WORDS = 12_000, 6_000_000
BLOCK = 64
#: Pivots of a query's first window; each window is twice the last.
WINDOW = 16
#: Shards of the first round of a search, and the growth of the later ones.
FIRST = 8
#: Terms of a shard in its matrix: those of more than one in ``COMMON`` of its places, and no more than fill ``CELLS``.
COMMON, CELLS = 32, 12_000_000
#: Queries that are multiplied at once.
TOGETHER = 128
#: Words whose numbers a builder holds before it counts them.
HELD_WORDS = 1_000_000
#: Query terms of one block of queries, repeats between queries counted.
QUERY_TERMS = 4_000_000
#: Scores are compared at nine decimal places; bounds give way by more than sums can err.
PLACES, SLACK = 9, 1e-8
HIT = "q long, doc_id long, score double"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """terms ascending; postings of term i at first[i]:first[i + 1], by place. ids at start[p]:start[p + 1] are those of
    place p, ascending, where ``known`` is false null and last."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, place: np.ndarray, tf: np.ndarray, lengths: np.ndarray, start: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.keys, self.first, self.place, self.tf, self.lengths, self.start, self.ids, self.known = keys, first, place, tf, lengths, start, ids, known

    def dump(self) -> bytes:
        """All but the keys, compressed, in the narrowest integers that hold the values."""
        out = io.BytesIO()
        np.savez(out, ids=self.ids, known=self.known, **{n: _narrow(getattr(self, n)) for n in ("place", "tf", "lengths", "start")}, sizes=_narrow(np.diff(self.first)))
        return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())

    @classmethod
    def load(cls, keys: np.ndarray, data: bytes) -> Shard:
        with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as f:
            first = np.concatenate([[0], np.cumsum(f["sizes"], dtype=np.int64)])
            return cls(keys, first, f["place"].astype(np.int32), f["tf"], f["lengths"].astype(np.int64), f["start"].astype(np.int64), f["ids"], f["known"])

    def frequencies(self) -> np.ndarray:
        """Documents that have each term; copies count."""
        copies = np.diff(self.start)
        return np.add.reduceat(copies[self.place], self.first[:-1]) if len(self.place) else np.zeros(0, np.int64)

    def prepare(self, mean: float) -> None:
        """Impacts (without idf) of all postings, and their maxima by term and block."""
        norm = K1 * (1 - B + B * self.lengths / max(mean, 1e-9))
        self.impact = self.tf * (K1 + 1) / (self.tf + norm[self.place])
        block = self.place // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[self.first[:-1]] = True
        self.run = np.append(np.flatnonzero(new), len(block))
        self.run_block = block[self.run[:-1]]
        self.run_max = np.maximum.reduceat(self.impact, self.run[:-1]) if len(block) else np.zeros(0)
        self.run_first = np.searchsorted(self.run, self.first)
        self.scored = 0
        places, sizes = len(self.lengths), np.diff(self.first)
        common = np.flatnonzero(sizes * COMMON > places)
        common = np.sort(common[np.argsort(-sizes[common], kind="stable")[: CELLS // max(places, 1)]])
        self.row = np.full(len(sizes), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), places), np.float32)
        for row, term in enumerate(common.tolist()):
            own = slice(self.first[term], self.first[term + 1])
            self.matrix[row, self.place[own]] = self.impact[own]
        # sums of so many terms above 0, rounded at each step, and their factors before
        self.error = (len(common) + 8) * 2.0**-23
        by_place = np.argsort(_narrow(self.place), kind="stable")
        self.place_first = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=places))])
        # once more by place: a place's postings stand together
        self.own_term = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_place]
        self.own_impact = self.impact[by_place]
        self.weight = np.zeros(len(sizes))

    def search_all(self, asked: list[tuple], k: int) -> list[list[tuple]]:
        """``search`` for many (at, idf, best)."""
        out = []
        for i in range(0, len(asked), TOGETHER):
            some = asked[i : i + TOGETHER]
            rows = [self.row[at] for at, _, _ in some]
            weights = np.zeros((len(some), len(self.matrix)), np.float32)
            for own, there, (_, idf, _) in zip(weights, rows, some, strict=True):
                own[there[there >= 0]] = idf[there >= 0]
            near = weights @ self.matrix
            for mine, there, (at, idf, best) in zip(near, rows, some, strict=True):
                rare = at[there < 0]
                lo, hi = self.first[rare], self.first[rare + 1]
                post = _ranges(lo, hi)
                mine = mine + np.bincount(self.place[post], weights=self.impact[post] * np.repeat(idf[there < 0], hi - lo), minlength=len(mine))
                self.weight[at] = idf
                out.append(self.search(at, idf, best, k, mine))
                self.weight[at] = 0
        return out

    def search(self, at: np.ndarray, idf: np.ndarray, best: list[tuple], k: int, near: np.ndarray | None = None) -> list[tuple]:
        """``best``, the k best (-score, null, id) so far, with this shard's: terms ``at`` (ascending places in keys).
        ``near`` has scores that may err by ``error`` of themselves; ``weight`` then has the terms' weights."""
        a, b = self.run_first[at], self.run_first[at + 1]
        runs, weight = _ranges(a, b), np.repeat(idf, b - a)
        block = self.run_block[runs]
        bound = np.bincount(block, weights=self.run_max[runs] * weight, minlength=-(-len(self.lengths) // BLOCK))
        bound[bound > 0] += SLACK
        score = (lambda blocks, best: self._score(blocks, runs, block, weight, best, k)) if near is None else (lambda blocks, best: self._score_near(blocks, near, best, k))
        # where scores are nearly known, those of all pivots are one window
        least, cursor, window = _least(best, k), 0, WINDOW if near is None else len(bound)
        if not least:  # nothing to beat yet: begin where most can be had
            most = np.sort(np.argpartition(bound, -4)[-4:]) if len(bound) > 4 else np.arange(len(bound))
            best = score(most[bound[most] > 0], best)
            bound[most], least = 0, _least(best, k)
        while len(pivots := cursor + np.flatnonzero(bound[cursor:] >= max(least, SLACK))):
            best = score(pivots[:window], best)
            cursor, least, window = int(pivots[:window][-1]) + 1, _least(best, k), 2 * window
        return best

    def _score(self, blocks: np.ndarray, runs: np.ndarray, block: np.ndarray, weight: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        open_ = np.zeros(-(-len(self.lengths) // BLOCK), bool)
        open_[blocks] = True
        # in the order of terms, so that the sum of a document is the same whatever it is met with
        mine = np.flatnonzero(open_[block])
        lo, hi = self.run[runs[mine]], self.run[runs[mine] + 1]
        post = _ranges(lo, hi)
        scores = np.bincount(self.place[post], weights=self.impact[post] * np.repeat(weight[mine], hi - lo))
        self.scored += BLOCK * len(blocks)
        return self._enter(np.arange(len(scores)), scores, best, k)

    def _score_near(self, blocks: np.ndarray, near: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        places = (BLOCK * blocks[:, None] + np.arange(BLOCK)).ravel()
        places = places[places < len(near)]
        self.scored += BLOCK * len(blocks)
        mine, floor = near[places], _least(best, k) - SLACK
        if len(mine) > k:
            floor = max(floor, np.partition(mine, -k)[-k] * (1 - self.error) - SLACK)
        places = places[(mine > 0) & (mine * (1 + self.error) >= floor)]
        lo, hi = self.place_first[places], self.place_first[places + 1]
        post = _ranges(lo, hi)
        # in the order of terms, as in _score
        return self._enter(places, np.bincount(np.repeat(np.arange(len(places)), hi - lo), weights=self.own_impact[post] * self.weight[self.own_term[post]], minlength=len(places)), best, k)

    def _enter(self, places: np.ndarray, scores: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        found = np.flatnonzero((scores > 0) & (scores >= _least(best, k) - SLACK))
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - SLACK]
        if not len(found):
            return best
        rows = list(best)
        for place, score in zip(places[found].tolist(), np.round(scores[found], PLACES).tolist(), strict=True):
            i, j = self.start[place], min(self.start[place + 1], self.start[place] + k)
            rows += [(-score, not known, int(x)) for x, known in zip(self.ids[i:j], self.known[i:j], strict=True)]
        return sorted(rows)[:k]


def _least(best: list[tuple], k: int) -> float:
    return -best[-1][0] if len(best) == k else 0.0


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0]..b[0]-1, a[1]..b[1]-1, ..."""
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Builder:
    """Gathers documents into a shard."""

    def __init__(self) -> None:
        self.number, self.at, self.ids = _Numbers(), {}, []
        self.lengths, self.top = [], []
        self.held, self.held_words, self.parts = [], 0, []
        self.docs = self.words = 0

    def add(self, key: int | None, text: bytes) -> None:
        place = self.at.setdefault(xxhash.xxh3_128_digest(text), len(self.at))
        self.docs += 1
        if place < len(self.ids):
            self.ids[place].append(key)
            self.words += self.lengths[place]
            return
        words = text.split()
        self.ids.append([key])
        self.lengths.append(len(words))
        self.words += len(words)
        self.held.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.held_words += len(words)
        if self.held_words >= HELD_WORDS:
            self._count()

    def _count(self) -> None:
        """The held texts' (place, term, times)."""
        sizes = [len(x) for x in self.held]
        begin = len(self.ids) - len(sizes)
        pairs, tf = np.unique(np.repeat(np.arange(begin, len(self.ids)), sizes) << 32 | np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        place, term = pairs >> 32, pairs & 0xFFFFFFFF
        self.parts.append((place.astype(np.int32), term.astype(np.int32), tf.astype(np.int32)))
        # each text's commonest word, as a stand-in for its language
        top = np.full(len(sizes), -1)
        if len(place):
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            top[place[starts] - begin] = np.maximum.reduceat(tf << 32 | term, starts) & 0xFFFFFFFF
        self.top.append(top)
        self.held, self.held_words = [], 0

    def shard(self) -> Shard:
        self._count()
        place, term, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number)).view(np.int64)
        lengths, top = np.array(self.lengths, np.int64), np.concatenate(self.top)
        # by the commonest word, then by length: blocks of like documents bound tightly
        order = np.lexsort((lengths, np.append(keys, 0)[top]))
        moved = np.argsort(order)
        by_key = np.argsort(keys)
        rank = np.argsort(by_key)
        sort = np.argsort(rank[term] * len(order) + moved[place])
        ids = [sorted(self.ids[p], key=lambda x: (x is None, x or 0)) for p in order]
        flat = [x for own in ids for x in own]
        start = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(keys))[by_key])])
        return Shard(keys[by_key], first, moved[place[sort]].astype(np.int32), tf[sort], lengths[order], start, np.array([x or 0 for x in flat], np.int64), np.array([x is not None for x in flat], bool))


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard (a random number), docs, words, terms, dfs (arrays), index (the rest of a shard) of doc_id and text. A
    partition's rows are cut into shards as they come, so none grows with a crowded partition."""
    names = ["docs", "words", "terms", "dfs", "index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Builder()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                now.add(key, text)
                if now.docs >= shard_docs or now.words >= shard_words:
                    yield made(now)
                    now = Builder()
        if now.docs:
            yield made(now)

    def made(now: Builder) -> pa.RecordBatch:
        shard = now.shard()
        arrays = [pa.array([now.docs], pa.int64()), pa.array([now.words], pa.int64()), *(pa.ListArray.from_arrays([0, len(x)], pa.array(x, pa.int64())) for x in (shard.keys, shard.frequencies())), pa.array([shard.dump()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    made_index = small_batches(docs).select("doc_id", "text").mapInArrow(run, "docs long, words long, terms array<long>, dfs array<long>, index binary")
    return materialize(made_index.withColumn("shard", F.xxhash64(F.monotonically_increasing_id())), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """q, terms (hashes of the distinct words, ascending) of q and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, set(t.split())), np.uint64).view(np.int64)) for t in texts(batch.column(1))]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], names=["q", "terms"])

    return small_batches(queries).select("q", "text").mapInArrow(run, "q long, terms array<long>")


class Block:
    """Some queries: numbers, and the terms of query i at first[i]:first[i + 1] of ``refs``, places in ``keys``; the
    documents that have each key; the best rows of earlier rounds."""

    def __init__(self, found: pa.Table, frequencies: pa.Table) -> None:
        flat = found.column("terms").combine_chunks().flatten().to_numpy()
        self.q = found.column("q").to_numpy()
        self.first = np.concatenate([[0], np.cumsum(found.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
        df = frequencies.sort_by("term")
        self.keys, self.df = df.column("term").to_numpy(), df.column("df").to_numpy()
        self.refs = np.searchsorted(self.keys, flat).astype(np.int32)
        self.best: dict[int, list[tuple]] = {}


def _search(block, number: int, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Block = block.value
        idf = np.log(1 + (number - asked.df + 0.5) / (asked.df + 0.5))
        heaps = [asked.best.get(q, []) for q in asked.q.tolist()]
        for batch in batches:
            for terms, data in zip(batch.column(0), batch.column(1), strict=True):  # one shard at a time
                shard = Shard.load(terms.values.to_numpy(), data.as_py())
                if not len(shard.keys):
                    continue
                shard.prepare(mean)
                at = np.minimum(np.searchsorted(shard.keys, asked.keys), len(shard.keys) - 1)
                there = shard.keys[at] == asked.keys
                for i in range(0, len(heaps), TOGETHER):
                    mine = {}
                    for j in range(i, min(i + TOGETHER, len(heaps))):
                        own = asked.refs[asked.first[j] : asked.first[j + 1]]
                        if len(own := own[there[own]]):
                            mine[j] = at[own], idf[own], heaps[j]
                    for j, heap in zip(mine, shard.search_all(list(mine.values()), k), strict=True):
                        heaps[j] = heap
        # what is new; a repeated row equals the one before and counts again
        rows = [(q, None if row[1] else row[2], -row[0]) for q, heap in zip(asked.q.tolist(), heaps, strict=True) for row in (Counter(heap) - Counter(asked.best.get(q, ()))).elements()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, key: str, k: int) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answers(index: DataFrame, shards: int, block: Block, number: int, mean: float, k: int) -> DataFrame:
    """The k best (q, doc_id, score) of each query of a block, in rounds over more and more shards."""
    spark, done, hits = index.sparkSession, 0, None
    while done < shards:
        goal = min(shards, FIRST * max(done, 1))
        # shards bear random numbers: a round takes those in a range of them
        span, low = 1 << 20, F.pmod(F.col("shard"), F.lit(1 << 20))
        part = index.where((low >= span * done // shards) & (low < span * goal // shards)).select("terms", "index")
        shared = spark.sparkContext.broadcast(block)
        found = materialize(part.mapInArrow(_search(shared, number, mean, k), HIT), "hits")
        shared.unpersist()
        hits = materialize(_ranked(found if hits is None else hits.unionByName(found), "q", k).drop("rank"), "best")
        if goal < shards:
            block.best = {}
            for row in hits.collect():  # at most k for each query of the block
                block.best.setdefault(row.q, []).append((-row.score, row.doc_id is None, row.doc_id or 0))
            for rows in block.best.values():
                rows.sort()
        done = goal
    return hits


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = QUERY_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: for each query (query_id, text) the k rows of the index with the highest BM25
    scores above 0 (before they are rounded), ties by doc_id, null last. A query's distinct words count once each; equal texts are asked once."""
    spark = index.sparkSession
    number, words, shards = (x or 0 for x in index.agg(F.sum("docs"), F.sum("words"), F.count("*")).first())
    members = materialize(queries.where("query_id IS NOT NULL").select("query_id", F.sha2("text", 256).alias("key"), "text").dropDuplicates(["query_id", "key"]), "queries")
    asked = members.groupBy("key").agg(F.min("query_id").alias("first"), F.first("text").alias("text"))
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    terms = materialize(query_terms(asked.select("q", "text")), "query-terms")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    met = materialize(terms.select(F.explode("terms").alias("term")).distinct().join(counted, "term"), "frequencies")
    result = spark.createDataFrame([], HIT)
    for turn in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == turn)
        needed = met if blocks == 1 else met.join(own.select(F.explode("terms").alias("term")).distinct(), "term")
        block = Block(own.toArrow(), needed.toArrow())
        if len(block.q):
            result = result.unionByName(_answers(index, shards, block, number, words / max(number, 1), k))
    hits = members.join(asked.select("q", "key"), "key").join(result, "q")
    return _ranked(hits, "query_id", k).select("query_id", "rank", "doc_id", "score")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 100, k: int = 10, shard_docs: int = SHARD_DOCS, block_terms: int = QUERY_TERMS) -> DataFrame:
    """The rows whose id is divisible by ``every``, each as a query, against all rows. Null and empty texts match
    nothing; of repeated query rows one is asked, and rows that share an id with different texts are one query id
    ranked together; repeated rows are found as often as they occur."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = build(rows, shard_docs)
    return top_k(index, rows.where(F.col("doc_id") % every == 0).withColumnRenamed("doc_id", "query_id"), k, block_terms)
