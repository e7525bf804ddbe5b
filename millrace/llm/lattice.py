"""Language-model scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary carry unigram scores. A word's probability is the sum over all ways to cut
it into pieces, the last of which ends the word, by a forward recursion in log space; a text's is the product over
its words and its end. Words repeat, so each distinct word is solved once, and documents meet the words' scores in
a join: words frequent enough to skew it are fewer than ``HOT_WORDS``, which bounds their broadcast.

The vocabulary comes with ranks only; they give the pieces' first scores, and expectation steps over the counts of
all training words turn them into probabilities. A training word is a piece, too: one more arc over the whole word,
in the same lattice; beside these arcs one more opens the reading by the vocabulary's pieces. A word's arc has its expected
uses, less an absolute discount estimated from the words that occur once and twice, as its score; what the discount leaves
of each word is read by the pieces, so these learn from words as kinds rather than by their counts, as words not met
before will be, and all that is left is the score of the arc that opens them. The score is a probability: words that
training has not seen share what is left by their spelling, where the base gives each of them the same.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .arrow import small_batches, steps, texts
from .store import materialize
from .tokens import vocabulary
from .toxicity import held_out

ROUNDS = 2
#: A word with over 1/HOT_WORDS of all training tokens, or of all tokens, is hot; each makes fewer than HOT_WORDS.
HOT_WORDS = 400_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 500_000
SUFFIX = "</w>"
#: So few words of one length are read one by one, place by place.
FEW = 12
#: Places of one word that are read at once, and a length up to which a word's pieces are looked up by their letters.
WINDOW, SHORT = 1 << 15, 64
#: Words that are solved together.
TOGETHER = 60_000
_STEP, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hash(letters: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Hashes of rows of letters, going on from those of what stands before them."""
    out = np.zeros(len(letters), np.uint64) if hashes is None else hashes
    for k in range(letters.shape[1]):
        out = (out + letters[:, k] + np.uint64(1)) * _STEP
        out = out ^ out >> np.uint64(32)
    return out


def together(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Pieces:
    """Numbers of the pieces that continue a word and of those that end it, and their log-probabilities; the last is
    that of no piece. ``open`` is the log-probability of the arc that leads to them; ``total`` is the uses of all arcs
    over whole words, of that one, and of ends.

    Words of one length are solved side by side; a few are solved one by one, in windows of their places, so that a word
    may be as long as a text. Pieces are found by 64-bit hashes of substrings. All recursions are in log space."""

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int], logs: np.ndarray, open: float = 0.0, total: float = 1.0) -> None:
        self.inner, self.final, self.open, self.total = inner, final, open, total
        self.none = len(inner) + len(final)
        self.logs = np.append(logs, -np.inf)
        self.longest = max(map(len, [*inner, *final]), default=1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}  # each worker makes its own

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing from the pieces' hashes to their numbers."""
        if not hasattr(self, "slots"):
            pieces = [*self.inner, *self.final]
            hashes = np.zeros(len(pieces), np.uint64)
            for same in _by_length(pieces):
                hashes[same] = _hash(np.frombuffer(b"".join([pieces[k] for k in same]), np.uint8).reshape(len(same), -1))
            hashes[len(self.inner) :] *= FINAL
            size = 1 << (4 * len(pieces)).bit_length()
            keys, numbers, left = np.zeros(size, np.uint64), np.full(size, self.none, np.int32), np.arange(len(pieces))
            at = (hashes >> np.uint64(30)) & np.uint64(size - 1)
            while len(left):
                free = left[keys[at[left]] == 0]
                keys[at[free]], numbers[at[free]] = hashes[free], free  # of several for one slot the last stays
                left = left[keys[at[left]] != hashes[left]]
                at[left] = (at[left] + np.uint64(1)) & np.uint64(size - 1)
            self.slots = keys, numbers
        return self.slots

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or of no piece."""
        keys, numbers = self._table()
        mask = np.uint64(len(keys) - 1)
        at = (hashes >> np.uint64(30)) & mask
        met = keys[at]
        out = np.where(met == hashes, numbers[at], self.none)
        left = np.flatnonzero((met != hashes) & (met != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            met = keys[at[left]]
            out[left] = np.where(met == hashes[left], numbers[at[left]], self.none)
            left = left[(met != hashes[left]) & (met != 0)]
        return out

    def _edges(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words that have a piece there, its number), by start, of words of one length."""
        n, none = len(words[0]), self.none
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        for start in range(n):
            hashes = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                hashes = _hash(letters[:, end - 1 : end], hashes)
                numbers = self._find(hashes * FINAL if end == n else hashes)
                hit = np.flatnonzero(numbers != none)
                if len(hit):
                    yield start, end, hit, numbers[hit]

    def _window(self, word: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, starts and numbers of the pieces of one word that end behind ``a`` and not behind ``b``, by their ends."""
        n, none, low = len(word), self.none, max(0, a + 1 - self.longest)
        ends, starts, numbers = [], [], []
        if n <= SHORT:
            for end in range(a + 1, b + 1):
                get = self.final.get if end == n else self.inner.get
                for start in range(max(0, end - self.longest), end):
                    if (k := get(word[start:end])) is not None:
                        ends.append(end)
                        starts.append(start)
                        numbers.append(k)
            return np.array(ends, np.int64), np.array(starts, np.int64), np.array(numbers, np.int64)
        letters = np.frombuffer(word, np.uint8, b - low, low).reshape(-1, 1)
        hashes = np.zeros(b - low, np.uint64)
        for size in range(1, min(self.longest, b - low) + 1):
            hashes = _hash(letters[size - 1 :], hashes[: len(letters) - size + 1].copy())
            first = max(0, a + 1 - size - low)
            at = np.arange(first, len(hashes))
            found = hashes[first:].copy()
            if b == n and len(found):
                found[-1:] *= FINAL
            number = self._find(found)
            hit = np.flatnonzero(number != none)
            starts.append(at[hit] + low)
            ends.append(at[hit] + low + size)
            numbers.append(number[hit].astype(np.int64))
        ends, starts, numbers = map(np.concatenate, (ends, starts, numbers))
        order = np.argsort(ends, kind="stable")
        return ends[order], starts[order], numbers[order]

    def _read(self, front: list[float], low: int, a: int, b: int, ends: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> list[float]:
        """``front``, the logs of the ways to each place from ``low`` to ``a``, extended to ``b``."""
        front, exp, log = list(front), math.exp, math.log
        cuts = np.searchsorted(ends, np.arange(a + 1, b + 2)).tolist()
        starts, weights = (starts - low).tolist(), weights.tolist()
        for i, j in zip(cuts, cuts[1:]):
            ways = [front[s] + w for s, w in zip(starts[i:j], weights[i:j])]
            best = max(ways, default=-math.inf)
            front.append(best + log(sum([exp(x - best) for x in ways])) if best > -math.inf else best)
        return front

    def _windows(self, n: int) -> list[tuple[int, int]]:
        return [(a, min(n, a + WINDOW)) for a in range(0, n, WINDOW)]

    def _along(self, word: bytes) -> tuple[float, list[tuple[int, list[float]]]]:
        """The log of all ways through one word; and for each window its lowest place and the logs up to its beginning.
        Beside these, what is held is one window's."""
        front, low, kept = [0.0], 0, []
        for a, b in self._windows(len(word)):
            new = max(0, a + 1 - self.longest)
            front, low = front[new - low :], new
            kept.append((low, front))
            ends, starts, numbers = self._window(word, a, b)
            front = self._read(front, low, a, b, ends, starts, self.logs[numbers])
        return front[-1], kept

    def _uses(self, word: bytes, kept: list[tuple[int, list[float]]], at_end: float, sums: np.ndarray) -> None:
        """Add the expected uses of pieces in one word to ``sums``: from the last window to the first, whose logs of ways
        to its places are found again. ``at_end``: the log of the word's uses less that of all its ways."""
        back = {len(word): at_end}
        for (a, b), (low, front) in reversed([*zip(self._windows(len(word)), kept, strict=True)]):
            ends, starts, numbers = self._window(word, a, b)
            weights = self.logs[numbers]
            front = np.array(self._read(front, low, a, b, ends, starts, weights))
            # in order of their starts, the later first, each piece's end is known
            behind = np.full(b - low + 1, -np.inf)
            for place, x in back.items():
                behind[place - low] = x
            behind = self._back(behind.tolist(), low, a, b, ends, starts, weights)
            np.add.at(sums, numbers, np.exp(front[starts - low] + weights + np.array(behind)[ends - low]))
            back = {low + k: x for k, x in enumerate(behind[: a - low + 1])}

    def _back(self, behind: list[float], low: int, a: int, b: int, ends: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> list[float]:
        exp, log1p = math.exp, math.log1p
        cuts = np.searchsorted(ends, np.arange(a + 1, b + 2)).tolist()
        starts, weights = (starts - low).tolist(), weights.tolist()
        for place in range(b, a, -1):
            then = behind[place - low]
            for k in range(cuts[place - a - 1], cuts[place - a]):
                s, way = starts[k], weights[k] + then
                now = behind[s]
                if now < way:
                    now, way = way, now
                behind[s] = now + log1p(exp(way - now)) if now > -math.inf else now
        return behind

    def _forward(self, words: list[bytes], edges: list) -> np.ndarray:
        front = np.full((len(words[0]) + 1, len(words)), -np.inf)
        front[0] = 0
        for start, end, hit, numbers in edges:
            front[end, hit] = np.logaddexp(front[end, hit], front[start, hit] + self.logs[numbers])
        return front

    def log_probs(self, words: list[bytes], whole: np.ndarray) -> np.ndarray:
        """Log-probability of each word over all cuts; ``whole`` has the logs of the words' own arcs."""
        out = np.full(len(words), -np.inf)
        for at in _by_length(words):
            same = [words[k] for k in at]
            out[at] = self._forward(same, self._edges(same))[-1] if len(same) > FEW else [self._along(w)[0] for w in same]
        return np.logaddexp(out + self.open, whole)

    def expect(self, words: list[bytes], counts: np.ndarray, whole: np.ndarray, discount: float, sums: np.ndarray) -> np.ndarray:
        """The uses that the words' own arcs keep, in words that occur ``counts`` times; the expected uses of the other
        pieces, in what is left of the words, are added to ``sums``."""
        kept = np.zeros(len(words))
        for at in _by_length(words):
            same = [words[k] for k in at]
            if len(same) <= FEW:
                for k, word in zip(at, same, strict=True):
                    ways, fronts = self._along(word)
                    own = np.exp(whole[k] - np.logaddexp(whole[k], ways + self.open))
                    kept[k] = max(counts[k] * own - discount, 0)
                    left = counts[k] - kept[k]
                    if left > 0 and ways > -math.inf:
                        self._uses(word, fronts, math.log(left) - ways, sums)
                continue
            edges = list(self._edges(same))
            front = self._forward(same, edges)
            own = np.exp(whole[at] - np.logaddexp(whole[at], front[-1] + self.open))
            kept[at] = np.maximum(counts[at] * own - discount, 0)
            back = np.full_like(front, -np.inf)
            back[-1] = np.log(counts[at] - kept[at]) - front[-1]
            for start, end, hit, numbers in reversed(edges):
                way = self.logs[numbers] + back[end, hit]
                back[start, hit] = np.logaddexp(back[start, hit], way)
                np.add.at(sums, numbers, np.exp(front[start, hit] + way))
        return kept


def _by_length(words: list[bytes], most: int = 4000) -> Iterator[np.ndarray]:
    """Places of the words of each length, ``most`` at once and fewer of very long ones."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        step = max(1, min(most, 40_000 // max(1, int(lengths[part[0]]))) if len(part) else 1)
        for i in range(0, len(part), step):
            yield part[i : i + step]


@cache
def ranked_pieces(path: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Ranks of inner and final pieces of a byte-level vocabulary with word ends."""
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    plain = {}
    for c in range(0x110000):  # every byte but those that UTF-8 does not use
        if len(plain) == 256 or c > 0x10FFFF:
            break
        if 0xD800 <= c < 0xE000 or c > 0x900 and c % 64:
            continue
        raw = chr(c).encode()
        plain.update(zip(level.pre_tokenize_str(chr(c))[0][0], raw, strict=True))
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    inner: dict[bytes, int] = {}
    final: dict[bytes, int] = {}
    for piece, rank in vocab.items():
        ends = piece.endswith(SUFFIX)
        letters = piece.removesuffix(SUFFIX)
        if letters and all(c in plain for c in letters):
            (final if ends else inner)[bytes(plain[c] for c in letters)] = rank
    for b in range(256):  # any word can be read byte by byte
        inner.setdefault(bytes([b]), len(vocab))
        final.setdefault(bytes([b]), len(vocab))
    return inner, final


def first_pieces(path: str) -> Pieces:
    """Scores by rank alone, as in Zipf's law."""
    inner, final = ranked_pieces(path)
    weight = 1 / (100 + np.array([*inner.values(), *final.values()], float))
    return Pieces(*_numbered(inner, final), np.log(weight / weight.sum()))


def _numbered(inner: dict[bytes, int], final: dict[bytes, int]) -> tuple[dict[bytes, int], dict[bytes, int]]:
    return {p: k for k, p in enumerate(inner)}, {p: len(inner) + k for k, p in enumerate(final)}


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """word (binary), n (occurrences in all documents), c (in training documents) of ``text`` and ``held_out``, spread
    over the tasks by word; and the number of training documents. Counted in each task first; the table grows with
    the corpus."""
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), Counter()
        for batch in steps(batches):
            for text, held in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = others if held else trained
                own.update(text.split())
                own[b""] += 1  # a document counts as its end, the empty word
            if len(trained) + len(others) >= COUNTED:
                yield from _counted(trained, others)
                trained, others = Counter(), Counter()
        yield from _counted(trained, others)

    found = docs.select("text", "held_out").mapInArrow(run, "word binary, n long, c long")
    words = materialize(found.repartition(spread, "word").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    ends = words.where(F.length("word") == 0).select("c").first()
    return words.where(F.length("word") > 0), ends[0] if ends else 0


def _counted(trained: Counter, others: Counter) -> Iterator[pa.RecordBatch]:
    words = list(trained | others)
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        c = np.fromiter((trained[w] for w in part), np.int64, len(part))
        n = c + np.fromiter((others[w] for w in part), np.int64, len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(n), pa.array(c)], names=["word", "n", "c"])


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def fit(words: DataFrame, path: str, ends: int, discount: float, rounds: int = ROUNDS) -> tuple[DataFrame, Pieces, float]:
    """``words`` (word, n, c) with ``kept``, the uses of each word's own arc; the pieces with their probabilities; and the
    log-probability of a text's end. Each step writes the words with what they keep, and beside them its tasks' sums
    of the pieces' uses; a row for each piece of the vocabulary comes to the driver."""
    now = first_pieces(path)
    state = words.withColumn("kept", F.greatest(F.col("c") - F.lit(discount), F.lit(0.0)))
    kept, trained = (float(x or 0) for x in state.agg(F.sum("kept"), F.sum("c")).first())
    # half a use more for the opening arc and for the end, which none then lacks
    total = trained + ends + 1
    now.open, now.total = math.log((trained - kept + 0.5) / total), total
    names = ["word", "n", "c", "kept", "piece", "uses"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    for turn in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces: Pieces = shared.value
            sums = np.zeros(pieces.none + 1)
            for batch in together(batches):
                word, n, c, kept = batch.columns
                counts, new = c.to_numpy().astype(float), kept.to_numpy().copy()
                seen = np.flatnonzero(counts)
                if len(seen):
                    new[seen] = pieces.expect(word.take(pa.array(seen)).to_pylist(), counts[seen], _log(new[seen] / pieces.total), discount, sums)
                yield pa.RecordBatch.from_arrays([word, n, c, pa.array(new), *(pa.nulls(len(new), t) for t in kinds[4:])], names=names)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), t) for t in kinds[:4]), pa.array(used), pa.array(sums[used])], names=names)

        done = materialize(state.mapInArrow(run, "word binary, n long, c long, kept double, piece long, uses double"), f"lattice-{turn}")
        state, sums = done.where("word IS NOT NULL").select(*names[:4]), np.zeros(now.none)
        for r in done.where("piece IS NOT NULL").groupBy("piece").agg(F.sum("uses")).collect():
            sums[r[0]] = r[1]
        kept = float(state.agg(F.sum("kept")).first()[0] or 0)
        now = Pieces(now.inner, now.final, np.log((sums + 0.01) / (sums.sum() + 0.01 * now.none)), math.log((trained - kept + 0.5) / total), total)
    return state, now, math.log((ends + 0.5) / total)


def solve(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, c, lp: log10 of each word's probability. The words are spread over the tasks already."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            lps = shared.value.log_probs(batch.column(0).to_pylist(), _log(batch.column(3).to_numpy() / shared.value.total)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lps)], names=["word", "n", "c", "lp"])

    return words.mapInArrow(run, "word binary, n long, c long, lp double")


def _documents(hot):
    """Rows of (uid, doc_id, held_out, total, known, base, lp, words): a document's words, the sums over its hot words,
    and its other words, each once with its times. ``uid`` numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, known = TaskContext.get().partitionId() << 40, hot.value
        for batch in steps(batches, 200):
            uids, totals, sums, word, times, ends = [], [], [], [], [], [0]
            for text in texts(batch.column(2)):
                uid += 1
                uids.append(uid)
                counts = Counter(text.split())
                met = [(w, h) for w in counts if (h := known.get(w)) is not None]
                n = np.array([counts.pop(w) for w, _ in met], float)
                sums.append(n @ np.array([h for _, h in met], float) if met else (0.0, 0.0, 0.0))
                totals.append(int(n.sum()) + counts.total())
                word += counts
                times += counts.values()
                ends.append(len(word))
            sums = np.array(sums, float).reshape(-1, 3)
            inner = pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
            columns = [pa.array(uids, pa.int64()), *batch.columns[:2], pa.array(totals, pa.int64()), *(pa.array(x) for x in (sums[:, 0].astype(np.int64), sums[:, 1], sums[:, 2])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "held_out", "total", "known", "base", "lp", "words"])

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, score: bool = True) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Without ``score`` the model is
    not fitted, and that column is not there.

    Learns from documents whose crc32 of the id as text, modulo 5, is not 1, and from those without an id. Null texts
    are empty: their end alone. Repeated rows are scored one by one; without training rows every count is 0, and the
    pieces keep the scores that their ranks give."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", 5, 1) & F.col("doc_id").isNotNull())
    words, ends = count_words(rows)
    once, twice = (F.count(F.when(F.col("c") == k, 1)) for k in (1, 2))
    everything, trained, distinct, n1, n2 = (x or 0 for x in words.agg(F.sum("n"), F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), once, twice).first())
    tokens, distinct = trained + ends, distinct + (1 if ends else 0)
    floor = tokens + 0.5 * (distinct + 1)
    if score:
        words, pieces, end = fit(words, path or vocabulary(), ends, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, ROUNDS if tokens else 0)
        scored = materialize(solve(words, pieces), "word-scores")
    else:
        scored, end = words.select("word", "n", "c", F.lit(0.0).alias("lp")), 0.0
    base = F.log10((F.col("c") + 0.5) / F.lit(floor))
    is_hot = (F.col("n") > everything / HOT_WORDS) | (F.col("c") > tokens / HOT_WORDS)
    hot = {bytes(r[0]): tuple(r[1:]) for r in scored.where(is_hot).select("word", (F.col("c") > 0).cast("int"), base, "lp").collect()}
    schema = "uid long, doc_id long, held_out boolean, total long, known long, base double, lp double, words array<struct<word: binary, times: long>>"
    found = materialize(rows.select("doc_id", "held_out", "text").mapInArrow(_documents(docs.sparkSession.sparkContext.broadcast(hot)), schema), "documents")
    cold = scored.where(~is_hot).select("word", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"), "lp")
    met = found.select("uid", F.explode("words").alias("x")).select("uid", "x.word", "x.times").join(cold, "word")
    rest = met.groupBy("uid").agg(*(F.sum(F.col(c) * F.col("times")).alias(f"cold_{c}") for c in ("known", "base", "lp")))

    def whole(part: str):
        return F.col(part) + F.coalesce(f"cold_{part}", F.lit(0))

    sums = found.drop("words").join(rest, "uid", "left")
    out = sums.select("doc_id", "held_out", (F.col("total") + 1).alias("n_tokens"), (whole("known") + (1 if ends else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (whole("base") + math.log10((ends + 0.5) / floor)).alias("base_score"), (whole("lp") + end / math.log(10)).alias("score"))
    return out if score else out.drop("score")
