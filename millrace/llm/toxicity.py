"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, one of toxic and one of ordinary text, give each word a likelihood, letter by letter after the five
letters before it in the word. Both discount their own counts and back off to one shared Kneser-Ney model of the
lower orders, so an expression rare in either class costs both the same, and the difference of their
log-likelihoods comes only from what a class has seen. Toxic text being mostly ordinary words, a word of toxic text
has a mixture of both models as its likelihood. A text's two log-likelihoods are sums over all its words, repeats
included; their difference by the number of words, calibrated on labelled documents that the models were not trained
on, is the score. An expression is a word: letters before the word do not count.

A model is fitted on at most ``SAMPLE_DOCS`` documents of a class and ``SAMPLE_CHARS`` bytes, those with the
smallest hash of their id; scoring reads every text whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, texts
from .store import fresh

ORDER = 6
SAMPLE_DOCS = 1600
SAMPLE_CHARS = 6_000_000
#: Word scores that a worker remembers at most.
REMEMBERED = 150_000
#: Taken off a class's own counts; what it leaves to the shared model makes rare expressions say little.
DISCOUNT = 1.0
#: Toxic text is ordinary text but for this share of its words.
MIX = 0.01
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**62, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(id_col: str, parts: int, part: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in training and in scoring."""
    return text.split()


def letters_of(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


def smallest_hashes(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Of each group some 20 ``n`` rows (all of smaller groups), those with the smallest hashes of ``id``: the ``n`` smallest
    are among them, and ranking them is little work. The groups are labels or languages: their sizes are broadcast."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_of"))
    share = F.xxhash64("id") / F.lit(float(1 << 64)) + 0.5
    return rows.join(F.broadcast(sizes), list(keys)).where(share < 20.0 * n / F.col("_of")).drop("_of")


class Windows:
    """The n-grams of words: for each letter and each word's end, hashes of the 0 to 5 letters before it."""

    def __init__(self, words: list[str]) -> None:
        pad = "\x00" * (ORDER - 1)
        self.codes = np.frombuffer("".join(f"{pad}{w}\x01" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + ORDER)
        at = np.ones(len(self.codes), bool)
        starts = stops - lengths - ORDER
        for k in range(ORDER - 1):
            at[starts + k] = False
        self.at = np.flatnonzero(at)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths + 1)

    def taken(self, places: np.ndarray) -> Windows:
        """These places alone."""
        out = object.__new__(Windows)
        out.codes, out.at, out.word = self.codes, self.at[places], self.word[places]
        return out

    def context(self, length: int) -> np.ndarray:
        """Hash of the ``length`` letters before each letter; made anew each time, which is cheaper than to keep."""
        out = np.zeros(len(self.at), np.uint64)
        for k in range(1, length + 1):
            out = _mix(out + (self.codes[self.at - k].astype(np.uint64) + np.uint64(7)) * _MULTIPLIERS[k])
        return out

    def grams(self, order: int) -> np.ndarray:
        """n-gram of ``order`` letters: the letter after order - 1 others."""
        return _mix(self.context(order - 1) * np.uint64(3) + (self.codes[self.at].astype(np.uint64) + np.uint64(11)) * _MULTIPLIERS[0] + np.uint64(order))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _count(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first place of each, and the sum of its weights."""
    found, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, np.bincount(back, weights=weights, minlength=len(found))


def _discount(counts: np.ndarray) -> float:
    one, two = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return one / (one + 2 * two) if one and two else 0.75


class Model:
    """Log-likelihood ratios of n-grams: ``gram`` where a class has seen one, and of the backoff weights after a
    ``context`` that a class has seen; the shared lower orders cancel out wherever neither has seen the n-gram."""

    def __init__(self, toxic: Counter, ordinary: Counter) -> None:
        words = list(toxic | ordinary)
        w = Windows(words)
        top, first, back = np.unique(w.grams(ORDER), return_index=True, return_inverse=True)
        counts = []
        for c in (toxic, ordinary):
            own = np.fromiter((c[x] for x in words), float, len(words))
            counts.append(np.bincount(back, weights=own[w.word], minlength=len(top)))
        del back
        # what is shorter is the end of an n-gram, so the distinct n-grams have all of it
        w = w.taken(first)
        context = w.context(ORDER - 1)
        self.context, _, _ = _count(context, np.ones(len(context)))
        at = np.searchsorted(self.context, context)
        shared = self._shared(w, sum(counts), at)
        logs, backoff = [], []
        for c in counts:
            d = DISCOUNT
            total = np.bincount(at, weights=c, minlength=len(self.context))
            rest = np.where(total > 0, np.bincount(at, weights=np.minimum(c, d), minlength=len(self.context)) / np.maximum(total, 1), 1.0)
            backoff.append(np.log(rest))
            logs.append(np.log(np.maximum(c - d, 0) / np.maximum(total[at], 1) + rest[at] * shared))
        self.gram, self.gram_llr = top, (logs[0] - logs[1]).astype(np.float32)
        self.context_llr = (backoff[0] - backoff[1]).astype(np.float32)
        self.slope, self.offset = 1.0, 0.0

    @staticmethod
    def _shared(w: Windows, both: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Kneser-Ney probability of the n-grams at ``w`` from the counts of both classes, below the top order
        continuation counts."""
        prob = None
        for order in range(1, ORDER):
            grams, contexts = w.grams(order), w.context(order - 1)
            # continuation count: in how many longer n-grams it ends
            _, longer, _ = _count(w.grams(order + 1), np.ones(len(grams)))
            keys, spot, c = _count(grams[longer], np.ones(len(longer)))
            held = contexts[longer][spot]
            names, _, total = _count(held, c)
            at = np.searchsorted(names, held)
            kinds = np.bincount(at, minlength=len(names))
            d = _discount(c)
            lower = np.full(len(keys), 1.0 / max(len(keys), 1)) if prob is None else prob[np.searchsorted(below, w.grams(order - 1)[longer][spot])]
            prob = np.maximum(c - d, 0) / total[at] + d * kinds[at] / total[at] * lower
            below = keys
        lower = prob[np.searchsorted(below, w.grams(ORDER - 1))]
        d, total, kinds = _discount(both), np.bincount(context, weights=both), np.bincount(context)
        return np.maximum(both - d, 0) / total[context] + d * kinds[context] / total[context] * lower

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        w = Windows(words)
        at, seen = _find(self.gram, w.grams(ORDER))
        llr = np.where(seen, self.gram_llr[at] if len(self.gram) else 0.0, 0.0)
        at, known = _find(self.context, w.context(ORDER - 1))
        llr = np.where(~seen & known, self.context_llr[at] if len(self.context) else 0.0, llr)
        llr = np.bincount(w.word, weights=llr, minlength=len(words))
        return np.log(1 - MIX + MIX * np.exp(np.minimum(llr, 50)))

    def calibrate(self, means: np.ndarray, labels: np.ndarray, prior: float = 0.35) -> None:
        """Logistic fit of the mean ratio by Newton's method, classes weighted to ``prior``."""
        if not len(means) or labels.min() == labels.max():
            self.offset = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
            return
        weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
        x = np.column_stack([means, np.ones(len(means))])
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (weight * (labels - p)) - 1e-3 * beta
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            beta += np.clip(step, -20, 20)
            if np.abs(step).max() < 1e-7:
                break
        self.slope, self.offset = max(float(beta[0]), 1e-3), float(beta[1])


class Scorer(dict):
    """word -> ratio, for the words met last."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def means(self, found: Iterable[bytes]) -> np.ndarray:
        """Mean ratio per word of each text; 0 for texts without words."""
        split = [words_of(t) for t in found]
        new = list({w for ws in split for w in ws} - self.keys())
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list({w for ws in split for w in ws})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.update(zip(part, self.model.words([letters_of(w) for w in part]).tolist(), strict=True))
        get = self.__getitem__
        return np.array([sum(map(get, ws)) / len(ws) if ws else 0.0 for ws in split])

    def scores(self, found: Iterable[bytes]) -> np.ndarray:
        x = self.model.slope * self.means(found) + self.model.offset
        return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(label, held, text) in the order of the ids' hashes: for each label at most ``sample_docs`` documents to train on
    and a quarter of that, held, to calibrate with. Ids are picked first; only the picked ids, whose number is bounded,
    meet the texts, so no text is shuffled but those of the sample."""
    rank, held = F.xxhash64("id"), F.pmod(F.hash("id"), F.lit(5)) == 0
    known = docs.where("text IS NOT NULL").select("id").join(labels, "id").withColumn("held", held)
    known = smallest_hashes(known, sample_docs, "label", "held").withColumn("rank", rank)
    sizes = {(label, part): max(1, sample_docs // 4) if part else sample_docs for label in (0, 1) for part in (False, True)}
    picked = None
    for (label, part), n in sizes.items():
        own = known.where((F.col("label") == label) & (F.col("held") == part)).orderBy("rank", "id").limit(n)
        picked = own if picked is None else picked.unionByName(own)
    # ids can repeat in the documents: one text stands for each, so that none crowds out others
    met = docs.where("text IS NOT NULL").join(F.broadcast(picked.dropDuplicates(["id"])), "id")
    once = met.groupBy("label", "held", "rank", "id").agg(F.min("text").alias("text"))
    # as bytes: malformed UTF-8 passes
    return once.orderBy("label", "held", "rank", "id").select("label", "held", F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled documents. A fifth of them, by a hash of the id, calibrates and does not train. Ids labelled
    more than once count by their largest label."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts, chars, held = (Counter(), Counter()), Counter(), []
    for label, apart, raw in _sample(rows, known, sample_docs).toLocalIterator():
        text = bytes(raw).lower()
        chars[label, apart] += len(text)
        if chars[label, apart] > (sample_chars // 4 if apart else sample_chars) and chars[label, apart] > len(text):
            continue
        if apart:
            held.append((text, label))
        else:
            counts[label].update(map(letters_of, words_of(text)))
    model = Model(counts[1], counts[0])
    del counts
    scorer = Scorer(model)
    means = [scorer.means([text])[0] for text, _ in held]
    model.calibrate(np.array(means), np.array([label for _, label in held]))
    return model


def add_score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text. The model is as large as its bounded sample allows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, kept = docs.columns.index(text_col), []

    def make(batch: pa.RecordBatch) -> list:
        if not kept:
            kept.append(Scorer(shared.value))
        return [pa.array(kept[0].scores(texts(batch.column(at))), pa.float64())]

    return append(docs, [T.StructField(name, T.DoubleType())], make, 250)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **sample: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns only from rows that are not held out
    (crc32 of the id as text, modulo 5, is not 0). Null and wordless texts get the score of no evidence either way;
    without labels every document gets the same score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", 5, 0))
    model = train(rows.where("NOT held_out AND doc_id IS NOT NULL"), labels.withColumnRenamed(id_col, "doc_id"), "doc_id", "text", label_col, **sample)
    return add_score(rows, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **sample: int) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more, columns unchanged. Learns as ``judge`` does."""
    (score,) = fresh(docs, "score")
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull())
    model = train(known, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", "text", label_col, **sample)
    return add_score(docs, model, score, text_col).where(F.col(score) < threshold).select(*docs.columns)
