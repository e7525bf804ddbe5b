"""Language identification by cross-parsing against suffix automata.

Labelled text of each language becomes a suffix automaton. A text is parsed into phrases, each the longest match
from where the last one ended. With c phrases against n learnt symbols a text's cross-parsing entropy is c log n for
each of its letters; the language with the lowest wins. Texts are parsed as the UTF-8 bytes of their letters, so
no letter of any script is folded into others. The automata are completed to dense tables, one per language: a step by
a byte either extends the match or ends the phrase and starts the next one. A batch's texts are cut into chunks
that step through the tables side by side; then the phrase that is open at a chunk's end is carried over the cut,
and the chunk after it is parsed again up to where both parses agree.

An automaton learns from a bounded sample: ``SAMPLE_DOCS`` documents with the smallest hashes of their ids, and of each
a window of its share of ``SAMPLE_BYTES``, the windows spread evenly over beginnings, middles and ends. Where there
are so many languages that the tables would outgrow ``TABLE_BYTES``, each learns less. Parsing reads every text whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, texts
from .store import materialize
from .toxicity import held_out, smallest_hashes

SAMPLE_DOCS = 200
SAMPLE_BYTES = 32_000
TABLE_BYTES = 96 << 20
#: Symbols of a chunk, and how far the chunk after a cut is parsed again before it is compared.
CHUNK, AGAIN = 256, 64
#: Chunks that step side by side.
LANES = 8192
UNKNOWN = "und"
SPACE, OTHER = 0, 1


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def table(step: list[dict[int, int]], width: int) -> np.ndarray:
    """Flat table of the automaton completed: at state * width + symbol, four times the next state's offset plus the
    phrases that end there (0 to 2). The last symbol pads and changes nothing. Only the root has no phrase open."""
    root = step[0]
    restart = np.array([4 * width * root[c] + 1 if c in root else 2 for c in range(width)], np.int32)
    out = np.tile(restart, (len(step), 1))
    out[0] = [4 * width * root[c] if c in root else 1 for c in range(width)]
    for s, ways in enumerate(step):
        for c, to in ways.items():
            out[s, c] = 4 * width * to
    out[:, width - 1] = np.arange(len(step)) * (4 * width)
    return out.ravel()


class Model:
    def __init__(self, samples: dict[str, list[str]], table_bytes: int = TABLE_BYTES) -> None:
        """``samples``: each language's texts, of which the beginnings are learnt, as many letters of each as of the others."""
        self._lower: np.ndarray | None = None
        self.names = sorted(samples)
        found = {name: [self._bytes([t])[0] for t in samples[name]] for name in self.names}
        used = np.unique(np.concatenate([np.zeros(0, np.uint8), *(x for own in found.values() for x in own)]))
        used = used[used != 32]
        self.symbol = np.full(256, OTHER, np.uint8)
        self.symbol[used], self.symbol[32] = np.arange(len(used)) + 2, SPACE
        self.width = len(used) + 3
        room = min(SAMPLE_BYTES, max(500, table_bytes // max(1, len(samples)) // (8 * self.width)))
        self.learnt = [self._learn(found[name], room) for name in self.names]
        self.tables = [table(automaton(x.tolist()), self.width) for x in self.learnt]
        self.weights = [math.log2(len(x) + 2) for x in self.learnt]
        self._lower = None  # each worker makes its own

    def _learn(self, found: list[np.ndarray], room: int) -> np.ndarray:
        share, out, left = max(240, -(-room // max(1, len(found)))), [], room
        for own in found:
            part = self.symbol[own[: min(share, left)]]
            out += [part, np.zeros(1, np.uint8)]
            left -= len(part) + 1
            if left <= 0:
                break
        return np.concatenate(out) if out else np.zeros(0, np.uint8)

    def lower(self) -> np.ndarray:
        """The code point of each letter in lower case, a space for all that is no letter."""
        if self._lower is None:
            out = np.full(0x110000, 32, np.uint32)
            for c in filter(str.isalpha, map(chr, range(0x110000))):
                out[ord(c)] = ord(low) if len(low := c.lower()) == 1 else ord(c)
            self._lower = out
        return self._lower

    def _bytes(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of all texts' letters in a row, runs of other than letters after a letter as one space; the text of
        each byte; and the letters that each text has."""
        codes = self.lower()[np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")]
        text = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
        letter = codes != 32
        counts = np.bincount(text[letter], minlength=len(found))
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (text[1:] == text[:-1])
        codes, text = codes[keep], text[keep]
        size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        return np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8), np.repeat(text, size), counts

    def phrases(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(languages, texts) phrases of each text; letters of each text."""
        raw, text, letters = self._bytes(found)
        totals = np.zeros((len(self.names), len(found)), np.int64)
        if not len(raw):
            return totals, letters
        starts = np.searchsorted(text, np.arange(len(found)))
        place = np.arange(len(raw)) - starts[text]
        begins = place % CHUNK == 0
        owner = text[begins]
        lanes = np.full((CHUNK, len(owner)), self.width - 1, np.uint8)
        lanes[place % CHUNK, begins.cumsum() - 1] = self.symbol[raw]
        last = np.append(owner[1:] != owner[:-1], True)
        for k, steps in enumerate(self.tables):
            ends, counts = _parse(steps, lanes, ~np.append(True, last[:-1]))
            totals[k] = np.bincount(owner, weights=counts + (last & (ends > 0)), minlength=len(found))
        return totals, letters

    def predict(self, found: list[str]) -> tuple[list[str], list[float]]:
        """The language of the lowest cross-parsing entropy, between equals the first by name; its lead over the next,
        0.5 to 1."""
        totals, letters = self.phrases(found)
        costs = totals * np.array(self.weights).reshape(-1, 1)
        names, scores = [], []
        for k, n in enumerate(letters.tolist()):
            if not n or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(costs[:, k], kind="stable")
            names.append(self.names[order[0]])
            best = float(costs[order[0], k])
            scores.append(1.0 if len(order) == 1 else float(costs[order[1], k]) / (best + float(costs[order[1], k])))
        return names, scores


def _run(steps: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes that start ``at`` end, and the phrases that end in them."""
    ended = np.zeros(len(at), np.int32)
    for row in rows:
        value = steps[at + row]
        ended += value & 3
        at = value >> 2
    return at, ended


def _parse(steps: np.ndarray, lanes: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each lane ends, and the phrases that end in it; a lane that ``follows`` starts where the one before ends."""
    n = lanes.shape[1]
    start, middle, early, end, count = (np.zeros(n, np.int32) for _ in range(5))
    for i in range(0, n, LANES):
        part = slice(i, i + LANES)
        middle[part], early[part] = _run(steps, lanes[:AGAIN, part], start[part])
        end[part], late = _run(steps, lanes[AGAIN:, part], middle[part])
        count[part] = early[part] + late
    while len(todo := np.flatnonzero(follows & (np.append(0, end[:-1]) != start))):
        start[todo] = end[todo - 1]
        at, ended = _run(steps, lanes[:AGAIN, todo], start[todo])
        apart = todo[at != middle[todo]]
        count[todo] += ended - early[todo]
        middle[todo], early[todo] = at, ended
        if len(apart):
            end[apart], late = _run(steps, lanes[AGAIN:, apart], middle[apart])
            count[apart] = early[apart] + late
    return end, count


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", table_bytes: int = TABLE_BYTES) -> Model:
    """Learn from rows with an id, text and language. Ids are picked first, ``SAMPLE_DOCS`` of a
    language; only these meet the texts. An id's least text stands for it."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = smallest_hashes(rows.select("id", "lang"), SAMPLE_DOCS, "lang").distinct().withColumn("n", place).where(F.col("n") <= SAMPLE_DOCS)
    met = rows.join(materialize(picked, "languages"), ["id", "lang"])
    # the n-th window lies n golden sections into its text; ten characters for each byte leave room for other than letters
    span = 10 * max(240, SAMPLE_BYTES // SAMPLE_DOCS)
    at = (F.col("n") * 0.6180339887 % 1) * F.greatest(F.length("text") - span, F.lit(0))
    cut = F.substring(F.col("text"), 1 + at.cast("int"), F.lit(span))
    samples: dict[str, list[str]] = {}
    for lang, text in met.groupBy("lang", "n").agg(F.min(cut).alias("text")).orderBy("lang", "n").select("lang", "text").toLocalIterator():
        samples.setdefault(lang, []).append(text)
    return Model(samples, table_bytes)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns only from rows that are not held out (crc32
    of the id as text, modulo 4, is not 2). Null texts and texts without a letter are ``und`` with score 0, as are all
    where nothing is labelled; malformed UTF-8 is no letter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(rows.where("NOT held_out"), "doc_id", "text", "lang", table_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        return list(shared.value.predict([x.decode("utf-8", "replace") for x in texts(batch.column(1), lower=False)]))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append(rows.select("doc_id", "text", "held_out"), fields, make, 500).select("doc_id", "held_out", "lang_pred", "score")
