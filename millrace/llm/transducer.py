"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The tokenizer merges pieces in order of score (byte-pair merges over characters, unknown characters spelt as bytes). Its
tokens of a text are characterised locally: a sequence of pieces is the tokenizer's if and only if each piece is its own
encoding and each two neighbours are the encoding of their join, because a merge over a border would also happen in the
two alone. So the last token of a prefix depends on those of shorter prefixes within the length of a piece.

A state is what decides the future: for each place in the text from where on the text is the beginning of a piece, the
node of that beginning in the trie of pieces, the token that ends at the place, and its count of tokens relative to the
present one. These are finitely many. Reading a character leads to the next state and adds a number of tokens, which may be
negative: the running total is at each moment the tokenizer's count for the prefix read so far. Transitions are compiled
when first met and kept. Where two characters are together in no piece, the state before them is forgotten.

A chunk of text is a map from states to (state, tokens). Up to the first place where the state is forgotten it depends on
the state that comes in, and is kept as text; behind it the map is constant. Words between spaces begin and end at
such places, so a word is a constant map, remembered by its text. Maps of chunks compose associatively: long texts are cut
into chunks that all tasks share, and a scan of their maps adds them up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, steps
from .store import materialize

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: The mark that stands for a space inside pieces.
SPACE = "▁"
#: Characters of a text beyond which it is cut, and of each of its chunks.
CHUNK = 1 << 20
#: Compiled transitions, remembered words and tried pairs of pieces that a worker keeps at most.
TRANSITIONS, WORDS, PAIRS = 400_000, 600_000, 300_000
#: Words longer than this are read, not remembered.
LONG_WORD = 64

#: Stands for any token before a place that it cannot affect.
FREE = -1


class State:
    __slots__ = ("items", "next")

    def __init__(self, items: tuple[tuple[int, int, int], ...]) -> None:
        self.items = items
        self.next: dict[str, tuple[State, int]] = {}


START = ((0, FREE, 0),)


class Transducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ A") not in (f"{SPACE}ﬁ{SPACE}A", f"ﬁ{SPACE}A") or model.normalize("a  ") [-2:] != SPACE * 2:
            raise ValueError("only vocabularies that leave characters and spaces as they are can be compiled")
        self.prefix = model.normalize("a").startswith(SPACE)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("only vocabularies that spell unknown characters as bytes can be compiled")
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.score = {p: model.get_score(i) for p, i in zip(self.pieces, ids, strict=True)}
        self.child: dict[tuple[int, str], int] = {}
        self.piece_at: list[int] = [FREE]
        self.inner: list[bool] = [False]
        self.bigrams = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        for k, p in enumerate(self.pieces):
            node = 0
            for c in p:
                self.inner[node] = True
                if (at := self.child.get((node, c))) is None:
                    at = self.child[node, c] = len(self.piece_at)
                    self.piece_at.append(FREE)
                    self.inner.append(False)
                node = at
            self.piece_at[node] = k
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.compiled = 0
        self.start = self._state(START)
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        spaces_cut = not any(b[1] == SPACE and b[0] != SPACE for b in self.bigrams)
        # a line's end is in no piece of this vocabulary: words end there, too
        line = "\n" if (0, "\n") not in self.child else ""
        self.cut = re.compile(rf" *[^ {line}]+| +" + (r"|\n+" if line else "")) if spaces_cut else re.compile(r"(?s).+")

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging the best pair, the leftmost of equals, again and again."""
        parts, score, none = list(text), self.score, float("-inf")
        scores = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], none)
        return parts

    def _own(self, k: int) -> bool:
        """Whether a piece is its own encoding."""
        if (out := self.own.get(k)) is None:
            out = self.own[k] = len(self.merge(self.pieces[k])) == 1
        return out

    def _fits(self, a: int, b: int) -> bool:
        """Whether two pieces are the encoding of their join."""
        if (out := self.pairs.get((a, b))) is None:
            x, y = self.pieces[a], self.pieces[b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            out = self.pairs[a, b] = x[-1] + y[0] not in self.bigrams or self.merge(x + y) == [x, y]
        return out

    def _state(self, items: tuple[tuple[int, int, int], ...]) -> State:
        if (out := self.states.get(items)) is None:
            out = self.states[items] = State(items)
        return out

    def _compile(self, state: State, c: str) -> tuple[State, int]:
        if (0, c) not in self.child:  # spelt as bytes, and in no piece
            found = self.start, len(c.encode())
        else:
            going, last = [], None
            for node, token, behind in state.items:
                if node == 0 and token != FREE and self.pieces[token][-1] + c not in self.bigrams:
                    token = FREE
                at = self.child.get((node, c))
                if at is None:
                    continue
                if last is None and (k := self.piece_at[at]) != FREE and self._own(k) and (token == FREE or self._fits(token, k)):
                    last = k, behind + 1
                if self.inner[at]:
                    going.append((at, token, behind))
            if last is None:  # a character of some piece that is no piece itself is unknown
                found = self.start, len(c.encode())
            else:
                token, added = last
                found = self._state((*((at, t, behind - added) for at, t, behind in going), (0, token, 0))), added
        if self.compiled >= TRANSITIONS:
            self.forget()
        self.compiled += 1
        state.next[c] = found
        return found

    def forget(self) -> None:
        """Drop what is compiled; states in use stay right, as they hold what decides them."""
        for s in self.states.values():
            s.next.clear()
        self.states = {START: self.start}
        self.compiled = 0

    def read(self, text: str, state: State | None = None) -> tuple[State, int]:
        """Where ``text``, spaces as marks, leads from a state, and the tokens that it adds."""
        state, n = state or self.start, 0
        for c in text:
            state, added = state.next.get(c) or self._compile(state, c)
            n += added
        return state, n

    def _word(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.read(word.replace(" ", SPACE))[1]
        if len(word) <= LONG_WORD:
            if len(self.words) >= WORDS // 2:  # common words are met again before they are forgotten
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        words, n = self.words, 0
        for word in self.cut.findall(self.normal(text)):
            k = words.get(word)
            n += self._word(word) if k is None else k
        return n

    def normal(self, text: str) -> str:
        return (" " if self.prefix else "") + text.replace(SPACE, " ")

    def chunk(self, text: str) -> Map:
        """The map of a chunk of normal text."""
        marked = text.replace(" ", SPACE)
        for i in range(1, len(marked)):
            if marked[i - 1 : i + 1] not in self.bigrams:
                if len(head := marked[:i]) and self.cut.pattern != r"(?s).+":
                    return self._rest(head, text[i:])
                break
        return Map(marked, None, 0)

    def _rest(self, head: str, text: str) -> Map:
        words, n, last = self.words, 0, ""
        for m in self.cut.finditer(text):
            if m.end() == len(text):
                last = m[0]
                break
            k = words.get(m[0])
            n += self._word(m[0]) if k is None else k
        state, more = self.read(last.replace(" ", SPACE))
        return Map(head, state.items, n + more)

    def then(self, a: Map, b: Map) -> Map:
        """The map of two chunks in turn."""
        if a.state is None:
            return Map(a.head + b.head, b.state, b.count)
        state, n = self.read(b.head, self._state(a.state))
        if b.state is None:
            return Map(a.head, state.items, a.count + n)
        return Map(a.head, b.state, a.count + n + b.count)

    def total(self, maps: Iterable[Map]) -> int:
        """Tokens of a text whose chunks have these maps, by their composition from the start."""
        return reduce(self.then, maps, Map("", START, 0)).count


class Map:
    """``head`` is read from whatever state comes in; from there on, ``count`` tokens and ``state`` in the end, which
    is None where the head is all."""

    __slots__ = ("count", "head", "state")

    def __init__(self, head: str, state: tuple | None, count: int) -> None:
        self.head, self.state, self.count = head, state, count


@cache
def transducer(path: str) -> Transducer:
    """One for each worker process."""
    return Transducer(path)


def _count(path: str, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, task, row = transducer(path), TaskContext.get().partitionId(), 0
        for batch in steps(batches, 256):
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                text, size, row = (raw or b"").decode("utf-8", "replace"), len(raw or b""), row + 1
                if len(text) <= cut:
                    out.append((doc_id, size, machine.count(text), None, None, None))
                else:
                    text = machine.normal(text)
                    out += [(doc_id, size, None, task << 40 | row, k, text[i : i + cut]) for k, i in enumerate(range(0, len(text), cut))]
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "row": pa.int64(), "part": pa.int64(), "chunk": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))


MAPS = "doc_id long, n_bytes long, row long, part long, head string, state array<struct<node int, token int, behind int>>, count long"


def _maps(path: str):
    kind = pa.list_(pa.struct([("node", pa.int32()), ("token", pa.int32()), ("behind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in steps(batches, 1):
            found = machine.chunk(batch.column(4)[0].as_py())
            state = found.state and [dict(zip(("node", "token", "behind"), x, strict=True)) for x in found.state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([found.head]), pa.array([state], kind), pa.array([found.count], pa.int64())], names=["doc_id", "n_bytes", "row", "part", "head", "state", "count"])

    return run


def _scan(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maps of each text in order; what is held is the map of the text so far."""
        machine, last, so_far, out = transducer(path), None, None, []
        for batch in steps(batches, 16):
            for r in batch.to_pylist():
                if last is None or last[0] != r["row"]:
                    if last:
                        out.append((*last[1:], so_far.count, None, None, None))
                    last, so_far = (r["row"], r["doc_id"], r["n_bytes"]), Map("", START, 0)
                state = r["state"] and tuple((x["node"], x["token"], x["behind"]) for x in r["state"])
                so_far = machine.then(so_far, Map(r["head"], state, r["count"]))
            yield _rows(out)
            out = []
        yield _rows([(*last[1:], so_far.count, None, None, None)] if last else [])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, cut: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens of its whole text.

    Null counts as empty, with no tokens; repeated rows are counted each, and an empty table gives an empty result. A text
    of over ``cut`` characters is cut into chunks of that size wherever they end; all tasks share the chunks, and each
    text's maps are scanned in order."""
    path = public_tokenizers.path(vocabulary)
    schema = "doc_id long, n_bytes long, n_tokens long, row long, part long, chunk string"
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = materialize(rows.mapInArrow(_count(path, cut), schema), "token-counts")
    columns = ("doc_id", "n_bytes", "n_tokens")
    maps = read.where("chunk is not null").select("doc_id", "n_bytes", "row", "part", "chunk").repartition("row", "part").mapInArrow(_maps(path), MAPS)
    long = maps.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_scan(path), schema)
    return read.where("chunk is null").select(*columns).unionByName(long.select(*columns))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``count_tokens`` with over_limit (more tokens than ``limit``)."""
    return count_tokens(docs, id_col, text_col, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
