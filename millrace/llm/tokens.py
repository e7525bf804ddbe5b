"""Token ids from the tokenizers library, with a bounded store of words already encoded.

The vocabulary's pre-tokenizer splits at white space and drops it, so the ids of a text are those of its words
in turn, and any word may be encoded by itself. Words of plain letters, between marks or not, go straight to the
library's BPE model, whose input the normalizer and the byte-level alphabet would leave as it is; all others take the
whole tokenizer. Texts are taken some at a time: their distinct words are looked up as columns, and those that are new
go to the model in one call, as a large corpus has many words that are met once."""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

VOCABULARY = "word_bpe_49k.json"
#: Words remembered by a worker at most.
REMEMBERED = 800_000
#: Words that stay between tasks where a worker has other work to do, too.
KEPT = 50_000
#: Bytes of text whose words are looked up together, but for a single word of more.
GROUP_BYTES = 4 << 20
#: Letters of ASCII and Latin-1, composed already, in UTF-8 between marks of ASCII: a pre-token each. An apostrophe
#: before letters may take some of them, and a special token begins with ``<|``.
_PLAIN = re.compile(rb"([!-&(-/:;=?@\[-`{}~]*)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:;=?@\[-`{}~]*)")
#: The letters of ``_PLAIN``, lower case.
_LOWER = "^(?:[a-z]|[\u00df-\u00f6\u00f8-\u00ff])+$"
#: The marks of ``_PLAIN`` before and after letters.
_BEFORE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<>|")
_AFTER = _BEFORE + "'"
_SPACE = re.compile(rb"[ \t-\r]")
SPECIAL = b"<|"


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def _strings(found: list[bytes]) -> pa.Array:
    """UTF-8, well-formed or not."""
    return pa.array(found, pa.large_binary()).view(pa.large_string())


def _bytes(found: pa.Array) -> list[bytes]:
    return found.view(pa.large_binary()).to_pylist()


class Lists:
    """Lists of ids: list i is at first[i]:first[i + 1]."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        self.ids, self.first = ids, first

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        return cls(np.array([k for x in lists for k in x], "<u4"), np.cumsum([0, *map(len, lists)]))

    def take(self, at: np.ndarray) -> Lists:
        sizes = np.diff(self.first)[at]
        first = np.concatenate([[0], np.cumsum(sizes)])
        return Lists(self.ids[np.repeat(self.first[at] - first[:-1], sizes) + np.arange(first[-1])], first)

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.ids, other.ids]), np.concatenate([self.first, self.first[-1] + other.first[1:]]))


class Store:
    """Words and the ids of each."""

    def __init__(self, words: pa.Array | None = None, lists: Lists | None = None) -> None:
        self.words, self.lists = _strings([]) if words is None else words, lists or Lists.of([])

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, lists: Lists) -> Store:
        return Store(pa.concat_arrays([self.words, words]), self.lists + lists)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. The store is of words without marks around them."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores, and threads of a pool stay
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        ends = self.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if ends and token.endswith(ends)]] = True
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = ["?"] * 256  # as the byte-level alphabet spells each byte
        letters[0x20] = " "
        for c in (*range(0x41, 0x7B), *range(0xC0, 0x100)):
            for byte, letter in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
                letters[byte] = letter
        self.letters = "".join(letters)
        self.marks: dict[bytes, list[int]] = {}
        self.now, self.older = Store(), Store()
        self.plain = self._agree()

    def __len__(self) -> int:
        return len(self.now)

    def _whole(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _mark(self, marks: bytes) -> list[int]:
        if (out := self.marks.get(marks)) is None:
            if len(self.marks) > 10_000:
                self.marks = {}
            out = self.marks[marks] = [t.id for t in self.model.tokenize(marks.decode())]
        return out

    def _spelt(self, words: pa.Array) -> Lists:
        """Of lower-case letters alone. The last token of each has the mark of a word's end, and no other has."""
        text = charmap_decode(b" ".join(_bytes(words)), "strict", self.letters)[0]
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        first = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(first) == len(words) + 1 and first[-1] == len(ids):
            return Lists(ids, first)
        return Lists.of([[t.id for t in self.model.tokenize(word)] for word in text.split(" ")])

    def _ids(self, words: pa.Array, plain: np.ndarray) -> Lists:
        """Of distinct words; ``plain`` ones are letters alone."""
        found = self.now.find(words)
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.now) and len(self.now) + len(new) > REMEMBERED // 2:
            # common words are met again before they are forgotten
            self.now, self.older = Store(), self.now
            return self._ids(words, plain)
        if len(new):
            old = self.older.find(words.take(pa.array(new)))
            again, spelt, rest = new[old >= 0], new[(old < 0) & plain[new]], new[(old < 0) & ~plain[new]]
            lists = self.older.lists.take(old[old >= 0])
            lists += self._spelt(words.take(pa.array(spelt))) if len(spelt) else Lists.of([])
            lists += Lists.of([self._whole(w) for w in _bytes(words.take(pa.array(rest)))])
            order = np.concatenate([again, spelt, rest])
            found[order] = len(self.now) + np.arange(len(order))
            self.now = self.now.add(words.take(pa.array(order)), lists)
        return self.now.lists.take(found)

    def _marked(self, words: pa.Array) -> Lists:
        """Of distinct words."""
        if not self.plain:
            return self._ids(words, np.zeros(len(words), bool))
        right = pc.ascii_rtrim(words, _AFTER)
        core = pc.ascii_ltrim(right, _BEFORE)
        plain = pc.match_substring_regex(core, _LOWER).to_numpy(zero_copy_only=False).copy()
        whole, middle, letters = (pc.binary_length(x).to_numpy() for x in (words, right, core))
        before, after = np.where(plain, middle - letters, 0), np.where(plain, whole - middle, 0)
        _, places, data = words.buffers()
        begin, data = np.frombuffer(places, np.int64)[words.offset :][: len(words)], np.frombuffer(data or b"", np.uint8)
        marks: dict[bytes, int] = {b"": 0}
        around = np.zeros((len(words), 2), np.int64)
        for side, sizes, start in ((0, before, begin), (1, after, begin + whole - after)):
            for size in (1, 2):  # nearly all
                at = np.flatnonzero(sizes == size)
                keys = data[start[at]].astype(np.int64)
                if size == 2:
                    keys = keys << 8 | data[start[at] + 1]
                here, inverse = np.unique(keys, return_inverse=True)
                around[at, side] = np.array([marks.setdefault(k.to_bytes(size), len(marks)) for k in here.tolist()], np.int64)[inverse]
            for i in np.flatnonzero(sizes > 2).tolist():
                around[i, side] = marks.setdefault(data[start[i] : start[i] + sizes[i]].tobytes(), len(marks))
        first, others, cores = np.flatnonzero(plain), np.flatnonzero(~plain), []
        for i, word in zip(others.tolist(), _bytes(words.take(pa.array(others))), strict=True):
            if m := _PLAIN.fullmatch(word):  # with capitals
                around[i], plain[i] = (marks.setdefault(m[1], len(marks)), marks.setdefault(m[3], len(marks))), True
                word = m[2].decode().lower().encode()
            cores.append(word)
        order = np.concatenate([first, others])
        distinct = pa.concat_arrays([core.take(pa.array(first)), _strings(cores)]).dictionary_encode()
        place = distinct.indices.to_numpy()
        kinds = np.zeros(len(distinct.dictionary), bool)
        kinds[place] = plain[order]
        lists = Lists.of([self._mark(m) if m else [] for m in marks]) + self._ids(distinct.dictionary, kinds)
        parts = np.empty((len(words), 3), np.int64)
        parts[:, 0], parts[:, 2] = around.T
        parts[order, 1] = len(marks) + place
        found = lists.take(parts.ravel())
        return Lists(found.ids, found.first[::3])

    def _agree(self) -> bool:
        """Whether model and tokenizer agree on plain words, as they do for this vocabulary."""
        self.plain = True
        words = [w.encode() for w in ("the", "Mixed", "zzyxqh", "end.", "well?!", "Éçàß", "Ñandú,", "ÿØÞ", "(so)", "it'", "a&&&", '"Él"', "{_x_}%%%", "añb", "çàß", "ñandú!")]
        return list(self.each(words)) == [np.array(self._whole(w), "<u4").tobytes() for w in words]

    def forget(self) -> None:
        """All words but the first met, which are the common ones: workers stay, and have other work to do."""
        few = np.arange(min(KEPT, len(self.now)))
        self.now, self.older = Store(self.now.words.take(pa.array(few)), self.now.lists.take(few)), Store()

    def _together(self, held: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(_strings(held))
        words = split.flatten().dictionary_encode()
        found = self._marked(words.dictionary).take(words.indices.to_numpy())
        cuts, data = (4 * found.first[split.offsets.to_numpy()]).tolist(), found.ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def each(self, found: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text (UTF-8)."""
        held, size = [], 0
        for text in found:
            # the normalizer lowers letters anyway; fewer different words are then met. Special tokens keep their case
            text = text if SPECIAL in text else text.lower()
            if held and size + len(text) > GROUP_BYTES:
                yield from self._together(held)
                held, size = [], 0
            if len(text) > GROUP_BYTES:
                yield b"".join(x for part in _cut(text) for x in self._together([part]))
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._together(held)

    def ids(self, text: bytes) -> bytes:
        return next(self.each([text]))


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end with words."""
    at = 0
    while at < len(text):
        end = m.start() if (m := _SPACE.search(text, at + GROUP_BYTES)) else len(text)
        yield text[at:end]
        at = end


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
