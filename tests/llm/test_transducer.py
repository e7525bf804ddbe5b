import random

import public_tokenizers
import pytest
import sentencepiece
from millrace.llm import transducer as X

PATH = public_tokenizers.path(X.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n, seed):
    rng, pieces = random.Random(seed), [p.replace(X.SPACE, " ") for p in X.transducer(PATH).pieces]
    odd = ["a", "e", "th", " ", "  ", X.SPACE, "\n", "\t", "é", "中文", "🙂", "12", "0", "(", "--", "==", "ing", "́", "\x00", "﻿", "https://", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "\xa0"]
    for i in range(n):
        size = rng.randrange(0, 14)
        yield "".join(rng.choice("aabt ") for _ in range(3 * size)) if i % 3 == 0 else "".join(rng.choice(odd if rng.random() < 0.5 else pieces) for _ in range(size))


def test_counts_are_the_library_s(library):
    machine = X.Transducer(PATH)
    for text in ["", " ", "   ", "x" * 3000, "ab" * 999, "=" * 777, "中" * 500, *odd_texts(4000, 1)]:
        assert machine.count(text) == len(library.encode(text)), repr(text)


def test_every_prefix_has_its_count(library):
    machine = X.Transducer(PATH)
    for text in ["internationalisation of thethe", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://www.example.com/index.html?q=1"]:
        state, n, marked = machine.start, 0, machine.normal(text).replace(" ", X.SPACE)
        for i, c in enumerate(marked):
            state, n = (lambda s, k: (s, n + k))(*machine.read(c, state))
            assert i == 0 or n == len(library.encode(text[:i])), text[:i]


def test_maps_of_chunks_compose_in_any_grouping(library):
    machine, rng = X.Transducer(PATH), random.Random(2)
    for text in [*odd_texts(500, 3), "a" * 300, "the " * 50]:
        if not text:
            continue
        normal = machine.normal(text)
        cuts = sorted({0, len(normal), *(rng.randrange(len(normal)) for _ in range(4))})
        maps = [machine.chunk(normal[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = machine.then(m, right)
        assert machine.total(maps) == machine.total([right]) == len(library.encode(text)), repr(text)


def test_what_is_compiled_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(X, "TRANSITIONS", 50)
    monkeypatch.setattr(X, "WORDS", 20)
    monkeypatch.setattr(X, "PAIRS", 10)
    machine = X.Transducer(PATH)
    for text in odd_texts(500, 4):
        assert machine.count(text) == len(library.encode(text))
        assert len(machine.words) <= 10 and machine.compiled <= 50


def test_other_normalisations_are_refused():
    with pytest.raises(Exception):
        X.Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_documents(spark, library):
    texts = [None, "", "Hello  world\n", "a" * 50_000, "word " * 9000, "ünï " * 300, "same", "same", *odd_texts(60, 5)]
    rows = [(i if i % 9 else None, t, "row", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, part int, n_tokens int")
    want = sorted((-1 if k is None else k, len((t or "").encode()), len(library.encode(t or ""))) for k, t, *_ in rows)
    for cut in (X.CHUNK, 97):
        found = X.count_tokens(docs, cut=cut).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    over = {r.doc_id: r.over_limit for r in X.judge(docs).collect() if r.doc_id is not None}
    assert over[3] and over[4] and not over[2]
    assert X.judge(docs.limit(0)).collect() == []
