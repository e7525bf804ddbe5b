import numpy as np
from tokenizers import Tokenizer

from millrace.llm import tokens

WORDS = ["alpha", "Beta,", "(gamma)", '"Él"', "ñandú!?", "ÀÉ.", "it's", "'the", "x1y2", "...", "4.0.", "<|endoftext|>", "İst", "a...", '{["deep"]}...', "ﬁn", "\x1cq", "üß--", "b&c"]


def test_many_new_words_are_one_call_of_the_model(monkeypatch):
    """Each call of the library for a single word costs more than the word."""
    own = tokens.Encoder(tokens.vocabulary())
    calls = []
    model, spelt = own.model, own._spelt
    monkeypatch.setattr(own, "_spelt", lambda words: calls.append(len(words)) or spelt(words))
    monkeypatch.setattr(own, "_whole", None)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [" ".join(f"z{a}{b}{c}q, ({a}{c}{b}w)" for b in letters for c in letters) for a in letters]
    found = list(own.each([r.encode() for r in rows]))
    assert calls == [2 * 26**3] and own.model is model
    library = Tokenizer.from_file(tokens.vocabulary())
    assert found == [np.array(library.encode(r, add_special_tokens=False).ids, "<u4").tobytes() for r in rows]


def test_groups_and_forgotten_words_do_not_matter(monkeypatch):
    rng = np.random.default_rng(4)
    rows = ["", " \n ", *(" ".join(w if k % 3 else f"{w}{k}x" for k, w in enumerate(rng.choice(WORDS, n))) for n in (1, 5, 900, 40, 2500)), "word" * 300, " lead  and trail\t"]
    library = Tokenizer.from_file(tokens.vocabulary())
    expected = [np.array(library.encode(r, add_special_tokens=False).ids, "<u4").tobytes() for r in rows]
    for size, kept in ((4 << 20, 800_000), (500, 800_000), (1, 40), (300, 10)):
        monkeypatch.setattr(tokens, "GROUP_BYTES", size)
        monkeypatch.setattr(tokens, "REMEMBERED", kept)
        own = tokens.Encoder(tokens.vocabulary())
        for _ in range(2):
            assert list(own.each([r.encode() for r in rows])) == expected
        assert len(own) <= max(kept, 2000)
        own.forget()
        assert list(own.each([r.encode() for r in rows])) == expected
    own.plain = False
    assert list(own.each([r.encode() for r in rows])) == expected
