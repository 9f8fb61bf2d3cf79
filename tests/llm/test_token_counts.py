import public_tokenizers
from cases import ODD

from dockline.llm.token_counts import MARK, Automaton, sentencepiece_pieces, token_counts

PIECES = sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))


START, ON = {p[1:] for p in PIECES if p.startswith(MARK)}, {p for p in PIECES if not p.startswith(MARK)}
LONGEST = max(map(len, PIECES))


def greedy(word):
    """The number of tokens by the rule itself, 0 for an unknown word."""
    n = i = 0
    while i < len(word) or not n:
        size = next((k for k in range(LONGEST, -1 if not n else 0, -1)
                     if i + k <= len(word) and word[i:i + k] in (ON if n else START)), None)
        if size is None:
            return 0
        n, i = n + 1, i + size
    return n


def counts(text):
    found = [greedy(w) for w in (text or "").split()]
    return len(found), sum(n or 1 for n in found), found.count(0)


def test_counts_are_those_of_greedy_word_pieces(small, small_texts, odd, empty):
    want = {i: counts(t) for i, t in small_texts}
    assert {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(small, PIECES).collect()} == want
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(odd, PIECES).collect())
    assert got == sorted((str(i), *counts(t)) for i, t in ODD)
    assert token_counts(empty, PIECES).count() == 0


def test_failure_links_pop_several_pieces():
    a = Automaton(["▁a", "▁abcdef", "b", "bc", "c", "de", "d", "g"])
    assert a.count("abcdeg") == 4  # a bc de g
    assert a.count("abcdef") == 1 and a.count("abcdex") == 0 and a.count("b") == 0
    assert a.count("zb") == 0


def test_the_bare_mark_starts_words_that_nothing_longer_starts():
    a = Automaton(["▁", "▁ab", "b", "bc", "x", "xy"])
    assert a.count("xyb") == 3  # mark xy b
    assert a.count("abx") == 2 and a.count("ax") == 0
    assert a.count("bcx") == 3 and a.count("q") == 0
    assert MARK in PIECES
    assert greedy("ababab") > 0


def test_whole_words_against_the_word_piece_model(small_texts):
    from tokenizers import models
    vocabulary = {"[UNK]": 0}
    for p in PIECES:
        name = p[1:] if p.startswith(MARK) else "##" + p
        if name not in ("", "##"):
            vocabulary.setdefault(name, len(vocabulary))
    model = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=1000)
    a = Automaton([p for p in PIECES if p != MARK])
    for w in {w for _, t in small_texts for w in (t or "").split() if len(w) < 1000}:
        ids = [t.id for t in model.tokenize(w)]
        assert a.count(w) == (0 if ids == [0] else len(ids))
