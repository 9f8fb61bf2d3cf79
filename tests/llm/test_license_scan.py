import random
import re

from cases import ODD, docs_of

from dockline.llm.common import words
from dockline.llm.license_scan import MOST_GAP, PHRASES, Automaton, Scanner, chains, scan, summary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return len(w), sorted((i, label) for p, label in PHRASES.items() for i in range(len(w))
                          if w[i:i + len(p.split())] == p.split())


def check(rows, source):
    want = sorted((str(i), *places(t)) for i, t in source)
    assert sorted((str(r.doc_id), r.n_words, [(p.start, p.label) for p in r.phrases]) for r in rows) == want


EXTRA = [(1, "cc by cc by by cc by"), (2, "All rights reserved, all rights. reserved all rights reserved"),
         (3, "general public general public license public license"),
         (4, "Licensed under the Apache License, Version 2.0."), (5, "Released under the MIT License"),
         (6, "under the License"), (7, "permission is hereby granted, free of charge, to any person obtaining a copy of "
          "this software and associated documentation files (the 'Software'), to deal in the OTHER Software without "
          "restriction"), (8, "Licensed under CC BY-NC 4.0.")]


def test_phrases_against_every_position(spark, small, small_texts, odd, empty):
    check(scan(small).collect(), small_texts)
    check(scan(odd).collect(), ODD)
    check(scan(docs_of(spark, EXTRA)).collect(), EXTRA)
    assert scan(empty).count() == 0


def test_summary(spark):
    rows = {r.doc_id: r for r in summary(scan(docs_of(spark, EXTRA))).collect()}
    assert rows[1].n_base == 3 and (rows[1].first_word, rows[1].last_word) == (0, 5)
    assert (rows[4].base_labels, rows[4].labels, rows[4].score) == ("", "apache-2.0", 1.0)
    assert rows[5].labels == "mit" and rows[6].labels == "" and rows[6].score == 0 and rows[6].first_word is None
    assert rows[7].labels == "mit" and 0.8 <= rows[7].score <= 1
    assert (rows[8].base_labels, rows[8].labels) == ("cc-by", "cc-by,cc-by-nc")


def test_automaton_holds_all_substrings_and_no_others():
    seqs = [list("abcab"), list("bcabx"), list("abcab"), list("xx")]
    a = Automaton(seqs)
    have = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

    def strings(state, before):
        for c, to in a.next[state].items():
            yield before + (c,)
            yield from strings(to, before + (c,))
    assert set(strings(0, ())) == have


def test_overlapping_matches_chain():
    text = "p q r s t u a b c d e f g h"
    for stuttered in ("p q r s t u t u a b c d e f g h", "p q r s t u s t u a b c x y d e f g h", text):
        _, _, spans = Scanner([("x", text)], {}).scan(words(stuttered))
        assert [(s["start"], s["end"], s["label"]) for s in spans] == [(0, len(stuttered.split()), "x")], stuttered
    two = Scanner([("x", text)], {}).scan(words(f"{text} {'no ' * 30} {text}"))[2]
    assert [(s["start"], s["end"], s["covered"]) for s in two] == [(0, 14, 1.0), (44, 58, 1.0)]


def every_chain(found):
    """Most words of any chain, over all ways to choose matches in order."""
    def best(i, end, stop):
        most = 0
        for j in range(i, len(found)):
            a, b, p, q = found[j]
            cut = 0 if end is None else max(0, end - a, stop - p)
            if cut < b - a and (end is None or a + cut - end <= MOST_GAP and p + cut - stop <= MOST_GAP):
                most = max(most, b - a - cut + best(j + 1, b, q))
        return most
    return best(0, None, None)


def test_best_chain_against_all_chains():
    draw = random.Random(5)
    some = 0
    for _ in range(300):
        text = [draw.choice("abcdefgh").encode() for _ in range(draw.randint(4, 14))]
        scanner = Scanner([("x", b" ".join(text).decode())], {})
        page = []
        while len(page) < 40:
            at = draw.randrange(len(text))
            page += text[at:at + draw.randint(1, 8)] + [b"zz"] * draw.choice((0, 0, 1, 9))
        matches = scanner.stream(page)[1]
        found = [(a, b, s[0] - (b - a), s[0]) for a, b, node in matches if (s := scanner.sam.ends[node])]
        got = chains(found)
        assert max((n for _, _, n in got), default=0) == every_chain(found)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:])) and all(n <= len(text) for _, _, n in got)
        some += len(found) > 4
    assert some > 50
