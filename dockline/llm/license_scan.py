"""Licence scan by a generalised suffix automaton over licence tokens.

The automaton holds every substring of the licence templates, word by word.
Reading a file's words through it gives matching statistics: at each word the
longest run of words ending there that occurs in some template.  Where a run
can't be extended it is a match; matches that lie in the same order in file and
template, with small gaps, are chained, and a chain that covers enough of a
template is a span of that licence.  Phrases are templates whose every full
occurrence counts.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import over_batches, words

#: Fixed phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Wording by which public licences are granted: a label and its texts.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
LEAST_MATCH = 3  # words of a match that may be chained
MOST_GAP = 8  # words between two matches of a chain, in file or template
COVERED = 0.8  # share of a template that a span covers
FIELDS = ("n_words long, phrases array<struct<start:long,label:string>>, "
          "spans array<struct<start:long,end:long,label:string,covered:double>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases=None) -> DataFrame:
    """One row per document: id, n_words, phrases (each place and label) and
    spans (word range, end exclusive; licence; share of its template covered).

    A null or empty text has no words; repeated rows are scanned alike; of equal
    chains the leftmost stands.  Templates travel to the tasks.  Other columns
    of ``docs`` are not read.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    args = docs.sparkSession.sparkContext.broadcast(
        (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases))
    return over_batches(rows, lambda: Scanner(*args.value), FIELDS, 1).withColumnRenamed("id", id_col)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``scan``'s rows in short: number and first and last place of phrases, their
    labels, all labels, and the score: 1 with a phrase, else the most covered."""
    def names(c):
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, spans = F.col("phrases.label"), F.col("spans.label")
    return found.select(
        id_col, "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"), F.array_max("phrases.start").alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, spans)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"))


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        #: Where the state's strings end first, by sequence.
        self.ends: list[dict[int, int]] = [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._add(last, w)
                at = last
                while at > 0 and k not in self.ends[at]:
                    self.ends[at][k] = i + 1
                    at = self.link[at]

    def _new(self, length: int, to: dict, link: int, ends: dict) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, at: int, w, old: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[old]), self.link[old], dict(self.ends[old]))
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = copy
            at = self.link[at]
        self.link[old] = copy
        return copy

    def _add(self, last: int, w) -> int:
        if w in self.next[last]:  # the string is there from another sequence
            old = self.next[last][w]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
        new = self._new(self.length[last] + 1, {}, 0, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][w]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, w, old)
        return new

    def find(self, seq: list) -> int:
        """The state of a sequence that occurs."""
        at = 0
        for w in seq:
            at = self.next[at][w]
        return at


class Scanner:
    def __init__(self, templates, phrases: dict[str, str]):
        self.templates = [(label, words(text)) for label, text in templates]
        self.phrases = [(label, words(text)) for text, label in phrases.items()]
        seqs = [w for _, w in self.templates + self.phrases]
        self.sam = Automaton(seqs)
        self.vocabulary = {w for s in seqs for w in s}
        #: Phrases that end wherever a state's strings of some length do.
        own = defaultdict(list)
        for label, w in self.phrases:
            own[self.sam.find(w)].append((len(w), label))
        self.full: list[list] = []
        for state in range(len(self.sam.next)):
            here, at = [], state
            while at > 0:
                here += own.get(at, [])
                at = self.sam.link[at]
            self.full.append(here)

    def __call__(self, texts):
        out = [self.scan(words(t)) for t in texts]
        return [list(c) for c in zip(*out)] or [[], [], []]

    def scan(self, w: list[bytes]):
        if self.vocabulary.isdisjoint(w):
            return len(w), [], []
        places, matches = self.stream(w)
        return (len(w), [{"start": s, "label": x} for s, x in sorted(places)], self.chain(matches))

    def stream(self, w: list[bytes]):
        """Phrase places, and matches (start, end, state) that can't be extended."""
        step, link, length, full = self.sam.next, self.sam.link, self.sam.length, self.full
        places, matches = [], []
        node = n = 0
        before = -1
        known = self.vocabulary
        for i in [i for i, x in enumerate(w) if x in known]:
            if i != before + 1:
                if n >= LEAST_MATCH:
                    matches.append((before + 1 - n, before + 1, node))
                node = n = 0
            before = i
            x = w[i]
            if x not in step[node]:
                if n >= LEAST_MATCH:
                    matches.append((i - n, i, node))
                while node >= 0 and x not in step[node]:
                    node = link[node]
                if node < 0:
                    node = n = 0
                    continue
                n = length[node]
            node, n = step[node][x], n + 1
            for size, label in full[node]:
                if size <= n:
                    places.append((i + 1 - size, label))
        if n >= LEAST_MATCH:
            matches.append((before + 1 - n, before + 1, node))
        return places, matches

    def chain(self, matches) -> list[dict]:
        by_template = defaultdict(list)
        for start, end, node in matches:
            for k, stop in self.sam.ends[node].items():
                if k < len(self.templates):
                    by_template[k].append((start, end, stop - (end - start), stop))
        spans = []
        for k, found in by_template.items():
            label, text = self.templates[k]
            spans += ({"start": start, "end": end, "label": label, "covered": n / len(text)}
                      for start, end, n in chains(found) if n / len(text) >= COVERED)
        return sorted(spans, key=lambda s: (s["start"], s["end"], s["label"]))


def chains(found: list[tuple]) -> list[tuple[int, int, int]]:
    """Best chains of matches (start, end, place in the template, its end), by end: the
    file words from and to, and how many template words are matched.

    In a chain both the file and the template go on, by gaps of ``MOST_GAP`` words at
    most.  A match that begins before the one ahead of it ends, in the file or in the
    template, counts from there on.  The chain with most words is taken first, the
    earliest of equals; those that would overlap a taken one in the file are not."""
    best, ahead, first = [], [], []
    for i, (start, end, place, stop) in enumerate(found):
        n, link = end - start, -1
        for j in range(i - 1, -1, -1):
            _, end_j, _, stop_j = found[j]
            if start - end_j > MOST_GAP:  # so are all before it
                break
            cut = max(0, end_j - start, stop_j - place)
            if (cut < end - start and start + cut - end_j <= MOST_GAP and place + cut - stop_j <= MOST_GAP
                    and best[j] + end - start - cut > n):
                n, link = best[j] + end - start - cut, j
        best.append(n)
        ahead.append(link)
        first.append(first[link] if link >= 0 else start)
    taken: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: (-best[i], i)):
        start, end = first[i], found[i][1]
        at = bisect_left(starts, end)  # taken ones are apart, so only the one before may overlap
        if at and taken[at - 1][1] > start:
            continue
        starts.insert(at, start)
        taken.insert(at, (start, end, best[i]))
    return taken
