"""Language identification by cross-parsing entropy.

A suffix automaton over each language's labelled words reads a text and yields
longest matches: the text is parsed into phrases, each the longest piece found
in that language's words.  The fewer phrases, the closer the language; a phrase
costs the logarithm of the length of the words it is taken from, and the cost is
divided by the text's letters (the cross-parsing estimate of cross-entropy, in
bits a letter).  A phrase doesn't cross a word's ends, so a word's phrase counts
don't depend on its place and are remembered.

Every label is learned, from a bounded part of its rows: its ``WORDS`` most
frequent words in about ``DOCS`` different labelled texts, drawn by their hash
(all of them if it has no more).  Prediction reads every text in full.
"""
from __future__ import annotations

import hashlib
import json
import math
import re
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.llm.common import free_name, over_batches

WORDS = 10_000  # of each language
DOCS = 500
MEMO = 150_000
UNKNOWN = "und"
FIELDS = "lang_pred string, score double"
#: Runs of letters (with marks and numerals that are no decimal digits).
LETTERS = re.compile(r"[^\W\d_]+")


def identify(docs: DataFrame, model: dict[str, list[str]], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score.

    ``model``: words by language (see ``learn``).  lang_pred is ``und`` if the
    text is null or has no letter, or nothing was learned; equal costs go to the
    language that sorts first.  score: the share by which the best language's
    cost is below the next one's, 0 for ``und``, 1 if there is one language.
    Repeated rows are predicted alike; other columns are not read; an empty table
    gives an empty one.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    known = docs.sparkSession.sparkContext.broadcast(model)
    return over_batches(rows, lambda: parser(known.value), FIELDS, 1).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: dict[str, list[str]], text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``docs``, with all its columns, without those whose language can't be told
    (``und``: a null text, one without letters, or nothing learned); a null label is
    filled in by the prediction.

    Repeated rows are told alike and all stay; equal costs go to the language that
    sorts first; columns may have any names; an empty table gives an empty one."""
    arg, pred, score = (free_name(docs, x) for x in ("arg", "told_lang", "told_score"))
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias(arg), *(F.col(f"`{c}`") for c in docs.columns))
    known = docs.sparkSession.sparkContext.broadcast(model)
    told = over_batches(rows, lambda: parser(known.value), f"`{pred}` string, `{score}` double", 1)
    return told.where(F.col(pred) != UNKNOWN).select(
        *(F.coalesce(F.col(f"`{c}`"), pred).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is a
    multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          words: int = WORDS, n_docs: int = DOCS) -> dict[str, list[str]]:
    """Words by language, from the labelled documents that aren't held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # copies are drawn together, so the share is one of different texts
    bounds = rows.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").agg(
        F.least(F.lit(1 << 30), F.ceil((1 << 30) * n_docs / F.count(F.lit(1)))).alias("bound"))
    drawn = rows.join(F.broadcast(bounds), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("bound")).select("lang", "text").distinct()
    found = drawn.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = (found.groupBy("lang", "word").count().withColumn("n", F.row_number().over(order))
           .where(F.col("n") <= words))
    model: dict[str, list[str]] = {}
    for lang, word in top.orderBy("lang", "word").select("lang", "word").collect():
        model.setdefault(lang, []).append(word)
    return model


class SuffixAutomaton:
    """All substrings of a text; reads a string into longest matches.

    A state's transitions are a string of characters, shared by the states that
    have the same ones, and as many numbers from ``first`` on in ``to``.
    """

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])
        last = 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if at >= 0:
                old = step[at][c]
                if length[old] == length[at] + 1:
                    link[new] = old
                else:
                    copy = len(step)
                    step.append(dict(step[old]))
                    length.append(length[at] + 1)
                    link.append(link[old])
                    while at >= 0 and step[at].get(c) == old:
                        step[at][c] = copy
                        at = link[at]
                    link[old] = link[new] = copy
            last = new
        known: dict[str, str] = {}
        self.root = step[0]
        self.chars: list[str] = []
        self.first, self.to = array("i"), array("i")
        for k, found in enumerate(step):
            chars = "".join(found)
            self.chars.append(known.setdefault(chars, chars))
            self.first.append(len(self.to))
            self.to.extend(found.values())
            if k:
                found.clear()

    def phrases(self, text: str) -> int:
        """How many longest matches ``text`` parses into, from left to right; a
        character that doesn't occur is a phrase by itself."""
        chars, first, to, root, node, n = self.chars, self.first, self.to, self.root, 0, 0
        for c in text:
            if node:
                k = chars[node].find(c)
                if k >= 0:
                    node = to[first[node] + k]
                    continue
                n += 1
            node = root.get(c, 0)
            if not node:
                n += 1
        return n + 1 if node else n


_parsers: dict[bytes, Parser] = {}


def parser(model: dict[str, list[str]]) -> Parser:
    """This worker's parser for the model; automata are built once a worker.  Models
    are told apart by a digest of all their labels and words."""
    key = hashlib.sha256(json.dumps(list(model.items())).encode()).digest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(model)
    return _parsers[key]


class Parser(dict):
    """Predicts a batch of texts.  Maps words to phrase counts: one number with
    32 bits for each language, so that counts of words simply add up."""

    def __init__(self, model: dict[str, list[str]]):
        super().__init__()
        texts = {lang: " " + " ".join(words) + " " for lang, words in sorted(model.items())}
        self.langs = list(texts)
        self.automata = [SuffixAutomaton(t) for t in texts.values()]
        self.bits = [math.log2(len(t)) for t in texts.values()]

    def __missing__(self, word: str) -> int:
        padded = f" {word} "
        n = sum(a.phrases(padded) << 32 * k for k, a in enumerate(self.automata))
        if len(word) < 64:
            self[word] = n
        return n

    def __call__(self, texts):
        out = [self.predict(t) for t in texts]
        return [list(c) for c in zip(*out)] or [[], []]

    def predict(self, text: str | None) -> tuple[str, float]:
        w = LETTERS.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for x in w for c in x):
            return UNKNOWN, 0.0
        if len(self) > MEMO:
            self.clear()
        total = sum(map(self.__getitem__, w))
        costs = sorted(((total >> 32 * k & 0xFFFFFFFF) * b, lang)
                       for k, (b, lang) in enumerate(zip(self.bits, self.langs)))
        return costs[0][1], 1 - costs[0][0] / costs[1][0] if len(costs) > 1 else 1.0
