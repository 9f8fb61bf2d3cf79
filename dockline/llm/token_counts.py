"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces make a trie with two roots: pieces that start a word and
pieces that go on.  A node's failure link leads to where matching goes on once
the longest pieces of the node's string are taken off, and the node holds how
many pieces that takes off.  Each character so costs constant time on average,
and the count comes without building the pieces.  If the mark itself is a piece,
a word that no other piece starts has it as its first token.
"""
from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import over_batches

MARK = "▁"  # starts the pieces that start a word
MEMO = 250_000  # words whose counts a worker remembers
FIELDS = "n_words long, n_tokens long, n_unknown long"


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text",
                 mark: str = MARK) -> DataFrame:
    """One row per document: id, n_words, n_tokens, n_unknown.

    Words are what white space parts.  A word's tokens: the longest piece that
    starts it (``mark`` alone, if it is a piece and no longer one does), then the
    longest piece that goes on, and so on; a word for which that ends without a
    piece is one unknown token.  A null or empty text has no words; repeated rows
    give a row each; an empty table gives none.  ``pieces``: the vocabulary (what
    travels to the tasks); those that start a word begin with ``mark``.  Other
    columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    return over_batches(rows, lambda: Counter(Automaton(vocabulary.value, mark)), FIELDS, 1) \
        .withColumnRenamed("id", id_col)


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model file, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    START, GO_ON = 0, 1

    def __init__(self, pieces: list[str], mark: str = MARK):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for piece in pieces:
            starts = piece.startswith(mark)
            node, text = (self.START, piece[len(mark):]) if starts else (self.GO_ON, piece)
            if not text and not starts:
                continue
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][c]
            ends[node] = True
        #: Where to go on (-1: nowhere), and after how many pieces.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        if ends[self.START]:  # the bare mark: a token without a character
            self.fail[self.START], self.popped[self.START] = self.GO_ON, 1
        queue = deque([self.START, self.GO_ON])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = self.GO_ON, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.next[at]:
                    at, n = self.fail[at], n + self.popped[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at][c], n

    def count(self, word: str) -> int:
        """Tokens of a word, 0 if it is unknown."""
        node, n, step, fail, popped = self.START, 0, self.next, self.fail, self.popped
        for c in word:
            while c not in step[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = step[node][c]
        while node != self.GO_ON:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


class Counter(dict):
    """Counts a batch of texts; remembers the counts of short words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) < 64:
            self[word] = n
        return n

    def __call__(self, texts):
        out = []
        for text in texts:
            w = text.split() if text else []
            if len(self) > MEMO:
                self.clear()
            counts = list(map(self.__getitem__, w))
            unknown = counts.count(0)
            out.append((len(w), sum(counts) + unknown, unknown))
        return [list(c) for c in zip(*out)] or [[], [], []]
