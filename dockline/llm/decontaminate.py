"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window).  A document contains a window only if it
contains all the window's words, so joining on the window's rarest word, its
necessary prefix for full containment, loses nothing.

1. Rarity: one pass counts, for each benchmark word, the documents that hold it.
2. Each window is filed under its rarest word with that word's position.
3. The second pass joins every document word with that index.  The position
   bounds the window's start, the document's length its end; what is left is
   looked up by its hash and verified word by word.

The index of a benchmark block is broadcast: its words, and 24 bytes a window
(hash, place in the block's text, item).  A block has ``block_bytes`` bytes of
text or about (checked before it is read; no item is cut); a larger benchmark is cut into several blocks, each joined with all
documents in a pass of its own.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dockline.llm.common import over_batches, ship, slices, stored, words

WINDOW = 13
BLOCK_BYTES = 4_000_000
LOOKUPS = 100_000  # of one text at a time
FIELDS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans (word ranges inside windows, end
    exclusive, disjoint and sorted) and items (ids of the items with windows
    there, as strings, sorted).

    Words: runs of letters, digits and non-ASCII of the text with A-Z lower-cased.
    A null or empty text, on either side, has no words; an item without an id
    marks spans but isn't listed; equal rows give equal results; an empty
    benchmark gives no spans.  Other columns are not read.
    """
    found = _found(docs, benchmark, [id_col], text_col, item_col, item_text_col, window, block_bytes)
    return found.select(F.col(f"doc.`{id_col}`"), "n_words", "spans", "items")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, with all its columns, without the contaminated rows.

    A row with a null or empty text stays; equal rows stay or go alike; columns
    may have any names; an empty benchmark or table of documents loses nothing.
    """
    found = _found(docs, benchmark, docs.columns, text_col, item_col, item_text_col, window, block_bytes)
    return found.where(~_contaminated()).select("doc.*")


def _found(docs, benchmark, keep, text_col, item_col, item_text_col, window, block_bytes) -> DataFrame:
    """(doc: the kept columns, n_words, spans, items) of each row."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(blocks) == 1:
        index = window_index(rows, blocks[0], window)
        return over_batches(rows, lambda: Matcher(index.value), FIELDS, 1)
    # Each block finds its own spans; the rows are stored first, so that a row
    # keeps its number from pass to pass.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = None
    for block in blocks:
        index = window_index(rows, block, window)
        part = over_batches(rows.select("text", "row"), lambda index=index: Matcher(index.value), FIELDS, 1)
        parts = part if parts is None else parts.unionAll(part)
    merged = (stored(parts).groupBy("row")
              .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    merged = over_batches(merged.select("spans", "row", "n_words", "items"), lambda: _merge_all,
                          "spans array<struct<start:long,end:long>>", 1)
    return rows.select("row", "doc").join(merged, "row").select("doc", "n_words", "spans", "items")


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated():
    return (_n_hit() > 0) & (_n_hit() * 20 >= F.col("n_words"))


def contamination(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of ``decontaminate``'s rows: n_hit words in spans, items, their
    digest, and contaminated: a twentieth of the words or more are hit."""
    return found.select(id_col, "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        _contaminated().alias("contaminated"))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes`` bytes, by item text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


class Index(NamedTuple):
    """The windows of a benchmark block, in the order of their hashes."""
    places: dict[bytes, list[tuple[int, int]]]  # of a prefix word: its position, the window's size
    hashes: np.ndarray
    at: np.ndarray  # of the window in ``text``
    length: np.ndarray
    item: np.ndarray
    items: list[str | None]
    text: bytes

    def find(self, wanted: list[bytes], hashes: list[int]):
        """(place in ``wanted``, items) of what is a window."""
        keys = np.array(hashes, np.uint64)
        first, end = np.searchsorted(self.hashes, keys), np.searchsorted(self.hashes, keys, "right")
        for k in np.flatnonzero(first < end).tolist():
            same = [e for e in range(first[k], end[k])
                    if self.text[self.at[e]:self.at[e] + self.length[e]] == wanted[k]]
            if same:
                yield k, {self.items[self.item[e]] for e in same}


def window_index(rows: DataFrame, block: DataFrame, window: int):
    """Broadcast of a block's ``Index``."""
    found = [(item, w) for item, text in block.collect() if (w := words(text))]
    sc = rows.sparkSession.sparkContext
    counts = document_counts(rows, sc.broadcast(frozenset(x for _, w in found for x in w)))
    rarity = {x: k for k, x in enumerate(sorted(counts, key=lambda x: (counts[x], x)))}
    text = b"\n".join(b" ".join(w) for _, w in found)
    places: dict[bytes, set] = defaultdict(set)
    parts, base = [], 0
    for k, (_, w) in enumerate(found):
        size = min(window, len(w))
        ends = base + np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([base], ends[:-1] + 1))
        rank = np.array([rarity.get(x, -1) for x in w])  # -1: no document holds it
        views = np.lib.stride_tricks.sliding_window_view(rank, size)
        prefix = views.argmin(axis=1)
        held = np.flatnonzero(views.min(axis=1) >= 0)
        for i in held.tolist():
            places[w[i + prefix[i]]].add((int(prefix[i]), size))
        at, end = starts[held], ends[held + size - 1]
        hashes = np.array([xxh64_intdigest(text[a:b]) for a, b in zip(at.tolist(), end.tolist())], np.uint64)
        parts.append((hashes, at, (end - at).astype(np.int32), np.full(len(at), k, np.int32)))
        base = int(ends[-1]) + 1
    empty = [(np.empty(0, t),) for t in (np.uint64, np.int64, np.int32, np.int32)]
    columns = [np.concatenate(c) for c in (zip(*parts) if parts else empty)]
    order = np.argsort(columns[0], kind="stable")
    return sc.broadcast(Index({x: sorted(p) for x, p in places.items()}, *(c[order] for c in columns),
                              [item for item, _ in found], text))


def document_counts(rows: DataFrame, vocabulary) -> dict[bytes, int]:
    """In how many rows each benchmark word occurs, over all rows."""
    ship(rows.sparkSession)

    def count(batches):
        known, n = vocabulary.value, Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                n.update(known.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())],
                                         names=["word", "n"])

    parts = rows.select("text").mapInArrow(count, "word binary, n long")
    return {bytes(w): n for w, n in parts.groupBy("word").agg(F.sum("n")).collect()}


class Matcher:
    """Spans and items of each text of a batch."""

    def __init__(self, index: Index):
        self.index = index

    def __call__(self, texts):
        out = [self.match(words(t)) for t in texts]
        return [list(c) for c in zip(*out)] or [[], [], []]

    def match(self, w: list[bytes]):
        places, n = self.index.places, len(w)
        if places.keys().isdisjoint(w):
            return n, [], []
        spans, items = [], set()
        ranges, wanted = [], []
        for i, here in enumerate(map(places.get, w)):
            for at, size in here or ():
                start = i - at
                if start >= 0 and start + size <= n:
                    ranges.append((start, start + size))
                    wanted.append(b" ".join(w[start:start + size]))
            if len(ranges) >= LOOKUPS:
                self.look_up(ranges, wanted, spans, items)
                ranges, wanted = [], []
        if ranges:
            self.look_up(ranges, wanted, spans, items)
        return n, merged(spans), sorted(x for x in items if x is not None)

    def look_up(self, ranges: list, wanted: list[bytes], spans: list, items: set):
        for k, found in self.index.find(wanted, list(map(xxh64_intdigest, wanted))):
            spans.append(ranges[k])
            items |= found


def merged(spans: list) -> list[dict]:
    """Overlapping and touching ranges as one, sorted."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _merge_all(column):
    return [[merged([(s["start"], s["end"]) for s in spans]) for spans in column]]
