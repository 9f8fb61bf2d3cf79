"""Best-fit packing with swap-based local search.

Documents become token pieces of one sequence's length at most.  A full piece is
a sequence by itself.  The others are dealt by a hash of their row number into
blocks of some thousands, so blocks are even whatever the documents look like.
In a block, best fit puts them into bins, and a local search then moves pieces
into, exchanges one for one with, or gives two for one to fuller bins, from the
emptiest bin up; each step increases the sum of squared fills, until bins empty
or nothing improves.  Bins that are still underfull are opened again, and their
pieces dealt into fewer blocks, level by level, until one block is left or a
level no longer closes half of its pieces.

Only (row, length) pairs shuffle; texts and ids don't.
"""
from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import ship, slices, stored

CAPACITY = 1024
END = 2  # the id after each document
BLOCK = 8192  # pieces in a block, about
#: Splits a text before byte-level merging, and the token that is never split: fixed values of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>", 50256)
PIECE = "piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end: int = END, block: int = BLOCK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary``: a byte-level BPE in tiktoken's format, read by the driver.
    A document is its tokens and ``end``; a null text is empty, so one token.
    Longer documents are cut into pieces of ``capacity``, the first one shorter
    if need be.  Repeated rows are packed each for itself; an empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    pieces = stored(cut(docs, vocabulary, id_col, text_col, capacity, end)
                    .withColumn("row", F.monotonically_increasing_id()))
    places = pack_lengths(pieces.where(F.col("length") < capacity).select("row", "length"), capacity, block)
    full = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(pieces.join(places, "row")).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def cut(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """Tokenizes; one row per piece with its document's ``id``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.schema["id"].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = Encoder(ranks.value)
        for b in slices(batches):
            out, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + tail
                n = len(ids) // 4
                stop = n % capacity or capacity
                for k in range(-(-n // capacity)):
                    start = max(0, stop - capacity)
                    out.append((k, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    at.append(i)
                    stop += capacity
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if cols:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cols],
                                                 names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {schema}, {PIECE}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Token ids of a text, as little-endian 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = np.array([SPECIAL[1]], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL[0] in text:
            return self.mark.join(self(x) if x else b"" for x in text.split(SPECIAL[0]))
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()


#: A sequence's number: level, block and bin, from the highest bit on (128 levels,
#: 2^36 blocks, 2^20 bins).
LEVEL_BITS = 56


def pack_lengths(items: DataFrame, capacity: int, block: int) -> DataFrame:
    """(row, sequence_id, offset) for (row, length) rows of distinct rows."""
    placed, level, n = None, 0, items.count()
    while True:
        blocks = -(-n // block) or 1
        last = blocks == 1
        dealt = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        packed = stored(dealt.groupBy("block").applyInPandas(
            _pack_block(capacity, level, last),
            "row long, length long, sequence_id long, offset long, closed boolean"))
        left = 0 if last else packed.where("not closed").count()
        if last or left > n // 2:
            done = packed
        else:
            done = packed.where("closed")
        done = done.select("row", "sequence_id", "offset")
        placed = done if placed is None else placed.unionAll(done)
        if last or left > n // 2 or not left:
            return placed
        items, n, level = packed.where("not closed").select("row", "length"), left, level + 1


def _pack_block(capacity: int, level: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, lengths = part["row"].tolist(), part["length"].tolist()
        bins = search(best_fit(lengths, capacity), capacity)
        by_length = defaultdict(list)
        for r, x in sorted(zip(rows, lengths), reverse=True):
            by_length[x].append(r)
        first = level << LEVEL_BITS | int(part["block"].iloc[0]) << 20
        out = []
        for b, sizes in enumerate(bins):
            at = 0
            closed = last or sum(sizes) == capacity
            for x in sizes:
                out.append((by_length[x].pop(), x, first + b, at, closed))
                at += x
        return pd.DataFrame(out, columns=["row", "length", "sequence_id", "offset", "closed"])
    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: each, from the longest, goes where it leaves least room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    some = 0  # bit r: a bin with free room r
    for x in sorted(lengths, reverse=True):
        fits = some >> x
        if fits:
            free = x + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
            bins[b].append(x)
        else:
            free, b = capacity, len(bins)
            bins.append([x])
        room[free - x].append(b)
        some |= 1 << free - x
    return bins


def search(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search: pieces of the emptiest bin go to fuller ones while that
    increases the squared fill; a bin that no step improves is done.  Bins of
    the same lengths are alike, so they are kept as counts."""
    out = [b for b in bins if sum(b) == capacity]
    work = Counter(tuple(sorted(b)) for b in bins if sum(b) < capacity)
    while work:
        source = min(work, key=lambda b: (sum(b), b))
        taken(work, source)
        now, better = list(source), True
        while now and better:
            better = False
            for target in sorted((b for b in work if sum(b) >= sum(now)), key=lambda b: (-sum(b), b)):
                while work[target] and now and sum(target) >= sum(now):
                    fuller = list(target)
                    if not step(now, fuller, capacity - sum(fuller)):
                        break
                    better = True
                    taken(work, target)
                    if sum(fuller) == capacity:
                        out.append(fuller)
                    else:
                        work[tuple(fuller)] += 1
        if now == list(source):  # so are all like it
            out += [now] * (1 + work.pop(source, 0))
        elif now:
            out.append(now)
    return out


def taken(work: Counter, bin: tuple) -> None:
    work[bin] -= 1
    if not work[bin]:
        del work[bin]


def step(source: list[int], target: list[int], room: int) -> bool:
    """The step from source to target, at least as full, that fills most of
    ``room``: a move, one for one, or two for one.  Whether one was made."""
    best, give, take = 0, (), ()
    if not room:
        return False
    for out in (0, *dict.fromkeys(target)):
        most = out + room  # what may come in for it
        k = bisect_right(source, most)
        if k and source[k - 1] - out > best:
            best, give, take = source[k - 1] - out, (source[k - 1],), (out,) if out else ()
        if best == room:
            break
        i, j = 0, len(source) - 1
        while i < j:  # the two that come closest
            two = source[i] + source[j]
            if two > most:
                j -= 1
                continue
            if two - out > best:
                best, give, take = two - out, (source[i], source[j]), (out,) if out else ()
            i += 1
    for x in give:
        source.remove(x)
        insort(target, x)
    for x in take:
        target.remove(x)
        insort(source, x)
    return bool(give)
