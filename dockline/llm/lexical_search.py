"""Ranked lexical search of many items at once, by common-subexpression evaluation.

The query set is evaluated as one sum-sharing program, not item by item:

1. One pass over all texts counts the query terms of every document (postings,
   stored once); the corpus statistics are aggregations over them.
2. Term sets that several items share are mined from the items: the pairs of
   terms that most items have in common become nodes, pairs of nodes larger
   nodes, until no pair is shared.  The result is a DAG: terms, shared sets, items.
3. Documents pass through the DAG in slices.  A slice's partial accumulators, one
   row of whole numbers for each node, are made once, level by level, whatever the
   number of items that use them; an item's scores are the sum of the few nodes
   left of it.
4. Every task keeps the best documents of each item; two rounds of ranking, the
   first in groups of tasks, so that no group grows with the tasks, leave the
   best of all.

Scores are sums of whole numbers, so neither sharing nor slicing changes them.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockline.llm.common import CHUNK, WORD_BYTES, chunks, over_batches, ship, stored, words

TOP = 50
#: Characters of item text that are searched for at once.
BLOCK_CHARS = 500_000
#: Bytes of the accumulators of a slice of documents.
SLICE_BYTES = 32 << 20
#: Nodes are paired with so many next ones, in order of the items that hold them.
REACH = 8


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item id, rank, document id, score): the ``top`` best documents of each item.

    Ids of documents are whole numbers.  Terms: runs of letters, digits and
    non-ASCII of the whole text with A-Z lower-cased; a null or empty text, on
    either side, has none.  Only scores above 0 are ranked; equal scores rank by
    ascending id, a null id last.  Repeated documents are ranked each; rows of
    ``items`` with one id, null too, are one item.  Items without terms, and all
    items over an empty table of documents, have no rows.  Items are searched in
    blocks of ``block_chars`` characters (a longer item is a block of its own),
    so that what is collected and broadcast is bounded.  Other columns are not
    read.
    """
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    item_type = items.schema[item_col].dataType
    found = None
    for block in item_blocks(items, item_col, item_text_col, block_chars):
        best = best_documents(rows, block, item_type, top)
        found = best if found is None else found.unionAll(best)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for by in (["item", "tasks"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
            F.col("rank") <= top)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[dict]:
    """The items as {id: terms}, in blocks of about ``block_chars`` characters by a
    hash of the id; one block is in memory at a time while it is read."""
    rows = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        terms: dict = defaultdict(set)
        for item, text in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect():
            terms[item].update(words(text))
        yield terms


class Dag(NamedTuple):
    """Nodes: first the terms, then each level's sums of two nodes of lower levels."""
    terms: dict[bytes, int]
    levels: list[tuple[np.ndarray, np.ndarray]]
    items: list
    parts: list[list[int]]  # the nodes whose sum is an item

    @property
    def n_nodes(self) -> int:
        return len(self.terms) + sum(len(a) for a, _ in self.levels)


def sharing_dag(terms: dict) -> Dag:
    """The DAG of a block of {item: terms}.

    Round by round, pairs of nodes are counted over the items; each item's nodes
    are in order of how many items hold them, and a node is paired with the
    ``REACH`` next ones, which keeps a round linear in the block.  Pairs that two
    items or more still hold become nodes, the most frequent first.
    """
    items = sorted((x for x in terms if terms[x]), key=lambda x: (x is None, x))
    index = {w: k for k, w in enumerate(sorted(set().union(*(terms[x] for x in items))))}
    parts = [{index[w] for w in terms[x]} for x in items]
    holders: dict[int, set[int]] = defaultdict(set)
    for k, nodes in enumerate(parts):
        for x in nodes:
            holders[x].add(k)
    levels, n = [], len(index)
    while True:
        pairs: Counter = Counter()
        for nodes in parts:
            shared = sorted((x for x in nodes if len(holders[x]) > 1), key=lambda x: (-len(holders[x]), x))
            for d in range(1, REACH + 1):
                pairs.update((min(p), max(p)) for p in zip(shared, shared[d:]))
        level = []
        for (a, b), count in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            both = holders[a] & holders[b] if count > 1 else ()
            if len(both) < 2:
                continue
            new = n + len(level)
            level.append((a, b))
            holders[new] = both
            for k in both:
                parts[k] -= {a, b}
                parts[k].add(new)
            holders[a], holders[b] = holders[a] - both, holders[b] - both
        if not level:
            return Dag(index, levels, items, [sorted(nodes) for nodes in parts])
        levels.append(tuple(np.array(x) for x in zip(*level)))
        n += len(level)


def best_documents(rows: DataFrame, block: dict, item_type: T.DataType, top: int) -> DataFrame:
    """(item, id, score, tasks): of each task's documents the best of each item;
    ``tasks``: the group of tasks."""
    spark = rows.sparkSession
    dag = sharing_dag(block)
    schema = T.StructType([T.StructField("item", item_type), T.StructField("id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("tasks", T.IntegerType())])
    if not dag.items:
        return spark.createDataFrame([], schema)
    posts = stored(postings(rows, dag.terms))
    n_docs, n_terms = posts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most one row for each term of the block
    held = posts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(dag.terms), np.int64)
    for term, df in held:
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    groups = math.isqrt(posts.rdd.getNumPartitions()) + 1
    program = spark.sparkContext.broadcast((dag, weight, n_docs, n_terms))
    ship(spark)

    def run(batches):
        scorer = Scorer(*program.value, top)
        for b in batches:
            scorer.add(b)
        yield from scorer.best(schema, TaskContext.get().partitionId() % groups)

    return posts.mapInArrow(run, schema)


def postings(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of each document with terms: n of all its terms, the
    query terms in it and how often each occurs."""
    known = rows.sparkSession.sparkContext.broadcast(terms)

    def make():
        index = known.value

        def count(texts):
            found = [term_counts(t, index) for t in texts]
            return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]
        return count

    return over_batches(rows, make, "n long, terms array<int>, counts array<long>", 1).where("n > 0")


def term_counts(text: str | None, index: dict[bytes, int], chunk: int = CHUNK) -> tuple[int, list[int], list[int]]:
    """How many terms the text has, and the counts of those in ``index``; a long
    text is split chunk by chunk."""
    data = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b""
    n, counts = 0, Counter()
    for part in chunks(data, chunk):
        found = part.split()
        n += len(found)
        counts.update(found)
    known = counts.keys() & index.keys()
    return n, [index[w] for w in known], [counts[w] for w in known]


class Scorer:
    """The best documents of each item among those added."""

    def __init__(self, dag: Dag, weight: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.dag, self.weight, self.n_docs, self.n_terms, self.top = dag, weight, n_docs, n_terms, top
        self.nodes = np.concatenate([np.array(p) for p in dag.parts])
        self.starts = np.cumsum([0] + [len(p) for p in dag.parts[:-1]])
        self.width = max(1, SLICE_BYTES // (8 * (dag.n_nodes + len(self.nodes))))
        self.least = np.ones(len(dag.items), np.int64)  # a score that may still be among the best
        self.held = [np.empty((3, 0), np.int64) for _ in dag.items]  # minus score, whether the id is null, id

    def add(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, self.width):
            part = batch.slice(at, self.width)
            ids, n, terms, counts = (part.column(part.schema.names.index(c)) for c in ("id", "n", "terms", "counts"))
            scores = self.scores(n.to_numpy(zero_copy_only=False), np.diff(terms.offsets.to_numpy()),
                                 terms.flatten().to_numpy(zero_copy_only=False),
                                 counts.flatten().to_numpy(zero_copy_only=False))
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            self.keep(scores, null, ids.fill_null(0).to_numpy(zero_copy_only=False))

    def scores(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Items by documents."""
        dag, doc = self.dag, np.repeat(np.arange(len(n)), sizes)
        m = 50 + 50 * n * self.n_docs // self.n_terms
        sums = np.zeros((dag.n_nodes, len(n)), np.int64)
        sums[terms, doc] = self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        at = len(dag.terms)
        for left, right in dag.levels:
            np.add(sums[left], sums[right], out=sums[at:at + len(left)])
            at += len(left)
        return np.add.reduceat(sums[self.nodes], self.starts, axis=0)

    def keep(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[:, None]
        for k in np.flatnonzero(good.any(axis=1)):
            some = good[k]
            held = np.concatenate([self.held[k], np.stack([-scores[k, some], null[some], ids[some]])], axis=1)
            if held.shape[1] > self.top:
                held = held[:, np.lexsort(held[::-1])[:self.top]]
                self.least[k] = -held[0, -1]
            self.held[k] = held

    def best(self, schema: T.StructType, tasks: int):
        from pyspark.sql.pandas.types import to_arrow_type
        sizes = [h.shape[1] for h in self.held]
        if not sum(sizes):
            return
        minus, null, ids = np.concatenate(self.held, axis=1)
        items = pa.array(self.dag.items, to_arrow_type(schema["item"].dataType)).take(
            pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays(
            [items, pa.array(ids, mask=null.astype(bool)), pa.array(-minus),
             pa.array(np.full(len(ids), tasks, np.int32))], names=schema.names)
