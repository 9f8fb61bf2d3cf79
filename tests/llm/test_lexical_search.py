import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import docs_of

from dockline.llm import lexical_search as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]


def brute(docs, items, top=50):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    queries = defaultdict(set)
    for item, t in items:
        queries[item].update(terms(t))
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, query in queries.items():
        scores = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * (10 ** 9 * c[w] // (1000 * c[w] + 20 * m)) for w in query if w in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=str_last)[:top], 1)]
    return sorted(out, key=str)


def str_last(x):
    return x[0], x[1], x[2] or 0


def tables(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "of", "é", "日本", "x_y"]
    shared = [rng.sample(vocabulary, 6) for _ in range(4)]
    items = [(k, " ".join(rng.choice(shared) + rng.sample(vocabulary, rng.randrange(6)))) for k in range(25)]
    items += [(3, "extra THE the"), (None, "nobody w1"), (40, None), (41, ""), (42, "!!!"), (43, "notthere")]
    docs = [(k, ", ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 80])))) for k in range(300)]
    docs += [(500 + k, docs[k % 5][1]) for k in range(40)]  # ties
    return docs + [(None, docs[0][1]), (None, None), (700, ""), (701, "--"), (2, docs[2][1])], items


def test_dag_sums_to_each_item_with_fewer_additions():
    _, items = tables()
    block = {i: set(S.words(t)) for i, t in items if i != 3}
    dag = S.sharing_dag(block)
    made = [{w} for w in sorted(dag.terms, key=dag.terms.get)]
    for left, right in dag.levels:
        level = [made[a] | made[b] for a, b in zip(left.tolist(), right.tolist())]
        assert all(made[a].isdisjoint(made[b]) for a, b in zip(left.tolist(), right.tolist()))
        made += level
    assert dag.n_nodes == len(made) and dag.levels
    for item, parts in zip(dag.items, dag.parts):
        assert set().union(*(made[x] for x in parts)) == block[item]
        assert sum(len(made[x]) for x in parts) == len(block[item])  # nothing is added twice
    alone = sum(len(w) - 1 for w in block.values() if w)
    assert sum(len(p) - 1 for p in dag.parts) + sum(len(a) for a, _ in dag.levels) < alone / 2
    assert S.sharing_dag({}).items == S.sharing_dag({1: set()}).items == []


@pytest.mark.parametrize("block_chars", [10_000, 300])
def test_against_every_document(spark, block_chars):
    docs, items = tables()
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "'x' AS rank")
    got = S.search(docs_of(spark, docs).repartition(5), frame, block_chars=block_chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    few = S.search(docs_of(spark, docs), frame, top=3)
    assert sorted(map(tuple, few.collect()), key=str) == brute(docs, items, 3)


def test_slices_of_documents_give_the_same_best():
    docs, items = tables()
    dag = S.sharing_dag({i: set(S.words(t)) for i, t in items if i != 3})
    counted = [(i, *S.term_counts(t, dag.terms)) for i, t in docs if S.words(t)]
    batch = pa.table({"id": [x[0] for x in counted], "n": [x[1] for x in counted],
                      "terms": pa.array([x[2] for x in counted], pa.list_(pa.int32())),
                      "counts": pa.array([x[3] for x in counted], pa.list_(pa.int64()))}).to_batches()[0]
    held = []
    for width in (1, 7, 1000):
        scorer = S.Scorer(dag, np.arange(1, len(dag.terms) + 1), len(counted), sum(x[1] for x in counted), 5)
        scorer.width = width
        scorer.add(batch.slice(0, 100))
        scorer.add(batch.slice(100))
        held.append([h.tolist() for h in scorer.held])
        assert max(h.shape[1] for h in scorer.held) == 5
    assert [sorted(map(tuple, zip(*h))) for h in held[0]] == [sorted(map(tuple, zip(*h))) for h in held[2]]
    assert [sorted(map(tuple, zip(*h))) for h in held[1]] == [sorted(map(tuple, zip(*h))) for h in held[2]]


def test_long_texts_are_counted_in_chunks():
    text = " ".join(f"w{k % 7} end" for k in range(200))
    index = {b"w3": 0, b"end": 1, b"no": 2}
    whole = S.term_counts(text, index)
    n, found, counts = S.term_counts(text, index, chunk=5)
    assert n == whole[0] == 400 and dict(zip(found, counts)) == dict(zip(*whole[1:])) == {
        0: len(range(3, 200, 7)), 1: 200}
    assert S.term_counts("x" * 50 + " end", index, chunk=5) == (2, [1], [1])
    assert S.term_counts(None, index) == S.term_counts("", index) == (0, [], [])


def test_odd_documents_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([("a", "twice"), ("b", "the thing")], "item_id string, text string")
    rows = S.search(odd, items).collect()
    assert [(r.rank, r.doc_id) for r in sorted(rows, key=lambda r: r.rank) if r.item_id == "a"] == [
        (1, 12), (2, 12), (3, 13)]
    assert {r.doc_id for r in rows if r.item_id == "b"} == {7, 8, 18}
    assert S.search(empty, items).count() == 0 and S.search(odd, items.limit(0)).count() == 0
