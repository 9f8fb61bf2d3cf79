import random
import re

from cases import ODD, docs_of
from xxhash import xxh64_intdigest

from dockline.llm import simhash_dedup as S


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    """Least position reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_whole_query_against_all_pairs(small, small_texts):
    prints = [fingerprint(t) for _, t in small_texts]
    want = {(i, f"{f:016x}", small_texts[c][0]) for (i, _), f, c in zip(small_texts, prints, classes(prints, 2))}
    assert {tuple(r) for r in S.simhash_components(small).collect()} == want


def test_chains_of_near_fingerprints(spark):
    for radius in (0, 1, 2):
        rng = random.Random(radius)
        prints = set()
        for _ in range(12):
            x = rng.getrandbits(64)
            for _ in range(60):
                y = x
                for _ in range(rng.randrange(1, 4)):
                    y ^= 1 << rng.randrange(64)
                prints.add(y)
                x = rng.choice([x, y])
        prints = sorted(prints)
        df = spark.createDataFrame([(S.signed(x), k) for k, x in enumerate(prints)], "fp long, least long")
        got = {r.fp & 2**64 - 1: r.component_id for r in S.components(df, radius).collect()}
        assert got == dict(zip(prints, classes(prints, radius)))


def test_any_two_bits_are_outside_some_mask():
    masks = S.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_odd_documents(spark, odd, empty):
    rows = S.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert {by[k].component_id for k in (1, 2, 3, 15)} == {1} and by[1].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[None].component_id is None
    assert S.simhash_components(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(12) == 1 and 13 not in ids and None in ids and ids.count(1) == 1 and 15 not in ids
    # an id in two groups: each row is judged by itself
    twin = docs_of(spark, [(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v")])
    assert sorted((r.doc_id, r.text[0]) for r in S.keep_one(twin).collect()) == [(1, "a"), (2, "q")]
