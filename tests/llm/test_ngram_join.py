import random
import re

import numpy as np
import pytest
from cases import ODD, docs_of

from dockline.llm import ngram_join as J


def shingles(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, percent=85):
    """All pairs of distinct sets, then least ids over links."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(docs)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def corpus(seed, n_bases=14, copies=14):
    """Bases of all sizes, copies with a few words changed, added or left out, and a
    passage that many of them share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=30)
    docs = []
    for _ in range(n_bases):
        base = rng.choices(vocabulary, k=rng.choice([3, 9, 12, 20, 60, 150, 400]))
        base = base + passage if rng.random() < 0.5 else base
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 60 + 2)):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            docs.append(" ".join(w).title() if rng.random() < 0.2 else "\n ".join(w))
    rng.shuffle(docs)
    return [(k + 100, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("percent", [85, 70])
def test_components_against_all_pairs(spark, percent):
    docs = corpus(percent) + [(None, "null id one two three"), (7, "Null id ONE two three"), (7, None), (8, ""),
                              (9, "a b"), (10, "A b"), (11, "a b c"), (12, "a b c d"), (12, "a b c d")]
    got = J.jaccard_components(docs_of(spark, docs).repartition(5), percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, percent)


def test_blocks_of_a_bucket_miss_no_pair(spark, monkeypatch):
    """All links found by comparing blocks alone, without a round of leaders."""
    docs = corpus(5, 3, 40)
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "leaders", lambda live, percent, turn: live.select(
        J.F.col("node").alias("a"), J.F.col("node").alias("b")).limit(0))
    assert sorted(map(tuple, J.jaccard_components(docs_of(spark, docs)).collect()), key=str) == brute(docs)


def test_every_linked_pair_meets_where_one_side_looks():
    """Signatures alone: linked sets share a subset, or one is a neighbour of the other's,
    also when each leaves out as many look-ups as it can spare."""
    rng = np.random.default_rng(4)
    sizes = J.Sizes(85)
    for n in [7, 8, 13, 20, 33, 70, 71, 150, 400, 1500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            total = 2 * n
            gone = rng.integers(0, sizes.difference(total) // 2 + 1)
            b = np.unique(np.append(a[gone:], rng.integers(0, 2**64, rng.integers(0, gone + 1), dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            if len(a) == len(b) == common or 100 * common < 85 * (len(a) + len(b) - common):
                continue
            met = []
            for one, other in ((a, b), (b, a)):
                looks, found = {}, set()
                for role, spare, sigs, places in J.signatures(one, J.mixed(one), sizes):
                    cost = list(zip(sigs.tolist(), places.tolist()))
                    rng.shuffle(cost)
                    left_out = {place >> 2 for _, place in [x for x in cost if not x[1] & 1][:spare]}
                    looks |= {sig: place & 1 for sig, place in cost if place >> 2 not in left_out or place & 1}
                for _, _, sigs, places in J.signatures(other, J.mixed(other), sizes):
                    found |= {sig for sig, place in zip(sigs.tolist(), places.tolist())
                              if sig in looks and not (looks[sig] and place & 1)}
                met.append(bool(found))
            assert any(met)


def test_bands_are_adjacent_and_points_suffice():
    for percent in (85, 70, 95):
        sizes = J.Sizes(percent)
        for n in [*range(1, 400), 5000, 123_456]:
            assert sizes.band(sizes.partner(n)) - sizes.band(n) in (0, 1)
            for _, _, m, near, need in sizes.roles(n):
                assert need <= m + near and need <= m


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        for extra in (0, 1, 9, 200):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.append(a[n // 9:], rng.integers(0, 2**64, extra, dtype=np.uint64))
            x, y = J.hamming_of([J.parities(a), J.parities(b)], [J.parities(b), J.parities(b)])
            assert 0 <= x <= n // 9 + extra and y == 0


def test_odd_documents_and_empty_tables(spark, odd, empty):
    rows = {r.doc_id: r for r in J.jaccard_components(odd).collect()}
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0
    assert [rows[k].component_id for k in (1, 2, 3, 15)] == [1, 2, 3, 15]
    assert rows[4].component_id == rows[5].component_id == rows[6].component_id == 4
    assert rows[7].component_id == rows[8].component_id == 7 and rows[13].component_id == 12
    assert J.jaccard_components(odd).count() == len(ODD)
    assert J.jaccard_components(empty).count() == 0


def test_long_texts_are_read_in_chunks():
    text = " ".join(f"w{k % 50} \t\nX{k}" for k in range(300_000))
    assert len(J.shingle_set(text, 4)) == len(shingles(text))


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a", b"ab", b"ba", b"a\x00", "日本".encode(), b"x" * 63, b"x" * 64, b"x" * 65, b"y" * 5000, b"x" * 66]
    alone = [J.word_hashes(w).tolist() for w in words]
    assert all(len(h) == 1 for h in alone) and len({h[0] for h in alone}) == len(words)
    assert J.word_hashes(b"  " + b"   ".join(words) + b" ").tolist() == [h[0] for h in alone]
    assert not len(J.word_hashes(b"")) and not len(J.word_hashes(b"   "))
