import zlib
from collections import Counter, defaultdict

from cases import ODD, docs_of

from dockline.llm.sharding import _propagate, assign_shards, even_out


def check(rows, source, shards=24):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), size(t), zlib.crc32((t or "").encode())) for i, t in source)
    slots, loads = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return loads


def outside(rows):
    """Linked documents that aren't in their group's main shard."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_crc32, r.size][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_bytes_are_even_and_copies_together(small, small_texts):
    rows = assign_shards(small, shards=4).collect()
    loads = check(rows, small_texts, 4)
    assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 4
    assert outside(rows) <= 2


def test_a_hot_group_fills_whole_shards(spark):
    rows = [(k, "x" * 100) for k in range(1000)] + [(1000 + k, f"text {k} " + "y" * (k % 150)) for k in range(2000)] \
        + [(5000 + k, f"pair {k // 2} " + "z" * 60) for k in range(200)]
    got = assign_shards(docs_of(spark, rows), shards=8).collect()
    loads = check(got, rows, 8)
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < 1.01 * mean and min(loads.values()) > 0.99 * mean
    hot = Counter(r.shard for r in got if r.size == 108 and r.doc_id < 1000)
    full = 108 * 1000 / mean  # shards the group fills
    assert sum(sorted(hot.values())[::-1][:int(full) + 2]) > 950
    pairs = [r for r in got if r.doc_id >= 5000]
    assert outside(pairs) <= 30


def test_odd_documents(odd, empty):
    check(assign_shards(odd).collect(), ODD)
    assert assign_shards(empty).count() == 0


def test_even_out_moves_the_sample_only():
    moves = even_out([100, 0], [(1, 30, 0, True), (2, 25, 0, False), (3, 90, 0, True)])
    assert moves == {1: 1, 2: 1} or moves == {1: 1}


def test_a_refused_group_moves_to_a_shard_with_room(spark):
    # group 1 is mostly in the full shard 0, group 2 nowhere else but in full ones
    rows = [(1, 100, 1, 300, 0), (2, 100, 1, 300, 0), (3, 100, 1, 300, 1), (4, 50, 2, 100, 0), (5, 50, 2, 100, 3)]
    linked = spark.createDataFrame(rows, "row long, size long, group long, bytes long, shard int")
    got = {r.row: r.shard for r in _propagate(linked, [1000, 500, 500, 1000], 1000, 4, 1, 5).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] and got[4] in (1, 2)
