"""Jaccard join of word n-gram sets, exact, by universe partition and pigeonhole.

Sets: the distinct hashes of a text's word shingles.  Texts with equal sets are
one node.  Two sets of sizes a and b that link differ in h(a + b) shingles at most.

Size bands: a band ends where a set no longer links with the band's smallest, so
linked sets lie in one band or in two adjacent ones.  Group g joins band g with
itself and with band g + 1.

Segments: in group g the universe of shingles is hashed into h + 1 segments, h
being the group's largest difference.  A set's signature in a segment is the hash
of the subset there.  By the pigeonhole principle two linked sets agree on some
segment.  A few segments of a group also hold the one-deletion neighbourhood of
the subset (the subset less any one shingle), which finds subsets that differ in
one shingle, so that each of these counts for two.

Allocation: a set needs as many points as it may differ in shingles, and one
more.  Every segment it looks up is a point, every one-deletion neighbourhood
another.  What is left over, because the set is smaller than its group's largest
or because of the neighbourhoods, pays for leaving out the costliest look-ups: a
segment without shingles isn't even written, if the set can do without all of
those, and of the others those in the fullest buckets go.  One complete set of
look-ups finds all partners, so of a pair it is enough that one side looks.

Verification: sizes; then parities of the shingles in a few hundred bits, whose
differences are a lower bound of the sets'; then the sets themselves.

A bucket's pairs are never listed as they are.  In rounds, each set is verified
against one leader of the buckets it shares most of, and linked sets get one
label; buckets with a single label are done.  When rounds link little more, the
pairs with different labels of what is left are compared in blocks, and only
those that the parities let through leave a task.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dockline.llm.common import chunks, over_batches, ship, slices, stored, text_of

SHINGLE = 4
PERCENT = 85
#: A group has one segment with neighbourhoods, and one more for so many segments.
SEGMENTS_A_NEIGHBOURHOOD = 128
#: Rows of a bucket that are compared with each other, or with as many others, at a time.
BLOCK = 256
#: Sets that a task remembers.
REMEMBERED = 1 << 20
#: Pairs (of two numbers) whose sets are named in a broadcast.
BROADCAST_PAIRS = 250_000
#: Bits of the filter for texts whose sets are needed (8 MB), in blocks of Spark's bitmaps.
FILTER_BITS = 1 << 26
BLOCK_BITS = 8 * 4096

#: A-Z lower-cased; the white space that separates words as spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Words: runs of other characters than space and ``\\t\\n\\v\\f\\r``, A-Z
    lower-cased; the set: distinct shingles of ``shingle`` words, or the whole of a
    shorter text.  Two documents link if 100 times the shingles they share are
    ``percent`` times those they have together, or more; component_id is the
    smallest id reachable over links, its own included (nulls are not smallest
    unless all ids there are null).  A text without words, null too, has no
    shingles and is linked with nothing.  Equal texts and repeated rows share a
    component.  Shingles count as equal if their 64-bit hashes are, sets if the
    sums of theirs are.  Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(described(docs, shingle, percent))
    n = rows.count()
    nodes = stored(rows.where("bits is not null").dropDuplicates(["node"]), n)
    live = allocated(shared_buckets(docs, shingle, percent), nodes)
    labels = linked(live, nodes, docs, shingle, percent, n)
    least = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    least = stored(least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), n)
    components = stored(least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label")
                        .select("node", "component_id"), n)
    return rows.join(components, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


# ---- sizes ----------------------------------------------------------------------------------------

class Sizes:
    """Bands, groups and their segments for a least similarity of ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]  # of the bands
        self.salts: dict[int, np.ndarray] = {}

    def difference(self, total: int) -> int:
        """Shingles in which linked sets of ``total`` shingles together differ at most."""
        return (100 - self.percent) * total // (100 + self.percent)

    def partner(self, n: int) -> int:
        """The largest set that links with one of ``n``."""
        return 100 * n // self.percent

    def salt(self, group: int, m: int) -> np.ndarray:
        """A number for each segment of a group, so that equal subsets elsewhere differ."""
        if group not in self.salts:
            self.salts[group] = mixed(np.arange(m, dtype=np.uint64) + np.uint64((group + 1) << 32))
        return self.salts[group]

    def band(self, n: int) -> int:
        while self.starts[-1] <= self.partner(self.partner(n)) + 2:
            last = self.starts[-1]
            self.starts.append(max(last + 1, self.partner(last - 1) + 1))
        return bisect_right(self.starts, n) - 1

    def roles(self, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(role, group, segments, neighbourhoods, points needed) of a set: role 0 in
        the group of its band, role 1 as the larger one in the group below."""
        for role in (0, 1):
            group = self.band(n) - role
            if group < 0:
                continue
            top = self.starts[group + 1] - 1
            most = self.difference(top + self.partner(top))
            if not most or role and n > self.partner(top):
                continue  # only equal sets link there, or none
            need = self.difference(n + (top if role else self.partner(n))) + 1
            yield role, group, most + 1, 1 + (most + 1) // SEGMENTS_A_NEIGHBOURHOOD, need


# ---- sets of a text -------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no pattern in them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte (none for the space) and for each place in a word.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
BYTES[0x20] = 0
PLACES = mixed(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word between the spaces of ``data``."""
    if not (data := data.lstrip(b" ")):
        return np.empty(0, np.uint64)
    codes = np.frombuffer(data, np.uint8)
    inside = np.append(codes != 0x20, False)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = np.append(0, edges[1::2]), edges[::2]
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    hashes = np.add.reduceat(BYTES[codes] * PLACES[np.minimum(place, len(PLACES) - 1)], starts)
    for k in np.flatnonzero(ends - starts > len(PLACES)):
        hashes[k] = xxh64_intdigest(data[starts[k]:ends[k]])
    return mixed(hashes)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD) if text else b""
    parts = [word_hashes(part) for part in chunks(data)]
    w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    k = min(shingle, len(w))
    if not k:
        return w
    joined = np.full(len(w) - k + 1, k, np.uint64)  # a shorter text's shingle is no shingle of a longer one
    for j in range(k):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - k + 1 + j]
    joined = mixed(joined)
    joined.sort()
    return joined[np.append(True, joined[1:] != joined[:-1])]


def signed(x: np.uint64) -> int:
    return int(x.view(np.int64))


def node_of(values: np.ndarray) -> int:
    """The name of a set: a hash of the sum of its members' ``mixed`` values and its size."""
    return signed(mixed(np.array([values.sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64))[0])


def parities(members: np.ndarray) -> bytes:
    """One bit for each class of members by their low bits, set if it is odd; twice to
    four times as many classes as members, a power of two."""
    width = max(64, 1 << (2 * len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def segments(members: np.ndarray, sizes: Sizes):
    """Of a set in its groups: (role, group, segments with neighbourhoods, each member's
    segment, the segments that are written, points to spare)."""
    high = members >> np.uint64(32)
    for role, group, m, near, need in sizes.roles(len(members)):
        segment = (high * np.uint64(m) >> np.uint64(32)).view(np.int64)
        written = np.bincount(segment, minlength=m) > 0
        written[:near] = True
        spare = m + near - need
        if (empty := m - int(np.count_nonzero(written))) <= spare:
            spare -= empty
        else:
            written[:] = True
        yield role, group, near, segment, written, spare


def signatures(members: np.ndarray, values: np.ndarray, sizes: Sizes):
    """(role, points to spare, signatures, places) of a set in its groups.  A place
    is the segment's number, the role and whether it is a neighbour, in one number."""
    for role, group, near, segment, written, spare in segments(members, sizes):
        sums = sizes.salt(group, len(written)).copy()
        np.add.at(sums, segment, values)
        less = np.flatnonzero(segment < near)
        at = segment[less]
        filled = np.flatnonzero(written)
        sigs = mixed(np.concatenate([sums[filled], sums[at] - values[less]]))
        places = np.concatenate([filled << 2, (at << 2) | 1]) | (role << 1)
        yield role, spare, sigs.view(np.int64), places


def described(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, hash, n, node, spare, bits) of each row: the text's hash, size and name of
    its set (null if empty), points to spare in the two roles, parities (null where
    the task has met the set before)."""
    def make():
        sizes, seen = Sizes(percent), set()

        def describe(text):
            members = shingle_set(text, shingle)
            if not len(members):
                return 0, None, None, None
            values = mixed(members)
            node = node_of(values)
            if node in seen:
                return len(members), node, None, None
            remember(seen, node)
            spare = [0, 0]
            for role, _, _, _, _, points in segments(members, sizes):
                spare[role] = points
            return len(members), node, spare, parities(members)

        def run(texts):
            return [list(c) for c in zip(*map(describe, texts))] or [[], [], [], []]
        return run

    rows = docs.select("text", "id", F.xxhash64(text_of("text")).alias("hash"))
    return over_batches(rows, make, "n long, node long, spare array<long>, bits binary", 1)


def remember(seen: set, node: int) -> None:
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(node)


# ---- buckets --------------------------------------------------------------------------------------

def shared_buckets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, node, place, exacts, neighbours) of the buckets that different sets share,
    with how many subsets and how many of their neighbours are there."""
    ship(docs.sparkSession)
    names = ["sig", "node", "place"]

    def run(batches):
        sizes, seen = Sizes(percent), set()
        held, n = [], 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                members = shingle_set(text, shingle)
                values = mixed(members)
                if not len(members) or (node := node_of(values)) in seen:
                    continue
                remember(seen, node)
                for _, _, sigs, places in signatures(members, values, sizes):
                    held.append((sigs, np.full(len(sigs), node), places))
                    n += len(sigs)
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    rows = docs.select("text").mapInArrow(run, "sig long, node long, place long")
    bucket = Window.partitionBy("sig")
    rows = rows.select("*", F.min("node").over(bucket).alias("first"), F.max("node").over(bucket).alias("last"),
                       F.sum((~neighbour()).cast("long")).over(bucket).alias("exacts"),
                       F.sum(neighbour().cast("long")).over(bucket).alias("neighbours"))
    return stored(rows.where("first < last and exacts > 0").drop("first", "last").distinct())


def neighbour() -> Column:
    return F.col("place").bitwiseAND(1) == 1


def role() -> Column:
    return F.shiftright("place", 1).bitwiseAND(1)


def allocated(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node, n, place, looks, looks_near, company) of the buckets in which some set
    looks up others: those equal to its subset, and those one shingle away from it.
    ``company``: the sets in all its buckets."""
    subset = F.shiftright("place", 1)
    costs = shared.groupBy("node", subset.alias("subset")).agg(
        F.coalesce(F.max(F.when(~neighbour(), F.col("exacts"))), F.lit(0)).alias("equal"),
        (F.coalesce(F.sum(F.when(neighbour(), F.col("exacts"))), F.lit(0))
         + F.coalesce(F.max(F.when(~neighbour(), F.col("neighbours"))), F.lit(0))).alias("near"))
    points = costs.select("node", "subset", F.explode(F.array(
        F.struct(F.lit(False).alias("near"), F.col("equal").alias("cost")),
        # goes before the point of the equal ones, as its cost counts both
        F.struct(F.lit(True).alias("near"), (F.col("equal") + F.col("near")).alias("cost")))).alias("p"))
    points = points.select("node", "subset", "p.near", "p.cost").join(nodes.select("node", "n", "spare"), "node")
    dearest = Window.partitionBy("node", F.col("subset").bitwiseAND(1)).orderBy(
        F.desc("cost"), "subset", F.desc("near"))
    spare = F.when(F.col("subset").bitwiseAND(1) == 0, F.col("spare")[0]).otherwise(F.col("spare")[1])
    looks = points.select("*", (F.row_number().over(dearest) > spare).alias("looks"), F.sum(F.when(~F.col("near"), F.col(
        "cost"))).over(dearest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("company"))
    looks = looks.groupBy("node", "subset").agg(
        F.first("n").alias("n"), F.first("company").alias("company"), F.max(F.col("looks") & ~F.col("near")).alias("looks"),
        F.max(F.col("looks") & F.col("near")).alias("looks_near"))
    rows = shared.withColumn("subset", subset).join(looks, ["node", "subset"])
    useful = F.when(neighbour(), F.col("looks_near")).otherwise(
        F.col("looks") | F.col("looks_near") & (F.col("neighbours") > 0))
    rows = rows.withColumn("useful", F.max(useful).over(Window.partitionBy("sig")))
    return stored(rows.where("useful").select("sig", "node", "n", "place", "looks", "looks_near", "company"))


# ---- links ----------------------------------------------------------------------------------------

def linked(live: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """(node, label) of the sets in buckets: sets reachable from each other over links
    have one label."""
    labels = stored(live.select("node").distinct().withColumn("label", F.col("node")), n)
    if not labels.limit(1).count():
        return labels
    sets = stored(sets_of(docs, labels.select("node").join(nodes, "node").select("id", "hash"), shingle))
    verify = Verifier(nodes, sets, percent, n)
    for turn in range(1 << 30):
        live = undecided(live, labels)
        if not live.limit(1).count():
            return labels
        tried = leaders(live, percent, turn)
        links, n_tried = verify(tried)
        n_links = links.count()
        labels = relabelled(labels, links, n)
        if 10 * n_links < n_tried or not n_links:
            break
    live = undecided(live, labels)
    links, _ = verify(rest(live, nodes, percent))
    return relabelled(labels, links, n)


def undecided(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets with more than one label, with each row's label."""
    bucket = Window.partitionBy("sig")
    rows = live.drop("label").join(labels, "node")
    rows = rows.select("*", F.min("label").over(bucket).alias("first"), F.max("label").over(bucket).alias("last"))
    return stored(rows.where("first < last").drop("first", "last"))


def leaders(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each set with the leader of most of its buckets.  At first a bucket's
    leader is the set with the most company, which is near the middle of alike sets;
    later it is a hash's choice, which is the same in most buckets of alike sets."""
    chosen = F.struct(F.xxhash64("node", F.lit(turn)) if turn else -F.col("company"), "node", "n", "label")
    rows = live.withColumn("leader", F.min(F.when(~neighbour(), chosen)).over(Window.partitionBy("sig")))
    fits = percent * F.greatest("n", F.col("leader.n")) <= 100 * F.least("n", F.col("leader.n"))
    pairs = rows.where((F.col("label") != F.col("leader.label")) & fits).groupBy(
        "node", F.col("leader.node").alias("leader")).count()
    most = Window.partitionBy("node").orderBy(F.desc("count"), "leader")
    return pairs.withColumn("nth", F.row_number().over(most)).where("nth = 1").select(
        F.col("leader").alias("a"), F.col("node").alias("b"))


class Verifier:
    """The links among pairs (a, b), and how many pairs there were."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int, n: int):
        self.nodes, self.sets, self.percent, self.n = nodes.select("node", "n", "bits"), sets, percent, n

    def __call__(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        p = self.percent
        pairs = stored(pairs)
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
                for x in "ab")
        both = pairs.join(b, "b").join(a, "a").select("bits_a", "bits_b", "a", "b", "n_a", "n_b")
        near = over_batches(both, lambda: lambda x, y: [hamming_of(x, y)], "differ long", 2)
        near = stored(near.where((100 + p) * F.col("differ") <= (100 - p) * (F.col("n_a") + F.col("n_b"))).drop("differ"))
        named = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # sets that no pair names don't shuffle while the names are few; beyond, they meet by a shuffle
        named = F.broadcast(named) if near.count() <= BROADCAST_PAIRS else named
        sets = stored(self.sets.join(named, "node", "left_semi").dropDuplicates(["node"]))
        a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}")) for x in "ab")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        full = near.join(b, "b").join(a, "a").withColumn("common", common)
        return stored(full.where(100 * F.col("common") >= p * (F.col("n_a") + F.col("n_b") - F.col("common")))
                      .select("a", "b")), pairs.count()


def sets_of(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of the sets named by (id, hash).  Other texts are left out by a
    filter of fixed size, so that neither texts nor sets shuffle; what it lets through
    besides, and repeated rows, are left to those who use the sets."""
    spark = docs.sparkSession
    ship(spark)
    key = F.xxhash64("id", "hash")
    slot = key.bitwiseAND(FILTER_BITS - 1) + 1
    blocks = needed.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    known = spark.sparkContext.broadcast({r["block"] - 1: bytes(r["bits"]) for r in blocks.collect()})

    def run(batches):
        blocks, seen = known.value, set()
        for b in slices(batches):
            names, held = [], []
            for text, h in zip(b.column(0), b.column(1).to_pylist()):
                block, bit = divmod(h & FILTER_BITS - 1, BLOCK_BITS)
                if h in seen or block not in blocks or not blocks[block][bit >> 3] >> (bit & 7) & 1:
                    continue
                remember(seen, h)
                members = shingle_set(text.as_py(), shingle)
                if len(members):
                    names.append(node_of(mixed(members)))
                    held.append(members.view(np.int64))
            if held:
                ends = np.cumsum([0] + [len(x) for x in held], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(held))],
                    names=["node", "members"])

    rows = docs.select("text", "id", F.xxhash64(text_of("text")).alias("hash")).select("text", key.alias("key"))
    return rows.mapInArrow(run, "node long, members array<long>")


def relabelled(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``labels`` after linked sets' labels have become one."""
    ends = links
    for x in "ab":
        ends = ends.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x)
    pairs = ends.where("label_a <> label_b").select(
        F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
    roots = least_reachable(pairs, n)
    return stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), n)


def least_reachable(pairs: DataFrame, n: int) -> DataFrame:
    """(label, root) for links (a, b): the least label reachable, by least neighbours
    and pointer jumping."""
    both = stored(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * n)
    now = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), n)
    while True:
        seen = both.join(now.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("seen"))
        near = stored(now.join(seen, "a").select("a", F.col("m").alias("was"), F.least("m", "seen").alias("m")), n)
        jump = near.join(near.select(F.col("a").alias("m"), F.col("m").alias("next")), "m", "left")
        now = stored(jump.select("a", "was", F.least("m", "next").alias("m")), n)
        if not now.where("was <> m").limit(1).count():
            return now.select(F.col("a").alias("label"), F.col("m").alias("root"))


# ---- pairs of what is left ------------------------------------------------------------------------

def rest(live: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pairs of different labels, in one bucket in which one looks up
    the other, that sizes and parities let through.  A bucket's rows are compared
    block by block; each block of a bucket goes to as many tasks as it has blocks."""
    ship(live.sparkSession)
    bucket = Window.partitionBy("sig")
    rows = live.select("sig", "node", "label", "place", "looks", "looks_near",
                       F.floor((F.row_number().over(bucket.orderBy("node", "place")) - 1) / BLOCK).alias("block"),
                       F.floor((F.count(F.lit(1)).over(bucket) - 1) / BLOCK).alias("last"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    rows = rows.join(nodes.select("node", "n", "bits"), "node").select(
        "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label",
        "n", "place", "looks", "looks_near", "bits")
    dealt = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    schema = dealt.schema.names

    def run(batches):
        kept = None  # the last group's rows, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            change = group_starts(t)
            kept = t.slice(change[-1])
            if change[-1]:
                yield from compared(t.slice(0, change[-1]), percent)
        if kept is not None:
            yield from compared(kept, percent)

    assert schema[:3] == ["sig", "i", "j"]
    return dealt.mapInArrow(run, "a long, b long").distinct()


def group_starts(t: pa.Table) -> np.ndarray:
    """Where the rows of the groups (sig, i, j) start."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("sig", "i", "j"):
        x = t[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def compared(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs within the groups of ``t``'s rows that pass."""
    t = t.combine_chunks()
    starts = group_starts(t)
    left = np.diff(np.append(starts, t.num_rows))
    left = np.repeat(starts + left, left) - np.arange(t.num_rows)  # rows of the group from each row on
    cols = {c: t[c].to_numpy() for c in ("i", "j", "block", "node", "label", "n", "place", "looks", "looks_near")}
    bits = t["bits"].chunk(0)
    flat, offsets = np.frombuffer(bits.buffers()[2], np.uint8), np.frombuffer(bits.buffers()[1], np.int32)
    offsets = offsets[bits.offset:bits.offset + len(bits) + 1].astype(np.int64)
    found = [np.empty((2, 0), np.int64)]
    for d in range(1, int(left.max())):
        x = np.flatnonzero(left > d)
        y = x + d
        x, y = (z[passes({c: (v[x], v[y]) for c, v in cols.items()}, percent)] for z in (x, y))
        total = cols["n"][x] + cols["n"][y]
        ok = (100 + percent) * hamming(flat, offsets, x, y) <= (100 - percent) * total
        a, b = cols["node"][x[ok]], cols["node"][y[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 100_000]), pa.array(b[at:at + 100_000])], names=["a", "b"])


def passes(c: dict[str, tuple[np.ndarray, np.ndarray]], percent: int) -> np.ndarray:
    """Pairs of rows with different labels, in different blocks unless it is a block
    with itself, not both the larger ones of the group, sizes near enough, and one
    side looking the other up."""
    (i, _), (j, _), (block, other), (n, m), (place, at) = (c[k] for k in ("i", "j", "block", "n", "place"))
    near, either = (place & 1) + (at & 1), c["looks"][0] | c["looks"][1]
    either_near = c["looks_near"][0] | c["looks_near"][1]
    return ((c["label"][0] != c["label"][1]) & ((i == j) | (block != other)) & ((place & at & 2) == 0)
            & (percent * np.maximum(n, m) <= 100 * np.minimum(n, m))
            & np.where(near == 0, either, (near == 1) & either_near))


def hamming(flat: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parities rows x and y differ; the longer one is folded first."""
    out = np.zeros(len(x), np.int64)
    sizes = np.diff(offsets)
    shapes = sizes[x] << 32 | sizes[y]
    for shape in np.unique(shapes):
        at = np.flatnonzero(shapes == shape)
        one, two = (flat[offsets[z[at]][:, None] + np.arange(size)] for z, size in (
            (x, int(shape) >> 32), (y, int(shape) & 0xFFFFFFFF)))
        width = min(one.shape[1], two.shape[1])
        differ = folded(one, width) ^ folded(two, width)
        out[at] = np.bitwise_count(np.ascontiguousarray(differ).view(np.uint64)).sum(axis=1)
    return out


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def hamming_of(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """``hamming`` of two columns of parities, row by row."""
    n, both = len(one), one + two
    flat = np.frombuffer(b"".join(both), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in both])
    return hamming(flat, offsets, np.arange(n), np.arange(n, 2 * n))
