"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Every linked document starts in a shard
by hash; then, round by round, it moves to the shard where most of its group is,
as far as capacity quotas allow.  A group larger than a shard has as many target
shards as it fills; another one goes where most of it is of the shards with room
for the rest of it, or to one that has none of it.  Rounds go on until no group
improves (``ROUNDS`` at most).  A round is two Spark joins: the documents' labels are
counted by group and shard, each group's targets follow from the counts and the
room in each shard, and the documents are joined with their group's targets.
A shard takes at most what its capacity (an even share of all bytes) leaves
beside the linked documents it has; if more want in, groups are taken by hash.

Documents without a link cut no edge anywhere, so they level the shards: a hash
deals them out in proportion to the room that is left, a second pass moves the
measured surplus, and a bounded sample of ``SAMPLE`` documents is moved one by
one from the fullest to the emptiest shard.

The driver sees the load of each shard and that sample, never groups or
documents in bulk.
"""
from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.llm.common import stored, text_of

SHARDS = 24
ROUNDS = 16
SAMPLE = 5000
CHUNK = 2000  # rows that are numbered together
UNIT = 1 << 30


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes and 8), text_crc32, shard, slot
    (from 0 without gaps in each shard).

    Shards have nearly the same bytes.  A null text has size 8 and the checksum
    of the empty text, and is linked with empty ones; repeated rows are linked;
    an empty table gives no rows; other columns of ``docs`` are not read.
    """
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text_of(text_col)).cast("long") + 8).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text_col)).alias("group")))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    capacity = -(-(total or 0) // shards)
    groups = stored(rows.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes")), n)
    many = groups.where("members > 1").select("group", "bytes")
    linked = stored(rows.select("row", "size", "group").join(many, "group")
                    .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), n)
    loads = _loads(linked, shards)
    cut = None
    for k in range(rounds):
        moved = stored(_propagate(linked, loads, capacity, shards, k, n), n)
        now = _cut(moved)
        if cut is not None and now > cut:
            break
        same = now == cut
        linked, cut, loads = moved, now, _loads(moved, shards)
        if not cut or same:
            break
    single = rows.join(groups.where("members = 1").select("group"), "group", "left_semi").select("row", "size")
    labels = stored(_level(single, loads, capacity, shards).withColumn("single", F.lit(True))
                    .unionByName(linked.select("row", "size", "shard").withColumn("single", F.lit(False))), n)
    labels = _smooth(labels, n, shards)
    return _numbered(rows.join(labels.select("row", "shard"), "row"), n, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    return [found.get(s, 0) for s in range(shards)]


def _cut(linked: DataFrame) -> int:
    """How many linked documents aren't in their group's fullest shard."""
    parts = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(
        (F.sum("n") - F.max("n")).alias("out"))
    return parts.agg(F.sum("out")).first()[0] or 0


def _uniform(*cols):
    """A hash from 0 to UNIT."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT))


def _propagate(linked: DataFrame, loads: list[int], capacity: int, shards: int, k: int, n: int) -> DataFrame:
    """``linked`` after one round, with ``moved``."""
    open_ = [s for s in range(shards) if loads[s] < 0.98 * capacity]
    room = [max(0, capacity - x) if s in open_ else 0 for s, x in enumerate(loads)]
    counts = linked.groupBy("group", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.sum("size").alias("here"))
    # of a group that fits in a shard, those without room for the rest of it come last
    full = (F.col("bytes") <= capacity) & (
        F.col("bytes") - F.col("here") > F.element_at(F.array(*(F.lit(x) for x in room)), F.col("shard") + 1))
    ranked = counts.groupBy("group").agg(
        F.max("bytes").alias("bytes"),
        # then a group's fullest shards first, ties by a hash
        F.sort_array(F.collect_list(F.struct(
            full.alias("full"), (-F.col("n")).alias("order"), F.xxhash64("group", "shard").alias("tie"), "shard"))).alias("at"))
    if sum(room):  # if all of its shards are full, one that has none of it, by room
        ends, at = [], 0
        for x in room:
            at += x
            ends.append(at * UNIT // sum(room))
        ranked = ranked.withColumn("at", F.when(
            F.expr("at[0].full"), F.array(F.struct(
                F.lit(False).alias("full"), F.lit(0).cast("long").alias("order"), F.lit(0).cast("long").alias("tie"),
                _pick(_uniform("group", F.lit(100 + k)), ends).alias("shard")))).otherwise(F.col("at")))
    fits = F.greatest(F.lit(1), F.ceil(F.col("bytes") / max(1, capacity))).cast("int")
    targets = stored(ranked.select("group", F.slice(F.expr("transform(at, x -> x.shard)"), F.lit(1), fits).alias("to")), n)
    wants = linked.join(targets, "group").withColumn(
        "to", F.when(F.array_contains("to", F.col("shard")), F.col("shard")).otherwise(
            F.element_at("to", (F.pmod(F.xxhash64("row", F.lit(k)), F.size("to")) + 1).cast("int"))))
    if k:  # shards without room take nobody
        wants = wants.withColumn("to", F.when(F.col("to").isin(open_), F.col("to")).otherwise(F.col("shard")))
    wants = stored(wants, n)
    asked = dict(wants.where("to <> shard").groupBy("to").agg(F.sum("size")).collect())
    leaving = dict(wants.where("to <> shard").groupBy("shard").agg(F.sum("size")).collect())
    share = [min(1.0, max(0, capacity - loads[s] + leaving.get(s, 0) // 2) / asked[s]) if asked.get(s) else 0.0
             for s in range(shards)]
    quota = F.element_at(F.array(*(F.lit(int(x * UNIT)) for x in share)), F.col("to") + 1)
    # a group moves as one, or document by document if it's a good part of a shard
    draw = F.when(F.col("bytes") * 8 > capacity, _uniform("row", F.lit(k))).otherwise(_uniform("group", F.lit(k)))
    goes = (F.col("to") != F.col("shard")) & (draw < quota)
    return wants.select("group", "row", "size", "bytes", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"),
                        goes.alias("moved"))


def _level(single: DataFrame, loads: list[int], capacity: int, shards: int) -> DataFrame:
    """(row, size, shard): dealt out in proportion to the room beside ``loads``."""
    room = [max(0, capacity - x) for x in loads]
    total = sum(room) or 1
    ends, at = [], 0
    for x in room:
        at += x
        ends.append(at * UNIT // total)
    return single.withColumn("shard", _pick(_uniform("row", F.lit(-1)), ends))


def _pick(draw, ends: list[int]):
    """The first shard whose end is above the draw."""
    shard = F.lit(len(ends) - 1)
    for s in reversed(range(len(ends) - 1)):
        shard = F.when(draw < ends[s], s).otherwise(shard)
    return shard.cast("int")


def _smooth(labels: DataFrame, n: int, shards: int) -> DataFrame:
    """Evens out the shards: the surplus of fuller ones by hash, then a sample one by one."""
    for k in range(2):
        sums = {s: (a, b) for s, a, b in labels.groupBy("shard").agg(
            F.sum("size"), F.sum(F.when(F.col("single"), F.col("size")).otherwise(0))).collect()}
        loads = [sums.get(s, (0, 0))[0] for s in range(shards)]
        mean = sum(loads) / shards
        first, rest = [], []  # shares that leave, of single documents and of linked ones
        for s in range(shards):
            all_, alone = sums.get(s, (0, 0))
            over = max(0, all_ - mean)
            first.append(int(UNIT * min(1, over / alone)) if alone else 0)
            rest.append(int(UNIT * min(1, max(0, over - alone) / (all_ - alone))) if all_ > alone else 0)
        room = [max(0, mean - x) for x in loads]
        total, ends, at = sum(room) or 1, [], 0.0
        for x in room:
            at += x
            ends.append(int(at / total * UNIT))
        leaves = F.when(F.col("single"), F.element_at(F.array(*map(F.lit, first)), F.col("shard") + 1)).otherwise(
            F.element_at(F.array(*map(F.lit, rest)), F.col("shard") + 1))
        labels = stored(labels.withColumn("shard", F.when(
            _uniform("row", F.lit(-2 - 2 * k)) < leaves, _pick(_uniform("row", F.lit(-3 - 2 * k)), ends))
            .otherwise(F.col("shard"))))
    loads = _loads(labels, shards)
    drawn = labels.where(_uniform("row", F.lit(-9)) < int(UNIT * min(1, SAMPLE / max(1, n)))).limit(2 * SAMPLE)
    moves = even_out(loads, [tuple(r) for r in drawn.select("row", "size", "shard", "single").collect()])
    if not moves:
        return labels
    spark = labels.sparkSession
    to = F.broadcast(spark.createDataFrame(list(moves.items()), "row long, to int"))  # 2 * SAMPLE rows at most
    return labels.join(to, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def even_out(loads: list[int], sample: list[tuple]) -> dict[int, int]:
    """Moves {row: shard} of sampled (row, size, shard, single) from the fullest
    shards to the emptiest, single documents first."""
    loads = list(loads)
    by = defaultdict(list)
    for row, size, shard, single in sample:
        by[shard, single].append((size, row))
    for x in by.values():
        x.sort()
    moves: dict[int, int] = {}
    for _ in range(4 * len(sample)):
        high, low = max(range(len(loads)), key=loads.__getitem__), min(range(len(loads)), key=loads.__getitem__)
        half = (loads[high] - loads[low]) // 2
        for single in (True, False):
            docs = by[high, single]
            k = bisect_right(docs, (half, float("inf")))
            if k:
                size, row = docs.pop(k - 1)
                break
        else:
            break
        loads[high] -= size
        loads[low] += size
        moves[row] = low
        # a moved document may not move again: that keeps the search finite
    return moves


def _numbered(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``slot`` from 0 in each shard: chunks are numbered apart and put in line."""
    rows = stored(rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(max(1, -(-n // (shards * CHUNK)))))))
    line = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).select("shard", "chunk", "before"))
    place = Window.partitionBy("shard", "chunk").orderBy("row")
    return rows.withColumn("place", F.row_number().over(place)).join(before, ["shard", "chunk"]) \
        .withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long"))
