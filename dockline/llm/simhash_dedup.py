"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: bit b of 64 is set if it is set in over half of the XXH64 hashes
(seed 42) of the text's word shingles, repeats included.

Candidates: every bit gets a random non-zero label of r + 1 bits (r: the
radius), and each non-zero v of r + 1 bits makes a mask of the bits whose label
has an odd product with v.  For any r bits some v is orthogonal to all their
labels, so two fingerprints that differ in r bits or fewer agree on one of the
2^(r+1) - 1 masks: no pair within the radius is lost.

Links: inside a bucket of one mask fingerprints differ only in the bits outside
it.  Two of them are within two bits exactly if some point is within one bit of
both, so each fingerprint of a bucket of two or more sends itself to its points
(itself and one for each flipped bit outside the mask), and the at most 65
fingerprints at a point are linked to the least of them.  That is linear in the
fingerprints, however large a bucket is; no pairs of a bucket are listed.

Components: least labels along the links, with pointer jumping; each round is
stored.  Fingerprints, not documents, are the nodes, so exact copies cost
nothing.
"""
from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dockline.llm.common import free_name, over_batches, stored, text_of

SHINGLE = 3
RADIUS = 2
BITS = 64


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints that differ in
    ``radius`` (0, 1 or 2) bits or fewer, its own included; nulls are not
    smallest unless all ids there are null.  A null or empty text has
    fingerprint zero and is linked like any other; repeated rows share a
    component.  Other columns of ``docs`` are not read.
    """
    return labelled(docs, id_col, text_col, shingle, radius).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs``, with all its columns, without all but one row of each component:
    a row with the component's id stays.  Of several such rows the one with the
    least text hash stays; of rows equal in id and text, any one."""
    rows = labelled(docs, id_col, text_col, shingle, radius)
    stay = stored(rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("label")
                  .agg(F.min(F.struct("id", "hash")).alias("row"), F.count(F.lit(1)).alias("n")))
    key, mark = free_name(docs, "hash"), free_name(docs, "nth")
    keyed = docs.withColumn(key, F.xxhash64(text_of(text_col)))
    right = stay.select(F.col("row.id").alias("stay_id"), F.col("row.hash").alias("stay_hash"))
    kept = keyed.join(right, keyed[id_col].eqNullSafe(right["stay_id"])
                      & (keyed[key] == right["stay_hash"]), "left_semi")
    if stay.where("n > 1").limit(1).count():  # repeated rows
        w = Window.partitionBy(id_col, key).orderBy(F.lit(1))
        kept = kept.withColumn(mark, F.row_number().over(w)).where(F.col(mark) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(id, hash, fp, label, component_id) of each row."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    n = prints.count()
    comps = stored(components(prints.groupBy("fp").agg(F.min("id").alias("least")), radius, n), n)
    return prints.join(comps, "fp")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hash, fp): the text's hash; the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"),
                       F.xxhash64(text_of(text_col)).alias("hash"))
    return over_batches(rows, lambda: lambda texts: [[simhash(t, shingle) for t in texts]], "fp long", 1)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    # bytes.lower() and bytes.split() know A-Z and \x20 \x09-\x0D only, as asked
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(w) - shingle + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 16384):
        part = np.array(hashes[k:k + 16384], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def covering_masks(radius: int, bits: int = BITS, seed: int = 1) -> list[int]:
    """The 2^(radius+1) - 1 masks, as unsigned numbers."""
    rng = random.Random(seed)
    labels = [rng.randrange(1, 2 ** (radius + 1)) for _ in range(bits)]
    return [sum(1 << b for b, x in enumerate(labels) if (x & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int, n: int | None = None) -> DataFrame:
    """(a, b), a < b: links whose components are those of all pairs of distinct
    ``fp`` within ``radius`` bits."""
    tables = [(k, signed(m), [signed(1 << b) for b in range(BITS) if not m >> b & 1])
              for k, m in enumerate(covering_masks(radius))]
    keyed = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m, _ in tables))).alias("t")
    ).select("fp", "t.mask", "t.key")
    shared = stored(keyed.groupBy("mask", "key").count().where("count > 1").select("mask", "key"), n)
    near = keyed.join(shared, ["mask", "key"], "left_semi")
    if radius == 0:
        return near.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    flips = F.element_at(F.create_map(*(x for k, _, free in tables for x in (
        F.lit(k), F.array(*map(F.lit, [0, *free]))))), F.col("mask"))
    points = near.select("fp", "mask", F.explode(flips).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    at = points.groupBy("point").agg(F.collect_list("fp").alias("at")).where(F.size("at") > 1)
    if radius == 1:  # neighbours of a point are linked through its own fingerprint alone
        hub = at.where(F.array_contains("at", F.col("point"))).select("point", F.explode("at").alias("fp"))
        return hub.where("fp <> point").select(F.least("fp", "point").alias("a"),
                                               F.greatest("fp", "point").alias("b")).distinct()
    # radius 2: any two fingerprints within one bit of a point are within two bits
    return at.select(F.array_min("at").alias("a"), F.explode("at").alias("b")).where("a < b").distinct()


def components(fps: DataFrame, radius: int, n: int | None = None) -> DataFrame:
    """(fp, label, component_id) for (fp, least) rows, one of each fp.  ``n``: a
    bound on their number."""
    fps = stored(fps, n)
    n = fps.count()
    pairs = stored(links(fps.select("fp"), radius, n), n)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n)
    while True:
        # least label among a node and its neighbours, then that label's label
        seen = both.join(label.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("n"))
        near = stored(label.join(seen, "a").select("a", F.col("m").alias("was"), F.least("m", "n").alias("m")), n)
        jump = near.join(near.select(F.col("a").alias("m"), F.col("m").alias("next")), "m", "left")
        label = stored(jump.select("a", "was", F.least("m", "next").alias("m")), n)
        if not label.where("was <> m").limit(1).count():
            break
    linked = fps.join(label.select(F.col("a").alias("fp"), "m"), "fp", "left") \
        .select("fp", "least", F.coalesce("m", "fp").alias("m"))
    roots = stored(linked, n)
    return roots.join(stored(roots.groupBy("m").agg(F.min("least").alias("component_id")), n), "m") \
        .select("fp", F.col("m").alias("label"), "component_id")
