"""Exact de-duplication by two-pass Bloom filtering, in DataFrame operations only.

One scan reduces each row to (id, row number, SHA-256 of its text), which is
stored.  Pass 1 hashes every digest to two slots of a bit table and counts the
rows of each slot; slots that two or more rows hit make the filter, kept as
32,768-bit blocks.  Pass 2 probes it: a row with a slot that nobody else hit is
the only one of its text and passes straight through.  Only the rows left, which
are the repeated texts and a few false positives, shuffle by digest and are
grouped exactly.

Bounds: the filter has 16 bits a row and 2^28 bits (32 MB) at most, which is
what is broadcast.  Beyond 2^24 rows it fills up, more rows count as possible
repeats and shuffle (40 bytes each); the result is the same.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import stored, text_of

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
BLOCK_BITS = 32768  # of one bitmap of bitmap_construct_agg


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal texts
    the row with the largest id stays (a null id is the smallest; of rows that
    also share the id, one stays).  Empty table: no rows.  Other columns of
    ``docs`` are not read.
    """
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("sha")))
    n = rows.count()
    bits = BLOCK_BITS
    while bits < bits_per_row * n and bits < max_filter_bits:
        bits *= 2
    slot = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(bits)) + 1 for k in (1, 2)]

    shared = (rows.select(F.explode(F.array(*slot)).alias("slot"))
              .groupBy("slot").count().where("count > 1"))
    blocks = (shared.groupBy(F.bitmap_bucket_number("slot").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")))

    probed = rows
    for k, s in enumerate(slot):
        side = F.broadcast(blocks.select(F.col("block").alias(f"block{k}"), F.col("bitmap").alias(f"bitmap{k}")))
        at = F.bitmap_bit_position(s)
        byte = F.expr(f"substring(bitmap{k}, int({_sql(bits, k + 1)} div 8) + 1, 1)")
        probed = (probed.join(side, F.bitmap_bucket_number(s) == F.col(f"block{k}"), "left")
                  .withColumn(f"hit{k}", F.coalesce(
                      F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(
                          F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False)))
                  .drop(f"block{k}", f"bitmap{k}"))
    probed = probed.select("id", "row", "sha", (F.col("hit0") & F.col("hit1")).alias("again"))

    again = probed.where("again")
    groups = stored(again.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("keep"),
                                             F.count(F.lit(1)).alias("group_size")), n)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    once = probed.where("not again").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha)
    more = again.join(groups, "sha").select(
        "id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), sha)
    return once.unionAll(more).withColumnRenamed("id", id_col)


def _sql(bits: int, seed: int) -> str:
    return f"bitmap_bit_position(pmod(xxhash64(sha, {seed}), {bits}L) + 1)"
