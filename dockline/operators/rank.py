"""A list's order as one whole number per row, found by many tasks.

A global ``row_number`` is a window without a partition: all rows in one task.
Here the rows are dealt into ranges of their order, so that each task sorts its own
range and numbers it; the sizes of the ranges, one number for each of them, then
give where each range starts.
"""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cut_lineage

#: ``monotonically_increasing_id`` holds the partition above these bits, the row in it below.
ROW_BITS = 33


def ranked(rows: DataFrame, order: str = "place", materialize: str = "auto") -> DataFrame:
    """``rows`` with ``rank``, 1 for the first in the order of column ``order``, which
    is dropped.  Equal places get different ranks, in any order.

    The sorted rows are stored once, so that counting and numbering see the same
    ranges.  The driver gets one count for each range."""
    at = F.col("_at")
    stored = cut_lineage(rows.repartitionByRange(order).sortWithinPartitions(order).drop(order)
                         .withColumn("_at", F.monotonically_increasing_id()), materialize)
    part = F.shiftright(at, ROW_BITS)
    sizes = sorted(tuple(r) for r in stored.groupBy(part.alias("_part")).count().collect())
    starts = zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0))
    before = rows.sparkSession.createDataFrame(list(starts), "_part long, _before long")
    return (stored.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn("rank", F.col("_before") + at.bitwiseAND((1 << ROW_BITS) - 1) + 1)
            .drop("_part", "_before", "_at"))
