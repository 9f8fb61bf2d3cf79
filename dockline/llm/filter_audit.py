"""Filter interaction audit: what each of several filters removes, in every order.

1. Every document becomes a mask, the set of filters that it fails.  Those on
   its own text are column expressions; whether a smaller id has the same text
   comes from one aggregation by the text's digest.  Rows are counted by their
   texts before they meet, so a text with a third of all rows is a few rows.
2. Documents are counted into cells (part, mask, good, toxic): at most 128 for
   each part, whatever the number of documents.
3. Each cell folds across the constant array of all orders, which goes to the
   tasks with the plan: ``transform`` over the orders, ``aggregate`` over an
   order's letters, with the letters seen so far as the state.  That makes 600
   structs for each cell, weighted by its count.
4. The arrays of a part's cells are summed place by place.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockline.llm.common import free_name, text_of

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, filter order and step, with the counts of the part.

    Filters (a document fails): A under 200 words, B under half of its words
    distinct, C over 3 % of its characters ``A-Z``, D any of ``#$%&*|``, E the
    same text has a smaller id anywhere in the table.  A null text is the empty
    text (it fails A, and E like any other); a null part is the empty string.  A
    row without an id neither fails E nor makes others fail it; repeated rows
    count each, and don't fail E by themselves.  Of several label rows of a
    document any one with the label counts; a document without labels is neither
    good nor toxic.  An empty table gives no rows.  Other columns are not read.
    """
    return audit(cells(docs, labels, id_col, text_col, part_col, quality_col, toxic_col))


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return (F.when(n < MIN_WORDS, BIT["A"]).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, BIT["B"]).otherwise(0)
            + F.when(100 * upper > UPPER_PERCENT * F.length(text), BIT["C"]).otherwise(0)
            + F.when(text.rlike(r"[#$%&*|]"), BIT["D"]).otherwise(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, quality_col: str,
          toxic_col: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters failed."""
    text = free_name(docs, "text_")
    rows = docs.withColumn(text, text_of(text_col)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text_mask(F.col(text)).alias("own"), F.sha2(text, 256).alias("digest"))
    rows = rows.groupBy("id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("rows"))
    flags = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.coalesce(F.col(f"`{quality_col}`") == 1, F.lit(False)).cast("int").alias("good"),
                          F.coalesce(F.col(f"`{toxic_col}`") == 1, F.lit(False)).cast("int").alias("toxic"))
    flags = flags.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(flags, "id", "left").fillna(0, ["good", "toxic"])
    # documents of one text, part and labels; those that occur equally often are one group, so that
    # the rows of the least id of a group are `rows`, and a long is all that is kept of the ids
    alike = rows.groupBy("digest", "part", "own", "good", "toxic", "rows").agg(
        (F.count(F.lit(1)) * F.col("rows")).alias("n"), F.min("id").alias("first"),
        (F.sum(F.col("id").isNull().cast("int")) * F.col("rows")).alias("no_id"))
    # a text has as many groups as parts and labels, not as documents
    least = F.min("first").over(Window.partitionBy("digest"))
    spared = F.col("no_id") + F.when(F.col("first") == least, F.col("rows")).otherwise(0)
    halves = alike.withColumn("spared", spared).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("own").alias("mask"), F.col("spared").alias("n")),
            F.struct((F.col("own") + BIT["E"]).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))).alias("half"))
    return halves.groupBy("part", F.col("half.mask").alias("mask"), "good", "toxic").agg(
        F.sum("half.n").alias("n")).where("n > 0")


def audit(cells: DataFrame) -> DataFrame:
    """The rows of all orders and steps from (part, mask, good, toxic, n) cells."""
    places = cells.select("part", F.posexplode(weighted(F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"))))
    sums = places.groupBy("part", "pos").agg(*(F.sum(f"col.{c}").alias(c) for c in COUNTS))
    step = F.pmod(F.col("pos"), F.lit(len(FILTERS))) + 1
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(F.col("pos") / len(FILTERS)).cast("int") + 1)
    rows = sums.select("part", order.alias("filter_order"), step.cast("int").alias("step"), *COUNTS)
    # 120 rows for each part and filter
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.withColumn("shapley", F.sum("removed").over(same))


def weighted(mask: Column, good: Column, toxic: Column, n: Column) -> Column:
    """600 structs of COUNTS, five for each order, of ``n`` documents that fail ``mask``."""
    orders = F.array(*(F.array(*(F.lit(BIT[f]) for f in order)) for order in ORDERS))

    def fold(order: Column) -> Column:
        """The order's five structs: ``seen`` has the bits of the filters before."""
        start = F.struct(F.lit(0).alias("seen"), F.lit([]).cast(f"array<{STEP}>").alias("steps"))
        return F.aggregate(order, start, lambda s, bit: F.struct(
            s["seen"].bitwiseOR(bit).alias("seen"), F.concat(s["steps"], F.array(at(s["seen"], bit))).alias("steps")),
            lambda s: s["steps"])

    def at(seen: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        gone = mask.bitwiseAND(seen) != 0
        removed = fails & ~gone

        def count(condition: Column) -> Column:
            return F.when(condition, n).otherwise(F.lit(0)).cast("long")
        return F.struct(
            count(~fails & ~gone).alias("kept"), count(removed).alias("removed"), count(fails & gone).alias("redundant"),
            count(mask == bit).alias("unique_fails"), count(removed & (good == 1)).alias("good_lost"),
            count(removed & (toxic == 1)).alias("toxic_lost"))

    return F.flatten(F.transform(orders, fold))


STEP = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"
