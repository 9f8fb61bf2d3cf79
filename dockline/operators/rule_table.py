"""C3 for large rule tables: patterns as rows, joined through n-grams.

A CASE chain holds a few hundred patterns; a table of customers can have a great
many.  Here the patterns are a table and are joined with the distinct ship-to and
carrier keys only:

1. Every key is cut into n-grams (three characters, or fewer for patterns that are
   shorter), and the keys that hold each n-gram are counted.
2. A key can only contain a pattern if it holds every n-gram of it, so each pattern
   is filed under the n-gram that the fewest keys hold; a pattern with an n-gram that
   no key holds can't match and goes.
3. Keys and patterns meet on that n-gram, an equi-join, and the pattern is verified.
   The least rank of a key's patterns stays, first of each key, then of each pair.

Every join is by equality: work grows with the matches of the rarest n-grams, not
with patterns times keys.  Orders are joined back by their pair of keys, which is
broadcast if the pairs are few (checked); otherwise a pair with very many orders is a
skewed key of a sort-merge join, which AQE splits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules
from ..plans.materialize import broadcast_if, broadcast_if_small

GRAM = 3
MAX_BROADCAST_PAIRS = 500_000
MAX_BROADCAST_GROUPS = 100_000


def pattern_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rules' matching table; of equal patterns only the first."""
    rows = spark.createDataFrame([tuple(p) for p in rules.patterns],
                                 "rank int, group string, column string, test string, text string")
    first = F.min(F.struct("rank", "group")).alias("first")
    return rows.groupBy("column", "test", "text").agg(first).select("column", "test", "text", "first")


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text; none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.array_distinct(F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))),
                                       F.array().cast("array<string>")))


def matched_keys(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """(column, key, first): of the distinct (column, key) rows those that a pattern
    takes, with the rank and group of the first one."""
    size = F.least(F.length("text"), F.lit(GRAM))
    sizes = sorted(r[0] for r in patterns.select(size.alias("size")).distinct().collect())  # 1 to GRAM
    if not sizes:
        return keys.join(patterns.select("column", F.lit("").alias("key"), "first"), ["column", "key"])
    held = keys.select("column", "key", F.explode(F.concat(*(grams(F.col("key"), n) for n in sizes))).alias("gram"))
    often = held.groupBy("column", "gram").agg(F.count(F.lit(1)).alias("keys"))
    parts = patterns.select("*", F.explode(F.concat(*(
        F.when(size == n, grams(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in sizes))).alias("gram"))
    counted = parts.join(often, ["column", "gram"], "left").groupBy("column", "test", "text", "first").agg(
        F.min(F.struct(F.coalesce("keys", F.lit(0)).alias("keys"), "gram")).alias("rarest"))
    filed = counted.where("rarest.keys > 0").withColumn("gram", F.col("rarest.gram"))
    holds = F.when(F.col("test") == "startswith", F.startswith("key", "text")).otherwise(F.contains("key", "text"))
    return held.join(filed, ["column", "gram"]).where(holds).groupBy("column", "key").agg(F.min("first").alias("first"))


def grouped_by_table(orders: DataFrame, ship_key: Column, carrier_key: Column, rules: Rules) -> DataFrame:
    """``orders`` with ``customer_group``, as the CASE form gives it.  They are read
    twice (keys, then rows), so orders that are costly to work out should be stored."""
    keyed = orders.withColumns({"_ship": ship_key, "_carrier": carrier_key})
    pairs = keyed.select("_ship", "_carrier").distinct()
    sides = pairs.select(F.explode(F.array(
        F.struct(F.lit("ship_to").alias("column"), F.col("_ship").alias("key")),
        F.struct(F.lit("carrier").alias("column"), F.col("_carrier").alias("key")))).alias("side"))
    best = matched_keys(sides.select("side.column", "side.key").where("key <> ''").distinct(),
                        pattern_table(orders.sparkSession, rules))
    ship, carrier = (best.where(F.col("column") == c).select(F.col("key").alias(k), F.col("first").alias(f"{k}_first"))
                     for c, k in (("ship_to", "_ship"), ("carrier", "_carrier")))
    first = F.least("_ship_first", "_carrier_first")  # skips nulls
    taken = pairs.join(ship, "_ship", "left").join(carrier, "_carrier", "left").where(first.isNotNull()).select(
        "_ship", "_carrier", first["group"].alias("customer_group"))
    out = keyed.join(broadcast_if_small(taken, MAX_BROADCAST_PAIRS), ["_ship", "_carrier"], "left")
    return out.drop("_ship", "_carrier").withColumn("customer_group", F.coalesce("customer_group", F.lit(rules.fallback)))


def group_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """One row of attributes per group, to be joined on ``customer_group``."""
    reports = rules.report_of_group()
    rows = [(g, v["display"], v["owner"], v["priority"], v["consequence"], v["amazon_deadline"], reports.get(g, ""))
            for g, v in rules.groups.items()]
    table = spark.createDataFrame(rows, "customer_group string, customer_display string, customer_owner string, "
                                        "customer_priority int, customer_consequence string, deadline_flag boolean, "
                                        "customer_report string")
    return broadcast_if(table, len(rows) <= MAX_BROADCAST_GROUPS)
