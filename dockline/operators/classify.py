"""Customer group, customer attributes, site label, DSD priority.

Up to ``MAX_CASE_PATTERNS`` ordered pattern rules make one ``CASE WHEN`` chain (first rule in
config order wins) over keys that are worked out once a row: no join, no shuffle,
no UDF.  Attribute lookups are literal ``CASE`` maps keyed on the group.
"""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import UNKNOWN_SITE, Rules
from ..functions.text import first_word, match_key, once
from .rule_table import group_table, grouped_by_table


#: Patterns that a CASE chain may have.
MAX_CASE_PATTERNS = 200


def lookup(key: Column, mapping: dict[str, Any], default: Any) -> Column:
    """Literal CASE lookup ``mapping[key]`` with a default."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v)))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def first_of(cases: list[tuple[Column, Any]], default: Column) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    out = default
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def customer_group(ship_key: Column, carrier_key: Column, rules: Rules) -> Column:
    """The group of the first pattern row that holds, else the fallback.  Rows
    of one group are one condition, so the chain has a branch per group."""
    def chain(pair: Column) -> Column:
        branches: dict[str, Column] = {}
        for p in sorted(rules.patterns):
            hit = getattr(pair[p.column], p.test)(p.text)
            branches[p.group] = branches[p.group] | hit if p.group in branches else hit
        return first_of([(hit, group) for group, hit in branches.items()], F.lit(rules.fallback))
    return once(F.struct(ship_key.alias("ship_to"), carrier_key.alias("carrier")), chain)


def site_label(ys: Column, rules: Rules) -> Column:
    """Configured label, 'Unknown' when missing, else the first word (case kept)."""
    label = once(match_key(ys), lambda key: first_of(
        [(key == "", UNKNOWN_SITE), *((key == name, label) for name, label in rules.site_labels.items())],
        F.lit(None).cast("string")))
    return F.coalesce(label, first_word(ys))


def dsd_priority(ship_key: Column, rules: Rules) -> Column:
    """First label (sorted) with a pattern contained in the ship-to key; else null."""
    return once(ship_key, lambda key: first_of(
        [(key.contains(text), label) for label, texts in rules.dsd.items() for text in texts], F.lit(None).cast("string")))


def by_table(rules: Rules) -> bool:
    """Whether there are too many patterns or groups for generated code."""
    return len(rules.patterns) > MAX_CASE_PATTERNS or len(rules.groups) > MAX_CASE_PATTERNS


def classify(orders: DataFrame, rules: Rules) -> DataFrame:
    """Add customer_group, customer_display/owner/priority/consequence,
    deadline_flag, customer_report and site.  The group comes from a CASE chain, or
    from a join with the table of patterns if they are many; both give the same."""
    ship = match_key(F.col("ship_to_name"))
    carrier = match_key(F.col("carrier_description"))
    if by_table(rules):
        grouped = grouped_by_table(orders, ship, carrier, rules)
        return grouped.join(group_table(orders.sparkSession, rules), "customer_group") \
            .withColumn("site", site_label(F.col("ys"), rules))
    grouped = orders.withColumn("customer_group", customer_group(ship, carrier, rules))

    def of_group(name: str) -> Column:
        values = rules.values(name)
        return lookup(F.col("customer_group"), values, values[rules.fallback])
    return grouped.withColumns({
        "customer_display": of_group("display"),
        "customer_owner": of_group("owner"),
        "customer_priority": of_group("priority"),
        "customer_consequence": of_group("consequence"),
        "deadline_flag": of_group("amazon_deadline"),
        "customer_report": lookup(F.col("customer_group"), rules.report_of_group(), ""),
        "site": site_label(F.col("ys"), rules),
    })


def site_rank(site: Column, rules: Rules) -> Column:
    """Section rank of a site label: configured order first (case-insensitive)."""
    return lookup(F.lower(site), rules.site_rank, len(rules.site_rank))


def ordered_sites(orders: DataFrame, rules: Rules) -> DataFrame:
    """Distinct non-blank sites with their section rank ``site_seq``
    (configured order first, case-insensitive, then alphabetical; two labels that
    differ only in letter case are ordered by their text).

    Sites are numbered in two steps, so that their number may grow with the
    data: within each first character, then by the characters before it."""
    sites = (orders.filter(F.trim(F.col("site")) != "").select("site").distinct()
             .withColumn("rank", site_rank(F.col("site"), rules)).withColumn("folded", F.lower(F.col("site")))
             .withColumn("lead", F.substring("folded", 1, 1)))
    within = Window.partitionBy("rank", "lead").orderBy("folded", "site")
    # one row per configured rank and first character
    leads = sites.groupBy("rank", "lead").agg(F.count(F.lit(1)).alias("n"))
    before = leads.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("rank", "lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (sites.withColumn("nth", F.row_number().over(within))
            .join(before.select("rank", "lead", "before"), ["rank", "lead"])
            .select("site", (F.col("before") + F.col("nth")).cast("long").alias("site_seq")))
