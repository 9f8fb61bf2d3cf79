"""Per-site summary plus the 'All Plants' roll-up in ONE aggregation.

GROUPING SETS ((site), ()): partial aggregation in every
map task, one small exchange on ``site``; the grand total comes out of the
same pass.  The three late buckets (complete / partial / not started)
partition the late orders because late implies open.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALL_PLANTS, Rules
from ..functions.agg import count_where, money_sum
from .classify import site_rank

SUMMARY_COLUMNS = ["site", "total_orders", "total_price", "late_orders", "late_value",
                   "completed", "completed_value", "partial", "partial_value",
                   "not_started", "not_started_value"]


def all_plants_summary(orders: DataFrame, rules: Rules, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """E22-E23; ``by``: a summary with its own roll-up for each value of these columns."""
    amt = F.col("sales_order_total")
    late = F.col("is_late")
    buckets = {"completed": F.col("is_picking_complete"),
               "partial": F.col("is_picking_in_progress"),
               "not_started": F.col("is_not_started")}
    aggs = [F.count(F.lit(1)).alias("total_orders"), money_sum(amt).alias("total_price"),
            count_where(late).alias("late_orders"), money_sum(amt, late).alias("late_value")]
    for name, cond in buckets.items():
        aggs += [count_where(late & cond).alias(name),
                 money_sum(amt, late & cond).alias(f"{name}_value")]
    rolled = (orders.groupingSets([[*by, "site"], [*by]], *by, "site")
              .agg(*aggs, F.grouping("site").alias("g")))
    out = rolled.select(
        *by,
        F.when(F.col("g") == 1, F.lit(ALL_PLANTS)).otherwise(F.col("site")).alias("site"),
        *SUMMARY_COLUMNS[1:], "g")
    if ordered:
        out = out.orderBy(*by, "g", site_rank(F.col("site"), rules), F.lower(F.col("site")),
                          F.col("site"))
    return out.select(*by, *SUMMARY_COLUMNS)
