"""Aggregate-expression helpers shared by the reports."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,4)"


def money_sum(amount: Column, cond: Column | None = None) -> Column:
    """Exact money total: summed as decimal (order-independent), returned as
    double; an empty selection sums to 0, never null."""
    v = amount.cast(MONEY) if cond is None else F.when(cond, amount.cast(MONEY))
    return F.coalesce(F.sum(v), F.lit(0).cast(MONEY)).cast("double")


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("long")
