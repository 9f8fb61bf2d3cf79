"""F1-F7, F9 from one aggregate: the dashboard's facet cube.

A dashboard asks for the same few numbers under many selections.  The cube holds them
once, by the six facets, the planned day and the issue type, as counts and exact
decimal sums that simply add up; a selection is a filter of its rows and each figure a
roll-up of them.  So the orders are read once, whatever is selected afterwards, and
cubes of different exports can be added too.  It has no more rows than there are orders
and as a rule very few; its grouping is reduced in every map task before its shuffle.

Its facet columns are called like those of the orders: ``facets.facet_filter`` and
``facets.filter_options`` take a cube as well.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AT_RISK, CRITICAL, ESCALATION_STATUSES
from ..functions.agg import MONEY, count_where
from .facets import FACETS

KEYS = [*FACETS.values(), "planned_day", "issue_type"]
COUNTS = ["orders", "not_started_orders", "overdue_not_started", "due_within_2_days"]
VALUES = ["value", "not_started_value"]


def facet_cube(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per facets, planned day and issue type (null is a value of its own), with
    counts and decimal sums; ``by``: further columns of the orders to keep apart, such
    as ``export_id``."""
    waiting = F.col("is_not_started")
    amount = F.col("sales_order_total").cast(MONEY)
    days = F.col("days_to_planned_delivery")
    none = F.lit(0).cast(MONEY)
    return (orders.withColumn("planned_day", F.to_date("planned_dlv_date")).groupBy(*by, *KEYS).agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum(amount), none).alias("value"),
        count_where(waiting).alias("not_started_orders"),
        F.coalesce(F.sum(F.when(waiting, amount)), none).alias("not_started_value"),
        count_where(waiting & (days < 0)).alias("overdue_not_started"),
        count_where(waiting & days.between(0, 2)).alias("due_within_2_days")))


def merged(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cubes that were put one below the other, as one."""
    sums = [F.sum(c).cast(cube.schema[c].dataType).alias(c) for c in COUNTS + VALUES]
    return cube.groupBy(*by, *KEYS).agg(*sums).select(*cube.columns)


def _count(name: str, cond: Column | None = None) -> Column:
    return F.coalesce(F.sum(name if cond is None else F.when(cond, F.col(name))), F.lit(0)).cast("long")


def _money(name: str, cond: Column | None = None) -> Column:
    total = F.sum(F.col(name) if cond is None else F.when(cond, F.col(name)))
    return F.coalesce(total.cast(MONEY), F.lit(0).cast(MONEY)).cast("double")


def _escalating(cube: DataFrame) -> DataFrame:
    return cube.where(F.col("risk_status").isin(*ESCALATION_STATUSES))


def exec_columns() -> list[Column]:
    """F3, as aggregates of a cube."""
    status = F.col("risk_status")
    escalating = status.isin(*ESCALATION_STATUSES)
    return [
        _count("orders", status == CRITICAL).alias("critical_issues"),
        _count("orders", status == AT_RISK).alias("at_risk_issues"),
        _count("orders", escalating).alias("orders_requiring_attention"),
        _count("not_started_orders").alias("not_started_orders"),
        _money("value", escalating).alias("price_at_risk"),
        _money("not_started_value").alias("price_not_started")]


def not_started_columns() -> list[Column]:
    """F9, as aggregates of a cube."""
    return [_count("not_started_orders").alias("not_started_orders"),
            _money("not_started_value").alias("price_not_started"),
            _count("overdue_not_started").alias("overdue_not_started"),
            _count("due_within_2_days").alias("due_within_2_days")]


def exec_kpis(cube: DataFrame) -> DataFrame:
    """F3."""
    return cube.agg(*exec_columns())


def risk_value_by_customer(cube: DataFrame) -> DataFrame:
    """F4, unordered."""
    return _escalating(cube).groupBy("customer_display").agg(_money("value").alias("price_at_risk"))


def not_started_by_customer(cube: DataFrame) -> DataFrame:
    """F5, unordered."""
    return (cube.where("not_started_orders > 0").groupBy("customer_display")
            .agg(_count("not_started_orders").alias("not_started_orders")))


def status_distribution(cube: DataFrame) -> DataFrame:
    """F6, unordered."""
    return _escalating(cube).groupBy(F.col("risk_status").alias("status")).agg(_count("orders").alias("orders"))


def risk_value_by_planned_day(cube: DataFrame) -> DataFrame:
    """F7, unordered."""
    return (_escalating(cube).where(F.col("planned_day").isNotNull()).groupBy("planned_day")
            .agg(_money("value").alias("price_at_risk")))


def not_started_kpis(cube: DataFrame) -> DataFrame:
    """F9."""
    return cube.agg(*not_started_columns())
