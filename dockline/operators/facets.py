"""Interactive dashboard queries over the enriched orders.

Facet filters are plain ``isin`` conjunctions (pushed into the Parquet scan
when the orders are read back from a written table); KPIs are single
aggregations of conditional counts / sums; distributions are one hash
aggregation each.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AT_RISK, CRITICAL
from ..functions.agg import count_where, money_sum
from ..functions.text import ustrip
from .tracker import escalating

# The six facets and the order columns they filter.
FACETS = {
    "site": "site",
    "customer": "customer_display",
    "status": "risk_status",
    "priority": "priority",
    "facility": "facility_code",
    "province": "ship_to_province",
}
_TRIMMED_FACETS = ("site", "customer", "facility", "province")


def filter_options(orders: DataFrame) -> DataFrame:
    """(facet, value) for every distinct non-blank facet value, one pass."""
    pairs = [F.struct(F.lit(name).alias("facet"),
                      (ustrip(F.col(col)) if name in _TRIMMED_FACETS else F.col(col)).alias("value"))
             for name, col in FACETS.items()]
    return (orders.select(F.explode(F.array(*pairs)).alias("p"))
            .select("p.facet", "p.value")
            .filter(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct())


def facet_filter(orders: DataFrame, **selected) -> DataFrame:
    """AND of the non-empty IN-lists; an empty list means no filter."""
    out = orders
    for name, values in selected.items():
        if name not in FACETS:
            raise ValueError(f"unknown facet {name!r}; one of {sorted(FACETS)}")
        if values:
            out = out.filter(F.col(FACETS[name]).isin(*list(values)))
    return out


def exec_kpis(orders: DataFrame) -> DataFrame:
    """headline counts and values in one aggregation."""
    st = F.col("risk_status")
    esc = st.isin(CRITICAL, AT_RISK)
    ns = F.col("is_not_started")
    amt = F.col("sales_order_total")
    return orders.agg(
        count_where(st == CRITICAL).alias("critical_issues"),
        count_where(st == AT_RISK).alias("at_risk_issues"),
        count_where(esc).alias("orders_requiring_attention"),
        count_where(ns).alias("not_started_orders"),
        money_sum(amt, esc).alias("price_at_risk"),
        money_sum(amt, ns).alias("price_not_started"),
    )


def risk_value_by_customer(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """escalating value per customer, largest first."""
    out = (escalating(orders).groupBy("customer_display")
           .agg(money_sum(F.col("sales_order_total")).alias("price_at_risk")))
    return out.orderBy(F.col("price_at_risk").desc(), "customer_display") if ordered else out


def not_started_by_customer(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """not-started deliveries per customer (unique after de-dup), most first."""
    out = (orders.filter(F.col("is_not_started")).groupBy("customer_display")
           .agg(F.count(F.lit(1)).alias("not_started_orders")))
    return out.orderBy(F.col("not_started_orders").desc(), "customer_display") if ordered else out


def status_distribution(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """escalating orders per status."""
    out = (escalating(orders).groupBy(F.col("risk_status").alias("status"))
           .agg(F.count(F.lit(1)).alias("orders")))
    return out.orderBy(F.col("orders").desc(), "status") if ordered else out


def risk_value_by_planned_day(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """escalating value per planned delivery day (orders without a date dropped)."""
    out = (escalating(orders).filter(F.col("planned_dlv_date").isNotNull())
           .groupBy(F.to_date("planned_dlv_date").alias("planned_day"))
           .agg(money_sum(F.col("sales_order_total")).alias("price_at_risk")))
    return out.orderBy("planned_day") if ordered else out


def not_started_kpis(orders: DataFrame) -> DataFrame:
    """not-started count, value, overdue and due within two days (fixed 2)."""
    ns = orders.filter(F.col("is_not_started"))
    d = F.col("days_to_planned_delivery")
    return ns.agg(
        F.count(F.lit(1)).alias("not_started_orders"),
        money_sum(F.col("sales_order_total")).alias("price_not_started"),
        count_where(d < 0).alias("overdue_not_started"),
        count_where(d.between(0, 2)).alias("due_within_2_days"),
    )
