"""The issue tracker, one row per site x customer group x issue type.

Plan: filter -> ONE hash aggregation (partial in every map task, exchange on
the three keys) over one scan of the orders.  Attributes that depend on the
customer group are grouping keys, not string aggregates.  Affected delivery ids
come from the same aggregation: a counter of distinct ids with a fixed number of
places (``approx_top_k``), which is exact for the groups that list their ids, of
at most five orders, and holds no more ids of a larger group.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AT_RISK, CRITICAL, ESCALATION_STATUSES, Rules
from .reports import place
from ..functions.agg import count_where, money_sum
from ..functions.dates import fmt_long, stamp
from ..functions.templates import (AFFECTED_LIMIT, AFFECTED_TEMPLATE, GENERAL_TEMPLATE,
                                   ISSUE_TEMPLATES, LATEST_UPDATE_TEMPLATE, render)
from .enrich import issue_type_rank

KEYS = ["site", "customer_group", "issue_type"]
# Columns that are functions of customer_group: grouped on, not aggregated.
GROUP_ATTRS = ["customer_display", "customer_owner", "customer_consequence", "customer_report"]
TRACKER_COLUMNS = ["site", "customer", "issue_type", "issue", "consequence", "owner", "due_date",
                   "status", "total_price", "order_count", "latest_update", "detail_report"]
# Status codes used while aggregating (lowest wins).
_STATUS_CODES = ["Critical", "At Risk", "Ready / Awaiting GI", "In Progress", "Not Started",
                 "Resolved"]


def escalating(orders: DataFrame, include_non_escalated: bool = False) -> DataFrame:
    if include_non_escalated:
        return orders.filter(F.col("is_open"))
    return orders.filter(F.col("risk_status").isin(*ESCALATION_STATUSES))


def _status_code(c):
    expr = None
    for i, s in enumerate(_STATUS_CODES):
        expr = F.when(c == s, i) if expr is None else expr.when(c == s, i)
    return expr.otherwise(len(_STATUS_CODES))


#: Places of the id counter.  It is exact for three quarters as many ids, and holds no
#: more of them in a group of any size.
ID_PLACES = 16


def tracker_groups(wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E3-E7 + E10 aggregates per group: numbers, dates, and the sorted ids of a group
    with at most five orders as one text (null for a larger one)."""
    ids = F.array_sort(F.transform("some_ids", lambda x: x["item"]))
    listed = F.when(F.col("order_count") <= AFFECTED_LIMIT, F.array_join(ids, ", "))
    return (wanted.groupBy(*by, *KEYS, *GROUP_ATTRS).agg(
        F.count(F.lit(1)).alias("order_count"),
        count_where(F.col("is_not_started")).alias("n_not_started"),
        count_where(F.col("is_late")).alias("n_late"),
        count_where(F.col("is_picking_in_progress")).alias("n_in_progress"),
        count_where(F.col("is_route_departure_missed")).alias("n_missed_route"),
        count_where(F.col("picking_pct") < 100).alias("n_unpicked"),
        F.min("planned_dlv_date").alias("earliest_planned"),
        F.min("customer_dock_appointment_date").alias("nearest_deadline"),
        F.coalesce(F.min("picking_pct"), F.lit(0.0)).alias("lowest_picked"),
        F.min("due_date").alias("due_date"),
        F.min(_status_code(F.col("risk_status"))).alias("status_code"),
        money_sum(F.col("sales_order_total")).alias("total_price"),
        F.expr(f"approx_top_k(le_delivery, {AFFECTED_LIMIT}, {ID_PLACES})").alias("some_ids"),
    ).withColumn("ids", listed).drop("some_ids"))


_SLOT_NAMES = ["count", "customer", "nearest_deadline", "earliest_planned", "lowest_picked",
               "unpicked", "not_started", "late", "in_progress", "value", "nearest_due"]


def with_text_slots(g: DataFrame) -> DataFrame:
    """Every sentence slot as its own text column (computed once per group), so
    the template CASE below only concatenates column references; this keeps the
    generated code small."""
    return g.withColumns({
        "_s_count": F.col("order_count").cast("string"),
        "_s_customer": F.col("customer_display"),
        "_s_nearest_deadline": fmt_long(F.col("nearest_deadline")),
        "_s_earliest_planned": fmt_long(F.col("earliest_planned")),
        "_s_lowest_picked": F.format_number(F.col("lowest_picked"), 0),
        "_s_unpicked": F.col("n_unpicked").cast("string"),
        "_s_not_started": F.col("n_not_started").cast("string"),
        "_s_late": F.col("n_late").cast("string"),
        "_s_in_progress": F.col("n_in_progress").cast("string"),
        "_s_value": F.format_number(F.col("total_price"), 0),
        "_s_nearest_due": fmt_long(F.col("due_date")),
    })


def _slots() -> dict:
    return {n: F.col(f"_s_{n}") for n in _SLOT_NAMES}


def issue_text(rules: Rules):
    slots = _slots()
    it = F.col("issue_type")
    expr = None
    for name, tpl in ISSUE_TEMPLATES.items():
        expr = (F.when(it == name, render(tpl, slots)) if expr is None
                else expr.when(it == name, render(tpl, slots)))
    body = expr.otherwise(render(GENERAL_TEMPLATE, slots))
    suffix = F.when(F.col("ids").isNotNull(),
                    render(AFFECTED_TEMPLATE, {"ids": F.col("ids")})).otherwise(F.lit(""))
    return F.concat(body, suffix)


def latest_update(now: dt.datetime):
    slots = _slots()
    slots["stamp"] = F.lit(stamp(now))
    return render(LATEST_UPDATE_TEMPLATE, slots)


def issue_tracker(orders: DataFrame, rules: Rules, now: dt.datetime,
                  include_non_escalated: bool = False, ordered: bool = True, placed: bool = False,
                  by: Sequence[str] = ()) -> DataFrame:
    """E10 (escalation-only) / E11 (all open orders) with E8/E9 text and E12 order;
    ``placed``: with the order as a column instead of a sort; ``by``: a tracker for
    each value of these columns."""
    wanted = escalating(orders, include_non_escalated)
    g = with_text_slots(tracker_groups(wanted, by))
    status = (F.when(F.col("status_code") == 0, F.lit(CRITICAL))
              .when(F.col("status_code") == 1, F.lit(AT_RISK)))
    for i, s in enumerate(_STATUS_CODES[2:], start=2):
        status = status.when(F.col("status_code") == i, F.lit(s))
    consequence = F.when(F.col("customer_consequence") != "", F.col("customer_consequence")) \
        .otherwise(F.lit(rules.default_consequence))
    out = g.select(
        *by,
        "site",
        F.col("customer_display").alias("customer"),
        "issue_type",
        issue_text(rules).alias("issue"),
        consequence.alias("consequence"),
        F.col("customer_owner").alias("owner"),
        "due_date",
        status.alias("status"),
        "total_price",
        "order_count",
        latest_update(now).alias("latest_update"),
        F.col("customer_report").alias("detail_report"),
        (F.col("status_code") != 0).cast("int").alias("_status_rank"),
    )
    keys = [F.col("_status_rank"), issue_type_rank(F.col("issue_type")), -F.col("total_price"),
            F.col("site"), F.col("customer"), F.col("issue_type")]
    if placed:
        return out.select(*by, *TRACKER_COLUMNS, place(keys))
    return (out.orderBy(*by, *keys) if ordered else out).select(*by, *TRACKER_COLUMNS)


# The columns of a drill-down.
DRILLDOWN_COLUMNS = ["site", "le_delivery", "ship_to_name", "facility_code", "picking_in_pct", "risk_status",
                     "issue_type", "priority", "planned_dlv_date", "route_depart_date", "sales_order_total"]


def tracker_drilldown(orders: DataFrame, site: str, customer: str, issue_type: str) -> DataFrame:
    """F8: escalating orders behind one tracker row (11 columns)."""
    sel = escalating(orders).filter((F.col("site") == site)
                                    & (F.col("customer_display") == customer)
                                    & (F.col("issue_type") == issue_type))
    return sel.select(*DRILLDOWN_COLUMNS)


def behind(orders: DataFrame, rows: DataFrame) -> DataFrame:
    """F8: escalating orders behind some rows of the tracker, whichever they are: a
    left-semi join on the tracker's keys (a large group of orders stays where it is if
    the rows are few, as AQE then broadcasts them)."""
    keys = rows.select("site", F.col("customer").alias("customer_display"), "issue_type")
    return escalating(orders).join(keys, ["site", "customer_display", "issue_type"], "left_semi").select(*DRILLDOWN_COLUMNS)


def tracker_drilldown_all(orders: DataFrame) -> DataFrame:
    """F8, set-based: every escalating order tagged with its tracker row keys."""
    return escalating(orders).select(
        "site", F.col("customer_display").alias("customer"), "issue_type", "le_delivery",
        "ship_to_name", "facility_code", "picking_in_pct", "risk_status", "priority",
        "planned_dlv_date", "route_depart_date", "sales_order_total")

