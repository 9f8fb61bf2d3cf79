"""Ranked work lists and detail reports.

Every report is a filter + projection over the enriched orders (narrow, no
shuffle); sorting happens only at the output edge (``ordered=True``), with the
input ``ordinal`` as the last key so ties keep input order.  The long form
(``detail_reports_long``) tags each order with every report it belongs to via
``explode`` in ONE scan; site sections, report totals and the catalog are
aggregations over it, never one job per site or per report.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALL_PLANTS, Report, Rules
from ..functions.agg import count_where, money_sum
from ..functions.dates import as_of_midnight, fmt_mmdd
from ..functions.text import match_key
from ..sources.headers import COLUMNS
from .classify import dsd_priority

# Report names that are always present, and column lists.
FULL_EXPORT = "SAPUI5 Export"
DSD_REPORT = "DSD Priorities"
NOT_STARTED_COLUMNS = [
    ("priority", "priority"), ("site", "site"), ("customer_group", "customer_display"),
    ("facility_code", "facility_code"), ("warehouse_task_creat", "warehouse_task_creat"),
    ("route_depart_date", "route_depart_date"), ("planned_dlv_date", "planned_dlv_date"),
    ("le_delivery", "le_delivery"), ("cust_reference", "cust_reference"),
    ("carrier_description", "carrier_description"), ("ship_to_name", "ship_to_name"),
    ("ship_to_city", "ship_to_city"), ("ship_to_province", "ship_to_province"),
    ("cases", "cases"), ("line_items", "line_items"), ("picking_in_pct", "picking_in_pct"),
    ("picking_status", "picking"), ("goods_issue", "goods_issue"),
    ("sales_order", "sales_order"), ("sales_order_total", "sales_order_total"),
    ("days_to_route_departure", "days_to_route_departure"),
    ("days_to_planned_delivery", "days_to_planned_delivery"),
]
LATE_LIST_COLUMNS = ["picking_in_pct", "planned_dlv_date", "le_delivery", "ship_to_name",
                     "ship_to_city", "ship_to_province", "cases", "line_items",
                     "sales_order_total"]
DEADLINE_NOTE = "Cancellation deadline "
LATE_WAREHOUSE_FACILITY = "Warehouse"
DSD_FACILITIES = ("DSD", "INDEPENDENT", "INDEPENDANT")


def _sorted(df: DataFrame, ordered: bool, *keys: Column) -> DataFrame:
    return df.orderBy(*keys, F.col("ordinal")) if ordered else df


def not_started_keys() -> list[Column]:
    """E13 order: priority, planned delivery (none last), value from the highest, input order."""
    planned = F.col("planned_dlv_date")
    return [F.col("priority_rank"), planned.isNull(), planned, -F.col("sales_order_total"), F.col("ordinal")]


def late_list_keys() -> list[Column]:
    """E17/E18 order: planned delivery, picking, value from the highest, input order."""
    return [F.col("planned_dlv_date"), F.col("picking_in_pct"), -F.col("sales_order_total"), F.col("ordinal")]


def place(keys: list[Column]) -> Column:
    """Sort keys as one column, to be written with rows that are put in order by
    whoever reads them."""
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("place")


def not_started(orders: DataFrame, ordered: bool = True, placed: bool = False) -> DataFrame:
    """0% picked and not goods-issued, ranked by priority / planned / value;
    ``placed``: with the rank as a column instead of a sort."""
    ns = orders.filter(F.col("is_not_started"))
    ns = ns.orderBy(*not_started_keys()) if ordered and not placed else ns
    return ns.select(*[F.col(src).alias(out) for out, src in NOT_STARTED_COLUMNS],
                     *([place(not_started_keys())] if placed else []))


def late_lists(orders: DataFrame, rules: Rules, as_of: dt.date) -> DataFrame:
    """E17/E18 under their configured report names, by site: nine columns and place."""
    special = {"andrew_tab": late_warehouse_filter(as_of), "andrew_tab_2": late_dsd_filter(as_of)}
    names = F.array(*(F.when(special[r.special], F.lit(r.name)) for r in rules.reports if r.special in special))
    return orders.select(F.explode(names).alias("report"), "site", *LATE_LIST_COLUMNS, place(late_list_keys())) \
        .where(F.col("report").isNotNull())


def full_export(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """E14 over all orders: the 35 business columns in input order."""
    return _sorted(orders, ordered).select(*COLUMNS)


def customer_report_filter(spec: Report) -> Column:
    mine = F.col("customer_group").isin(*spec.groups)
    return mine & F.upper(F.col("facility_code")).isin(*spec.facilities) if spec.facilities else mine


def comments(spec: Report) -> Column:
    """Deadline note for deadline reports when the dock date is known."""
    dock = F.col("customer_dock_appointment_date")
    if spec.deadline:
        return F.when(dock.isNotNull(), F.concat(F.lit(DEADLINE_NOTE), fmt_mmdd(dock))) \
            .otherwise(F.lit(""))
    return F.lit("")


def customer_report(orders: DataFrame, spec: Report, ordered: bool = True) -> DataFrame:
    """The spec's customer groups (optionally facilities), input order."""
    sub = _sorted(orders.filter(customer_report_filter(spec)), ordered)
    lead = [comments(spec).alias("comments")] if spec.comments else []
    return sub.select(*lead, *COLUMNS)


def late_warehouse_filter(as_of: dt.date) -> Column:
    return ((F.col("facility_code") == LATE_WAREHOUSE_FACILITY)
            & F.coalesce(F.col("planned_dlv_date") < as_of_midnight(as_of), F.lit(False))
            & (F.col("picking_in_pct") < 100))


def late_dsd_filter(as_of: dt.date) -> Column:
    return (F.upper(F.col("facility_code")).isin(*DSD_FACILITIES)
            & F.coalesce(F.col("planned_dlv_date") < as_of_midnight(as_of), F.lit(False))
            & (F.upper(F.col("goods_issue")) != "COMPLETED"))


def _late_list(orders: DataFrame, cond: Column, ordered: bool) -> DataFrame:
    sub = orders.filter(cond)
    return (sub.orderBy(*late_list_keys()) if ordered else sub).select(*LATE_LIST_COLUMNS)


def late_warehouse(orders: DataFrame, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """Warehouse-facility orders past planned delivery and not fully picked."""
    return _late_list(orders, late_warehouse_filter(as_of), ordered)


def late_dsd_independent(orders: DataFrame, as_of: dt.date, ordered: bool = True) -> DataFrame:
    """DSD / independent orders past planned delivery with goods issue open."""
    return _late_list(orders, late_dsd_filter(as_of), ordered)


def with_dsd_priority(orders: DataFrame, rules: Rules) -> DataFrame:
    return orders.withColumn("dsd_priority", dsd_priority(match_key(F.col("ship_to_name")), rules))


def dsd_priorities(orders: DataFrame, rules: Rules, ordered: bool = True) -> DataFrame:
    """Orders whose ship-to matches a DSD priority pattern (completed included)."""
    sub = with_dsd_priority(orders, rules).filter(F.col("dsd_priority").isNotNull())
    rank = F.when(F.col("dsd_priority").contains("1"), 1).otherwise(2)
    sub = _sorted(sub, ordered, rank, F.col("planned_dlv_date").asc_nulls_last())
    return sub.select(F.col("dsd_priority").alias("priority"), *COLUMNS)


def report_membership(rules: Rules, as_of: dt.date,
                      dsd: Column | None = None) -> list[tuple[str, Column]]:
    """(report name, membership predicate) in workbook order; ``dsd`` may be an
    already computed DSD priority column."""
    if dsd is None:
        dsd = dsd_priority(match_key(F.col("ship_to_name")), rules)
    out: list[tuple[str, Column]] = [(FULL_EXPORT, F.lit(True)), (DSD_REPORT, dsd.isNotNull())]
    for spec in rules.reports:
        if spec.special == "andrew_tab":
            out.append((spec.name, late_warehouse_filter(as_of)))
        elif spec.special == "andrew_tab_2":
            out.append((spec.name, late_dsd_filter(as_of)))
        elif spec.groups:
            out.append((spec.name, customer_report_filter(spec)))
    return out


def detail_reports_long(orders: DataFrame, rules: Rules, as_of: dt.date) -> DataFrame:
    """E20 long form: one row per (order, report it belongs to), one scan.

    Columns: report, report_seq, comments, priority, site, ordinal + 35 business
    columns.  ``comments`` is the deadline note where the report has one."""
    members = report_membership(rules, as_of, dsd=F.col("priority"))
    spec_by_name = {s.name: s for s in rules.reports}
    dsd = dsd_priority(match_key(F.col("ship_to_name")), rules)
    tags = []
    for seq, (name, cond) in enumerate(members):
        spec = spec_by_name.get(name)
        note = comments(spec) if (spec and spec.comments) else F.lit(None).cast("string")
        tags.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(name).alias("report"), F.lit(seq).alias("report_seq"),
            note.alias("comments"))))
    # explode over a plain array (non-members are null) + a null filter keeps
    # the Generate inside whole-stage codegen; a lambda filter would not.
    tagged = (orders.withColumn("priority", dsd)
              .select(F.explode(F.array(*tags)).alias("t"), "priority", "site", "ordinal",
                      *COLUMNS)
              .filter(F.col("t").isNotNull()))
    return tagged.select("t.report", "t.report_seq", "t.comments", "priority", "site",
                         "ordinal", *COLUMNS)


def report_totals(orders: DataFrame, rules: Rules, as_of: dt.date) -> DataFrame:
    """rows and value per (scope, report), without the full export.

    ``All Plants`` has every report, those without rows too; a site has the
    reports with rows there.  One rollup over the orders holds a count and a sum
    for each report; its few rows are then turned into one row per report."""
    members = [(seq, name, F.coalesce(cond, F.lit(False)))
               for seq, (name, cond) in enumerate(report_membership(rules, as_of)) if name != FULL_EXPORT]
    # memberships are worked out once a row, below the rollup's doubling of rows
    flagged = orders.select("site", "sales_order_total", *(cond.alias(f"in{seq}") for seq, _, cond in members))
    sums = [x for seq, _, _ in members for x in (
        count_where(F.col(f"in{seq}")).alias(f"rows{seq}"),
        money_sum(F.col("sales_order_total"), F.col(f"in{seq}")).alias(f"total{seq}"))]
    rolled = flagged.rollup("site").agg(*sums, F.grouping("site").alias("all_plants"))
    cells = F.array(*(F.struct(F.lit(name).alias("report"), F.lit(seq).alias("report_seq"),
                               F.coalesce(F.col(f"rows{seq}"), F.lit(0)).alias("rows"),
                               F.coalesce(F.col(f"total{seq}"), F.lit(0.0)).alias("total"))
                      for seq, name, _ in members))
    return (rolled.select(F.when(F.col("all_plants") == 1, F.lit(ALL_PLANTS)).otherwise(F.col("site")).alias("scope"),
                          "all_plants", F.explode(cells).alias("cell"))
            .where((F.col("all_plants") == 1) | (F.col("cell.rows") > 0)).select("scope", "cell.*"))
