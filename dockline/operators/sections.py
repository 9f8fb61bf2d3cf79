"""The sections of all sites as ranges of one table.

A site's section is its tracker, its not-started list, its orders and its reports.  The
number of sites grows with the data, so there is no loop over them: the rows of all
sections are one long table, numbered in their order (site, part, then the part's own
order) and sorted by that number.  It is computed and written once; a section is then a
filter on ``site`` and ``part`` that reads the row groups that hold it.

Parts are numbered as in the report catalog.  A row has the columns of its part and is
null in the others'.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..plans.materialize import broadcast_if_small, cut_lineage
from ..sources.headers import COLUMNS
from .classify import ordered_sites
from .enrich import issue_type_rank
from .rank import ranked
from .reports import DSD_REPORT, FULL_EXPORT, LATE_LIST_COLUMNS, NOT_STARTED_COLUMNS, detail_reports_long
from .tracker import TRACKER_COLUMNS, issue_tracker

#: The parts that every site has; the reports follow, in workbook order.
TRACKER, NOT_STARTED, ORDERS = range(3)
PARTS = ["Issue Tracker", "Not Started", "Orders"]
#: Up to here the sites' numbers are broadcast; beyond it they are joined by site.
MAX_BROADCAST_SITES = 200_000

#: The keys that any part is sorted by, all of them in one struct; a part leaves out
#: (as null) those that it doesn't use.
ORDER_FIELDS = {"first": "int", "second": "int", "planned": "timestamp_ntz", "amount": "double", "less": "double",
                "name": "string", "kind": "string"}


def _order(ordinal: Column, **keys: Column) -> Column:
    unused = F.lit(None)
    return F.struct(*(keys.get(k, unused).cast(t).alias(k) for k, t in ORDER_FIELDS.items()), ordinal.alias("ordinal"))


def section_rows(orders: DataFrame, rules: Rules, as_of: dt.date, now: dt.datetime) -> DataFrame:
    """Rows of all sections: site, part, report, the columns of the part, and ``_order``
    within the part."""
    planned, value, ordinal = F.col("planned_dlv_date"), F.col("sales_order_total"), F.col("ordinal")
    no_ordinal = F.lit(None).cast(orders.schema["ordinal"].dataType)

    tracker = issue_tracker(orders, rules, now, ordered=False).withColumn("_order", _order(
        no_ordinal, first=(F.col("status") != "Critical").cast("int"), second=issue_type_rank(F.col("issue_type")),
        amount=-F.col("total_price"), name=F.col("customer"), kind=F.col("issue_type")))
    waiting = orders.where("is_not_started").select(
        *(F.col(src).alias(out) for out, src in NOT_STARTED_COLUMNS),
        _order(ordinal, first=F.col("priority_rank"), second=planned.isNull(), planned=planned, amount=-value).alias("_order"))

    late = F.col("report").isin(*(r.name for r in rules.reports if r.special))
    dsd = F.col("report") == DSD_REPORT
    order = (F.when(late, _order(ordinal, planned=planned, amount=F.col("picking_in_pct"), less=-value))
             .when(dsd, _order(ordinal, first=F.when(F.col("priority").contains("1"), 1).otherwise(2),
                               second=planned.isNull(), planned=planned))
             .otherwise(_order(ordinal)))
    whole = F.col("report") == FULL_EXPORT  # a site's orders
    reports = detail_reports_long(orders, rules, as_of).select(
        "site", F.when(whole, F.lit(ORDERS)).otherwise(F.col("report_seq") + len(PARTS)).alias("part"),
        F.when(whole, F.lit(PARTS[ORDERS])).otherwise(F.col("report")).alias("report"), "comments",
        F.when(dsd, F.col("priority")).alias("priority"),
        *(F.col(c) if c in LATE_LIST_COLUMNS else F.when(~late, F.col(c)).alias(c) for c in COLUMNS), order.alias("_order"))

    def part(df: DataFrame, k: int) -> DataFrame:
        return df.withColumns({"part": F.lit(k), "report": F.lit(PARTS[k])})

    return (part(tracker, TRACKER).unionByName(part(waiting, NOT_STARTED), allowMissingColumns=True)
            .unionByName(reports, allowMissingColumns=True))


def site_sections(orders: DataFrame, rules: Rules, as_of: dt.date, now: dt.datetime, materialize: str = "auto") -> DataFrame:
    """E21 as one table: the rows of ``section_rows`` with ``site_seq`` (section order)
    and ``rank``, their place in the whole table, by which it is sorted."""
    sites = cut_lineage(ordered_sites(orders, rules), materialize)
    rows = section_rows(orders, rules, as_of, now).join(broadcast_if_small(sites, MAX_BROADCAST_SITES), "site")
    placed = rows.withColumn("_order", F.struct("site_seq", "part", "_order"))
    return ranked(placed, "_order", materialize)


def part_columns(report: str, rules: Rules) -> list[str]:
    """The columns of a part of a section."""
    if report in PARTS:
        return [TRACKER_COLUMNS, [out for out, _ in NOT_STARTED_COLUMNS], COLUMNS][PARTS.index(report)]
    if report == DSD_REPORT:
        return ["priority", *COLUMNS]
    spec, = (r for r in rules.reports if r.name == report)
    if spec.special:
        return LATE_LIST_COLUMNS
    return (["comments"] if spec.comments else []) + COLUMNS


def section(table: DataFrame, site: str, report: str, rules: Rules) -> DataFrame:
    """One part of a site's section, in its order: a pruned slice of the table."""
    mine = table.where((F.col("site") == site) & (F.col("report") == report))
    return mine.orderBy("rank").select(*part_columns(report, rules))


class SiteSections(Mapping):
    """Sections by site, in section order; ``table`` holds them all.  Sites are read as
    they are asked for, never collected."""

    def __init__(self, table: DataFrame, sites: DataFrame):
        self.table, self.sites = table, sites

    def __iter__(self) -> Iterator[str]:
        return (r["site"] for r in self.sites.orderBy("site_seq").toLocalIterator())

    def __len__(self) -> int:
        return self.sites.count()

    def __getitem__(self, site: str) -> dict[str, DataFrame]:
        """The site's tracker, not-started list and orders, and its reports as one
        long table (lazy slices)."""
        mine = self.table.where(F.col("site") == site)
        in_order = {name: mine.where(F.col("part") == k).orderBy("rank") for k, name in enumerate(PARTS)}
        return {"issue_tracker": in_order[PARTS[TRACKER]].select(*TRACKER_COLUMNS),
                "not_started": in_order[PARTS[NOT_STARTED]].select(*(out for out, _ in NOT_STARTED_COLUMNS)),
                "orders": in_order[PARTS[ORDERS]].select(*COLUMNS),
                "reports": mine.where(F.col("part") >= len(PARTS)).orderBy("rank").select(
                    "report", "comments", "priority", "site", *COLUMNS)}
