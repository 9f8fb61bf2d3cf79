"""Report catalog, output shaping, partitioned writes, run summary.

The catalog is computed from small grouped counts (reports x sites), never by
running one job per output.  Writes go through one partitioned write per
output kind; a new run of the same as-of date fully replaces the previous one
(the day's folder is overwritten as a whole).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALL_PLANTS, AT_RISK, CRITICAL, NOT_STARTED, READY, UNKNOWN_SITE, Rules
from ..functions.agg import money_sum
from ..functions.dates import as_of_midnight
from ..operators.classify import lookup, ordered_sites
from ..operators.reports import DSD_REPORT, FULL_EXPORT, report_totals

# Sheet names of the combined outputs, the validation sheet, and
# the note attached to deadline reports.
COMBINED = ["All Plants Summary", "All Plants Issue Tracker", "All Plants Not Started"]
VALIDATION_SHEET = "Validation Warnings"
DEADLINE_REPORT_NOTE = ("HIGHLIGHTED ORDERS ARE CURRENTLY LATE AND MAY BE SUBJECT TO THE "
                        "CONFIGURED ON-TIME DELIVERY CHARGEBACK")
# Run warnings.
UNKNOWN_SITE_WARNING = ("No warehouse column was recognized in this export, so every order is "
                        "grouped under a single Unknown warehouse. The site column should be "
                        "named ys, Site, Warehouse or Plant.")
UNPARSED_WARNING = ("{n} record(s) could not be fully parsed - see the Validation Warnings "
                    "output.")
# Numeric output columns whose blanks are written as 0.
NUMERIC_OUTPUT_COLUMNS = [
    "total_price", "sales_order_total", "late_value", "completed_value", "partial_value",
    "not_started_value", "picking_in_pct", "picking_pct", "cases", "line_items",
    "pallet_quantity", "num_lifts_pallets", "gross_weight", "order_count",
    "days_to_route_departure", "days_to_planned_delivery", "total_orders", "not_started",
    "late_orders", "completed", "partial"]


#: Places in the catalog: blocks, and parts within a site's block.
SITE_PARTS = ["Issue Tracker", "Not Started", "Orders"]
BLOCK, SITE = 10**15, 1000


def report_catalog(summary: DataFrame, tracker: DataFrame, not_started: DataFrame,
                   orders: DataFrame, errors: DataFrame, rules: Rules,
                   as_of: dt.date) -> DataFrame:
    """G1 (+G5): manifest (seq, sheet, site, report, rows, total, shading, note).

    Combined outputs; per site (configured order) its tracker, not-started list
    and orders, with 0 rows too, and every report with rows; the full export; the
    validation sheet if there are errors.  ``seq`` sorts it (block, site, part;
    it has gaps).  ``total`` is there for outputs that end in a total row: orders
    and customer reports.  ``shading`` says what rows are coloured by."""
    count = F.count(F.lit(1)).alias("rows")

    def whole(df: DataFrame, name: str, seq: int, shading: str | None) -> DataFrame:
        return df.agg(count).select(F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("sheet"),
                                    F.lit(None).cast("string").alias("site"), F.lit(name).alias("report"), "rows",
                                    F.lit(None).cast("double").alias("total"), F.lit(shading).cast("string").alias("shading"))

    sites = ordered_sites(orders, rules)
    reports = report_totals(orders, rules, as_of).where(F.col("scope") != ALL_PLANTS).select(
        F.col("scope").alias("site"), "report", (F.col("report_seq") + len(SITE_PARTS)).alias("part"), "rows", "total")
    sections = reports
    totals = [None, None, F.col("sales_order_total")]
    for part, (df, amount) in enumerate(zip((tracker, not_started, orders), totals)):
        # every site has the part, also when it is empty
        counts = df.groupBy("site").agg(count, (F.lit(None).cast("double") if amount is None else money_sum(amount))
                                        .alias("total"))
        sections = sections.unionByName(sites.select("site").join(counts, "site", "left").select(
            "site", F.lit(SITE_PARTS[part]).alias("report"), F.lit(part).alias("part"),
            F.coalesce("rows", F.lit(0)).alias("rows"), "total"))
    customer = [r.name for r in rules.reports if r.groups and not r.special]
    detail = F.col("report").isin(SITE_PARTS[2], *customer)
    per_site = sections.join(sites, "site").select(
        (BLOCK + F.col("site_seq") * SITE + F.col("part")).alias("seq"),
        F.concat("site", F.when(F.col("part") < len(SITE_PARTS), " ").otherwise(" - "), "report").alias("sheet"),
        "site", "report", "rows", F.when(detail, F.col("total")).alias("total"),
        F.when(F.col("part") == 0, "status").when(F.col("part") == 1, "priority").when(detail, "detail").alias("shading"))
    plan = (whole(summary, COMBINED[0], 0, None).unionByName(whole(tracker, COMBINED[1], 1, "status"))
            .unionByName(whole(not_started, COMBINED[2], 2, "priority")).unionByName(per_site)
            .unionByName(whole(orders, FULL_EXPORT, 2 * BLOCK, None))
            .unionByName(whole(errors, VALIDATION_SHEET, 3 * BLOCK, None).where("rows > 0")))
    notes = {r.name: DEADLINE_REPORT_NOTE for r in rules.reports if r.deadline}
    return plan.withColumn("note", lookup(F.col("report"), notes, None).cast("string")).orderBy("seq")


def null_as_zero(df: DataFrame) -> DataFrame:
    """Blanks in numeric output columns become 0; other nulls stay empty."""
    cols = [c for c in df.columns if c in NUMERIC_OUTPUT_COLUMNS]
    return df.na.fill(0, subset=cols) if cols else df


def tracker_severity(status: Column) -> Column:
    """G3 for tracker rows; other statuses have no colour."""
    return lookup(status, {CRITICAL: "red", AT_RISK: "orange", NOT_STARTED: "yellow", READY: "green"}, None)


def not_started_severity(priority: Column) -> Column:
    """G3 for not-started rows."""
    return (F.when(priority == "Critical", "red").when(priority == "High", "orange")
            .when(priority == "Medium", "yellow"))


def detail_severity(as_of: dt.date) -> Column:
    """G3 for detail rows, from the business columns only."""
    m = as_of_midnight(as_of)
    gi_open = F.upper(F.col("goods_issue")) != "COMPLETED"
    late = F.coalesce(F.col("planned_dlv_date") < m, F.lit(False)) & gi_open
    missed = F.coalesce(F.col("route_depart_date") < m, F.lit(False)) & (F.col("picking_in_pct") < 100)
    return (F.when(late | missed, "red")
            .when((F.col("picking_in_pct") == 0) & gi_open, "yellow"))


def with_total_row(df: DataFrame, label_col: str) -> DataFrame:
    """Append a TOTAL row carrying the sum of sales_order_total (one extra
    aggregation; the ``is_total`` flag sorts it last)."""
    total = df.agg(money_sum(F.col("sales_order_total")).alias("sales_order_total"))
    total = total.select(F.lit("TOTAL").alias(label_col), "sales_order_total",
                         F.lit(True).alias("is_total"))
    return df.withColumn("is_total", F.lit(False)).unionByName(total, allowMissingColumns=True)


def write_output(df: DataFrame, path: str, as_of: dt.date, partition_by=("site",),
                 fmt: str = "parquet") -> None:
    """Persist an output under ``path/as_of=<day>/site=...``.  The day's
    folder is overwritten as a whole, so a new upload for a day fully replaces
    the previous one (also sites that are gone) and other days are untouched.
    Readers see ``as_of`` and ``site`` as partition columns (pruned scans)."""
    df = null_as_zero(df)
    if fmt != "parquet":  # text files have no struct cells
        df = df.drop("place", "ordinal")
    parts = [p for p in partition_by if p in df.columns]
    if parts:  # files of a useful size for each folder; a large site is split
        df = df.hint("rebalance", *parts)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(f"{path.rstrip('/')}/as_of={as_of.isoformat()}")


def run_summary(typed: DataFrame | None, orders: DataFrame, errors: DataFrame) -> DataFrame:
    """Run metadata as (metric, value) rows: row_count, duplicates_removed,
    sites, validation_records, only_unknown_site (0/1).  Three one-row
    aggregations stacked with ``unionByName`` (no join)."""
    from ..operators.clean import duplicates_removed
    t = orders.agg(duplicates_removed())
    o = orders.agg(F.count(F.lit(1)).alias("row_count"),
                   F.count_distinct("site").alias("sites"),
                   ((F.count(F.lit(1)) > 0) & (F.count_if(F.col("site") != UNKNOWN_SITE) == 0))
                   .cast("long").alias("only_unknown_site"))
    e = errors.agg(F.count(F.lit(1)).alias("validation_records"))

    def stack(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value"))
            for n in names])).alias("m")).select("m.metric", "m.value")

    return (stack(o, ["row_count", "sites", "only_unknown_site"])
            .unionByName(stack(t, ["duplicates_removed"]))
            .unionByName(stack(e, ["validation_records"])))



def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` beside their ``place``."""
    from ..operators.rank import ranked
    return ranked(rows.withColumn("_order", F.col("place")), "_order")


def write_all(result, path: str, fmt: str = "parquet") -> None:
    """Persist every output of one run under ``path/<output>/as_of=.../site=...``.

    Re-running the same as-of date replaces exactly that day's folders.  Ranked
    lists carry their order in ``rank`` (as sort keys in ``place`` too, where cells can
    hold them) and rows their colour in ``severity``;
    blank numbers are 0.  Orders are written once: the reports leave out the full
    export and have the late lists in their own nine columns."""
    from ..operators.reports import late_lists, not_started
    from ..operators.tracker import issue_tracker
    from ..sources.headers import COLUMNS
    as_of, rules, orders = result.as_of, result.rules, result.orders
    late = [r.name for r in rules.reports if r.special]
    reports = result.detail_reports().where(~F.col("report").isin(FULL_EXPORT, *late))
    tracker = issue_tracker(orders, rules, result.now, placed=True)
    coloured = F.col("report") != DSD_REPORT  # of the reports, those of customers
    outputs = {
        "summary": result.all_plants_summary(),
        "issue_tracker": numbered(tracker).withColumn("severity", tracker_severity(F.col("status"))),
        "not_started": numbered(not_started(orders, placed=True)).withColumn("severity", not_started_severity(F.col("priority"))),
        "orders": orders.select("site", *COLUMNS, detail_severity(as_of).alias("severity"), "ordinal"),
        "reports": reports.withColumn("severity", F.when(coloured, detail_severity(as_of))),
        "late_lists": late_lists(orders, rules, as_of),
        "validation_errors": result.validation_errors,
        "catalog": result.report_catalog(),
    }
    by = {"issue_tracker": ("site",), "not_started": ("site",), "orders": ("site",), "reports": ("site", "report"),
          "late_lists": ("site", "report")}
    for name, df in outputs.items():
        write_output(df, f"{path}/{name}", as_of, partition_by=by.get(name, ()), fmt=fmt)
