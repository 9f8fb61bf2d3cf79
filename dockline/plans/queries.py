"""Named queries over the TPC-H-derived export (one per operator family).

Each query takes ``(spark, sf_dir)``, derives the raw export from ALL rows of
the tables in ``sf_dir``, runs the pipeline, then the operator.  Results are
unordered here (the driver compares them order-insensitively); the library
functions sort at the output edge when asked to.
"""
from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, Rules, load_rules
from ..operators import facet_cube, facets, reports, sections, summary, tracker
from ..operators.classify import classify, ordered_sites
from ..operators.clean import errors_of, percent_factors, typed_export, unique_orders
from ..operators.enrich import enrich
from ..operators.rank import ranked
from ..sinks import catalog
from ..session import ensure_checkpoint_dir, tune_for_wide_projections
from .materialize import cut_lineage
from .pipeline import process_export, process_exports
from ..sources.export import from_table, read_export
from ..sources.fixture import FIXTURE_AS_OF, fixture_export, messy_export, write_csv_files
from ..sources.headers import COLUMNS

AS_OF = dt.date.fromisoformat(FIXTURE_AS_OF)
NOW = dt.datetime(1998, 1, 15, 8, 0)
RULES = load_rules()
SPEC = {r.name: r for r in RULES.reports}

# Fixed facet selections used by the registered facet queries.
F2_SELECTION = {"site": ["AMERICA", "ASIA"], "priority": ["Critical", "High"]}
F11_SELECTION = {"site": ["EUROPE"], "customer": ["Amazon", "Walmart"]}

ENRICHED_COLUMNS = [
    "le_delivery", "site", "customer_group", "customer_display", "customer_priority",
    "picking_in_pct", "sales_order_total", "planned_dlv_date", "route_depart_date",
    "customer_dock_appointment_date", "is_open", "is_not_started", "is_late",
    "is_route_departure_missed", "days_to_planned_delivery", "days_to_route_departure",
    "days_to_customer_deadline", "earliest_due_days", "risk_status", "issue_type", "priority",
    "priority_rank", "due_date", "customer_report"]


SECTION_COLUMNS = [
    "site", "site_seq", "part", "report", "rank", "customer", "issue_type", "issue", "status", "total_price", "order_count",
    "due_date", "priority", "customer_group", "picking_status", "days_to_planned_delivery", "comments", "le_delivery",
    "ship_to_name", "facility_code", "goods_issue", "picking_in_pct", "planned_dlv_date", "sales_order_total"]


def fixture_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune_for_wide_projections(spark)
    return typed_export(fixture_export(spark, sf_dir, materialize_large=False), cut_lineage)


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders, materialized once like ``process_export`` does.  Reports
    filter on derived columns (risk_status, site); against the stored table
    those filters stay small instead of being pushed into (and inlining) the
    whole enrichment expression."""
    tune_for_wide_projections(spark)
    unique = unique_orders(fixture_export(spark, sf_dir, materialize_large=False))
    return cut_lineage(enrich(classify(unique, RULES), AS_OF, RULES))


def fixture_orders_and_errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Enriched orders as above, and the validation errors."""
    tune_for_wide_projections(spark)
    raw = fixture_export(spark, sf_dir, materialize_large=False)
    factors = percent_factors(raw)
    orders = cut_lineage(enrich(classify(unique_orders(raw, factors), RULES), AS_OF, RULES))
    return orders, errors_of(raw, factors)


def _orders(fn):
    def q(spark, sf_dir):
        return fn(fixture_orders(spark, sf_dir))
    q.__name__ = fn.__name__
    return q


def q_typed_export(spark, sf_dir):
    t = fixture_typed(spark, sf_dir)
    return t.select(*COLUMNS, "bad_total", F.col("ordinal.k1").alias("k1"),
                    F.col("ordinal.k2").alias("k2"), F.col("ordinal.k3").alias("k3"),
                    F.col("ordinal.k4").alias("k4"), F.col("ordinal.k5").alias("k5"))


def account_rules(n: int) -> Rules:
    """``n`` rules, one for each account number, before the default ones: a ship-to
    number, a ship-to prefix, a fragment of a number, or a carrier."""
    kinds = [("ship_to_contains", "#{:09d}", 1), ("ship_to_startswith", "WMX Customer#{:09d}", 1),
             ("ship_to_contains", "{:04d}", 7), ("carrier_contains", "carrier {}", 1)]
    accounts = []
    for k in range(n):
        name, text, factor = kinds[k % 4]
        accounts.append({"key": f"account_{k:05d}", "priority": k % 3 + 1,
                         "match": {name: [text.format(k * factor % 10_000)]}})
    return Rules({**DEFAULT_RULES, "customers": accounts + DEFAULT_RULES["customers"]})


def q_classified_by_rule_table(spark, sf_dir):
    """Ten thousand account rules and the default ones, by the rule-table join."""
    tune_for_wide_projections(spark)
    orders = cut_lineage(unique_orders(fixture_export(spark, sf_dir, materialize_large=False)).select(
        "le_delivery", "ys", "ship_to_name", "carrier_description"))
    return classify(orders, account_rules(10_000)).select(
        "le_delivery", "customer_group", "customer_display", "customer_priority", "customer_report", "site")


def q_messy_header_export(spark, sf_dir):
    """The same export under untidy headers, resolved and typed."""
    tune_for_wide_projections(spark)
    t = typed_export(from_table(messy_export(fixture_export(spark, sf_dir))))
    return t.select(*COLUMNS, "bad_total", *(F.col(f"ordinal.k{i}").alias(f"k{i}") for i in range(1, 6)))


def q_scan_export(spark, sf_dir):
    """The export written as CSV files under three header rows, read back and typed."""
    tune_for_wide_projections(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dockline-tables/{uuid.uuid4().hex}"
    folders = write_csv_files(cut_lineage(fixture_export(spark, sf_dir, materialize_large=False)), folder)
    return typed_export(read_export(spark, folders)).select(*COLUMNS, "bad_total")


#: Three exports of three days.
EXPORT_DAYS = {f"export-{k}": AS_OF + dt.timedelta(days=d) for k, d in enumerate((-2, 0, 3))}


def three_exports(spark, sf_dir) -> DataFrame:
    """The fixture's deliveries as three exports; the last one has fractions for
    percents."""
    raw = fixture_export(spark, sf_dir, materialize_large=False)
    number = F.pmod("ordinal.k1", F.lit(3))
    pct = F.col("picking_in_pct")
    part = F.when(pct == "150", "1").otherwise(F.coalesce((pct.try_cast("double") / 100).cast("string"), pct))
    return raw.withColumns({"export_id": F.concat(F.lit("export-"), number.cast("string")),
                            "picking_in_pct": F.when(number == 2, part).otherwise(pct)})


def _exports(fn):
    def q(spark, sf_dir):
        return fn(process_exports(three_exports(spark, sf_dir), EXPORT_DAYS, RULES, NOW))
    return q


def q_processed_and_filtered(spark, sf_dir):
    """G8 and F11 through the pipeline's own result."""
    raw = fixture_export(spark, sf_dir, materialize_large=False)
    return process_export(raw, AS_OF, RULES, now=NOW).filtered(**F11_SELECTION).issue_tracker(
        ordered=False)


def q_clean_orders(spark, sf_dir):
    tune_for_wide_projections(spark)
    return unique_orders(fixture_export(spark, sf_dir, materialize_large=False)).select(*COLUMNS)


def q_validation_errors(spark, sf_dir):
    tune_for_wide_projections(spark)
    return errors_of(fixture_export(spark, sf_dir, materialize_large=False)).select(
        "validation_issue", *COLUMNS)


def q_run_summary(spark, sf_dir):
    return catalog.run_summary(None, *fixture_orders_and_errors(spark, sf_dir))


def q_report_catalog(spark, sf_dir):
    orders, errors = fixture_orders_and_errors(spark, sf_dir)
    return catalog.report_catalog(
        summary.all_plants_summary(orders, RULES, ordered=False),
        tracker.issue_tracker(orders, RULES, NOW, ordered=False),
        reports.not_started(orders, ordered=False).select("site", "sales_order_total"),
        orders, errors, RULES, AS_OF)


def _filtered_tracker(orders):
    return tracker.issue_tracker(facets.facet_filter(orders, **F11_SELECTION), RULES, NOW,
                                 ordered=False)


def _facet_cube(orders):
    cube = facet_cube.facet_cube(orders)
    return cube.select(*facet_cube.KEYS, *facet_cube.COUNTS,
                       *(F.col(c).cast("double").alias(c) for c in facet_cube.VALUES))


def _filtered_kpis(orders):
    """F3 and F9 of a selection, from the cube."""
    chosen = facets.facet_filter(facet_cube.facet_cube(orders), **F2_SELECTION)
    return chosen.agg(*facet_cube.exec_columns(), *facet_cube.not_started_columns()[2:])


def _tracker_row_orders(orders):
    """F8 for one row: the orders behind the tracker's first one in its order."""
    first = tracker.issue_tracker(orders, RULES, NOW).limit(1)
    return tracker.behind(orders, first)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources + cleaning
    "typed_export": q_typed_export,
    "messy_header_export": q_messy_header_export,
    "scan_export": q_scan_export,
    "clean_orders": q_clean_orders,
    "validation_errors": q_validation_errors,
    "run_summary": q_run_summary,
    # classification + enrichment
    "enriched_orders": _orders(lambda o: o.select(*ENRICHED_COLUMNS, "issue_type_rank")),
    "classified_by_rule_table": q_classified_by_rule_table,
    "ordered_sites": _orders(lambda o: ordered_sites(o, RULES)),
    # whole runs
    "many_exports_summary": _exports(lambda m: m.all_plants_summary(ordered=False)),
    "many_exports_tracker": _exports(lambda m: m.issue_tracker(ordered=False)),
    "processed_and_filtered": q_processed_and_filtered,
    # reports
    "all_plants_summary": _orders(lambda o: summary.all_plants_summary(o, RULES, ordered=False)),
    "issue_tracker": _orders(lambda o: tracker.issue_tracker(o, RULES, NOW, ordered=False)),
    "tracker_all_open": _orders(lambda o: tracker.issue_tracker(
        o, RULES, NOW, include_non_escalated=True, ordered=False)),
    "tracker_ranked": _orders(lambda o: ranked(tracker.issue_tracker(o, RULES, NOW, placed=True))),
    "not_started_ranked": _orders(lambda o: ranked(reports.not_started(o, placed=True))),
    "not_started": _orders(lambda o: reports.not_started(o, ordered=False)),
    "full_export": _orders(lambda o: reports.full_export(o, ordered=False)),
    "report_amz": _orders(lambda o: reports.customer_report(o, SPEC["AMZ"], ordered=False)),
    "report_pfg_whse": _orders(lambda o: reports.customer_report(o, SPEC["PFG WHSE"], ordered=False)),
    "report_calgary_coop": _orders(
        lambda o: reports.customer_report(o, SPEC["Calgary CO-OP"], ordered=False)),
    "report_pratts": _orders(lambda o: reports.customer_report(o, SPEC["Pratts"], ordered=False)),
    "report_gfs": _orders(lambda o: reports.customer_report(o, SPEC["GFS"], ordered=False)),
    "late_warehouse": _orders(lambda o: reports.late_warehouse(o, AS_OF, ordered=False)),
    "late_lists": _orders(lambda o: reports.late_lists(o, RULES, AS_OF).drop("place")),
    "late_dsd_independent": _orders(
        lambda o: reports.late_dsd_independent(o, AS_OF, ordered=False)),
    "dsd_priorities": _orders(lambda o: reports.dsd_priorities(o, RULES, ordered=False)),
    "detail_reports_long": _orders(lambda o: reports.detail_reports_long(o, RULES, AS_OF).select(
        "report", "comments", "priority", "site", *COLUMNS)),
    "report_totals": _orders(lambda o: reports.report_totals(o, RULES, AS_OF)),
    "site_sections": _orders(lambda o: sections.site_sections(o, RULES, AS_OF, NOW).select(*SECTION_COLUMNS)),
    "report_catalog": q_report_catalog,
    # dashboard queries
    "filter_options": _orders(facets.filter_options),
    "facet_filter": _orders(lambda o: facets.facet_filter(o, **F2_SELECTION).select(
        "le_delivery", "site", "customer_display", "risk_status", "priority", "sales_order_total")),
    "exec_kpis": _orders(facets.exec_kpis),
    "risk_value_by_customer": _orders(lambda o: facets.risk_value_by_customer(o, ordered=False)),
    "not_started_by_customer": _orders(lambda o: facets.not_started_by_customer(o, ordered=False)),
    "status_distribution": _orders(lambda o: facets.status_distribution(o, ordered=False)),
    "risk_value_by_planned_day": _orders(
        lambda o: facets.risk_value_by_planned_day(o, ordered=False)),
    "tracker_drilldown": _orders(tracker.tracker_drilldown_all),
    "not_started_kpis": _orders(facets.not_started_kpis),
    "facet_cube": _orders(_facet_cube),
    "filtered_kpis": _orders(_filtered_kpis),
    "tracker_row_orders": _orders(_tracker_row_orders),
    "filtered_tracker": _orders(_filtered_tracker),
    # sink shaping
    "row_severity": _orders(lambda o: o.select(
        "le_delivery", "site", catalog.detail_severity(AS_OF).alias("severity"),
        catalog.tracker_severity(F.col("risk_status")).alias("status_severity"),
        catalog.not_started_severity(F.col("priority")).alias("priority_severity"))),
    "report_with_total": _orders(lambda o: catalog.with_total_row(
        reports.customer_report(o, SPEC["GFS"], ordered=False)
        .select("le_delivery", "ship_to_name", "sales_order_total"), "le_delivery")),
}
