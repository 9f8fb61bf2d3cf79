"""The whole pipeline, returning lazy DataFrames over one materialized table.

raw text export -> typed + quarantined -> unique orders (one shuffle on the
delivery key) -> classified + enriched (narrow) -> materialized once
(a Parquet table in ``spark.checkpoint.dir``, else ``persist``) -> every report
is a DataFrame over it.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from ..config import Rules, load_rules
from ..operators.classify import by_table, classify
from ..operators.clean import MAX_BROADCAST_EXPORTS, errors_of, percent_factors, typed_for_orders, unique_orders
from ..operators.enrich import enrich
from ..session import wide_projections
from ..sources.headers import ExportSchemaError
from .materialize import broadcast_if, cut_lineage, release

if TYPE_CHECKING:
    from ..operators.sections import SiteSections

#: Where the plants are: the run clock's zone.
PLANT_ZONE = ZoneInfo("America/Edmonton")


@dataclass
class ProcessResult:
    """Everything one export produces.  Report methods return lazy DataFrames."""

    orders: DataFrame
    validation_errors: DataFrame
    as_of: dt.date
    now: dt.datetime
    rules: Rules
    typed: DataFrame = field(repr=False, default=None)  # worked out from the raw text when read
    unique: DataFrame | None = field(repr=False, default=None)  # where it is stored

    def release(self) -> None:
        """Give up what is stored; DataFrames made from it can't be run any more."""
        for stored in (self.orders, self.validation_errors, self.unique):
            if stored is not None:
                release(stored)

    def issue_tracker(self, include_non_escalated: bool = False, ordered: bool = True) -> DataFrame:
        from ..operators.tracker import issue_tracker
        return issue_tracker(self.orders, self.rules, self.now,
                             include_non_escalated=include_non_escalated, ordered=ordered)

    def not_started(self) -> DataFrame:
        from ..operators.reports import not_started
        return not_started(self.orders)

    def detail_reports(self) -> DataFrame:
        from ..operators.reports import detail_reports_long
        return detail_reports_long(self.orders, self.rules, self.as_of)

    def all_plants_summary(self) -> DataFrame:
        from ..operators.summary import all_plants_summary
        return all_plants_summary(self.orders, self.rules)

    def run_summary(self) -> DataFrame:
        from ..sinks.catalog import run_summary
        return run_summary(self.typed, self.orders, self.validation_errors)

    def warnings(self) -> list[str]:
        """Run warnings, from the five-row run summary."""
        from ..sinks.catalog import UNKNOWN_SITE_WARNING, UNPARSED_WARNING
        meta = {r["metric"]: r["value"] for r in self.run_summary().collect()}
        out = []
        if meta.get("only_unknown_site"):
            out.append(UNKNOWN_SITE_WARNING)
        if meta.get("validation_records"):
            out.append(UNPARSED_WARNING.format(n=meta["validation_records"]))
        return out

    def site_sections(self) -> SiteSections:
        """By site (section order) its tracker, not-started list, orders and
        reports, as slices of one sorted table that is made here."""
        from ..operators.classify import ordered_sites
        from ..operators.sections import SiteSections, site_sections
        table = site_sections(self.orders, self.rules, self.as_of, self.now)
        return SiteSections(table, ordered_sites(self.orders, self.rules))

    def report_catalog(self) -> DataFrame:
        from ..sinks.catalog import report_catalog
        return report_catalog(self.all_plants_summary(), self.issue_tracker(ordered=False),
                              self.not_started().select("site", "sales_order_total"),
                              self.orders, self.validation_errors, self.rules, self.as_of)

    def report_totals(self) -> DataFrame:
        from ..operators.reports import report_totals
        return report_totals(self.orders, self.rules, self.as_of)

    def filtered(self, **facets) -> "ProcessResult":
        """every output recomputed over the facet-filtered orders; the
        validation errors stay those of the whole upload."""
        from ..operators.facets import facet_filter
        return ProcessResult(orders=facet_filter(self.orders, **facets),
                             validation_errors=self.validation_errors, as_of=self.as_of,
                             now=self.now, rules=self.rules, typed=self.typed)


def process_export(raw: DataFrame, as_of: dt.date, rules: Rules | None = None,
                   now: dt.datetime | None = None, materialize: str = "auto",
                   require_rows: bool = True) -> ProcessResult:
    """Run the pipeline on one raw export (see ``dockline.sources``).

    ``now``: the run clock in the texts, by default the plants' current time.
    Rows of more than one ``export_id`` are an error: see ``process_exports``."""
    rules = rules or load_rules()
    now = now or dt.datetime.now(PLANT_ZONE).replace(tzinfo=None)
    with wide_projections(raw.sparkSession):
        factors = percent_factors(raw)
        typed = typed_for_orders(raw, factors)
        unique = unique_orders(raw, factors)
        if by_table(rules):  # reads them twice
            unique = cut_lineage(unique, materialize)
        orders = cut_lineage(enrich(classify(unique, rules), as_of, rules), materialize)
        errors = cut_lineage(errors_of(raw, factors), materialize)
        ids = orders.select("export_id").union(errors.select("export_id")).distinct().limit(2).count()
    # Every non-blank row is either a delivery row or a missing-key error,
    # so "no data rows" is checked on the two stored tables (no extra pass).
    if require_rows and not ids:
        raise ExportSchemaError("The export contains headers but no data rows.")
    if ids > 1:
        raise ExportSchemaError("The rows come from more than one export; process each by itself.")
    return ProcessResult(orders=orders, validation_errors=errors,
                         as_of=as_of, now=now, rules=rules, typed=typed,
                         unique=unique if by_table(rules) else None)


@dataclass
class ManyExports:
    """Several exports, processed together: every table has their ``export_id``."""

    orders: DataFrame  # with as_of, the day of the row's export
    validation_errors: DataFrame
    days: dict[str, dt.date]
    now: dt.datetime
    rules: Rules
    typed: DataFrame = field(repr=False, default=None)  # worked out from the raw text when read
    unique: DataFrame | None = field(repr=False, default=None)  # where it is stored

    def release(self) -> None:
        for stored in (self.orders, self.validation_errors, self.unique):
            if stored is not None:
                release(stored)

    def all_plants_summary(self, ordered: bool = True) -> DataFrame:
        """The summary of every export, in one aggregation."""
        from ..operators.summary import all_plants_summary
        return all_plants_summary(self.orders, self.rules, ordered, by=["export_id"])

    def issue_tracker(self, include_non_escalated: bool = False, ordered: bool = True) -> DataFrame:
        """The tracker of every export, in one aggregation."""
        from ..operators.tracker import issue_tracker
        return issue_tracker(self.orders, self.rules, self.now, include_non_escalated, ordered, by=["export_id"])

    def of(self, export_id: str) -> ProcessResult:
        """One of the exports, with all of its reports."""
        from pyspark.sql import functions as F
        mine = F.col("export_id") == export_id
        return ProcessResult(orders=self.orders.where(mine), validation_errors=self.validation_errors.where(mine),
                             as_of=self.days[export_id], now=self.now, rules=self.rules, typed=self.typed.where(mine))


def process_exports(raw: DataFrame, days: Mapping[str, dt.date], rules: Rules | None = None,
                    now: dt.datetime | None = None, materialize: str = "auto") -> ManyExports:
    """Run the pipeline once on rows of many exports (by ``export_id``), each with its
    as-of day in ``days``.

    Percents are scaled, orders made unique and days counted within each export; the
    days are a dimension joined to the orders, broadcast if there are few.  Rows of an
    export without a day, or an export without rows, are an error."""
    from pyspark.sql import functions as F
    rules = rules or load_rules()
    now = now or dt.datetime.now(PLANT_ZONE).replace(tzinfo=None)
    spark = raw.sparkSession
    known = broadcast_if(spark.createDataFrame(sorted(days.items()), "export_id string, as_of date"),
                         len(days) <= MAX_BROADCAST_EXPORTS)
    with wide_projections(spark):
        factors = percent_factors(raw)
        typed = typed_for_orders(raw, factors)
        unique = unique_orders(raw, factors)
        if by_table(rules):
            unique = cut_lineage(unique, materialize)
        dated = classify(unique, rules).join(known, "export_id", "left")
        orders = cut_lineage(enrich(dated, F.col("as_of"), rules), materialize)
        errors = cut_lineage(errors_of(raw, factors), materialize)
        there = orders.select("export_id").union(errors.select("export_id")).distinct()
        wrong = [r[0] for r in there.join(known, "export_id", "left_anti").limit(5).collect()]
        missing = [r[0] for r in known.join(there, "export_id", "left_anti").select("export_id").limit(5).collect()]
    if wrong or missing:
        raise ExportSchemaError("; ".join(f"{text}: {', '.join(sorted(ids))}" for text, ids in (
            ("exports without a day", wrong), ("exports without rows", missing)) if ids))
    return ManyExports(orders=orders, validation_errors=errors, days=dict(days), now=now, rules=rules, typed=typed,
                       unique=unique if by_table(rules) else None)
