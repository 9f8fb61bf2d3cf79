"""Benchmark: the whole pipeline and every headline report at $BENCH_SF_DIR.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs one warm-up pass on sf0.001, then times (wall clock, seconds):
  clean_and_enrich  raw export derived from ALL tables -> typed -> de-duplicated ->
             classified -> enriched, materialized once (as process_export does)
  <report>   each report computed over that materialized table, executed in
             full with the ``noop`` sink (nothing collected to the driver)
Prints ONE JSON line; ``value`` is the sum of all timings.
"""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from dockline.config import load_rules  # noqa: E402
from dockline.operators import facets, reports, summary, tracker  # noqa: E402
from dockline.plans.pipeline import process_export  # noqa: E402
from dockline.plans.queries import AS_OF, NOW  # noqa: E402
from dockline.session import local_session  # noqa: E402
from dockline.sinks import catalog  # noqa: E402
from dockline.sources.fixture import fixture_export  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def reports_of(res, rules):
    o = res.orders
    long = reports.detail_reports_long(o, rules, AS_OF)
    return {
        "validation_errors": res.validation_errors,
        "issue_tracker": tracker.issue_tracker(o, rules, NOW),
        "tracker_all_open": tracker.issue_tracker(o, rules, NOW, include_non_escalated=True),
        "not_started": reports.not_started(o),
        "all_plants_summary": summary.all_plants_summary(o, rules),
        "detail_reports_long": long,
        "report_totals": reports.report_totals(o, rules, AS_OF),
        "late_lists": reports.late_warehouse(o, AS_OF).unionByName(
            reports.late_dsd_independent(o, AS_OF)),
        "exec_kpis": facets.exec_kpis(o),
        "filter_options": facets.filter_options(o),
        "risk_value_by_planned_day": facets.risk_value_by_planned_day(o),
        "run_summary": res.run_summary(),
    }


def one_pass(spark, sf_dir, rules, timings=None):
    t0 = time.time()
    res = process_export(fixture_export(spark, sf_dir), AS_OF, rules, now=NOW)
    n = res.orders.count()  # materializes the enriched orders once
    if timings is not None:
        timings["clean_and_enrich"] = round(time.time() - t0, 3)
    for name, df in reports_of(res, rules).items():
        t = time.time()
        run(df)
        if timings is not None:
            timings[name] = round(time.time() - t, 3)
    res.release()
    return n


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="dockline-bench")
    rules = load_rules()
    one_pass(spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"), rules)
    timings: dict[str, float] = {}
    n = one_pass(spark, sf_dir, rules, timings)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "pipeline_and_reports_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "orders": n}))


if __name__ == "__main__":
    main()
