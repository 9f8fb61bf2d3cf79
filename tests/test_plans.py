import io
from contextlib import redirect_stdout

from dockline.operators.clean import dedup_orders
from dockline.plans.queries import QUERIES, fixture_typed

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_python_udfs_anywhere(spark):
    for name in ["enriched_orders", "issue_tracker", "detail_reports_long", "report_catalog"]:
        text = plan_text(QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_dedup_is_one_partial_aggregation_and_one_exchange_on_the_key(spark):
    text = plan_text(dedup_orders(fixture_typed(spark, SF)))
    assert "partial_min_by" in text
    lines = text.splitlines()
    hash_exchanges = [ln for ln in lines if "Arguments: hashpartitioning(" in ln]
    # one for the rows, on the delivery; one for the percent factors, a row a task
    rows, factors = sorted(hash_exchanges, key=lambda ln: "le_delivery" not in ln)
    assert len(hash_exchanges) == 2 and "le_delivery" in rows and "le_delivery" not in factors


def test_large_dimension_path_stores_the_export_once(spark, monkeypatch):
    import dockline.sources.fixture as fx
    from oracle_check import compare
    monkeypatch.setattr(fx, "MAX_BROADCAST_ROWS", 10)  # dimensions "too large" to broadcast
    raw = fx.fixture_export(spark, SF)
    assert "Scan parquet" in raw._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan_text(raw)
    res = compare(spark, SF, ["all_plants_summary", "validation_errors"], verbose=True)
    assert all(v is True for v in res.values())


def test_building_reports_launches_no_job(spark):
    from dockline.operators import facets, reports, summary, tracker
    from dockline.plans.queries import AS_OF, NOW, RULES, fixture_orders
    from dockline.sinks import catalog
    orders = fixture_orders(spark, SF)
    sc = spark.sparkContext
    sc.setJobGroup("building", "reports")
    try:
        built = [tracker.issue_tracker(orders, RULES, NOW), tracker.issue_tracker(orders, RULES, NOW, True),
                 reports.not_started(orders), reports.report_totals(orders, RULES, AS_OF),
                 reports.detail_reports_long(orders, RULES, AS_OF), summary.all_plants_summary(orders, RULES),
                 facets.exec_kpis(orders), facets.filter_options(orders),
                 catalog.report_catalog(orders, orders.withColumn("total_price", orders.sales_order_total), orders, orders,
                                        orders, RULES, AS_OF)]
        assert len(built) == 9 and not sc.statusTracker().getJobIdsForGroup("building")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_raw_text_is_read_once(spark):
    """Orders, percents and errors come from the stored typed rows."""
    from dockline.operators.clean import typed_export, validation_errors
    from dockline.plans.materialize import cut_lineage
    from dockline.sources.fixture import fixture_export
    typed = typed_export(fixture_export(spark, SF), lambda rows: cut_lineage(rows, "persist"))
    for df in (dedup_orders(typed), validation_errors(typed)):
        text = plan_text(df)
        assert "InMemoryTableScan" in text or "TableCacheQueryStage" in text


def test_tracker_is_one_aggregation_over_one_scan(spark):
    """Ids come from the same aggregation as the numbers: no second scan, no join."""
    from dockline.operators import tracker
    from dockline.plans.queries import NOW, RULES, fixture_orders
    orders = fixture_orders(spark, SF)
    orders.count()
    text = plan_text(tracker.issue_tracker(orders, RULES, NOW, ordered=False))
    tree = text.split("\n\n")[0]
    assert tree.count("InMemoryTableScan") + tree.count("Scan parquet") == 1
    assert "Join" not in tree and tree.count("Exchange") == 1 and tree.count("HashAggregate") == 2
