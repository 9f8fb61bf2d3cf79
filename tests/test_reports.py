import pytest
from pyspark.sql import functions as F

from dockline.operators import reports, summary, tracker
from dockline.plans.queries import fixture_orders
from helpers import AS_OF, NOW, RULES, day, order, processed


def test_tracker_row_and_its_texts(spark):
    late = dict(ship_to_name="Amazon yard", ys="Laval DC")
    res = processed(spark, [order(1, **late, planned_dlv_date=day(-4), sales_order_total="1200.5"),
                            order(2, **late, planned_dlv_date=day(-2), sales_order_total="34"),
                            order(3, **late, planned_dlv_date=day(20))])
    row, = (r.asDict() for r in res.issue_tracker().collect())
    assert (row["site"], row["customer"], row["issue_type"], row["status"], row["owner"], row["detail_report"]) == (
        "Laval", "Amazon", "Late Delivery", "Critical", "Unassigned", "AMZ")
    assert (row["total_price"], row["order_count"], row["due_date"].day) == (1234.5, 2, 8)
    assert row["issue"] == ("2 Amazon order(s) are past the planned delivery date (earliest Mar 08, 2031) with Goods "
                            "Issue still open. Affected LE Deliveries: 90001, 90002.")
    assert row["latest_update"] == ("As of Mar 12, 2031 at 2:05 PM: 2 orders are late, 2 are not started and the current "
                                    "value at risk is $1,234. The nearest due date is Mar 08, 2031.")


def test_tracker_rows_are_per_site_customer_and_issue_in_order(spark):
    res = processed(spark, [
        order(1, ship_to_name="SYSCO", planned_dlv_date=day(-1), ys="Surrey Warehouse", sales_order_total="10"),
        order(2, ship_to_name="SYSCO", planned_dlv_date=day(-1), ys="Laval", sales_order_total="900"),
        order(3, ship_to_name="SYSCO", route_depart_date=day(-1), picking_in_pct="3", ys="Laval"),
        order(4, ship_to_name="A&W", planned_dlv_date=day(1), ys="Laval")])
    rows = [(r["site"], r["issue_type"], r["status"]) for r in res.issue_tracker().collect()]
    assert rows == [("Laval", "Late Delivery", "Critical"), ("Surrey", "Late Delivery", "Critical"),
                    ("Laval", "Route Departure Missed", "Critical"), ("Laval", "Not Started", "At Risk")]


def test_late_lists_sorted_by_date_picking_and_value(spark):
    past = dict(planned_dlv_date=day(-1))
    res = processed(spark, [
        order(1, **past, picking_in_pct="50"), order(2, **past, picking_in_pct="5", sales_order_total="1"),
        order(3, **past, picking_in_pct="5", sales_order_total="2"), order(4, planned_dlv_date=day(-9)),
        order(5, **past, picking_in_pct="100"), order(6), order(7, **past, facility_code="dsd"),
        order(8, **past, facility_code=" INDEPENDANT "), order(9, **past, facility_code="DSD", goods_issue="completed")])
    wh, dsd = reports.late_warehouse(res.orders, AS_OF), reports.late_dsd_independent(res.orders, AS_OF)
    assert [r["le_delivery"] for r in wh.collect()] == ["90004", "90003", "90002", "90001"]
    assert [r["le_delivery"] for r in dsd.collect()] == ["90007", "90008"] and len(wh.columns) == 9


def test_customer_reports_and_not_started(spark):
    res = processed(spark, [
        order(1, ship_to_name="AMZ", customer_dock_appointment_date=day(8)), order(2, ship_to_name="AMZ"),
        order(3, ship_to_name="Save-On", facility_code="DSD"), order(4, ship_to_name="saveon 3", facility_code=" warehouse"),
        order(5, ship_to_name="Calgary Co Op", picking_in_pct="40"), order(6, goods_issue="COMPLETED")])
    spec = {r.name: r for r in RULES.reports}

    def ids(name):
        return [r["le_delivery"] for r in reports.customer_report(res.orders, spec[name]).collect()]
    amz = reports.customer_report(res.orders, spec["AMZ"]).collect()
    assert [r["comments"] for r in amz] == ["Cancellation deadline 03/20", ""]
    assert ids("PFG WHSE") == ["90004"] and ids("Calgary CO-OP") == ["90005"] and ids("Pratts") == []
    assert [r["comments"] for r in reports.customer_report(res.orders, spec["Calgary CO-OP"]).collect()] == [""]
    assert sorted(r["le_delivery"] for r in res.not_started().collect()) == ["90001", "90002", "90003", "90004"]


def test_report_totals_have_empty_reports_for_all_plants_only(spark):
    res = processed(spark, [order(1, ship_to_name="GFS", ys="Laval", sales_order_total="5"), order(2, ys="Surrey")])
    got = {(r["scope"], r["report"]): (r["rows"], r["total"]) for r in res.report_totals().collect()}
    names = {"DSD Priorities", *(r.name for r in RULES.reports)}
    assert {n for s, n in got if s == "All Plants"} == names
    assert {k: v for k, v in got.items() if v[0]} == {("All Plants", "GFS"): (1, 5.0), ("Laval", "GFS"): (1, 5.0)}


@pytest.fixture(scope="module")
def fixture_small(spark):
    return fixture_orders(spark, "/root/testdata/sf0.001")


def test_invariants_on_fixture(spark, fixture_small):
    o = fixture_small
    # one row per delivery; each delivery in exactly one site
    assert o.count() == o.select("le_delivery").distinct().count()
    s = {r["site"]: r.asDict() for r in summary.all_plants_summary(o, RULES).collect()}
    total = s.pop("All Plants")
    for col in ["total_orders", "late_orders", "completed", "partial", "not_started"]:
        assert total[col] == sum(v[col] for v in s.values())
    for col in ["total_price", "late_value"]:
        assert total[col] == pytest.approx(sum(v[col] for v in s.values()), abs=0.01)
    # the late buckets partition the late orders
    for row in list(s.values()) + [total]:
        assert row["completed"] + row["partial"] + row["not_started"] == row["late_orders"]
        assert row["completed_value"] + row["partial_value"] + row["not_started_value"] == \
            pytest.approx(row["late_value"], abs=0.01)
    # a site's tracker equals the all-plants tracker filtered to that site
    t_all = tracker.issue_tracker(o, RULES, NOW, ordered=False)
    site = next(iter(s))
    t_site = tracker.issue_tracker(o.filter(F.col("site") == site), RULES, NOW, ordered=False)
    assert sorted(map(tuple, t_site.collect())) == \
        sorted(map(tuple, t_all.filter(F.col("site") == site).collect()))


def test_repeated_deliveries_count_once(spark):
    res = processed(spark, [order(1, le_delivery=i, planned_dlv_date=day(-1)) for i in ("12", "12.0", " 12 ")])
    total = {r["site"]: r for r in res.all_plants_summary().collect()}["All Plants"]
    assert (total["total_orders"], total["total_price"]) == (1, 250.0)
    meta = {r["metric"]: r["value"] for r in res.run_summary().collect()}
    assert (meta["duplicates_removed"], meta["row_count"]) == (2, 1)


def test_run_warnings(spark):
    none = processed(spark, [order(1, ys=None), order(2, ys=" ", le_delivery=None)])
    meta = {r["metric"]: r["value"] for r in none.run_summary().collect()}
    assert (meta["only_unknown_site"], meta["sites"], meta["validation_records"]) == (1, 1, 1)
    first, second = none.warnings()
    assert "Unknown warehouse" in first and second.startswith("1 record(s)")
    assert processed(spark, [order(1)]).warnings() == []
