from pyspark.sql import functions as F

from dockline.plans.materialize import cut_lineage
from dockline.sinks.catalog import (COMBINED, detail_severity, not_started_severity, null_as_zero, tracker_severity,
                                    with_total_row, write_all)
from dockline.sinks.display import TRACKER_HEADERS, with_display_names
from helpers import AS_OF, day, order, processed, records

ORDERS = [
    order(1, ship_to_name="AMZ", planned_dlv_date=day(-4), sales_order_total="70"),
    order(2, ship_to_name="Sysco", ys="Calgary Warehouse", picking_in_pct="30"),
    order(3, ship_to_name="GFS", ys="Winnipeg DC", planned_dlv_date=day(-2), sales_order_total="30"),
    order(4, ys="Calgary Warehouse", le_delivery=""),
    order(5, ship_to_name="DELUCA BROS FOODS", ys="Calgary Warehouse", picking_in_pct="30"),
]


def test_catalog(spark):
    cat = processed(spark, ORDERS).report_catalog().collect()
    sheets = [r["sheet"] for r in cat]
    assert sheets[:3] == COMBINED and sheets[-2:] == ["SAPUI5 Export", "Validation Warnings"]
    assert sheets[3:-2] == [
        "Calgary Issue Tracker", "Calgary Not Started", "Calgary Orders", "Calgary - DSD Priorities", "Calgary - Sysco",
        "Surrey Issue Tracker", "Surrey Not Started", "Surrey Orders", "Surrey - AMZ", "Surrey - Andrew Tab",
        "Winnipeg Issue Tracker", "Winnipeg Not Started", "Winnipeg Orders", "Winnipeg - Andrew Tab", "Winnipeg - GFS"]
    by = {r["sheet"]: r for r in cat}
    assert (by["Calgary Issue Tracker"]["rows"], by["Calgary Not Started"]["rows"]) == (0, 0)  # listed, though empty
    totals = {s: r["total"] for s, r in by.items() if r["total"] is not None}
    assert totals == {"Calgary Orders": 500.0, "Calgary - Sysco": 250.0, "Surrey Orders": 70.0, "Surrey - AMZ": 70.0,
                      "Winnipeg Orders": 30.0, "Winnipeg - GFS": 30.0}
    assert [s for s, r in by.items() if r["note"]] == ["Surrey - AMZ"]
    assert (by["Surrey Issue Tracker"]["shading"], by["Surrey - Andrew Tab"]["shading"], by["Surrey - AMZ"]["shading"],
            by["SAPUI5 Export"]["rows"]) == ("status", None, "detail", 4)
    assert len({r["seq"] for r in cat}) == len(cat)


def test_site_sections_equal_filtered_outputs(spark):
    sections = processed(spark, ORDERS).site_sections()
    assert list(sections) == ["Calgary", "Surrey", "Winnipeg"]
    assert sections["Surrey"]["issue_tracker"].count() == 1 and sections["Calgary"]["orders"].count() == 2
    assert {r["report"] for r in sections["Winnipeg"]["reports"].collect()} == {"GFS", "Andrew Tab"}


def test_filtered_rebuild_keeps_validation_errors(spark):
    res = processed(spark, ORDERS)
    only = res.filtered(site=["Surrey"])
    assert [r["site"] for r in only.all_plants_summary().collect()] == ["Surrey", "All Plants"]
    assert only.validation_errors.count() == res.validation_errors.count() == 1


def test_colours(spark):
    statuses = ["Critical", "At Risk", "Not Started", "Ready / Awaiting GI", "In Progress", "Resolved"]
    df = spark.createDataFrame([(s,) for s in statuses + ["High", "Medium", "Low"]], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", tracker_severity(F.col("s")), not_started_severity(F.col("s"))).collect()}
    assert [got[s][0] for s in statuses] == ["red", "orange", "yellow", "green", None, None]
    assert [got[s][1] for s in ("Critical", "High", "Medium", "Low")] == ["red", "orange", "yellow", None]
    res = processed(spark, ORDERS + [order(6), order(7, goods_issue="completed", planned_dlv_date=day(-9))])
    sev = {r["le_delivery"]: r["s"] for r in res.orders.select("le_delivery", detail_severity(AS_OF).alias("s")).collect()}
    assert sev == {"90001": "red", "90002": None, "90003": "red", "90005": None, "90006": "yellow", "90007": None}


def test_total_row_zero_fill_and_display_names(spark):
    orders = processed(spark, ORDERS).orders
    total, = (r for r in with_total_row(orders.select("le_delivery", "sales_order_total"), "le_delivery").collect()
              if r["is_total"])
    assert (total["le_delivery"], total["sales_order_total"]) == ("TOTAL", 600.0)
    filled = null_as_zero(orders.select(F.lit(None).cast("double").alias("cases"), F.lit(None).cast("double").alias("x")))
    assert {tuple(r) for r in filled.collect()} == {(0.0, None)}
    shown = with_display_names(processed(spark, ORDERS).issue_tracker(), TRACKER_HEADERS)
    assert shown.columns[:3] == ["Site", "Customer", "Issue Type"]


def test_a_day_is_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    write_all(processed(spark, ORDERS), out)
    write_all(processed(spark, ORDERS[1:2]), out)
    assert [r["le_delivery"] for r in spark.read.parquet(out + "/orders").collect()] == ["90002"]
    assert not list((tmp_path / "out" / "issue_tracker").rglob("*.parquet"))  # nothing escalates any more
    assert spark.read.parquet(out + "/catalog").count() == 8


def test_written_lists_keep_their_order(spark, tmp_path):
    out = str(tmp_path / "out")
    res = processed(spark, ORDERS + [order(i, planned_dlv_date=day(9 - i)) for i in range(10, 20)])
    write_all(res, out)
    for name, df in (("not_started", res.not_started()), ("issue_tracker", res.issue_tracker())):
        written = spark.read.parquet(f"{out}/{name}")
        keys = [c for c in df.columns if c in ("le_delivery", "site", "customer", "issue_type")]
        for site in ("Surrey", "Winnipeg"):
            want = [tuple(r[k] for k in keys) for r in df.where(F.col("site") == site).collect()]
            assert [tuple(r[k] for k in keys) for r in written.where(F.col("site") == site).orderBy("place").collect()] == want


def test_checkpoint_mode_cuts_lineage(spark):
    kept = cut_lineage(processed(spark, ORDERS).orders, "checkpoint")
    assert len(records(kept)) == 4 and "Scan" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_and_colours_of_written_files(spark, tmp_path):
    out = str(tmp_path / "out")
    res = processed(spark, ORDERS + [order(i, planned_dlv_date=day(9 - i), ship_to_name=name)
                                     for i, name in enumerate(["PRATT'S WHOLESALE", "AMZ 1", "gfs"] * 4, 10)])
    write_all(res, out)
    for name, df in (("not_started", res.not_started()), ("issue_tracker", res.issue_tracker())):
        keys = [c for c in df.columns if c in ("le_delivery", "site", "customer", "issue_type")]
        written = spark.read.parquet(f"{out}/{name}").orderBy("rank").collect()
        assert [r["rank"] for r in written] == list(range(1, len(written) + 1))
        assert [tuple(r[k] for k in keys) for r in written] == [tuple(r[k] for k in keys) for r in df.collect()]
    reports = {}
    for r in spark.read.parquet(out + "/reports").collect():
        reports.setdefault(r["report"], set()).add(r["severity"])
    assert reports["DSD Priorities"] == {None}  # of the reports, those of customers are coloured
    assert any(v != {None} for v in reports.values())
