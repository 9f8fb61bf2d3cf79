import datetime as dt
import warnings

import pandas as pd
from pyspark.sql import functions as F

from dockline.functions.dates import parse_date
from dockline.functions.text import clean_identifier, to_number
from dockline.operators.clean import (VALIDATION_ISSUES, dedup_orders, typed_export, validation_errors)
from helpers import COLS, day, order, raw_export, records


def column(spark, expression, cells):
    df = spark.createDataFrame(list(enumerate(cells)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


def test_identifiers_lose_a_spreadsheet_fraction_only(spark):
    cells = {"4411.0": "4411", " 4411.00 ": "4411", "+7.0": "7", "-0.0": "0", "4411.5": "4411.5", "X9.0": "X9.0",
             "000510": "000510", "NaT": "", "none": "", "  ": "", None: "",
             "98765432109876543210.0": "98765432109876543210"}
    assert column(spark, clean_identifier, cells) == list(cells.values())


def test_numbers_are_plain_decimals(spark):
    cells = {"\t7.25 ": 7.25, "6.": 6.0, "-.5e1": -5.0, "12,5": None, "9f": None, "1 2": None, "∞": None, "": None}
    assert column(spark, to_number, cells) == list(cells.values())


LAYOUTS = ["2031-03-09", "2031-3-9 4:05", "2031-03-09T04:05:06.5", "2031/3/9 04:05", "2031.03.09", "03/09/2031", "3/9/31",
           "21/3/2031", "03-21-2031 04:05:06", "21.03.2031", "9-Mar-2031", "9 March 2031 16:05", "Mar 9, 2031 4:05 PM",
           "Sept 9 2031", "March 9 2031", "03/09/2031 12:30 AM", "3/9/2031 04:05:06.250", "3/9/31 4:05:06 pm"]
NO_DATES = ["21/21/2031", "2031-02-30", "Marc 9, 2031", "03/09/2031 25:00", "03/09/2031 14:00 PM", "soon", "-"]


def test_text_dates_read_as_pandas_reads_them_in_any_zone(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [None if pd.isna(t) else t.to_pydatetime() for c in LAYOUTS + NO_DATES
                for t in pd.to_datetime(pd.Series([c]), errors="coerce", format="mixed")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in (zone, "America/Edmonton"):  # 9 March 2031 02:30 doesn't exist there
            spark.conf.set("spark.sql.session.timeZone", other)
            assert column(spark, parse_date, LAYOUTS + NO_DATES) == want
            assert column(spark, parse_date, ["03/09/2031 02:30:00"]) == [dt.datetime(2031, 3, 9, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert all(want[:len(LAYOUTS)]) and not any(want[len(LAYOUTS):])


def test_numbers_as_dates(spark):
    cells = {"47916": dt.datetime(2031, 3, 9), "47916.25": dt.datetime(2031, 3, 9, 6), "20310309": dt.datetime(2031, 3, 9),
             "2031": dt.datetime(2031, 1, 1), "20311309": None, "8888888": None}
    assert column(spark, parse_date, cells) == list(cells.values())


def percents(spark, cells, **kw):
    t = typed_export(raw_export(spark, [order(i, picking_in_pct=c) for i, c in enumerate(cells)], **kw))
    return [r["picking_in_pct"] for r in records(t)]


def test_percents_are_clipped_and_scaled_by_the_whole_upload(spark):
    assert percents(spark, ["12.5", "-3", "240", "x", None]) == [12.5, 0.0, 100.0, 0.0, 0.0]
    assert percents(spark, [".25", "-.5", "x", "0"]) == [25.0, 0.0, 0.0, 0.0]
    assert percents(spark, [".25", "1.01"]) == [0.25, 1.01]  # one value above 1: they are percents
    assert percents(spark, ["0", "0"]) == [0.0, 0.0]


def test_issues_by_row(spark):
    t = typed_export(raw_export(spark, [
        order(1, le_delivery=" ", ship_to_name=None, sales_order_total="?"), order(2, ship_to_name="\t"),
        order(3, sales_order_total="12 CAD"), order(4, ship_to_name="", sales_order_total="n.a."),
        order(5, sales_order_total=" "), {c: " \t" for c in COLS}]))
    assert t.count() == 5  # the blank row is gone
    found = sorted((r["issue_rank"], r["le_delivery"]) for r in validation_errors(t).collect())
    assert found == [(0, ""), (1, "90002"), (1, "90004"), (2, "90003"), (2, "90004")]
    assert {r["validation_issue"] for r in validation_errors(t).collect()} == set(VALIDATION_ISSUES)
    assert {r["sales_order_total"] for r in records(t) if r["le_delivery"] in ("90003", "90005")} == {0.0}


def test_best_record_of_a_delivery(spark):
    one = dict(le_delivery="55")
    steps = [  # each beats all before it
        order(1, **one, ship_to_name="plain"),
        order(2, **one, ship_to_name="picked", picking_in_pct="60"),
        order(3, **one, ship_to_name="complete", customer_dock_appointment_date=day(3)),
        order(4, **one, ship_to_name="complete and picked", customer_dock_appointment_date=day(3), picking_in_pct="1"),
        order(5, **one, ship_to_name="created", customer_dock_appointment_date=day(3), warehouse_task_creat=day(-9)),
        order(6, **one, ship_to_name="created later", customer_dock_appointment_date=day(3), warehouse_task_creat=day(-2)),
    ]
    for n in range(1, len(steps) + 1):
        kept = dedup_orders(typed_export(raw_export(spark, steps[:n] + [steps[n - 1] | {"le_delivery": "55.0"}])))
        assert [(r["ship_to_name"], r["source_rows"]) for r in kept.collect()] == [(steps[n - 1]["ship_to_name"], n + 1)]
    # equal in everything: the first row of the input stays
    twins = [order(1, **one, ship_to_name="first"), order(2, **one, ship_to_name="second")]
    assert [r["ship_to_name"] for r in dedup_orders(typed_export(raw_export(spark, twins))).collect()] == ["first"]
