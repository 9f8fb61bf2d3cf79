"""Orders are typed after the de-dup, and errors without storing typed rows; both give
what the typed rows give."""
import datetime as dt

import pytest
from helpers import AS_OF, NOW, RULES, day, order, raw_export
from pyspark.sql import functions as F

from dockline.operators import clean
from dockline.operators.clean import dedup_orders, typed_export, validation_errors
from dockline.plans import pipeline


@pytest.fixture
def raw(spark):
    cells = [order(1), order(1, picking_in_pct="0.4", cases=" 7 "), order(1, planned_dlv_date="soon"),
             order(2, le_delivery=" 90002.0 ", ship_to_name=" GFS ", sales_order_total="TBD"), order(2, sales_order="12.0"),
             order(3, le_delivery="nan"), order(4, le_delivery=None, sales_order_total="x"), order(5, ship_to_name=None),
             order(6, warehouse_task_creat=day(-1), cases="many"), order(6, warehouse_task_creat=day(-2)), dict.fromkeys(order(0), " ")]
    one = raw_export(spark, cells)
    two = raw_export(spark, cells + [order(7, picking_in_pct="80")]).withColumn("export_id", F.lit("two"))
    return one.unionByName(two)


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_orders_and_errors_are_those_of_the_typed_rows(spark, raw):
    typed = typed_export(raw).persist()
    orders, errors = clean.unique_orders(raw), clean.errors_of(raw)
    assert orders.columns == dedup_orders(typed).columns and errors.columns == validation_errors(typed).columns
    assert rows(orders) == rows(dedup_orders(typed)) and orders.count() == 9
    assert rows(errors) == rows(validation_errors(typed)) and errors.count() == 8


def test_only_what_the_dedup_looks_at_is_typed_before_it(spark, raw):
    def below(df):
        return df._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    late, early = (below(f(raw)) for f in (clean.unique_orders, lambda r: dedup_orders(typed_export(r))))
    assert "cases#" in late
    for typed in ("RLIKE(cases#", "RLIKE(line_items#"):
        assert typed in early and typed not in late


def test_many_exports_store_no_typed_rows(spark, raw, monkeypatch):
    stored = []
    monkeypatch.setattr(pipeline, "cut_lineage", lambda df, mode="auto": stored.append(df) or df.persist())
    many = pipeline.process_exports(raw, {"export": AS_OF, "two": AS_OF + dt.timedelta(days=1)}, RULES, NOW)
    assert len(stored) == 2 and rows(many.typed) == rows(typed_export(raw))
    many.release()
