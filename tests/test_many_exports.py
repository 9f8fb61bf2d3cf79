"""Several exports in one run, against a run of each by itself."""
import datetime as dt

import pytest

from dockline import process_export
from dockline.plans.pipeline import process_exports
from dockline.sources.headers import ExportSchemaError
from helpers import AS_OF, NOW, RULES, day, order, raw_export

DAYS = {"a": AS_OF, "b": AS_OF + dt.timedelta(days=20), "c": AS_OF}


def three(spark):
    """One delivery number in all of them; ``c`` has fractions for percents."""
    a = raw_export(spark, [order(1), order(1, picking_in_pct="40"), order(2, planned_dlv_date=day(-3)),
                           order(3, le_delivery=" ")], export_id="a")
    b = raw_export(spark, [order(1, ship_to_name="AMZ"), order(4, picking_in_pct="1")], export_id="b")
    c = raw_export(spark, [order(1, picking_in_pct="0.25"), order(5, picking_in_pct="1"), order(6, picking_in_pct="0")],
                   export_id="c")
    return {"a": a, "b": b, "c": c}


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_each_export_as_if_alone(spark):
    parts = three(spark)
    whole = parts["a"].unionByName(parts["b"]).unionByName(parts["c"])
    many = process_exports(whole, DAYS, RULES, NOW, materialize="persist")
    summary = {k: [] for k in DAYS}
    for r in many.all_plants_summary().collect():
        summary[r["export_id"]].append(tuple(r)[1:])
    for k, raw in parts.items():
        alone, mine = process_export(raw, DAYS[k], RULES, now=NOW, materialize="persist"), many.of(k)
        assert rows(mine.orders.select(alone.orders.columns)) == rows(alone.orders)
        assert rows(mine.validation_errors) == rows(alone.validation_errors)
        assert rows(mine.issue_tracker()) == rows(alone.issue_tracker())
        assert rows(mine.run_summary()) == rows(alone.run_summary())
        assert summary[k] == [tuple(r) for r in alone.all_plants_summary().collect()]
    tracker = many.issue_tracker(ordered=False)
    assert {r["export_id"] for r in tracker.collect()} == {"a", "b"}  # c has nothing late
    picked = {(r["export_id"], r["le_delivery"]): r["picking_in_pct"] for r in many.orders.collect()}
    assert picked["c", "90001"] == 25.0 and picked["c", "90005"] == 100.0 and picked["b", "90004"] == 100.0
    assert picked["a", "90001"] == 40.0
    many.release()


def test_exports_and_days_must_belong_together(spark):
    raw = three(spark)["a"]
    with pytest.raises(ExportSchemaError, match="without a day: a; exports without rows: x"):
        process_exports(raw, {"x": AS_OF}, RULES, NOW, materialize="persist")
