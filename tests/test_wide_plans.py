"""Costly keys are worked out once a row, and no method is too large to be compiled."""
import pytest
from helpers import AS_OF, RULES, order, raw_export
from pyspark.sql import functions as F

from dockline.functions.text import WHITESPACE, once, ustrip
from dockline.operators import reports
from dockline.operators.classify import classify
from dockline.functions.dates import parse_date
from dockline.operators.clean import dedup_orders, typed_export, typed_for_orders
from dockline.operators.enrich import enrich
from dockline.plans import queries
from dockline.plans.pipeline import process_export
from dockline.session import tune_for_wide_projections, wide_projections, wide_settings


def keys_in_plan(df, below):
    """How often the ship-to key is worked out in ``df``, and in the stored ``below``."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 2000)
    return [x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(ship_to_name") for x in (df, below)]


@pytest.fixture
def unique(spark):
    rows = [order(k, ship_to_name=n) for k, n in enumerate(["Save-On  Foods", "GFS", None, "DELUCA BROS"])]
    return dedup_orders(typed_export(raw_export(spark, rows))).persist()


def test_the_ship_to_key_is_not_repeated_for_every_pattern(spark, unique):
    tune_for_wide_projections(spark)
    orders = enrich(classify(unique, RULES), AS_OF, RULES)
    times, stored_times = keys_in_plan(orders, unique)
    assert 1 <= times - stored_times <= 2
    stored = orders.persist()
    for report in (reports.dsd_priorities(stored, RULES, ordered=False), reports.detail_reports_long(stored, RULES, AS_OF)):
        times, stored_times = keys_in_plan(report, stored)
        assert 1 <= times - stored_times <= 2


def test_methods_stay_small_enough_to_be_compiled(spark, unique):
    settings = wide_settings(spark)
    assert int(settings["spark.sql.codegen.hugeMethodLimit"]) <= 8000
    was = {k: spark.conf.get(k, None) for k in settings}
    with wide_projections(spark):
        assert {k: spark.conf.get(k) for k in settings} == settings
    assert {k: spark.conf.get(k, None) for k in settings} == was


def test_strip_of_odd_ends(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\u00a0x\u3000", "\u00e9", "\u00e9 ", "\x1cq\x1f", "x\u2028", "!~", "\x7f", "z\x85", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(ustrip(F.col("t"))).collect()]
    assert got == [None if t is None else t.strip(WHITESPACE) for t in texts]
    assert [r[0] for r in rows.select(once(F.col("t"), lambda x: F.concat(x, x))).collect()] == [t and t + t if t else t for t in texts]


def test_rows_without_any_text_are_dropped(spark):
    blank = {c: "\u00a0 " for c in order(0)}
    rows = [order(1), blank, blank | {"cases": "2"}, dict.fromkeys(blank)]
    res = process_export(raw_export(spark, rows), AS_OF, RULES, materialize="persist")
    assert res.typed.count() == 2


def test_orders_are_made_without_storing_the_typed_rows(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(queries, "cut_lineage", lambda df: stored.append(df) or df.persist())
    orders = queries.fixture_orders(spark, "/root/testdata/sf0.001")
    assert orders.count() > 0 and len(stored) == 1


@pytest.mark.parametrize("percents", [["0.5", "1", None, "x"], ["0.5", "1.5", "-3", "250"], ["0", " ", None, "-0.2"]])
def test_typed_rows_are_the_same_stored_or_not(spark, percents):
    cells = [order(k % 3, picking_in_pct=p, cases=str(k)) for k, p in enumerate(percents)]
    blank = dict.fromkeys(order(0), " ")
    raw = raw_export(spark, [*cells, blank, order(9, le_delivery=" ", picking_in_pct="0.25"), order(9, le_delivery=None)])
    both = [typed_export(raw, lambda rows: rows.persist()), typed_for_orders(raw)]
    assert both[0].columns == both[1].columns
    for make in (lambda t: t, dedup_orders):
        first, second = (sorted(str(r) for r in make(t).collect()) for t in both)
        assert first == second and len(first) == (6 if make is not dedup_orders else 3)


def test_percents_of_exports_with_and_without_fractions(spark):
    def export(name, *percents):
        rows = [order(k, picking_in_pct=p) for k, p in enumerate(percents)]
        return raw_export(spark, rows).withColumn("export_id", F.lit(name))
    raw = export("a", "0.5", "1").unionByName(export("b", "0.5", "100")).unionByName(export("c", None, "0"))
    got = {(r["export_id"], r["le_delivery"]): r["picking_in_pct"] for r in dedup_orders(typed_for_orders(raw)).collect()}
    assert [got[k] for k in sorted(got)] == [50.0, 100.0, 0.5, 100.0, 0.0, 0.0]


def test_plain_dates_are_read_without_a_lambda(spark):
    texts = {"01/02/1998": "1998-01-02", "1-2-1998": "1998-01-02", "13.05.1998": "1998-05-13", "02/29/1999": None,
             "02/30/1998": None, "29/02/2000": "2000-02-29", "13/13/1998": None, "00/05/1998": None, "5/0/1998": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] and str(r["d"])[:10] for r in rows.select("t", parse_date(F.col("t")).alias("d")).collect()}
    assert got == texts
    from dockline.functions import dates
    assert dates._PLAIN in rows.select(parse_date(F.col("t")))._jdf.queryExecution().analyzed().toString()
