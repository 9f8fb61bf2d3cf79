"""The rule-table join against the CASE form and against every pattern in turn."""
import random

import pytest
from pyspark.sql import functions as F

from dockline import process_export
from dockline.config import Rules
from dockline.operators import classify as C
from dockline.operators.classify import classify
from dockline.operators.rule_table import grams
from dockline.plans.queries import account_rules
from helpers import AS_OF, NOW, RULES, order, raw_export

PAIRS = "i int, ship_to_name string, carrier_description string, ys string"
ATTRIBUTES = ["customer_group", "customer_display", "customer_owner", "customer_priority", "customer_consequence",
              "deadline_flag", "customer_report", "site"]


def keyed(spark, pairs):
    return spark.createDataFrame([(i, s, c, "x") for i, (s, c) in enumerate(pairs)], PAIRS)


def rows_of(df):
    return [tuple(r) for r in df.select("i", *ATTRIBUTES).orderBy("i").collect()]


@pytest.fixture
def always_by_table(monkeypatch):
    monkeypatch.setattr(C, "MAX_CASE_PATTERNS", 0)


def test_same_as_the_case_form_on_the_default_rules(spark, monkeypatch):
    rng = random.Random(7)
    texts = [p.text for p in RULES.patterns] + ["", None, "nan", "wm", "PRAT", "A&", "  "]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(150)]
    pairs += [(f"{rng.choice(['x ', ''])}{rng.choice(texts)}{rng.choice(['', ' y', 'z'])}", "Own") for _ in range(150)]
    by_case = rows_of(classify(keyed(spark, pairs), RULES))
    monkeypatch.setattr(C, "MAX_CASE_PATTERNS", 0)
    assert rows_of(classify(keyed(spark, pairs), RULES)) == by_case
    assert len({r[1] for r in by_case}) > 10


def test_short_patterns_ties_and_many_rules(spark, always_by_table):
    rng = random.Random(3)
    letters = "AB1é"
    customers = [{"key": f"g{k}", "priority": k, "match": {
        rng.choice(["ship_to_contains", "ship_to_startswith", "carrier_contains"]):
            ["".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(2)]}} for k in range(60)]
    rules = Rules({"customers": customers})
    pairs = [("".join(rng.choices(letters, k=rng.randrange(7))), "".join(rng.choices(letters, k=rng.randrange(7))))
             for _ in range(200)]

    def group(ship, carrier):
        for p in sorted(rules.patterns):
            key = (ship if p.column == "ship_to" else carrier).upper()
            if p.text in key if p.test == "contains" else key.startswith(p.text):
                return p.group
        return "other"
    got = classify(keyed(spark, pairs), rules).orderBy("i").collect()
    assert [r.customer_group for r in got] == [group(*p) for p in pairs]


def test_no_rules_no_orders(spark, always_by_table):
    none = Rules({"customers": []})
    assert [r[1] for r in rows_of(classify(keyed(spark, [("a", "b"), (None, None)]), none))] == ["other"] * 2
    assert classify(keyed(spark, []), RULES).count() == 0


def test_grams(spark):
    row = spark.createDataFrame([("ABABC",)], "t string").select(
        grams(F.col("t"), 2).alias("two"), grams(F.col("t"), 5).alias("five"), grams(F.col("t"), 6).alias("six")).first()
    assert (row.two, row.five, row.six) == (["AB", "BA", "BC"], ["ABABC"], [])


def test_plan_has_no_cross_join_and_a_hot_pair_is_one_key(spark):
    hot = spark.range(30_000).selectExpr("CAST(id AS INT) AS i", "IF(id % 3 > 0, 'WMX Customer#000000005', concat('n', id)) "
                                         "AS ship_to_name", "IF(id % 7 = 0, '', 'own') AS carrier_description", "'x' AS ys")
    df = classify(hot, account_rules(10_000))
    groups = {r["customer_group"]: r["count"] for r in df.groupBy("customer_group").count().collect()}
    assert groups["account_00005"] == 20_000  # the prefix rule, of a lower rank than a fragment's
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_whole_pipeline_by_table(spark, always_by_table):
    raw = raw_export(spark, [order(1, ship_to_name="AMZ 4"), order(2, ship_to_name="x pratt"), order(3)])
    res = process_export(raw, AS_OF, RULES, now=NOW, materialize="persist")
    assert [r.customer_group for r in res.orders.orderBy("le_delivery").collect()] == ["amazon", "pratts", "other"]
    res.release()
