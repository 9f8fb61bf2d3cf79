"""One delivery / one tracker group holding a third of all rows."""
from pyspark.sql import functions as F

from dockline import load_rules, process_export
from dockline.operators.clean import dedup_orders, typed_export
from helpers import AS_OF, day, order, raw_export

N = 3000
HOT = "hot-one"


def _skewed(spark):
    late = dict(ship_to_name="AMZ everywhere", planned_dlv_date=day(-6))
    return raw_export(spark, [order(i, **late) if i % 3 else order(i, **late, le_delivery=HOT, picking_in_pct=str(i % 101))
                              for i in range(N)])


def test_hot_delivery_is_reduced_map_side_and_kept_whole(spark):
    raw = _skewed(spark).repartition(8)
    orders = dedup_orders(typed_export(raw))
    got = {r["le_delivery"]: r for r in orders.collect()}
    assert len(got) == 1 + (N - N // 3)
    hot = got[HOT]
    assert hot["picking_in_pct"] == 100.0 and hot["source_rows"] == N // 3
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_hot_tracker_group(spark):
    res = process_export(_skewed(spark).repartition(8), AS_OF, load_rules())
    t = res.issue_tracker().collect()
    assert len(t) == 1 and t[0]["order_count"] == 1 + (N - N // 3)
    assert "Affected LE Deliveries" not in t[0]["issue"]  # large group: no id list
    assert res.all_plants_summary().filter(F.col("site") == "All Plants").first()["late_orders"] \
        == 1 + (N - N // 3)


def test_ids_of_groups_up_to_the_limit_beside_a_hot_one(spark):
    """Groups of one to seven orders over many tasks: ids are listed whole up to five."""
    late = dict(planned_dlv_date=day(-6))
    names = {"amazon": 1, "sysco": 2, "pratt": 4, "gfs": 5, "sobeys": 6, "a&w": 7}
    rows = [order(100 * k + i, ship_to_name=f"{name} yard", **late)
            for k, (name, n) in enumerate(names.items()) for i in range(n)]
    rows += [order(2000 + i, ship_to_name="walmart", **late) for i in range(1500)]
    res = process_export(raw_export(spark, rows).repartition(16), AS_OF, load_rules())
    counts, listed = {}, {}
    for r in res.issue_tracker().collect():
        counts[r["customer"]] = r["order_count"]
        listed[r["customer"]] = r["issue"].split("Affected LE Deliveries")[1:]
    assert sorted(counts.values()) == [1, 2, 4, 5, 6, 7, 1500]
    for customer, n in counts.items():
        ids = [x for x in " ".join(listed[customer]).replace(":", " ").replace(",", " ").replace(".", " ").split() if x.isdigit()]
        assert ids == sorted(ids) and len(ids) == (n if n <= 5 else 0)
