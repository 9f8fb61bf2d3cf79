from pyspark.sql import functions as F

from dockline.operators.rank import ranked


def test_ranks_over_many_ranges_a_hot_value_and_ties(spark):
    rows = spark.range(5000).selectExpr("id", "struct(IF(id % 3 = 0, 7, id % 100) AS k0, IF(id % 10 = 0, null, -id) AS k1) "
                                        "AS place").repartition(13)
    want = [r[0] for r in rows.orderBy("place").select("id").collect()]
    got = ranked(rows)
    assert got.columns == ["id", "rank"]
    got = sorted((r["rank"], r["id"]) for r in got.collect())
    assert [k for k, _ in got] == list(range(1, 5001))
    place = {r["id"]: r["place"] for r in rows.collect()}
    key = [tuple((x is not None, x or 0) for x in place[i]) for _, i in got]
    assert key == sorted(key) and sorted(want) == sorted(i for _, i in got)  # tied rows in any order


def test_no_rows_and_one_row(spark):
    rows = spark.createDataFrame([("x", 4)], "name string, place int")
    assert [tuple(r) for r in ranked(rows).collect()] == [("x", 1)]
    assert ranked(rows.limit(0)).count() == 0


def test_no_window_gathers_all_rows(spark):
    rows = spark.range(100).withColumn("place", -F.col("id"))
    plan = ranked(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
