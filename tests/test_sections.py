import pytest
from pyspark.sql import functions as F

from dockline.operators import sections
from dockline.operators.classify import ordered_sites
from dockline.operators.rank import ranked
from helpers import AS_OF, NOW, RULES, day, order, processed

PLANTS = ["Surrey Warehouse", "Calgary Warehouse", "Winnipeg DC", "winnipeg dc", None]
NAMES = ["AMZ", "Sysco", "GFS", "DELUCA BROS FOODS", "PRATT'S WHOLESALE", "CORNER STORE LTD", "SAVE ON", "CALGARY CO-OP"]
ORDERS = [order(k, ys=PLANTS[k % 7 % 5], ship_to_name=NAMES[k % 8], planned_dlv_date=day(k % 9 - 5) if k % 11 else "",
                picking_in_pct=str(k % 3 * 50), sales_order_total=str(k % 4 * 10), facility_code="DSD" if k % 5 == 0 else "Warehouse",
                customer_dock_appointment_date=day(k % 6)) for k in range(120)]


@pytest.fixture(scope="module")
def result(spark):
    return processed(spark, ORDERS)


@pytest.fixture(scope="module")
def table(result):
    return sections.site_sections(result.orders, RULES, AS_OF, NOW).cache()


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_every_section_equals_the_filtered_output(result, table):
    from dockline.operators import reports
    for site in ("Calgary", "winnipeg"):
        here = F.col("site") == site
        whole = {"Issue Tracker": result.issue_tracker().where(here), "Not Started": result.not_started().where(here),
                 "Orders": reports.full_export(result.orders.where(here)),
                 "DSD Priorities": reports.dsd_priorities(result.orders.where(here), RULES),
                 "Andrew Tab": reports.late_warehouse(result.orders.where(here), AS_OF),
                 "Andrew Tab 2": reports.late_dsd_independent(result.orders.where(here), AS_OF)}
        whole |= {r.name: reports.customer_report(result.orders.where(here), r) for r in RULES.reports if not r.special}
        for report, want in whole.items():
            got = sections.section(table, site, report, RULES)
            assert got.columns == want.columns and tuples(got) == tuples(want), (site, report)


def test_ranks_follow_site_part_and_order(table):
    rows = table.orderBy("rank").select("rank", "site_seq", "part").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r[1], r[2]) for r in rows] == sorted((r[1], r[2]) for r in rows)


def test_a_mapping_by_site_in_section_order(result):
    found = result.site_sections()
    assert list(found) == [r["site"] for r in ordered_sites(result.orders, RULES).orderBy("site_seq").collect()]
    assert len(found) == 5 and found["Nowhere"]["orders"].count() == 0


def test_a_hundred_thousand_sites_one_of_them_hot(spark):
    """Numbered without one task that sees all rows, and without collecting sites."""
    many = spark.range(150_000).select(F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("S"), "id")).alias("site"), "id")
    sites = ordered_sites(many, RULES)
    assert sites.count() == 100_001 and sites.agg(F.max("site_seq")).first()[0] == 100_001
    rows = many.join(sites, "site").withColumn("_order", F.struct("site_seq", F.lit(2), "id"))
    numbered = ranked(rows, "_order")
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    wrong = numbered.alias("a").join(numbered.alias("b"), F.col("a.rank") + 1 == F.col("b.rank")).where(
        "struct(a.site_seq, a.id) >= struct(b.site_seq, b.id)")
    assert wrong.count() == 0 and numbered.agg(F.max("rank"), F.min("rank")).first()[:] == (150_000, 1)
    hot = numbered.where("site = 'Hot'").agg(F.min("rank"), F.max("rank"), F.count("*")).first()
    assert hot[1] - hot[0] + 1 == hot[2] == 50_000  # one range of the table
