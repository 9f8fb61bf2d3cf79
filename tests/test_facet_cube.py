"""Every dashboard figure from the cube and from the orders."""
import pytest
from pyspark.sql import functions as F

from dockline.operators import facet_cube as cubes
from dockline.operators import facets
from helpers import day, order, processed

ORDERS = [
    order(1, ship_to_name="AMZ", planned_dlv_date=day(-4), sales_order_total="70.10"),
    order(2, ship_to_name="Sysco", ys="Calgary Warehouse", picking_in_pct="30", planned_dlv_date=day(2), sales_order_total="0.2"),
    order(3, ship_to_name="GFS", ys="Winnipeg DC", planned_dlv_date="", sales_order_total="30", ship_to_province=" AB "),
    order(4, ship_to_name="Sysco", goods_issue="Completed", planned_dlv_date=day(-1)),
    order(5, ship_to_name="DELUCA BROS FOODS", facility_code="DSD", planned_dlv_date=day(1), sales_order_total="n/a"),
    *(order(k, ship_to_name="AMZ", planned_dlv_date=day(-4), sales_order_total="0.1") for k in range(10, 40)),
]
SELECTIONS = [{}, {"site": ["Surrey"]}, {"customer": ["Amazon", "Sysco"], "priority": ["Critical"]},
              {"status": ["At Risk"]}, {"facility": ["DSD"], "province": []}, {"site": ["Nowhere"]}]
FIGURES = ["exec_kpis", "risk_value_by_customer", "not_started_by_customer", "status_distribution",
           "risk_value_by_planned_day", "not_started_kpis"]


@pytest.fixture(scope="module")
def orders(spark):
    return processed(spark, ORDERS).orders


@pytest.fixture(scope="module")
def cube(orders):
    return cubes.facet_cube(orders).cache()


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", FIGURES)
def test_figures_equal_those_of_the_orders(orders, cube, name):
    for chosen in SELECTIONS:
        want = getattr(facets, name)(facets.facet_filter(orders, **chosen))
        got = getattr(cubes, name)(facets.facet_filter(cube, **chosen))
        assert got.columns == want.columns and rows(got) == rows(want), chosen
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_options_and_size(orders, cube):
    assert rows(facets.filter_options(cube)) == rows(facets.filter_options(orders))
    assert cube.count() < orders.count() == cube.agg(F.sum("orders")).first()[0]


def test_cubes_add_up(orders, cube):
    parts = [cubes.facet_cube(orders.where(F.crc32("le_delivery") % 3 == k)) for k in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert both.count() > cube.count() and rows(cubes.merged(both)) == rows(cube)
    assert cubes.merged(both).schema.simpleString() == cube.schema.simpleString()


def test_no_orders(orders):
    cube = cubes.facet_cube(orders.limit(0))
    assert cube.count() == 0 and tuple(cubes.exec_kpis(cube).first()) == (0, 0, 0, 0, 0.0, 0.0)
