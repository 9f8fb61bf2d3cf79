"""Every registered query against its DuckDB SQL on the sf0.001 tables."""
import pytest

import __spark_entry__ as E
from dockline.plans import queries
from dockline.plans.oracle import oracle_queries
from oracle_check import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_oracle_sql():
    assert set(queries.QUERIES) == set(oracle_queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module", autouse=True)
def stored_orders():
    """The fixture's enriched orders are made once for all queries of a folder."""
    made, make, patch = {}, queries.fixture_orders, pytest.MonkeyPatch()

    def once(spark, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = make(spark, sf_dir)
        return made[sf_dir]
    patch.setattr(queries, "fixture_orders", once)
    yield
    patch.undo()


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=True)
    assert res[name] is True


def test_results_do_not_depend_on_session_time_zone(spark):
    tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Edmonton")
    try:
        res = compare(spark, SF, ["typed_export", "issue_tracker"], verbose=True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)
    assert all(v is True for v in res.values())
