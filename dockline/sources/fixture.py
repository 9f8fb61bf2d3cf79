"""Raw delivery export derived from the TPC-H-style test tables.

One raw export row per ``lineitem`` row, so a delivery (an order) has several
rows and de-duplication matters.  Every cell is text, shaped to exercise the
cleaning rules (blank cells, spacing, serial / ISO / US dates, bad numbers,
``.0`` identifiers, classification patterns).  The same derivation is written
independently in SQL for the DuckDB oracle (``plans/oracle.py``).

Scale notes: the orders-level attributes (customer, region) are joined to
``orders`` first (4x fewer rows than ``lineitem``), the region lookup is a
size-checked broadcast, and only the columns used are read from Parquet.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if, cut_lineage, spread, table_has_at_most
from .headers import COLUMNS, DISPLAY_OF

# The as-of date of the derived export (day serial 35810).
FIXTURE_AS_OF = "1998-01-15"
FIXTURE_EXPORT_ID = "fixture"
# Dimension rows that may be broadcast (~80 bytes each -> at most ~40 MB).
MAX_BROADCAST_ROWS = 500_000


def _s(c: Column) -> Column:
    return c.cast("string")


def _lpad2(c: Column) -> Column:
    return F.lpad(_s(c), 2, "0")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_export(spark: SparkSession, sf_dir: str, materialize_large: bool = True) -> DataFrame:
    """The raw (all-text) export: 35 canonical columns + ``ordinal`` + ``export_id``."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # The fact side (lineitem) is always streamed; each dimension is broadcast
    # only after a bounded row count proves it small, else it is a sort-merge
    # join on the key (AQE splits skewed keys).  Without explicit sides the
    # planner, misled by compressed file sizes, may broadcast the fact table.
    # Bounds come from the base tables' row counts (cheap for Parquet scans).
    # A joined dimension has at most one row per row of its base table because
    # it is joined on the other table's primary key (region, nation, customer).
    geo_small = table_has_at_most(nation, 10_000) and table_has_at_most(region, 10_000)
    cust_small = geo_small and table_has_at_most(cust, MAX_BROADCAST_ROWS)
    orders_small = table_has_at_most(orders, MAX_BROADCAST_ROWS)
    geo = nation.join(broadcast_if(region, geo_small),
                      nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    cust_geo = cust.join(broadcast_if(geo, geo_small), cust.c_nationkey == geo.n_nationkey)
    od = spread(orders).join(broadcast_if(cust_geo, cust_small),
                             orders.o_custkey == cust_geo.c_custkey)
    rows = li.join(broadcast_if(od, orders_small), li.l_orderkey == od.o_orderkey)

    ok, ck, ln = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_linenumber")
    off = ok % 29 - 12
    serial = F.lit(35810)
    null = F.lit(None).cast("string")

    raw = {
        "ys": F.when(ck % 97 == 0, null)
               .when(ck % 11 == 0, "Mississauga  warehouse").when(ck % 11 == 1, "CALGARY WAREHOUSE")
               .when(ck % 11 == 2, " Surrey Warehouse ")
               .when(ck % 2 == 0, F.concat(F.col("r_name"), F.lit(" WAREHOUSE")))
               .otherwise(F.concat(F.lit(" "), F.col("r_name"), F.lit("  Warehouse"))),
        "facility_code": F.when(ok % 5 == 0, "DSD").when(ok % 5 == 1, "Independant")
                          .when(ok % 5 == 2, " independent ").otherwise("Warehouse"),
        "picking_in_pct": F.when(ok % 211 == 0, "n/k").when(ok % 199 == 0, "150")
                           .when(ok % 3 == 0, "0").when((ok + ln) % 5 == 0, "70.5")
                           .when(((ok + ln) % 5 == 1) & (ok % 2 == 0), "100").otherwise("25"),
        "planned_dlv_date": F.when(ok % 53 == 0, null)
            .when(ln % 3 == 0, F.concat(_s(serial + off), F.lit(".5")))
            .when(ln % 3 == 1, F.concat(F.lit("1998-01-"), _lpad2(off + 15), F.lit(" 23:00:00")))
            .otherwise(F.concat(F.lit("01/"), _lpad2(off + 15), F.lit("/1998"))),
        "route_depart_date": F.when((ok + ln) % 31 == 0, "not a date")
                              .when(ok % 37 == 0, "19980120").when(ok % 43 == 0, "1998")
                              .when(ok % 47 == 0, "20-Jan-1998").when(ok % 59 == 0, "Jan 20, 1998 11:00 PM")
                              .when(ok % 61 == 0, "1/20/98 8:30").when(ok % 67 == 0, "20.01.1998")
                              .otherwise(_s(serial + ck % 23 - 6)),
        "customer_dock_appointment_date": F.when(ok % 4 == 0, null)
                                           .otherwise(_s(serial + (ok + ck) % 17 - 4)),
        "customer_dock_appointment_time": F.when(ok % 6 == 0, "  ").otherwise(F.concat(F.lit("08:"), _lpad2(ok % 60))),
        "warehouse_task_creat": F.when(ln % 4 == 0, null).otherwise(_s(F.col("l_shipdate"))),
        "le_delivery": F.when(ok % 301 == 0, "   ")
                        .when(ln % 2 == 0, F.concat(_s(ok + 80000000), F.lit(".0")))
                        .otherwise(F.concat(F.lit(" "), _s(ok + 80000000))),
        "ship_to_name": F.when(ck % 101 == 0, "").otherwise(F.concat(
            F.when(ck % 13 == 0, "Save-On ").when(ck % 13 == 1, "ASSOCIATED  GROCERS ")
             .when(ck % 13 == 2, "Calgary Co-op ").when(ck % 13 == 3, "Pratt's Wholesale ")
             .when(ck % 13 == 4, "FCL ").when(ck % 13 == 5, "Canada  Safeway ").when(ck % 13 == 6, "LOBLAW ")
             .when(ck % 13 == 7, "Italian Centre ").when(ck % 13 == 8, "DELUCA BROS FOODS ").when(ck % 13 == 9, "GFS ")
             .when(F.col("c_mktsegment") == "AUTOMOBILE", "Amazon  ")
             .when(F.col("c_mktsegment") == "BUILDING", "sysco ")
             .when(F.col("c_mktsegment") == "FURNITURE", "A&W GFS ")
             .when(F.col("c_mktsegment") == "MACHINERY", "WM ")
             .otherwise("WMX "),
            F.col("c_name"))),
        "carrier_description": F.when(ok % 41 == 0, "Loblaws  Pick up")
                                .otherwise(F.concat(F.lit("CARRIER "), _s(ck % 7))),
        "goods_issue": F.when((F.col("o_orderstatus") == "F") & (ok % 2 == 0), "COMPLETED")
                        .when(F.col("o_orderstatus") == "F", " Completed ")
                        .otherwise("Not Started"),
        "sales_order_total": F.when(ok % 307 == 0, "TBD")
                              .otherwise(_s(F.col("o_totalprice").cast("decimal(18,2)"))),
        "cases": _s(F.col("l_quantity")),
        "line_items": _s(ln),
    }
    # some rows are blank altogether
    blank = (ok + ln) % 499 == 0
    cols = [F.when(blank, " " if c in raw else null).otherwise(raw.get(c, null)).alias(c) for c in COLUMNS]
    ordinal = F.struct(ok.alias("k1"), ln.alias("k2"), F.col("l_partkey").alias("k3"),
                       F.col("l_suppkey").alias("k4"), F.col("l_extendedprice").alias("k5"))
    export = rows.select(*cols, ordinal.alias("ordinal"),
                         F.lit(FIXTURE_EXPORT_ID).alias("export_id"))
    if not (orders_small and cust_small) and materialize_large:
        # The derivation shuffles (sort-merge joins).  Readers that take the
        # export several times (percent statistics, then rows) shuffle once and
        # scan the stored text; those that store typed rows read it only once.
        export = cut_lineage(export, "auto")
    return export


#: Headers as an untidy export may have them, by column: line breaks, spacing,
#: punctuation, case, aliases.
MESSY = {"ys": "Description", "facility_code": " FACILITY\n Code:", "picking_in_pct": "picking %",
         "planned_dlv_date": "Planned Delivery Date", "route_depart_date": "ROUTE  DEPARTURE DATE.",
         "customer_dock_appointment_date": "Customer Dock Appointment", "warehouse_task_creat": "Warehouse Task Creation",
         "customer_dock_appointment_time": "customer dock appointment\r\ntime", "le_delivery": "LE Delivery",
         "ship_to_name": "-ship-to name", "carrier_description": "Carrier\tDescription", "goods_issue": "goods issue;",
         "sales_order_total": "Sales Order Total ", "cases": "CASES", "line_items": "Line Items,"}


def messy_export(export: DataFrame) -> DataFrame:
    """The export under ``MESSY`` headers, in another order, with columns that mean
    nothing or come second to another, and without the optional ones."""
    wrong = F.lit("wrong")
    columns = [F.col(c).alias(h) for c, h in reversed(MESSY.items())]
    return export.select(F.lit("x").alias("Notes"), *columns, wrong.alias("le delivery "), wrong.alias("Plant"),
                         wrong.alias("Picking in"), "ordinal", "export_id")


def write_csv_files(export: DataFrame, folder: str) -> list[str]:
    """The export as CSV files under three header rows, a third of the deliveries
    each; the folders of the files."""
    shown = [F.col(c).alias(DISPLAY_OF[c]) for c in COLUMNS]
    shouted = [F.col(c).alias(f" {DISPLAY_OF[c].upper()}: ") for c in sorted(MESSY)]
    kinds = [lambda part: part.select(*shown), lambda part: messy_export(part).drop("ordinal", "export_id"),
             lambda part: part.select(*shouted)]
    folders = []
    for k, kind in enumerate(kinds):
        folders.append(f"{folder.rstrip('/')}/{k}")
        part = kind(export.where(F.pmod(F.xxhash64("ordinal.k1"), F.lit(len(kinds))) == k))
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(folders[-1])
    return folders
