import pytest

from dockline.sources.export import from_rows, pick_export, read_export
from dockline.sources.headers import (ALIASES, COLUMNS, DISPLAY, REQUIRED, ExportSchemaError, HeaderMap, header_audit,
                                      normalize_header)

HEADERS = "Plant,Facility Code,Picking in %,Planned Dlv. Date,Route Depart. Date,LE Delivery,Ship-to Name,Goods Issue," \
          "Sales Order Total"


def line(number, **kw):
    cells = dict(plant="Laval DC", code="DSD", pct="5", planned="2031-04-01", route="2031-03-30", id=f"70{number}",
                 name="Deli", gi="Open", total="12") | kw
    return ",".join(cells.values())


def test_headers_are_compared_by_their_words():
    assert normalize_header(" -Sales\r\nOrder\t Total:; ") == "sales order total"
    assert normalize_header(None) == normalize_header(" .-_ ") == ""
    for d in DISPLAY:
        assert list(HeaderMap([f"\n {d.upper()} : "]).at) == [d]
    for alias, d in ALIASES.items():
        assert d in HeaderMap([alias.title()]).at


def test_names_beat_aliases_and_left_beats_right():
    assert HeaderMap(["werks", "Plant", "YS", "ys "]).at == {"ys": 2}
    assert HeaderMap(["site", "warehouse"]).at == {"ys": 0}
    assert HeaderMap(["Picking %", "x", "picking in"]).at == {"Picking in %": 0}
    both = HeaderMap(["Goods Issue", "?", "LE Delivery"])
    assert both.score == 2 and len(both.missing) == len(REQUIRED) - 2
    with pytest.raises(ExportSchemaError, match="Ship-to Name.*Recognized columns: Goods Issue, LE Delivery"):
        both.require()


def test_absent_columns_are_blank(spark):
    row = from_rows(spark, [*REQUIRED, "junk"], [[*"abcdefgh", "z"]]).first()
    assert [row[c] for c in COLUMNS if row[c] is not None] == ["a", "b", "d", "c", "e", "f", "g", "h"]


def test_audit_table(spark):
    df = spark.createDataFrame([("GOODS\nISSUE",), ("Werks",), ("zzz",), (None,)], "header string")
    got = {r["header"]: (r["canonical"], r["via_alias"]) for r in header_audit(df).collect()}
    assert got == {"GOODS\nISSUE": ("Goods Issue", False), "Werks": ("ys", True), "zzz": (None, None), None: (None, None)}


def test_all_files_are_read_each_by_its_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADERS}\n{line(1)}\n{line(2)}\n")
    turned = HEADERS.split(",")[::-1]
    (tmp_path / "b.csv").write_text(",".join(turned) + "\n" + ",".join(line(3).split(",")[::-1]) + "\n")
    (tmp_path / "c.csv").write_text(f"{HEADERS}\n{line(4)}\n")
    for paths in (str(tmp_path), str(tmp_path / "*.csv"), [str(tmp_path / f"{n}.csv") for n in "abc"]):
        got = sorted((r["le_delivery"], r["ys"], r["sales_order_total"]) for r in read_export(spark, paths).collect())
        assert got == [(f"70{k}", "Laval DC", "12") for k in (1, 2, 3, 4)]
    (tmp_path / "d.csv").write_text("Cases,Goods Issue\n1,Open\n")
    with pytest.raises(ExportSchemaError, match="d.csv"):
        read_export(spark, str(tmp_path))
    with pytest.raises(ExportSchemaError):
        read_export(spark, str(tmp_path / "nothing*"))


def test_header_rows_come_from_one_job_for_any_number_of_files(spark, tmp_path):
    from dockline.sources.export import header_rows, list_files, read_header
    turned = ",".join(HEADERS.split(",")[::-1])
    broken = HEADERS.replace("Goods Issue", '"Goods\nIssue"')
    for k in range(12):
        head = (HEADERS, turned, "\n\n" + broken, "\ufeff" + HEADERS)[k % 4]
        (tmp_path / f"part {k:02d}%.csv").write_text(f"{head}\n" + f"{line(k)}\n" * (3 if k else 30_000), encoding="utf-8")
    files = list_files(spark, [str(tmp_path)])
    jobs = []
    for some in (files[:2], files):
        spark.sparkContext.setJobGroup(f"headers {len(some)}", "x")
        got = header_rows(spark, some, ",", "UTF-8")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {len(some)}")))
        assert got == {f: read_header(spark, f, ",", "UTF-8") for f in some} and list(got) == some
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == [1, 1] and spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 50)
    assert read_export(spark, str(tmp_path)).count() == 30_000 + 11 * 3
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "wide.csv").write_text(f"{HEADERS}\n{line(5)}\n", encoding="utf-16")
    assert header_rows(spark, [f"file:{tmp_path}/w/wide.csv"], ",", "UTF-16") == {
        f"file:{tmp_path}/w/wide.csv": HEADERS.split(",")}


def test_line_ends_of_headers_are_not_those_of_records(spark, tmp_path):
    for name, inner, outer in (("a", "\r\n", "\n"), ("b", "\n", "\r\n"), ("c", "\r\n", "\r\n")):
        head = HEADERS.replace("Goods Issue", f'"Goods{inner}Issue"')
        text = outer.join([head, *(line(k) for k in range(40)), line(99, total="N/A")]) + outer
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        got = read_export(spark, str(tmp_path / f"{name}.csv")).collect()
        assert len(got) == 41 and {r["goods_issue"] for r in got} == {"Open"}
        assert {r["sales_order_total"] for r in got} == {"12", None}


def test_quotes_commas_and_line_breaks_in_cells_and_headers(spark, tmp_path):
    head = HEADERS.replace("Goods Issue", '"Goods\nIssue"')
    rows = [line(1, name='"JO ""THE"" BAKER, LTD"'), line(2, name='"two\nlines"'), line(3, total="N/A")]
    (tmp_path / "x.csv").write_text("﻿" + head + "\n" + "\n".join(rows) + "\n", encoding="utf-8")
    got = {r["le_delivery"]: r for r in read_export(spark, str(tmp_path / "x.csv")).collect()}
    assert sorted(got) == ["701", "702", "703"]
    assert got["701"]["ship_to_name"] == 'JO "THE" BAKER, LTD' and got["701"]["sales_order_total"] == "12"
    assert got["702"]["ship_to_name"] == "two\nlines" and got["702"]["goods_issue"] == "Open"
    assert got["703"]["sales_order_total"] is None  # a token for a missing value


def test_other_separators_doubled_headers_and_compressed_files(spark, tmp_path):
    import gzip
    text = f"{HEADERS},LE Delivery,Description\n{line(1)},999,wrong\n".replace(",", ";")
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(text.encode()))
    row = read_export(spark, str(tmp_path), sep=";").first()
    assert (row["le_delivery"], row["ys"]) == ("701", "Laval DC")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    with pytest.raises(ExportSchemaError, match="empty"):
        read_export(spark, str(tmp_path / "e"))


def test_typed_parquet_cells_as_text(spark, tmp_path):
    names = ", ".join(f"`{h}` {'double' if h in ('LE Delivery', 'Sales Order Total', 'Picking in %') else 'string'}"
                      for h in HEADERS.split(","))
    rows = [("L", "DSD", 0.75, "2031-04-01", "x", 80117458123.0, "n", "Open", 1234567.25),
            ("L", "DSD", 1e-7, "2031-04-01", "x", 7.0, "n", "Open", 3e9), ("L", "DSD", None, "x", "x", 8.0, "n", "o", None)]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "p"))
    got = {r["le_delivery"]: (r["picking_in_pct"], r["sales_order_total"])
           for r in read_export(spark, str(tmp_path / "p"), fmt="parquet").collect()}
    assert got == {"80117458123": ("0.75", "1234567.25"), "7": ("0.0000001", "3000000000"), "8": (None, None)}


def test_best_of_several_candidates(spark, tmp_path):
    (tmp_path / "notes.csv").write_text("Plant,Cases\nx,1\n")
    (tmp_path / "data.csv").write_text(f"{HEADERS}\n{line(1)}\n")
    df = pick_export(spark, [str(tmp_path / "notes.csv"), str(tmp_path / "data.csv")])
    assert [r["le_delivery"] for r in df.collect()] == ["701"]


def test_one_export_at_a_time_and_not_without_rows(spark):
    from dockline import process_export
    from helpers import AS_OF, COLS, order, raw_export
    two = raw_export(spark, [order(1)], export_id="a").unionByName(raw_export(spark, [order(1)], export_id="b"))
    with pytest.raises(ExportSchemaError, match="more than one export"):
        process_export(two, AS_OF, materialize="persist")
    with pytest.raises(ExportSchemaError, match="no data rows"):
        process_export(raw_export(spark, [{c: " " for c in COLS}]), AS_OF, materialize="persist")


def test_session_settings_come_back_and_the_clock_is_the_plants(spark):
    import datetime as dt
    from dockline import process_export
    from helpers import AS_OF, order, raw_export
    key = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        res = process_export(raw_export(spark, [order(1)]), AS_OF, materialize="persist")
        assert spark.conf.get(key) == "true" and res.orders.count() == 1
        off = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - res.now
        assert dt.timedelta(hours=5.9) < off < dt.timedelta(hours=7.1)
    finally:
        spark.conf.set(key, was)
