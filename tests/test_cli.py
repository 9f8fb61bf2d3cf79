from dockline.__main__ import main


def test_cli_processes_a_csv_export(spark, tmp_path):
    src = tmp_path / "export.csv"
    src.write_text("Plant,Facility Code,Picking in %,Planned Dlv. Date,Route Depart. Date,"
                   "LE Delivery,Ship-to Name,Goods Issue,Sales Order Total\n"
                   "Calgary Warehouse,Warehouse,0,2026-07-10,2026-07-20,801,AMAZON A,Not Started,100\n"
                   "Calgary Warehouse,Warehouse,0,2026-07-10,2026-07-20,801.0,AMAZON A,Not Started,100\n"
                   "Surrey Warehouse,DSD,50,07/30/2026,2026-07-29,,GFS B,Not Started,TBD\n")
    out = tmp_path / "out"
    meta = main(["--input", str(src), "--as-of", "2026-07-17", "--out", str(out),
                 "--now", "2026-07-17T09:30"], spark=spark)
    assert meta["row_count"] == 1 and meta["duplicates_removed"] == 1
    assert meta["validation_records"] == 1 and len(meta["warnings"]) == 1
    tracker = spark.read.parquet(str(out / "issue_tracker"))
    assert [(r["site"], r["issue_type"]) for r in tracker.collect()] == [("Calgary", "Late Delivery")]
