import datetime as dt
import os

from dockline.streaming.uploads import start

HEAD = "Site,Facility Code,Picking in %,Planned Dlv. Date,Route Depart. Date,LE Delivery,Ship-to Name,Goods Issue," \
       "Sales Order Total"


def upload(folder, name, lines, age, head=HEAD):
    path = folder / name
    path.write_text("\n".join([head, *lines]) + "\n")
    os.utime(path, (2_000_000_000 - age, 2_000_000_000 - age))


def test_each_day_is_replaced_by_its_newest_upload(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    old = "Laval DC,Warehouse,0,2031-03-01,2031-03-20,1,AMZ,Not Started,100"
    upload(inbox, "2031-03-12 b.csv", [old], age=900)
    upload(inbox, "2031-03-12 a.csv", [
        'Laval DC,Warehouse,N/A,2031-03-01,2031-03-20,1,"AMZ ""A"", LTD",Not Started,100',
        "Laval DC,Warehouse,0,2031-03-01,2031-03-20,1.0,AMZ,Not Started,100",
        'Surrey Warehouse,DSD,50,2031-04-30,2031-04-29,2,"GFS\nB",Not Started,50'], age=10)
    upload(inbox, "2031-03-13 x.csv", ["AMZ,Laval DC,Warehouse,100,2031-03-01,2031-03-20,1,Completed,100"], age=5,
           head="Ship-to Name," + HEAD.replace("Ship-to Name,", ""))
    q = start(spark, str(inbox), str(out), str(tmp_path / "ckpt"), available_now=True,
              as_of_for=lambda name: dt.date.fromisoformat(name.replace("%20", " ").split(" ")[0]))
    q.awaitTermination(300)
    got = {(str(r["as_of"]), r["site"]): r["total_orders"] for r in spark.read.parquet(str(out / "summary")).collect()}
    assert got == {("2031-03-12", "Laval"): 1, ("2031-03-12", "Surrey"): 1, ("2031-03-12", "All Plants"): 2,
                   ("2031-03-13", "Laval"): 1, ("2031-03-13", "All Plants"): 1}
    names = {r["ship_to_name"] for r in spark.read.parquet(str(out / "orders")).where("as_of = '2031-03-12'").collect()}
    assert names == {'AMZ "A", LTD', "GFS\nB"}
