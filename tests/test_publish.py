import datetime as dt

import pytest

from dockline.sinks import catalog
from dockline.sinks.publish import publish, published
from dockline.sources.headers import ExportSchemaError
from helpers import AS_OF, order, processed


def numbers(spark, path, output="orders"):
    return sorted(r["le_delivery"] for r in published(spark, path, output, AS_OF).collect())


def test_a_run_that_fails_leaves_the_day_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(ExportSchemaError, match="Nothing is published"):
        published(spark, out, "orders", AS_OF)
    publish(processed(spark, [order(1), order(2)]), out)
    reader = published(spark, out, "orders", AS_OF)  # opened before the next run
    newer = processed(spark, [order(3)])
    write, done = catalog.write_output, []

    def failing(df, path, *args, **kw):
        if len(done) == 4:
            raise OSError("disk full")
        done.append(path)
        write(df, path, *args, **kw)
    monkeypatch.setattr(catalog, "write_output", failing)
    with pytest.raises(OSError):
        publish(newer, out)
    assert len(done) == 4 and numbers(spark, out) == numbers(spark, out, "not_started") == ["90001", "90002"]
    monkeypatch.undo()
    publish(newer, out)
    assert numbers(spark, out) == numbers(spark, out, "not_started") == ["90003"]
    assert reader.count() == 2  # what it opened is still there
    with pytest.raises(ExportSchemaError):
        published(spark, out, "orders", AS_OF + dt.timedelta(days=1))
    assert [p.name for p in (tmp_path / "out" / "days").iterdir() if not p.name.startswith(".")] == [AS_OF.isoformat()]
