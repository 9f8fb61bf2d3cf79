"""Process one export end to end and write every output.

    python -m dockline --input exports/2026-07-17/*.csv --as-of 2026-07-17 \\
        --out s3://bucket/delivery-risk [--format csv|parquet] [--rules rules.yaml]

or from a job that already has a session: ``main([...], spark)``.

Uses the active (cluster) session; outputs land under
``<out>/<output>/as_of=<day>/...`` and a re-run of the same day replaces it.
"""
from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from .config import load_rules
from .plans.pipeline import process_export
from .sinks.catalog import write_all
from .sources.export import read_export


def main(argv=None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="dockline", description=__doc__.splitlines()[0])
    p.add_argument("--input", nargs="+", required=True, help="files, folders or globs of one export; all are read")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--as-of", required=True, help="YYYY-MM-DD")
    p.add_argument("--out", required=True)
    p.add_argument("--rules", default=None, help="YAML or JSON rules (default: built-in)")
    p.add_argument("--sep", default=",")
    p.add_argument("--now", type=dt.datetime.fromisoformat, default=None,
                   help="run clock in the texts (default: current plant time)")
    p.add_argument("--single-line", action="store_true", help="no cell holds a line break (splits huge files)")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    as_of = dt.date.fromisoformat(a.as_of)
    raw = read_export(spark, a.input, fmt=a.format, export_id=a.as_of, sep=a.sep,
                      multiline=not a.single_line)
    res = process_export(raw, as_of, load_rules(a.rules), now=a.now)
    write_all(res, a.out, fmt="parquet")
    meta = {r["metric"]: r["value"] for r in res.run_summary().collect()}
    meta["warnings"] = res.warnings()
    print(json.dumps(meta))
    return meta


if __name__ == "__main__":
    main()
