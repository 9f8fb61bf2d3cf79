"""G6, all or nothing: a day's outputs are published together.

Every run writes its outputs into a folder of its own.  When all are there, one small
file for the day is renamed into place; it names the run.  Readers look the run up, so
they see the old day whole until that rename and the new one whole after it, and a run
that fails leaves the day as it was.

Layout: ``runs/<run>/<output>/as_of=<day>/...`` and ``days/<day>``.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.headers import ExportSchemaError
from . import catalog


def _file_context(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)


def _write_over(spark: SparkSession, path: str, text: str) -> None:
    """The file becomes ``text`` in one step: written beside it, then renamed over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    jvm, src, context = _file_context(spark, beside)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(src, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(src, jvm.org.apache.hadoop.fs.Path(path), how)


def _read(spark: SparkSession, path: str) -> str | None:
    jvm, at, _ = _file_context(spark, path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(result, path: str, fmt: str = "parquet") -> str:
    """Write every output of ``result`` and make them the day's; the run's name."""
    spark, base = result.orders.sparkSession, path.rstrip("/")
    run = uuid.uuid4().hex
    catalog.write_all(result, f"{base}/runs/{run}", fmt)
    _write_over(spark, f"{base}/days/{result.as_of.isoformat()}", f"{run} {fmt}")
    return run


def published(spark: SparkSession, path: str, output: str, as_of: dt.date) -> DataFrame:
    """An output of the run that is the day's now."""
    base = path.rstrip("/")
    named = _read(spark, f"{base}/days/{as_of.isoformat()}")
    if named is None:
        raise ExportSchemaError(f"Nothing is published for {as_of}.")
    run, fmt = named.split()
    return spark.read.format(fmt).load(f"{base}/runs/{run}/{output}")
