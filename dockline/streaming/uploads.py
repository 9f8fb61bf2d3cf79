"""Daily uploads as a Structured Streaming source.

The stream carries the names of new uploads; each upload is then read by the
batch reader (``sources.export``), so headers, quoting and missing-value tokens
are those of a batch run.  Every upload regenerates its day from scratch: outputs
go to ``as_of=<day>`` folders that are overwritten as a whole.  Of several uploads
of one day in a micro-batch the one modified last wins.  There is deliberately no
streaming state: "late" in this domain is a business flag, not late data.

The checkpoint location must be on shared storage (e.g. under the cluster's
``spark.checkpoint.dir``) so a restarted query resumes after executor or driver
loss without reprocessing committed batches.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules, load_rules
from ..plans.pipeline import process_export
from ..sinks.catalog import write_all
from ..sources.export import read_export

FILES = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of new files under ``folder``; contents are not read."""
    return (spark.readStream.format("binaryFile").schema(FILES).load(folder)
            .select("path", F.col("modificationTime").alias("modified")))


def process_batch(out_dir: str, as_of_for: Callable[[str], dt.date], rules: Rules | None = None,
                  now: dt.datetime | None = None, **read_options):
    """``foreachBatch`` handler: run the pipeline per upload, overwrite its day."""
    rules = rules or load_rules()

    def handle(files: DataFrame, batch_id: int) -> None:
        newest: dict[dt.date, str] = {}
        for path, _ in sorted(files.collect(), key=lambda f: (f["modified"], f["path"])):  # names of new files
            newest[as_of_for(path.rsplit("/", 1)[-1])] = path
        for as_of, path in sorted(newest.items()):
            raw = read_export(files.sparkSession, path, export_id=as_of.isoformat(), **read_options)
            res = process_export(raw, as_of, rules, now=now, require_rows=False)
            write_all(res, out_dir)
            res.release()

    return handle


def start(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, as_of_for: Callable[[str], dt.date],
          available_now: bool = False, **options):
    """Start the upload query; ``available_now`` processes what is there and stops."""
    writer = (upload_stream(spark, folder).writeStream
              .foreachBatch(process_batch(out_dir, as_of_for, **options))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
