"""Size-checked broadcast and lineage cutting.

* ``broadcast_if`` / ``broadcast_if_small`` broadcast a side only after its row
  count is proven under a bound (``table_has_at_most``: a base table's count,
  footers only for Parquet; ``has_at_most``: an early-stopping ``take`` for
  small derived frames); beyond the bound the join is left to the planner
  (sort-merge, AQE skew splitting).
* ``cut_lineage`` stores a DataFrame as a Parquet table in the shared folder
  named by ``spark.checkpoint.dir`` (or reliably checkpoints / persists it).
  It never uses ``localCheckpoint`` (executor-local, lost with the executor).
"""
from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Row-count bound for a small derived frame (early-stopping take)."""
    return len(df.select(F.lit(1).alias("x")).take(max_rows + 1)) <= max_rows


def table_has_at_most(table: DataFrame, max_rows: int) -> bool:
    """Row-count bound for a direct file scan: ``count()`` of a Parquet scan
    reads footers / row-group counts only, and is one row per task to combine,
    so the check stays cheap even for a huge table."""
    return table.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``F.broadcast(df)`` if ``df`` provably has at most ``max_rows`` rows."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the
    cluster can run at once (e.g. one small unsplittable file).  A no-op at
    scale, where scans already have many more partitions than cores.
    Round-robin after Spark's local sort is deterministic, so a lost task
    recomputes the same rows."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    try:
        current = df.rdd.getNumPartitions()  # planning only, no job
    except Exception:  # e.g. no RDD access on this session type
        return df
    return df.repartition(target) if current < target else df


def checkpoint_dir(spark) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = configured_checkpoint_dir(spark)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def configured_checkpoint_dir(spark) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))


def cut_lineage(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Materialize ``df`` once for the many outputs computed from it.

    ``auto``: ``table`` when the session names a ``spark.checkpoint.dir``
    (a cluster), else ``persist``.
    ``table``: write Parquet into ``spark.checkpoint.dir`` and read it back.
    Reports then scan a columnar table: only the columns they use are read,
    and filters on derived columns (risk_status, site, ...) are pushed into
    the scan.  Survives executor loss; nothing is recomputed.
    ``persist``: MEMORY_AND_DISK (lost blocks are recomputed from lineage).
    ``checkpoint``: reliable checkpoint in ``spark.checkpoint.dir`` (required);
    later jobs read the written table and survive executor loss without
    re-running the cleaning.
    ``none``: leave the plan as is.
    """
    if mode == "none":
        return df
    if mode == "auto":
        mode = "table" if configured_checkpoint_dir(df.sparkSession) else "persist"
    if mode == "table":
        base = checkpoint_dir(df.sparkSession)
        if base is None:
            raise RuntimeError("spark.checkpoint.dir is not set; cannot write a table")
        path = f"{base.rstrip('/')}/dockline-tables/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        return df.sparkSession.read.parquet(path)
    if mode == "checkpoint":
        if checkpoint_dir(df.sparkSession) is None:
            raise RuntimeError("spark.checkpoint.dir is not set; cannot checkpoint")
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(df: DataFrame) -> None:
    """Drop what ``cut_lineage`` kept: cached blocks, or the table's own folder."""
    df.unpersist()
    for file in df.inputFiles():
        at = file.find("/dockline-tables/")
        if at >= 0:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file[:file.index("/", at + len("/dockline-tables/"))])
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            return
