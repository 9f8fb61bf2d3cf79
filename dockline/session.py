"""Session settings for tests, the bench and local runs.

On a cluster, pass your own session; the library reads ``spark.checkpoint.dir``
from it and only sets a scratch checkpoint folder when none is configured.
"""
from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dockline") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("DOCKLINE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_for_wide_projections(spark)
    ensure_checkpoint_dir(spark)
    return spark


TASKS_A_CORE = 4


def wide_settings(spark: SparkSession) -> dict[str, str]:
    """Settings under which the wide projections are planned and run."""
    tasks = str(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.codegen.hugeMethodLimit": "8000",
            "spark.sql.files.minPartitionNum": tasks, "spark.sql.adaptive.coalescePartitions.minPartitionNum": tasks}


def tune_for_wide_projections(spark: SparkSession) -> None:
    """The cleaning / enrichment plan is a few projections of many large CASE /
    regex expressions.  Catalyst's constraint propagation re-derives constraints
    through every alias of those expressions and its cost explodes on such plans
    (planning took minutes).  Spark documents this knob for exactly this case;
    nothing in these plans relies on inferred constraints (no joins on derived
    columns), so the pipeline turns it off for its session.

    A generated method of more than 8,000 bytes is never compiled by the JVM but
    interpreted for every row; Spark's limit, beyond which it generates several smaller
    methods, is far above that unless it is set.

    A narrow shuffled row or a stored one becomes a wide row that is costly to work out,
    so stages are cut into several tasks a core: with about one, a few cores that get two
    make the others wait."""
    for key, value in wide_settings(spark).items():
        spark.conf.set(key, value)


@contextmanager
def wide_projections(spark: SparkSession):
    """``tune_for_wide_projections`` while plans are made; the session's own
    settings come back afterwards."""
    was = {key: spark.conf.get(key, None) for key in wide_settings(spark)}
    tune_for_wide_projections(spark)
    try:
        yield
    finally:
        for key, value in was.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured ``spark.checkpoint.dir``; set a scratch one only if unset
    in a local session.  On a cluster executors couldn't reach it: an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="dockline-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()
