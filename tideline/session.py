"""Session factory for local work; on a cluster the session comes from spark-submit and none of this is needed."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import SparkSession

#: Settings the operators rely on. Adaptive execution re-plans joins and partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "tideline", **more: str) -> SparkSession:
    """A session on this machine with as many shuffle partitions as threads."""
    n = cpus or os.cpu_count() or 8
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | more
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one beside the warehouse where all runs on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return known.rstrip("/") if known else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans whose rows have been written and that nothing refers to."""
    gc.collect()
    spark.range(1).count()  # the last plan that ran is referred to until another one has run
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.java.lang.System.gc()
