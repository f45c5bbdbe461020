"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. They are defaults only: a cluster's own spark-defaults win where the
# builder finds an existing session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole texts into the scorer extension point: keep a batch to a few MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "corpuslens", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always read from the session; without it a clear error is
    raised. Only a single-process session (``local[...]``) without the setting gets a private folder, as in tests.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
        if d is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = d or tempfile.mkdtemp(prefix="corpuslens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_MATERIALIZED: list[str] = []


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing the plan) and gives later
    branches a columnar scan with pruning, unlike re-running an expensive upstream plan per branch.
    The paths are remembered so :func:`release_materialized` can delete them once results are consumed."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpuslens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _MATERIALIZED.append(path)
    return spark.read.parquet(path)


def materialized_count() -> int:
    """How many tables :func:`materialize` has written and not released: a mark for :func:`release_materialized`."""
    return len(_MATERIALIZED)


def release_materialized(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the intermediate tables written by :func:`materialize` (through the Hadoop file system of the
    checkpoint folder, so it works on shared storage). Call it after the results that read them are written.

    ``since`` and ``until`` are marks (:func:`materialized_count`): only the tables written between them go, so a job can free
    what one of its steps needed and leave the tables of other results alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for path in _MATERIALIZED[since:until]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        n += bool(fs.delete(p, True))
    del _MATERIALIZED[since:until]
    return n
