"""Session helpers: a tuned SparkSession for tests and benchmarks, and the
shared checkpoint folder that lineage-cutting operators write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tablesight", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster the master and memory come from spark-submit; only pass
    ``master`` for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when nothing is configured and all
    work is done by one local process (tests), a fresh scratch folder is
    created and registered, once per session; elsewhere this raises, as
    executors would write to folders of their own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:  # classic sessions: the context may carry a directory set in code
        d = d or spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no SparkContext
        pass
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tablesight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablesight/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later plans that use it several times start from the
    files instead of recomputing the lineage, and the files survive the loss
    of executors (unlike a local checkpoint)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (from file sizes and operator
    statistics); no job runs."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate unavailable: assume large
        return 1 << 62


def reuse(df: DataFrame, name: str, recompute_below: int = 256 << 20) -> DataFrame:
    """A plan read several times downstream: small inputs are simply
    recomputed; larger ones are written once with ``materialize``."""
    return df if estimated_bytes(df) < recompute_below else materialize(df, name)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """A result bounded by construction (one row per column, per class...)
    turned into a local table, so plans that use it twice do not recompute
    its lineage. Refuses results larger than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
