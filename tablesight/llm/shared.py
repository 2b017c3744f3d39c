"""Helpers shared by the operators of this subpackage: intermediate tables in
the shared checkpoint folder, Arrow batches as NumPy text blocks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Words of the contracts: runs of anything but space, tab, \n, \v, \f and \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate Parquet tables of one operator call.

    They live in the folder that ``spark.checkpoint.dir`` names, which the
    driver and all executors share, so a lost executor costs a re-read and not
    the table. Only where that setting is absent (local tests) a temporary
    folder is registered for the session."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.conf.get("spark.master", "")
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="llm-scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back: cuts the lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete intermediate tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go at the end of the query that wrote them, not
    when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process, for
    objects that are costly to build (tokenizers) and reused by its tasks."""
    import pyspark
    return pyspark.__dict__.setdefault("_llm_worker_cache", {})


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most ``rows`` rows, so that the Python
    objects made of a batch of long texts stay few."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def byte_slices(batches, column=0, limit: int = 8 << 20, rows: int = 1000):
    """Arrow batches in parts of at most ``limit`` bytes of the given string
    column (its place, or a function of the batch) and ``rows`` rows (one row at least), so that what a part is turned
    into is bounded by its bytes, whatever the lengths of its texts."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(column(batch) if callable(column) else batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, "right"))
            b = max(a + 1, min(b, a + rows))
            yield batch.slice(a, b - a)
            a = b


def column_bytes(column) -> list[bytes]:
    """Arrow string column as UTF-8 byte strings; null becomes empty."""
    import pyarrow as pa
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
