"""Session helpers shared by the operators: shipping the package, and written intermediate tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Let executors import this package, and keep Arrow batches small: texts can be long."""
    spark.conf.set(ARROW_ROWS, str(rows))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine, where that is unset, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


class Scratch:
    """Written tables of one run.  They cut the lineage, so that a lost executor costs only the step that runs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_BYTES = 64 << 20


def _width(kind: T.DataType) -> int:
    """Bytes of a value in a broadcast table, as a rule of thumb; 0 where the values vary in size."""
    return 0 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else 8


def join_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join long rows with narrow ones: these are broadcast if they take at most ``most`` bytes, else both are shuffled.

    A row takes its columns' bytes and 48 more for its place in the hash table;
    the bytes of columns of varying size are summed up in the same pass.  ``ids``
    is counted once: pass a written table, or one cheap to make.
    """
    loose = [f.name for f in ids.schema if not _width(f.dataType)]
    fixed = 48 + sum(_width(f.dataType) for f in ids.schema)
    n, extra = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string").cast("binary")), F.lit(0)) for c in loose), F.lit(0).cast("long"))), F.lit(0))).first()
    return rows.join(F.broadcast(ids) if n * fixed + extra <= most else ids, key, how)


def trim() -> None:
    """Give freed memory back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing is lost
        pass


def tidy(run):
    """A function over Arrow batches that trims its worker's memory when the task ends."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data as the other side does: sort and merge, never broadcast."""
    return df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
