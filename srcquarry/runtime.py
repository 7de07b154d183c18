"""Session helpers shared by all operators: shared work folders, lineage cuts, partition spreading."""

from __future__ import annotations

import copy
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Where scratch data goes when the session names no shared folder (local tests only).
_FALLBACK: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else a local one (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="srcquarry-"))
    return _FALLBACK[0]


class Scratch:
    """A folder of written tables below the shared root, removed when the JVM ends or by ``drop()``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/srcquarry-{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def within(self, spark: SparkSession) -> Scratch:
        """The same folder, read by another session."""
        other = copy.copy(self)
        other.spark = spark
        return other

    def write(self, df: DataFrame, part: str) -> DataFrame:
        """Write ``df`` as Parquet below this folder and return it as read again (lineage cut, size known)."""
        df.write.mode("overwrite").parquet(f"{self.path}/{part}")
        return self.read(part, df.schema)

    def write_counted(self, df: DataFrame, part: str) -> tuple[DataFrame, int]:
        """``write`` that also returns the number of rows, observed while they are written."""
        out, seen = self.write_observed(df, part, n=F.count(F.lit(1)))
        return out, seen["n"]

    def write_observed(self, df: DataFrame, part: str, **metrics) -> tuple[DataFrame, dict]:
        """``write`` that also returns aggregates, observed while the rows are written."""
        seen = Observation()
        df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.mode("overwrite").parquet(f"{self.path}/{part}")
        return self.read(part, df.schema), seen.get

    def read(self, part: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.path}/{part}")

    def drop(self, *parts: str) -> None:
        """Remove tables that nothing reads any more."""
        for part in parts:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}"), True)


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when a scan has fewer splits than the cluster has cores (a few small files).

    Large inputs have many splits and keep them, so CPU-heavy row operators add no shuffle at scale.
    """
    want = slots(df.sparkSession)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
