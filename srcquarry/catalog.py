"""A catalog of the relations as Parquet snapshots, partitioned where deletes and filters are by one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcquarry.schemas import DDL, schema

PARTITIONS = {"chunks": ["repo_id"]}


class Catalog:
    """Named relations below one folder; a relation that was never written reads as empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p, aside = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet{end}") for end in ("", ".old"))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p) and fs.exists(aside):
            fs.rename(aside, p)  # a replacement that did not come to its end
        return fs.exists(p)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DDL:
            return self.table(name)
        raise AttributeError(name)

    def init(self) -> None:
        """Write every relation that is missing, empty."""
        for name in DDL:
            if not self._exists(name):
                self.write(name, self.spark.createDataFrame([], schema(name)))

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Replace or append a relation. A table is never read and overwritten in one plan: the rows go to a new
        folder first, which then takes the place of the old one."""
        target = f"{self.path}/{name}.parquet"
        df = df.select(*schema(name).names)
        parts = PARTITIONS.get(name, [])
        if mode == "append" or not self._exists(name):
            df.write.mode(mode if mode == "append" else "overwrite").partitionBy(*parts).parquet(target)
            return
        fresh = f"{target}.new"
        df.write.mode("overwrite").partitionBy(*parts).parquet(fresh)
        jvm = self.spark.sparkContext._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(fresh)
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        aside = jvm.org.apache.hadoop.fs.Path(f"{target}.old")
        fs.delete(aside, True)
        fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)

    def replace_repo(self, name: str, df: DataFrame) -> None:
        """Replace only the partitions that the rows touch."""
        df.select(*schema(name).names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{self.path}/{name}.parquet")
