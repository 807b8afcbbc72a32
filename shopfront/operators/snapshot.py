"""A table kept in folders by a hash of its key, so that a batch reads and rewrites only the folders its keys fall into.

Parquet has no upsert. Here a batch of changes names its folders, reads those, works out their new rows with any join or
aggregation over the key, and replaces just them by dynamic partition overwrite. Tables of one key and one number of folders are cut alike,
so a job that needs several of them reads the same folders of each.

New files are staged beside the table and moved into place folder by folder when all tasks are done; a lost executor
costs its tasks only. If the driver stops between two folders, the batch is run again: a change that gives the same rows when
applied twice, as upserts and first-writer inserts do, then leaves the table as if it had run once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, folders: int = 256):
        """schema: the columns in DDL. folders: fixed for the life of the table; choose it so that one folder fits a few tasks."""
        self.spark, self.path, self.key, self.schema, self.folders = spark, path, key, schema, folders
        # the number is part of the name, so that a table is never read as if it were cut another way
        self.column = f"{key}_of_{folders}"

    def folder(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.folders)).cast("int")

    def touched(self, changes: DataFrame, key: str | None = None) -> list[int]:
        """The folders that the keys of a batch fall into: at most as many numbers as there are folders."""
        return sorted(r[0] for r in changes.select(self.folder(key).alias("f")).distinct().collect())

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, folders: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders; the files of the others are not opened."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(f"{self.schema}, {self.column} int").parquet(self.path)
        if folders is not None:
            df = df.filter(F.col(self.column).isin(folders) if folders else F.lit(False))
        return df.drop(self.column)

    def replace(self, rows: DataFrame, files: int = 1) -> None:
        """Puts the rows in place of the folders they fall into. Each of those folders must be given whole; a folder without rows is left as it is.

        files: how many tasks write a folder.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        placed = rows.select(*columns).withColumn(self.column, self.folder())
        dealt = [F.col(self.column), *([F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(files))] if files > 1 else [])]
        placed.repartition(*dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(self.path)
