"""Tables that change in place: rows in parts by a hash of their key.

A change reads and rewrites the parts that it touches, by Spark's dynamic
partition overwrite; all other files stay as they are. The new parts are
written aside first, so a part is never read while it is replaced, and a change
that is repeated, after a failure say, gives the same table. Rows with null keys
are a part's own like all others. One change at a time: there is no isolation
from other writers, and no log.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.operators import relational as R
from scholion.runtime import checkpointed, discard

PART = "_part"


class StoredTable:
    """A table of `schema` under `path`, in `parts` parts by `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, parts: int = 16) -> None:
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, parts: int = 16) -> StoredTable:
        """A new table with these rows."""
        out = cls(rows.sparkSession, path, key, rows.schema, parts)
        out._placed(rows).repartition(PART).write.mode("errorifexists").partitionBy(PART).parquet(out.path)
        return out

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias(PART))

    def _files(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().select(*self.schema.names)

    def _rewrite(self, touched: DataFrame, change) -> None:
        """Replace the parts named by the rows of `touched` by what `change` makes of their rows."""
        parts = sorted(r[0] for r in touched.select(PART).distinct().collect())  # `self.parts` numbers at most
        if not parts:
            return
        new = checkpointed(self._placed(change(self._files().where(F.col(PART).isin(parts)).select(*self.schema.names))))
        left = {r[0] for r in new.select(PART).distinct().collect()}
        new.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        context = self.spark.sparkContext
        for part in set(parts) - left:  # a part without rows is not among those written
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        discard(new)

    def insert_ignore(self, rows: DataFrame, order: str) -> None:
        """Add the rows whose key the table does not have; of several with one key, the first by `order`."""
        fresh = checkpointed(self._placed(rows).join(self._files().select(self.key), self.key, "left_anti").select(*self.schema.names, PART))
        self._rewrite(fresh, lambda old: R.insert_ignore(old, fresh.select(*self.schema.names), self.key, order))
        discard(fresh)

    def update(self, values: Mapping[str, Column], where: Column) -> None:
        """Set columns, but the key, in the rows that meet the condition."""
        if self.key in values:
            raise ValueError("the key places a row and cannot be changed: delete and insert it")
        self._rewrite(self._files().where(where), lambda old: R.update(old, dict(values), where))

    def delete(self, where: Column) -> None:
        """Remove the rows that meet the condition."""
        self._rewrite(self._files().where(where), lambda old: R.delete(old, where))
