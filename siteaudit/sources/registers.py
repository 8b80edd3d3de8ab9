"""Tables that are kept up by changes, whatever the order and however often these come.

A row holds a register for each field: the value with the time and number of the change that set it. Registers are merged by
their greatest (or least) version, logs by union: merging is associative, commutative and idempotent, so late, repeated and
replayed changes leave the same table. Rows lie in buckets by key, a folder each; a merge reads and writes the buckets of its changes and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

#: Kinds of fields: the latest value counts, the first one, or all of them.
LAST, FIRST, LOG = "last", "first", "log"


def put(value: Column) -> Column:
    """A field of a change that is set, if only to null; a null field isn't set."""
    return F.struct(value.alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Registers:
    """A table at ``path`` with ``key`` columns and ``fields``, name -> kind and type, in ``buckets`` folders. Choose as many that one fits a task: their number stays."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], fields: dict[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path, key, fields, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key. Partial results are merged before a shuffle; rows come by bucket, so that a bucket is written by one task."""
        how = {LAST: F.max, FIRST: F.min, LOG: lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))}
        return rows.groupBy("bucket", *self.key).agg(*[how[kind](f).alias(f) for f, (kind, _) in self.fields.items()])

    def states(self, changes: DataFrame) -> DataFrame:
        """``changes(key, at, seq, fields made by put)`` as rows of the table. Fields that a change lacks aren't set; changes without a key or a time are left out."""

        def state(f: str, kind: str, type_: str) -> Column:
            made = f"struct<at:timestamp,seq:bigint,value:{type_}>"
            if f not in changes.columns:
                return F.lit(None).cast(f"array<{made}>" if kind == LOG else made).alias(f)
            value = F.struct("at", F.col("seq").cast("long").alias("seq"), F.col(f)["value"].cast(type_).alias("value"))
            return F.when(F.col(f).isNotNull(), F.array(value) if kind == LOG else value).alias(f)

        known = changes.dropna(subset=[*self.key, "at"])
        return self._merged(known.select(self._bucket().alias("bucket"), *self.key, *[state(f, *k) for f, k in self.fields.items()]))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets: the folders of others aren't listed as inputs. None before the first merge."""
        if not exists(self.spark, self.path):
            return None
        rows = self.spark.read.parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def merge(self, changes: DataFrame) -> list[int]:
        """Apply changes; returns the buckets that were written. A merge that was cut off is mended by doing it again."""
        new = staged(self.states(changes), "changes")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # numbers up to ``buckets``
        if not touched:
            return []
        old = self.read(touched)
        rows = new if old is None else self._merged(old.select(*new.columns).unionByName(new.select(*new.columns)).repartition("bucket"))
        out = rows.repartition("bucket") if old is None else rows
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched
