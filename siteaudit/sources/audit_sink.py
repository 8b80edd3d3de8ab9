"""A sink for audits: partitions by day, each id once, safe to run again.

A batch writes folders of its own, ``data/day=D/batch=B`` for its rows and ``ids/part=K/batch=B`` for their ids, and replaces nothing else: a
batch that is run again replaces just these. An id that another batch has already is left out (that audit stays as it was). To find
it, only the ids of the parts that the batch's ids fall in are read, never rows of audits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registers import exists
from .staging import staged

#: Parts of the ids. Their number stays with a table.
PARTS = 256


def append_batch(rows: DataFrame, path: str, batch: int, parts: int = PARTS, period: str = "day") -> None:
    """Append ``rows(id, created_at, ...)`` as batch number ``batch``; of rows with one id the earliest by created_at counts, null ids are left out, a null created_at falls on no day. ``period``: week or month where days hold few audits; ``day`` is its first.

    Ids are written after rows: a batch that was cut off in between is mended by running it again, before any other.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    first = rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("created_at", F.to_json(F.struct(*rows.columns)))).alias("r")).select("r.*", part.alias("part"))
    new = staged(first, "audit-batch")
    touched = sorted(r.part for r in new.select("part").distinct().collect())  # numbers up to ``parts``
    if exists(spark, f"{path}/ids"):
        known = spark.read.parquet(f"{path}/ids").where(F.col("part").isin(touched) & (F.col("batch") != batch)).select("id")
        new = staged(new.join(known, "id", "left_anti"), "audit-new")
    put = lambda df, to, *by: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(f"{path}/{to}")
    put(new.select(*rows.columns, F.to_date(F.date_trunc(period, "created_at")).alias("day")).repartition("day"), "data", "day")
    put(new.select("id", "part").repartition("part"), "ids", "part")


def append_stream(rows: DataFrame, path: str, marks: str):
    """A stream of audits into the sink; a batch's number is the stream's, so one that is run again after a loss replaces its own folders. Returns the writer."""
    return rows.writeStream.option("checkpointLocation", marks).foreachBatch(lambda df, number: append_batch(df, path, number))


def read_audits(spark: SparkSession, path: str) -> DataFrame:
    """All audits; a filter on ``day`` prunes folders."""
    return spark.read.parquet(f"{path}/data").drop("batch")
