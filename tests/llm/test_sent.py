"""What goes to a Python worker at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import minhash
from siteaudit.llm.common import SENT, sent

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(SIZE, None)
    spark.conf.unset(SIZE)
    yield spark.conf
    spark.conf.unset(SIZE)
    if before is not None:
        spark.conf.set(SIZE, before)


def texts(spark):
    """64 MB in one partition: rows of 64 KB, and one of 8 MB."""
    return spark.range(0, 896, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w x "), F.when(F.col("id") == 5, 2 << 20).otherwise(16 << 10).cast("int")).alias("text"))


def test_texts_are_sent_in_small_batches(spark, unset, monkeypatch):
    """Before, all of it came as one batch of 64 MB."""

    def sizes(size, n_bands):
        def run(batches):
            for b in batches:
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes]), none, none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print1", "print2", "sig", "bands"])

        return run

    monkeypatch.setattr(minhash, "_sign", sizes)
    found = minhash.signatures(texts(spark), 5, 24).select("doc_id", "n_shingles").collect()
    assert sum(rows for rows, _ in found) == 896
    assert all(size < 2 * SENT for rows, size in found if size < 8 << 20) and sum(size >= 8 << 20 for _, size in found) == 1


def test_a_size_that_is_set_stays(spark, unset):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    unset.set(SIZE, "32m")
    assert sum(r.n for r in sent(texts(spark), run, "n long").collect()) == 896
    assert unset.get(SIZE) == "32m"
