"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import new_folder, staged, stages  # noqa: F401  staging is the library's, for all operators here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is frequent from this share of all rows on, so there are at most so many frequent keys.
FREQUENT_SHARE = 2000


def with_each(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``keyed`` has for each key, where no frequent key's rows meet in one task.

    ``keyed`` tells in ``many`` how many rows have the key. Those of keys with a share of ``total`` of
    at least ``1 / FREQUENT_SHARE`` are broadcast, ``2 * FREQUENT_SHARE`` at most as ``total`` may be half the rows; the others are joined by a shuffle.
    """
    least = max(1000, total // FREQUENT_SHARE)
    values = [c for c in keyed.columns if c not in (key, "many")]
    frequent = keyed.where(F.col("many") >= least).select(F.col(key).alias("_key"), F.lit(True).alias("_frequent"), *(F.col(c).alias(f"_{c}") for c in values))
    marked = rows.join(F.broadcast(frequent), F.col(key).eqNullSafe(F.col("_key")), "left")
    near = marked.where("_frequent").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in values))
    rest = marked.where("_frequent is null").select(*rows.columns).join(keyed.where(F.col("many") < least).select(key, *values), key)
    return near.unionByName(rest.select(*rows.columns, *values))


#: Rows of an Arrow batch on its way to Python; Spark's default of 10,000 whole texts takes hundreds of MB.
#: This is a setting of the session, the only one that the operators change; one that is smaller already stays.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with small batches to Python in its session unless the session asks for smaller ones."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have at most ``most`` bytes together, or are one row; so memory is bounded whatever batches Spark sends."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, upto - at)
        at, done = upto, int(ends[upto - 1])
