"""Match items as they arrive: a stream of JSON lines against a built catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import match
from ..sources.items_json import items_of_strings, raw_of_variants
from ..stage import stages


def match_stream(spark: SparkSession, source: str, products: DataFrame, output: str, checkpoint: str, *, top_k: int = 10, once: bool = False) -> StreamingQuery:
    """Match every text line that appears under ``source``, one item a line, and append results to ``output``.

    The cascade is a chain of joins with the whole batch, so each micro-batch is matched as a
    table. A batch is written under its number and overwrites itself if it is run again, so
    each item has one result after a failure as well. What a batch stages goes with the batch.
    """
    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def one(batch: DataFrame, number: int) -> None:
        keyed = batch.where(F.trim("value") != "").withColumn("key", F.concat_ws("#", "file", F.col("at").cast("string"), F.monotonically_increasing_id().cast("string")))
        with stages(spark):
            match(spark, raw_of_variants(items_of_strings(keyed, "key", "value")), products, top_k=top_k).write.mode("overwrite").json(f"{output}/batch={number}")

    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
