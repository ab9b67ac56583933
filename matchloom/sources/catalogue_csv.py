"""The catalogue CSV: UTF-8 with or without a byte-order mark, a fixed header, quoted fields over several lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import SOURCE_COLUMNS
from .csv_records import read_records, without_ends

#: Bytes of a file that are held at once.
PIECE = 8 << 20


#: How a record is parsed; fields stay as they are, quotes within are doubled.
RECORD = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 27 text columns and ``source_row``, the record's number counted from 2; absent values are empty.

    Raises unless the header has the 27 names in order; those of further files raise when they are read, as do
    records with too few or too many fields. Files are numbered on in order of their names. A file is read by
    as many tasks as the session splits it for, quoted line breaks or not; lines end with line feeds, perhaps after a carriage return.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    names = reader.option("inferSchema", False).csv(path).columns
    if names != SOURCE_COLUMNS:
        raise ValueError(f"unexpected catalogue header: {names}")
    parsed = F.from_csv(without_ends(F.col("text")), ", ".join(f"{c} string" for c in SOURCE_COLUMNS), RECORD)
    rows = read_records(spark, path).withColumn("r", parsed)
    named = F.lit(True)
    for c in SOURCE_COLUMNS:
        named = named & F.coalesce(F.col(f"r.{c}") == c, F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("unexpected catalogue header in "), "file")).cast("boolean")
    rows = rows.where(F.when(F.col("record") > 0, True).when(named, False).otherwise(wrong))
    return rows.select(*(F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in SOURCE_COLUMNS), (F.col("file_begun") + F.col("record") + 1).alias("source_row"))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each source file, read in tasks piece by piece."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch["path"]:
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                sha = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while piece := f.read(PIECE):
                        sha.update(piece)
                out.append(sha.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": out})

    files = spark.read.format("binaryFile").load(path).select("path")  # names alone; no content is read
    return files.mapInPandas(digests, "path string, sha256 string")
