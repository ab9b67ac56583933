"""The records of CSV files whose quoted fields may hold line breaks, one file read by many tasks.

Where a record begins can't be seen from a chunk of a file alone: a line feed may stand in a quoted field that
began in an earlier chunk. So each chunk says first how it ends, and how many records begin in it, both if it
starts outside quotes and if it starts within; a prefix pass over these few numbers tells how each chunk
really starts and which record it starts in. Then every chunk deals its lines to records. Records that lie
in one chunk are done; the pieces of those that cross into others are put together by their number.

Lines end at line feeds; a carriage return before one belongs to the line's end outside quotes and to the field within.
A quote opens a field only at its beginning, and a doubled one within is a character of it. Blank lines outside quotes are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Records of a batch that goes back to Spark, and their characters.
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000


def within(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open at the end of the line, if one is at its beginning or not."""
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if quoted:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):  # doubled
                at += 1
                continue
            quoted = False
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        at = line.find(",", at) + 1  # to the next field
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, chunk, place, line)``: the lines of a chunk, which begins at the byte ``chunk``, come in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _chunk_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk in turn: how it ends and how many records begin in it, from outside quotes and from within."""
    told: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, chunk, line in zip(batch["file"].to_pylist(), batch["chunk"].to_pylist(), batch["line"].to_pylist(), strict=True):
            t = told.setdefault((file, chunk), [False, 0, True, 0])
            for k in (0, 2):
                t[k + 1] += not t[k] and not _blank(line)
            t[0], t[2] = (within(line, t[0]), within(line, t[2])) if '"' in line else (t[0], t[2])
    rows = [(f, c, int(a), n, int(b), m) for (f, c), (a, n, b, m) in told.items()]
    names = ("file", "chunk", "end_out", "begun_out", "end_in", "begun_in")
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))


def chunk_starts(lines: DataFrame) -> DataFrame:
    """``(file, chunk, quoted, begun, file_begun)``, a row a chunk: how it starts, records begun before it in its file, and records of all files before, headers left out."""
    ends = lines.select("file", "chunk", "line").mapInArrow(_chunk_ends, "file string, chunk long, end_out int, begun_out long, end_in int, begun_in long")
    in_file = Window.partitionBy("file").orderBy("chunk")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # A chunk ends as it starts, the other way round, or always in the same way. So it starts as the last of
    # the latter kind before it ends, turned round by each chunk between that does so.
    turns = F.coalesce(F.sum(((F.col("end_out") == 1) & (F.col("end_in") == 0)).cast("int")).over(before), F.lit(0))
    ends = ends.withColumn("turns", turns)
    fixed = F.last(F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("end"), "turns")), ignorenulls=True).over(before)
    ends = ends.withColumn("quoted", (F.coalesce(fixed["end"] + F.col("turns") - fixed["turns"], F.col("turns")) % 2) == 1)
    ends = ends.withColumn("records", F.when(F.col("quoted"), F.col("begun_in")).otherwise(F.col("begun_out")))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ends = ends.withColumn("begun", earlier("records", before))
    rows = F.col("records") - ((F.col("begun") == 0) & (F.col("records") > 0)).cast("int")
    everything = earlier(rows, Window.orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1))  # numbers alone, a row a chunk
    return ends.withColumn("file_begun", everything - F.greatest(F.col("begun") - 1, F.lit(0))).select("file", "chunk", "quoted", "begun", "file_begun")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of chunks with known starts as records, whole ones and pieces."""
    rows: list[tuple] = []
    chars, key, number, piece, quoted, whole, last = 0, None, 0, None, False, True, -1
    names = ("file", "file_begun", "record", "chunk", "whole", "text")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))

    def close(done: bool) -> None:
        nonlocal chars, piece
        if piece is not None:
            text = "\n".join(piece)
            chars += len(text)
            rows.append((key[0], key[2], number, key[1], whole and done, text))
            piece = None

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("file", "chunk", "file_begun", "place", "quoted", "begun", "line")]
        for file, chunk, file_begun, place, starts_quoted, begun, line in zip(*columns, strict=True):
            if place <= last:
                raise RuntimeError("the lines of a chunk must come in order")
            last = place
            if (file, chunk, file_begun) != key:
                close(False)
                key, number, quoted = (file, chunk, file_begun), begun - 1, starts_quoted
                piece, whole = ([] if quoted else None), not quoted
            if not quoted:
                if _blank(line):
                    continue
                number, piece, whole = number + 1, [], True
            piece.append(line)
            quoted = within(line, quoted)
            if not quoted:
                close(True)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield made()
                    rows, chars = [], 0
    close(False)
    yield made()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, file_begun, record, text)``: every record, numbered from 0 in its file; ``file_begun`` counts those of the files before, by name, without their first ones, the headers."""
    lines = lines_of(spark, path)
    # A row a chunk, so bounded by a file's size over the session's split size; a broadcast leaves the lines in their order.
    placed = lines.join(F.broadcast(chunk_starts(lines_of(spark, path))), ["file", "chunk"])
    kind = "file string, file_begun long, record long, chunk long, whole boolean, text string"
    dealt = placed.select("file", "chunk", "file_begun", "place", "quoted", "begun", "line").mapInArrow(_deal, kind)
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "text")))  # of the records that cross from one chunk into others
    crossing = dealt.where(~F.col("whole")).groupBy("file", "file_begun", "record").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    return dealt.where("whole").select("file", "file_begun", "record", "text").unionByName(crossing)


def without_ends(text: Column) -> Column:
    """A record without the byte-order mark before it and the carriage return behind it."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r$", "")
