"""The items of JSON files, an array or the ``items`` array of an object, one file read by many tasks.

A file is cut after each closing brace, and pieces lie in chunks as Spark splits the file. Three passes, each of
which leaves a row a chunk to the next: whether a chunk starts within a string, and how deep; where the
array of items opens and closes, and how many items begin in each chunk; then every chunk deals its pieces to items by their place
in the array. Items that cross into other chunks are put together by place. No task holds more than its chunk,
an item and the numbers of a file's chunks.

An object without an array under ``items`` is one item, and so held whole. An item that is no object, a comma too many and an
end that doesn't fit raise; other fields of the object around the items are passed over. An empty file holds no items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|["\[\]{]', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
NOT_OBJECT, NO_ITEMS, BROKEN = "every item must be a JSON object", "item JSON must be an object, an array, or an object with an items array", "malformed item JSON"
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000


class State:
    """Where a walk stands: within a string or not, and in how many brackets."""

    def __init__(self, quoted: bool = False, depth: int = 0):
        self.quoted, self.depth = quoted, depth

    def walk(self, piece: str, closed: bool = True) -> Iterator[tuple[str, int, int]]:
        """``(sign, begin, end)`` of each opening or closing bracket and each string before the closing brace; ``closed``: the piece ends with one."""
        at = 0
        if self.quoted:
            if not (m := REST.match(piece)):
                return
            at, self.quoted = m.end(), False
        for m in TOKEN.finditer(piece, at):
            sign = piece[m.start()]
            if sign == '"' and m.end() - m.start() == 1:
                self.quoted = True
                return
            yield sign, m.start(), m.end()
            if sign != '"':
                self.depth += -1 if sign == "]" else 1
        if closed:
            self.depth -= 1


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size, chunk, place, piece)``: the pieces of a chunk come in order, without the brace that ends each."""
    rows = spark.read.option("lineSep", "}").text(path)
    m = lambda n: F.col(f"_metadata.{n}")
    return rows.select(m("file_path").alias("file"), m("file_size").alias("size"), m("file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def _told(rows: dict, names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    flat = [(*k, *v) for k, v in rows.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], names.split())


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    last = -1
    for batch in batches:
        for place, *row in zip(batch["place"].to_pylist(), *(batch[n].to_pylist() for n in names), strict=True):
            if place <= last:
                raise RuntimeError("the pieces of a chunk must come in order")
            last = place
            yield tuple(row)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each chunk ends and how much deeper, from outside strings and from within; and its bytes with a brace a piece."""
    told: dict = {}
    for file, chunk, piece in _rows(batches, "file", "chunk", "piece"):
        t = told.setdefault((file, chunk), [State(), State(True), 0])
        for s in t[:2]:
            for _ in s.walk(piece):
                pass
        t[2] += len(piece.encode()) + 1
    flat = {k: (int(a.quoted), a.depth, int(b.quoted), b.depth, n) for k, (a, b, n) in told.items()}
    yield _told(flat, "file chunk end_out deeper_out end_in deeper_in bytes", [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])


def chunk_starts(pieces: DataFrame) -> DataFrame:
    """``(file, chunk, quoted, depth, last, total)``, a row a chunk; ``total``: the file's bytes, if its last piece ends with a brace."""
    ends = pieces.select("place", "file", "chunk", "piece").mapInArrow(_ends, "file string, chunk long, end_out int, deeper_out long, end_in int, deeper_in long, bytes long")
    in_file = Window.partitionBy("file").orderBy("chunk")
    before, whole = in_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    turns = F.coalesce(F.sum(((F.col("end_out") == 1) & (F.col("end_in") == 0)).cast("int")).over(before), F.lit(0))
    ends = ends.withColumn("turns", turns)
    # As with quoted fields: a chunk starts as the last one before that always ends alike ends, turned by those between.
    fixed = F.last(F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("end"), "turns")), ignorenulls=True).over(before)
    ends = ends.withColumn("quoted", (F.coalesce(fixed["end"] + F.col("turns") - fixed["turns"], F.col("turns")) % 2) == 1)
    ends = ends.withColumns({"deeper": F.when(F.col("quoted"), F.col("deeper_in")).otherwise(F.col("deeper_out")), })
    ends = ends.withColumns({"depth": F.coalesce(F.sum("deeper").over(before), F.lit(0)), "total": F.sum("bytes").over(whole), "last": F.col("chunk") == F.max("chunk").over(whole)})
    return ends.select("file", "chunk", "quoted", "depth", "last", "total")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: the file's first sign, items begun in an array that is the file, and what is known of one under ``items``.

    ``begun``, ``closes``: objects begun two deep, and whether such an array closes, until the first that does; ``opens``, ``begun_in``, ``closes_in``: the
    same from where ``items`` opens.
    """
    told: dict = {}
    states: dict = {}
    for file, chunk, quoted, depth, piece in _rows(batches, "file", "chunk", "quoted", "depth", "piece"):
        t = told.setdefault((file, chunk), [None, 0, 0, False, False, 0, False])
        s = states.setdefault((file, chunk), State(quoted, depth))
        if chunk == 0 and t[0] is None and (head := piece.lstrip("﻿ \t\r\n")[:1] or None):
            t[0] = head
        key = None
        for sign, begin, end in s.walk(piece):
            if sign == '"':
                key = end if s.depth == 1 and piece[begin:end] == '"items"' else None
            elif sign == "{":
                t[1] += s.depth == 1
                t[2] += s.depth == 2 and not t[3]
                t[5] += s.depth == 2 and t[4] and not t[6]
            elif sign == "[" and s.depth == 1 and key is not None and piece[key:begin].strip() == ":":
                t[4] = True
            elif sign == "]" and s.depth == 2:
                t[3] = True
                t[6] |= t[4]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()]
    yield _told(told, "file chunk head ones begun closes opens begun_in closes_in", kinds)


def chunk_items(starts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``chunk_starts`` with ``kind`` (array, items or one), ``inside`` (the chunk starts within the array) and ``first``, the place of the first item that begins in it."""
    placed = pieces.join(F.broadcast(starts), ["file", "chunk"]).select("place", "file", "chunk", "quoted", "depth", "piece")
    facts = placed.mapInArrow(_facts, "file string, chunk long, head string, ones long, begun long, closes boolean, opens boolean, begun_in long, closes_in boolean")
    whole, in_file = Window.partitionBy("file"), Window.partitionBy("file").orderBy("chunk")
    told = facts.withColumns({"head": F.max("head").over(whole), "open_at": F.min(F.when(F.col("opens"), F.col("chunk"))).over(whole)})
    at, opened = F.col("chunk"), F.col("open_at")
    told = told.withColumn("close_at", F.min(F.when((at > opened) & F.col("closes") | (at == opened) & F.col("closes_in"), at)).over(whole))
    kind = F.when(F.col("head") == "[", "array").when(F.col("head") != "{", F.raise_error(F.lit(NO_ITEMS)).cast("string")).when(opened.isNotNull(), "items").otherwise("one")
    inside = (at > opened) & ~F.coalesce(at > F.col("close_at"), F.lit(False))
    begun = F.when(F.col("kind") == "array", F.col("ones")).when(at == opened, F.col("begun_in")).when(inside, F.col("begun")).otherwise(0)
    told = told.withColumn("kind", kind).withColumn("begun", begun)
    first = F.coalesce(F.sum("begun").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return starts.join(told.select("file", "chunk", "kind", F.coalesce(inside, F.lit(False)).alias("inside"), first.alias("first")), ["file", "chunk"])


class Dealer:
    """Deals the pieces of one chunk to items."""

    def __init__(self, kind: str, quoted: bool, depth: int, inside: bool, first: int):
        self.kind, self.state, self.next = kind, State(quoted, depth), first
        self.deep = 1 if kind == "array" else 2
        self.active = depth >= 1 if kind == "array" else inside
        self.done = False
        self.parts: list[str] | None = [] if self.active and depth > self.deep else None
        self.whole = self.parts is None

    def deal(self, piece: str, closed: bool) -> Iterator[tuple[int, bool, str]]:
        """``(place, whole, text)`` of the item that ends with the piece."""
        s, begin_at, gap = self.state, 0, 0
        key = None
        end = piece + "}" if closed else piece
        for sign, begin, stop in s.walk(piece, closed):
            if sign == '"':
                key = stop if s.depth == 1 and piece[begin:stop] == '"items"' else None
            elif sign == "]":
                if self.active and s.depth == self.deep:
                    if piece[gap:begin].strip():
                        raise ValueError(NOT_OBJECT)
                    self.active, self.done = False, True
            elif self.active and s.depth == self.deep and self.parts is None:
                between = piece[gap:begin].strip()
                if sign == "[" or between not in ("", ","):
                    raise ValueError(NOT_OBJECT)
                if (between == ",") != (self.next > 0):
                    raise ValueError(BROKEN)
                self.parts, self.whole, begin_at = [], True, begin
                self.next += 1
            elif sign == "[" and not self.active and not self.done and (s.depth == 0 if self.kind == "array" else s.depth == 1 and key is not None and piece[key:begin].strip() == ":"):
                self.active, gap = True, stop
        if self.parts is not None:
            self.parts.append(end[begin_at:])
            if closed and not s.quoted and s.depth == self.deep:
                text, self.parts = "".join(self.parts), None
                yield self.next - 1, self.whole, text


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars, key, dealer, waiting = 0, None, None, None
    names, kinds = ["file", "pos", "chunk", "whole", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    unit: list[str] = []  # of a file that is one item

    def put(piece: str, closed: bool) -> None:
        nonlocal chars
        if key[4] == "one":
            unit.append(piece + "}" if closed else piece)
            for _ in dealer.state.walk(piece, closed):
                pass
        else:
            for pos, whole, text in dealer.deal(piece, closed):
                rows.append((key[0], pos, key[1], whole, text))
                chars += len(text)

    def finish() -> None:
        """The chunk's last piece, and what crosses into the next chunk."""
        if key is None:
            return
        last, closed = key[2], key[3]
        put(waiting, closed if last else True)
        if last and (dealer.state.quoted or dealer.state.depth):
            raise ValueError(BROKEN)
        if key[4] == "one":
            rows.append((key[0], 0, key[1], False, "".join(unit)))
        elif dealer.parts is not None:
            rows.append((key[0], dealer.next - 1, key[1], False, "".join(dealer.parts)))

    for file, chunk, last, closed, kind, quoted, depth, inside, first, piece in _rows(batches, "file", "chunk", "last", "closed", "kind", "quoted", "depth", "inside", "first", "piece"):
        if key is None or (file, chunk) != key[:2]:
            finish()
            key, dealer, unit = (file, chunk, last, closed, kind), Dealer(kind, quoted, depth, inside, first), []
            waiting = piece.removeprefix("﻿") if chunk == 0 else piece
            continue
        put(waiting, True)
        waiting = piece
        if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield made()
            rows, chars = [], 0
    finish()
    yield made()


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, text)``: each item's JSON text and its place."""
    pieces = pieces_of(spark, path)
    chunks = chunk_items(chunk_starts(pieces_of(spark, path)), pieces_of(spark, path))
    # A row a chunk is broadcast, which leaves the pieces in their order. Three bytes of a byte-order mark are no part of a piece.
    placed = pieces.join(F.broadcast(chunks), ["file", "chunk"]).withColumn("closed", (F.col("total") - F.col("size")).isin(0, -3))
    dealt = placed.select("place", "file", "chunk", "last", "closed", "kind", "quoted", "depth", "inside", "first", "piece").mapInArrow(_deal, "file string, pos long, chunk long, whole boolean, text string")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))  # of the items that cross from one chunk into others
    crossing = dealt.where(~F.col("whole")).groupBy("file", "pos").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return dealt.where("whole").select("file", "pos", "text").unionByName(crossing)
