"""Sharding by a K-d tree over row metadata, with DataFrame functions only.

Every inner node of the tree splits its rows at a weighted median (weight: bytes of
the row) along the dimension in which the node is widest. The tree has as many leaves
as the data need to reach the target bytes; a node for ``n`` leaves gives
``n // 2`` of them to its left child, so the cut lies at that share of the bytes.

How a median is found without sorting: each row has a 63-bit key (31 bits of the
scaled dimension, then 32 bits of a hash of the row, so that rows with an equal
dimension value can still be parted). A histogram of 65,536 key digits per node is
summed map-side, the digit that holds the median is kept, and the next digits are
resolved among the rows of that digit only. All nodes of a level share each job; what
reaches the driver is one row per node.

Equal texts stay together: the rows of a group of copies take the least values of the group for their
dimensions and the hash of the text for theirs, so no cut parts them. A group that holds more than a
share ``TOGETHER`` of a shard's bytes or rows is parted like other rows, as shards near equal in bytes can't hold it whole.

Defined cases: null text weighs nothing but the fixed 8 bytes; null dimensions sort
first; an empty table gives an empty result; rows equal in id and text can't be
parted and stay in one shard; columns beyond those named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged

VALUE_BITS, HASH_BITS, DIGIT_BITS = 31, 32, 16
TOGETHER = 0.01


@dataclass
class Node:
    leaves: int
    first: int
    dim: int = 0
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None
    total: int = 0
    below: int = 0
    prefix: int = 0
    target: float = 0.0
    done: bool = field(default=False)


def _number(df: DataFrame, name: str) -> Column:
    """A dimension as a double; text by the place of its hash, so equal values stay together."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.TimestampType | T.DateType):
        return F.col(name).cast("timestamp").cast("double")
    return F.crc32(F.col(name).cast("string").cast("binary")).cast("double")


def kd_shards(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("doc_id", "source", "lang"),
    shards: int | None = None,
    target_bytes: int | None = None,
    row_overhead: int = 8,
) -> DataFrame:
    """Return ``(id, size, text_crc32, shard, slot)``, one row per row of ``df``.

    Give either ``shards`` or ``target_bytes``. ``slot`` numbers the rows of a shard
    from 0 without gaps.
    """
    text = F.col(text_col).cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_overhead
    values = [_number(df, d) for d in dims] + [F.log2(size.cast("double"))]
    base = staged(
        df.select(
            F.col(id_col).alias("id"),
            size.alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(text).alias("same"),
            *(F.coalesce(v, F.lit(float("-inf"))).alias(f"v{i}") for i, v in enumerate(values)),
        ),
        "kd",
    )
    n = len(values)
    finite = [F.when(F.col(f"v{i}") > float("-inf"), F.col(f"v{i}")) for i in range(n)]
    whole = base.agg(
        F.count("*").alias("rows"),
        F.sum("size").alias("bytes"),
        *(F.min(finite[i]).alias(f"lo{i}") for i in range(n)),
        *(F.max(finite[i]).alias(f"hi{i}") for i in range(n)),
    ).first()
    rows, total = whole["rows"], whole["bytes"] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    base = _together(base, n, total / shards * TOGETHER, (rows or 0) / shards * TOGETHER)
    span = [(whole[f"lo{i}"] or 0.0, (whole[f"hi{i}"] or 0.0) - (whole[f"lo{i}"] or 0.0)) for i in range(n)]
    keys = []
    for i, (low, width) in enumerate(span):
        at = F.floor((F.greatest(F.col(f"v{i}"), F.lit(low)) - low) / (width or 1.0) * float((1 << VALUE_BITS) - 1))
        keys.append(F.shiftleft(at.cast("long"), HASH_BITS).bitwiseOR(F.col("tie")))
    base = staged(base.select("id", "size", "crc", *(k.alias(f"k{i}") for i, k in enumerate(keys))), "kd")
    keys = [F.col(f"k{i}") for i in range(n)]

    root = Node(shards, 0)
    level = [root] if shards > 1 and rows else []
    while level:
        _split(base, root, level, keys, total / shards)
        level = [c for node in level for c in (node.left, node.right) if c.leaves > 1]
    placed = base.select("id", "size", "crc", _leaf(root, keys).cast("int").alias("shard"))
    return _slots(placed, rows, shards).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _together(base: DataFrame, n: int, most_bytes: float, most_rows: float) -> DataFrame:
    """Give the copies of a text one place in all dimensions and one ``tie``; groups beyond the limits keep those of their rows."""
    on = ["same", "crc", "size"]
    groups = base.groupBy(*on).agg(F.count("*").alias("copies"), *(F.min(f"v{i}").alias(f"g{i}") for i in range(n))).where("copies > 1")
    groups = staged(groups.withColumn("parted", (F.col("copies") * F.col("size") > most_bytes) | (F.col("copies") > F.greatest(F.lit(most_rows), F.lit(2)))), "copies")
    parted = groups.where("parted").select(*on, "parted")  # at most 2 / TOGETHER of them a shard
    marked = base.join(F.broadcast(parted), on, "left")
    own = F.xxhash64("id", "crc", "size")
    alone = marked.where("parted").select("id", "size", "crc", *(f"v{i}" for i in range(n)), own.alias("tie"))
    met = marked.where("parted is null").drop("parted").join(groups.where("not parted").drop("parted"), on, "left")
    shared = F.when(F.col("copies").isNotNull(), F.xxhash64(*on)).otherwise(own)
    together = met.select("id", "size", "crc", *(F.coalesce(f"g{i}", f"v{i}").alias(f"v{i}") for i in range(n)), shared.alias("tie"))
    return together.unionByName(alone).withColumn("tie", F.col("tie").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def _leaf(node: Node, keys: list[Column]) -> Column:
    """The first shard of the node in which a row now lies."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(keys[node.dim] < node.cut, _leaf(node.left, keys)).otherwise(_leaf(node.right, keys))


def _split(base: DataFrame, root: Node, level: list[Node], keys: list[Column], leaf_bytes: float) -> None:
    by = {node.first: node for node in level}
    n = len(keys)
    here = base.withColumn("cell", _leaf(root, keys)).where(F.col("cell").isin(list(by)))
    scaled = [F.shiftright(k, HASH_BITS) for k in keys]
    stats = here.groupBy("cell").agg(
        F.sum("size").alias("total"),
        *(F.min(scaled[i]).alias(f"lo{i}") for i in range(n)),
        *(F.max(scaled[i]).alias(f"hi{i}") for i in range(n)),
    )
    for r in stats.collect():  # one row per node
        node = by[r["cell"]]
        node.total = r["total"]
        node.dim = max(range(n), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
    for node in level:
        node.target = node.total * (node.leaves // 2) / node.leaves
        node.done = node.total == 0
    shift = VALUE_BITS + HASH_BITS
    while active := {c: node for c, node in by.items() if not node.done}:
        before, shift = shift, max(0, shift - DIGIT_BITS)
        of = lambda get, kind: F.get(F.array(*(F.lit(get(active.get(c, root))).cast(kind) for c in range(root.leaves))), F.col("cell"))
        at = (
            here.where(F.col("cell").isin(list(active)))
            .withColumn("key", F.get(F.array(*keys), of(lambda x: x.dim, "int")))
            .where(F.shiftright("key", before) == of(lambda x: x.prefix, "long"))
            .groupBy("cell", F.shiftright("key", shift).alias("digit"))
            .agg(F.sum("size").alias("w"), F.count("*").alias("c"))
            .withColumn("upto", F.sum("w").over(Window.partitionBy("cell").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("upto", F.col("upto") + of(lambda x: x.below, "long"))
            .withColumn("target", of(lambda x: x.target, "double"))
            .where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("w") < F.col("target")))
        )
        for r in at.collect():  # one row per node
            node = active[r["cell"]]
            node.prefix, node.below = r["digit"], r["upto"] - r["w"]
            if r["c"] == 1 or shift == 0 or r["w"] <= leaf_bytes * 1e-3:
                node.done = True
                over = r["upto"] - node.target < node.target - node.below
                node.cut = (node.prefix + over) << shift
        for node in active.values():
            node.done |= shift == 0
    for node in level:
        left = node.leaves // 2
        node.left, node.right = Node(left, node.first), Node(node.leaves - left, node.first + left)


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Number the rows of each shard; a shard is numbered in blocks, so no task holds a whole one."""
    blocks = min(4096, max(8, rows // (shards * 100_000)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).cast("int"))
    start = (
        placed.groupBy("shard", "block")
        .agg(F.count("*").alias("c"))
        .withColumn("start", F.sum("c").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
        .select("shard", "block", "start")
    )  # shards x blocks rows at most: 4096 for a shard
    start = F.broadcast(start) if shards * blocks <= 200_000 else start
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "crc", "size"))
    return placed.join(start, ["shard", "block"]).withColumn("slot", F.col("start") + nth - 1)
