"""Exact n-gram Jaccard join with count-vector R-trees, and the groups it links.

A text's set holds its distinct shingles of five words. Two texts link when the Jaccard
similarity of their sets is 0.8 or more. The result is one row per document with the
component that its links reach.

How pairs are found:

1. Each task hashes the shingles of its documents with array code: 64-bit hashes of words,
   then of five words in a row. Documents with equal sets are one class from here on.
2. Shingles are hashed into groups, about one to a group; the counts by group are a point. The
   overlap of two sets is at most the sum of their coordinate minima. The number of groups
   is a power of two, so points of sets of different sizes are made alike by folding.
3. Documents meet in the buckets of the shingles of their prefixes: among sets in one fixed
   order, two that link share one of their first ``n - ceil(0.8 n) + 1`` shingles. The order
   puts shingles that many documents hold last, so frequent passages fill no buckets. It is a
   matter of cost alone: any fixed order gives all links.
4. Every bucket has a centre, the class whose prefix is shared most. The classes that meet a
   centre in any bucket are its family, so two classes that share a bucket are in one family, and
   there are no more family members than bucket entries. All are tried against their centre
   first; groups of copies, however large, become connected this way in linear work.
5. Then families with classes of different components build an R-tree over the points of their
   classes and join it with itself: a pair of boxes whose greatest possible overlap is too
   small for their least sizes is cut off with all below, and so are pairs that are connected
   already. Large families are dealt out by pairs of chunks. What survives is verified.
6. Verifying compares whole sets. They are hashed again for the classes concerned alone, so
   the sets of the other documents are never written out.

The R-tree prunes within families rather than over the whole table: for unrelated texts of
some hundred words, points are too alike for a box to exclude them, and a single
tree over all documents would compare nearly all pairs.

Words are hashed by a multilinear sum over their bytes (a random 64-bit factor for each place), which unlike a
polynomial has no texts that collide by construction. Sets are compared by 64-bit shingle hashes, classes by a
128-bit digest of the set: 64 bits name the class, and where the others tell classes of one name apart,
they are named anew. Rows are told apart by a 128-bit hash of id and text.

Defined cases: null, empty or blank texts have an empty set, link with nothing and are
their own component; texts of one to four words have one shingle, the whole sequence;
repeated rows are copies; rows go by their texts, so rows that share an id may be of different
components, and rows without an id link like others (a component of such rows alone has a null
id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, staged, with_each
from .components import connected_components

#: Least number of groups, and shingles to a group.
GROUPS, LOAD = 16, 1
#: Shingles to a group in the tree; its leaves are tried at the full number of groups.
TREE_LOAD = 8
#: Share of a block's documents from which on a shingle counts as frequent there; a block holds so many shingles.
FREQUENT, BLOCK_SHINGLES = 0.002, 8_000_000
#: Families of up to so many classes are one leaf of the tree.
SMALL_FAMILY = 24
#: Larger families are dealt out by pairs of chunks of this size.
CHUNK_CLASSES = 3000
#: So many keys of 16 bytes at most are broadcast, by halves; beyond, the same join shuffles.
BROADCAST_KEYS = 2_000_000
FREQUENT_KEYS = 2_000_000
#: So many frequent shingles of prefixes at most are broadcast with their buckets (20 MB); beyond, the same join shuffles.
BROADCAST_BUCKETS = 500_000
#: A row's id (0 where it is null, as nulls would turn a batch's ids into floats), whether that is null, and its row key.
KEYS = ["id", "no_id", "row"]
CHUNK_BYTES = 2_000_000

R = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(16)]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: Words of up to so many bytes are hashed together; longer ones one by one.
LONG_WORD = 1 << 16
#: The factor of each place of a word.
FACTORS = mixed((np.arange(LONG_WORD, dtype=np.uint64) + np.uint64(1)) * R) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in order, and the number of the text that it is from."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1).astype(np.int32), np.flatnonzero(edge == 1).astype(np.int32)
    length = end - start
    place = np.arange(len(raw), dtype=np.int32)
    if len(start):
        place[start[0] :] -= np.repeat(start, np.diff(start, append=np.int32(len(raw))))
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * FACTORS[np.minimum(place, LONG_WORD - 1)], out=upto[1:])
    words = upto[end] - upto[start] + length.astype(np.uint64) * MIX[0]
    for i in np.flatnonzero(length > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "big")
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(words), np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, owner = word_hashes([(t or "").encode("utf-8").lower() for t in texts])
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    if len(words) >= n:
        grams = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            grams += words[j : len(grams) + j] * PLACE[j]
        grams = mixed(grams)
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            short = (words[a : a + c] * np.array(PLACE[:c])).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set and its size, as signed 64-bit numbers."""
    if not len(own):
        return 0, 0
    size = np.array([len(own)], np.uint64) * R
    first = mixed(own * MIX[1] + np.uint64(1)).sum(dtype=np.uint64, keepdims=True)
    second = mixed(own ^ MIX[0]).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(first + size).view(np.int64)[0]), int(mixed(second + size).view(np.int64)[0])


def _sets(batches: Iterator[pd.DataFrame], n: int, columns: list[str] = KEYS) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of the columns and the set of every row."""
    for batch in batches:
        keys, texts, held = [], [], 0
        for *key, t in zip(*(batch[c] for c in columns), batch["text"], strict=True):
            keys.append(tuple(key))
            texts.append(t)
            held += len(t or "")
            if held >= CHUNK_BYTES:
                yield from zip(keys, shingle_sets(texts, n), strict=True)
                keys, texts, held = [], [], 0
        if keys:
            yield from zip(keys, shingle_sets(texts, n), strict=True)


def _batched(rows: Iterator[tuple], columns: list[str], cells: int = 400_000) -> Iterator[pd.DataFrame]:
    """Frames of the rows; arrays count by their length, so that a frame stays small."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, np.ndarray | bytes) else 1 for x in row)
        if size >= cells:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


class Limits:
    """Similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def enough(self, overlap, both):
        """Whether an overlap is enough for sets of ``both`` elements together."""
        return (self.num + self.den) * overlap >= self.num * both


def frequent_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in some block of documents and in all blocks together, sorted, and the place of each when ordered by count."""

    def frequent(sets: list[np.ndarray]) -> pd.DataFrame:
        shingle, c = np.unique(np.concatenate(sets), return_counts=True)
        ok = c >= max(3, FREQUENT * len(sets))
        none = np.zeros(1, np.int64)  # a row for the number of documents
        docs = np.concatenate([np.zeros(int(ok.sum()), np.int64), [len(sets)]])
        return pd.DataFrame({"shingle": np.concatenate([shingle[ok].view(np.int64), none]), "c": np.concatenate([c[ok], none]), "docs": docs})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, sets, held = set(), [], 0
        for _, own in _sets(batches, n):
            if len(own) and (d := digest(own)) not in seen:
                seen.add(d)
                sets.append(own)
                held += len(own)
                if held >= BLOCK_SHINGLES:
                    yield frequent(sets)
                    sets, held = [], 0
        if sets:
            yield frequent(sets)

    found = staged(rows.mapInPandas(local, "shingle long, c long, docs long"), "frequent")
    docs = found.agg(F.sum("docs")).first()[0] or 0
    total = found.where("docs = 0").groupBy("shingle").agg(F.sum("c").alias("c")).where(F.col("c") >= max(8, FREQUENT / 2 * docs))
    # Their number is at most the mean size of a set times 2 / FREQUENT; the limit bounds it for any table.
    top = total.orderBy(F.desc("c"), "shingle").limit(FREQUENT_KEYS).toPandas()
    shingle, count = top["shingle"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(shingle)
    shingle, count = shingle[order], count[order]
    place = np.empty(len(count), np.int64)
    place[np.lexsort((shingle, count))] = np.arange(len(count))
    return shingle, place


def _row_key(id_column: Column, text: Column) -> Column:
    """What tells rows with words apart: equal for rows of one id and one text alone."""
    ident = F.coalesce(id_column.cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(ident, F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def link_components(docs: DataFrame, **options) -> DataFrame:
    """Return ``(id, n_shingles, component_id)`` for every row of ``docs``; options as in ``labelled_rows``."""
    rows = staged(labelled_rows(docs, **options), "labelled")
    labelled = rows.where("n > 0")
    least = staged(labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("many")), "least")
    linked = with_each(labelled, least, "label", rows.count()).select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def _sketched(rows: DataFrame, limits: Limits, n: int) -> DataFrame:
    """The class of every row; for one row or more of each class its point and its prefix, of which the first ``cold`` shingles are not frequent."""
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, n))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (late, order), seen = frequent.value, set()

        def each() -> Iterator[tuple]:
            for key, own in _sets(batches, n):
                name, prefix, cold, point = digest(own), None, 0, None
                if len(own) and name not in seen:
                    seen.add(name)
                    at = np.minimum(np.searchsorted(late, own), max(len(late) - 1, 0))
                    last = late[at] == own if len(late) else np.zeros(len(own), bool)
                    rare_first = own[last][np.argsort(order[at[last]])] if last.any() else own[:0]
                    prefix = np.concatenate([own[~last], rare_first])[: limits.prefix(len(own))].view(np.int64)
                    cold = min(len(prefix), int((~last).sum()))
                    point = counts(own)
                yield *key, len(own), *name, prefix, cold, point

        yield from _batched(each(), [*KEYS, "n", "class", "check", "prefix", "cold", "point"])

    made = staged(rows.mapInPandas(sketch, "id long, no_id boolean, row binary, n long, class long, check long, prefix array<long>, cold int, point binary"), "sketch")
    # Different sets whose classes have one name get names of their own.
    clash = staged(made.where("n > 0").groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("class", F.lit(True).alias("clash")), "clash")
    if clash.isEmpty():
        return made
    renamed = made.join(clash, "class", "left").withColumn("class", F.when(F.col("clash"), F.xxhash64("class", "check")).otherwise(F.col("class")))
    return staged(renamed.drop("clash"), "sketch")


def _families(sketched: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The classes that share a bucket with another, and the families ``(class, centre)`` of the buckets' centres."""
    bucket = Window.partitionBy("shingle")
    firsts = sketched.where("prefix is not null")
    cold = firsts.select("class", F.explode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("shingle"))
    cold = (
        cold.withColumns({"least": F.min("class").over(bucket), "most": F.max("class").over(bucket), "size": F.count("*").over(bucket)})
        .where("least <> most")
        .select("shingle", "class", "size", F.lit(False).alias("hot"))
    )
    hot = staged(firsts.where("cold < size(prefix)").select("class", F.explode(F.slice("prefix", F.col("cold") + 1, F.size("prefix") - F.col("cold"))).alias("shingle")), "hot")
    met = staged(hot.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("size")).where("least <> most").select("shingle", "size"), "buckets")
    hot = hot.join(_few(met, BROADCAST_BUCKETS), "shingle").select("shingle", "class", "size", F.lit(True).alias("hot"))
    shared = staged(cold.unionByName(hot).distinct(), "shared")

    shares = shared.groupBy("class").agg(F.sum("size").alias("met"))
    classes = sketched.where("n > 0").groupBy("class").agg(F.min("row").alias("rep"), F.max("n").alias("n"), F.max("point").alias("point"))
    concerned = staged(classes.join(shares, "class").withColumn("pull", F.col("met") / (F.col("n") - F.ceil(F.col("n") * limits.num / limits.den) + 1)).drop("met"), "classes")
    pulled = shared.select("shingle", "class", "hot").join(concerned.select("class", "pull"), "class")
    best = F.max(F.struct("pull", "class"))
    cold = pulled.where("not hot").select("class", best.over(bucket)["class"].alias("centre"))
    tops = staged(pulled.where("hot").groupBy("shingle").agg(best.alias("top")).select("shingle", F.col("top.class").alias("centre")), "tops")
    hot = pulled.where("hot").join(_few(tops, BROADCAST_BUCKETS), "shingle").select("class", "centre")
    return concerned, staged(cold.unionByName(hot).distinct(), "families")


def labelled_rows(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """Return ``(id, row, n, label)`` for every row of ``docs``; ``label`` names its component and is null for empty sets."""
    limits = Limits(*similarity)
    i, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = bounded_batches(docs).select(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("no_id"), _row_key(i, text).alias("row"), text.alias("text"))
    sketched = _sketched(rows, limits, n)
    concerned, families = _families(sketched, limits)

    stars = families.where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b"))
    first = _verified(rows, concerned, _bounded(stars, concerned, limits), limits, n)
    joined = connected_components(first)
    named = concerned.join(joined.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "point", F.coalesce("component", "class").alias("component"))
    second = _verified(rows, concerned, _tree_pairs(families, staged(named, "named"), limits), limits, n)
    joined = connected_components(first.unionByName(second))

    ids = sketched.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "row", "n", "class")
    sizes = sketched.where("n > 0").groupBy("class").agg(F.count("*").alias("many"))
    names = staged(sizes.join(joined.withColumnRenamed("node", "class"), "class", "left").select("class", "many", F.coalesce("component", "class").alias("label")), "names")
    labelled = with_each(ids.where("n > 0"), names, "class", sketched.count()).select("id", "row", "n", "label")
    return labelled.unionByName(ids.where("n = 0").select("id", "row", "n", F.lit(None).cast("long").alias("label")))


def counts(own: np.ndarray) -> bytes:
    """The point of a set: counts by group, compressed; at about one shingle to a group they stay far below 255."""
    bits = max(GROUPS, 1 << max(0, (len(own) - 1) // LOAD).bit_length()).bit_length() - 1
    point = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if point.max(initial=0) > 255:
        raise ValueError("shingle hashes are not spread")
    return zlib.compress(point.astype(np.uint8).tobytes(), 1)


def point_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def folded(point: np.ndarray, size: int) -> np.ndarray:
    """A point of more groups as one of ``size`` groups."""
    return point.astype(np.uint16) if len(point) == size else point.reshape(size, -1).sum(1, dtype=np.uint16)


def room(limits: Limits, pa: list[bytes], pb: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each pair of sets, whether their points leave enough room for an overlap."""
    ok = (na * limits.den >= nb * limits.num) & (nb * limits.den >= na * limits.num)
    for i in np.flatnonzero(ok).tolist():
        x, y = point_of(pa[i]), point_of(pb[i])
        size = min(len(x), len(y))
        ok[i] = limits.enough(int(np.minimum(folded(x, size), folded(y, size)).sum()), int(na[i] + nb[i]))
    return ok


def _bounded(pairs: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """The pairs whose sizes and points leave enough room for an overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = room(limits, batch["pa"].tolist(), batch["pb"].tolist(), batch["na"].to_numpy(np.int64), batch["nb"].to_numpy(np.int64))
            yield batch.loc[ok, ["a", "b"]]

    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("point").alias(f"p{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def _tree_pairs(families: DataFrame, named: DataFrame, limits: Limits) -> DataFrame:
    """Pairs ``(a, b)`` of classes of one family, but for its centre, that neither the tree nor a component rules out."""

    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, low, high = (x.as_py() for x in key)
        cls, n, part, chunk = (rows.column(c).to_numpy() for c in ("class", "n", "component", "chunk"))
        if len(cls) <= SMALL_FAMILY:
            found = small_family_pairs(cls, n, part, rows.column("point"), limits)
        else:
            found = family_pairs(cls, n, part, [point_of(p) for p in rows.column("point").to_pylist()], limits)
        at = dict(zip(cls.tolist(), chunk.tolist(), strict=True))
        kept = sorted({(a, b) for a, b in found if low == high or at[a] != at[b]})  # of two chunks, pairs across
        return pa.table({"a": [a for a, _ in kept], "b": [b for _, b in kept]}, schema=none.schema) if kept else none

    own = families.where("class <> centre").join(named.select("class", "component"), "class")
    sizes = own.groupBy("centre").agg(F.count("*").alias("many"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    sizes = staged(sizes.select("centre", "many", F.col("many").alias("size")), "sizes")
    dealt = with_each(own, sizes, "centre", families.count()).withColumn("chunks", F.ceil(F.col("size") / CHUNK_CLASSES).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("centre", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "class")
    return dealt.join(named, "class").groupBy("centre", "low", "high").applyInArrow(run, "a long, b long").distinct()


def small_family_pairs(cls: np.ndarray, n: np.ndarray, part: np.ndarray, packed: pa.ChunkedArray, limits: Limits) -> Iterator[tuple[int, int]]:
    """The same for a family of one leaf of the tree: its pairs of points, unpacked only where sizes and components leave a pair."""
    i, j = np.triu_indices(len(cls), 1)
    ok = (part[i] != part[j]) & (n[i] * limits.den >= n[j] * limits.num) & (n[j] * limits.den >= n[i] * limits.num)
    points: dict[int, np.ndarray] = {}
    for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        for k in (x, y):
            if k not in points:
                points[k] = point_of(packed[k].as_py())
        size = min(len(points[x]), len(points[y]))
        if limits.enough(int(np.minimum(folded(points[x], size), folded(points[y], size)).sum()), int(n[x] + n[y])):
            a, b = int(cls[x]), int(cls[y])
            yield min(a, b), max(a, b)


def family_pairs(cls: np.ndarray, n: np.ndarray, part: np.ndarray, points: list[np.ndarray], limits: Limits) -> Iterator[tuple[int, int]]:
    """The pairs of a family that points and components leave, for each number of groups with the next finer folded in."""
    groups = np.array([len(p) for p in points])
    for size in np.unique(groups).tolist():
        at = np.flatnonzero((groups == size) | (groups == 2 * size))
        if len(at) < 2 or part[at].min() == part[at].max():
            continue
        fine = np.stack([folded(points[i], size) for i in at])
        coarse = fine.reshape(len(at), max(4, size * LOAD // TREE_LOAD), -1).sum(2, dtype=np.uint16)
        own = groups[at] == size
        for x, y in CountTree(coarse, n[at], part[at], limits).pairs():
            step = max(64, 4_000_000 // size)
            for s in range(0, len(x), step):
                i, j = x[s : s + step], y[s : s + step]
                ok = own[i] | own[j]
                ok[ok] = limits.enough(np.minimum(fine[i[ok]], fine[j[ok]]).sum(1, dtype=np.int64), n[at[i[ok]]] + n[at[j[ok]]])
                first, second = cls[at[i[ok]]], cls[at[j[ok]]]
                yield from zip(np.minimum(first, second).tolist(), np.maximum(first, second).tolist(), strict=True)


class CountTree:
    """An R-tree, packed bottom-up, over the count vectors of a family."""

    def __init__(self, points: np.ndarray, n: np.ndarray, part: np.ndarray, limits: Limits, fill: int = 16) -> None:
        self.limits = limits
        spread = points.var(0).argsort()[::-1][:3]
        self.order = np.lexsort((*(points[:, d] for d in spread), n))
        self.points, self.n, self.part = points[self.order], n[self.order], part[self.order]
        starts = np.arange(0, len(n), fill)
        #: Levels of boxes, leaves first: greatest counts, least and greatest size, the only component or -1 and children.
        self.levels = [self._boxes(starts, self.points, self.n, self.n, self.part, np.ones(len(self.n), bool))]
        while len(self.levels[-1]["low"]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below["low"]), fill)
            self.levels.append(self._boxes(starts, below["top"], below["low"], below["high"], below["part"], below["pure"]))
        self.fill = fill

    @staticmethod
    def _boxes(starts: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, pure: np.ndarray) -> dict[str, np.ndarray]:
        least, most = np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts)
        return {
            "top": np.maximum.reduceat(top, starts, axis=0),
            "low": np.minimum.reduceat(low, starts),
            "high": np.maximum.reduceat(high, starts),
            "part": least,
            "pure": np.logical_and.reduceat(pure, starts) & (least == most),
        }

    def _meet(self, a: np.ndarray, b: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, pure: np.ndarray) -> np.ndarray:
        """Which of the pairs of boxes (or points) may hold a link between components."""
        num, den = self.limits.num, self.limits.den
        ok = ~(pure[a] & pure[b] & (part[a] == part[b])) & (high[a] * den >= low[b] * num) & (high[b] * den >= low[a] * num)
        at = np.flatnonzero(ok)
        step = max(64, 4_000_000 // top.shape[1])
        for s in range(0, len(at), step):
            k = at[s : s + step]
            ok[k] = self.limits.enough(np.minimum(top[a[k]], top[b[k]]).sum(1, dtype=np.int64), low[a[k]] + low[b[k]])
        return ok

    def _children(self, a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of the pairs of boxes, each pair once."""
        step = np.arange(self.fill)
        x = (a[:, None, None] * self.fill + step[None, :, None] + 0 * step[None, None, :]).ravel()
        y = (b[:, None, None] * self.fill + 0 * step[None, :, None] + step[None, None, :]).ravel()
        ok = (x < count) & (y < count) & ((x < y) if count == len(self.n) else (x <= y))
        return x[ok], y[ok]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that may link, some at a time."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            box = self.levels[level]
            ok = self._meet(a, b, box["top"], box["low"], box["high"], box["part"], box["pure"])
            a, b = a[ok], b[ok]
            for s in range(0, len(a), 256):
                if level:
                    x, y = self._children(a[s : s + 256], b[s : s + 256], len(self.levels[level - 1]["low"]))
                    todo.append((level - 1, x, y))
                else:
                    x, y = self._children(a[s : s + 256], b[s : s + 256], len(self.n))
                    met = self._meet(x, y, self.points, self.n, self.n, self.part, np.ones(len(self.n), bool))
                    yield self.order[x[met]], self.order[y[met]]


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, limits: Limits, n: int) -> DataFrame:
    """The pairs of classes that link, as edges ``(u, v)``, by comparing their whole sets."""
    pairs = staged(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    reps = _few(staged(classes.join(needed, "class", "left_semi").select(F.col("rep").alias("row"), "class"), "reps"), BROADCAST_BUCKETS)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batched(((*key, own.tobytes()) for key, own in _sets(batches, n, ["class"])), ["class", "own"], 4_000_000)

    sets = rows.join(reps, "row").select("class", "text").mapInPandas(again, "class long, own binary").dropDuplicates(["class"])
    sets = staged(sets, "sets")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                ok.append(limits.enough(int((y[at] == x).sum()), len(x) + len(y)))
            yield pd.DataFrame({"u": batch["a"][ok], "v": batch["b"][ok]})

    met = pairs.join(sets.select(F.col("class").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("own").alias("y")), "b")
    return staged(met.select("a", "b", "x", "y").mapInPandas(compare, "u long, v long"), "links")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, all columns, of each component, and every row with an empty set.

    It is the row of the least id, null last, then of the least row key, then of the least other values.
    """
    rows = labelled_rows(docs, id_col=id_col, text_col=text_col, **options).where("n > 0")
    rows = staged(rows.groupBy("row").agg(F.min("label").alias("label"), F.min("id").alias("id"), F.count("*").alias("copies")), "rows")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("first.row")
    gone = _few(staged(rows.join(first, "row", "left_anti").select("row"), "gone"))
    twice = staged(rows.where("copies > 1").join(first, "row", "left_semi").select("row"), "twice")

    named = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, named, strict=True))
    kept = docs.toDF(*named).withColumn("row", _row_key(F.col(at[id_col]), F.col(at[text_col]))).join(gone, "row", "left_anti")
    if twice.isEmpty():
        return kept.select(*named).toDF(*docs.columns)
    twice = _few(twice)
    ordered = [c for c, f in zip(named, docs.schema, strict=True) if not re.search("map<|variant", f.dataType.simpleString())]  # the others have no order
    one = kept.join(twice, "row", "left_semi").groupBy("row").agg(F.min_by(F.struct(*named), F.struct(*ordered)).alias("kept")).select("kept.*")
    return kept.join(twice, "row", "left_anti").select(*named).unionByName(one).toDF(*docs.columns)


def _few(keys: DataFrame, most: int = BROADCAST_KEYS // 2) -> DataFrame:
    """The keys, to be broadcast unless they are many."""
    return F.broadcast(keys) if keys.count() <= most else keys
