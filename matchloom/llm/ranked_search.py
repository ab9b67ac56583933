"""Ranked lexical search: posting lists under range-maximum tables, searched by intervals of documents, best first.

A document becomes its terms with their counts once (``forward``). Corpus figures come from that
table by aggregates. Then blocks of items meet groups of documents in a cogroup. A task inverts its
group: for each term of the block the documents that hold it, by id, with what the term adds to
their scores, and over all lists a sparse table that names the largest addition in any stretch of a list.

An item starts with the whole group as one interval of documents. No document in an interval can score more than the
sum, over the item's terms, of the largest addition in the interval, which the table tells in constant time. The
intervals with the greatest bounds are taken first: each is split at the document of its largest
addition, which is scored, and both sides get bounds of their own; intervals of ``LEAF`` documents or fewer are
scored whole. Intervals whose bound can't enter the best ``k`` go, so the result is exact. The groups' best are merged.

Arithmetic is in 64-bit integers but for the weights' logarithm. Texts without terms, null ones too, take no part and
are not counted. Items that share an id are one item with the terms of all; an item without terms, or whose terms
no document holds, has no rows. Equal scores go by ascending document id, null ids last; rows that share an id
take a rank each. Memory: a group has about ``GROUP_TERMS`` terms of documents, a block about ``BLOCK_TERMS`` of items.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, slices, staged

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
GROUP_TERMS, BLOCK_TERMS, SLICE_BYTES = 2_000_000, 200_000, 8_000_000
#: Intervals taken at a time, and the documents that an interval must have to be split.
TAKEN, LEAF = 128, 16


def forward(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, counts)`` of every row with a term: the number of its terms, the distinct ones and how often each occurs."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                held = [Counter(TERM.findall(t.translate(LOWER))) if t else {} for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part["id"],
                        "n": pa.array([sum(h.values()) for h in held], pa.int64()),
                        "terms": pa.array([list(h) for h in held], pa.list_(pa.string())),
                        "counts": pa.array([list(h.values()) for h in held], pa.list_(pa.int32())),
                    }
                )

    rows = bounded_batches(rows).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, terms array<string>, counts array<int>").where("n > 0")


class Postings:
    """Posting lists of a group, one after the other by term, then by document; and the places of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        order = np.argsort(term, kind="stable")  # within a term by document, as they come
        self.doc, self.impact, self.docs = doc[order], np.append(impact[order], 0), docs  # the last place stands for none
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        size, longest = len(term), int(np.diff(self.starts).max(initial=0))
        self.table = [np.arange(size, dtype=np.int32)]
        for level in range(1, longest.bit_length()):
            a, b = self.table[-1][: -(1 << level - 1)], self.table[-1][1 << level - 1 :]
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))
        #: Levels one after the other, so that a look-up takes an index and no loop.
        self.at = np.cumsum([0, *(len(t) for t in self.table)])
        self.flat = np.concatenate(self.table) if size else np.zeros(1, np.int32)
        self.level = np.zeros(longest + 1, np.int64)
        for level in range(1, longest.bit_length()):
            self.level[1 << level :] = level

    def places(self, terms: np.ndarray) -> np.ndarray:
        """For each term a row: at ``d`` the place in its list of its first document from ``d`` on."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        held = np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows = np.zeros((len(terms), self.docs + 1), np.int32)
        rows[np.repeat(np.arange(len(terms)), sizes), self.doc[held] + 1] = 1
        return np.cumsum(rows, axis=1, dtype=np.int32, out=rows) + self.starts[terms].astype(np.int32)[:, None]

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest addition between places ``a`` and ``b`` of one list; the last place if there is none."""
        level = self.level[b - a]
        left = self.flat[self.at[level] + a] if len(self.flat) > 1 else np.zeros_like(a)
        right = self.flat[np.maximum(self.at[level] + b - (1 << level), 0)]
        best = np.where(self.impact[right] > self.impact[left], right, left)
        return np.where(b > a, best, len(self.impact) - 1)


def best_documents(lists: Postings, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores above 0 and documents of the ``k`` best, best first, equal scores by document; and how many documents were scored."""
    places, last = lists.places(terms), len(lists.impact) - 1
    scores = docs = np.zeros(0, np.int64)
    scored = 0

    def bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval and the document of its largest addition."""
        at = lists.largest(places[:, low], places[:, high])
        each = lists.impact[at]
        peak = at[np.argmax(each, axis=0), np.arange(len(low))]
        return each.sum(axis=0), lists.doc[np.minimum(peak, last - 1)] if last else low

    def score(at: np.ndarray) -> None:
        nonlocal scores, docs, scored
        a = places[:, at]
        found = lists.impact[np.where(places[:, at + 1] > a, a, last)].sum(axis=0)
        scored += len(at)
        scores, docs = np.concatenate([scores, found[found > 0]]), np.concatenate([docs, at[found > 0]])
        order = np.lexsort([docs, -scores])[:k]
        scores, docs = scores[order], docs[order]

    low, high = np.array([0]), np.array([lists.docs])
    bound, split = bounds(low, high)
    while len(low):
        if len(scores) == k:
            may = (bound > scores[-1]) | ((bound == scores[-1]) & (low < docs[-1]))
        else:
            may = bound > 0
        low, high, bound, split = low[may], high[may], bound[may], split[may]
        if not len(low):
            break
        if len(low) > TAKEN:
            order = np.argpartition(-bound, TAKEN)
            now, later = order[:TAKEN], order[TAKEN:]
        else:
            now, later = np.arange(len(low)), np.zeros(0, np.int64)
        small = high[now] - low[now] <= LEAF
        leaf, cut = now[small], now[~small]
        sizes = high[leaf] - low[leaf]
        inside = np.repeat(low[leaf] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        score(np.concatenate([inside, split[cut]]))
        new_low, new_high = np.concatenate([low[cut], split[cut] + 1]), np.concatenate([split[cut], high[cut]])
        some = new_low < new_high
        new_low, new_high = new_low[some], new_high[some]
        new_bound, new_split = bounds(new_low, new_high)
        low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
        bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
    return scores, docs, scored


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    group_terms: int = GROUP_TERMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Return ``(item_id, rank, id, score)``: the ``k`` highest-scoring documents of each item."""
    held = staged(forward(docs, id_col, text_col), "forward")
    told = held.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = told["N"], max(told["L"], 1)
    asked = staged(forward(items, item_col, item_text_col).select(F.col("id").alias("item"), F.explode("terms").alias("term")).distinct(), "item-terms")
    words = asked.select("term").distinct()
    often = held.select(F.explode("terms").alias("term")).join(words, "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)) * 1000.0).cast("long")
    weighed = staged(asked.join(often.select("term", weight.alias("weight")), "term").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t")), "items")
    weighed = weighed.select("item", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["weight"]).alias("weights"))

    groups = max(1, -(-told["terms"] // group_terms))
    blocks = max(1, -(-weighed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // block_terms))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).withColumn("group", spread(groups))
    # Lengths against the mean, in hundredths.
    length = F.expr(f"10L + (90L * n * {n_docs}L) div {n_terms}L")
    right = held.select("id", length.alias("m"), "terms", "counts").withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")).withColumn("block", spread(blocks))
    item_kind, id_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.take(pc.sort_indices(theirs["id"], null_placement="at_end")).combine_chunks()
        words = ours["terms"].combine_chunks().flatten()
        known = words.unique()
        weights = np.zeros(len(known), np.int64)
        own = pc.index_in(words, known).to_numpy()
        weights[own] = ours["weights"].combine_chunks().flatten().to_numpy()
        lists = theirs["terms"].combine_chunks() if len(theirs) else pa.array([], pa.list_(pa.string()))
        term = pc.index_in(lists.flatten(), known)
        used = pc.is_valid(term).to_numpy(zero_copy_only=False)
        term = pc.fill_null(term, 0).to_numpy()[used]
        doc = pc.list_parent_indices(lists).to_numpy()[used]
        tf = theirs["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)[used] if len(theirs) else np.zeros(0, np.int64)
        m = theirs["m"].to_numpy()
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        postings = Postings(term, doc, impact, len(known), len(theirs))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ours["terms"]).to_numpy())])
        made = [best_documents(postings, own[a:b], k) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        whose = np.repeat(np.arange(len(ours)), [len(s) for s, _, _ in made])
        return pa.table({"item": ours["item"].take(pa.array(whose)), "id": theirs["id"].take(pa.array(joined([d for _, d, _ in made]))), "score": joined([s for s, _, _ in made])})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, f"item {item_kind.simpleString()}, id {id_kind.simpleString()}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "id", "score")
