"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared as word sequences (lower case, runs of
letters and digits). A tile is a stretch of at least ``least`` words that both hold; the
longest tile is marked first, marked words are not used again, and this goes on until no
tile is left. An item leaks into a document when its tiles cover at least ``coverage`` of
its words, in whatever order they stand there.

Pairs to tile are found by joining seeds: Karp-Rabin hashes of ``least`` words. The seeds of
a block of benchmark items (``block_words`` words at most) go to the executors, where each
document's rolling hashes are looked up in them; a larger benchmark takes several blocks, each
a pass over the documents, so what is sent is bounded whatever its size. Documents are never
shuffled.

Tiling doesn't list the places where seeds of the two meet, as texts that repeat themselves have
a square number of them. The greatest length at which unmarked windows of both still agree is found by running
Karp-Rabin hashes of the unmarked windows of a length, in steps that double going down from the last length and a
bisection of the last step; the windows of that length are marked from left to right, each at the first
place that is free. Tiles of ``m`` words have at most ``sqrt(2 m)`` different lengths, so that many rounds are
made at most; where lengths lie close together, a round tries one or two. The side with fewer windows is sorted. Every tile is
checked word by word, so a hash collision makes none.

Defined cases: null or wordless texts hold no seed and are clean; an item of fewer than
``least`` words is tiled with its own length and must be held whole; an item without words
is ignored; an empty benchmark leaves every document clean; repeated documents or items
are judged each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WORDS = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Modulus and bases of the hashes of windows of any length: two of 31 bits, as one number of 62.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_013)
#: Longer texts are split word by word instead of into a list of words.
LONG_CHARS = 1 << 20


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``k`` codes."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - k + 1, np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    for j in range(k):
        out = out * BASE + mixed[j : len(codes) - k + 1 + j]
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo the prime, kept for later calls."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), PRIME)) % np.uint64(PRIME)])
    _POWERS[base] = known
    return known[:n]


class Windows:
    """Running Karp-Rabin hashes of the windows of a code sequence, for any window length."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        c = (codes + 2).astype(np.uint64)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(c * _powers(b, self.n) % np.uint64(PRIME))]) for b in BASES]

    def of(self, length: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for base, sums in zip(BASES, self.sums, strict=True):
            part = (sums[places + length] - sums[places]) % np.uint64(PRIME)
            out = out << np.uint64(31) | part * _powers(pow(base, -1, PRIME), self.n)[places] % np.uint64(PRIME)
        return out


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values are among the others."""
    if not len(others):
        return np.zeros(len(values), bool)
    others = np.sort(others)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


def _free_runs(free: np.ndarray) -> np.ndarray:
    """For every place, how many unmarked words follow in a row."""
    at = np.arange(len(free))
    stop = np.where(free, len(free), at)
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def tiles(a: np.ndarray, b: np.ndarray, least: int, free_a: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(a, b, length)`` of ``a`` and ``b``; ``free_a``: the places of ``a`` that may be used.

    The longest match of unmarked words is marked first; ties go to the first place in
    ``a``, then ``b``.
    """
    free_a = np.ones(len(a), bool) if free_a is None else free_a.copy()
    free_b = np.ones(len(b), bool)
    in_a, in_b = Windows(a), Windows(b)
    made, most = [], min(len(a), len(b))
    while most >= least:
        run_a, run_b = _free_runs(free_a), _free_runs(free_b)
        most = min(most, int(run_a.max()), int(run_b.max()))

        def open_windows(length: int, run_a=run_a, run_b=run_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places of unmarked windows of ``a`` that ``b`` has too, and all of ``b``, with their hashes; those of ``b`` sorted by hash, then place."""
            i, j = (np.flatnonzero(r[: len(r) - length + 1] >= length) for r in (run_a, run_b))
            x, y = in_a.of(length, i), in_b.of(length, j)
            if len(x) < len(y):  # what is left of the longer side after this is sorted
                met = _among(y, x)
                j, y = j[met], y[met]
            order = np.argsort(y, kind="stable")
            j, y = j[order], y[order]
            met = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
            return i[met], x[met], j, y

        # The greatest length with a match: ``high`` has none above it, ``low`` has one or is too short.
        low, high, step = least - 1, most, 1
        at = high
        while low < high:
            if len((found := open_windows(at))[0]):
                low, met = at, found
            else:
                high = at - 1
            if low == least - 1:  # still going down
                step *= 2
                at = max(high - step + 1, least) if high >= least else high
            else:
                at = (low + high + 1) // 2
        if low < least:
            break
        i, x, j, y = met
        first, end = np.searchsorted(y, x).tolist(), np.searchsorted(y, x, side="right").tolist()
        next_of: dict[int, int] = {}  # by the first window of a hash, the first that is free
        upto = 0
        for at, begin, stop in zip(i.tolist(), first, end, strict=True):
            if at < upto:
                continue
            k = next_of.get(begin, begin)
            while k < stop and not (free_b[j[k]] and free_b[j[k] + low - 1]):  # marks of this round are of this length
                k += 1
            next_of[begin] = k
            if k < stop and (a[at : at + low] == b[j[k] : j[k] + low]).all():
                upto = at + low
                free_a[at:upto] = free_b[j[k] : j[k] + low] = False
                made.append((at, int(j[k]), low))
        most = low - 1
    return made


def _covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` places windows of ``k`` at these starts cover."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + k, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


class Seeds(NamedTuple):
    """The seeds of the items of one seed length: sorted hashes, and the items that have each."""

    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    items: np.ndarray

    def items_of(self, places: np.ndarray) -> np.ndarray:
        n = self.count[places]
        ends = np.cumsum(n)
        return np.unique(self.items[np.repeat(self.first[places] - (ends - n), n) + np.arange(ends[-1])])


class Item(NamedTuple):
    """An item's id, words as codes, seed length and the place of each of its windows among the seeds."""

    name: int
    codes: np.ndarray
    k: int
    places: np.ndarray


class Items:
    """A block of benchmark items: their words as codes and the index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.code: dict[str, int] = {}
        known = []
        for item, text in items:
            codes = np.array([self.code.setdefault(w, len(self.code)) for w in words(text)], np.int64)
            if len(codes):
                k = min(least, len(codes))
                known.append((item, codes, k, rolling(codes, k)))
        self.index: dict[int, Seeds] = {}
        for k in sorted({x[2] for x in known}):
            hashes = np.concatenate([x[3] for x in known if x[2] == k])
            owner = np.concatenate([np.full(len(x[3]), i) for i, x in enumerate(known) if x[2] == k])
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
            keys, first, count = np.unique(hashes[new], return_index=True, return_counts=True)
            self.index[k] = Seeds(keys, first, count, owner[new])
        self.items = [Item(name, codes, k, np.searchsorted(self.index[k].keys, h)) for name, codes, k, h in known]

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int, float, int]]:
        """``(item, share of its words, longest tile)`` of the items that leak into the text."""
        found = words(text) if len(text or "") < LONG_CHARS else (m[0] for m in WORDS.finditer(text.lower()))
        codes = np.fromiter((self.code.get(w, -1) for w in found), np.int64)
        run = np.cumsum(np.concatenate([[0], codes >= 0]))
        out = []
        for k, seeds in self.index.items():
            if len(codes) < k:
                continue
            at = np.flatnonzero(run[k:] - run[:-k] == k)  # windows of benchmark words only
            if not len(at):
                continue
            found = rolling(codes, k)[at]
            place = np.minimum(np.searchsorted(seeds.keys, found), len(seeds.keys) - 1)
            hit = seeds.keys[place] == found
            if not hit.any():
                continue
            at, place = at[hit], place[hit]
            held = np.unique(place)
            for i in seeds.items_of(held).tolist():
                name, own, _, places = self.items[i]
                if _covered(np.flatnonzero(np.isin(places, held)), k, len(own)).sum() < coverage * len(own):
                    continue  # all seeds together cover too little
                used = _covered(at[np.isin(place, places)], k, len(codes))
                kept = np.flatnonzero(used | np.concatenate([[False], used[:-1]]))  # each stretch and a word after it
                made = tiles(np.where(used[kept], codes[kept], -1), own, k, used[kept])
                share = sum(n for _, _, n in made) / len(own)
                if share >= coverage:
                    out.append((name, share, max(n for _, _, n in made)))
        return out


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of a bounded number of words; the driver holds one at a time."""
    block, held = [], 0
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1]) // 5 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 5,
    coverage: float = 0.5,
    block_words: int = 500_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: ``(id, leaked_items array<bigint>, coverage double, longest_tile int)``.

    ``keep``: further columns of ``docs`` to carry along. ``coverage`` of the result is the
    largest share over the leaked items, 0 for a clean document.
    """
    spark = docs.sparkSession
    keep = keep or []
    rows = bounded_batches(docs).select(id_col, text_col, *[c for c in keep if c not in (id_col, text_col)])
    found = rows.withColumns({"_items": F.array().cast("array<bigint>"), "_share": F.lit(0.0), "_tile": F.lit(0)})
    for block in _item_blocks(benchmark, item_col, item_text_col, block_words):
        sent = spark.sparkContext.broadcast(Items(block, least))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items = sent.value
            for batch in batches:
                seen = [items.leaks(x, coverage) for x in batch[text_col]]
                batch["_items"] = [[] if a is None else [*a, *sorted(x[0] for x in s)] for a, s in zip(batch["_items"], seen, strict=True)]
                batch["_share"] = [max([a, *(x[1] for x in s)]) for a, s in zip(batch["_share"], seen, strict=True)]
                batch["_tile"] = [max([a, *(x[2] for x in s)]) for a, s in zip(batch["_tile"], seen, strict=True)]
                yield batch

        found = found.mapInPandas(run, found.schema)
    return found.select(F.col(id_col), *[c for c in keep if c != id_col], F.col("_items").alias("leaked_items"), F.col("_share").alias("coverage"), F.col("_tile").alias("longest_tile"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with the columns they came with, into which no item leaks."""
    named = [f"c{i}" for i in range(len(docs.columns))]  # any names, clashing ones too
    text = docs.columns.index(options.pop("text_col", "text"))
    ident = docs.columns.index(options.pop("id_col", "doc_id"))
    found = find_leaks(docs.toDF(*named), benchmark, id_col=named[ident], text_col=named[text], keep=named, **options)
    return found.where(F.size("leaked_items") == 0).select(*named).toDF(*docs.columns)
