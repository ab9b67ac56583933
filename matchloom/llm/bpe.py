"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split into words by the tokenizer's pattern. Every distinct word is merged once: a
worker keeps a table of the words that it has seen and of their ids, and the new words of
a block of documents are replayed together. All their bytes stand in one array of
symbols with links to the live neighbours. An inverted index leads from each mergeable pair
(by the rank of what it merges to) to the positions where it occurs. The ranks are replayed
in order for all words at once: the positions of a rank are merged, which touches only
their neighbours, and the pairs that arise are added to the index. Documents are then
written out from the word table.

A tokenizer library works word by word and always takes the lowest rank in the word. The
replay gives the same unless a merge brings up a pair of lower rank in its word; such
words are found in the replay and are done again one by one in that order.

The work has no shuffle, as merges never cross words. A block is bounded by the bytes of its
new words and by the number of words of its documents, which are held as numbers (one document
at least); the table is emptied when it holds too many words, or too many bytes of words and ids. So memory is bounded
whatever the table of documents holds, but for a single document's own size, and a lost task is redone alone.

Defined cases: null text is encoded as empty text (no ids); an empty text has no ids;
unpaired surrogates can't occur in Spark strings; repeated rows are encoded each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bytes of the new words of a block, words of its documents, and words that a worker's table keeps; all bound its memory.
BLOCK_BYTES, BLOCK_WORDS, TABLE_WORDS = 2_000_000, 4_000_000, 400_000
#: Bytes that the table keeps; of each word, and of each of its characters with the ids that it may take.
TABLE_BYTES, WORD_BYTES, CHAR_BYTES = 160_000_000, 160, 16
#: Longer texts are split word by word instead of into a list of words.
LONG_CHARS = 1 << 20
#: Ranks whose positions are sorted out of the index at a time.
BAND = 1024


class Ranks:
    """A rank file: token bytes to rank, and the ranks of token pairs by their bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.token = {r: t for t, r in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("a byte has no rank")
        self.names = list(map(str, range(max(self.token) + 1)))
        # Every pair of tokens that merges, as one sorted number, and the rank that it merges to.
        merged = [(self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        merged.sort()
        self.pair_keys = np.array([k for k, _ in merged], np.int64)
        self.pair_ranks = np.array([r for _, r in merged], np.int32)

    def pair(self, a: int, b: int) -> int:
        """The rank that two adjacent tokens merge to, or -1."""
        return self.rank.get(self.token[a] + self.token[b], -1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for arrays of tokens."""
        if not len(self.pair_keys):
            return np.full(len(a), -1, np.int32)
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def one_word(self, word: bytes) -> list[int]:
        """Merge a single word, lowest rank first and then leftmost."""
        ids = [int(self.byte[b]) for b in word]
        after, before, live = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= len(ids) or self.pair(ids[i], ids[j]) != r:
                continue
            ids[i], live[j], after[i] = r, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (s := self.pair(r, ids[after[i]])) >= 0:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := self.pair(ids[before[i]], r)) >= 0:
                heapq.heappush(heap, (s, before[i]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]


def _sorted_once(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class PairIndex:
    """The inverted index: positions by the rank of the pair that begins there, taken out in order of rank.

    Positions of a band of ranks are sorted when the replay comes to the band; those of later
    bands wait as they came.
    """

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []  # positions and ranks beyond the band
        self.upto = 0  # end of the band
        self.ranks: list[int] = []  # heap of the ranks of the band
        self.parts: dict[int, list[np.ndarray]] = {}

    def add(self, left: np.ndarray, rank: np.ndarray) -> None:
        later = rank >= self.upto
        if later.any():
            self.waiting.append((left[later], rank[later]))
            left, rank = left[~later], rank[~later]
        if len(left):
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(left)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(rank[a])
                if r not in self.parts:
                    self.parts[r] = []
                    heapq.heappush(self.ranks, r)
                self.parts[r].append(left[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, sorted and each once; None at the end. Every ``add`` gives sorted positions."""
        while not self.ranks:
            if not self.waiting:
                return None
            both = _sorted_once(np.concatenate([left.astype(np.int64) << 32 | rank for left, rank in self.waiting]))
            self.waiting = []
            rank = (both & 0xFFFFFFFF).astype(np.int32)
            self.upto = int(rank.min()) // BAND * BAND + BAND
            self.add((both >> 32).astype(np.int32), rank)
        r = heapq.heappop(self.ranks)
        parts = self.parts.pop(r)
        return r, parts[0] if len(parts) == 1 else _sorted_once(np.concatenate(parts))


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and how many each has, by replaying the merges over all words together."""
    whole = np.array([ranks.rank.get(w, -1) for w in words], np.int32)  # words that are tokens
    rest = np.flatnonzero(whole < 0)
    length = np.ones(len(words), np.int64)
    if not len(rest):
        return whole, length
    size = np.array([len(words[i]) for i in rest], np.int64)
    ids = ranks.byte[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)].astype(np.int32)
    n, start = len(ids), np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(rest), dtype=np.int32), size)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[start[1:] - 1] = n  # n: no neighbour
    before[start[:-1]] = -1
    live = np.ones(n, bool)
    merges_to = np.full(n, -1, np.int32)  # by the position where a pair begins
    odd = np.zeros(len(rest), bool)
    index = PairIndex()

    def add(left: np.ndarray, now: int) -> None:
        """Index the pairs that begin at these positions; ``now``: the rank just merged."""
        rank = ranks.pairs(ids[left], ids[after[left]])
        merges_to[left] = rank
        known = rank >= 0
        left, rank = left[known], rank[known]
        odd[owner[left[rank < now]]] = True
        index.add(left, rank)

    add(np.flatnonzero(after < n).astype(np.int32), -1)
    while (found := index.pop()) is not None:
        r, at = found
        at = at[live[at] & (merges_to[at] == r)]
        if not len(at):
            continue
        chained = after[at[:-1]] == at[1:]
        if chained.any():  # of overlapping pairs, as in "aaa", every second one counts, from the left
            chained = np.concatenate([[False], chained])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        live[gone] = False
        ids[at] = r
        follow = after[gone]
        after[at] = follow
        merges_to[at] = -1
        has = follow < n
        before[follow[has]] = at[has]
        prior = before[at]
        add(_sorted_once(np.concatenate([at[has], prior[prior >= 0]])), r)
    kept = np.add.reduceat(live, start[:-1], dtype=np.int64)
    again = {int(k): ranks.one_word(words[rest[k]]) for k in np.flatnonzero(odd)}
    for k, found in again.items():
        kept[k] = len(found)
    length[rest] = kept
    flat = np.zeros(int(length.sum()), np.int32)
    begin = np.cumsum(length) - length
    flat[begin[whole >= 0]] = whole[whole >= 0]
    plain = live & ~odd[owner]
    of = owner[plain]
    first = np.searchsorted(of, np.arange(len(rest)))  # place of each word's first id among the plain ones
    flat[begin[rest][of] + np.arange(len(of)) - first[of]] = ids[plain]
    for k, found in again.items():
        flat[begin[rest[k]] : begin[rest[k]] + len(found)] = found
    return flat, length


class Numbers(dict):
    """Words to numbers in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.fresh_bytes = self.bytes = 0

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self.fresh_bytes += len(word)
        self.bytes += WORD_BYTES + CHAR_BYTES * len(word)
        number = self[word] = len(self)
        return number


class Words:
    """A worker's table of distinct words: their numbers, and the ids of those replayed so far."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def replay(self, ranks: Ranks) -> None:
        if self.number.fresh:
            flat, size = replay([w.encode("utf-8") for w in self.number.fresh], ranks)
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.number.fresh, self.number.fresh_bytes = [], 0
        self.start = np.cumsum(self.size) - self.size

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words, one list after the other."""
        n = self.size[words]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[words] - (ends - n), n) + np.arange(total)]


_LOADED: dict[tuple[str, str], tuple[Ranks, Words]] = {}


def _ranks(path: str, pattern: str) -> Ranks:
    """The rank file, read once for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = (Ranks(path, pattern), Words())
    return _LOADED[path, pattern][0]


def encode(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Return ``(id, ids)``: the token ids of every text. The rank file must be on every executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, lists in encoded(batches, path, pattern, block_bytes):
            yield pd.DataFrame({"id": keys, "ids": lists})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>")


def encoded(batches: Iterator[pd.DataFrame], path: str, pattern: str, block_bytes: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids of the documents of each block, some hundred documents at a time."""
    ranks = _ranks(path, pattern)
    table = _LOADED[path, pattern][1]
    keys, coded, held = [], [], 0

    def block() -> Iterator[tuple[list, list[np.ndarray]]]:
        table.replay(ranks)
        for a in range(0, len(keys), 256):
            yield keys[a : a + 256], [table.ids(w) for w in coded[a : a + 256]]
        keys.clear()
        coded.clear()
        if len(table.number) > TABLE_WORDS or table.number.bytes > TABLE_BYTES:
            table.__init__()

    for batch in batches:
        for key, text in zip(batch["id"], batch["text"], strict=True):
            text = text or ""
            found = ranks.pattern.findall(text) if len(text) < LONG_CHARS else (m[0] for m in ranks.pattern.finditer(text))
            keys.append(key)
            coded.append(np.fromiter(map(table.number.__getitem__, found), np.int32))
            held += len(coded[-1])
            if table.number.fresh_bytes >= block_bytes or held >= BLOCK_WORDS:
                yield from block()
                held = 0
    if keys:
        yield from block()


def decode(encoded_docs: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """Return ``(id, bytes)`` for rows of ``(id, ids)``; ids that are not in the file raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = _ranks(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "bytes": [b"".join(map(ranks.token.__getitem__, () if x is None else x.tolist())) for x in batch["ids"]]})

    kind = encoded_docs.schema["id"].dataType.simpleString()
    return encoded_docs.select("id", "ids").mapInPandas(run, f"id {kind}, bytes binary")


def digests(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode and decode every text and keep digests: ``(id, n_tokens, ids_sha256, decoded_sha256)``.

    The same as :func:`encode` then :func:`decode`, without carrying the ids through the JVM.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = _ranks(path, pattern)
        text, name = ranks.token.__getitem__, ranks.names.__getitem__
        for keys, lists in encoded(batches, path, pattern, block_bytes):
            rows = []
            for ids in lists:
                ids = ids.tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(text, ids))).hexdigest()))
            yield pd.DataFrame({"id": keys, "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
