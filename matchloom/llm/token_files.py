"""Token ids as Parquet files: list columns under a dictionary, delta-coded numbers, and pages that can be read alone.

A file holds the documents of one range of ids in ascending order, a row each: ``id``, ``shard``
(the number of the file), ``at`` (ids of the documents before it in the file), ``n_tokens`` and ``ids``. Beside
them lies a table with a row for each file: where its ids begin among all. So a document's
``start`` is known without a second pass over what was written.

* ``ids`` is a list column under a dictionary: two bytes or less an id. The numbers are delta-coded.
* Row groups hold ``row_group_bytes``, pages ``page_bytes`` or ``page_rows`` rows; column and offset indexes tell what
  each page holds. Readers that want numbers alone never touch the pages of ids, and a range of
  documents or of places reads only the pages that it meets.

Texts are cut by ranges of ids before they are encoded, so ids are never shuffled; the task that
sorts a range encodes it, counts and writes it. Rows of one id, and equal rows, are dealt by their
text and their place in the input, so no id fills one task by itself.

A null text is an empty one: the end id alone. Null ids come first; rows that share an id follow each
other in an order that their texts decide. An empty table gives no rows. Words reach the
tokenizer once for each worker while they fit a table of ``TABLE_BYTES``, which starts anew when it is full.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, new_folder, slices

SLICE_BYTES, TABLE_BYTES, LONGEST, LINES = 4_000_000, 128_000_000, 64, 4096
#: Words that the model gets as one text (longer ones take longer a word), and characters of texts that are encoded together.
CHUNK, BLOCK_CHARS = 32, 400_000
#: About what Python keeps for an entry of the table beside its characters and ids.
ENTRY_BYTES = 160
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 1024


# How byte-level vocabularies spell bytes. Those with a visible sign in Latin-1 stand for themselves, the others follow from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Marks that are neither letters, digits nor white space; the last letter of the Latin blocks.
MARKS, LAST_LATIN = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u024f"


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, as little-endian 32-bit numbers.

    A byte-level tokenizer without normalizer cuts a text before every single space, around every
    single line feed between characters that are no white space, and between letters and marks. What lies between is
    encoded once: words of Latin letters by the tokenizer's model, many at a time, and those with marks behind them as the same
    word and its marks; other new words by the tokenizer, as lines of one text. Lines with other white space are encoded whole, as are texts for other tokenizers, and those that
    contain a special token. A table that is full keeps the words of the last texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        plain = not any(told.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        (line_feed,) = self._whole(["\n"])
        self.cuts = plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and len(line_feed) == 4
        self.line_feed = line_feed
        #: The model under lines of spelt words, where a word after a space always begins with a token that begins with the space; which tokens do.
        self.lines, self.leads = None, np.zeros(0, bool)
        model, space = told["model"], " ".translate(ALPHABET)
        if model.get("type") == "BPE" and space in model["vocab"] and not any(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            self.lines = Tokenizer(self.tokenizer.model)
            self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            self.leads = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.leads[[k for token, k in model["vocab"].items() if token.startswith(space)]] = True
        #: Ids of words at the beginning of a line, and after a space.
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str | list[str]]:
        """Lines that the tokenizer never joins: as words that single spaces part, or whole."""
        if not self.cuts or any(s in text for s in self.special):
            return [text]
        lines: list[str] = []
        before = ""
        for k, line in enumerate(text.split("\n")):
            if k == 0 or before and line and not before[-1].isspace() and not line[0].isspace():
                lines.append(line)
            else:
                lines[-1] += "\n" + line
            before = line
        return [words if (words := line.split()) and " ".join(words) == line else line for line in lines]

    def _learn(self, table: dict[str, bytes], words: set[str], lead: str) -> list[str]:
        """Encode new words; return those too long to be kept."""
        new = [w for w in words if w not in table]
        bare, tailed, others = [], [], []
        for w in new:
            stem = w.rstrip(MARKS)
            if not stem.isalpha() or not stem.isascii() and max(stem) > LAST_LATIN:
                others.append(w)
            elif len(stem) == len(w):
                bare.append(w)
            else:
                tailed.append((w, stem))
        table.update(self._modelled(bare, lead))
        alone = self._modelled([stem for stem in {stem for _, stem in tailed} if stem not in table], lead)
        for w, stem in tailed:
            tail = w[len(stem) :]
            if tail not in self.tails:
                (self.tails[tail],) = self._whole([tail])
            table[w] = (alone[stem] if stem in alone else table[stem]) + self.tails[tail]
        for s in range(0, len(others), LINES):
            some = others[s : s + LINES]
            ids = np.frombuffer(self._whole(["\n".join([lead + w for w in some])])[0], "<u4")
            ends = [*np.flatnonzero(ids == np.frombuffer(self.line_feed, "<u4")).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                table[w] = raw[4 * at : 4 * end]
                at = end + 1
        self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, map(table.__getitem__, new)))
        return [w for w in new if len(w) > LONGEST]

    def _modelled(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of words of letters, each one word to the tokenizer."""
        sign, out = lead.translate(ALPHABET), {}
        for s in range(0, len(words), LINES):
            some = words[s : s + LINES]
            spelt = [sign + (w if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET)) for w in some]
            ids: list[int] = []
            if lead and self.lines is not None:
                for x in self.lines.encode_batch_fast(["\n".join(spelt[k : k + CHUNK]) for k in range(0, len(spelt), CHUNK)], add_special_tokens=False):
                    ids += x.ids
                raw = np.array(ids, "<u4")
                ends = [*np.flatnonzero(self.leads[raw]).tolist()[1:], len(ids)]
            else:
                ends = []
                for w in spelt:
                    ids += [x.id for x in self.tokenizer.model.tokenize(w)]
                    ends.append(len(ids))
                raw = np.array(ids, "<u4")
            at, held = 0, raw.tobytes()
            for w, end in zip(some, ends, strict=True):
                out[w] = held[4 * at : 4 * end]
                at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        inner: set[str] = set()
        firsts: set[str] = set()
        out: list[bytes] = []
        some, size = [], 0
        for k, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size > BLOCK_CHARS or k == len(texts) - 1:
                out += self._block(some, inner, firsts)
                some, size = [], 0
        if self.held > TABLE_BYTES:
            last = [(self.spaced, inner), (self.first, firsts)]
            self.spaced, self.first = ({w: table[w] for w in words if w in table} for table, words in last)
            self.tails = {"": b""}
            self.held = sum(ENTRY_BYTES + len(w) + len(ids) for table in (self.spaced, self.first) for w, ids in table.items())
            if self.held > TABLE_BYTES // 2:
                self.spaced, self.first, self.held = {}, {}, 0
        return out

    def _block(self, texts: list[str], inner: set[str], firsts: set[str]) -> list[bytes]:
        """Ids of a few texts; add their words to ``inner``, and those at the beginning of a line to ``firsts``."""
        cut = [self.parts(t) for t in texts]
        lines = [x for parts in cut for x in parts if isinstance(x, list)]
        whole = list({x for parts in cut for x in parts if isinstance(x, str)})
        once = dict(zip(whole, self._whole(whole), strict=True))
        begin = {x[0] for x in lines}
        spaced = set().union(*[x[1:] for x in lines])
        long = [(self.spaced, self._learn(self.spaced, spaced, " ")), (self.first, self._learn(self.first, begin, ""))]
        out, find = [], self.spaced.__getitem__
        for parts in cut:
            made: list[bytes] = []
            for k, x in enumerate(parts):
                if k:
                    made.append(self.line_feed)
                if isinstance(x, str):
                    made.append(once[x])
                else:
                    made.append(self.first[x[0]])
                    made += map(find, x[1:])
            out.append(b"".join(made))
        for table, words in long:
            for w in words:
                self.held -= ENTRY_BYTES + len(w) + len(table.pop(w))
        inner |= spaced
        firsts |= begin
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of this tokenizer; one is kept."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    *,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> str:
    """Encode every whole text, close it with ``end_id``, write all in ascending order of ids; return the folder.

    There are as many files as the session's shuffles have partitions, or fewer where Spark joins small ones.
    """
    path = path or new_folder(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = {"_same": F.xxhash64("text"), "_place": F.monotonically_increasing_id()}
    order = ["id", *keys]
    rows = bounded_batches(rows).withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.spark_partition_id().alias("shard"), "text")
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = [x + end for x in _encoder(tokenizer).encode(part["text"].to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
                yield pa.RecordBatch.from_pydict({"id": part["id"], "shard": part["shard"], "at": pa.array(at + ends - n), "n_tokens": pa.array(n), "ids": lists})
                at += int(ends[-1])

    made = rows.mapInArrow(run, f"id {kind}, shard int, at long, n_tokens long, ids array<int>")
    options = {
        "parquet.writer.version": "PARQUET_2_0",  # delta codes for numbers
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "compression": "zstd",
    }
    made.write.options(**options).parquet(f"{path}/tokens")
    # Numbers alone are read back; a row a file remains.
    files = docs.sparkSession.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/files")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)``: ``start`` counts the ids of all documents before it. Columns that aren't asked for aren't read."""
    files = spark.read.parquet(f"{path}/files").select("shard", "base")  # a row a file
    rows = spark.read.parquet(f"{path}/tokens").join(F.broadcast(files), "shard")
    return rows.select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, first: int, upto: int) -> DataFrame:
    """``(start, ids)`` of the documents with ids at the places ``first`` to ``upto - 1``, cut to these; other files and pages aren't read."""
    files = spark.read.parquet(f"{path}/files").where((F.col("base") < upto) & (F.col("base") + F.col("tokens") > first))
    met = {r["shard"]: r["base"] for r in files.select("shard", "base").collect()}  # a number for each file that the span meets
    rows = spark.read.parquet(f"{path}/tokens")
    if not met:
        return rows.where("false").select(F.col("at").alias("start"), "ids")
    least, most = min(met), max(met)
    # Only the first and the last file are cut: their pages are chosen by ``at``, those between are read whole.
    inside = (F.col("shard") > least) & (F.col("shard") < most)
    low, high = (F.col("shard") == least), (F.col("shard") == most)
    after, ahead = F.col("at") + F.col("n_tokens") > first - met[least], F.col("at") < upto - met[most]
    chosen = (low & high & after & ahead) if least == most else inside | (low & after) | (high & ahead)
    rows = rows.where(F.col("shard").between(least, most) & chosen)
    bases = spark.read.parquet(f"{path}/files").select("shard", "base")
    start = F.col("base") + F.col("at")
    lead = F.greatest(F.lit(first) - start, F.lit(0))
    kept = F.least(F.col("n_tokens"), F.lit(upto) - start) - lead
    return rows.join(F.broadcast(bases), "shard").select((start + lead).alias("start"), F.slice("ids", (lead + 1).cast("int"), kept.cast("int")).alias("ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``, the last two of the ids themselves."""
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            ends = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "start": batch["start"], "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(sums, pa.int64())})

    return bounded_batches(tokens).select("id", "start", "ids").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
