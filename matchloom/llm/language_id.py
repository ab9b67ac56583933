"""Language ID by prediction by partial matching (PPM) over bytes.

For each language a context tree holds, for contexts of up to ``order`` bytes, how often
each next byte followed. A text's code length under a language is the sum of the costs of
its bytes: the longest stored context gives the byte by its share of the counts, or an
escape and the next shorter context, down to a uniform code over all bytes (escape
estimator C). The statistics are frozen after training, so the cost of a byte depends on
the ``order`` bytes before it alone. The language with the shortest code wins.

Every language has a model of its own, with the contexts and followers that it holds alone:
sorted codes with their costs in bits. At most ``max_contexts`` contexts and
``max_followers`` followers are kept for each length of context (the most frequent), so a model takes
less than a megabyte, and 200 languages take less than 200. Models are fitted in tasks, one
language each, from a bounded sample: at most ``max_rows`` labelled rows a language,
chosen by a hash of id and text over the whole table, and of a long text a stretch of ``max_chars``
characters from a place that the hash gives. What reaches the driver, and is broadcast, are the models.

Prediction reads every byte of every text. The distinct runs of ``order + 1`` bytes of a stretch of
texts are costed once for every language, and the texts sum up the costs of their runs.

Defined cases: a null text or one without any letter gives ``und`` with score 0; with no
labelled rows at all every prediction is ``und``; equal code lengths go to the language
that sorts first; rows equal in id and text count once in training; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

UNKNOWN = "und"
MAX_CONTEXTS, MAX_FOLLOWERS = 8_000, 24_000
#: Bytes that are costed together.
STRETCH = 1 << 20
#: Cells of the table of costs that are summed at a time.
CELLS = 1 << 22
#: Bits of a byte by the uniform code.
PLAIN = 8.0


class Costs:
    """Codes and their costs in bits, looked up for many codes at once."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray) -> None:
        self.codes, self.bits = codes, bits.astype(np.float32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each code, and whether it is known."""
        if not len(self.codes):
            return np.zeros(len(codes), np.float32), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.bits[at], self.codes[at] == codes

    def pack(self) -> tuple[bytes, bytes]:
        return self.codes.astype("<u8").tobytes(), self.bits.astype("<f4").tobytes()


class LanguageModel:
    """``followers[k]``: costs of contexts of ``k`` bytes with a byte after them; ``escapes[k]``: of leaving them."""

    def __init__(self, followers: list[Costs], escapes: list[Costs]) -> None:
        self.followers, self.escapes = followers, escapes

    @property
    def order(self) -> int:
        return len(self.followers) - 1

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ``order + 1`` bytes after the others."""
        out, todo = np.zeros(len(runs), np.float32), np.arange(len(runs))
        for k in range(self.order, -1, -1):
            code = runs[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            bits, known = self.followers[k].find(code)
            out[todo[known]] += bits[known]
            todo, code = todo[~known], code[~known]
            bits, known = self.escapes[k].find(code >> np.uint64(8))
            out[todo[known]] += bits[known]
        out[todo] += np.float32(PLAIN)
        return out


def coded(raw: np.ndarray, length: int) -> np.ndarray:
    """Every run of ``length`` bytes as a number, by its last byte; ``raw`` has the bytes before the first one too."""
    out = np.zeros(max(0, len(raw) - length + 1), np.uint64)
    for j in range(length):
        out = out << np.uint64(8) | raw[j : j + len(out)]
    return out


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def train(texts: list[str], *, order: int = 3, max_contexts: int = MAX_CONTEXTS, max_followers: int = MAX_FOLLOWERS, least: int = 2) -> LanguageModel:
    """Fit the context tree of one language; contexts seen fewer than ``least`` times are not kept."""
    each = [b"\n" * order + bytes_of(t) for t in texts]
    raw = np.frombuffer(b"".join(each), np.uint8)
    own = np.concatenate([np.arange(len(x)) >= order for x in each])[order:]  # runs that end in a byte of a text
    followers, escapes = [], []
    for k in range(order + 1):
        runs = coded(raw[order - k :], k + 1)[own]
        code, count = np.unique(runs, return_counts=True)
        context, first, kinds = np.unique(code >> np.uint64(8), return_index=True, return_counts=True)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        kept = np.flatnonzero(total >= (least if k else 1))
        if len(kept) > max_contexts:
            kept = np.sort(kept[np.lexsort((context[kept], -total[kept]))[:max_contexts]])
        keeps = np.zeros(len(context), bool)
        keeps[kept] = True
        of = np.repeat(np.arange(len(context)), kinds)  # the context of each code
        whole = total + kinds
        escapes.append(Costs(context[kept], np.log2(whole[kept]) - np.log2(kinds[kept])))
        at = np.flatnonzero(keeps[of])
        if len(at) > max_followers:
            at = np.sort(at[np.lexsort((code[at], -count[at]))[:max_followers]])
        followers.append(Costs(code[at], np.log2(whole[of[at]]) - np.log2(count[at])))
    return LanguageModel(followers, escapes)


MODEL = "lang string, k int, follower_codes binary, follower_bits binary, context_codes binary, context_bits binary"


def training_sample(docs: DataFrame, trains: Column, *, id_col: str, text_col: str, lang_col: str, max_rows: int, max_chars: int) -> DataFrame:
    """About ``max_rows`` rows ``(lang, at, text)`` a language, spread over the table by the hash ``at`` of id and text."""
    text = F.col(text_col).cast("string")
    fit = docs.where(trains).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, F.col(id_col).cast("string")).alias("at"))
    fit = fit.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["c"] for r in fit.groupBy("lang").agg(F.approx_count_distinct("at").alias("c")).collect()}  # one row a language
    if not counts:
        return fit.limit(0)
    share = F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 1.3 * max_rows / max(c, 1)))))
    near = fit.where(F.shiftrightunsigned("at", 11) < share[F.col("lang")] * float(1 << 53))
    start = F.pmod(F.col("at"), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    near = near.withColumn("text", F.substring("text", start.cast("int"), F.lit(max_chars)))
    return near.groupBy("lang", "at").agg(F.first("text").alias("text"))


def fit_models(docs: DataFrame, trains: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, max_rows: int = 400, max_chars: int = 20_000, max_contexts: int = MAX_CONTEXTS, max_followers: int = MAX_FOLLOWERS) -> dict[str, LanguageModel]:
    """A model for each language of the labelled rows; a task fits one language from its bounded sample."""
    trains = F.lit(True) if trains is None else trains
    sample = training_sample(docs, trains, id_col=id_col, text_col=text_col, lang_col=lang_col, max_rows=max_rows, max_chars=max_chars)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values(["at"])["text"].tolist()[:max_rows]
        model = train(texts, order=order, max_contexts=max_contexts, max_followers=max_followers)
        out = [(rows["lang"].iloc[0], k, *f.pack(), *e.pack()) for k, (f, e) in enumerate(zip(model.followers, model.escapes, strict=True))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    parts: dict[str, dict[int, tuple[Costs, Costs]]] = {}
    for r in sample.groupBy("lang").applyInPandas(fit, MODEL).collect():  # bounded by the number of languages
        of = lambda codes, bits: Costs(np.frombuffer(codes, "<u8"), np.frombuffer(bits, "<f4"))
        parts.setdefault(r["lang"], {})[r["k"]] = (of(r["follower_codes"], r["follower_bits"]), of(r["context_codes"], r["context_bits"]))
    return {lang: LanguageModel(*map(list, zip(*(by[k] for k in sorted(by)), strict=True))) for lang, by in sorted(parts.items())}


def code_lengths(models: dict[str, LanguageModel], texts: list[bytes], stretch: int = STRETCH) -> np.ndarray:
    """Bits to code each text under each language."""
    every = list(models.values())
    order = every[0].order
    out = np.zeros((len(texts), len(every)))
    held: list[tuple[int, np.ndarray]] = []  # stretches of texts with the bytes before them
    size = 0

    def add_up() -> None:
        runs = np.concatenate([coded(raw, order + 1) for _, raw in held])
        distinct, place = np.unique(runs, return_inverse=True)
        costs = np.stack([m.costs(distinct) for m in every], axis=1)
        at, step = 0, max(1, CELLS // len(every))
        for i, raw in held:
            end = at + len(raw) - order
            for s in range(at, end, step):
                out[i] += costs[place[s : min(s + step, end)]].sum(0, dtype=np.float64)
            at = end

    for i, text in enumerate(texts):
        raw = np.frombuffer(b"\n" * order + text, np.uint8)
        for s in range(0, len(raw) - order, stretch):
            held.append((i, raw[s : s + stretch + order]))
            size += len(held[-1][1])
            if size >= stretch:
                add_up()
                held, size = [], 0
    if held:
        add_up()
    return out


def predict(models: dict[str, LanguageModel], texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
    """The columns ``lang_pred, score, bits_per_byte`` for a batch of texts."""
    names, told = list(models), np.flatnonzero(letters.to_numpy(bool)) if models else np.zeros(0, np.int64)
    lang, score, each = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
    if len(told):
        raw = [bytes_of(texts.iloc[i]) for i in told]
        bits = code_lengths(models, raw)
        best = bits.argmin(1)
        low = bits[np.arange(len(told)), best]
        lang[told] = [names[k] for k in best]
        score[told] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
        each[told] = low / np.array([len(x) for x in raw])
    made = pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": each}, index=texts.index)
    made["bits_per_byte"] = made["bits_per_byte"].astype("Float64")
    return made


def _letters(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def identify_language(docs: DataFrame, *, trains: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return ``(id, lang_pred, score, bits_per_byte)`` for every row of ``docs``; options as in ``fit_models``.

    ``trains`` tells which rows may be learned from (default: all labelled rows).
    ``score`` is the posterior of the winner when all languages are equally likely.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_models(docs, trains, id_col=id_col, text_col=text_col, **options))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[["id"]], predict(sent.value, batch["text"], batch["letters"])], axis=1)

    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _letters(text_col).alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, *, trains: Column | None = None, text_col: str = "text", raw_bits: float = PLAIN, **options) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all columns and ``lang_pred`` added.

    A row goes when its text is null or has no letter, or when the winning model takes
    ``raw_bits`` or more for a byte, no less than raw bytes. Without any labelled row nothing
    can be told, and every row with letters stays as ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_models(docs, trains, text_col=text_col, **options))
    named = [f"c{i}" for i in range(len(docs.columns))]  # any names, clashing ones too
    at = named[docs.columns.index(text_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = predict(sent.value, batch[at], batch["letters"])
            batch["letters"] = made["lang_pred"]
            yield batch[~(made["bits_per_byte"] >= raw_bits).fillna(False).astype(bool)]

    rows = bounded_batches(docs).toDF(*named)
    rows = rows.withColumn("letters", _letters(at)).where("letters")
    schema = rows.drop("letters").schema.add("letters", "string")
    return rows.mapInPandas(run, schema).toDF(*docs.columns, "lang_pred")
