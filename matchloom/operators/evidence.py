"""Evidence: one table of weighted rules that gives the score and explains it.

Every rule tells when it speaks for a candidate and when against it. The score of a pair, its
list of matched fields and its list of conflicts are all made from the same rules. Lists are built for the few candidates
that are shown.

A specification search finds thousands of rows for a key, and many items share a key. For the best of them (``best``) not every pair
is scored: a key's rows are grouped by their signature, what the rules that any item asks for
read of a row; each item meets each signature once, and of a signature only the first ids go on.

Items of a key that are alike in all that rules read are scored once.

A strict identifier may stand in many rows and be asked for by many items. Of a key with many pairs, lists of rows meet lists of items:
each rule is worked out once for the distinct values that it compares there, and a pair's score is a sum of these (``_first_of_lists``).
Only the first rows of an item leave the list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import features
from ..functions.text import contains_either
from ..stage import large, staged
from .candidates import PART_QUESTIONS, SPEC_KEYS, STRICT_KEYS, Found, deal, part_of, parted

# What a candidate gets for how it was found.
IDENTIFIER_WEIGHTS = {"hinban+kidou": 100, "full_code": 100, "hinban": 75, "public_model_code": 90, "relaxed_identifier": 60, "partial_identifier": 35, "spec_candidate": 0}
# Weights of the text rules; a conflict costs half the weight, five at most.
TEXT_WEIGHTS = {"category": 12, "style": 4, "key_hint": 18, "brightness": 10, "fixture_size": 14, "cutout_size": 18, "y_toukyu": 10, "y_toritsuke": 10, "y_hyoujimen": 10, "y_kinou": 10}
SIMILARITY_WEIGHT = 25

EVIDENCE = (
    "field string, match_type string, input_text string, db_text string, input_list array<string>, db_list array<string>, "
    "input_num double, db_num double, input_range array<double>, db_range array<double>, db_values map<string,string>, ratio double, weight double"
)
LIFECYCLE = ("discontinued", "planned_discontinued")


@dataclass
class Rule:
    """``asked``: the item says what the rule is about; ``asks`` and ``reads``: the columns of the item and of the catalogue that it looks at."""

    field: str
    asked: Column
    asks: tuple[str, ...]
    reads: tuple[str, ...]
    matched: Column
    conflict: Column
    weight: float
    penalty: float
    shown: dict[str, Column]


def entry(field: str, weight: Column | float | None = None, only: tuple[str, ...] | None = None, **slots: Column) -> Column:
    """An evidence element; slots that aren't named are null. ``only``: the slots that it has, if not all."""
    kinds = dict(x.rsplit(" ", 1) for x in EVIDENCE.split(", "))
    values = slots | {"field": F.lit(field)} | ({} if weight is None else {"weight": weight if isinstance(weight, Column) else F.lit(float(weight))})
    return F.struct(*(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items() if only is None or k in only))


def pairs_with_rows(pairs: DataFrame, items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Item columns as ``i_*`` and catalogue columns as ``c_*`` beside each pair."""
    i = as_asked(items)
    c = catalogue.select(*(F.col(c).alias(f"c_{c}") for c in catalogue.columns))
    return pairs.join(large(c), pairs["id"] == c["c_id"]).join(large(i), pairs["item_key"] == i["i_item_key"])


def rules(c: Callable[[str], Column] = lambda n: F.col(f"c_{n}"), i: Callable[[str], Column] = lambda n: F.col(f"i_{n}"), only: list[int] | None = None) -> list[Rule]:
    """The rules beside the identifier, in the order in which they are listed; ``c`` and ``i``: where a column of the catalogue or of the item is found; ``only``: some of them, by place."""
    groups, keys = ("kigugroup_norm", "t_kigugroup_norm"), ("key_norm", "view_key_norm")
    actual: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
        "category": (lambda: F.when(c("kigugroup_norm") != "", c("kigugroup_norm")).otherwise(c("t_kigugroup_norm")), groups),
        "style": (lambda: c("kigustyle_norm"), ("kigustyle_norm",)),
        "key_hint": (lambda: F.concat(c("key_norm"), c("view_key_norm")), keys),
        "brightness": (lambda: F.concat(c("brightness_norm"), c("key_norm"), c("view_key_norm")), ("brightness_norm", *keys)),
        **{k: (partial(c, f"{k}_norm"), (f"{k}_norm",)) for k in ("fixture_size", "cutout_size", "y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou")},
    }

    def words(field: str, weight: float) -> Rule:
        left, right = i(field), actual[field][0]()
        both, holds = (left != "") & (right != ""), contains_either(left, right)
        return Rule(field, left != "", (field,), actual[field][1], holds, both & ~holds, weight, min(5.0, weight / 2), {"input_text": left, "db_text": right})

    # Tolerances, weights and penalties of the rules below.
    def mounting() -> Rule:
        left, right = i("mounting"), c("mounting_norm")
        both, shared = (F.size(left) > 0) & (F.size(right) > 0), F.arrays_overlap(left, right)
        return Rule("mounting", F.size(left) > 0, ("mounting",), ("mounting_norm",), both & shared, both & ~shared, 14, 7, {"input_list": left, "db_list": right})

    def water() -> Rule:
        left, right = i("waterproof"), c("wet_combined_norm")
        fits = features.water_compatible(left, right)
        shown = {"input_text": left, "db_text": right}
        return Rule("waterproof", left != "unknown", ("waterproof",), ("wet_combined_norm",), F.coalesce(fits, F.lit(False)), F.coalesce(~fits, F.lit(False)), 14, 12, shown)

    def water_conflict() -> Rule:
        left, right = i("waterproof"), c("wet_combined_norm")
        known = left != "unknown"
        raw = F.when(right == "conflict", F.create_map(F.lit("boushitsu_bouu"), c("boushitsu_bouu"), F.lit("t_kinou"), c("t_kinou")))
        return Rule("waterproof", known, ("waterproof",), ("wet_combined_norm",), F.lit(False), known & (right == "conflict"), 0, 0, {"input_text": left, "db_text": right, "db_values": raw})

    def dimming() -> Rule:
        left, right = i("dimming"), c("dimming_norm")
        both = (left != "unknown") & (right != "unknown")
        return Rule("dimming", left != "unknown", ("dimming",), ("dimming_norm",), both & (left == right), both & (left != right), 14, 12, {"input_text": left, "db_text": right})

    def number(field: str, hint: str, near: float, far: float, weight: float, penalty: float, least: float | None) -> Rule:
        left, right = i(field), c(hint)
        apart = F.abs(right - left)
        if least is not None:  # relative to the asked value
            apart = apart / F.greatest(left, F.lit(least))
        known = left.isNotNull() & right.isNotNull()
        return Rule(field, left.isNotNull(), (field,), (hint,), known & (apart <= F.lit(near)), known & (apart > F.lit(far)), weight, penalty, {"input_num": left, "db_num": right})

    def voltage() -> Rule:
        low, high, db_low, db_high = i("voltage_min_v"), i("voltage_max_v"), c("voltage_min_hint"), c("voltage_max_hint")
        asked = low.isNotNull() & high.isNotNull()
        known = asked & db_low.isNotNull() & db_high.isNotNull()
        matched, conflict = known & (db_low <= low) & (high <= db_high), known & ((high < db_low) | (low > db_high))
        shown = {"input_range": F.array(low, high), "db_range": F.array(db_low, db_high)}
        return Rule("voltage", asked, ("voltage_min_v", "voltage_max_v"), ("voltage_min_hint", "voltage_max_hint"), matched, conflict, 8, 8, shown)

    every = [
        *(partial(words, field, weight) for field, weight in TEXT_WEIGHTS.items()),
        *(mounting, water, water_conflict, dimming),
        partial(number, "luminous_flux_lm", "luminous_flux_hint", 0.1, 0.25, 12, 8, 1.0),
        partial(number, "color_temperature_k", "color_temperature_hint", 150.0, 500.0, 12, 10, None),
        partial(number, "power_consumption_w", "power_consumption_hint", 0.1, 0.25, 10, 7, 0.1),
        voltage,
        partial(number, "cri_ra", "cri_hint", 2.0, 5.0, 6, 4, None),
    ]
    return [rule() for k, rule in enumerate(every) if only is None or k in only]


def _kind(match_type: Column) -> Column:
    return F.substring_index(match_type, ":", 1)


def _identifier_weight(match_type: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for k, w in IDENTIFIER_WEIGHTS.items() for x in (k, float(w))))
    return F.coalesce(F.try_element_at(weights, _kind(match_type)), F.lit(0.0))


# Similarity of codes found by a part.


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(pairs: pd.Series) -> pd.Series:
    """The greatest Ratcliff-Obershelp ratio of a list of pairs."""
    return pairs.map(lambda p: max((SequenceMatcher(None, x["a"], x["b"]).ratio() for x in p), default=0.0))


#: The characters of relaxed codes.
CODE_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: In SQL over a pair ``p``: how many characters its codes have in common, wherever they stand; no sequence of matches has more.
_SHARED = " + ".join(f"least(length(p.a) - length(replace(p.a, '{c}', '')), length(p.b) - length(replace(p.b, '{c}', '')))" for c in CODE_CHARACTERS)


def open_pairs(rows: DataFrame, asked: Column | None = None) -> DataFrame:
    """Add ``similarity``, the best ratio that lengths alone tell, and ``_pairs``, the code pairs that could beat it.

    A code that holds the other has a ratio of its lengths; any other pair has at most that of the characters that both
    have, counted with repeats. ``asked``: the rows that are compared; the others get null and no pairs.
    """
    i, c = (lambda n: F.col(f"i_{n}")), (lambda n: F.col(f"c_{n}"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    public = F.flatten(F.transform(i("public_codes_relaxed"), lambda v: F.array(pair(v, c("public1_relaxed")), pair(v, c("public2_relaxed")))))
    pairs = F.filter(F.concat(F.array(pair(i("product_code_relaxed"), c("full_code_relaxed"))), public), lambda p: (p["a"] != "") & (p["b"] != ""))
    least = lambda p: 2.0 * F.least(F.length(p["a"]), F.length(p["b"])) / (F.length(p["a"]) + F.length(p["b"]))
    held = lambda p: p["a"].contains(p["b"]) | p["b"].contains(p["a"])
    rows = rows.withColumn("_pairs", F.array_distinct(pairs) if asked is None else F.when(asked, F.array_distinct(pairs)))
    known = F.coalesce(F.array_max(F.transform(F.filter("_pairs", held), least)), F.lit(0.0))
    rows = rows.withColumn("similarity", F.when(F.col("_pairs").isNotNull(), known))
    over = lambda n: f"2.0D * ({n}) / (length(p.a) + length(p.b)) > similarity"
    beats = f"not contains(p.a, p.b) and not contains(p.b, p.a) and {over('least(length(p.a), length(p.b))')} and {over(_SHARED)}"
    return rows.withColumn("_pairs", F.coalesce(F.expr(f"filter(_pairs, p -> {beats})"), F.array()))


def with_similarity(rows: DataFrame) -> DataFrame:
    """Add ``similarity`` of the codes, for candidates found by a part of an identifier; only ``open_pairs`` go through the sequence matcher."""
    return _matched(open_pairs(rows))


def _matched(rows: DataFrame) -> DataFrame:
    """Settle the ``similarity`` of rows that have pairs left open."""
    plain = rows.where(F.size("_pairs") == 0).drop("_pairs")
    matched = rows.where(F.size("_pairs") > 0).withColumn("similarity", F.greatest("similarity", _sequence_ratio("_pairs"))).drop("_pairs")
    return plain.unionByName(matched)


def found_by_part() -> Column:
    return F.exists("match_types", lambda m: F.startswith(m, F.lit("partial_identifier:")))


def similar(pairs: DataFrame, items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The pairs that were found by a part, with their rows and ``similarity``."""
    return with_similarity(pairs_with_rows(pairs.where(found_by_part()), items, catalogue))


def asked_rules(asked: DataFrame) -> list[int]:
    """The rules that some of the items, with columns ``i_*``, ask for, by their place in ``rules()``; the others are silent on all of these items."""
    told = asked.agg(F.count("*"), *(F.max(r.asked) for r in rules())).first()[1:]  # one row: a flag for each rule
    return [k for k, some in enumerate(told) if some]


def as_asked(items: DataFrame) -> DataFrame:
    return items.select(*(F.col(c).alias(f"i_{c}") for c in items.columns))


def scored(pairs: DataFrame, items: DataFrame, catalogue: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """All pairs with their scores; only pairs found by a part take the way over similarity. ``whole``: more pairs, none of them found by a part.

    A pair meets its rows once: what its score takes from them is written in narrow columns, and those that need the
    sequence matcher are told apart there.
    """
    table = rules(only=asked_rules(as_asked(items)))
    rows = open_pairs(pairs_with_rows(pairs, items, catalogue), found_by_part())
    told = staged(rows.select("item_key", "id", "match_types", "similarity", "_pairs", *(v.alias(k) for k, v in _apart(table).items())), "named-scores")
    out = _matched(told).withColumns(_together()).select(*NARROW)
    if whole is None:
        return out
    plain = pairs_with_rows(whole, items, catalogue).withColumn("similarity", F.lit(None).cast("double"))
    return out.unionByName(with_scores(plain, table).select(*NARROW))


def _sum(score: Column, table: list[Rule]) -> Column:
    for r in table:
        score = score + F.when(r.matched, F.lit(float(r.weight))).when(r.conflict, F.lit(-float(r.penalty))).otherwise(F.lit(0.0))
    return score


def _counts(table: list[Rule]) -> tuple[Column, Column]:
    """How many rules speak for a candidate, and how many against it."""
    matched = conflicts = F.lit(0)
    for r in table:
        matched, conflicts = matched + r.matched.cast("int"), conflicts + r.conflict.cast("int")
    return matched, conflicts


def _reads(table: list[Rule]) -> dict[str, Column]:
    """The catalogue columns that the rules read, and what ``NARROW`` tells of a row whatever is asked."""
    reads = {c: F.col(c) for r in table for c in r.reads}
    reads.setdefault("wet_combined_norm", F.when(F.col("wet_combined_norm") == "conflict", "conflict").otherwise(""))
    reads["availability_norm"] = F.when(F.col("availability_norm").isin(*LIFECYCLE), F.col("availability_norm")).otherwise("")
    return reads


def _apart(table: list[Rule]) -> dict[str, Column]:
    """What the rules tell of a pair before its similarity counts."""
    matched, conflicts = _counts(table)
    return {
        "score": _sum(F.greatest(F.array_max(F.transform("match_types", _identifier_weight)), F.lit(0.0)), table),
        "other_matches": matched,
        "has_conflict": (conflicts > 0) | (F.col("c_wet_combined_norm") == "conflict"),
        "lifecycle_warning": F.when(F.col("c_availability_norm").isin(*LIFECYCLE), F.col("c_availability_norm")),
    }


def _together() -> dict[str, Column]:
    """The same with ``similarity``."""
    similar = F.round(F.col("similarity") * SIMILARITY_WEIGHT, 3)
    return {"score": F.round(F.col("score") + F.coalesce(similar, F.lit(0.0)), 3), "other_matches": F.col("other_matches") + F.col("similarity").isNotNull().cast("int")}


def with_scores(rows: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``score`` and the counts that the decision needs, for rows with ``similarity``; ``table``: fewer rules, where no row asks for others."""
    return rows.withColumns(_apart(rules() if table is None else table)).withColumns(_together())


#: What ranking and deciding read of a scored pair, and what listing its evidence needs besides the rows.
NARROW = ["item_key", "id", "score", "other_matches", "has_conflict", "lifecycle_warning", "match_types", "similarity"]


def ranked(scored: DataFrame, keep: int | None = None) -> DataFrame:
    """Add ``rank`` (score down, id up) and ``score_gap`` to the next; with ``keep``, the first so many."""
    w = Window.partitionBy("item_key").orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(w))
    if keep is not None:  # the limit is pushed below the window's sort
        out = out.where(F.col("rank") <= keep)
    return out


def best(found: Found, items: DataFrame, catalogue: DataFrame, keep: int, *, part_questions: int = PART_QUESTIONS) -> DataFrame:
    """``ranked(scored(found.pairs), keep)`` without all pairs of strict lookups and specification searches.

    A pair that a public code finds too has a score no less than by its strict key alone, so a row that is not among the
    first of its key is not among the first of all. What each way of searching finds is written in eight narrow columns, so
    no plan holds the rules of more than one.
    """
    strict = _best_of_strict(found, items, catalogue, keep).join(large(found.identified.select("item_key", "id")), ["item_key", "id"], "left_anti")
    strict = staged(strict, "strict-scores")
    named = scored(found.identified, items, catalogue)
    keyed = staged(_best_of_keys(found, items, catalogue, keep, part_questions), "spec-scores")
    return ranked(named.unionByName(strict).unionByName(keyed), keep)


#: Rows of a strict key in a list; pairs of a key up to which they are scored one by one.
LIST_ROWS, PLAIN_PAIRS = 512, 256


def _best_of_strict(found: Found, items: DataFrame, catalogue: DataFrame, keep: int) -> DataFrame:
    """The scored pairs of the first ``keep`` rows of each item's strict key."""
    on = list(STRICT_KEYS)
    keyed = found.strict_items.select(F.col("item_key").alias("i_item_key"), *on, "part", (F.col("askers") * F.col("total")).alias("pairs"))
    asked = staged(as_asked(items).join(large(keyed), "i_item_key"), "strict-questions")
    some = asked_rules(asked)
    table = rules(only=some)
    reads = _reads(table)
    rows = staged(found.strict_rows.join(large(catalogue.select("id", *(v.alias(f"c_{k}") for k, v in reads.items()))), "id"), "strict-reads")
    none = F.lit(None).cast("double").alias("similarity")
    plain = deal(asked.where(F.col("pairs") <= PLAIN_PAIRS), rows, on).select("*", F.array("kind").alias("match_types"), none)
    plain = with_scores(plain, table).withColumnRenamed("i_item_key", "item_key").select(*NARROW)
    met = _lists_met(asked.where(F.col("pairs") > PLAIN_PAIRS), rows, table, some)
    met = met.mapInArrow(_first_of_lists([(float(r.weight), -float(r.penalty)) for r in table], keep), FIRST)
    met = met.select("*", F.array("kind").alias("match_types"), none).select(*NARROW)
    nth = F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc("score"), "id"))
    return plain.unionByName(met).withColumn("nth", nth).where(F.col("nth") <= keep).select(*NARROW)


def _lists_met(asked: DataFrame, rows: DataFrame, table: list[Rule], some: list[int]) -> DataFrame:
    """Lists of items beside lists of rows of their key, and what each rule of the ``table``, which are ``some`` of all by place, says of the values that it compares there.

    For the ``n``-th rule: ``a_n`` and ``b_n``, digests of the distinct values of items and of rows, and ``cells_n``, for each value of ``a_n`` one for each of ``b_n``:
    1 if the rule speaks for such a pair, 2 if against it. ``asks`` and ``rows`` hold the digests of each item and row, by rule.
    """
    on = list(STRICT_KEYS)
    digest = lambda prefix, names: F.xxhash64(*(x for n in names for x in (F.col(f"{prefix}_{n}").isNull(), F.col(f"{prefix}_{n}"))))
    values = lambda prefix, names: F.collect_set(F.struct(digest(prefix, names).alias("digest"), *(F.col(f"{prefix}_{n}").alias(n) for n in names)))
    by_rule = lambda prefix, names: F.array(*(digest(prefix, n) for n in names)).cast("array<bigint>").alias("digests")
    asks = F.collect_list(F.struct(F.col("i_item_key").alias("key"), by_rule("i", [r.asks for r in table]))).alias("asks")
    asks = asked.groupBy(*on, "part").agg(asks, *(values("i", r.asks).alias(f"a_{n}") for n, r in enumerate(table)))
    told = F.struct("id", (F.col("c_wet_combined_norm") == "conflict").alias("conflict"), F.col("c_availability_norm").alias("state"), by_rule("c", [r.reads for r in table]))
    listed = rows.withColumn("list", part_of("id", F.ceil(F.col("total") / LIST_ROWS))).groupBy(*on, "list")
    listed = listed.agg(F.array_sort(F.collect_list(told)).alias("rows"), *(values("c", r.reads).alias(f"b_{n}") for n, r in enumerate(table)))

    def cells(n: int, k: int) -> Column:
        def cell(a: Column, b: Column) -> Column:
            (rule,) = rules(lambda c: b[c], lambda i: a[i], [k])
            return F.when(rule.matched, 1).when(rule.conflict, 2).otherwise(0).cast("tinyint")

        return F.flatten(F.transform(f"a_{n}", lambda a: F.transform(f"b_{n}", lambda b: cell(a, b)))).alias(f"cells_{n}")

    met = deal(asks, listed, on).select("*", _identifier_weight(F.col("kind")).alias("weight"), *(cells(n, k) for n, k in enumerate(some)))
    digests = {f"{side}_{n}": F.col(f"{side}_{n}")["digest"] for n in range(len(table)) for side in "ab"}
    return met.select("kind", "weight", "asks", "rows", *(v.alias(k) for k, v in digests.items()), *(f"cells_{n}" for n in range(len(table))))


FIRST = "item_key string, kind string, id string, score double, other_matches int, has_conflict boolean, lifecycle_warning string"


def _first_of_lists(points: list[tuple[float, float]], keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each item of ``_lists_met`` the first ``keep`` rows of the list by score and id; ``points`` of each rule for a pair and against it."""
    worth = [np.array([0.0, more, less, more]) for more, less in points]

    def parts(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
        return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])

    def codes(known: np.ndarray, seen: np.ndarray) -> np.ndarray:
        order = np.argsort(known)
        return order[np.searchsorted(known[order], seen)]

    def first_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        (asks, ask_ends), (rows, row_ends) = parts(batch["asks"]), parts(batch["rows"])
        (keys, asked), (ids, conflicts, states, read) = asks.flatten(), rows.flatten()
        asked, read = (x.flatten().to_numpy().reshape(len(x), len(worth)) for x in (asked, read))
        split = [[(values.to_numpy(), ends) for values, ends in (parts(batch[f"{side}_{n}"]) for side in ("a", "b", "cells"))] for n in range(len(worth))]
        weights, kept = batch["weight"].to_numpy(), []
        for k in range(batch.num_rows):
            left, right = slice(*ask_ends[k : k + 2]), slice(*row_ends[k : k + 2])
            size = right.stop - right.start
            total, tables = np.full((left.stop - left.start, size), weights[k]), []
            for n, sides in enumerate(split):
                a, b, cells = (values[ends[k] : ends[k + 1]] for values, ends in sides)
                cells, at, to = cells.reshape(len(a), len(b)), codes(a, asked[left, n]), codes(b, read[right, n])
                total += worth[n][cells][at][:, to]
                tables.append((cells, at, to))
            total = np.rint(total * 1000).astype(np.int64)  # weights have three decimals at most
            order = np.arange(size) - total * size  # by score, then by id, in the order of which rows come
            first = np.argpartition(order, keep - 1, axis=1)[:, :keep] if size > keep else np.broadcast_to(np.arange(size), order.shape)
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(order, first, 1), axis=1), 1)
            spoken, against = np.zeros(first.shape, np.int32), np.zeros(first.shape, bool)
            for cells, at, to in tables:
                some = cells[at[:, None], to[first]]
                spoken += some & 1
                against |= some >= 2
            items = np.repeat(np.arange(left.start, left.stop), first.shape[1])
            kept.append((np.full(first.size, k), items, (right.start + first).ravel(), np.take_along_axis(total, first, 1).ravel() / 1000.0, spoken.ravel(), against.ravel()))
        block, items, at, score, spoken, against = (np.concatenate(x) for x in zip(*kept, strict=True))
        states = states.take(pa.array(at))
        columns = [keys.take(pa.array(items)), batch["kind"].take(pa.array(block)), ids.take(pa.array(at)), score, spoken, against | conflicts.to_numpy(zero_copy_only=False)[at]]
        columns.append(pc.if_else(pc.equal(states, ""), None, states))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in FIRST.split(", ")])

    return lambda batches: (first_of(batch) for batch in batches if batch.num_rows)


#: One signature in so many is scored first, for a bound on the others.
FLOOR_SHARE = 16


def _best_of_keys(found: Found, items: DataFrame, catalogue: DataFrame, keep: int, part_questions: int) -> DataFrame:
    """The scored pairs of specification searches that can be among the first ``keep`` of their item.

    Rows of one signature score alike, so only their first ids count; and each of the ``keep`` best signatures of an item has
    a row, so none of the others can come before them all. A share of the signatures is scored first: the ``keep``-th of these
    bounds the ``keep``-th of all, so what lies behind it is neither kept nor sorted. The bound cuts no row that ranks.
    Items of a key that are alike in all that rules read of them are scored as one, the least of them.
    """
    keys = {k: f"k_{k}" for k in SPEC_KEYS}
    table = rules()
    read = [*keys.values(), *sorted({f"i_{c}" for r in table for c in r.asks})]
    every = as_asked(items).join(large(found.spec_items.withColumnsRenamed(keys).withColumnRenamed("item_key", "i_item_key")), "i_item_key")
    alike = F.md5(F.to_json(F.struct(*read), {"ignoreNullFields": "false"}).cast("binary"))
    every = staged(every.select("i_item_key", alike.alias("alike"), *read), "spec-questions")
    asked = every.groupBy("alike").agg(F.min("i_item_key").alias("i_item_key"), F.first(F.struct(*read)).alias("read")).select("i_item_key", "alike", "read.*")
    asked = staged(parted(asked, list(keys.values()), "i_item_key", part_questions), "spec-kinds")
    table = [table[k] for k in asked_rules(asked)]
    reads = _reads(table)
    rows = staged(found.spec_hits, "spec-hits").withColumnsRenamed(keys).join(large(catalogue.select("id", *(v.alias(f"c_{k}") for k, v in reads.items()))), "id")
    signatures = rows.groupBy(*keys.values(), *(f"c_{k}" for k in reads)).agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))  # of a key's capped rows
    signatures = staged(signatures, "signatures")
    at = F.struct((0.0 - F.col("score")).alias("down"), F.col("ids")[0].alias("id"))  # in the order of ranks

    def made(questions: DataFrame, some: DataFrame) -> DataFrame:
        met = deal(questions, some, list(keys.values())).withColumns({"match_types": F.array(F.lit("spec_candidate")), "similarity": F.lit(None).cast("double")})
        return with_scores(met, table).withColumnRenamed("i_item_key", "item_key").withColumn("at", at)

    place = F.row_number().over(Window.partitionBy("item_key").orderBy("at"))
    few = made(asked, signatures.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(FLOOR_SHARE)) == 0))
    floors = few.select("item_key", "at").withColumn("place", place).where(F.col("place") == keep).select(F.col("item_key").alias("i_item_key"), F.col("at").alias("floor"))
    bounded = asked.join(large(staged(floors, "floors")), "i_item_key", "left")
    ahead = made(bounded, signatures).where(F.col("floor").isNull() | (F.col("at") <= F.col("floor")))
    first = ahead.select("item_key", "ids", "at", *(c for c in NARROW if c not in ("item_key", "id"))).withColumn("place", place).where(F.col("place") <= keep)
    first = ranked(first.withColumn("id", F.explode("ids")).select(*NARROW), keep).drop("rank")
    whose = every.select("alike", F.col("i_item_key").alias("whose")).join(large(asked.select("alike", F.col("i_item_key").alias("item_key"))), "alike").select("item_key", "whose")
    return first.join(large(whose), "item_key").drop("item_key").withColumnRenamed("whose", "item_key").select(*NARROW)


def with_lists(rows: DataFrame, slots: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``matched_fields``, ``conflicts`` and ``db_internal_warnings``; ``slots``: those that the entries have, if not all."""
    made = partial(entry, only=slots)
    found = F.transform("match_types", lambda m: made("identifier", _identifier_weight(m), match_type=m))
    similar = F.when(F.col("similarity").isNotNull(), made("identifier_similarity", F.round(F.col("similarity") * SIMILARITY_WEIGHT, 3), ratio=F.round("similarity", 4)))
    table = rules()
    matched = F.array_compact(F.array(*(F.when(r.matched, made(r.field, r.weight, **r.shown)) for r in table), similar))
    conflicts = F.array_compact(F.array(*(F.when(r.conflict, made(r.field, **r.shown)) for r in table)))
    warnings = F.array_compact(F.array(F.when(F.col("c_wet_combined_norm") == "conflict", "db_internal_waterproof_conflict")))
    return rows.withColumns({"matched_fields": F.concat(found, matched), "conflicts": conflicts, "db_internal_warnings": warnings})


# What is shown of a catalogue row as it stands in the source, in order.
RECORD_BEFORE = ["id", "hinban", "kidou"]
RECORD_MIDDLE = ["key", "view_key", "kigugroup", "kigustyle", "t_kigubunrui", "t_kigugroup", "price_zeinuki", "hatsubai_date", "seisan_end_date", "zaiku"]
RECORD_AFTER = ["koukyou_kataban1", "koukyou_kataban2", "t_akarusa", "kigusize", "umekomi_ana", "t_toritsuke", "boushitsu_bouu", "t_kinou", "dannetsusekou", "y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou"]
RECORD_TEXTS = [c for c in (*RECORD_BEFORE, *RECORD_MIDDLE, *RECORD_AFTER) if c not in ("id", "price_zeinuki")]
HINTS_SHOWN = {"luminous_flux_lm": "luminous_flux_hint", "color_temperature_k": "color_temperature_hint", "power_consumption_w": "power_consumption_hint", "voltage_min_v": "voltage_min_hint", "voltage_max_v": "voltage_max_hint", "cri_ra": "cri_hint"}


def record() -> Column:
    """The catalogue row as it is shown."""
    c = lambda n: F.col(f"c_{n}")
    code = F.concat(c("hinban_norm"), F.when(c("kidou_norm") != "", F.concat(F.lit(" "), c("kidou_norm"))).otherwise(""))
    return F.struct(
        *(c(k).alias(k) for k in RECORD_BEFORE),
        code.alias("full_code"),
        *(c(k).alias(k) for k in RECORD_MIDDLE),
        c("availability_norm").alias("availability"),
        *(c(k).alias(k) for k in RECORD_AFTER),
        F.struct(*(c(v).alias(k) for k, v in HINTS_SHOWN.items())).alias("parsed_hints"),
    )
