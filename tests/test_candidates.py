"""Searches of a catalogue in which many rows share a key, against plain Python; and the best of all candidates without scoring all."""

import random

import pytest
from data import ROWS
from pyspark.sql import functions as F

from matchloom.operators import candidates, catalogue, evidence, items
from matchloom.plans import fixtures, jobs
from matchloom.stage import staged

SF = "/root/testdata/sf0.001"
COLUMNS = ("full_code_relaxed", "public1_relaxed", "public2_relaxed")


def products(spark, codes):
    """Catalogue rows with these relaxed codes, numbered backwards against their ids."""
    rows = [(f"P{k:05}", len(codes) - k, *c) for k, c in enumerate(codes)]
    return spark.createDataFrame(rows, "id string, source_row long, full_code_relaxed string, public1_relaxed string, public2_relaxed string")


def found(rows):
    return sorted((r["item_key"], r["id"], r["place"], r["match_type"]) for r in rows.collect())


def brute(values, codes, cap, kind, fits):
    out = []
    for item, pos, value in values:
        hits = sorted((len(codes) - k, f"P{k:05}") for k, c in enumerate(codes) if any(x and fits(x, value) for x in c))
        out += [(item, i, pos, f"{kind}:{value}") for _, i in hits[: cap + 1]]
    return sorted(out)


@pytest.fixture(scope="module")
def shared():
    """Half of all codes hold HOTGRAMS, at the beginning, the end or twice; others are short, empty, long or repeat themselves."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ABC12") for _ in range(n))
    codes = []
    for k in range(600):
        code = letters(rng.randint(0, 14))
        if k % 2:
            code = rng.choice([f"HOTGRAMS{code}", f"{code}HOTGRAMS", f"HOTGRAMS{code}HOTGRAMS"])
        codes.append((code, rng.choice(["", letters(7), "HOTGRAMS9"]), rng.choice(["", code, "AAAAAAAAAA" * 30 if k == 77 else letters(5)])))
    values = ["HOTGRAMS", "HOTGRA", "TGRAMS", "AAAAAA", "A" * 40, "HOTGRAMSA", "HOTGRAMSAB1HOTGRAMS", "NOWHERE", "ABC12A", "ABCDE", "ABC"]
    values += [c[0][a : a + n] for c in codes[::9] for a, n in ((0, 6), (2, 9), (1, 13), (0, 30)) if len(c[0]) >= a + n]
    return codes, [(f"i{k % 40}", k % 5, v) for k, v in enumerate(values)]


@pytest.mark.parametrize("cap, chunks", [(1, 3), (7, 90), (2000, 1), (5000, 3)])
def test_tolerant_lookups_of_shared_keys(spark, shared, cap, chunks):
    codes, values = shared
    asked, rows = spark.createDataFrame(values, "item_key string, pos int, value string"), products(spark, codes)
    long = [v for v in values if len(v[2]) >= 6]
    assert found(candidates.by_partial(asked, rows, cap, chunks)) == brute(long, codes, cap, "partial_identifier", lambda x, v: v in x)
    assert found(candidates.by_relaxed(asked, rows, cap, chunks)) == brute(values, codes, cap, "relaxed_identifier", lambda x, v: v == x)


def test_substring_lookup_of_nothing(spark, shared):
    rows = products(spark, shared[0])
    none = spark.createDataFrame([], "item_key string, pos int, value string")
    assert candidates.by_partial(none, rows, chunks=4).count() == candidates.by_relaxed(none, rows, chunks=4).count() == 0
    some = spark.createDataFrame(shared[1], none.schema)
    assert candidates.by_partial(some, rows.limit(0)).count() == 0


def test_no_task_gets_a_shared_key_alone(spark):
    """Every gram of the value stands in half of all codes; the rows that it meets are dealt evenly."""
    rows = products(spark, [(f"HOTGRAMS{k:06}" if k % 2 else f"COLD{k:06}", "", "") for k in range(40_000)])
    index = candidates.chunked(candidates.keys_of(rows, *COLUMNS), 400).select("id", "source_row", "chunk", F.substring("value", 1, 8).alias("key"))
    asked = spark.createDataFrame([("HOTGRAMS", "HOTGRAMS")], "value string, key string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        met = candidates.lookup(asked, index, ["key"], 400)
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 20_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        # Windows sort chunks; the last one sees the first rows of FAN chunks at most.
        first = candidates.first_rows(met.select("value", "id", "source_row", "chunk"), ["value"], 5, 400)
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [row_number()") == 3 and "Window [row_number() windowspecdefinition(value" in plan
        assert [r["source_row"] for r in first.orderBy("source_row").collect()] == [1, 3, 5, 7, 9]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("cap", [1, 7, 2000, 5000])
def test_first_rows_of_chunks(spark, cap):
    rng = random.Random(cap)
    data = [(rng.choice("aaaaaab"), f"r{k:04}", rng.randint(0, 2000)) for k in range(6000)]
    rows = spark.createDataFrame(data, "key string, id string, source_row int")
    want = {k: [i for _, i in sorted((s, i) for x, i, s in data if x == k)][:cap] for k in "ab"}
    for chunks in (1, 33, 1500):
        got = candidates.first_rows(candidates.chunked(rows, chunks), ["key"], cap, chunks).collect()
        assert {k: [r["id"] for r in sorted(got, key=lambda r: (r["source_row"], r["id"])) if r["key"] == k] for k in "ab"} == want


def test_searches_in_many_chunks(spark):
    """Whole searches of the given tables, in one chunk and in many, under small caps and the real ones."""
    source = catalogue.normalize_catalogue(fixtures.catalogue_source(spark, SF)).cache()
    asked = items.normalize_items(fixtures.raw_items(spark, SF)).cache()
    for caps in ({}, {"fuzzy_cap": 1, "spec_cap": 7}):
        made = []
        for rows in (10**6, 9):
            got = candidates.find_candidates(asked, source, chunk_rows=rows, **caps)
            made.append((sorted(map(repr, got.pairs.collect())), sorted(map(repr, got.routes.collect()))))
        assert made[0] == made[1] and made[0][0]
    source.unpersist()
    asked.unpersist()


def plain_best(got):
    """All candidates scored, and by a number: the first so many of each item."""
    by = {}
    for r in got.scored.collect():
        by.setdefault(r["item_key"], []).append(r)
    ranked = {k: sorted(v, key=lambda r: (-r["score"], r["id"])) for k, v in by.items()}
    return lambda keep: sorted(repr((*r, n)) for v in ranked.values() for n, r in enumerate(v[:keep], 1))


def rows_of(best):
    return sorted(repr(tuple(r)) for r in best.select(*evidence.NARROW, "rank").collect())


@pytest.mark.parametrize("kind", ["plain", "detailed"])
def test_best_is_the_head_of_all(spark, kind):
    """Signatures give the candidates that scoring all pairs and ranking them gives."""
    source, raw = (fixtures.catalogue_source, fixtures.raw_items) if kind == "plain" else (fixtures.detailed_source, fixtures.echoed_items)
    made = staged(catalogue.normalize_catalogue(source(spark, SF)), "catalogue")
    got = jobs.answer(raw(spark, SF), made)
    want = plain_best(got)
    assert want(10) and rows_of(got.best(2)) == want(2)
    assert rows_of(evidence.best(got.found, got.questions, got.products, 10, part_questions=1)) == want(10)


def test_best_of_items_that_ask_for_everything(spark):
    """Every rule is asked for by some item; values are drawn so that scores tie and differ."""
    rng = random.Random(8)
    draw = {"kigugroup": ["ダウンライト", "スポットライト"], "kigustyle": ["丸", ""], "key": ["K1", "K2"], "view_key": ["100lm", "900lm", ""], "umekomi_ana": ["φ75", "φ100", ""], "t_toritsuke": ["天井埋込", "壁直付", ""], "boushitsu_bouu": ["防湿", "対応なし", ""], "t_kinou": ["調光", "防雨形", ""], "y_toukyu": ["A級", ""], "y_kinou": ["Ra80 AC100V", "Ra90 5000K", ""], "zaiku": ["受注品", "生産終了品"]}
    rows = [ROWS[0] | {"id": f"C{k:03}", "hinban": f"X{k}"} | {c: rng.choice(v) for c, v in draw.items()} for k in range(150)]
    made = catalogue.normalize_catalogue(spark.createDataFrame([tuple(r.get(c, "") for c in catalogue.SOURCE_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in catalogue.SOURCE_COLUMNS))).cache()
    some = lambda *v: rng.choice([None, *v])
    asked = [
        (str(k), rng.choice(draw["kigugroup"]), some("丸", "角"), some("K1"), some("75", "999"), some(100.0, 500.0), some(5000.0), some(80.0), some("AC100V"), some("防湿", "防雨形"), some("調光", "非調光"), some("A級", "B級"), [some("天井埋込")])
        for k in range(60)
    ]
    raw = spark.createDataFrame(asked, "item_key string, category string, style string, key_hint string, cutout_size_diameter string, luminous_flux_lm_num double, color_temperature_k_num double, cri_ra_num double, voltage_text string, waterproof_text string, dimming_text string, y_toukyu string, mounting array<string>")
    got = jobs.answer(raw, made)
    assert rows_of(got.best(10)) == plain_best(got)(10)
    made.unpersist()


def test_no_specification_search(spark):
    made = catalogue.normalize_catalogue(fixtures.catalogue_source(spark, SF)).cache()
    raw = spark.createDataFrame([("a", "NNF00001", "LE9"), ("b", None, None)], "item_key string, hinban string, kidou string")
    got = jobs.answer(raw, made)
    assert rows_of(got.best(10)) == plain_best(got)(10)
    assert jobs.answer(raw.where("item_key = 'b'"), made).best(2).count() == 0
    made.unpersist()


def test_similarity_of_open_pairs(spark):
    """The greatest ratio of all code pairs, though few of them go through the sequence matcher."""
    from difflib import SequenceMatcher

    rng = random.Random(12)
    code = lambda: "".join(rng.choices("ABCD123", k=rng.randint(0, 9)))
    data = [(k, code(), [code() for _ in range(rng.randrange(3))], code(), code(), code()) for k in range(400)]
    rows = staged(spark.createDataFrame(data, "k int, i_product_code_relaxed string, i_public_codes_relaxed array<string>, c_full_code_relaxed string, c_public1_relaxed string, c_public2_relaxed string"), "codes")
    pairs = {k: [(a, b) for a, b in [(p, f), *((v, c) for v in public for c in (one, two))] if a and b] for k, p, public, f, one, two in data}
    want = {k: max((SequenceMatcher(None, a, b).ratio() for a, b in v), default=0.0) for k, v in pairs.items()}
    got = {r["k"]: r["similarity"] for r in evidence.with_similarity(rows).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    left = sum(len(r["_pairs"]) for r in evidence.open_pairs(rows).collect())
    held = sum(a in b or b in a for v in pairs.values() for a, b in v)
    assert 0 < left < 0.8 * (sum(map(len, pairs.values())) - held)


def test_no_growing_side_is_broadcast(spark):
    """Small as these tables are: Spark takes large ones for as small, by their compressed files and before explodes."""
    made = staged(catalogue.normalize_catalogue(fixtures.catalogue_source(spark, SF)), "catalogue")
    got = jobs.answer(fixtures.raw_items(spark, SF), made)
    asked = candidates.relaxed_values(got.questions)
    parts = candidates.by_partial(asked, made, chunks=1), candidates.by_partial(asked, made, chunks=2), candidates.by_relaxed(asked, made)
    for df in (*parts, got.found.pairs, got.routes, got.scored, got.best(2), items.per_item(got.routes, got.items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" in plan


def test_items_of_one_key_are_dealt(spark):
    """All items ask for one key; they meet its rows in tasks of equal size."""
    asked = spark.range(8000).select(F.col("id").cast("string").alias("item_key"), F.lit("a").alias("category"), F.lit("").alias("cutout_size"), F.lit("").alias("fixture_size"))
    hits = spark.range(20).select(*(F.lit(v).alias(k) for k, v in zip(candidates.SPEC_KEYS, ("a", "", ""), strict=True)), F.concat(F.lit("P"), "id").alias("id"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "4"), strict=True):
            spark.conf.set(k, v)
        met = candidates.deal(asked.withColumn("part", candidates.part_of("item_key", 64)), hits, list(candidates.SPEC_KEYS)).select("item_key", "id")
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == met.distinct().count() == 160_000 and len(sizes) == 4 and sizes[-1] <= 3 * sizes[0]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_shared_strict_key_makes_no_pairs(spark):
    """Forty items ask for the base number of sixty rows: what is kept is a row an item and a row a product."""
    rows = [ROWS[0] | {"id": f"C{k:03}", "hinban": "X1", "key": f"K{k % 7}"} for k in range(60)]
    made = staged(catalogue.normalize_catalogue(spark.createDataFrame([tuple(r.get(c, "") for c in catalogue.SOURCE_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in catalogue.SOURCE_COLUMNS))), "catalogue")
    raw = spark.createDataFrame([(str(k), "X1", f"K{k}") for k in range(40)], "item_key string, hinban string, key_hint string")
    got = jobs.answer(raw, made)
    assert (got.found.strict_items.count(), got.found.strict_rows.count(), got.found.identified.count(), got.found.pairs.count()) == (40, 60, 0, 2400)
    assert {(r["route"], r["candidate_total"]) for r in got.routes.collect()} == {("exact_identifier", 60)}
    assert rows_of(got.best(3)) == plain_best(got)(3)


def test_parts_follow_the_askers_of_a_key(spark):
    """A key that few ask for is dealt to one part, however many questions there are in all."""
    asked = spark.range(3010).select(F.col("id").alias("item_key"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("category"))
    parts = {r["category"]: sorted(r["parts"]) for r in candidates.parted(asked, ["category"], questions=1000).groupBy("category").agg(F.collect_set("part").alias("parts")).collect()}
    assert parts == {"a": [0, 1, 2], "b": [0]}


@pytest.mark.parametrize("keep", [1, 4, 40])
def test_a_share_of_the_signatures_bounds_the_others(spark, monkeypatch, keep):
    """Most pairs lie behind the bound, also where scores tie; what ranks is the same. Where the share has fewer than ``keep``, nothing is bounded."""
    rows = [ROWS[0] | {"id": f"C{k:03}", "hinban": f"X{k}", "kigugroup": "ダウンライト", "y_kinou": f"消費電力:{k}.5W Ra{80 + k % 9}"} for k in range(400)]
    made = staged(catalogue.normalize_catalogue(spark.createDataFrame([tuple(r.get(c, "") for c in catalogue.SOURCE_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in catalogue.SOURCE_COLUMNS))), "catalogue")
    raw = spark.createDataFrame([(str(k), "ダウンライト", k * 20.0 + 1, 80.0 + k) for k in range(12)], "item_key string, category string, power_consumption_w_num double, cri_ra_num double")
    got = jobs.answer(raw, made)
    seen = {}
    monkeypatch.setattr(evidence, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    assert rows_of(got.best(keep)) == plain_best(got)(keep)
    assert seen["signatures"].count() == 400
    if keep == 40:
        assert seen["floors"].count() == 0
        return
    assert seen["floors"].count() == 12
    ahead = got.scored.join(seen["floors"].withColumnRenamed("i_item_key", "item_key"), "item_key").where(F.struct((0.0 - F.col("score")).alias("down"), "id") <= F.col("floor")).count()
    assert 12 * keep <= ahead < 12 * 400 / 2


def test_ranking_joins_written_scores(spark):
    """Each way of searching writes its scores, so the plan that ranks them holds no rules and no joins; similarity reads what was found by identifier alone."""
    made = staged(catalogue.normalize_catalogue(fixtures.catalogue_source(spark, SF)), "catalogue")
    got = jobs.answer(fixtures.raw_items(spark, SF), made)
    assert "Join" not in got.best(2)._jdf.queryExecution().optimizedPlan().toString()
    files = " ".join(got.similar.inputFiles())
    assert "/identified-" in files and not any(f"/{name}-" in files for name in ("strict-rows", "spec-hits", "spec-asked"))


def test_identified_pairs_meet_their_rows_once(spark, monkeypatch):
    """Scores of what identifiers found are written by one join with catalogue rows and one with items, whether found by a part or not; the same scores as by joining each kind alone."""
    made = staged(catalogue.normalize_catalogue(fixtures.catalogue_source(spark, SF)), "catalogue")
    got = jobs.answer(fixtures.raw_items(spark, SF), made)
    joins = {}
    monkeypatch.setattr(evidence, "staged", lambda df, name: (joins.update({name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")}), staged(df, name))[1])
    one = evidence.scored(got.found.identified, got.questions, made)
    assert joins == {"named-scores": 2} and "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    plain = evidence.pairs_with_rows(got.found.identified.where(~evidence.found_by_part()), got.questions, made).withColumn("similarity", F.lit(None).cast("double"))
    each = evidence.with_scores(plain.unionByName(evidence.similar(got.found.identified, got.questions, made))).select(*evidence.NARROW)
    kinds = {r["part"] for r in got.found.identified.select(evidence.found_by_part().alias("part")).distinct().collect()}
    assert kinds == {True, False} and sorted(map(str, one.collect())) == sorted(map(str, each.collect()))
    got.best(2)
    assert joins["signatures"] == 1  # with catalogue rows: what keys find is read, not searched again
