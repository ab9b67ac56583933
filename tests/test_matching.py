"""End-to-end matches on the small catalogue, through CSV and nested JSON."""

import hashlib
import json
import shutil

import pytest
from data import item, write_csv

from matchloom.plans import jobs
from matchloom.sources.catalogue_csv import fingerprint, read_catalogue_csv
from matchloom.sources.items_json import items_of_strings, raw_of_variants, read_items_json

MIXED = item(
    {"manufacturer": "Nordlicht", "category": "ダウンライト", "product_code_raw": "RVK880B D2", "key_hint": "3000K"},
    {
        "luminous_flux_lm": {"raw": "光束 620 lm", "value": 620},
        "color_temperature_k": "3000K",
        "cutout_size": {"shape": "circle", "value": 75},
        "mounting_method": ["天井埋込", {"raw": "壁埋込"}],
        "ip_rating": {"value": "x", "raw": "防雨"},
        "dimming": True,
    },
)
#: What a conflict costs, by field.
PENALTY = {"style": 2, "mounting": 7, "waterproof": 12, "dimming": 12, "luminous_flux_lm": 8, "color_temperature_k": 10, "power_consumption_w": 7, "voltage": 8, "cri_ra": 4}
#: name: payload, then candidates, status, selected id, review, best score
CASES = {
    "by_hint": (item({"hinban": "qla1207", "kidou": "D2", "key_hint": "s-12"}), 2, "spec_filtered_unique", "A1", False, 118.0),
    "by_hint_and_flux": (item({"hinban": "QLA1207"}, {"luminous_flux_lm": 2000}), 2, "spec_filtered_unique", "A2", False, 87.0),
    "ending": (item({"product_number": "RVK880B D2"}), 1, "exact_unique", "A3", True, 100.0),
    "public": (item({"public_model_codes": ["PB2-300", "PB2-300"]}), 1, "exact_unique", "A5", False, 90.0),
    "contradiction": (item({"model_number": "ZTM44D2"}, {"water_resistance": "防雨形"}), 1, "conflict", "A4", True, 100.0),
    "spec_only": (item({"category": "ダウンライト"}, {"cutout_size": {"diameter_mm": 200}}), 1, "spec_filtered_unique", "A5", True, 30.0),
    "elsewhere": (item({"product_code_raw": "XX-0001-YY", "category": "ダウンライト"}, {"cutout_size": "φ88"}), 0, "not_found", None, True, None),
    "from_sight": (item({"model_base": "RVK880B", "visual_context_code_raw": "RVK880B D2"}, uncertain_fields=["product_code"]), 1, "exact_unique", "A3", True, 100.0),
    "twice": (item({"hinban": "QLA1207", "suffix": "D2"}), 2, "exact_multiple", None, True, 100.0),
    "loosely": (item({"product_code_compact": "QLA.1207-D2"}), 2, "fuzzy_candidates", None, True, 60.0),
    "in_part": (item({"product_code_raw": "LA1207D2"}), 2, "fuzzy_candidates", None, True, 35 + 23.529),
    "backed_off": (item({"category": "ダウンライト"}, {"cutout_size": "φ999"}), 3, "spec_candidates", None, True, 7.0),
    "by_size": (item({}, {"fixture_size": {"width_mm": 60, "length_mm": 210}}), 2, "spec_candidates", None, True, 14.0),
    "nothing": (item(), 0, "insufficient_input", None, True, None),
    "mixed": (MIXED, 1, "conflict", "A3", True, 139.0),
    "wide": (item({"product_code_raw": "ＲＶＫ８８０Ｂ　Ｄ２"}), 1, "exact_unique", "A3", True, 100.0),
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogue")
    report = jobs.build(spark, write_csv(folder / "source.csv"), str(folder / "db"), str(folder / "report")).first()
    return folder, report


@pytest.fixture(scope="module")
def results(spark, built):
    rows = spark.createDataFrame([(k, json.dumps(v[0], ensure_ascii=False)) for k, v in CASES.items()], "k string, p string")
    made = jobs.match(spark, raw_of_variants(items_of_strings(rows, "k", "p")), spark.read.parquet(str(built[0] / "db/products")))
    return {r["item_key"]: r for r in made.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(results, name):
    _, total, status, selected, review, score = CASES[name]
    r = results[name]
    assert (r["search"]["candidate_count"], r["decision"]["status"], r["decision"]["selected_id"], r["decision"]["review_required"]) == (total, status, selected, review)
    if score is not None:
        assert r["candidates"][0]["score"] == pytest.approx(score, abs=1e-3)
    assert [c["rank"] for c in r["candidates"]] == list(range(1, len(r["candidates"]) + 1))


def test_evidence_adds_up(results):
    for r in results.values():
        for c in r["candidates"]:
            gains = sum(e["weight"] or 0 for e in c["matched_fields"] if e["field"] != "identifier") + max([e["weight"] for e in c["matched_fields"] if e["field"] == "identifier"])
            costs = sum(0 if e["db_values"] else PENALTY.get(e["field"], 5) for e in c["conflicts"])
            assert c["score"] == pytest.approx(gains - costs, abs=1e-3)


def test_lists_and_warnings(results):
    assert results["contradiction"]["candidates"][0]["db_internal_warnings"] == ["db_internal_waterproof_conflict"]
    assert [e["field"] for e in results["mixed"]["candidates"][0]["conflicts"]] == ["cutout_size", "waterproof", "dimming"]
    assert [e["field"] for e in results["mixed"]["candidates"][0]["matched_fields"]] == ["identifier", "category", "key_hint", "mounting", "luminous_flux_lm", "color_temperature_k"]
    assert results["mixed"]["warnings"] == ["source_db_has_no_manufacturer_column; manufacturer_not_used_for_matching"]
    assert results["from_sight"]["warnings"] == ["input_contains_uncertain_fields"]
    assert results["backed_off"]["search"]["basis"] == ["category_backoff"] and results["backed_off"]["search"]["returned_count"] == 3
    assert results["by_hint"]["decision"]["score_gap"] == 23.0 and results["by_size"]["decision"]["top_score_gap"] == 0.0
    assert results["elsewhere"]["search"]["route"] == "identifier_not_found" and results["elsewhere"]["search"]["basis"] == ["full_code"]
    assert [e["match_type"] for e in results["public"]["candidates"][0]["matched_fields"]] == ["public_model_code:PB2-300"] * 2
    shown = results["public"]["candidates"][0]["record"]
    assert (shown["full_code"], shown["availability"], shown["price_zeinuki"], shown["hatsubai_date"], shown["parsed_hints"]["luminous_flux_lm"]) == ("KOM7", "made_to_order", 18400.0, "2021/4/1", 300.0)
    assert results["ending"]["candidates"][0]["lifecycle_warning"] == "planned_discontinued"


def test_report(built):
    folder, r = built
    assert (r["row_count"], r["unique_id_count"], r["unique_full_code_count"], r["duplicate_full_code_groups"]) == (5, 5, 4, 1)
    assert r["status_counts"] == {"受注品": 4, "生産終了予定品": 1}
    assert r["normalized_hint_counts"]["cutout_size"] == 3
    (written,) = (folder / "report").glob("part-*.json")
    told = json.loads(written.read_text(encoding="utf-8"))
    assert told["row_count"] == 5 and told["source_sha256"] == hashlib.sha256((folder / "source.csv").read_bytes()).hexdigest()
    assert not list((folder / "db").glob("*new*")) and not list((folder / "db").glob("*replaced*"))


def test_catalogue_rows(spark, built):
    rows = {r["id"]: r for r in spark.read.parquet(str(built[0] / "db/products")).collect()}
    assert [rows[f"A{i}"]["source_row"] for i in range(1, 6)] == [2, 3, 4, 5, 6]
    assert len(rows["A1"]) == 63 and rows["A1"]["bumon"] == "東" and rows["A1"]["price_zeinuki_text"] == "18400"
    assert rows["A1"]["fixture_size_norm"] == "60x210" and rows["A1"]["mounting_norm"] == ["track"]
    assert rows["A4"]["wet_combined_norm"] == "conflict" and rows["A4"]["cutout_size_norm"] == "□90" and rows["A3"]["availability_norm"] == "planned_discontinued"


def test_inspect_and_run(spark, built, tmp_path):
    seen = jobs.inspect(spark, str(built[0] / "db")).first()
    assert seen["rows"] == 5 and set(seen["metadata"]) == {"schema_version", "source_path", "source_sha256", "source_rows", "built_at_utc"}
    (tmp_path / "in.json").write_text(json.dumps({"items": [MIXED, item()]}, ensure_ascii=False), encoding="utf-8")
    counts = jobs.match_file(spark, str(tmp_path / "in.json"), str(built[0] / "db"), str(tmp_path / "out")).collect()
    assert {r["status"]: r["item_count"] for r in counts} == {"conflict": 1, "insufficient_input": 1}
    (run,) = (tmp_path / "out/run").glob("part-*.json")
    run = json.loads(run.read_text(encoding="utf-8"))
    assert run["result_count"] == 2 and run["input_file"].endswith("in.json") and run["db_metadata"]["source_rows"] == "5"


def test_a_failed_build_leaves_the_catalogue(spark, built, tmp_path):
    folder = built[0]
    before = {r["id"] for r in spark.read.parquet(str(folder / "db/products")).collect()}
    twice = write_csv(tmp_path / "c.csv", [{"id": "A"}, {"id": "A"}])
    with pytest.raises(ValueError, match="not valid"):
        jobs.build(spark, twice, str(folder / "db"))
    assert {r["id"] for r in spark.read.parquet(str(folder / "db/products")).collect()} == before


def test_a_replacement_cut_short(spark, built, tmp_path):
    """A driver that dies between the renames leaves the earlier catalogue aside, with its metadata; readers put it back."""
    target = tmp_path / "db"
    shutil.copytree(built[0] / "db", target)
    (target / "products").rename(target / "products-replaced")
    shutil.copytree(target / "products-replaced", target / "_new_products", dirs_exist_ok=True)
    seen = jobs.inspect(spark, str(target)).first()
    assert seen["rows"] == 5 and seen["metadata"]["source_rows"] == "5"
    jobs.build(spark, write_csv(tmp_path / "c.csv", [{"id": "A"}]), str(target))
    seen = jobs.inspect(spark, str(target)).first()
    assert seen["rows"] == 1 and seen["metadata"]["source_rows"] == "1"
    assert sorted(x.name for x in target.iterdir()) == ["products"]


def test_numbers_and_digests_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, n in enumerate((3, 40, 1)):
        write_csv(tmp_path / f"in/{k}.csv", [{"id": f"{k}-{i:02}", "key": "two\nlines" if i == 1 else ""} for i in range(n)])
    rows = {r["id"]: r["source_row"] for r in read_catalogue_csv(spark, str(tmp_path / "in")).collect()}
    assert [rows[x] for x in sorted(rows)] == list(range(2, 46))
    found = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in fingerprint(spark, str(tmp_path / "in")).collect()}
    assert found == {f"{k}.csv": hashlib.sha256((tmp_path / f"in/{k}.csv").read_bytes()).hexdigest() for k in range(3)}


@pytest.mark.parametrize("payload, n", [({"identity": {}}, 1), ([{}, {}, {}], 3), ({"items": [{}]}, 1), ([], 0)])
def test_item_envelopes(spark, tmp_path, payload, n):
    (tmp_path / "i.json").write_text(json.dumps(payload))
    assert read_items_json(spark, str(tmp_path / "i.json")).count() == n


@pytest.mark.parametrize("payload", [[1], "text"])
def test_bad_items(spark, tmp_path, payload):
    (tmp_path / "i.json").write_text(json.dumps(payload))
    with pytest.raises(Exception, match="JSON"):
        read_items_json(spark, str(tmp_path / "i.json")).collect()


def test_guards(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv")
    with pytest.raises(ValueError):
        jobs.build(spark, path, path)
    bad = write_csv(tmp_path / "b.csv", [], ["id", "hinban"])
    with pytest.raises(ValueError, match="header"):
        jobs.build(spark, bad, str(tmp_path / "db"))
    twice = write_csv(tmp_path / "c.csv", [{"id": "A"}, {"id": "A"}])
    with pytest.raises(ValueError, match="not valid"):
        jobs.build(spark, twice, str(tmp_path / "db2"))
    with pytest.raises(ValueError):
        jobs.match(spark, None, None, top_k=0)
