"""The matching queries in DuckDB SQL, written apart from the Spark code.

Substring and alternative-key lookups are brute force here. The fixture texts are in
compatibility form already, so no Unicode step is needed.
"""

from __future__ import annotations

from ..functions.features import MOUNTINGS
from ..functions.text import AVAILABILITY, CATEGORIES
from ..operators.decide import REASONS, VERSION, WARNINGS
from ..operators.evidence import HINTS_SHOWN, RECORD_TEXTS
from .fixtures import CATALOGUE_SQL, DETAILED_CATALOGUE_SQL, DETAILED_ITEMS_SQL, ECHOED, ITEMS_SQL


def _ident(x: str) -> str:
    return f"regexp_replace(upper({x}), '\\s+', '', 'g')"


def _search(x: str) -> str:
    return f"regexp_replace(upper(trim({x})), '[\\s・･,，:：;；]', '', 'g')"


def _relaxed(x: str) -> str:
    return f"regexp_replace({_ident(x)}, '[^A-Z0-9]', '', 'g')"


def _category(x: str) -> str:
    return "case " + " ".join(f"when contains({x}, '{a}') then '{b}'" for a, b in CATEGORIES) + f" else {x} end"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'), lambda n: cast(cast(n as double) as bigint))"


def _dimension(x: str) -> str:
    t = f"replace(lower(regexp_replace({x}, '\\s+', '', 'g')), '×', 'x')"
    return f"case when contains({t}, 'φ') then 'φ' || cast(cast(regexp_extract({t}, 'φ(\\d+)', 1) as bigint) as varchar) when len({_numbers(t)}) >= 2 and contains({t}, 'x') then array_to_string({_numbers(t)}, 'x') else {t} end"


def _water(x: str) -> str:
    wet = f"(contains({x}, '防雨') or contains({x}, '防浸') or regexp_matches({x}, '(^| )IP[0-9]'))"
    return f"case when contains({x}, '対応なし') or contains({x}, '非対応') then 'none' when contains({x}, '防湿') and {wet} then 'damp_and_waterproof' when {wet} then 'waterproof' when contains({x}, '防湿') then 'damp' else 'unknown' end"


def _mounting(x: str) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {' or '.join(f"contains({x}, '{a}')" for a in MOUNTINGS[k])} then '{k}' end" for k in sorted(MOUNTINGS)) + ")"


def _hint(x: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '{pattern}', {group}), '') as double)"


_SPEC = "upper(concat_ws(' ', nullif(key, ''), nullif(view_key, ''), nullif(t_akarusa, ''), nullif(t_kinou, ''), nullif(y_toukyu, ''), nullif(y_kinou, '')))"
_PAIR = "(select a from (values " + ", ".join(f"('{k}', '{v}')" for k, v in AVAILABILITY.items()) + ") m(k, a) where m.k = trim(zaiku))"

def _base(catalogue: str) -> str:
    return f"""
with src as ({catalogue}),
c1 as (
  select *, {_ident("hinban")} as hinban_norm, {_ident("kidou")} as kidou_norm, {_ident("koukyou_kataban1")} as public1_norm, {_ident("koukyou_kataban2")} as public2_norm,
    {_water("boushitsu_bouu")} as wet_primary_norm, {_water("t_kinou")} as wet_feature_norm, {_SPEC} as spec, concat_ws(' ', t_kinou, view_key, key) as dim_text
  from src
), cat as materialized (
  select *, hinban_norm || kidou_norm as full_code_norm, {_relaxed("hinban_norm || kidou_norm")} as full_code_relaxed,
    {_relaxed("public1_norm")} as public1_relaxed, {_relaxed("public2_norm")} as public2_relaxed,
    {_category("kigugroup")} as kigugroup_norm, {_category("t_kigugroup")} as t_kigugroup_norm, {_search("kigustyle")} as kigustyle_norm,
    {_search("key")} as key_norm, {_search("view_key")} as view_key_norm, {_search("t_akarusa")} as brightness_norm, {_search("t_kigubunrui")} as t_kigubunrui_norm,
    {_search("dannetsusekou")} as insulation_norm, {_search("y_kinou")} as y_kinou_norm, {_search("y_toukyu")} as y_toukyu_norm, {_search("y_toritsuke")} as y_toritsuke_norm, {_search("y_hyoujimen")} as y_hyoujimen_norm,
    {_dimension("kigusize")} as fixture_size_norm, {_dimension("umekomi_ana")} as cutout_size_norm, {_mounting("t_toritsuke")} as mounting_norm,
    case when wet_primary_norm = 'unknown' then wet_feature_norm when wet_feature_norm = 'unknown' or wet_feature_norm = wet_primary_norm then wet_primary_norm
      when 'damp_and_waterproof' in (wet_primary_norm, wet_feature_norm) and 'none' not in (wet_primary_norm, wet_feature_norm) then 'damp_and_waterproof' else 'conflict' end as wet_combined_norm,
    case when contains(dim_text, '非調光') or contains(dim_text, '固定出力') then 'false' when contains(dim_text, '調光') then 'true' else 'unknown' end as dimming_norm,
    coalesce({_PAIR}, 'other') as availability_norm,
    coalesce({_hint("view_key", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:lm|LM)")}, {_hint("t_akarusa", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:lm|LM)")}) as luminous_flux_hint,
    coalesce({_hint("spec", r"(?:^|[^A-Z0-9])(\d{4,5})\s*K(?:[^A-Z0-9]|$)")}, 100 * {_hint("spec", r"(?:^|[^A-Z0-9])(27|30|35|40|50|57|65)\s*K(?:[^A-Z0-9]|$)")}) as color_temperature_hint,
    {_hint("spec", r"消費電力\s*[:：]?\s*(\d+(?:\.\d+)?)\s*W")} as power_consumption_hint,
    {_hint("spec", r"(\d+(?:\.\d+)?)\s*[～~\-]\s*(\d+(?:\.\d+)?)\s*V")} as voltage_min_hint,
    {_hint("spec", r"(\d+(?:\.\d+)?)\s*[～~\-]\s*(\d+(?:\.\d+)?)\s*V", 2)} as voltage_max_hint,
    {_hint("spec", r"RA\s*[:：]?\s*(\d+(?:\.\d+)?)")} as cri_hint
  from c1
)
"""


BASE = _base(CATALOGUE_SQL)


def _items(fuzzy_cap: int = 2000, spec_cap: int = 5000) -> str:
    """Items, lookups, scores and decisions; rows go by id, which has the order of the source."""
    return f""", raw as ({ITEMS_SQL}),
i1 as (
  select item_key, {_ident("product_code_raw")} as product_code, {_ident("hinban")} as hinban, {_ident("kidou")} as kidou, {_search("key_hint")} as key_hint, {_category("category")} as category,
    case when cutout_diameter_mm is null then '' else 'φ' || cast(cutout_diameter_mm as varchar) end as cutout_size, {_ident("public_model_code")} as public_code, luminous_flux_lm
  from raw
), item as (
  select *, case when hinban <> '' then hinban || kidou else product_code end as full_code, {_relaxed("product_code")} as product_code_relaxed, {_relaxed("public_code")} as public_relaxed,
    (hinban <> '' or product_code <> '' or public_code <> '') as has_primary_identifier,
    case when hinban <> '' and kidou <> '' then 'hinban+kidou' when product_code <> '' then 'full_code' when hinban <> '' then 'hinban' else '' end as branch
  from i1
), pair as (select item_key, id, 'hinban+kidou' as match_type from item join cat on hinban_norm = hinban and kidou_norm = item.kidou where branch = 'hinban+kidou'),
""".replace("on hinban_norm = hinban and kidou_norm = item.kidou", "on cat.hinban_norm = item.hinban and cat.kidou_norm = item.kidou").replace("select item_key, id, 'hinban", "select item.item_key, cat.id, 'hinban") + f"""
full_hit as (select item.item_key, cat.id, 'full_code' as match_type from item join cat on cat.full_code_norm = item.product_code where branch = 'full_code'),
fallback as (select item.item_key, cat.id, 'hinban' as match_type from item join cat on cat.hinban_norm = item.product_code where branch = 'full_code' and item.item_key not in (select item_key from full_hit)),
base_hit as (select item.item_key, cat.id, 'hinban' as match_type from item join cat on cat.hinban_norm = item.hinban where branch = 'hinban'),
public_hit as (select item.item_key, cat.id, 'public_model_code:' || item.public_code as match_type from item join cat on item.public_code <> '' and (cat.public1_norm = item.public_code or cat.public2_norm = item.public_code)),
exact as (from pair union all from full_hit union all from fallback union all from base_hit union all from public_hit),
val as (
  select distinct item_key, v from (select item_key, unnest([product_code_relaxed, {_relaxed("full_code")}, public_relaxed]) as v from item where has_primary_identifier) where length(v) >= 5
), relaxed_hit as (
  select val.item_key, cat.id, 'relaxed_identifier:' || v as match_type from val join cat on v in (full_code_relaxed, public1_relaxed, public2_relaxed)
), partial_hit as (
  select val.item_key, cat.id, 'partial_identifier:' || v as match_type from val join cat on length(v) >= 6 and (contains(full_code_relaxed, v) or contains(public1_relaxed, v) or contains(public2_relaxed, v))
), spec0 as (
  select item.item_key, item.category, item.cutout_size, cat.id from item join cat
    on (item.category = '' or item.category in (cat.kigugroup_norm, cat.t_kigugroup_norm)) and (item.cutout_size = '' or item.cutout_size = cat.cutout_size_norm)
  where not has_primary_identifier and (item.category <> '' or item.cutout_size <> '')
), back as (
  select item.item_key, cat.id from item join cat on item.category in (cat.kigugroup_norm, cat.t_kigugroup_norm)
  where not has_primary_identifier and item.category <> '' and item.cutout_size <> '' and item.item_key not in (select item_key from spec0)
), spec as (select item_key, id from spec0 union all select item_key, id from back),
spec_item as (
  select item_key, case when item_key in (select item_key from back) then 'category_backoff' else concat_ws(',', case when category <> '' then 'category' end, case when cutout_size <> '' then 'cutout_size' end) end as basis,
    (select count(*) from spec where spec.item_key = item.item_key) as candidate_total
  from item where not has_primary_identifier and (category <> '' or cutout_size <> '')
), loose_all as (from relaxed_hit where item_key not in (select item_key from exact) qualify row_number() over (partition by item_key, match_type order by id) <= {fuzzy_cap + 1}),
part_all as (from partial_hit where item_key not in (select item_key from exact) and item_key not in (select item_key from loose_all) qualify row_number() over (partition by item_key, match_type order by id) <= {fuzzy_cap + 1}),
fuzzy_all as (from loose_all union all from part_all),
fuzzy_total as (select item_key, count(distinct id) as n from fuzzy_all group by 1),
fuzzy_kept as (select item_key, id from fuzzy_all group by 1, 2 qualify row_number() over (partition by item_key order by min(match_type), id) <= {fuzzy_cap}),
loose as (from loose_all where (item_key, id) in (from fuzzy_kept)),
part_hit as (from part_all where (item_key, id) in (from fuzzy_kept)),
spec_kept as (from spec qualify row_number() over (partition by item_key order by id) <= {spec_cap}),
hit as (from exact union all from loose union all from part_hit union all select item_key, id, 'spec_candidate' from spec_kept),
cand as (select item_key, id, list(match_type) as types from hit group by 1, 2),
total as (
  select item_key, count(*) as n from cand where item_key in (select item_key from exact) group by 1 union all from fuzzy_total
  union all select item_key, candidate_total from spec_item where candidate_total > 0
), route as (
  select item_key,
    case when item_key in (select item_key from exact) then 'exact_identifier' when item_key in (select item_key from loose) then 'relaxed_identifier' when item_key in (select item_key from part_hit) then 'partial_identifier'
      when has_primary_identifier then 'identifier_not_found' when category <> '' or cutout_size <> '' then 'specification_search' else 'insufficient_input' end as route,
    case when branch = 'full_code' and item_key in (select item_key from fallback) then 'hinban' else branch end as tried,
    item_key in (select item_key from public_hit) as by_public, coalesce((select n from total where total.item_key = item.item_key), 0) as candidate_total,
    coalesce((select n from fuzzy_total where fuzzy_total.item_key = item.item_key) > {fuzzy_cap}, (select candidate_total from spec_item where spec_item.item_key = item.item_key) > {spec_cap}, false) as truncated
  from item
), scored as (
  select *, case when w >= 0 then w else 0 end + case when category <> '' and group_norm <> '' then case when cat_ok then 12 else -5 end else 0 end
      + case when key_hint <> '' and keys <> '' then case when key_ok then 18 else -5 end else 0 end
      + case when cutout_size <> '' and cutout_size_norm <> '' then case when cut_ok then 18 else -5 end else 0 end
      + case when apart <= 0.1 then 12 when apart > 0.25 then -8 else 0 end + coalesce(round(25 * similarity, 3), 0) as score,
    cast(coalesce(category <> '' and group_norm <> '' and cat_ok, false) as integer) + cast(coalesce(key_hint <> '' and keys <> '' and key_ok, false) as integer)
      + cast(coalesce(cutout_size <> '' and cutout_size_norm <> '' and cut_ok, false) as integer) + cast(coalesce(apart <= 0.1, false) as integer) + cast(similarity is not null as integer) as matched,
    wet_combined_norm = 'conflict' or (category <> '' and group_norm <> '' and not cat_ok) or (key_hint <> '' and keys <> '' and not key_ok)
      or (cutout_size <> '' and cutout_size_norm <> '' and not cut_ok) or coalesce(apart > 0.25, false) as has_conflict,
    case when availability_norm in ('discontinued', 'planned_discontinued') then availability_norm else '' end as lifecycle_warning
  from (
    select cand.item_key, cand.id, item.category, item.key_hint, item.cutout_size, cat.cutout_size_norm, cat.wet_combined_norm, cat.availability_norm,
      case when cat.kigugroup_norm <> '' then cat.kigugroup_norm else cat.t_kigugroup_norm end as group_norm, cat.key_norm || cat.view_key_norm as keys,
      contains(group_norm, item.category) or contains(item.category, group_norm) as cat_ok, contains(keys, item.key_hint) or contains(item.key_hint, keys) as key_ok,
      contains(cat.cutout_size_norm, item.cutout_size) or contains(item.cutout_size, cat.cutout_size_norm) as cut_ok,
      abs(cat.luminous_flux_hint - item.luminous_flux_lm) / greatest(item.luminous_flux_lm, 1.0) as apart,
      list_max(list_transform(types, lambda t: case split_part(t, ':', 1) when 'hinban+kidou' then 100.0 when 'full_code' then 100.0 when 'public_model_code' then 90.0 when 'hinban' then 75.0 when 'relaxed_identifier' then 60.0 when 'partial_identifier' then 35.0 else 0.0 end)) as w,
      case when len(list_filter(types, lambda t: starts_with(t, 'partial'))) > 0 then 2.0 * length(item.product_code_relaxed) / (length(item.product_code_relaxed) + length(cat.full_code_relaxed)) end as similarity
    from cand join item using (item_key) join cat on cat.id = cand.id
  )
), ranked as (select item_key, cast(row_number() over (partition by item_key order by score desc, id) as integer) as rank, id, cast(score as double) as score, matched, has_conflict, lifecycle_warning from scored),
top as (
  select a.item_key, a.id, a.score, a.score - b.score as gap, a.matched, a.has_conflict, a.lifecycle_warning from ranked a left join ranked b on b.item_key = a.item_key and b.rank = 2 where a.rank = 1
), decision as (
  select r.item_key, r.route,
    case when t.id is null then case when r.route = 'insufficient_input' then 'insufficient_input' else 'not_found' end
      when r.route = 'exact_identifier' and r.candidate_total = 1 then case when t.has_conflict then 'conflict' else 'exact_unique' end
      when r.route = 'exact_identifier' then case when coalesce(t.gap, 0) >= 12 and t.matched >= 1 and not t.has_conflict then 'spec_filtered_unique' else 'exact_multiple' end
      when r.route in ('relaxed_identifier', 'partial_identifier') then 'fuzzy_candidates'
      when r.candidate_total = 1 and t.matched >= 2 and not t.has_conflict then 'spec_filtered_unique' else 'spec_candidates' end as status,
    t.id, t.lifecycle_warning, r.candidate_total as candidate_count
  from route r left join top t using (item_key)
)
"""

ITEMS = _items()

_HINTS = {
    "category": "kigugroup_norm <> '' or t_kigugroup_norm <> ''",
    "fixture_size": "fixture_size_norm <> ''",
    "cutout_size": "cutout_size_norm <> ''",
    "mounting": "mounting_norm <> ''",
    "waterproof": "wet_combined_norm <> 'unknown'",
    "dimming": "dimming_norm <> 'unknown'",
    "luminous_flux": "luminous_flux_hint is not null",
    "color_temperature": "color_temperature_hint is not null",
    "power_consumption": "power_consumption_hint is not null",
    "voltage": "voltage_min_hint is not null",
    "cri": "cri_hint is not null",
}
_DECISION = """select item_key, route, status,
  case when status in ('conflict', 'exact_unique', 'spec_filtered_unique') then id else '' end as selected_id,
  case when status = 'exact_unique' or (status = 'spec_filtered_unique' and route = 'exact_identifier') then lifecycle_warning <> '' else true end as review_required,
  candidate_count from decision"""


def _hit(name: str) -> str:
    return f"select item_key, id, match_type from {name}"


def _columns(*names: str) -> str:
    return f"select id, {', '.join(names)} from cat"


_CATALOGUE = {
    "catalogue_identifiers": _columns("hinban_norm", "kidou_norm", "full_code_norm", "full_code_relaxed", "public1_norm", "public2_norm", "public1_relaxed", "public2_relaxed"),
    "catalogue_category": _columns("kigugroup_norm", "t_kigugroup_norm", "kigustyle_norm"),
    "catalogue_search_text": _columns("key_norm", "view_key_norm", "brightness_norm", "t_kigubunrui_norm", "insulation_norm", "y_kinou_norm"),
    "catalogue_mounting": _columns("mounting_norm"),
    "catalogue_availability": _columns("availability_norm"),
    "catalogue_dimensions": _columns("fixture_size_norm", "cutout_size_norm"),
    "catalogue_waterproof": _columns("wet_primary_norm", "wet_feature_norm", "wet_combined_norm"),
    "catalogue_dimming": _columns("dimming_norm"),
    "catalogue_hints": _columns("luminous_flux_hint", "color_temperature_hint", "power_consumption_hint", "voltage_min_hint", "voltage_max_hint", "cri_hint"),
    "catalogue_price": _columns("cast(price_zeinuki as double) as price_zeinuki"),
    "catalogue_text_nfkc": _columns("hinban_norm", "kidou_norm", "full_code_relaxed", "fixture_size_norm", "luminous_flux_hint", "color_temperature_hint", "cri_hint"),
    "build_report": "select count(*) as row_count, count(distinct id) as unique_id_count, count(distinct hinban_norm) as unique_hinban_count, count(distinct full_code_norm) as unique_full_code_count,"
    " (select count(*) from (select 1 from cat group by full_code_norm having count(*) > 1)) as duplicate_full_code_groups, " + ", ".join(f"count(*) filter (where {v}) as {k}" for k, v in _HINTS.items()) + " from cat",
    "duplicate_groups": "select full_code_norm, count(*) as row_count from cat group by 1 having count(*) > 1",
    "status_histogram": "select zaiku, count(*) as row_count from cat group by 1",
    "validation_counts": "select count(*) as row_count, count(distinct id) as unique_id_count from cat",
}
_MATCHING = {
    "items_normalized": "select item_key, product_code, product_code_relaxed, hinban, kidou, full_code, key_hint, category, cutout_size, '' as fixture_size, 'unknown' as waterproof, 'unknown' as dimming,"
    " public_code as public_codes, public_relaxed as public_codes_relaxed, luminous_flux_lm, has_primary_identifier from item",
    "items_variant_json": "select item_key, full_code, category, cutout_size, luminous_flux_lm, public_code as public_codes from item",
    "join_exact_pair": _hit("pair"),
    "join_full_code": _hit("full_hit"),
    "join_hinban_fallback": _hit("fallback"),
    "join_hinban": _hit("base_hit"),
    "join_public_code": _hit("public_hit"),
    "join_relaxed": _hit("relaxed_hit"),
    "join_partial": _hit("partial_hit"),
    "spec_search": "select item_key, id from spec_kept",
    "spec_counts": "select item_key, basis, candidate_total, candidate_total > 5000 as truncated from spec_item",
    "spec_backoff": "select item_key, candidate_total from spec_item where basis = 'category_backoff'",
    "route_per_item": """select item_key, route, case route when 'exact_identifier' then concat_ws(',', nullif(tried, ''), case when by_public then 'public_model_code' end)
      when 'relaxed_identifier' then route when 'partial_identifier' then route when 'identifier_not_found' then coalesce(nullif(tried, ''), 'identifier')
      when 'specification_search' then (select basis from spec_item where spec_item.item_key = route.item_key) else '' end as basis, candidate_total, truncated from route""",
    "candidate_scores": "select item_key, id, score, matched, has_conflict, lifecycle_warning from ranked",
    "identifier_similarity": "select item_key, id, round(similarity, 3) as similarity from scored where similarity is not null",
    "ranked_topk": "select item_key, rank, id, score from ranked where rank <= 10",
    "score_gap": "select item_key, id, round(gap, 3) as score_gap from top",
    "match_decisions": _DECISION,
    "decision_summary": f"select status, count(*) as item_count from ({_DECISION}) group by 1",
}
#: The rules over the detailed fixture: field, when it speaks for a pair, when against it, weight and penalty.
_PAIR_TEXTS = {
    "style": ("style", "kigustyle_norm", 4, 2),
    "brightness": ("brightness", "brightness_norm || key_norm || view_key_norm", 10, 5),
    "fixture_size": ("fixture_size", "fixture_size_norm", 14, 5),
    "cutout_size": ("cutout_size", "cutout_size_norm", 18, 5),
    "category": ("category", "case when kigugroup_norm <> '' then kigugroup_norm else t_kigugroup_norm end", 12, 5),
    **{k: (k, f"{k}_norm", 10, 5) for k in ("y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou")},
}
_WET = "case when i.waterproof = 'unknown' or wet_combined_norm in ('unknown', 'conflict') then null else i.waterproof = wet_combined_norm or (i.waterproof in ('damp', 'waterproof') and wet_combined_norm = 'damp_and_waterproof') end"
_PAIR_RULES = [
    (f, f"i.{a} <> '' and {b} <> '' and (contains({b}, i.{a}) or contains(i.{a}, {b}))", f"i.{a} <> '' and {b} <> '' and not (contains({b}, i.{a}) or contains(i.{a}, {b}))", w, p)
    for f, (a, b, w, p) in _PAIR_TEXTS.items()
] + [
    ("mounting", "i.mounting <> '' and contains(mounting_norm, i.mounting)", "i.mounting <> '' and mounting_norm <> '' and not contains(mounting_norm, i.mounting)", 14, 7),
    ("waterproof", f"coalesce({_WET}, false)", f"coalesce(not ({_WET}), false)", 14, 12),
    ("waterproof", "false", "i.waterproof <> 'unknown' and wet_combined_norm = 'conflict'", 0, 0),
    ("dimming", "i.dimming <> 'unknown' and dimming_norm <> 'unknown' and i.dimming = dimming_norm", "i.dimming <> 'unknown' and dimming_norm <> 'unknown' and i.dimming <> dimming_norm", 14, 12),
    ("color_temperature_k", "abs(color_temperature_hint - i.color_temperature_k) <= 150", "abs(color_temperature_hint - i.color_temperature_k) > 500", 12, 10),
    ("power_consumption_w", "abs(power_consumption_hint - i.power_consumption_w) / greatest(i.power_consumption_w, 0.1) <= 0.1", "abs(power_consumption_hint - i.power_consumption_w) / greatest(i.power_consumption_w, 0.1) > 0.25", 10, 7),
    ("voltage", "voltage_min_hint <= i.low and i.high <= voltage_max_hint", "i.high < voltage_min_hint or i.low > voltage_max_hint", 8, 8),
    ("cri_ra", "abs(cri_hint - i.cri_ra) <= 2", "abs(cri_hint - i.cri_ra) > 5", 6, 4),
]
DETAILED = _base(DETAILED_CATALOGUE_SQL) + f""", raw as ({DETAILED_ITEMS_SQL}),
item as materialized (
  select item_key, hinban, list_filter([public_one, public_two], lambda x: x <> '') as codes, {_category("category")} as category, {_search("style")} as style, {_search("brightness")} as brightness,
    case when fixture_text = '' then '' else {_dimension("fixture_text")} end as fixture_size, case when cutout_text = '' then '' else {_dimension("cutout_text")} end as cutout_size,
    {_search("y_toukyu")} as y_toukyu, {_search("y_toritsuke")} as y_toritsuke, {_search("y_hyoujimen")} as y_hyoujimen, {_search("y_kinou")} as y_kinou, {_mounting("mounting")} as mounting,
    {_water("waterproof_text")} as waterproof, case dimming_text when '' then 'unknown' when '調光' then 'true' else 'false' end as dimming, cast(color_temperature_k as double) as color_temperature_k,
    cast(power_consumption_w as double) as power_consumption_w, cast(cri_ra as double) as cri_ra, cast(nullif(regexp_extract(voltage_text, '([0-9]+)', 1), '') as double) as low,
    cast(nullif(regexp_extract(voltage_text, '([0-9]+)V', 1), '') as double) as high, uncertain
  from raw
), code as (select item_key, unnest(codes) as code, generate_subscripts(codes, 1) as place from item),
public as (select id, public1_norm as code from cat where public1_norm <> '' union select id, public2_norm from cat where public2_norm <> ''),
kind as materialized (
  select item_key, id, 'hinban' as match_type, 75.0 as w, 0 as place from item join cat on cat.hinban_norm = item.hinban and item.hinban <> ''
  union all select item_key, id, 'public_model_code:' || code, 90.0, place from code join public using (code)
), asked as (select * from item where hinban = '' and len(codes) = 0 and (category <> '' or cutout_size <> '' or fixture_size <> '')),
spec0 as materialized (
  select item_key, id from asked i join cat on (i.category = '' or i.category in (kigugroup_norm, t_kigugroup_norm)) and (i.cutout_size = '' or i.cutout_size = cutout_size_norm) and (i.fixture_size = '' or i.fixture_size = fixture_size_norm)
), back as materialized (
  select item_key, id from asked i join cat on i.category in (kigugroup_norm, t_kigugroup_norm) where i.category <> '' and i.cutout_size || i.fixture_size <> '' and item_key not in (select item_key from spec0)
), spec as (from spec0 union all from back),
found as materialized (from kind union all select item_key, id, 'spec_candidate', 0.0, 0 from (from spec qualify row_number() over (partition by item_key order by id) <= 5000)),
pair as materialized (select item_key, id, max(w) as w, array_to_string(list(match_type order by place), ',') as match_types from found group by 1, 2),
total as (select item_key, count(distinct id) as n, false as truncated from kind group by 1 union all select item_key, count(*), count(*) > 5000 from spec group by 1),
spoken as (
  select p.item_key, p.id, unnest([{", ".join(f"struct_pack(field := '{f}', m := coalesce({m}, false), c := coalesce({c}, false), w := cast({w} as double), p := cast({p} as double))" for f, m, c, w, p in _PAIR_RULES)}]) as r
  from pair p join item i using (item_key) join cat on cat.id = p.id
), entry as materialized (
  select item_key, id, r.field as field, case when r.m then '+' else '-' end as sign, case when r.m then r.w else 0 end as weight, case when r.m then r.w else -r.p end as points from spoken where r.m or r.c
), score as (
  select p.item_key, p.id, any_value(p.w) + coalesce(sum(points), 0) as score, count(*) filter (where sign = '+') as matched, count(*) filter (where sign = '-') as against
  from pair p left join entry e on e.item_key = p.item_key and e.id = p.id group by p.item_key, p.id
), place as materialized (select *, cast(row_number() over (partition by item_key order by score desc, id) as integer) as rank from score),
route as (
  select item.*, coalesce(total.n, 0) as candidate_count, coalesce(total.truncated, false) as truncated, item_key in (select item_key from kind where match_type <> 'hinban') as by_public, item_key in (select item_key from back) as backed,
    case when item_key in (select item_key from kind) then 'exact_identifier' when hinban <> '' or len(codes) > 0 then 'identifier_not_found'
      when category <> '' or cutout_size <> '' or fixture_size <> '' then 'specification_search' else 'insufficient_input' end as route
  from item left join total using (item_key)
)
"""
_CAPPED = f"{BASE}{_items(1, 7)}"
_DETAILED = {
    "evidence_entries": "select item_key, rank, id, cast(score as double) as score, field, sign, weight from place join (select item_key, id, field, sign, weight from entry union all select item_key, id, 'identifier', '+', cast(w as double) from found) using (item_key, id) where rank <= 10",
    "result_search": """select item_key, route, candidate_count, least(10, candidate_count) as returned_count,
      case when uncertain <> '' then 'input_contains_uncertain_fields' else '' end as warnings, array_to_string(codes, ',') as public_codes, '部品' || item_key as component_codes from route""",
    "catalogue_installation": _columns("insulation_norm", "y_toukyu_norm", "y_toritsuke_norm", "y_hyoujimen_norm", "wet_combined_norm", "public2_norm", "dannetsusekou", "bumon", "hatsubai_date"),
}
_REASON = {k: "'" + v.replace("'", "''") + "'" for k, v in REASONS.items()}
_ECHO = f", echo as (select item_key, {', '.join(f'{v} as {c}' for c, v in ECHOED.items())} from (select item_key, cast(item_key as bigint) as k from raw))"
_DOCUMENTS = {
    "result_items": f"""select item_key, source_file, page, item_no, drawing_label, coalesce({_search("manufacturer")}, '') as manufacturer, category, style, hinban, '' as kidou, hinban as full_code, fixture_size, cutout_size, mounting,
      nullif(waterproof, 'unknown') as waterproof, nullif(dimming, 'unknown') as dimming, brightness, color_temperature_k, power_consumption_w, coalesce(low, high) as voltage_min_v, high as voltage_max_v, cri_ra, uncertain as uncertain_fields
      from item join echo using (item_key)""",
    "result_decisions": f"""select item_key, '{VERSION}' as matcher_version, route,
      case route when 'exact_identifier' then concat_ws(',', case when hinban <> '' then 'hinban' end, case when by_public then 'public_model_code' end) when 'identifier_not_found' then case when hinban <> '' then 'hinban' else 'identifier' end
        when 'specification_search' then case when backed then 'category_backoff' else concat_ws(',', case when category <> '' then 'category' end, case when cutout_size <> '' then 'cutout_size' end, case when fixture_size <> '' then 'fixture_size' end) end else '' end as basis,
      candidate_count, truncated, status, case when status in ('conflict', 'exact_unique', 'spec_filtered_unique') then id else '' end as selected_id,
      case when status = 'exact_unique' then lifecycle or doubtful when status = 'spec_filtered_unique' and route = 'exact_identifier' then lifecycle else true end as review_required,
      case status when 'insufficient_input' then {_REASON["insufficient"]} when 'not_found' then {_REASON["not_found"]} when 'conflict' then {_REASON["conflict"]}
        when 'exact_unique' then {_REASON["unique"]} || case when lifecycle then {_REASON["lifecycle"]} else '' end || case when doubtful then {_REASON["uncertain"]} else '' end
        when 'spec_filtered_unique' then case when route = 'exact_identifier' then {_REASON["separated"]} else {_REASON["spec_unique"]} end when 'exact_multiple' then {_REASON["multiple"]} else {_REASON["spec"]} end as reason,
      case when status = 'spec_filtered_unique' and route = 'exact_identifier' then cast(round(gap, 3) as double) end as score_gap, case when status = 'spec_candidates' then cast(round(coalesce(gap, score), 3) as double) end as top_score_gap,
      concat_ws(',', case when truncated then '{WARNINGS[0]}' end, case when manufacturer <> '' then '{WARNINGS[1]}' end, case when uncertain <> '' then '{WARNINGS[2]}' end) as warnings
      from (
        select *, contains(uncertain, 'identity.') as doubtful, case when id is null then case when route = 'insufficient_input' then route else 'not_found' end
          when route = 'exact_identifier' and candidate_count = 1 then case when conflict then 'conflict' else 'exact_unique' end
          when route = 'exact_identifier' then case when coalesce(gap, 0) >= 12 and matched >= 1 and not conflict then 'spec_filtered_unique' else 'exact_multiple' end
          when candidate_count = 1 and matched >= 2 and not conflict then 'spec_filtered_unique' else 'spec_candidates' end as status
        from route join echo using (item_key) left join (
          select a.item_key, a.id, a.score, a.matched, a.score - b.score as gap, a.against > 0 or wet_combined_norm = 'conflict' as conflict, availability_norm in ('discontinued', 'planned_discontinued') as lifecycle
          from place a join cat on cat.id = a.id left join place b on b.item_key = a.item_key and b.rank = 2 where a.rank = 1) top using (item_key))""",
    "result_candidates": f"""select item_key, rank, cat.id, cast(score as double) as score, match_types, hinban_norm || case when kidou_norm <> '' then ' ' || kidou_norm else '' end as full_code, availability_norm as availability,
      case when wet_combined_norm = 'conflict' then 'db_internal_waterproof_conflict' else '' end as db_internal_warnings, case when availability_norm in ('discontinued', 'planned_discontinued') then availability_norm else '' end as lifecycle_warning,
      {", ".join(f"cat.{c}" for c in RECORD_TEXTS)}, cast(cat.price_zeinuki as double) as price_zeinuki, {", ".join(f"{v} as {k}" for k, v in HINTS_SHOWN.items())}
      from place join pair using (item_key, id) join cat using (id) where rank <= 10""",
}
_CAPPED_QUERIES = {
    "capped_candidates": "select item_key, id, cast(len(types) as bigint) as hits from cand",
    "capped_routes": "select item_key, route, candidate_total, truncated from route",
}
ORACLES = {k: f"{DETAILED} {v}" for k, v in _DETAILED.items()} | {k: f"{DETAILED}{_ECHO} {v}" for k, v in _DOCUMENTS.items()} | {k: f"{_CAPPED} {v}" for k, v in _CAPPED_QUERIES.items()} | {k: f"{BASE} {v}" for k, v in _CATALOGUE.items()} | {k: f"{BASE}{ITEMS} {v}" for k, v in _MATCHING.items()}
