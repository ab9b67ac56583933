"""The normalized catalogue: derived columns, validation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, numbers, text
from ..stage import staged

# The source columns in order.
SOURCE_COLUMNS = [
    "id", "hinban", "kidou", "key", "view_key", "bumon", "kigugroup", "kigustyle", "t_kigubunrui", "t_kigugroup",
    "price_zeinuki", "hatsubai_date", "seisan_end_date", "zaiku", "koukyou_kataban1", "koukyou_kataban2",
    "t_akarusa", "kigusize", "umekomi_ana", "t_toritsuke", "boushitsu_bouu", "t_kinou", "dannetsusekou", "y_toukyu",
    "y_toritsuke", "y_hyoujimen", "y_kinou",
]
CLEANED = [c for c in SOURCE_COLUMNS if c not in ("id", "bumon", "price_zeinuki", "hatsubai_date", "seisan_end_date")]
SCHEMA_VERSION = "catalogue/v1"


def normalize_catalogue(source: DataFrame) -> DataFrame:
    """63 columns from the 27 of the source and, if there, its ``source_row``.

    Source strings are carried as they are, with null as the empty string; derived texts are
    empty and derived numbers null where the source says nothing.
    """
    if "source_row" not in source.columns:
        source = source.withColumn("source_row", F.lit(None).cast("long"))
    filled = source.select("source_row", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SOURCE_COLUMNS))
    t = text.cleaned(filled, CLEANED)
    c = lambda name: F.col(f"_{name}")
    t = t.withColumns(
        {
            "hinban_norm": text.identifier(c("hinban")),
            "kidou_norm": text.identifier(c("kidou")),
            "public1_norm": text.identifier(c("koukyou_kataban1")),
            "public2_norm": text.identifier(c("koukyou_kataban2")),
            "wet_primary_norm": features.water(c("boushitsu_bouu")),
            "wet_feature_norm": features.water(c("t_kinou")),
            "_specification": F.concat_ws(" ", *(text.or_null(c(k)) for k in ("key", "view_key", "t_akarusa", "t_kinou", "y_toukyu", "y_kinou"))),
            "_dimming": F.concat_ws(" ", *(text.or_null(c(k)) for k in ("t_kinou", "view_key", "key"))),
        }
    )
    low, high = numbers.voltage(F.col("_specification"))
    derived = {
        "source_row": F.col("source_row"),
        "hinban_norm": F.col("hinban_norm"),
        "kidou_norm": F.col("kidou_norm"),
        "full_code_norm": F.concat("hinban_norm", "kidou_norm"),
        "full_code_relaxed": text.relaxed(F.concat("hinban_norm", "kidou_norm")),
        "key_norm": text.search_text(c("key")),
        "view_key_norm": text.search_text(c("view_key")),
        "kigugroup_norm": text.category(c("kigugroup")),
        "kigustyle_norm": text.search_text(c("kigustyle")),
        "t_kigugroup_norm": text.category(c("t_kigugroup")),
        "t_kigubunrui_norm": text.search_text(c("t_kigubunrui")),
        "brightness_norm": text.search_text(c("t_akarusa")),
        "fixture_size_norm": numbers.dimension(c("kigusize")),
        "cutout_size_norm": numbers.dimension(c("umekomi_ana")),
        "mounting_norm": features.mounting(c("t_toritsuke")),
        "wet_primary_norm": F.col("wet_primary_norm"),
        "wet_feature_norm": F.col("wet_feature_norm"),
        "wet_combined_norm": features.water_combined(F.col("wet_primary_norm"), F.col("wet_feature_norm")),
        "dimming_norm": features.dimming(F.col("_dimming")),
        "availability_norm": text.availability(c("zaiku")),
        "public1_norm": F.col("public1_norm"),
        "public2_norm": F.col("public2_norm"),
        "public1_relaxed": text.relaxed(F.col("public1_norm")),
        "public2_relaxed": text.relaxed(F.col("public2_norm")),
        "insulation_norm": text.search_text(c("dannetsusekou")),
        **{f"{k}_norm": text.search_text(c(k)) for k in ("y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou")},
        "luminous_flux_hint": F.coalesce(numbers.luminous_flux(c("view_key")), numbers.luminous_flux(c("t_akarusa"))),
        "color_temperature_hint": numbers.colour_temperature(F.col("_specification")),
        "power_consumption_hint": numbers.power(F.col("_specification")),
        "voltage_min_hint": low,
        "voltage_max_hint": high,
        "cri_hint": numbers.rendering_index(F.col("_specification")),
        "price_zeinuki": numbers.price(F.col("price_zeinuki")),
    }
    carried = [F.col(k).alias("price_zeinuki_text" if k == "price_zeinuki" else k) for k in SOURCE_COLUMNS]
    return t.select(*carried, *(v.alias(k) for k, v in derived.items()))


def validation(catalogue: DataFrame) -> DataFrame:
    """One row: rows and distinct ids."""
    return catalogue.agg(F.count("*").alias("row_count"), F.count_distinct("id").alias("unique_id_count"))


def check_valid(catalogue: DataFrame, source_rows: int) -> None:
    """Raise unless every source row is there under an id of its own."""
    r = validation(catalogue).first()
    if not r["row_count"] == r["unique_id_count"] == source_rows:
        raise ValueError(f"the catalogue is not valid: {source_rows} source rows, {r['row_count']} rows, {r['unique_id_count']} ids")


HINT_COLUMNS = ["kigugroup_norm", "t_kigugroup_norm", "fixture_size_norm", "cutout_size_norm", "mounting_norm", "wet_combined_norm", "dimming_norm", "luminous_flux_hint", "color_temperature_hint", "power_consumption_hint", "voltage_min_hint", "cri_hint"]


def hint_counts(catalogue: DataFrame) -> DataFrame:
    """One row: how many catalogue rows have each kind of hint."""
    c = F.col
    known = {
        "category": (c("kigugroup_norm") != "") | (c("t_kigugroup_norm") != ""),
        "fixture_size": c("fixture_size_norm") != "",
        "cutout_size": c("cutout_size_norm") != "",
        "mounting": F.size("mounting_norm") > 0,
        "waterproof": c("wet_combined_norm") != "unknown",
        "dimming": c("dimming_norm") != "unknown",
        "luminous_flux": c("luminous_flux_hint").isNotNull(),
        "color_temperature": c("color_temperature_hint").isNotNull(),
        "power_consumption": c("power_consumption_hint").isNotNull(),
        "voltage": c("voltage_min_hint").isNotNull(),
        "cri": c("cri_hint").isNotNull(),
    }
    return catalogue.agg(*(F.count_if(v).alias(k) for k, v in known.items()))


def duplicate_groups(catalogue: DataFrame) -> DataFrame:
    """Full codes that more than one row has, with their rows."""
    return catalogue.groupBy("full_code_norm").agg(F.count("*").alias("row_count")).where("row_count > 1")


def status_counts(catalogue: DataFrame) -> DataFrame:
    """Rows by the stock text as it stands in the source."""
    return catalogue.groupBy("zaiku").agg(F.count("*").alias("row_count"))


def build_report(catalogue: DataFrame) -> DataFrame:
    """One row with all statistics of a build; the catalogue is read once."""
    catalogue = staged(catalogue.select("id", "hinban_norm", "full_code_norm", "zaiku", *HINT_COLUMNS), "report")
    codes = catalogue.agg(F.count_distinct("hinban_norm").alias("unique_hinban_count"), F.count_distinct("full_code_norm").alias("unique_full_code_count"))
    groups = duplicate_groups(catalogue).agg(F.count("*").alias("duplicate_full_code_groups"))
    states = status_counts(catalogue).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("zaiku", "row_count")))).alias("status_counts"))
    hints = hint_counts(catalogue)
    hints = hints.select(F.struct(*hints.columns).alias("normalized_hint_counts"))
    out = validation(catalogue).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "*")
    for one in (codes, groups, states, hints):  # each a single row
        out = out.join(F.broadcast(one))
    return out
