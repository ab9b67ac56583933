"""Normalized items: one product read off a drawing, by the rules of the catalogue.

``normalize_items`` takes the flat raw schema :data:`RAW_ITEM`, which the JSON source makes
from nested records and which tables can give directly. Absent texts are empty and absent
numbers null in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features, numbers, text
from ..stage import large

TEXTS = ["manufacturer", "category", "style", "hinban", "kidou", "product_code", "visual_code", "key_hint", "brightness", "y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou"]
NUMBERS = ["luminous_flux_lm", "color_temperature_k", "power_consumption_w", "cri_ra"]
SIZES = ["fixture_size", "cutout_size"]
FLAGS = ["waterproof", "dimming"]

#: Raw items. A number comes as ``_num`` or as text, a size as typed parts or as text, a flag as ``_flag`` or as text.
RAW_ITEM = T.StructType(
    [T.StructField("item_key", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("page", T.LongType()), T.StructField("item_no", T.LongType()), T.StructField("drawing_label", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in TEXTS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("public_codes", "component_codes", "mounting", "uncertain_fields")]
    + [f for c in NUMBERS for f in (T.StructField(f"{c}_num", T.DoubleType()), T.StructField(f"{c}_text", T.StringType()))]
    + [T.StructField("voltage_min_num", T.DoubleType()), T.StructField("voltage_max_num", T.DoubleType()), T.StructField("voltage_text", T.StringType())]
    + [T.StructField(f"{c}_{k}", T.StringType()) for c in SIZES for k in ("diameter", "width", "height", "length", "text")]
    + [f for c in FLAGS for f in (T.StructField(f"{c}_flag", T.BooleanType()), T.StructField(f"{c}_text", T.StringType()))]
)
#: Joins the texts of a list, so that no pattern matches across two of them.
JOIN = "\u0001"


def raw_items(df: DataFrame) -> DataFrame:
    """``df`` with every missing raw column added as null, others dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_ITEM))


def normalize_items(raw: DataFrame) -> DataFrame:
    lists = {c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), JOIN) for c in ("public_codes", "component_codes", "mounting")}
    t = raw_items(raw).withColumns({f"{c}_list": v for c, v in lists.items()})
    plain = TEXTS + [f"{c}_text" for c in (*NUMBERS, "voltage", *SIZES, *FLAGS)]
    t = text.cleaned(t, [*plain, *(f"{c}_list" for c in lists)])
    c = lambda name: F.col(f"_{name}")

    def codes(name: str) -> Column:
        return F.filter(F.transform(F.split(c(f"{name}_list"), JOIN), lambda x: text.identifier(x)), lambda x: x != "")

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_num"), F.when(F.col(f"{name}_text").isNotNull(), numbers.first_number(c(f"{name}_text"))))

    def size(name: str) -> Column:
        typed = [F.col(f"{name}_{k}") for k in ("diameter", "width", "height", "length")]
        return numbers.dimension_of_parts(*typed, F.when(F.col(f"{name}_text").isNotNull(), c(f"{name}_text")))

    t = t.withColumns({"_h": text.identifier(c("hinban")), "_k": text.identifier(c("kidou")), "_v": text.identifier(c("visual_code")), "_p": text.identifier(c("product_code"))})
    t = t.withColumn("_k", F.when((F.col("_h") != "") & (F.col("_k") == "") & F.startswith("_v", "_h"), F.expr("substring(_v, length(_h) + 1)")).otherwise(F.col("_k")))
    low, high = numbers.voltage(c("voltage_text"))
    typed_low, typed_high = F.col("voltage_min_num"), F.col("voltage_max_num")
    typed = typed_low.isNotNull() | typed_high.isNotNull()
    out = t.select(
        "item_key",
        "source_file",
        "page",
        "item_no",
        "drawing_label",
        text.search_text(c("manufacturer")).alias("manufacturer"),
        text.category(c("category")).alias("category"),
        text.search_text(c("style")).alias("style"),
        F.col("_p").alias("product_code"),
        text.relaxed(F.col("_p")).alias("product_code_relaxed"),
        F.col("_h").alias("hinban"),
        F.col("_k").alias("kidou"),
        F.when(F.col("_h") != "", F.concat("_h", "_k")).otherwise(F.col("_p")).alias("full_code"),
        text.search_text(c("key_hint")).alias("key_hint"),
        codes("public_codes").alias("public_codes"),
        F.transform(codes("public_codes"), text.relaxed).alias("public_codes_relaxed"),
        codes("component_codes").alias("component_codes"),
        size("fixture_size").alias("fixture_size"),
        size("cutout_size").alias("cutout_size"),
        features.mounting(c("mounting_list")).alias("mounting"),
        features.water_of(F.col("waterproof_flag"), c("waterproof_text")).alias("waterproof"),
        features.dimming_of(F.col("dimming_flag"), c("dimming_text")).alias("dimming"),
        text.search_text(c("brightness")).alias("brightness"),
        *(number(n).alias(n) for n in NUMBERS[:3]),
        F.when(typed, F.coalesce(typed_low, typed_high)).otherwise(low).alias("voltage_min_v"),
        F.when(typed, F.coalesce(typed_high, typed_low)).otherwise(high).alias("voltage_max_v"),
        number("cri_ra").alias("cri_ra"),
        *(text.search_text(c(k)).alias(k) for k in ("y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou")),
        F.coalesce("uncertain_fields", F.array().cast("array<string>")).alias("uncertain_fields"),
    )
    known = (F.col("full_code") != "") | (F.col("product_code") != "") | (F.col("hinban") != "") | (F.size("public_codes") > 0)
    return out.withColumn("has_primary_identifier", known)


#: What tells where an item was read; it has no part in matching.
ECHO = ["item_key", "source_file", "page", "item_no", "drawing_label"]


def with_question(items: DataFrame) -> DataFrame:
    """Add ``question``, equal for items that are equal in all that matching reads: a 128-bit digest."""
    asked = [c for c in items.columns if c not in ECHO]
    return items.withColumn("question", F.md5(F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}).cast("binary")))


def questions(items: DataFrame) -> DataFrame:
    """One item for each distinct question, with the question as its key."""
    asked = [c for c in items.columns if c not in (*ECHO, "question")]
    firsts = items.groupBy("question").agg(F.first(F.struct(*asked)).alias("asked"))
    return firsts.select(F.col("question").alias("item_key"), "asked.*")


def per_item(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Rows keyed by question as rows keyed by item."""
    named = items.select("item_key", "question")
    return answers.withColumnRenamed("item_key", "question").join(large(named), "question").select("item_key", *(c for c in answers.columns if c != "item_key"))


def public_view(item: str | None = None) -> Column:
    """The normalized item as it is shown: absent values null, forms for matching left out."""
    c = lambda name: F.col(f"{item}.{name}" if item else name)
    shown = ["manufacturer", "category", "style", "product_code", "hinban", "kidou", "full_code", "key_hint"]
    return F.struct(
        *(text.or_null(c(k)).alias(k) for k in shown),
        c("public_codes").alias("public_model_codes"),
        c("component_codes"),
        *(text.or_null(c(k)).alias(k) for k in SIZES),
        c("mounting"),
        *(F.nullif(c(k), F.lit("unknown")).alias(k) for k in FLAGS),
        text.or_null(c("brightness")).alias("brightness"),
        *(c(k) for k in NUMBERS[:3]),
        F.when(c("voltage_min_v").isNotNull(), F.struct(c("voltage_min_v").alias("min_v"), c("voltage_max_v").alias("max_v"))).alias("voltage"),
        c("cri_ra"),
        c("uncertain_fields"),
    )


def source_view() -> Column:
    return F.struct("source_file", "page", "item_no", "drawing_label")
