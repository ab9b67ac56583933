"""Item JSON: nested records with fields that are scalars or ``{value, raw}`` objects, as a raw item table.

A file holds one item, an array of items, or an object with an ``items`` array, and is read by as many tasks as it has
splits; so are JSON lines of one item each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import FLAGS, NUMBERS, SIZES
from .json_elements import read_elements


def read_items_json(spark: SparkSession, path: str) -> DataFrame:
    """(item_key, v): every item as a variant, keyed by its file and place."""
    rows = read_elements(spark, path).select(F.concat_ws("#", "file", F.col("pos").cast("string")).alias("item_key"), F.parse_json("text").alias("v"))
    return _checked(rows)


def read_items_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(item_key, v) from JSON lines, one item a line; the key is the file and the place in it of the line's block and row."""
    rows = spark.read.format("json").option("singleVariantColumn", "v").load(path).select("v", "_metadata.file_path")
    return _checked(rows.select(F.concat_ws("#", "file_path", F.monotonically_increasing_id().cast("string")).alias("item_key"), "v"))


def items_of_strings(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(item_key, v) from a table that has an item's JSON in a column."""
    return _checked(df.select(F.col(key).cast("string").alias("item_key"), F.parse_json(payload).alias("v")))


def _checked(items: DataFrame) -> DataFrame:
    ok = F.schema_of_variant("v").startswith("OBJECT")
    return items.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("every item must be a JSON object")).cast("variant")))


# Access to fields. An absent field is null, and so is a JSON null.


def _get(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(x), x)


def _first(v: Column, parent: str, *names: str) -> Column:
    """The first field that is there and not null; the empty string counts."""
    return F.coalesce(*(_get(v, f"$.{parent}.{n}") for n in names))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "BOOLEAN"), F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "string"))


def _scalar(v: Column) -> Column:
    """The value of a typed field: its value, raw text, diameter or length, whichever comes first."""
    inner = F.coalesce(*(_get(v, f"$.{k}") for k in ("value", "raw", "diameter_mm", "length_mm")))
    return F.when(_is(v, "OBJECT"), inner).otherwise(v)


def _number(v: Column) -> tuple[Column, Column]:
    """A number, or the text in which one may be found; booleans are neither."""
    s = _scalar(v)
    numeric = _is(s, "BIGINT") | _is(s, "DECIMAL") | _is(s, "DOUBLE")
    return F.when(numeric, F.try_variant_get(s, "$", "double")), F.when(~numeric & ~_is(s, "BOOLEAN"), _text(s))


def _flag(v: Column, positive: str | None) -> tuple[Column, Column]:
    """A boolean, or the text to read one from. ``positive``: the text for true where no raw text says more."""
    inner = _get(v, "$.value")
    typed, said = _is(v, "OBJECT"), _is(inner, "BOOLEAN")
    raw_there = F.try_variant_get(v, "$.raw", "variant").isNotNull()
    raw = _get(v, "$.raw")
    plain = F.when(typed, F.when(raw_there, raw).otherwise(inner)).otherwise(v)
    value = F.try_variant_get(inner, "$", "boolean")
    if positive is None:
        return F.when(typed & said, value).when(_is(plain, "BOOLEAN"), F.try_variant_get(plain, "$", "boolean")), F.when(~(typed & said) & ~_is(plain, "BOOLEAN"), _text(plain))
    yes = F.coalesce(F.nullif(_text(raw), F.lit("")), F.lit(positive))
    flag = F.when(typed & said, F.when(~value, F.lit(False))).when(_is(plain, "BOOLEAN"), F.try_variant_get(plain, "$", "boolean"))
    return flag, F.when(typed & said & value, yes).when(~(typed & said) & ~_is(plain, "BOOLEAN"), _text(plain))


def _list(v: Column) -> Column:
    """An array field as variants; a single value is a list of one."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(_is(v, "ARRAY"), many).when(v.isNotNull(), F.array(v))


def raw_of_variants(items: DataFrame) -> DataFrame:
    """The raw item table of ``(item_key, v)``."""
    v = F.col("v")
    ident = lambda *names: _first(v, "identity", *names)
    spec = lambda *names: _first(v, "specifications", *names)
    top = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)

    def filled(x: Column) -> Column:
        """A code list that says something; an empty list or text gives way to the next."""
        return F.when(F.coalesce(F.size(F.try_variant_get(x, "$", "array<variant>")), F.lit(0)) > 0, x).when(~_is(x, "ARRAY") & (_text(x) != ""), x)

    public = F.coalesce(filled(ident("public_model_codes")), filled(_get(v, "$.public_model_codes")))
    component = lambda x: F.when(_is(x, "OBJECT"), F.coalesce(*(_get(x, f"$.{k}") for k in ("code_compact", "code_raw", "code")))).otherwise(x)
    texts = lambda arr, get=lambda x: x: F.transform(arr, lambda x: _text(get(x)))
    bright = [_text(_scalar(x)) for x in (spec("brightness_equivalent", "brightness_class"), spec("lamp_configuration"), spec("brightness"))]
    out: dict[str, Column] = {
        "source_file": top("source_file", "string"),
        "page": top("page", "bigint"),
        "item_no": top("item_no", "bigint"),
        "drawing_label": top("drawing_label", "string"),
        "manufacturer": _text(ident("manufacturer")),
        "category": _text(_scalar(ident("category"))),
        "style": _text(_scalar(ident("style"))),
        "hinban": _text(ident("hinban", "model_base")),
        "kidou": _text(ident("kidou", "suffix")),
        "product_code": _text(ident("product_code_compact", "product_code_raw", "product_number", "model_number")),
        "visual_code": _text(ident("visual_context_code_raw")),
        "key_hint": _text(ident("key_hint")),
        "brightness": F.concat_ws(" ", *(F.nullif(b, F.lit("")) for b in bright)),
        **{k: _text(spec(k)) for k in ("y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou")},
        "public_codes": texts(_list(public)),
        "component_codes": texts(_list(ident("component_codes")), component),
        "mounting": texts(_list(spec("mounting_method")), _scalar),
        "uncertain_fields": F.try_variant_get(v, "$.uncertain_fields", "array<string>"),
    }
    numbers = {
        "luminous_flux_lm": spec("luminous_flux_lm", "luminous_flux_min_lm"),
        "color_temperature_k": spec("color_temperature_k"),
        "power_consumption_w": spec("power_consumption_w", "rated_power_consumption_w"),
        "cri_ra": spec("cri_ra", "color_rendering_index"),
    }
    for name in NUMBERS:
        out[f"{name}_num"], out[f"{name}_text"] = _number(numbers[name])
    volts = spec("voltage")
    bound = {k: _number(_get(volts, f"$.{k}"))[0] for k in ("min_v", "max_v", "value_v")}
    out["voltage_min_num"] = F.when(_is(volts, "OBJECT"), F.coalesce(bound["min_v"], bound["max_v"], bound["value_v"]))
    out["voltage_max_num"] = F.when(_is(volts, "OBJECT"), F.coalesce(bound["max_v"], bound["min_v"], bound["value_v"]))
    out["voltage_text"] = F.when(_is(volts, "OBJECT"), _text(_get(volts, "$.raw"))).otherwise(_text(volts))
    for name in SIZES:
        x = spec(name)
        typed, part = _is(x, "OBJECT"), lambda k, x=x: _get(x, f"$.{k}")
        round_ = F.try_variant_get(x, "$.shape", "string").isin("round", "circle")
        out[f"{name}_diameter"] = F.when(typed, _text(F.coalesce(part("diameter_mm"), F.when(round_, part("value")))))
        for k in ("width", "height", "length"):
            out[f"{name}_{k}"] = F.when(typed, _text(part(f"{k}_mm")))
        out[f"{name}_text"] = F.when(typed, _text(F.coalesce(part("raw"), part("value")))).otherwise(_text(x))
    flags = {"waterproof": (spec("waterproof", "water_resistance", "ip_rating"), "防雨型"), "dimming": (spec("dimming"), None)}
    for name in FLAGS:
        out[f"{name}_flag"], out[f"{name}_text"] = _flag(*flags[name])
    return items.select("item_key", *(e.alias(k) for k, e in out.items()))
