"""Numbers in text: plain values, dimensions, and figures with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, or_null, search_text

# The patterns of figures with their units, here and in the functions below.
NUMBER = r"\d+(?:\.\d+)?"
GROUPED = r"\d+(?:,\d{3})*(?:\.\d+)?"


def as_double(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return or_null(F.regexp_extract(text, pattern, group))


def first_number(clean: Column) -> Column:
    return as_double(found(clean, f"-?{GROUPED}", 0))


def number_text(text: Column) -> Column:
    """A number as text: whole numbers without a point, others with up to six significant digits."""
    d = as_double(text)
    six = F.format_string("%.6g", d)
    six = F.regexp_replace(F.regexp_replace(six, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    return F.when(d.isNull(), text).when(d == F.floor(d), d.try_cast("decimal(38,0)").cast("string")).otherwise(six)


def dimension(clean: Column) -> Column:
    """A comparison key: ``φD``, ``□A``, ``WxHxL`` or the lower-case search text."""
    t = F.translate(F.lower(clean), "ø⌀×*", "φφxx")
    t = F.regexp_replace(t, r"(?iU)\b(mm|ミリ)\b", "")
    t = F.regexp_replace(t, f"(?U){WHITE}+", "")
    each = F.transform(F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1)), number_text)
    joined = F.array_join(each, "x")
    square = F.concat(F.lit("□"), F.when(F.size(each) > 0, joined).otherwise(F.substring(t, 2, 1_000_000)))
    diameter = found(t, f"φ({NUMBER})")
    return (
        F.when(t.startswith("□"), square)
        .when(diameter.isNotNull(), F.concat(F.lit("φ"), number_text(diameter)))
        .when((F.size(each) >= 2) & t.contains("x"), joined)
        .otherwise(F.lower(search_text(t)))
    )


def dimension_of_parts(diameter: Column, width: Column, height: Column, length: Column, clean: Column) -> Column:
    """The key of a typed dimension: its diameter, two sides or more, its text, or its only side. Parts are texts."""
    sides = F.array_compact(F.array(number_text(width), number_text(height), number_text(length)))
    return (
        F.when(diameter.isNotNull(), F.concat(F.lit("φ"), number_text(diameter)))
        .when(F.size(sides) >= 2, F.array_join(sides, "x"))
        .when(clean.isNotNull(), dimension(clean))
        .otherwise(F.coalesce(F.get(sides, F.lit(0)), F.lit("")))
    )


def luminous_flux(clean: Column) -> Column:
    return as_double(found(clean, rf"({GROUPED})\s*(?:lm|LM)"))


def colour_temperature(clean: Column) -> Column:
    t = F.upper(clean)
    full = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![A-Z0-9])(\d{4,5})\s*K(?![A-Z0-9])"), F.lit(1)), as_double)
    full = F.get(F.filter(full, lambda k: k.between(1800, 20000)), F.lit(0))
    short = as_double(found(t, r"(?<![A-Z0-9])(27|30|35|40|50|57|65)\s*K(?![A-Z0-9])"))
    return F.coalesce(full, short * 100)


def power(clean: Column) -> Column:
    t = F.upper(clean)
    named = found(t, rf"(?:消費電力|定格消費電力)\s*[:：]?\s*({NUMBER})\s*W(?![A-Z])")
    return as_double(F.coalesce(named, found(t, rf"(?<![A-Z0-9])({NUMBER})\s*W(?![A-Z])")))


def voltage(clean: Column) -> tuple[Column, Column]:
    """The least and greatest voltage of a text."""
    t = F.upper(clean)
    ranged = rf"(?:AC|DC)?\s*({NUMBER})\s*[～~\-]\s*({NUMBER})\s*V"
    single = found(t, rf"(?:AC|DC)\s*({NUMBER})\s*V")
    return tuple(as_double(F.coalesce(found(t, ranged, k), single)) for k in (1, 2))


def rendering_index(clean: Column) -> Column:
    return as_double(found(F.upper(clean), rf"RA\s*[:：]?\s*({NUMBER})"))


def price(text: Column) -> Column:
    """A price of digits; grouped or worded prices are null. Infinity and not-a-number count as none."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
