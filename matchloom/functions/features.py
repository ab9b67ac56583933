"""Signals in text: mounting, protection against water, dimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mounting codes and the texts that stand for them.
MOUNTINGS = {
    "ceiling_recessed": ("ceiling_recessed", "天井埋込", "埋込天井"),
    "ceiling_surface": ("ceiling_surface", "天井直付", "直付天井"),
    "wall_surface": ("wall_surface", "壁直付"),
    "ceiling_suspended": ("ceiling_suspended", "天井吊下", "吊下"),
    "track": ("track", "配線ダクト", "ダクト取付"),
    "pole": ("pole", "ポール取付"),
    "ground_recessed": ("ground_recessed", "地中埋込"),
    "wall_recessed": ("wall_recessed", "壁埋込"),
    "floor_recessed": ("floor_recessed", "床埋込"),
    "stand": ("stand", "据置"),
}


def mounting(clean: Column) -> Column:
    """The sorted codes that the text names; join several texts with a control sign first."""

    def named(aliases: tuple[str, ...]) -> Column:
        out = clean.contains(aliases[0])
        for a in aliases[1:]:
            out = out | clean.contains(a)
        return out

    return F.array_compact(F.array(*(F.when(named(MOUNTINGS[code]), code) for code in sorted(MOUNTINGS))))


def water(clean: Column) -> Column:
    """none, damp, waterproof, damp_and_waterproof or unknown."""
    no = clean.contains("対応なし") | clean.contains("非対応") | F.lower(clean).isin("none", "false", "no")
    damp = clean.contains("防湿")
    wet = clean.contains("防雨") | clean.contains("防浸") | clean.rlike(r"(?iU)\bIP\d+")
    return (
        F.when(no, "none")
        .when(damp & wet, "damp_and_waterproof")
        .when(wet, "waterproof")
        .when(damp, "damp")
        .otherwise("unknown")
    )


def water_of(flag: Column, clean: Column) -> Column:
    return F.when(flag, "waterproof").when(~flag, "none").otherwise(water(clean))


def water_combined(a: Column, b: Column) -> Column:
    """Two signals as one; unknown gives way, a part gives way to the whole, other pairs conflict."""
    whole, part = "damp_and_waterproof", ("waterproof", "damp")
    return (
        F.when(a == "unknown", b)
        .when((b == "unknown") | (a == b), a)
        .when(((a == whole) & b.isin(*part)) | ((b == whole) & a.isin(*part)), whole)
        .otherwise("conflict")
    )


def water_compatible(asked: Column, has: Column) -> Column:
    """True, false, or null where one side says nothing sure."""
    return F.when((asked != "unknown") & ~has.isin("unknown", "conflict"), (asked == has) | (asked.isin("waterproof", "damp") & (has == "damp_and_waterproof")))


def dimming(clean: Column) -> Column:
    """true, false or unknown, as text."""
    low = F.lower(clean)
    no = clean.contains("非調光") | clean.contains("固定出力") | low.isin("false", "no", "none")
    return F.when(no, "false").when(clean.contains("調光") | low.isin("true", "yes"), "true").otherwise("unknown")


def dimming_of(flag: Column, clean: Column) -> Column:
    return F.when(flag, "true").when(~flag, "false").otherwise(dimming(clean))
