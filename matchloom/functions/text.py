"""Text forms: cleaned text, search text, identifiers, categories.

All builders but :func:`nfkc` are native expressions. They expect cleaned text (see
:func:`cleaned`), so the one Python step, Unicode compatibility form, runs once a column, and only for
texts that it may change: those of ASCII, kana, ideographs and a few signs never leave the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs that count as a hyphen.
HYPHENS = "‐‑‒–—―−ｰ"

# The first token that the text holds names the category.
CATEGORIES = [
    ("誘導灯", "誘導灯"),
    ("非常", "非常灯"),
    ("ユニバーサルダウンライト", "ダウンライト"),
    ("ダウンライト", "ダウンライト"),
    ("ベースライト", "ベースライト"),
    ("シーリング", "シーリングライト"),
    ("スポット", "スポットライト"),
    ("ブラケット", "ブラケット"),
    ("ウォール", "ブラケット"),
    ("ペンダント", "ペンダント"),
    ("シャンデリア", "シャンデリア"),
    ("高天井", "高天井用照明"),
    ("街路", "街路灯"),
    ("投光", "投光器"),
    ("テープライト", "その他照明"),
    ("ライン照明", "その他照明"),
]

# Availability by the stock text.
AVAILABILITY = {
    "生産終了品": "discontinued",
    "生産終了予定品": "planned_discontinued",
    "工場在庫品": "factory_stock",
    "受注品": "made_to_order",
    "常備在庫品": "stock",
    "": "unknown",
}

#: White space as Unicode and the information separators count it.
WHITE = r"[\s\x{1C}-\x{1F}]"


#: Characters, in ranges, that compatibility form leaves as they are, also side by side: none of them combines with the one before.
STABLE = ["\x00-\x7f", "×", "Α-Ω", "α-ω", "‐", "–", "—", "−", "□", "○", "、-〃", "ぁ-ゖ", "ァ-ー", "一-鿿"]


def may_change(text: Column) -> Column:
    """The text if compatibility form may change it, else null."""
    ranges = "".join("-".join(rf"\x{{{ord(c):X}}}" for c in r.split("-")) for r in STABLE)
    return F.when(~F.regexp_like(text, F.lit(rf"\A[{ranges}]*\z")), text)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return values.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x), na_action="ignore")


def tidy(text: Column) -> Column:
    """Hyphens unified, white space collapsed and trimmed; null becomes empty. Expects compatibility form."""
    one = F.translate(F.coalesce(text, F.lit("")), HYPHENS, "-" * len(HYPHENS))
    return F.trim(F.regexp_replace(one, f"(?U){WHITE}+", " "))


def cleaned(df: DataFrame, columns: list[str], prefix: str = "_") -> DataFrame:
    """Add the cleaned text of each column under ``prefix`` + its name, in one Arrow pass."""
    forms = df.withColumns({f"{prefix}{c}": F.coalesce(nfkc(may_change(F.col(c))), F.col(c)) for c in columns})
    return forms.withColumns({f"{prefix}{c}": tidy(F.col(f"{prefix}{c}")) for c in columns})


def search_text(clean: Column) -> Column:
    return F.regexp_replace(F.upper(clean), rf"(?U)[\s\x{{1C}}-\x{{1F}}・･,，:：;；]", "")


def identifier(clean: Column) -> Column:
    return F.regexp_replace(F.upper(clean), f"(?U){WHITE}+", "")


def relaxed(strict: Column) -> Column:
    return F.regexp_replace(strict, "[^A-Z0-9]", "")


def category(clean: Column) -> Column:
    out = None
    for token, name in CATEGORIES:
        out = (F if out is None else out).when(clean.contains(token), name)
    return out.otherwise(clean)


def availability(clean: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in AVAILABILITY.items() for x in kv))
    return F.coalesce(F.try_element_at(known, clean), F.lit("other"))


def contains_either(left: Column, right: Column) -> Column:
    """Whether one non-empty text holds the other."""
    return (left != "") & (right != "") & (left.contains(right) | right.contains(left))


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
