"""Column expressions on single values."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import features, numbers, text


def one(spark, expression, value):
    df = text.cleaned(spark.createDataFrame([(value,)], "x string"), ["x"])
    return df.select(expression(F.col("_x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "expression, value, expected",
    [
        (text.identifier, "ｑｌａ１２０７　Ｄ２", "QLA1207D2"),
        (text.identifier, None, ""),
        (lambda c: text.relaxed(text.identifier(c)), "qla.12 07/d2", "QLA1207D2"),
        (text.search_text, "電球色・2700K; ra90：x", "電球色2700KRA90X"),
        (text.category, "ユニバーサルダウンライト LED", "ダウンライト"),
        (text.category, "Other", "Other"),
        (text.category, "ﾍﾞｰｽﾗｲﾄ", "ベースライト"),
        (text.availability, "受注品", "made_to_order"),
        (text.availability, "x", "other"),
        (text.availability, "", "unknown"),
        (numbers.dimension, "W60×H7.50×L210", "60x7.5x210"),
        (numbers.dimension, "Φ88.0 mm", "φ88"),
        (numbers.dimension, "□ 90", "□90"),
        (numbers.dimension, "1,250x300", "1x250x300"),
        (numbers.dimension, "125.0", "125.0"),
        (numbers.dimension, "125mm", "125mm"),
        (numbers.dimension, "125 mm", "125"),
        (numbers.luminous_flux, "12,345.5 lm", 12345.5),
        (numbers.luminous_flux, "820Lm", None),
        (numbers.colour_temperature, "白色(4000K)", 4000.0),
        (numbers.colour_temperature, "クラス250 50K", 5000.0),
        (numbers.colour_temperature, "99999K 35K", 3500.0),
        (numbers.power, "定格消費電力：7.5 W", 7.5),
        (numbers.power, "FL40.5W", 5.0),
        (numbers.power, "FL40W", None),
        (lambda c: F.array(*numbers.voltage(c)), "AC 90～264 V", [90.0, 264.0]),
        (lambda c: F.array(*numbers.voltage(c)), "AC100V", [100.0, 100.0]),
        (lambda c: F.array(*numbers.voltage(c)), "100V", [None, None]),
        (numbers.rendering_index, "ra ： 92.5", 92.5),
        (numbers.first_number, "LED-40", -40.0),
        (numbers.price, " 18400 ", 18400.0),
        (numbers.price, "18,400", None),
        (features.mounting, "床埋込/吊下", ["ceiling_suspended", "floor_recessed"]),
        (features.water, "防湿 防雨", "damp_and_waterproof"),
        (features.water, "形式IP65", "unknown"),
        (features.water, "IP65", "waterproof"),
        (features.water, "対応なし", "none"),
        (features.dimming, "非調光", "false"),
        (features.dimming, "調光", "true"),
        (features.dimming, "", "unknown"),
    ],
)
def test_expression(spark, expression, value, expected):
    assert one(spark, expression, value) == expected


@pytest.mark.parametrize("a, b, expected", [("unknown", "unknown", "unknown"), ("none", "unknown", "none"), ("damp", "damp_and_waterproof", "damp_and_waterproof"), ("damp", "waterproof", "conflict"), ("none", "waterproof", "conflict"), ("damp", "damp", "damp")])
def test_water_combined(spark, a, b, expected):
    for x, y in ((a, b), (b, a)):
        assert spark.range(1).select(features.water_combined(F.lit(x), F.lit(y)).alias("y")).first()["y"] == expected


@pytest.mark.parametrize("asked, has, expected", [("damp", "damp_and_waterproof", True), ("damp_and_waterproof", "damp", False), ("none", "conflict", None), ("unknown", "none", None), ("none", "none", True)])
def test_water_compatible(spark, asked, has, expected):
    assert spark.range(1).select(features.water_compatible(F.lit(asked), F.lit(has)).alias("y")).first()["y"] is expected


@pytest.mark.parametrize("value, expected", [("12.50", "12.5"), ("100", "100"), ("0.1234567", "0.123457"), ("1234567.5", "1.23457e+06"), ("x", "x")])
def test_number_text(spark, value, expected):
    assert spark.range(1).select(numbers.number_text(F.lit(value)).alias("y")).first()["y"] == expected


def test_texts_that_python_sees(spark):
    """Only texts that compatibility form may change go to Python; the others are as it leaves them."""
    import random
    import unicodedata

    chars = [chr(c) for r in text.STABLE for c in range(ord(r.split("-")[0]), ord(r.split("-")[-1]) + 1)]
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in chars)
    rng = random.Random(6)
    stable = ["".join(rng.choices(chars, k=20)) for _ in range(200)] + ["", "plain\n", "ベースライト φ125 W150×L300", "−5 一般"]
    assert all(unicodedata.is_normalized("NFKC", s) for s in stable)
    other = ["ＮＮＦ４", "ｶﾞ", "が", "é", "①", "x\n²", "㎜", "　", "가", "가"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*stable, *other, None])], "k int, s string")
    got = rows.select("k", "s", text.may_change(F.col("s")).alias("sent"), F.coalesce(text.nfkc(text.may_change(F.col("s"))), "s").alias("form")).orderBy("k").collect()
    assert [r["sent"] for r in got] == [None] * len(stable) + other + [None]
    assert [r["form"] for r in got] == [s and unicodedata.normalize("NFKC", s) for s in [*stable, *other, None]]
