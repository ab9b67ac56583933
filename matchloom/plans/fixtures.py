"""Catalogue and items derived from the part table, for queries over given tables.

The text is plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import SOURCE_COLUMNS

CATALOGUE_SQL = """
select 'S' || lpad(cast(p_partkey as string),7,'0') as id,
 'NNF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0') as hinban,
 case when p_partkey%6=2 then '' when p_partkey%6=5 then 'LE1' else 'LE9' end as kidou,
 cast(p_size*100 as string) || 'タイプ' as key,
 'ベースライト ' || cast(p_size*100 as string) || 'lm' as view_key,
 '' as bumon,
 case p_type when 'ECONOMY' then 'ダウンライト' when 'STANDARD' then 'ベースライト' when 'MEDIUM' then 'ユニバーサルダウンライト' when 'SMALL' then 'スポットライト' when 'LARGE' then '高天井用照明' else '' end as kigugroup,
 p_brand as kigustyle, '' as t_kigubunrui,
 case p_type when 'PROMO' then 'ブラケット' when 'SMALL' then 'ダウンライト' else '' end as t_kigugroup,
 cast(cast(floor(p_retailprice) as bigint) as string) as price_zeinuki, '' as hatsubai_date, '' as seisan_end_date,
 case p_partkey%6 when 0 then '常備在庫品' when 1 then '受注品' when 2 then '生産終了品' when 3 then '生産終了予定品' when 4 then '工場在庫品' else '' end as zaiku,
 case when p_partkey%10=0 then 'LRS1-' || lpad(cast(p_partkey as string),6,'0') || 'LM' else '' end as koukyou_kataban1,
 '' as koukyou_kataban2, cast(p_size*100 as string) || 'lm' as t_akarusa,
 'W150×L' || cast(p_size*25 as string) as kigusize,
 case when p_type in ('ECONOMY','MEDIUM') then 'φ' || cast(75+25*(p_size%5) as string) else '' end as umekomi_ana,
 case p_partkey%4 when 0 then '天井埋込' when 1 then '天井直付・壁直付' when 2 then '配線ダクト' else '' end as t_toritsuke,
 case p_partkey%3 when 0 then '対応なし' when 1 then '防湿' else '' end as boushitsu_bouu,
 case when p_partkey%7=0 then '防雨型 ' else '' end || case when p_partkey%2=0 then '非調光' else '調光' end as t_kinou,
 '' as dannetsusekou, '' as y_toukyu, '' as y_toritsuke, '' as y_hyoujimen,
 'Ra' || cast(80+p_size%15 as string) || ' AC100-242V 消費電力:' || cast(p_size as string) || '.5W ' || case when p_size%2=0 then '5000K' else '35K' end as y_kinou
from part
"""

ITEMS_SQL = """
select cast(p_partkey as string) as item_key,
 case when p_partkey%8 in (0,1,2) then 'NNF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0') else '' end as hinban,
 case when p_partkey%8 in (0,1) then case when p_partkey%6=2 then '' when p_partkey%6=5 then 'LE1' else 'LE9' end else '' end as kidou,
 case when p_partkey%40=20 then '' when p_partkey%16=3 then 'NNF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0') || ' ' || case when p_partkey%6=2 then '' when p_partkey%6=5 then 'LE1' else 'LE9' end when p_partkey%16=11 then 'NNF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0')
   when p_partkey%8=4 then 'NNF-' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0') || '/' || case when p_partkey%6=2 then '' when p_partkey%6=5 then 'LE1' else 'LE9' end
   when p_partkey%8=5 then 'NF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0')
   when p_partkey%16=7 then 'OTHER-MAKER-' || cast(p_partkey as string) else '' end as product_code_raw,
 case when p_partkey%40 in (0,20) then 'LRS1-' || lpad(cast(p_partkey as string),6,'0') || 'LM' else '' end as public_model_code,
 case when p_partkey%8=0 then cast(p_size*100 as string) || 'タイプ' else '' end as key_hint,
 case when p_partkey%8=6 then 'ダウンライト' else '' end as category,
 case when p_partkey%16=14 then 999 when p_partkey%8=6 then 75+25*(p_size%5) end as cutout_diameter_mm,
 case when p_partkey%2=0 then cast(p_size*100 as double) end as luminous_flux_lm
from part
"""

_KEY = "cast(substring(id, 2) as bigint)"
_DETAILS = {
    "y_toukyu": f"case {_KEY}%3 when 0 then 'A級' when 1 then 'B級' else '' end",
    "y_toritsuke": f"case {_KEY}%5 when 0 then '直付' when 1 then '埋込' else '' end",
    "y_hyoujimen": f"case {_KEY}%4 when 0 then '片面' when 1 then '両面' else '' end",
    "dannetsusekou": f"case {_KEY}%7 when 0 then 'SB・SGI 形' else '' end",
    "koukyou_kataban2": f"case when {_KEY}%20=10 then 'LBF-' || substring(id, 2) else '' end",
    "boushitsu_bouu": f"case {_KEY}%6 when 0 then '対応なし' when 1 then '防湿' when 2 then '防雨形 IP23' when 3 then '防湿・防雨' else '' end",
}
#: The catalogue with the columns filled that the plain one leaves empty.
DETAILED_CATALOGUE_SQL = f"select {', '.join(f'{_DETAILS[c]} as {c}' if c in _DETAILS else c for c in SOURCE_COLUMNS)} from ({CATALOGUE_SQL}) plain"

#: Items that give every field that a rule reads: fitting, contradicting, in between or not at all, by remainders of the key.
DETAILED_ITEMS_SQL = """
select cast(p_partkey as string) as item_key,
 case when p_partkey%9=4 then '' else 'NNF' || lpad(cast(cast(floor(p_partkey/3) as bigint) as string),5,'0') end as hinban,
 case when p_partkey%10=0 then 'LRS1-' || lpad(cast(p_partkey as string),6,'0') || 'LM' else '' end as public_one,
 case when p_partkey%20=10 then 'LBF-' || lpad(cast(p_partkey as string),7,'0') else '' end as public_two,
 case when p_partkey%9=4 and p_partkey%2=0 then 'ダウンライト' else '' end as category,
 case when p_partkey%27=4 then 'φ' || cast(75+25*(p_size%5) as string) else '' end as cutout_text,
 case p_partkey%3 when 0 then p_brand when 1 then 'その他' else '' end as style,
 case p_partkey%4 when 0 then cast(p_size*100 as string) || 'lm' when 1 then '99999lm' else '' end as brightness,
 case p_partkey%5 when 0 then 'W150×L' || cast(p_size*25 as string) when 1 then 'W1×L2' when 4 then 'W150×L' || cast(p_size*25 as string) else '' end as fixture_text,
 case p_partkey%7 when 0 then 'A級' when 1 then 'B級' else '' end as y_toukyu,
 case p_partkey%7 when 2 then '埋込' when 3 then '直付' else '' end as y_toritsuke,
 case p_partkey%7 when 4 then '片面' when 5 then '両面' else '' end as y_hyoujimen,
 case p_partkey%7 when 6 then 'ac100-242v' when 5 then '非常灯' else '' end as y_kinou,
 case p_partkey%5 when 0 then '天井埋込' when 1 then '壁直付' when 2 then '床埋込' else '' end as mounting,
 case p_partkey%6 when 0 then '防湿' when 1 then '防雨型' when 2 then '対応なし' when 3 then '防湿 防雨' else '' end as waterproof_text,
 case p_partkey%4 when 0 then '調光' when 1 then '非調光' else '' end as dimming_text,
 case p_partkey%5 when 0 then 5000.0 when 1 then 3600.0 when 2 then 4000.0 when 3 then 9000.0 end as color_temperature_k,
 case p_partkey%4 when 0 then p_size+0.5 when 1 then 1.2*(p_size+0.5) when 2 then 2.0*(p_size+0.5) end as power_consumption_w,
 case p_partkey%5 when 0 then 'AC100～200V' when 1 then 'AC100-300V' when 2 then '400~500V' when 3 then 'AC242V' else '' end as voltage_text,
 case p_partkey%4 when 1 then 80.0+p_size%15 when 2 then 84.0+p_size%15 when 3 then 90.0+p_size%15 end as cri_ra,
 case when p_partkey%13=0 then 'identity.hinban' when p_partkey%13=1 then 'specifications.dimming' else '' end as uncertain
from part
"""

#: What a detailed item says about where it was read, and its maker; in SQL over ``k``, the number in its key.
ECHOED = {
    "source_file": "case when k%7=0 then null else 'drawing-' || cast(k%7 as string) || '.pdf' end",
    "page": "case when k%5<>0 then k%13 end",
    "item_no": "case when k%3<>0 then k%29+1 end",
    "drawing_label": "case when k%4=0 then 'L' || cast(k%50 as string) end",
    "manufacturer": "case when k%11=0 then 'nord licht' || cast(k%2 as string) else '' end",
}


def _part(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # The table is a single small file, which Spark reads as one partition; the texts are worked on in as many as there are cores.
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(sql.replace("from part", "from {part}"), part=part)


def catalogue_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source catalogue of one row per part, numbered by the part."""
    return _part(spark, sf_dir, CATALOGUE_SQL).withColumn("source_row", F.expr(f"{_KEY} + 1"))


def detailed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, DETAILED_CATALOGUE_SQL).withColumn("source_row", F.expr(f"{_KEY} + 1"))


def detailed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw item per part with all fields; codes of components as well."""
    rows, some = _part(spark, sf_dir, DETAILED_ITEMS_SQL), lambda *names: F.filter(F.array(*names), lambda x: x != "")
    return rows.select(
        *("item_key", "hinban", "category", "style", "brightness", "y_toukyu", "y_toritsuke", "y_hyoujimen", "y_kinou"),
        *(F.nullif(c, F.lit("")).alias(c) for c in ("waterproof_text", "dimming_text", "voltage_text")),
        F.nullif("fixture_text", F.lit("")).alias("fixture_size_text"),
        F.nullif("cutout_text", F.lit("")).alias("cutout_size_text"),
        some("public_one", "public_two").alias("public_codes"),
        F.array(F.concat(F.lit("部品 "), "item_key"), F.lit("")).alias("component_codes"),
        some("mounting").alias("mounting"),
        *(F.col(c).cast("double").alias(f"{c}_num") for c in ("color_temperature_k", "power_consumption_w", "cri_ra")),
        some("uncertain").alias("uncertain_fields"),
    )


def echoed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detailed items with their maker and the places where they were read."""
    items = detailed_items(spark, sf_dir).withColumn("k", F.col("item_key").cast("long"))
    return items.withColumns({c: F.expr(v) for c, v in ECHOED.items()}).drop("k")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw item per part."""
    return _part(spark, sf_dir, ITEMS_SQL).select(
        "item_key",
        "hinban",
        "kidou",
        F.col("product_code_raw").alias("product_code"),
        F.when(F.col("public_model_code") != "", F.array("public_model_code")).alias("public_codes"),
        "key_hint",
        "category",
        F.col("cutout_diameter_mm").cast("string").alias("cutout_size_diameter"),
        F.col("luminous_flux_lm").alias("luminous_flux_lm_num"),
    )
