"""Items as JSON lines, in batch and as a stream."""

import json

from data import ROWS, item
from pyspark.sql import functions as F

from matchloom import stage
from matchloom.operators.catalogue import SOURCE_COLUMNS, normalize_catalogue
from matchloom.sources.items_json import raw_of_variants, read_items_jsonl
from matchloom.streaming.match_stream import match_stream


def lines(path, items):
    path.write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in items), encoding="utf-8")


def test_json_lines(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [item({"hinban": "A"}), item({"category": "ダウンライト"})])
    rows = raw_of_variants(read_items_jsonl(spark, str(tmp_path / "a.jsonl"))).collect()
    assert sorted((r["hinban"] or "", r["category"] or "") for r in rows) == [("", "ダウンライト"), ("A", "")]
    assert len({r["item_key"] for r in rows}) == 2


def test_stream(spark, tmp_path):
    source = spark.createDataFrame([tuple(r.get(c, "") for c in SOURCE_COLUMNS) for r in ROWS], SOURCE_COLUMNS)
    products = normalize_catalogue(source.withColumn("source_row", F.lit(1)))
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in/1.jsonl", [item({"product_code_raw": "RVK880B D2"}), item()])
    files, folder = stage._path(spark, stage.session_dir(spark))
    staged = []
    for k in range(3):  # the second run finds nothing new
        if k == 2:
            lines(tmp_path / "in/2.jsonl", [item({"product_code_raw": "KOM7"})])
        match_stream(spark, str(tmp_path / "in"), products, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(300)
        staged.append((len(files.listStatus(folder)), spark.sparkContext._jsc.getPersistentRDDs().size()))
    assert len(set(staged)) == 1  # a batch leaves no table and nothing cached
    got = spark.read.json(str(tmp_path / "out")).select("decision.status").collect()
    assert sorted(r["status"] for r in got) == ["exact_unique", "exact_unique", "insufficient_input"]
