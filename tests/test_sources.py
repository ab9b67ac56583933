"""Files cut anywhere: records with quoted line breaks."""

import csv
import io
import json
import random

import pytest
from data import ROWS, write_csv
from pyspark.sql import functions as F

from matchloom.operators.catalogue import SOURCE_COLUMNS
from matchloom.sources import csv_records, json_elements
from matchloom.sources.catalogue_csv import read_catalogue_csv


@pytest.fixture
def small_splits(spark):
    """Sets the bytes of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    keep = {n: spark.conf.get(n) for n in names}

    def cut(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield cut
    for n, v in keep.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize(
    "line, out, inside",
    [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a",b', False, False), ('a,"b""', True, False), ('""', False, True), ('"', True, False), ('x"y,"z', True, True), ('"a"b,c', False, False), ("", False, True), ('b","c', True, True), ('b"",c', False, True)],
)
def test_open_quotes(line, out, inside):
    assert csv_records.within(line, False) == out
    assert csv_records.within(line, True) == inside


def random_csv(rng, rows):
    """A text and the records that Python's reader finds in it."""
    field = lambda: rng.choice(["", "a", "läng", "1,2", 'say "x"', "two\nlines", "\n", '"', '"",\n"', "x\r\ny", " lead", "\n\n\n", 'in"side', "日本"])
    out = io.StringIO()
    made = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    for _ in range(rows):
        made.writerow([field() or "x", field(), field()])
        if rng.random() < 0.1:
            out.write("\n")  # a blank line
        if rng.random() < 0.1:
            out.write(f'st"ray,x"",{rng.randint(0, 9)}\n')  # quotes in plain fields
    return out.getvalue()


@pytest.mark.parametrize("size", [1, 7, 64, 300, 10**6])
def test_records_of_splits(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    texts = [random_csv(rng, n) for n in (0, 1, 12 if size == 1 else 120, 3)] + ["h,i,j", 'h,i,j\nlast,"open\nto the', "\n\n"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(t.encode())
    small_splits(size)
    got = {}
    for r in csv_records.read_records(spark, str(tmp_path)).collect():
        got.setdefault(int(r["file"].rsplit("/", 1)[1][0]), {})[r["record"]] = (r["text"], r["file_begun"])
    begun = 0
    for k, t in enumerate(texts):
        want = [x for x in csv.reader(io.StringIO(t, newline="")) if x]
        records = got.get(k, {})
        assert sorted(records) == list(range(len(want)))
        assert [next(csv.reader(io.StringIO(records[n][0], newline=""))) for n in sorted(records)] == want
        assert {b for _, b in records.values()} <= {begun}
        begun += max(0, len(want) - 1)


def test_catalogue_cut_at_every_place(spark, tmp_path, small_splits):
    """The rows and numbers of a catalogue are those of one task, however its files are cut."""
    rng = random.Random(2)
    texts = ["", "plain", "two\nlines", 'a "quoted" word', "x\r\ny", "ends with\n", ",", "日本\n語"]
    for name, n in (("a.csv", 9), ("b.csv", 30), ("c.csv", 0)):
        write_csv(tmp_path / name, [{"id": f"{name}{k}", "bumon": str(k)} | {c: rng.choice(texts) for c in ("hinban", "key", "y_kinou", "zaiku")} for k in range(n)])
    whole = sorted(map(repr, read_catalogue_csv(spark, str(tmp_path)).collect()))
    assert len(whole) == 39
    small_splits(200)
    rows = read_catalogue_csv(spark, str(tmp_path))
    assert csv_records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted(map(repr, rows.collect())) == whole
    assert [r["source_row"] for r in rows.orderBy("source_row").collect()] == list(range(2, 41))
    assert rows.where("id = 'b.csv0'").first()["source_row"] == 11
    plain = [r for name in ("a.csv", "b.csv", "c.csv") for r in csv.DictReader(io.StringIO((tmp_path / name).read_bytes().decode("utf-8-sig"), newline=""))]
    assert [r.asDict() for r in rows.orderBy("source_row").select(*SOURCE_COLUMNS).collect()] == plain


def test_bad_records_raise(spark, tmp_path):
    good = write_csv(tmp_path / "a.csv", ROWS)
    with open(good, "a", encoding="utf-8") as f:
        f.write("too,few\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_catalogue_csv(spark, good).collect()
    (tmp_path / "two").mkdir()
    write_csv(tmp_path / "two/a.csv", ROWS)
    write_csv(tmp_path / "two/b.csv", ROWS, list(reversed(SOURCE_COLUMNS)))
    with pytest.raises(Exception, match="header"):
        read_catalogue_csv(spark, str(tmp_path / "two")).collect()
    assert read_catalogue_csv(spark, write_csv(tmp_path / "none.csv", [])).agg(F.count("*")).first()[0] == 0


def random_value(rng, depth=0):
    texts = ["", "a", 'say "x"', "{", "}", "[]}", "\\", '\\"}', "}{", '"items": [', "日本", "\n"]
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(texts)
    if kind < 4:
        return rng.choice([1, -2.5, True, None])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice([*texts, "items", "k"]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [40, 500, 10**6])
def test_items_of_splits(spark, tmp_path, small_splits, size):
    """The items that Python's reader finds, however the files are cut."""
    rng = random.Random(size)
    items = lambda n: [{"k": random_value(rng), rng.choice(["items", "x", "}"]): random_value(rng)} for _ in range(n)]
    n = 5 if size == 40 else 25
    around = {"meta": [{"a": [{}]}, {}], "no": {"items": [{"x": 1}]}, 'odd "items": [': "}"}
    values = [items(n), [], {"items": items(n)}, around | {"items": items(n), "after": [{"b": 1}, {}], "more": {"items": [{}]}}, {"items": []}, {"items": 3, "z": items(2)}, {}, {"k": random_value(rng)}, around, [{}]]
    for k, v in enumerate(values):
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{k}.json").write_text(rng.choice(["", "﻿", "\n "]) + text + rng.choice(["", "\n"]), encoding="utf-8")
    small_splits(size)
    got = {}
    for r in json_elements.read_elements(spark, str(tmp_path)).collect():
        got.setdefault(int(r["file"].rsplit("/", 1)[1].split(".")[0]), []).append((r["pos"], json.loads(r["text"])))
    for k, v in enumerate(values):
        want = v if isinstance(v, list) else v["items"] if isinstance(v.get("items"), list) else [v]
        assert sorted(got.get(k, []), key=lambda x: x[0]) == list(enumerate(want))


@pytest.mark.parametrize("text", ["[1]", '["a"]', "[[]]", '[{"a": 1}, 2]', '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[{"a": 1}', '[{"a": "}', '{"items": [{}, null]}', '{"items": [{}', "3", '"{}"', '{"a": 1', "[,{}]"])
@pytest.mark.parametrize("size", [3, 10**6])
def test_broken_items(spark, tmp_path, small_splits, text, size):
    (tmp_path / "a.json").write_text(text)
    small_splits(size)
    with pytest.raises(Exception, match="JSON"):
        json_elements.read_elements(spark, str(tmp_path)).collect()
