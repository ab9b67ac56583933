"""Identifiers and specifications that many items and rows share, and result documents read in parts."""

import pytest
from test_candidates import plain_best, rows_of

from matchloom.operators import candidates, catalogue, decide, evidence
from matchloom.plans import fixtures, jobs, queries
from matchloom.stage import staged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts whose base numbers, cut to five digits, stand in many rows, as they do in large tables; and parts that are alike but for their number."""
    path = str(tmp_path_factory.mktemp("shared-keys"))
    heads = [10000, *range(100000, 100006), *range(1000000, 1000020)]
    keys = [3 * v + k for v in heads for k in range(3)] + [4 + 49140 * k for k in range(6)]
    rows = [(k, f"Brand#{k % 4}", ("ECONOMY", "SMALL", "PROMO", "MEDIUM")[k % 4], 7 if k % 49140 == 4 else 1 + k * 7 % 5, 900.0) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def got(spark, folder):
    made = staged(catalogue.normalize_catalogue(fixtures.detailed_source(spark, folder)), "catalogue")
    return jobs.answer(fixtures.echoed_items(spark, folder), made)


@pytest.fixture
def seen(monkeypatch):
    """What the operators write, by name."""
    written = {}
    for module in (candidates, evidence, jobs, queries):
        monkeypatch.setattr(module, "staged", lambda df, name: written.setdefault(name, staged(df, name)))
    return written


@pytest.mark.parametrize("keep, list_rows", [(10, 16), (200, 512)])
def test_rules_are_worked_out_once_a_value(got, monkeypatch, seen, keep, list_rows):
    """Lists of rows meet lists of items: far fewer cells than rules times pairs, and the same rows, scores and flags as by scoring every pair."""
    monkeypatch.setattr(evidence, "LIST_ROWS", list_rows)
    lists = []
    met = evidence._lists_met
    monkeypatch.setattr(evidence, "_lists_met", lambda *given: lists.append(staged(met(*given), "lists")) or lists[-1])
    assert rows_of(got.best(keep)) == plain_best(got)(keep)
    blocks = lists[0].collect()
    rules = sum(c.startswith("cells_") for c in lists[0].columns)
    pairs = sum(len(b["asks"]) * len(b["rows"]) for b in blocks)
    cells = sum(len(b[f"cells_{n}"]) for b in blocks for n in range(rules))
    assert rules > 10 and pairs > 2000 and cells < rules * pairs / (3 if list_rows == 16 else 5)
    assert len(blocks) > 1 if list_rows == 16 else len(blocks) == 1


def test_items_that_ask_alike_are_scored_once(got, seen):
    """Items that differ in their number alone, which no rule reads, meet the rows of their specification as one."""
    assert rows_of(got.best(5)) == plain_best(got)(5)
    asked, kinds = seen["spec-questions"].count(), seen["spec-kinds"].count()
    assert 0 < kinds <= asked - 5


def test_parts_of_documents(got):
    """What the queries read of the documents is what the documents hold."""
    made = jobs.Matched(got, 10)
    whole = {r["item_key"]: r for r in made.documents.collect()}
    assert {len(r["candidates"]) for r in whole.values()} >= {0, 10}
    searches = {r["item_key"]: r for r in made.searches.collect()}
    assert all((searches[k]["search"], searches[k]["warnings"]) == (r["search"], r["warnings"]) and r["search"]["returned_count"] == len(r["candidates"]) for k, r in whole.items())
    items = {r["item_key"]: (r["source"], r["normalized_input"]) for r in decide.shown_items(got.items).collect()}
    assert items == {k: (r["source"], r["normalized_input"]) for k, r in whole.items()}
    of = lambda name, entries: [(name, e["field"], e["weight"]) for e in entries]
    want = sorted((k, c["rank"], c["record"]["id"], of("+", c["matched_fields"]) + of("-", c["conflicts"])) for k, r in whole.items() for c in r["candidates"])
    shown = made.shown(("field", "weight")).select("item_key", "rank", "id", "matched_fields", "conflicts").collect()
    assert sorted((r["item_key"], r["rank"], r["id"], of("+", r["matched_fields"]) + of("-", r["conflicts"])) for r in shown) == want


@pytest.mark.parametrize("name, no", [("result_search", {"strict-scores", "spec-scores", "ranked", "results"}), ("result_items", {"catalogue", "spec-keys", "ranked", "results"})])
def test_only_what_is_shown_is_made(spark, folder, seen, name, no):
    """A query writes no documents, and scores no candidates where it shows none."""
    queries.QUERIES[name](spark, folder)
    assert seen and not no & set(seen)
