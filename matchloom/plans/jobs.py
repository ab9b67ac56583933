"""The three jobs: build a catalogue, match items against it, inspect it."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, catalogue, decide, evidence, items
from ..sources.catalogue_csv import fingerprint, read_catalogue_csv
from ..sources.items_json import raw_of_variants, read_items_json
from ..stage import large, replace, restore, staged, stages

def build(spark: SparkSession, csv: str, target: str, report: str | None = None) -> DataFrame:
    """Normalize the CSV into ``target/products``, its metadata within; return the one-row report.

    The catalogue is written beside its place and moved there once it is valid, so a build that
    fails, also while it writes, leaves an earlier catalogue as it was. Rows and metadata are one folder, so they
    change together. A driver that dies between the two renames of the change leaves the earlier catalogue
    aside; the next build, match or inspection puts it back.
    """
    if csv.rstrip("/") == target.rstrip("/"):
        raise ValueError("the catalogue can't replace its source")
    seen = Observation("source")
    source = read_catalogue_csv(spark, csv).observe(seen, F.count(F.lit(1)).alias("rows"))  # counted while it is written
    source = source.repartition(spark.sparkContext.defaultParallelism)  # a file of quoted lines is read by one task
    made = f"{target.rstrip('/')}/_new_products"
    restore(spark, products_of(target))
    catalogue.normalize_catalogue(source).write.mode("overwrite").parquet(made)
    products = spark.read.parquet(made)
    rows = products.count()
    catalogue.check_valid(products, seen.get["rows"])
    sha = fingerprint(spark, csv).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]))).first()[0]  # one row a file
    now = datetime.datetime.now(datetime.UTC).isoformat()
    facts = {"schema_version": catalogue.SCHEMA_VERSION, "source_path": csv, "source_sha256": sha, "source_rows": str(rows), "built_at_utc": now}
    spark.createDataFrame(list(facts.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{made}/{FACTS}")
    replace(spark, products_of(target), made)
    built = catalogue.build_report(open_catalogue(spark, target))
    built = built.withColumns({"source_csv": F.lit(csv), "normalized_db": F.lit(target), "source_sha256": F.lit(sha)})
    if report:
        built.coalesce(1).write.mode("overwrite").json(report)
    return built


#: The metadata's folder in that of the rows; readers of the rows pass over names that begin like this.
FACTS = "_facts"


def products_of(target: str) -> str:
    return f"{target.rstrip('/')}/products"


def open_catalogue(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a built catalogue; an earlier one that a failed replacement left aside is put back first."""
    restore(spark, products_of(target))
    return spark.read.parquet(products_of(target))


def metadata(spark: SparkSession, target: str) -> DataFrame:
    """The build's metadata as one row with a map."""
    rows = spark.read.parquet(f"{products_of(target)}/{FACTS}")
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def inspect(spark: SparkSession, target: str) -> DataFrame:
    """One row: the number of rows, from the file footers, and the metadata."""
    return open_catalogue(spark, target).agg(F.count("*").alias("rows")).join(F.broadcast(metadata(spark, target)))


@dataclass
class Answers:
    """Items with their ``question``, and for each distinct question its route and its candidates."""

    items: DataFrame
    questions: DataFrame
    products: DataFrame
    found: candidates.Found

    @property
    def routes(self) -> DataFrame:
        return self.found.routes

    @property
    def scored(self) -> DataFrame:
        """All candidates with their scores."""
        return evidence.scored(self.found.identified, self.questions, self.products, self.found.whole)

    @property
    def similar(self) -> DataFrame:
        """The candidates found by a part of an identifier, with the similarity of their codes."""
        return evidence.similar(self.found.identified, self.questions, self.products).select("item_key", "id", "similarity")

    def best(self, keep: int) -> DataFrame:
        """The first ``keep`` candidates of each question, by rank."""
        return evidence.best(self.found, self.questions, self.products, keep)


def answer(raw: DataFrame, products: DataFrame, **caps: int) -> Answers:
    """Search every distinct question once, however many items ask it."""
    asked = staged(items.with_question(items.normalize_items(raw)), "items")
    questions = staged(items.questions(asked), "questions")
    return Answers(asked, questions, products, candidates.find_candidates(questions, products, **caps))


@dataclass
class Matched:
    """What result documents are made of. Candidates are scored and ranked where a part is read that shows them or decides by them."""

    got: Answers
    top_k: int

    @cached_property
    def first(self) -> DataFrame:
        """The first candidates of each question, by rank."""
        return staged(self.got.best(max(self.top_k, 2)), "ranked")

    @property
    def searches(self) -> DataFrame:
        """The documents without decision and candidates."""
        return decide.result_searches(self.got.items, self.got.routes, self.top_k)

    @property
    def heads(self) -> DataFrame:
        """The documents without candidates."""
        decisions = decide.decide(self.got.questions, self.got.routes, decide.top_of_each(self.first))
        return decide.result_heads(self.searches, decisions)

    def shown(self, slots: tuple[str, ...] | None = None) -> DataFrame:
        """The candidates of the documents, a row each; ``slots``: what alone is wanted of their evidence."""
        return decide.shown_candidates(self.first.where(F.col("rank") <= self.top_k), self.got.items, self.got.products, slots)

    @property
    def documents(self) -> DataFrame:
        return decide.result_documents(self.heads, decide.candidate_lists(self.shown()))


def matched(raw: DataFrame, products: DataFrame, *, top_k: int = 10) -> Matched:
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    return Matched(answer(raw, products), top_k)


def match(spark: SparkSession, raw: DataFrame, products: DataFrame, *, top_k: int = 10) -> DataFrame:
    """One result document per raw item. It reads tables staged in the session or in the running ``stages`` block."""
    return matched(raw, products, top_k=top_k).documents


def match_file(spark: SparkSession, json: str, target: str, output: str, *, top_k: int = 10) -> DataFrame:
    """Match an item file; write ``output/results`` and ``output/run``; return the summary by status."""
    with stages(spark):
        raw = raw_of_variants(read_items_json(spark, json))
        match(spark, raw, open_catalogue(spark, target), top_k=top_k).write.mode("overwrite").json(f"{output}/results")
    results = spark.read.json(f"{output}/results")
    run = results.agg(F.count("*").alias("result_count")).select(F.lit(decide.VERSION).alias("matcher_version"), F.lit(json).alias("input_file"), F.lit(target).alias("db_file"), "result_count")
    run.join(F.broadcast(metadata(spark, target).withColumnRenamed("metadata", "db_metadata"))).coalesce(1).write.mode("overwrite").json(f"{output}/run")
    return summary(results.select("decision.status"))


def summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count("*").alias("item_count"))
