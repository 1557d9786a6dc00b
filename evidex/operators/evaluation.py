"""Retrieval metrics over runs and relevance tables (or judged runs), and statistics of recorded runs."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import strings
from evidex.operators.blocks import quantiles


class Judged(NamedTuple):
    """A run with its judgements: (query, item, rank, hit) of each retrieved item, (query, n_rel) of each query."""

    hits: DataFrame
    queries: DataFrame


def judge(runs: DataFrame, qrels: DataFrame) -> Judged:
    """``runs`` (query, item, rank) by relevance rows (query, item)."""
    known = qrels.select("query", "item").distinct()
    hits = runs.join(known.withColumn("rel", F.lit(True)), ["query", "item"], "left").select("query", "item", "rank", F.coalesce("rel", F.lit(False)).alias("hit"))
    n = known.groupBy("query").agg(F.count("*").alias("n_rel"))
    every = runs.select("query").union(qrels.select("query")).distinct().join(n, "query", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    return Judged(hits, every)


def judge_by_label(runs: DataFrame, labels: DataFrame, queries: DataFrame) -> Judged:
    """``runs`` where all other rows of ``labels`` (id, label) with a query's label are relevant to it.

    Relevant rows are counted by label, and only retrieved items are looked up: no row is made for a query and
    each relevant item. ``queries`` (query) are ids of ``labels``; a null label has none beside it.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    asked = queries.select("query").distinct().join(labels.select(F.col("id").alias("query"), F.col("label").alias("own")), "query", "left")
    every = asked.join(sizes.withColumnRenamed("label", "own"), "own", "left").select("query", "own", (F.coalesce("size", F.lit(1)) - 1).alias("n_rel"))
    hits = runs.join(asked, "query", "left").join(labels.select(F.col("id").alias("item"), "label"), "item", "left")
    hits = hits.select("query", "item", "rank", F.coalesce((F.col("own") == F.col("label")) & (F.col("query") != F.col("item")), F.lit(False)).alias("hit"))
    return Judged(hits, every.drop("own"))


def _judged(runs: DataFrame | Judged, qrels: DataFrame | None) -> Judged:
    return runs if isinstance(runs, Judged) else judge(runs, qrels)


def precision_recall_f1(runs: DataFrame | Judged, qrels: DataFrame | None = None) -> DataFrame:
    """Each query's precision, recall and F1; 0 where nothing is retrieved or relevant."""
    got = _judged(runs, qrels).hits.groupBy("query").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"), F.count_distinct(F.when(F.col("hit"), F.col("item"))).alias("d"))
    j = _judged(runs, qrels).queries.join(got, "query", "left")
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("h", "n"), zero), F.coalesce(F.try_divide("d", "n_rel"), zero)
    return j.select("query", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"))


def average_precision(runs: DataFrame | Judged, qrels: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gained = _judged(runs, qrels).hits.withColumn("seen", F.sum(F.col("hit").cast("int")).over(w)).filter("hit")
    summed = gained.groupBy("query").agg(F.sum(F.col("seen") / F.col("rank")).alias("s"))
    return _judged(runs, qrels).queries.join(summed, "query", "left").select("query", F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), "n_rel"), F.lit(0.0)).alias("ap"))


def mean_average_precision(runs: DataFrame | Judged, qrels: DataFrame | None = None) -> DataFrame:
    """One row; queries without a relevant item count with 0."""
    return average_precision(runs, qrels).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def ndcg(runs: DataFrame | Judged, qrels: DataFrame | None = None, k: int = 10, discount: str = "log2") -> DataFrame:
    """Each query's NDCG at k with discount log2(rank + 1) or rank + 1."""
    weight = lambda i: math.log2(i + 1) if discount == "log2" else i + 1.0
    ideal = [0.0]
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + 1 / weight(i))
    d = F.log2(F.col("rank") + 1) if discount == "log2" else F.col("rank") + 1.0
    gained = _judged(runs, qrels).hits.filter(F.col("hit") & (F.col("rank") <= k)).groupBy("query").agg(F.sum(1 / d).alias("dcg"))
    table = F.array(*[F.lit(x) for x in ideal])
    best = F.element_at(table, (F.least("n_rel", F.lit(k)) + 1).cast("int"))
    return _judged(runs, qrels).queries.join(gained, "query", "left").select("query", F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), best), F.lit(0.0)).alias("ndcg"))


def mean_reciprocal_rank(runs: DataFrame | Judged, qrels: DataFrame | None = None) -> DataFrame:
    first = _judged(runs, qrels).hits.groupBy("query").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("r"))
    return _judged(runs, qrels).queries.join(first, "query", "left").agg(F.coalesce(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def accuracy(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.col(predicted).eqNullSafe(F.col(truth)).cast("int")), F.lit(0.0)).alias("accuracy"))


def latency_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, minimum, maximum, and p95 and p99 as the value at place int(n q) of the sorted ones.

    The places come from value counts in order over all tasks, so a group may have any number of rows.
    """
    at = lambda q: lambda n: F.floor(n * q).cast("double")
    places = quantiles(rows, group, value, {"median": lambda n: (n - 1) / 2, "p95": at(0.95), "p99": at(0.99)})
    base = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return base.join(places, group, "left")


def error_analysis(rows: DataFrame, success: str, kind: str) -> DataFrame:
    """One row: shares of success and failure, and failures by type."""
    failed = ~F.coalesce(F.col(success), F.lit(False))
    kinds = rows.filter(failed).groupBy(F.coalesce(kind, F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    types = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("failure_types"))
    rates = rows.agg(F.avg((~failed).cast("int")).alias("success_rate"), F.avg(failed.cast("int")).alias("failure_rate"))
    return rates.crossJoin(types)  # two tables of one row


def component_summary(rows: DataFrame, component: str, success: str, results: str, latency: str) -> DataFrame:
    n = F.when(F.col(success), F.coalesce(results, F.lit(0))).otherwise(0)
    return rows.groupBy(component).agg(
        F.count("*").alias("total"), F.count_if(success).alias("successes"), F.avg(F.col(success).cast("int")).alias("success_rate"), F.avg(n).alias("mean_results"), F.min(n).alias("min_results"),
        F.max(n).alias("max_results"), F.avg(latency).alias("mean_latency"),
    )


def overall_summary(components: DataFrame) -> DataFrame:
    """One row: all successes over all items, and the unweighted mean of the components' means."""
    return components.agg(F.sum("total").alias("total"), F.sum("successes").alias("successes"), (F.sum("successes") / F.sum("total")).alias("success_rate"), F.avg("mean_latency").alias("mean_of_means"))


def rollup_summary(rows: DataFrame, component: str, success: str) -> DataFrame:
    return rows.rollup(component).agg(F.count("*").alias("total"), F.count_if(success).alias("successes"))


def gold_title_match(papers: DataFrame, phrases: list[str], top: int = 20) -> DataFrame:
    """One row: of the first titles by ord, those that hold any gold phrase."""
    first = papers.orderBy("ord").limit(top)
    gold = strings([p.lower() for p in phrases])
    return first.agg(F.count_if(F.exists(gold, lambda g: F.contains(F.lower("title"), g))).alias("found_relevant"))
