"""Repurposing evidence: target overlap, graph, embedding and structural scores, combined and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import clamp, score_to_confidence
from evidex.operators.blocks import numbered
from evidex.operators.compounds import digits, similar_compounds

#: Weights of the four kinds of evidence.
WEIGHTS = (("structural", 0.25), ("overlap", 0.30), ("embedding", 0.20), ("graph", 0.25))


def target_overlap(predictions: DataFrame, query_targets: DataFrame) -> DataFrame:
    """(compound_id, overlap): confidence shared with the query's targets over their number, at most 1.

    ``predictions`` has compound_id, target_id, confidence; ``query_targets`` target_id, confidence.
    """
    query = query_targets.groupBy("target_id").agg(F.max("confidence").alias("q"))
    n = F.broadcast(query.agg(F.count("*").alias("n")))
    best = predictions.groupBy("compound_id", "target_id").agg(F.max("confidence").alias("c"))
    shared = best.join(query, "target_id").groupBy("compound_id").agg(F.sum(F.least("c", "q")).alias("s"))
    return shared.crossJoin(n).select("compound_id", F.least(F.lit(1.0), F.round(F.col("s") / F.col("n"), 6)).alias("overlap"))


def target_score(predictions: DataFrame, target_id: str) -> DataFrame:
    """(compound_id, overlap): the best confidence for one target."""
    return predictions.filter(F.col("target_id") == target_id).groupBy("compound_id").agg(F.max("confidence").alias("overlap"))


def graph_score(edges: DataFrame, disease: str) -> DataFrame:
    """(candidate, graph, paths): the strongest relation to the disease, and what the relations say."""
    path = F.concat_ws(" ", "src", "relation", "dst")
    return edges.filter(F.col("dst") == disease).groupBy(F.col("src").alias("candidate")).agg(F.least(F.lit(1.0), F.max("confidence")).alias("graph"), F.array_sort(F.collect_set(path)).alias("paths"))


def embedding_evidence(candidates: DataFrame, similarities: DataFrame) -> DataFrame:
    """(compound_id, embedding): the given similarity in [0, 1]; 0 where there is none."""
    best = similarities.groupBy("compound_id").agg(F.max("similarity").alias("s"))
    return candidates.join(best, "compound_id", "left").select("compound_id", clamp(F.coalesce("s", F.lit(0.0))).alias("embedding"))


def structural_evidence(candidates: DataFrame, bits: DataFrame, query: DataFrame) -> DataFrame:
    """(compound_id, structural): similarity with the query compound; 0 without one."""
    found = similar_compounds(query, bits).groupBy("compound_id").agg(F.max("similarity").alias("s"))
    return candidates.join(found, "compound_id", "left").select("compound_id", F.coalesce("s", F.lit(0.0)).alias("structural"))


def repurposing_candidates(candidates: DataFrame, evidence: dict[str, DataFrame], least: float = 0.0, top: int | None = None) -> DataFrame:
    """Ranked candidates: weighted evidence, where what is missing counts as 0.

    criteria is what each kind gives, notes say what there is and what it says: the paths of graph
    evidence, where its table has them, and the kinds without evidence.
    """
    joined = candidates.select("compound_id")
    for kind, _ in WEIGHTS:
        more = ["paths"] if kind == "graph" and "paths" in evidence.get("graph", candidates).columns else []
        joined = joined.join(evidence[kind].select("compound_id", kind, *more), "compound_id", "left") if kind in evidence else joined.withColumn(kind, F.lit(None).cast("double"))
    parts = {k: F.coalesce(k, F.lit(0.0)) for k, _ in WEIGHTS}
    score = F.least(F.lit(1.0), F.round(sum((w * parts[k] for k, w in WEIGHTS), F.lit(0.0)), 6))
    criteria = F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), c)])
    said = [F.when(F.col(k) > 0, F.format_string(k + " evidence %s (weight %s)", digits(F.col(k), 2), F.lit(str(w)))).otherwise(f"no {k} evidence") for k, w in WEIGHTS]
    paths = [F.when(F.size("paths") > 0, F.concat(F.lit("relations: "), F.array_join("paths", "; ")))] if "paths" in joined.columns else []
    notes = F.array_compact(F.array(*said, *paths))
    scored = joined.select("compound_id", score.alias("score"), criteria.alias("criteria"), notes.alias("notes")).filter(F.col("score") >= least)
    order = [F.desc("score"), F.asc("compound_id")]
    scored = scored.withColumn("level", score_to_confidence(F.col("score")))
    if top:
        return scored.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered(scored, "rank", *order).withColumn("rank", F.col("rank") + 1)
