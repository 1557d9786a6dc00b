"""Compound discovery as one lazy plan: filter by rules, weigh repurposing evidence in, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import ranking as M
from evidex.operators import repurposing as R


def discovery(scored: DataFrame, structural: DataFrame, overlap: DataFrame, embedding: DataFrame, top: int = 25, weight: float = 0.3, compat: bool = False) -> DataFrame:
    """``scored`` (compound_id, composite, toxicity_level, violations, confidence_level), filtered and ranked.

    The repurposing score takes ``weight`` of the ranking; with ``compat`` it is left out.
    """
    parts = {"structural": structural, "overlap": overlap, "embedding": embedding}
    total = F.lit(0.0)
    joined = M.ranking_filter(scored, 0.3, "moderate", True, "medium")
    for kind, w in R.WEIGHTS:
        if kind in parts:
            joined = joined.join(parts[kind].select("compound_id", kind), "compound_id", "left")
            total = total + w * F.coalesce(kind, F.lit(0.0))
    score = F.least(F.lit(1.0), F.round(total, 6))
    final = F.col("composite") if compat else F.round((1 - weight) * F.col("composite") + weight * score, 6)
    return M.rank_top_k(joined.select("compound_id", final.alias("composite")), "compound_id", top)
