"""Multi-criteria ranking: long criteria tables, normalizers, combiners, filters, statistics and Pareto rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import clamp
from evidex.operators.blocks import block_join, quantiles
from evidex.operators.graph import cut

#: Order of toxicity levels and of confidence levels.
TOXICITY_ORDER = ("low", "moderate", "high", "severe", "unknown")
CONFIDENCE_ORDER = ("low", "medium", "high", "very_high")


def ordinal(c: Column, order) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(order):
        out = F.when(c == name, k).otherwise(out)
    return out


def criteria_long(wide: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """(key, criterion, value): a row for each criterion that a candidate has."""
    return wide.unpivot([key], criteria, "criterion", "value").filter("value is not null")


#: The six criteria, and the column of its evidence that each one takes.
EVIDENCE = (
    ("structural_similarity", "similarity", "similarity"), ("target_confidence", "targets", "confidence"), ("toxicity_risk", "toxicity", "toxicity_score"),
    ("drug_likeness", "properties", "qed"), ("lipinski_violations", "properties", "violations"), ("repurposing_evidence", "repurposing", "score"),
)


def criteria_from_evidence(key: str, evidence: dict[str, DataFrame], custom: DataFrame | None = None) -> DataFrame:
    """(key, criterion, value) of the six criteria from evidence tables, and of ``custom`` ones (key, criterion, value).

    ``evidence`` has any of similarity, targets, toxicity, properties and repurposing; what a table lacks
    makes no row. Of several rows of a candidate the highest value counts, so of targets the strongest.
    A custom value outside 0 to 1 is an error.
    """
    parts = [evidence[table].groupBy(key).agg(F.max(F.col(column).cast("double")).alias("value")).select(key, F.lit(name).alias("criterion"), "value") for name, table, column in EVIDENCE if table in evidence]
    if custom is not None:
        inside = F.col("value").between(0, 1)
        checked = F.when(inside | F.col("value").isNull(), F.col("value").cast("double")).otherwise(F.raise_error(F.lit("a custom value lies between 0 and 1")).cast("double"))
        parts.append(custom.select(key, "criterion", checked.alias("value")))
    return reduce(DataFrame.union, parts).filter("value is not null")


def _ends(long: DataFrame, *aggs) -> DataFrame:
    """``long`` beside its criteria's aggregates, a row for each criterion (few, so sent to all tasks)."""
    return long.join(F.broadcast(long.groupBy("criterion").agg(*aggs)), "criterion")


def _flip(value: Column) -> Column:
    return F.when(F.col("higher_is_better"), value).otherwise(1 - value)


def normalize_min_max(long: DataFrame) -> DataFrame:
    """Adds normalized: place between the lowest and highest value; 1 where all are equal; then flipped
    where lower is better. ``long`` has key, criterion, value, higher_is_better."""
    span = F.col("hi") - F.col("lo")
    placed = F.when(span == 0, 1.0).otherwise((F.col("value") - F.col("lo")) / span)
    return _ends(long, F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("normalized", _flip(placed)).drop("lo", "hi")


def normalize_clamp(long: DataFrame) -> DataFrame:
    return long.withColumn("normalized", _flip(clamp(F.col("value"))))


def normalize_z_score(long: DataFrame) -> DataFrame:
    """Population z through the logistic function; 1 where all are equal."""
    z = (F.col("value") - F.col("m")) / F.col("sd")
    placed = F.when(F.col("sd") == 0, 1.0).otherwise(1 / (1 + F.exp(-z)))
    return _ends(long, F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).withColumn("normalized", _flip(placed)).drop("m", "sd")


def weighted_sum(value: Column, weight: Column) -> Column:
    """An aggregate: mean by weight over the criteria that are there; 0 without weight."""
    return clamp(F.coalesce(F.try_divide(F.sum(weight * value), F.sum(weight)), F.lit(0.0)))


def weighted_geometric_mean(value: Column, weight: Column) -> Column:
    logs = F.sum(weight * F.log(F.greatest(value, F.lit(1e-6))))
    return clamp(F.coalesce(F.exp(F.try_divide(logs, F.sum(weight))), F.lit(0.0)))


def combine(normalized: DataFrame, key: str, strategy: Callable[[Column, Column], Column] = weighted_sum) -> DataFrame:
    """(key, composite): a strategy is any function of value and weight columns that gives an aggregate."""
    return normalized.groupBy(key).agg(strategy(F.col("normalized"), F.col("weight")).alias("composite"))


def candidate_confidence(covered: Column, total: int, mean_level: Column) -> Column:
    """Half the share of criteria covered, half the mean evidence level of 3 (a third where there is none)."""
    return 0.5 * covered / total + 0.5 * F.coalesce(mean_level / 3, F.lit(1 / 3))


def ranking_filter(scored: DataFrame, least_score: float | None = None, worst_toxicity: str | None = None, lipinski: bool = False, least_confidence: str | None = None, predicates: list[Column] = ()) -> DataFrame:
    """Optional predicates; a candidate with no toxicity level passes that one."""
    tests = list(predicates)
    if least_score is not None:
        tests.append(F.col("composite") >= least_score)
    if worst_toxicity is not None:
        tests.append(F.coalesce(ordinal(F.col("toxicity_level"), TOXICITY_ORDER) <= TOXICITY_ORDER.index(worst_toxicity), F.lit(True)))
    if lipinski:
        tests.append(F.col("violations") == 0)
    if least_confidence is not None:
        tests.append(ordinal(F.col("confidence_level"), CONFIDENCE_ORDER) >= CONFIDENCE_ORDER.index(least_confidence))
    return scored.filter(reduce(lambda a, b: a & b, tests)) if tests else scored


def rank_top_k(scored: DataFrame, key: str, k: int, score: str = "composite") -> DataFrame:
    """The k best with rank from 1; a top-k, then numbers over k rows."""
    order = [F.desc(score), F.asc(key)]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def filtered_out(scored: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """One row: how many candidates there are, how many pass the filters, and how many don't."""
    both = scored.select(key).distinct().join(kept.select(key).distinct().withColumn("_kept", F.lit(True)), key, "left")
    return both.agg(F.count("*").alias("total"), F.count("_kept").alias("kept"), (F.count("*") - F.count("_kept")).alias("filtered_out"))


def fixed(c: Column, places: int) -> Column:
    """A double with so many places, rounded from its exact value as C and Python do; Java rounds its shortest decimal form."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{places}f}")

    return F.coalesce(F.when(c.isNotNull(), text(c.cast("double"))), F.lit("null"))


def explanations(normalized: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """(key, lines): the overall line, then criteria by weight with their share of it."""
    total = F.sum("weight").over(Window.partitionBy(key))
    normalized = normalized.withColumns({"_share": fixed(100 * F.col("weight") / total, 1), "_value": fixed(F.col("normalized"), 3)})
    line = F.format_string("%s: %s (weight %s%%)", "criterion", "_value", "_share")
    lines = normalized.withColumn("line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "criterion", "line"))).alias("ls"))
    head = F.array(F.concat(F.lit("Overall score "), fixed(F.col("composite"), 3)))
    return scored.join(lines, key).select(key, F.concat(head, F.transform("ls", lambda x: x["line"])).alias("lines"))


def ranking_statistics(scored: DataFrame, score: str = "composite", level: str | None = None, normalized: DataFrame | None = None) -> DataFrame:
    """One row about the scores; with ``level`` (a column) also confidence_distribution, how many have each level
    (null: unknown), and with ``normalized`` (criterion, normalized) the mean of each criterion. Empty: zeros."""
    rows = _score_statistics(scored, score)
    if level:
        counts = scored.groupBy(F.coalesce(F.col(level), F.lit("unknown")).alias("k")).agg(F.count("*").alias("v"))
        rows = rows.crossJoin(counts.agg(_as_map().alias("confidence_distribution")))  # tables of one row
    if normalized is not None:
        means = normalized.groupBy(F.col("criterion").alias("k")).agg(F.avg("normalized").alias("v"))
        rows = rows.crossJoin(means.agg(_as_map().alias("criterion_averages")))
    return rows


def _as_map() -> Column:
    """Rows (k, v) as one map, in order of k."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))


def _score_statistics(scored: DataFrame, score: str) -> DataFrame:
    one = scored.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("std"), F.min(score).alias("lowest"), F.max(score).alias("highest"))
    middle = quantiles(scored.withColumn("_all", F.lit(0)), "_all", score, {"median": lambda n: (n - 1) / 2}).agg(F.max("median").alias("median"))
    return one.crossJoin(middle).select("n", "mean", "median", "std", "lowest", "highest")  # two tables of one row


#: Cells that the criteria are divided into at most, and rows of a piece whose own front is taken.
CELLS, PIECE = 65_536, 4096


def _front(rows: np.ndarray) -> np.ndarray:
    """The distinct rows that no other dominates: by falling sums, as what dominates a row has a higher one."""
    rows = np.unique(rows, axis=0)
    rows = rows[np.lexsort((*-rows.T[::-1], -rows.sum(axis=1)))]
    best = rows[:0]
    for k in range(0, len(rows), 256):
        own = rows[k : k + 256]
        own = own[~_beaten(own, best)]
        best = np.vstack([best, own[~_beaten(own, own)]])
    return best


def _beaten(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows any of ``others`` dominates on the criteria that both have."""
    lost = np.zeros(len(own), bool)
    for k in range(0, len(others), 1024):
        left = np.flatnonzero(~lost)
        as_good, better = np.ones((len(left), len(others[k : k + 1024])), bool), np.zeros((len(left), len(others[k : k + 1024])), bool)
        for x, y in zip(own[left].T, others[k : k + 1024].T):
            gap = np.isnan(x)[:, None] | np.isnan(y)[None]
            as_good &= (y[None] >= x[:, None]) | gap
            better |= (y[None] > x[:, None]) & ~gap
        lost[left] = (as_good & better).any(axis=1)
    return lost


def _grid(rows: DataFrame, criteria: list[str]) -> list[np.ndarray]:
    """Boundaries of each criterion that deal its values evenly, as many as make ``CELLS`` cells at most."""
    n, d = rows.count(), len(criteria)
    steps = max(1, min(int(CELLS ** (1 / d) + 1e-9), math.ceil((n / 256) ** (1 / max(1, d - 1)))))
    cuts = rows.approxQuantile(criteria, [k / steps for k in range(1, steps)], 0.25 / steps) if steps > 1 and n else [[]] * d
    return [np.unique(c) for c in cuts]


def _complete_front(rows: DataFrame, criteria: list[str], table, values) -> DataFrame:
    """The front of distinct rows with every criterion, cell by cell.

    A cell is dropped unseen if another lies above it on every criterion. Rows of what is left can only be
    dominated by rows of cells that are as high everywhere, and those are few, as the front is thin: each
    cell's front goes to the cells below it that are left, and is compared there. Cells are counted on
    the driver, in a grid of ``CELLS`` at most.
    """
    spark, schema = rows.sparkSession, rows.schema
    cuts = _grid(rows, criteria)
    shape = tuple(len(c) + 1 for c in cuts)
    cell_of = lambda v: np.ravel_multi_index([np.searchsorted(c, x, side="right") for c, x in zip(cuts, v.T)], shape)

    def thin(batches):
        for batch in batches:
            v = values(batch)
            for k in range(0, len(v), PIECE):
                own = _front(v[k : k + PIECE])
                t = table(own)
                yield from t.append_column("cell", pa.array(cell_of(own))).to_batches()

    celled = cut(rows.mapInArrow(thin, f"{_ddl(criteria)}, cell long"))
    full = np.zeros(shape, bool)
    full.ravel()[[r.cell for r in celled.select("cell").distinct().collect()]] = True  # CELLS rows at most
    above = full.copy()
    for axis in range(len(shape)):  # whether any cell as high everywhere has rows
        above = np.flip(np.logical_or.accumulate(np.flip(above, axis), axis=axis), axis)
    higher = np.zeros(shape, bool)
    higher[tuple(slice(0, -1) for _ in shape)] = above[tuple(slice(1, None) for _ in shape)]
    left = np.flatnonzero((full & ~higher).ravel())
    places = np.array(np.unravel_index(left, shape)).T
    sent = spark.sparkContext.broadcast((left, places))

    def fan(batches):
        """Rows of the cells that are left, for their own cell and for each lower one."""
        cells, at = sent.value
        for batch in batches:
            own = np.flatnonzero(np.isin(batch.column("cell").to_numpy(), cells))
            v, c = values(batch.take(pa.array(own))), batch.column("cell").to_numpy()[own]
            for x in np.unique(c).tolist():
                to = cells[(at <= at[np.searchsorted(cells, x)]).all(axis=1)]
                mine = v[c == x]
                for k in range(0, len(to), max(1, PIECE * 16 // len(mine))):
                    some = to[k : k + max(1, PIECE * 16 // len(mine))]
                    yield from table(np.tile(mine, (len(some), 1))).append_column("cell", pa.array(np.repeat(some, len(mine)))).append_column("own", pa.array(np.repeat(some == x, len(mine)))).to_batches()

    sums = [F.col(c) for c in criteria]
    first = celled.mapInArrow(fan, f"{_ddl(criteria)}, cell long, own boolean")
    dealt = first.repartition("cell").sortWithinPartitions("cell", -reduce(lambda a, b: a + b, sums), *[-c for c in sums])

    def settle(batches):
        """Rows of a cell by falling sums, with those that may dominate them before them."""
        cell, best = None, None
        for batch in batches:
            cells, own, v = batch.column("cell").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), values(batch)
            ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells)) if len(cells) else []
            a = 0
            for b in map(int, ends):
                if cells[a] != cell:
                    cell, best = cells[a], v[:0]
                for k in range(a, b, 256):
                    rows_, mine = v[k : min(b, k + 256)], own[k : min(b, k + 256)]
                    stays = ~_beaten(rows_, best)
                    rows_, mine = rows_[stays], mine[stays]
                    stays = ~_beaten(rows_, rows_)
                    rows_, mine = rows_[stays], mine[stays]
                    best = np.vstack([best, rows_])
                    yield from table(rows_[mine]).to_batches()
                a = b

    return dealt.mapInArrow(settle, schema)


def _ddl(criteria: list[str]) -> str:
    return ", ".join(f"`{c}` double" for c in criteria)


def pareto_frontier(wide: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """Keys of rows that no other row dominates: as good on every criterion that both have, better on one.

    Higher is better; NaN is a gap, as null is. Equal rows are compared once. Rows with every criterion are reduced to their front
    by a grid of cells. Dominance is not transitive between rows with different gaps, but it is among rows
    with the same ones, and what dominates a row dominates all that it does; so rows with gaps are
    reduced to the front of their own pattern first, and the fronts of different patterns are then
    compared block with block.
    """
    number = lambda x: F.when(~F.isnan(x.cast("double")), x.cast("double"))
    distinct = wide.select(*[number(F.col(c)).alias(c) for c in criteria]).distinct()
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in criteria])
    schema = _ddl(criteria)
    table = lambda rows: pa.table([pa.array(rows[:, i], pa.float64(), from_pandas=True) for i in range(len(criteria))], criteria)
    values = lambda t: np.column_stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in criteria])
    pattern = lambda v: (np.isnan(v) * (1 << np.arange(v.shape[1]))).sum(axis=1)

    def meet(same_pattern: bool):
        def lost(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not len(asked) or not len(held):
                return table(np.zeros((0, len(criteria))))
            mine, theirs = values(asked.select(criteria)), values(held.select(["o_" + c for c in criteria]).rename_columns(criteria))
            out, kinds, others = np.zeros(len(mine), bool), pattern(mine), pattern(theirs)
            for x in np.unique(kinds).tolist():
                own = np.flatnonzero(kinds == x)
                out[own] = _beaten(mine[own], theirs[(others == x) == same_pattern])
            return table(mine[out])

        return lost

    def against(rows: DataFrame, others: DataFrame, same_pattern: bool) -> DataFrame:
        return block_join(rows, others.toDF(*["o_" + c for c in criteria]), meet(same_pattern), schema, PIECE, PIECE).distinct()

    same = lambda x, y: reduce(lambda a, b: a & b, [number(x[c]).eqNullSafe(y[c]) for c in criteria])
    minus = lambda rows, lost: rows.join(lost, same(rows, lost), "left_anti")
    distinct = cut(distinct)
    whole = cut(_complete_front(distinct.filter(complete), criteria, table, values))
    gaps = distinct.filter(~complete)
    if not gaps.isEmpty():
        gaps = cut(minus(gaps, against(gaps, gaps, True)))
        every = whole.union(gaps)
        lost = against(whole, gaps, False).union(against(gaps, every, False)).distinct()
        whole = minus(every, lost)
    return wide.join(whole, same(wide, whole), "left_semi").select(key)


def ranked_candidates(candidates: DataFrame, rankings: DataFrame, key: str, order: str) -> DataFrame:
    """All candidates: ranked ones first, by rank, then the others in input order."""
    return candidates.join(rankings.select(key, "rank"), key, "left").orderBy(F.col("rank").asc_nulls_last(), order)


def percentiles(rows: DataFrame, group: str, value: str, asked: dict[str, float]) -> DataFrame:
    """(group, names of ``asked``): linear interpolation at p / 100 of each group's sorted values; 0 where there is none."""
    at = lambda p: lambda n: (n - 1) * (p / 100)
    found = quantiles(rows, group, value, {n: at(p) for n, p in asked.items()})
    every = rows.select(group).distinct().join(found, group, "left")
    return every.select(group, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in asked])
