"""Centroid clustering in exact integers, with a search that looks at few centroids of each vector.

Each vector carries its centroid, the second nearest, and two bounds: its distance to the one is at most
the upper, to any other at least the lower. Where the bounds can't settle a round, the search starts from
the closer of the two and goes through that one's neighbours by distance; it ends where a neighbour lies
further off than the ball that the two best found so far leave, which shrinks as better ones are found.
Distances are compared as integers; floating numbers only tell what need not be looked at, with room for
rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import forget, shared_dir

#: Room for rounding in bounds.
EPS = 1e-9
#: Largest absolute component in units; a squared distance of 64 such components fits a long.
MOST = 1 << 27


class Search:
    """The nearest and the second nearest of some centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        d = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(float)) if k else np.zeros((0, 0))
        self.order = np.argsort(d, axis=1, kind="stable")
        self.gaps = np.take_along_axis(d, self.order, axis=1)
        self.half = self.gaps[:, 1] / 2 if k > 1 else np.full(k, np.inf)

    def distance(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        x = v - self.c[which]
        return np.einsum("ij,ij->i", x, x)

    def assign(self, v: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Puts the new values in place; gives the number of distances that were worked out."""
        far = np.maximum(lower, self.half[first]) * (1 - EPS)
        open_ = np.flatnonzero(upper * (1 + EPS) >= far)
        d_first = self.distance(v[open_], first[open_])
        upper[open_] = np.sqrt(d_first)
        still = upper[open_] * (1 + EPS) >= far[open_]
        worked = len(open_)
        rows, d1 = open_[still], d_first[still]
        x, a, b = v[rows], first[rows], second[rows]
        d2 = self.distance(x, b)
        worked += len(rows)
        swap = (d2 < d1) | ((d2 == d1) & (b < a))
        a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
        alone = a == b  # one centroid, or none known beside it
        d2[alone] = np.iinfo(np.int64).max
        pivot, other, reach = a.copy(), b.copy(), np.sqrt(d1)
        live = np.arange(len(rows))
        for t in range(len(self.c)):
            ball = (reach[live] + np.sqrt(d2[live])) * (1 + EPS)
            live = live[self.gaps[pivot[live], t] <= ball]
            if not len(live):
                break
            j = self.order[pivot[live], t]
            new = (j != pivot[live]) & (j != other[live])
            at, j = live[new], j[new]
            d = self.distance(x[at], j)
            worked += len(at)
            best = (d < d1[at]) | ((d == d1[at]) & (j < a[at]))
            after = ~best & ((d < d2[at]) | ((d == d2[at]) & (j < b[at])))
            up, mid = at[best], at[after]
            b[up], d2[up] = a[up], d1[up]
            a[up], d1[up] = j[best], d[best]
            b[mid], d2[mid] = j[after], d[after]
        first[rows], second[rows], upper[rows], lower[rows] = a, b, np.sqrt(d1), np.sqrt(d2)
        return worked


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


STATE = "vec_id long, v array<int>, first int, before int, second int, upper double, lower double, distance long"


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of ``dims`` finite components, each times ``scale`` and rounded down."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < MOST))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept of (vec_id, embedding).

    Vectors of another length, with a null or not finite component, or with one beyond 2^27 units (whose
    distances don't fit a long) are left out. The first centroids are the ``k`` vectors with smallest
    sha256 of ``seed`` and vec_id (equal ids: by components; null ids come last); with fewer vectors there
    are as many centroids. Each of ``rounds`` assigns all vectors and moves each centroid that has any to
    the floor of their mean. Repeated rows and ids each get a row; other columns aren't read; an empty
    table gives no rows. Vectors and bounds are a table in the shared folder, written anew in each
    round; the one before goes once the new one stands. The driver holds the centroids and their sums.
    """
    spark = vectors.sparkSession
    vectors = integer_vectors(vectors, dims, scale)
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    heads = vectors.select(F.coalesce(key, F.lit("~")).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    c = np.array([r.v for r in sorted(heads, key=lambda r: (r.h, r.v))], np.int64).reshape(-1, dims)
    none = F.lit(0).cast("int")
    second = F.lit(min(1, max(0, len(c) - 1))).cast("int")
    bounds = (none.alias("first"), F.lit(-1).cast("int").alias("before"), second.alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"))
    state, path = vectors.select("vec_id", "v", *bounds), None
    moved = np.zeros(len(c))
    sums, counts = np.zeros((len(c), dims), object), np.zeros(len(c), object)
    for r in range(rounds + 1):
        new = shared_dir(spark, "vectors")
        state.mapInArrow(_assigner(c, moved, r == 0, r == rounds, dims), STATE).write.parquet(new)
        if path:
            forget(spark, path)
        path, state = new, spark.read.schema(STATE).parquet(new)
        if r < rounds:
            for x in _changes(state, dims).collect():  # k times dims rows
                sums[x.cluster, x.pos] += int(x.total)
                counts[x.cluster] += int(x.n) if x.pos == 0 else 0
            old, c = c, np.array([[int(s) // int(n) for s in row] if n else list(was) for row, n, was in zip(sums, counts, c.tolist())], np.int64).reshape(-1, dims)
            moved = np.sqrt(((c - old) ** 2).sum(axis=1).astype(float))
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())], "cluster int, centroid_sha256 string")
    rows = state.select("vec_id", F.col("first").alias("cluster"), "distance")
    totals = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = totals.agg(F.sum("cluster_inertia").alias("inertia"))
    about = totals.crossJoin(whole).join(names, "cluster")  # a row for each centroid
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigner(c: np.ndarray, moved: np.ndarray, fresh: bool, last: bool, dims: int):
    """One round over the state: bounds give way by what the centroids moved, then each vector is assigned."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(c)
        most = moved.max(initial=0.0)
        rest = np.where(moved == most, np.sort(np.append(moved, 0.0))[-2] if len(moved) > 1 and (moved == most).sum() == 1 else most, most)
        for batch in batches:
            col = lambda n: batch.column(n).to_numpy(zero_copy_only=False).copy()
            v, first, second, upper, lower = _matrix(batch.column("v"), dims), col("first").astype(np.int64), col("second").astype(np.int64), col("upper"), col("lower")
            before = np.full(len(first), -1) if fresh else first.copy()  # what sums and counts have so far
            if len(v):
                upper += moved[first]
                lower -= rest[first]
                search.assign(v, first, second, upper, lower)
            d = search.distance(v, first) if last and len(v) else np.zeros(len(v), np.int64)
            new = {"first": first.astype(np.int32), "before": before.astype(np.int32), "second": second.astype(np.int32), "upper": upper, "lower": lower, "distance": d}
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v")} | {n: pa.array(x) for n, x in new.items()})

    return assign


def _changes(state: DataFrame, dims: int) -> DataFrame:
    """(cluster, pos, total, n): what vectors that changed their centroid add to sums and counts, by component.

    A task adds up its own vectors first, so the shuffle has a row for each task, centroid and component.
    """
    k_of = lambda first: int(first.max(initial=-1)) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((0, dims), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            v, first, before = _matrix(batch.column("v"), dims), *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("first", "before"))
            size = max(k_of(first), k_of(before), len(sums))
            sums, counts = np.pad(sums, ((0, size - len(sums)), (0, 0))), np.pad(counts, (0, size - len(counts)))
            for at, way in ((first, 1), (before, -1)):
                known = np.flatnonzero((at >= 0) & (first != before))
                order = known[np.argsort(at[known], kind="stable")]
                if len(order):
                    heads = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                    sums[at[order][heads]] += way * np.add.reduceat(v[order], heads, axis=0)
                    counts[at[order][heads]] += way * np.diff(np.append(heads, len(order)))
        used = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dims, pa.int32()), pa.array(sums[used].ravel()))
            yield pa.record_batch({"cluster": pa.array(used.astype(np.int32)), "n": pa.array(counts[used]), "sums": lists})

    part = state.filter("first <> before").select("v", "first", "before").mapInArrow(add, "cluster int, n long, sums array<long>")
    return part.select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
