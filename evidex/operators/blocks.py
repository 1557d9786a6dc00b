"""Many rows against many rows in blocks, and orders over whole tables: what one task must not hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.graph import cut

#: Most rows of a block of queries, and of a block of the rows that they meet.
QUERY_ROWS, STORE_ROWS = 4096, 65_536


def block_join(queries: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, query_rows: int = QUERY_ROWS, store_rows: int = STORE_ROWS, key: str | None = None) -> DataFrame:
    """``work(queries, rows)`` for every block of ``queries`` with every block of ``rows``.

    Both sides are dealt into blocks by a hash of all their columns and meet in tasks by block numbers,
    so neither passes through the driver, which only sees how many rows there are, and the plan's size
    doesn't depend on them. With ``key``, a column of both, only rows with equal keys meet.
    """
    n_queries, n_rows = queries.count(), rows.count()
    return _blocks_join(queries, rows, work, schema, max(1, -(-n_queries // query_rows)), max(1, -(-n_rows // store_rows)), key)


def _blocks_join(queries: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, q_blocks: int, r_blocks: int, key: str | None = None) -> DataFrame:
    """``block_join`` with given numbers of blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("long")
    queries, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, rows))  # apart, where both are of one table
    left = queries.withColumn("_q", own(queries, q_blocks)).withColumn("_r", every(r_blocks))
    right = rows.withColumn("_r", own(rows, r_blocks)).withColumn("_q", every(q_blocks))
    by = ["_q", "_r", *([key] if key else [])]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)


#: Most keys that spread_join sends to all tasks, and rows of one key that it leaves together.
HOT_KEYS, TOGETHER = 100_000, 20_000


def spread_join(left: DataFrame, right: DataFrame, key: str, together: int = TOGETHER) -> DataFrame:
    """``left`` joined with ``right`` by ``key``; rows of a frequent key are dealt over tasks.

    A key of more right rows than ``together``, and than one in ``HOT_KEYS`` of all, is cut into parts of
    about so many by a hash of the row, and its left rows are copied to each part.
    """
    bound = max(together, right.count() // HOT_KEYS)
    hot = right.groupBy(key).count().filter(F.col("count") > bound).select(key, F.ceil(F.col("count") / bound).alias("_parts"))  # HOT_KEYS rows at most
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts)).drop("_parts")
    copied = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return copied.join(dealt, [key, "_part"]).drop("_part")


class Best:
    """The ``k`` best (score, then least id) of each query, fed with matrices of scores."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """``scores``: a row for each query (or each of ``queries``), a column for each of ``ids``; minus infinity for no score."""
        low = self.floor if queries is None else self.floor[queries]
        if scores.shape[1] > self.k:
            low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((scores >= low[:, None]) & np.isfinite(scores))
        self.add_pairs(i if queries is None else queries[i], ids[j], scores[i, j])

    def add_pairs(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The same for scores of single pairs."""
        if not len(queries):
            return
        query, at, score = np.append(self.query, queries), np.append(self.id, ids), np.append(self.score, scores)
        order = np.lexsort((at, -score, query))
        query, at, score = query[order], at[order], score[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        self.query, self.id, self.score = query[kept], at[kept], score[kept]
        full = np.bincount(self.query, minlength=len(self.floor)) == self.k
        ends = np.searchsorted(self.query, np.flatnonzero(full), side="right") - 1
        self.floor[full] = self.score[ends]


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all elements in a row, where each list begins, with the end)."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0) if whole.num_chunks else pa.array([], column.type)
    sizes = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return whole.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


#: Most shared keys that are counted at a time, and keys of a block of either side.
_PIECE, BLOCK_KEYS = 1 << 22, 1 << 23
#: A key that more than one in OFTEN pairs share is counted by a product of matrices, which takes no longer for a
#: pair than one OFTENth of counting it by itself; the most such keys, and queries of a product.
OFTEN, MOST_OFTEN, PRODUCT_ROWS = 1000, 2048, 4096


def _often(n: int, m: int, asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Numbers of the keys that many of ``n`` times ``m`` pairs share, where so many of either side have them."""
    pairs = asked.astype(float) * held
    own = np.flatnonzero(pairs * OFTEN > float(n) * m)
    return np.sort(own[np.argsort(-pairs[own], kind="stable")[:MOST_OFTEN]])


def _bits(row: np.ndarray, key: np.ndarray, n: int, wide: int) -> np.ndarray:
    """A row of zeros and ones for each of ``n``, with ones at its keys."""
    out = np.zeros((n, wide), np.uint8)
    out[row, key] = 1
    return out


def _shared(asked: pa.Table, held: pa.Table) -> Iterable[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """Numbers of keys that rows of ``asked`` and of ``held`` share, for some rows of ``held`` at a time.

    Where most pairs share some: (None, rows of ``held``, a matrix with a row for each of ``asked``). Where few
    do, only those: (rows of ``asked``, rows of ``held``, numbers). In the matrix, keys that many pairs share are
    counted by products of matrices of zeros and ones, others one by one.
    """
    keys, begins = lists(asked.column("keys"))
    n = len(begins) - 1
    distinct, number = np.unique(keys, return_inverse=True)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(begins))[np.argsort(number, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(number, minlength=len(distinct))))
    del keys, number
    theirs, starts = lists(held.column("keys"))
    place = np.searchsorted(distinct, theirs).astype(np.int32)
    known = np.zeros(len(theirs), bool)
    inside = place < len(distinct)
    known[inside] = distinct[place[inside]] == theirs[inside]
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))[known]
    place = place[known]
    work = np.bincount(row, weights=(first[place + 1] - first[place]), minlength=len(starts) - 1)
    dense = work.sum() * 8 > n * len(work)
    if dense:
        often = _often(n, len(work), np.diff(first), np.bincount(place, minlength=len(distinct)))
        code = np.full(len(distinct), -1, np.int32)
        code[often] = np.arange(len(often), dtype=np.int32)
        theirs = np.concatenate([owner[first[k] : first[k + 1]] for k in often]) if len(often) else owner[:0]
        a_bits = _bits(theirs, np.repeat(np.arange(len(often)), np.diff(first)[often]), n, len(often))
        code = code[place]
        b_row, b_key = row[code >= 0], code[code >= 0]
        row, place = row[code < 0], place[code < 0]
        work = np.bincount(row, weights=(first[place + 1] - first[place]), minlength=len(work))
    work += n if dense else 1
    a = 0
    for b in np.append(np.flatnonzero(np.diff(np.cumsum(work) // _PIECE)) + 1, len(work)).astype(int).tolist():
        if b > a:
            at = slice(*np.searchsorted(row, (a, b)))
            sizes = first[place[at] + 1] - first[place[at]]
            ends = np.cumsum(sizes)
            who = owner[np.repeat(first[place[at]] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
            pair = np.repeat(row[at].astype(np.int64) - a, sizes) * n + who
            if dense:
                counts = np.bincount(pair, minlength=(b - a) * n).reshape(b - a, n).astype(np.float32)
                own = slice(*np.searchsorted(b_row, (a, b)))
                b_bits = _bits(b_row[own] - a, b_key[own], b - a, len(often)).astype(np.float32)
                for i in range(0, n, PRODUCT_ROWS) if len(often) else ():
                    counts[:, i : i + PRODUCT_ROWS] += b_bits @ a_bits[i : i + PRODUCT_ROWS].astype(np.float32).T
                yield None, np.arange(a, b), counts.T
            else:
                pair, counts = np.unique(pair, return_counts=True)
                yield pair % n, pair // n + a, counts
        a = b


def overlap_search(queries: DataFrame, rows: DataFrame, top: int | None, measure: str = "count", least: float = 0.0, query_rows: int | None = None) -> DataFrame:
    """(query, id, score, rank): for each of ``queries`` (query, keys) the rows (id, keys) that share keys.

    keys are arrays of distinct longs; the score is their ``count`` or ``tanimoto``, ``least`` or more;
    the ``top`` best, or all without it. Rows that share no key and the query itself are left out. Keys
    that all rows have cost no row of a join: counts are added up in blocks, and only what a block
    keeps is shuffled. A block holds ``BLOCK_KEYS`` keys or so, or ``query_rows`` queries if that is given,
    so rows are copied once for each so many keys of queries, and not for each so many queries.
    """

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids = (t.column(c).to_numpy() for t, c in ((asked, "query"), (held, "id")))
        sizes = [np.diff(lists(t.column("keys"))[1]) for t in (asked, held)]
        best, found = Best(len(names), top or 1), []
        for q, r, counts in _shared(asked, held) if len(names) and len(ids) else ():
            if q is None and measure == "count" and top is not None and (best.floor > 0).mean() > 0.9:  # few pairs are left
                q, at = np.nonzero(counts >= np.maximum(best.floor, max(least, 1))[:, None])
                kept = np.flatnonzero(names[q] != ids[r[at]])
                best.add_pairs(q[kept], ids[r[at[kept]]], counts[q[kept], at[kept]].astype(float))
                continue
            if q is None:
                scores = counts / (1 if measure == "count" else sizes[0][:, None] + sizes[1][r][None] - counts)
                scores = np.where((counts > 0) & (scores >= least) & (names[:, None] != ids[r][None]), scores, -np.inf)
                if top is not None:
                    best.add(scores, ids[r])
                    continue
                q, at = np.nonzero(np.isfinite(scores))
                r, scores = r[at], scores[q, at]
            else:
                scores = counts / (1 if measure == "count" else sizes[0][q] + sizes[1][r] - counts)
                kept = np.flatnonzero((scores >= np.maximum(best.floor[q], least)) & (names[q] != ids[r]))
                q, r, scores = q[kept], r[kept], scores[kept]
            if top is None:
                found.append((q, ids[r], scores))
            else:
                best.add_pairs(q, ids[r], scores)
        q, i, s = (np.concatenate(x) for x in zip(*found)) if found else (best.query, best.id, best.score)
        return pa.table({"query": pa.array(names[q], pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    asked = cut(queries.select(F.col("query").cast("long").alias("query"), "keys"))  # both are counted and then joined
    held = cut(rows.select(F.col("id").cast("long").alias("id"), "keys"))
    n_queries, q_keys, n_rows, r_keys = (x or 0 for df in (asked, held) for x in df.agg(F.count("*"), F.sum(F.size("keys"))).first())
    q_blocks = max(1, -(-q_keys // BLOCK_KEYS), -(-n_queries // query_rows) if query_rows else 1)
    tasks = 2 * asked.sparkSession.sparkContext.defaultParallelism
    r_blocks = max(1, -(-r_keys // BLOCK_KEYS), min(-(-tasks // q_blocks), -(-n_rows // QUERY_ROWS)))
    found = _blocks_join(asked, held, work, "query long, id long, score double", q_blocks, r_blocks)
    if top is None:  # a query may have any number of hits
        run = numbered(found, "_at", "query", F.desc("score"), "id")
        first = run.groupBy("query").agg(F.min("_at").alias("_first"))
        return run.join(first, "query").select("query", "id", "score", (F.col("_at") - F.col("_first") + 1).cast("long").alias("rank"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long"))
    return ranked.filter(F.col("rank") <= top)


def numbered(df: DataFrame, name: str, *order: Column | str, size: str | None = None) -> DataFrame:
    """``df`` with the number of rows (or the sum of ``size``) before each in ``order``, over all tasks.

    Rows are dealt by range and written, so that their places hold; each part is numbered by itself, and
    parts by a sum over their sizes, a row each.
    """
    weight = F.lit(1) if size is None else F.col(size)
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each part
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - weight
    return parts.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def quantiles(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, names of ``places``): values at places of each group's sorted values.

    A place is a function of the group's size that gives a number from 0; between two whole numbers the
    value lies between theirs in proportion. Equal values are one row. Up to ``FEW_VALUES`` rows are put in
    order group by group; more, however many a group has, are spread over all tasks by their order.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    if counts.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        w = Window.partitionBy("_g").orderBy("_v")
        run = counts.withColumns({"_at": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"), "_size": F.sum("_c").over(Window.partitionBy("_g"))})
    else:
        run = _placed(counts)
    at = lambda p: F.max(F.when((F.col("_at") <= p) & (p < F.col("_at") + F.col("_c")), F.col("_v")))
    ends = {}
    for name, place in places.items():
        p = place(F.col("_size"))
        ends |= {f"{name}_lo": at(F.floor(p)), f"{name}_hi": at(F.ceil(p)), f"{name}_p": F.max(p - F.floor(p))}
    found = run.groupBy("_g").agg(*[c.alias(n) for n, c in ends.items()])
    between = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_p")).alias(n) for n in places]
    return found.select(F.col("_g").alias(group), *between)


#: Distinct values that are put in order without being written.
FEW_VALUES = 1 << 20


def _placed(counts: DataFrame) -> DataFrame:
    """Counts with each value's place in its group (_at) and the group's size, by an order over all tasks."""
    run = numbered(counts, "_at", "_g", "_v", size="_c")
    sizes = run.groupBy("_g").agg(F.min("_at").alias("_first"), F.sum("_c").alias("_size"))
    return run.join(sizes, "_g").withColumn("_at", F.col("_at") - F.col("_first"))
