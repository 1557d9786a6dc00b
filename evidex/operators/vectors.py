"""Embedding table: metrics, exact top-k search in blocks, clusters, caches and ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import normalize_text, sentences_with
from evidex.operators.blocks import QUERY_ROWS, Best, block_join
from evidex.operators.graph import cut, small_batches, write_cut
from evidex.operators.nearest import build_index, matrix, scores, search_index, sized


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


#: Rows of a block that are scored at a time.
_PIECE = 1024


def vector_search(store: DataFrame, queries: DataFrame, top_k: int, source_type: str | None = None, metric: str = "cosine", exclude_self: bool = True, apart: str | None = None) -> DataFrame:
    """(query, id, score, rank): the best ``top_k`` of ``store`` (id, vector) for each of ``queries`` (query, vector).

    Exact. Few queries are one block that meets blocks of the store in tasks, which score them by one
    matrix product and keep ``top_k`` for each query, so no row of the store is copied and no pair is
    ever a row; more than that go through a metric index (see ``nearest``). Scores tie by id; only
    vectors of one length meet; rows and queries without an id or a vector are left out. With ``apart``,
    a column of numbers that both have, rows with equal numbers there don't count as neighbours.
    """
    rows = store if source_type is None else store.filter(F.col("source_type") == source_type)
    if queries.select("query").limit(QUERY_ROWS + 1).count() > QUERY_ROWS:
        return search_index(build_index(rows, metric, apart), queries, top_k, exclude_self, apart)

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids = asked.column("query").to_numpy(), held.column("id").to_numpy()
        best = Best(len(names), top_k)
        if len(names) and len(ids):
            q, m = matrix(asked.column("vector")), matrix(held.column("vector"))
            for k in range(0, len(ids), _PIECE):
                s, at = scores(q, m[k : k + _PIECE], metric), ids[k : k + _PIECE]
                if apart:
                    s[asked.column("apart").to_numpy()[:, None] == held.column("apart").to_numpy()[k : k + _PIECE][None]] = -np.inf
                if exclude_self:
                    s[names[:, None] == at[None]] = -np.inf
                best.add(s, at)
        return pa.table({"query": pa.array(names[best.query], pa.int64()), "id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.float64())})

    found = block_join(sized(queries, "query", apart), sized(rows, "id", apart), work, "query long, id long, score double", key="dims")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_k)


def stored(store: DataFrame, ids: DataFrame | list[int], name: str = "id") -> DataFrame:
    """Rows of ``store`` whose ``name`` is among ``ids`` (a table with that column, or a list); an unknown one is an error."""
    if isinstance(ids, list):
        ids = store.sparkSession.createDataFrame([(i,) for i in ids], f"{name} long")
    ids = ids.select(name).distinct()
    missing = ids.join(store, name, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"not in the store: {[r[0] for r in missing]}")
    return store.join(ids, name, "left_semi")


def find_similar(store: DataFrame, ids: DataFrame | list[int], top_k: int) -> DataFrame:
    """As vector_search, from stored vectors; an unknown id is an error."""
    return vector_search(store, stored(store, ids).select(F.col("id").alias("query"), "vector"), top_k)


def knn_all_pairs(store: DataFrame, k: int) -> DataFrame:
    """k nearest for every row: all rows are the query set of a metric index over themselves."""
    return search_index(build_index(store), store.select(F.col("id").alias("query"), "vector"), k)


def get_by_source(store: DataFrame, source_id: int) -> DataFrame:
    return store.filter(F.col("source_id") == source_id).orderBy("chunk_index")


def get(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_semi")


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def unknown(store: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(store.select("id").distinct(), "id", "left_anti")


def ingest_new_only(papers: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, new rows, counts): (ord, status) of each paper, (ord, text) of those to ingest, and a row for each status.

    A paper is skipped_no_text, skipped_duplicate (stored already, or its ord came before) or new.
    """
    text = normalize_text(F.concat_ws(" ", "title", "abstract"))
    known = stored.select(F.col("source_id").alias("ord")).distinct().withColumn("known", F.lit(True))
    joined = papers.select("ord", text.alias("text")).join(known, "ord", "left")
    first = F.row_number().over(Window.partitionBy("ord").orderBy("text"))
    status = F.when(F.col("text").isNull(), "skipped_no_text").when(F.col("known") | (F.col("n") > 1), "skipped_duplicate").otherwise("new")
    marked = joined.withColumn("n", first).select("ord", status.alias("status"), "text")
    return marked.select("ord", "status"), marked.filter("status = 'new'").select("ord", "text"), marked.groupBy("status").agg(F.count("*").alias("n"))


def embed_keywords(text: Column, vocab) -> Column:
    """1 or 0 for each word of the vocabulary that the text holds."""
    return F.transform(F.array(*[F.lit(v) for v in vocab]), lambda k: F.when(F.contains(F.lower(text), k), 1.0).otherwise(0.0))


def embed_hashed_table(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, vector): hashed term frequencies by MLlib, to length 1; blank texts are left out."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer

    rows = df.select(key, normalize_text(F.col(text)).alias("t")).filter("t is not null")
    words = RegexTokenizer(inputCol="t", outputCol="w", pattern=r"\s+").transform(rows)
    hashed = HashingTF(inputCol="w", outputCol="tf", numFeatures=dims).transform(words)
    return Normalizer(inputCol="tf", outputCol="vector").transform(hashed).select(key, "vector")


def embed_with(encoder: Callable, batch_size: int = 32):
    """A column function from any encoder of a pandas Series of texts to arrays of floats."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.concat([pd.Series(list(encoder(texts[k : k + batch_size]))) for k in range(0, len(texts), batch_size)], ignore_index=True) if len(texts) else pd.Series([], dtype=object)

    return encode


def embed_with_cache(texts: DataFrame, path: str, text: str, key: Column, encoder: Callable, batch_size: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows with key and vector, statistics): texts by the cache at ``path``, which then has them all.

    ``path`` is a versioned store (see ``sources.store``) of (key, vector), bucketed by key; it may be
    new. Keys that it lacks go through ``encoder`` (a function from a pandas Series of texts to arrays),
    once each, whatever the number of their rows, and are added as one batch. A later equal text is a
    hit. Rows whose key is null have no vector and count nowhere.
    """
    from evidex.sources import store

    spark = texts.sparkSession
    small_batches(spark)
    keyed = texts.withColumn("key", key)
    distinct = keyed.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(text).alias("_text"))
    held = store.read_version(spark, path, store.snapshot(spark, path)[1])
    known = (held if held is not None else spark.createDataFrame([], "key string, vector array<float>")).select("key", F.lit(True).alias("cached"))
    looked = cut(distinct.join(known, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False))))
    stats = looked.agg(F.coalesce(F.sum(F.when(F.col("cached"), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("hits"), F.count_if(~F.col("cached")).alias("misses"))
    misses = looked.filter(~F.col("cached"))
    if not misses.isEmpty():
        fresh = cut(misses.select("key", embed_with(encoder, batch_size)("_text").alias("vector")))  # written, so that no part is encoded twice
        try:
            store.upsert_store(fresh, path, "key")
        except ValueError:  # somebody else has encoded some of them meanwhile
            own = store.read_store(spark, path).select("key")
            store.upsert_store(fresh.join(own, "key", "left_anti"), path, "key")
    vectors = store.read_version(spark, path, store.snapshot(spark, path)[1])
    vectors = vectors if vectors is not None else spark.createDataFrame([], "key string, vector array<float>")
    return keyed.join(vectors.select("key", "vector"), "key", "left"), stats.withColumn("hit_rate", F.coalesce(F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 6), F.lit(0.0)))


def facet_embeddings(compounds: DataFrame, key: str, description: str, mechanism, indication, placeholder: str = "") -> DataFrame:
    """(key, facet, chunk_index, text): the general text, its mechanism and its indication sentences."""
    whole = normalize_text(F.col(description))
    facets = F.array(
        F.struct(F.lit("general").alias("facet"), F.lit(0).alias("chunk_index"), whole.alias("text")),
        F.struct(F.lit("mechanism").alias("facet"), F.lit(1).alias("chunk_index"), sentences_with(whole, mechanism).alias("text")),
        F.struct(F.lit("indication").alias("facet"), F.lit(2).alias("chunk_index"), sentences_with(whole, indication).alias("text")),
    )
    rows = compounds.filter(whole != placeholder).select(key, F.explode(facets).alias("f")).select(key, "f.*")
    return rows.filter("text <> ''")


def similar_by_facet(store: DataFrame, queries: DataFrame, facet: str, top_k: int) -> DataFrame:
    """Neighbours within a facet from other sources: ``queries`` (query, vector) are ids of the store."""
    own = store.select(F.col("id").alias("query"), "source_id")
    return vector_search(store, queries.join(own, "query"), top_k, facet, apart="source_id")


def profile_fields(compounds: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text): each field that has text, and all of them joined as "combined"."""
    text = {f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) for f in fields}
    combined = F.concat_ws(" | ", *[F.when(c != "", c) for c in text.values()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in [*text.items(), ("combined", combined)]])
    return compounds.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter("text <> ''")


def changed_profiles(fields: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Fields whose text differs from the stored one, or isn't stored."""
    known = stored.select(key, "field", F.sha2("text", 256).alias("h")).distinct()
    return fields.withColumn("h", F.sha2("text", 256)).join(known, [key, "field", "h"], "left_anti").drop("h")


def similar_profiles(store: DataFrame, source_ids: DataFrame | list[int], top_k: int) -> DataFrame:
    """(source, source_id, score, rank): other sources by their best chunk among 4 k neighbours of the first chunk."""
    first = stored(store, source_ids, "source_id").groupBy("source_id").agg(F.min_by("id", "chunk_index").alias("query"), F.min_by("vector", "chunk_index").alias("vector"))
    near = vector_search(store, first, 4 * top_k).join(first.select("query", F.col("source_id").alias("source")), "query").join(store.select("id", "source_id"), "id")
    best = near.filter(F.col("source_id") != F.col("source")).groupBy("source", "source_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "source_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_k)


def suggest_expansion(store: DataFrame, query_ids: DataFrame | list[int], present: DataFrame, k: int = 8, reach: int = 20) -> DataFrame:
    """(query, id, score): of the ``reach`` nearest of each query, the first ``k`` that ``present`` (id) lacks."""
    near = find_similar(store, query_ids, reach).join(present, "id", "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("query", "id", "score")


#: Rows of a block in which leaders are found one after the other, and bytes of their vectors at most.
LEADER_ROWS, LEADER_BYTES = 16_384, 16 << 20


def cluster_leader(store: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(id, leader): the first row without a leader, in order of id, leads all later free rows that are near enough.

    A round takes the first free rows, a block that one task can hold, and goes through them one after
    the other; their leaders then take every other free row that is near one of them, the earliest one
    first, and what is left is the next round's table. So every row is written once when it is decided and
    once for each block of leaders before it, whatever the number of near pairs. Rows without an id or a
    vector are left out, rows with one id are one, the least by its vector; vectors of different lengths
    are never near.
    """
    spark = store.sparkSession
    free = cut(sized(store, "id").groupBy("id").agg(F.min(F.struct("vector", "dims")).alias("r")).select("id", "r.*"))
    done: list[str] = []
    while (widest := free.agg(F.max("dims").alias("d")).first().d) is not None:
        block = min(LEADER_ROWS, max(1, LEADER_BYTES // (8 * widest)))
        head = cut(free.orderBy("id").limit(block))
        last = head.agg(F.max("id")).first()[0]
        decided = write_cut(head.repartition(1).mapInArrow(lambda batches: _led(batches, threshold), "id long, leader long"))
        done.append(decided)
        own = spark.read.schema("id long, leader long").parquet(decided).filter("id = leader").select("id")
        lead = head.join(own, "id", "left_semi").orderBy("id").select("id", "vector").collect()  # a block at most
        leaders: dict[int, list] = {}
        for r in lead:
            leaders.setdefault(len(r.vector), []).append((r.id, r.vector))
        sent = spark.sparkContext.broadcast({n: (np.array([i for i, _ in x]), np.array([v for _, v in x], float)) for n, x in leaders.items()})
        rest = cut(free.filter(F.col("id") > last).mapInArrow(lambda batches, sent=sent: _followers(batches, sent.value, threshold), free.withColumn("leader", F.lit(None).cast("long")).schema))
        done.append(write_cut(rest.filter("leader is not null").select("id", "leader")))
        free = cut(rest.filter("leader is null").drop("leader"))
    return spark.read.schema("id long, leader long").parquet(*done) if done else spark.createDataFrame([], "id long, leader long")


def _led(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The sequential loop over a block: the first free row takes all near ones, then the next free row."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, dims = table.column("id").to_numpy(), table.column("dims").to_numpy()
    leader = np.full(len(ids), -1)
    for x in np.unique(dims).tolist():
        at = np.flatnonzero(dims == x)
        m = matrix(pa.chunked_array([table.column("vector").take(pa.array(at)).combine_chunks()]))
        order = np.argsort(ids[at])
        at, m = at[order], m[order]
        taken = np.full(len(at), -1)
        for i in range(len(at)):
            if taken[i] < 0:
                near = (scores(m[i : i + 1], m[i:], "cosine")[0] >= threshold) & (taken[i:] < 0)
                near[0] = True
                taken[i:][near] = i
        leader[at] = ids[at][taken]
    yield pa.record_batch({"id": pa.array(ids), "leader": pa.array(leader)})


def _followers(batches: Iterator[pa.RecordBatch], leaders: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows with the earliest of ``leaders`` that is near, or null."""
    for whole in batches:
        for a in range(0, len(whole), 1024):
            batch = whole.slice(a, 1024)
            dims = batch.column("dims").to_numpy()
            found, known = np.zeros(len(dims), np.int64), np.zeros(len(dims), bool)
            for x in np.unique(dims).tolist():
                ids, m = leaders.get(x, (None, None))
                open_ = np.flatnonzero(dims == x)
                v = matrix(pa.chunked_array([batch.column("vector").take(pa.array(open_))]))
                for k in range(0, len(m) if m is not None else 0, 1024):
                    near = scores(v, m[k : k + 1024], "cosine") >= threshold
                    hit = near.any(axis=1)
                    found[open_[hit]], known[open_[hit]] = ids[k : k + 1024][near[hit].argmax(axis=1)], True
                    open_, v = open_[~hit], v[~hit]
            yield pa.record_batch({c: batch.column(c) for c in batch.schema.names} | {"leader": pa.array(found, mask=~known)})


def layout_2d(store: DataFrame, width: float = 400.0) -> DataFrame:
    """(id, x, y): two principal components, the largest coordinate at ``width``; signs are fixed by the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = store.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    mean = rows.select(Summarizer.mean(F.col("v")).alias("m")).first().m
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    loading = model.pc.toArray()
    sign = np.sign(loading[np.abs(loading).argmax(axis=0), [0, 1]])
    shift = np.asarray(mean) @ loading
    p = vector_to_array("p")
    placed = model.transform(rows).select("id", *[((p[i] - float(shift[i])) * float(sign[i])).alias(c) for i, c in enumerate("xy")])
    most = F.broadcast(placed.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")))
    return placed.crossJoin(most).select("id", (F.col("x") / F.col("m") * width).alias("x"), (F.col("y") / F.col("m") * width).alias("y"))


def store_stats(store: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Rows, dimensions and sources of each source type; with ``cache``, the row of statistics that
    ``embed_with_cache`` gives, also hits, misses and hit_rate."""
    rows = store.groupBy("source_type").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dims"), F.count_distinct("source_id").alias("n_sources"))
    return rows if cache is None else rows.crossJoin(F.broadcast(cache.select("hits", "misses", "hit_rate")))  # one row
