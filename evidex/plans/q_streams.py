"""Queries of the streaming forms (X) over the event files, and the SQL of what they amount to."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.streaming import streams as X

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def events(s, d):
    return X.file_stream(s, d, "events")


@query("x01_stream_dedupe_ingest", "select user_id, count(*) as n from (select distinct user_id from events) group by 1")
def _(s, d):
    return X.run_to_end(X.dedupe_ingest(events(s, d), ["user_id"], "60 days")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("x02_stream_session_windows", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), n as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, cast(epoch_us(min(ts)) as bigint) as start, cast(epoch_us(max(ts)) as bigint) + 3600000000 as end, count(*) as n from n group by user_id, k")
def _(s, d):
    return X.run_sessions(events(s, d), "user_id").withColumnRenamed("key", "user_id")


@query("x03_stream_last_n", "with l as (select user_id as key, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events) select key, count(*) as kept, arg_max(event_id, back) as oldest, arg_min(event_id, back) as newest from l where back <= 20 group by 1")
def _(s, d):
    with X.rocksdb(s):
        return X.upsert(X.last_n(events(s, d), "user_id", "event_id", 20), X.replace(["key"]), ["key"], mode="update")


@query("x04_stream_graph_upsert", "select cast(user_id as varchar) as src, cast(event_id % 10 as varchar) as dst, event_type as relation, max(value) as confidence, count(*) as merge_count from events group by 1, 2, 3")
def _(s, d):
    rows = events(s, d).selectExpr("cast(user_id as string) as subject", "event_type as verb", "cast(event_id % 10 as string) as object", "value as confidence", "cast(event_id as string) as source", "ts")
    return X.upsert(rows, X.merge_graph, ["src", "dst", "relation"], X.graph_rows).select("src", "dst", "relation", "confidence", "merge_count")


@query("x05_stream_embedding_upsert", "select vec_id as id, len(embedding) as dims, embedding[1]::double as first from embeddings")
def _(s, d):
    rows = X.file_stream(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    held = X.upsert(rows, X.new_only(["id"]), ["id"], lambda batch: batch.dropDuplicates(["id"]))
    return held.select("id", F.size("embedding").cast("long").alias("dims"), F.element_at("embedding", 1).cast("double").alias("first"))


_METRICS = "select cast(epoch({w}) as bigint) as start, event_type as component, count(*) as requests, count(*) filter (event_type = 'error') as failures, round(avg(value), 6) as mean_latency from events{more} group by 1, 2"


def metrics(s, d, *window):
    rows = events(s, d).selectExpr("ts", "event_type as component", "value as latency", "event_type <> 'error' as success")
    keys = ["start", "component"]
    held = X.upsert(X.component_metrics(rows, *window), X.replace(keys), keys, mode="update")
    return held.select(F.unix_timestamp("start").alias("start"), "component", "requests", "failures", F.round("mean_latency", 6).alias("mean_latency"))


@query("x06_stream_component_metrics", _METRICS.format(w="date_trunc('day', ts)", more=""))
def _(s, d):
    return metrics(s, d)


@query("x06_stream_component_metrics_sliding", _METRICS.format(w="time_bucket(interval 12 hours, ts, timestamp '2000-01-01') - to_hours(12 * back)", more=", range(2) t(back)"))
def _(s, d):
    return metrics(s, d, "1 day", "12 hours")
