"""Conversation and task tables: histories, retention, search, summaries, readiness and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import clamp, snippet, strings

TERMINAL = ("completed", "failed", "cancelled", "timed_out")


def _newest(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def recent_history(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The last messages of each conversation, with their place in order."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= limit)


def retain_last_n(messages: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(kept rows, evicted count for each conversation)."""
    kept = recent_history(messages, most).drop("back")
    counts = messages.groupBy("conversation_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("evicted"))
    return kept, counts


def prune_expired(messages: DataFrame, ttl_seconds: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row: evicted): rows from before ``ttl_seconds`` ago go; those without a time go too."""
    young = F.coalesce(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - ttl_seconds, F.lit(False))
    return messages.filter(young), messages.agg(F.count_if(~young).alias("evicted"))


def keyword_search(records: DataFrame, query: str, kinds: list[str] | None = None, conversation: int | None = None, limit: int = 20) -> DataFrame:
    """The records (kind, id, conversation_id, content) that hold most of the query's terms."""
    terms = sorted(set(query.lower().split()))
    rows = records
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    if conversation is not None:
        rows = rows.filter(F.col("conversation_id") == conversation)
    low = F.lower("content")
    score = F.size(F.filter(strings(terms), lambda t: F.contains(low, t))) / len(terms) if terms else F.lit(0.0)
    scored = rows.withColumn("score", F.round(score, 6)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "kind", "id").limit(limit).select("kind", "id", "score", snippet(F.col("content")).alias("snippet"))


def list_filter(rows: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy("created_at")


def sessions_of(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("n_messages"))


def list_conversations(sessions: DataFrame, limit: int, offset: int = 0, user: str | int | None = None, status: str | None = None) -> DataFrame:
    """A page of conversations, the newest first; of one user (user_id) or status where these are given."""
    rows = sessions if user is None else sessions.filter(F.col("user_id") == user)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "conversation_id").offset(offset).limit(limit)


def conversation_summary(messages: DataFrame) -> DataFrame:
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.struct("created_at", "id")))
    by = messages.groupBy("conversation_id").agg(
        F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count("*").alias("n"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), first.alias("first"),
    )
    title = F.when(F.length("first") > 50, F.concat(F.substring("first", 1, 50), F.lit("..."))).otherwise(F.coalesce("first", F.lit("")))
    return by.withColumn("title", title).drop("first")


def conversation_stats(sessions: DataFrame) -> DataFrame:
    """One row: conversations, messages and their mean; where sessions have them, also users and numbers by status."""
    more = [F.count_distinct("user_id").alias("n_users")] if "user_id" in sessions.columns else []
    more += [F.count_if(F.col("status") == x).alias(x) for x in ("active", "completed", "expired")] if "status" in sessions.columns else []
    return sessions.agg(F.count("*").alias("n_conversations"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"), F.coalesce(F.round(F.avg("n_messages"), 6), F.lit(0.0)).alias("mean_messages"), *more)


def session_expiry(sessions: DataFrame, now: Column, timeout_seconds: int = 3600) -> DataFrame:
    if timeout_seconds <= 0:
        return sessions.withColumn("status", F.lit("active"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return sessions.withColumn("status", F.when(idle > timeout_seconds, "expired").otherwise("active"))


def render_transcript(messages: DataFrame, last_turns: int | None = None, most_chars: int = 100) -> DataFrame:
    """(conversation_id, transcript): lines "[ROLE] text"; with ``last_turns`` the last two for each, cut short."""
    rows = messages if last_turns is None else recent_history(messages, 2 * last_turns)
    text = F.col("content") if last_turns is None else F.substring("content", 1, most_chars)
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), text)
    lines = F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line"))))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def user_limits(sessions: DataFrame, user: str, most: int, status: str | None = None) -> DataFrame:
    """Users with ``most`` conversations or more; with ``status`` only active ones count."""
    rows = sessions if status is None else sessions.filter(F.col(status) == "active")
    return rows.groupBy(user).agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def full_conversations(messages: DataFrame, most: int) -> DataFrame:
    """(conversation_id, n) of conversations at the limit of messages or beyond."""
    return messages.groupBy("conversation_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def evict_oldest(records: DataFrame, keys: list[str], most: int, status: str | None = None) -> DataFrame:
    """The newest ``most`` of each group; with ``status``, finished ones go first."""
    order = [F.col(status).isin(*TERMINAL).cast("int").asc()] if status else []
    return records.withColumn("place", _newest(keys, [*order, F.desc("created_at"), F.desc("task_id")])).filter(F.col("place") <= most).drop("place")


def ready_tasks(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies (task_id, dependency) are all completed."""
    done = tasks.filter("status = 'completed'").select(F.col("task_id").alias("dependency"))
    unmet = dependencies.filter("dependency is not null").join(done, "dependency", "left_anti").select("task_id").distinct()
    return tasks.filter("status = 'pending'").join(unmet, "task_id", "left_anti")


def workflow_progress(tasks: DataFrame) -> DataFrame:
    bad = F.col("status").isin("failed", "timed_out")
    return tasks.groupBy("request_id").agg(
        F.round(100 * F.count_if(F.col("status").isin(*TERMINAL)) / F.count("*"), 6).alias("progress"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "completed").alias("successful"),
    )


def aggregate_confidence(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Clamped values by each method; 0 where there is none."""
    c = clamp(F.col(value))
    methods = {"mean": F.avg(c), "highest": F.max(c), "lowest": F.min(c), "product": F.product(c)}
    return rows.groupBy(group).agg(*[F.coalesce(f, F.lit(0.0)).alias(n) for n, f in methods.items()])


def overall_confidence(results: DataFrame, request: str, success: str, confidence: str) -> DataFrame:
    """Mean confidence of successes times their share, at most 1; 0.5 where none succeeded."""
    mean = F.avg(F.when(F.col(success), F.col(confidence)))
    rate = F.count_if(success) / F.count("*")
    return results.groupBy(request).agg(F.coalesce(F.least(F.lit(1.0), mean * rate), F.lit(0.5)).alias("confidence"))


def merge_results(results: DataFrame, request: str, success: str, output: str, error: str) -> DataFrame:
    """Totals, sorted outputs and errors of each request."""
    ok = F.col(success)
    message = F.coalesce(error, F.lit("Unknown error"))
    return results.groupBy(request).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.array_sort(F.collect_list(F.when(ok, F.col(output)))).alias("data"), F.array_sort(F.collect_list(F.when(~ok, message))).alias("errors"),
    )
