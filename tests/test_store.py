"""The versioned store with two writers and with failures, the cache in front of an encoder, and sources that fail."""

import threading

import pytest
from pyspark.sql import functions as F

from evidex.functions.text import text_hash
from evidex.operators import literature as L
from evidex.operators import vectors as V
from evidex.operators.graph import shared_folder
from evidex.sources import sinks, store


@pytest.fixture
def path(spark, tmp_path):
    return str(tmp_path / "store")


def rows(spark, *ids, tag="a"):
    return spark.createDataFrame([(i, [float(i)], tag) for i in ids], "id long, vector array<double>, tag string")


def held(spark, path):
    return sorted((r.id, r.tag) for r in store.read_store(spark, path).collect())


def test_batches_append_and_replace(spark, path):
    assert sinks.upsert_embedding_store(rows(spark, 1, 2), path) == 1
    assert sinks.upsert_embedding_store(rows(spark, 3, tag="b"), path) == 2
    with pytest.raises(ValueError):
        sinks.upsert_embedding_store(rows(spark, 4, 2), path)
    with pytest.raises(ValueError):
        sinks.upsert_embedding_store(rows(spark, 5, 5), path)
    with pytest.raises(ValueError):
        sinks.upsert_embedding_store(spark.createDataFrame([(None, [1.0], "x")], "id long, vector array<double>, tag string"), path)
    assert held(spark, path) == [(1, "a"), (2, "a"), (3, "b")]
    sinks.upsert_embedding_store(rows(spark, 2, 9, tag="c"), path, replace=True)
    assert held(spark, path) == [(1, "a"), (2, "c"), (3, "b"), (9, "c")]
    store.vacuum(spark, path)
    assert held(spark, path) == [(1, "a"), (2, "c"), (3, "b"), (9, "c")] and store.snapshot(spark, path)[0] == 3
    sinks.upsert_embedding_store(rows(spark).limit(0), path)
    assert len(held(spark, path)) == 4


@pytest.mark.parametrize("replace", [False, True])
def test_of_two_writers_with_one_key_one_counts(spark, path, replace):
    """Both check against the same version; the one that publishes second looks again."""
    store.upsert_store(rows(spark, 0), path)
    meet, outcome = threading.Barrier(2, timeout=120), {}

    def write(tag):
        first = []

        def wait():
            if not first:
                first.append(1)
                meet.wait()

        try:
            outcome[tag] = store.upsert_store(rows(spark, 7, ord(tag), tag=tag), path, replace=replace, before_publish=wait)
        except ValueError as error:
            outcome[tag] = str(error)

    threads = [threading.Thread(target=write, args=(t,)) for t in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(spark, path)
    assert [i for i, _ in got].count(7) == 1
    if replace:
        assert sorted(outcome.values()) == [2, 3] and len(got) == 4
    else:
        assert sorted(map(str, outcome.values())) == ["2", "the batch has keys that are stored"] and len(got) == 3


def test_writers_with_different_keys_both_count(spark, path):
    meet = threading.Barrier(2, timeout=120)
    seen = threading.local()

    def wait():
        if not getattr(seen, "done", False):
            seen.done = True
            meet.wait()

    threads = [threading.Thread(target=lambda k=k: store.upsert_store(rows(spark, k), path, before_publish=wait)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(spark, path) == [(1, "a"), (2, "a")] and store.snapshot(spark, path)[0] == 2


def test_a_failure_before_the_commit_leaves_no_trace(spark, path):
    store.upsert_store(rows(spark, 1), path)

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.upsert_store(rows(spark, 2), path, batch="two", before_publish=fail)
    assert held(spark, path) == [(1, "a")]
    for _ in range(2):  # and a retry writes once
        store.upsert_store(rows(spark, 2), path, batch="two")
    assert held(spark, path) == [(1, "a"), (2, "a")]
    assert len(store.vacuum(spark, path)) == 1 and held(spark, path) == [(1, "a"), (2, "a")]


def test_the_encoder_sees_each_distinct_miss_once(spark, path):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    def run(texts):
        before = calls.value
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").repartition(3)
        out, stats = V.embed_with_cache(df, path, "t", text_hash(F.col("t")), encode)
        return {r.id: r.vector for r in out.collect()}, tuple(stats.first()), calls.value - before

    vectors, stats, n = run(["one", "two", "one", None, " ", "one"])
    assert vectors == {0: [3.0], 1: [3.0], 2: [3.0], 3: None, 4: None, 5: [3.0]} and stats == (2, 2, 0.5) and n == 2
    vectors, stats, n = run(["two", "three", "three"])
    assert vectors == {0: [3.0], 1: [5.0], 2: [5.0]} and stats == (2, 1, 0.666667) and n == 1
    assert run(["one"])[1:] == ((1, 0, 1.0), 0) and run([])[1:] == ((0, 0, 0.0), 0)


def test_sources_fail_by_themselves(spark):
    a = spark.createDataFrame([(1, "x")], "ord int, title string")
    fail = a.withColumn("ord", F.raise_error(F.lit("no")).cast("int"))

    def broken():
        raise TimeoutError("late")

    union, status = L.federated_union({"one": a, "two": a.filter("ord > 5"), "bad": fail, "late": broken, "gone": lambda: spark.read.parquet(f"{shared_folder(spark)}/nothing")}, ["one", "two", "three", "bad", "late", "gone", "one"])
    assert [tuple(r) for r in union.collect()] == [(1, "x", "one")]
    got = {r.source: (r.status, r.n_results) for r in status.collect()}
    assert got == {"one": ("OK (1 results)", 1), "two": ("No results", 0), "three": ("Failed: unknown source", 0), "bad": ("Failed: USER_RAISED_EXCEPTION", 0), "late": ("Failed: TimeoutError", 0), "gone": ("Failed: PATH_NOT_FOUND", 0)}
    assert L.federated_union({"late": broken}, ["late"], spark)[0].count() == 0
