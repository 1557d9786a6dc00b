"""The entry module: names, SQL parity with DuckDB, and independence from the training-data subpackage."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    if hasattr(v, "asDict"):
        return canonical(list(v))
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(f) else float("%.8g" % f)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    ours = sorted(repr([canonical(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([canonical(v) for _, v in sorted(zip(names, row))]) for row in got.fetchall())
    assert ours == theirs


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_runs_without_the_training_data_subpackage(tmp_path, sf):
    """With the subpackage gone and corpus_pipeline.py left, the module imports and the other queries run."""
    for name in ("evidex", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm")} if os.path.isdir(source) else {}))
    code = f"""
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert 'l07_search_papers' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
for name in ('l01_dedupe_by_identifier', 'g01_extract_mentions', 'e05_knn_all_pairs', 'x05_stream_embedding_upsert'):
    assert q[name](spark, {sf!r}).count() > 0, name
assert e.entry(spark).count() > 0
print(len(q))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
