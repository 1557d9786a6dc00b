"""A table of rows by key that many writers share: data folders, and versions that say which of them count.

``path/data/<batch>/bucket=<b>`` has the rows that a batch wrote into a bucket of a hash of their key;
``path/versions/<n>.json`` lists, for each bucket, the folders that make up the table. A reader takes the last
version and sees that one whole. A writer checks its rows against a version, writes its folder, and then
publishes the next version under a name that only one can have; who comes second checks again against what
the first one published. What a failed writer leaves is in no version, and a batch that is in the version
already is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store, and how often a writer that comes second tries again.
BUCKETS, ATTEMPTS = 32, 20


class Conflict(RuntimeError):
    """Others published versions more often than ``ATTEMPTS`` while a batch was being checked."""


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _hadoop(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def is_store(spark: SparkSession, path: str) -> bool:
    """Whether there is a store at ``path``, or nothing yet; a folder of plain files is none."""
    fs, at = _hadoop(spark, path)
    return not fs.exists(at) or bool(_versions(spark, path)) or fs.exists(_hadoop(spark, f"{path}/data")[1])


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def snapshot(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the last version; 0 and an empty content before there is one."""
    found = _versions(spark, path)
    if not found:
        return 0, {"buckets": BUCKETS, "schema": None, "folders": {}, "batches": []}
    return found[-1], json.loads(_read_text(spark, f"{path}/versions/{found[-1]:08d}.json"))


def publish(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Makes ``content`` the version of that number, unless somebody else has one by that number."""
    fs, target = _hadoop(spark, f"{path}/versions/{version:08d}.json")
    _, draft = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # fails where the name is taken
        return True
    except Exception:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise


def read_version(spark: SparkSession, path: str, content: dict, buckets: set[int] | None = None) -> DataFrame | None:
    """The rows of a version (or of some of its buckets); None for a store that has none yet."""
    if content["schema"] is None:
        return None
    folders = [f"{path}/{f}" for b, own in content["folders"].items() for f in own if buckets is None or int(b) in buckets]
    schema = content["schema"]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last version."""
    rows = read_version(spark, path, snapshot(spark, path)[1])
    if rows is None:
        raise FileNotFoundError(f"no store at {path}")
    return rows


def upsert_store(new: DataFrame, path: str, key: str = "id", replace: bool = False, batch: str | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, before_publish: Callable[[], None] | None = None) -> int:
    """Adds the rows of ``new`` to the store at ``path``; the version that has them.

    A null key, or one that is twice in the batch, is an error. So is a key that is stored already, unless
    ``replace``: then the new row takes its place, and the buckets of the batch's keys are written anew.
    Or ``merge`` makes the rows of these buckets from those that are held there and the new ones.
    Either all rows of a batch are in a version or none. ``batch`` names the batch: one that a version has
    already is not added again. ``before_publish`` is called between writing and publishing.
    """
    spark = new.sparkSession
    batch = batch or uuid.uuid4().hex
    odd = new.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1))
    if not odd.isEmpty():
        raise ValueError("the batch has null or repeated keys")
    written = None
    for _ in range(ATTEMPTS):
        version, content = snapshot(spark, path)
        if batch in content["batches"]:
            return version
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(content["buckets"])).cast("int")
        rows = new.withColumn("bucket", bucket)
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # as many as there are buckets
        held = read_version(spark, path, content, touched)
        if held is not None and not replace and not merge and not new.select(key).join(held.select(key), key, "left_semi").isEmpty():
            _drop(spark, path, written)
            raise ValueError("the batch has keys that are stored")
        if (replace or merge) and held is not None:  # what is kept depends on the version
            _drop(spark, path, written)
            written = None
            rows = merge(held, new) if merge else new.unionByName(held.join(new.select(key), key, "left_anti"))
            rows = rows.select(*held.columns).withColumn("bucket", bucket)
        if written is None:
            written = f"data/{batch}-{uuid.uuid4().hex[:8]}"
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{written}")
        if before_publish:
            before_publish()
        folders = {b: list(own) for b, own in content["folders"].items()}
        for b in touched:
            mine = f"{written}/bucket={b}"
            folders[str(b)] = [mine] if replace or merge else [*folders.get(str(b), []), mine]
        schema = content["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        now = {"buckets": content["buckets"], "schema": schema, "folders": folders, "batches": [*content["batches"], batch][-1000:]}
        if publish(spark, path, version + 1, now):
            return version + 1
    _drop(spark, path, written)
    raise Conflict(f"{ATTEMPTS} other versions were published meanwhile")


def _drop(spark: SparkSession, path: str, folder: str | None) -> None:
    if folder:
        fs, at = _hadoop(spark, f"{path}/{folder}")
        fs.delete(at, True)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes data folders that the last version doesn't name, and versions before it; no writer may be at work."""
    version, content = snapshot(spark, path)
    named = {f.split("/")[1] for own in content["folders"].values() for f in own}
    fs, at = _hadoop(spark, f"{path}/data")
    gone = sorted(f.getPath().getName() for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName() not in named)
    for name in gone:
        _drop(spark, path, f"data/{name}")
    for old in _versions(spark, path):
        if old != version:
            _drop(spark, path, f"versions/{old:08d}.json")
    return gone
