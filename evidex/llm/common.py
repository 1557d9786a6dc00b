"""Helpers that the training-data operators share: the shared folder, checkpoints, word segmentation."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session may leave it unset:
    a temporary folder takes its place and becomes the session's checkpoint folder. What stands below
    the path belongs to the innermost ``scratch``, if there is one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if owned := _owned(spark):
        owned[-1].append(path)
    return path


_here = threading.local()


def _owned(spark: SparkSession) -> list[list[str]]:
    """Paths of each open ``scratch`` of this thread and session, innermost last."""
    sessions = _here.__dict__.setdefault("sessions", {})
    return sessions.setdefault(spark.sparkContext.applicationId + str(spark._jsparkSession.sessionUUID()), [])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, what operators wrote to the shared folder inside it; results that read it
    must be written by then. Paths that the caller asks for before the block stay."""
    _owned(spark).append([])
    try:
        yield
    finally:
        for path in _owned(spark).pop():
            spark.sql(f"drop table if exists `{path.rsplit('/', 1)[1].replace('-', '_')}`")
            forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what stands at a path of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, "cut")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that hot_join may send to all tasks in any case; with more shuffle partitions, four for each.
HOT_KEYS = 2000


def hot_join(rows: DataFrame, classes: DataFrame, key: list[str], n: int) -> DataFrame:
    """``rows`` (``n`` of them) joined with ``classes``, a row for each key with ``size``, how many rows have it.

    Keys of more than a quarter of a partition's share of the rows (or one in ``HOT_KEYS``) can't be more
    than four for each partition: they go to all tasks, and their rows stay where they are. Other rows meet
    their key by a shuffle, in which no key has more than that share. ``size`` is dropped.
    """
    most = max(HOT_KEYS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = classes.filter(F.col("size") > n / most).drop("size").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.filter("_hot is null").select(*rows.columns).join(classes.filter(F.col("size") <= n / most).drop("size"), key)
    return marked.filter("_hot").drop("_hot").unionByName(cold)


#: Rows of a batch that goes to Python: with long texts, Spark's own 10,000 take hundreds of MB in each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of batches of texts, unless the session sets its own number of rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "-1") == "-1":  # nobody has set it
        spark.conf.set(name, BATCH_ROWS)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@contextlib.contextmanager
def open_write(path: str):
    """A binary sink at a path or URI; the file appears under its name when it is complete."""
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as sink:
        yield sink
    fs.move(part, at)


def filesystem(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        uri = path if "://" in path else "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


def word_table(word: bytes = b"", other_than: bytes = b"", fold: bool = False) -> np.ndarray:
    """256 numbers: what each byte becomes inside a word, 256 where it ends one.

    Words are made of the bytes in ``word``, or else of all but those in ``other_than``; ``fold``
    turns A-Z into a-z.
    """
    table = np.arange(256, dtype=np.uint16)
    inside = np.zeros(256, bool)
    if word:
        inside[list(word)] = True
    else:
        inside[:] = True
        inside[list(other_than)] = False
    if fold:
        table[65:91] += 32
    table[~inside] = 256
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts); null: empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, table: np.ndarray, kinds: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the number of words before each text (one more entry).

    Works on bytes, so a word is a longest run of bytes that ``table`` keeps; runs end with their text.
    With ``kinds``, 256 numbers, a word also ends where a byte of kind 1 meets one of kind 2.
    """
    data, begins = text_bytes(texts)
    mapped = table[data]
    inside = mapped < 256
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    if kinds is not None:
        kind = kinds[data]
        start[1:] |= kind[1:] + kind[:-1] == 3
    at = begins[:-1][begins[:-1] < len(data)]
    start[at] = inside[at]
    places = np.flatnonzero(start)
    kept = mapped[inside].astype(np.uint8)
    offsets = np.append(np.flatnonzero(start[inside]), len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(places, begins)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number, and the distinct words by number."""
    if not len(words):
        return np.zeros(0, np.int64), words
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each (left, right), equal exactly where both are equal; numbers stay below the length."""
    import pandas as pd

    if not len(left):
        return np.zeros(0, np.int64)
    return pd.factorize(left * (int(right.max()) + 1) + right)[0].astype(np.int64)


def slices(table: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    texts = table.column(column)
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    group = (np.cumsum(sizes) // most).astype(np.int64)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(sizes))
    begin = 0
    for end in ends:
        if end > begin:
            yield table.slice(begin, int(end) - begin)
        begin = int(end)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case: an operator's own results take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
