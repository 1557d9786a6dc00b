"""Line dedup: repeated runs of lines, found in a suffix array over line ids by prefix doubling.

Lines that have a word are numbered; a document is the sequence of its line ids, and a suffix is what
begins at one of its lines. Prefix doubling sorts suffixes by their first 1, 2, 4 ... lines: round k
pairs a suffix's rank with the rank of the suffix 2^k lines further on, sorts the distinct pairs by
range over all tasks, and numbers them in that order. A rank that one suffix alone has ends its part
in the search. Suffixes of one rank after round k are an interval of the suffix array whose longest
common prefix is 2^k lines or more; equal ranks of the first 2^k and the last 2^k of n lines are the
interval whose common prefix is n lines or more.

A run counts from ``min_words`` words on. The shortest run of so many words that begins, or ends, at a
line has fewer than ``min_words + 1`` lines, so the rounds end at log2(min_words), and its interval
names the first place where it stands. A maximal repeated run of min_words words or more is exactly the
union of the shortest runs inside it, from its lines' beginnings and ends. So shortest runs whose first
copies stand side by side are joined: the length of what results is the longest common prefix of the
suffixes that begin at the run and at its first copy, and deleting all of them deletes each maximal
repeated run but its first copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import cut, hot_join, slices, small_batches, without

MIN_WORDS = 50

#: A line's place: documents by doc_id (null last) and the hash of their text, lines by number.
PLACE = ("d", "t", "pos")


def _full_lines(text: str) -> list[tuple[int, bytes, int]]:
    """(line number, line, words) of the lines with a word."""
    out = []
    for k, line in enumerate(text.split("\n")):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw.split())
        if n:
            out.append((k, raw, n))
    return out


def shortest_runs(words: list[int], least: int) -> dict[int, list[int]]:
    """first line -> lengths, of the shortest runs with ``least`` words from each line's begin and end."""
    total = np.append(0, np.cumsum(words))
    n, runs = len(words), {}
    ends = np.searchsorted(total, total[:-1] + least)  # run from i: lines i to ends[i] - 1
    begins = np.searchsorted(total, total[1:] - least, side="right") - 1  # run up to i: lines begins[i] to i
    for i in range(n):
        if ends[i] <= n:
            runs.setdefault(i, set()).add(int(ends[i]) - i)
        if begins[i] >= 0:
            runs.setdefault(int(begins[i]), set()).add(i + 1 - int(begins[i]))
    return {i: sorted(x) for i, x in runs.items()}


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, pos, h, lens) of every line with a word; h: 128 bits of its text, lens: shortest runs from it."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                d, t, pos, h, lens = [], [], [], [], []
                ds, ts = part.column("d").to_pylist(), part.column("t").to_pylist()
                for i, text in enumerate(part.column("text").to_pylist()):
                    rows = _full_lines(text or "")
                    runs = shortest_runs([n for _, _, n in rows], min_words)
                    for k, (_, raw, _) in enumerate(rows):
                        d.append(ds[i])
                        t.append(ts[i])
                        pos.append(k)
                        h.append(xxhash.xxh3_128_digest(raw))
                        lens.append(runs.get(k, []))
                yield pa.record_batch({"d": pa.array(d, pa.int64()), "t": pa.array(t, pa.int64()), "pos": pa.array(pos, pa.int32()), "h": pa.array(h, pa.binary()), "lens": pa.array(lens, pa.list_(pa.int32()))})

    return docs.select(*_keys(), "text").mapInArrow(explode, "d long, t long, pos int, h binary, lens array<int>")


def _keys():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def _ranks(classes: DataFrame, by: list[str]) -> DataFrame:
    """``classes`` with rank: their order by ``by``, from 0, over all tasks (a sort by range, then sums of its parts)."""
    order = cut(classes.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    sizes = order.groupBy("part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each part
    within = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    ranked = order.withColumn("within", within).join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    return ranked.withColumn("rank", (F.col("before") + F.col("within")).cast("long")).drop("part", "within", "before")


def _repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys ``by`` that rows at different places have, with the first of these places and the number of rows."""
    place = F.struct(*PLACE)
    return rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("size")).filter("first <> last").drop("last")


def _later(rows: DataFrame) -> DataFrame:
    """Runs (d, t, pos, len, first) that an equal one precedes; rows have their interval's ``first`` place."""
    return rows.filter(F.struct(*PLACE) != F.col("first")).select(*PLACE, "len", "first")


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of one document that overlap or touch, and whose first copies do so in the same way, as one."""
    at = runs.select("d", "t", "pos", (F.col("pos") + F.col("len")).alias("end"), F.col("first.d").alias("fd"), F.col("first.t").alias("ft"), (F.col("first.pos") - F.col("pos")).alias("shift"))
    by = ("d", "t", "fd", "ft", "shift")
    w = Window.partitionBy(*by).orderBy("pos")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = at.repartition("d", "t").withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1))
    at = at.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = at.groupBy(*by, "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    first = F.struct(F.col("fd").alias("d"), F.col("ft").alias("t"), (F.col("pos") + F.col("shift")).alias("pos"))
    return whole.select(*PLACE, (F.col("end") - F.col("pos")).alias("len"), first.alias("first"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, pos, len, first): repeated runs of lines that an equal run, at place ``first``, precedes."""
    if min_words < 1:
        raise ValueError("min_words is 1 at least")
    lines = cut(_lines(docs, min_words))
    n = lines.count()  # no round has more than two rows for a line
    ranked = _ranks(_repeated(lines, ["h"]), ["h"])
    level = cut(hot_join(lines, ranked, ["h"], n).groupBy(*PLACE).agg(F.first("rank").alias("rank"), F.first("first").alias("first"), F.first("lens").alias("lens")))
    found, k = [], 1
    while True:
        sized = level.select(*PLACE, "rank", "first", F.explode(F.filter("lens", lambda x: (x >= k) & (x < 2 * k))).alias("len"))
        found.append(_later(sized.filter(F.col("len") == k)))
        longer = sized.filter(F.col("len") > k)
        if k > 1:
            far = level.select("d", "t", F.col("pos").alias("far"), F.col("rank").alias("rank2"))
            both = cut(longer.withColumn("far", F.col("pos") + F.col("len") - k).join(far, ["d", "t", "far"]).select(*PLACE, "len", "rank", "rank2"))
            key = ["len", "rank", "rank2"]
            found.append(_later(hot_join(both, _repeated(both, key), key, n)))
        if 2 * k > min_words:
            break
        ahead = F.max("rank").over(Window.partitionBy("d", "t").orderBy("pos").rangeBetween(k, k))
        pairs = cut(level.select(*PLACE, "lens", "rank", ahead.alias("rank2")).filter("rank2 is not null"))
        classes = _repeated(pairs, ["rank", "rank2"]).select(F.col("rank").alias("r1"), F.col("rank2").alias("r2"), "first", "size")
        classes = _ranks(classes, ["r1", "r2"]).withColumnsRenamed({"rank": "next", "r1": "rank", "r2": "rank2"})
        level = cut(hot_join(pairs, classes, ["rank", "rank2"], n).select(*PLACE, F.col("next").alias("rank"), "first", "lens"))
        k *= 2
        if level.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return _joined(out)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text less the later copies of repeated runs of lines, and n_lines, n_deleted (long).

    A run is some neighbouring lines with ``min_words`` words or more in all; the copy in the document
    with the smallest doc_id (null last; then by the text's hash; then by place) stays. Lines without a
    word join no run: they go with the lines around them, where both are deleted. n_lines and n_deleted
    count lines with a word. Null texts stay null. Rows with one doc_id and one text are one document,
    and all get the same result. Columns named n_lines or n_deleted are replaced. Lines are told apart
    by 128 bits of hash.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "n_lines", "n_deleted")
    runs = repeated_runs(docs, min_words).groupBy("d", "t").agg(F.collect_list(F.struct("pos", "len")).alias("runs"))
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    keyed = docs.select(*_keys(), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    joined = keyed.join(runs, ["d", "t"], "left").drop("d", "t")

    names = [*named.columns, "n_lines", "n_deleted"]

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                texts, n_lines, n_deleted = [], [], []
                for t, own in zip(part.column(text).to_pylist(), part.column("runs").to_pylist()):
                    t, n, gone = without_runs(t, own)
                    texts.append(t)
                    n_lines.append(n)
                    n_deleted.append(gone)
                new = {text: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_deleted": pa.array(n_deleted, pa.int64())}
                yield pa.record_batch({c: new[c] if c in new else part.column(c) for c in names})

    schema = named.withColumns({"n_lines": F.lit(0).cast("long"), "n_deleted": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(delete, schema).toDF(*docs.columns, "n_lines", "n_deleted")


def without_runs(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    """(text less the lines of the runs, lines with a word, deleted ones of these)."""
    lines = (text or "").split("\n")
    full = [k for k, line in enumerate(lines) if line.encode("utf-8", "surrogatepass").split()]
    if not runs:
        return text, len(full), 0
    edge = np.zeros(len(full) + 1, np.int64)
    for r in runs:
        edge[r["pos"]] += 1
        edge[r["pos"] + r["len"]] -= 1
    gone = (np.cumsum(edge[:-1]) > 0).tolist()
    kept, last, wait = [], None, []
    flags = dict(zip(full, gone))
    for k, line in enumerate(lines):
        if k not in flags:
            wait.append(line)
            continue
        if not (flags[k] and last in (True, None)):
            kept += wait
        wait, last = [], flags[k]
        if not flags[k]:
            kept.append(line)
    if not last:
        kept += wait
    return "\n".join(kept), len(full), sum(gone)
