"""Benchmark decontamination by Wu-Manber multi-pattern search over word numbers.

Patterns are the benchmark's windows of ``window`` words. The alphabet is words, not bytes: a block
is two neighbouring words, and the shift table says for a block how far the search may jump before a
window could end there; a block that no window holds lets it jump by ``window - 1``. Where the shift
is zero, the bucket of the window's last block lists the windows to compare, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import coded, cut, slices, small_batches, without, word_table, words_of

WINDOW = 10
#: Most windows that are sent to the executors at once; more are searched for block by block.
BLOCK_WINDOWS = 200_000

#: Words hold 0-9, a-z (after folding) and all bytes beyond ASCII.
WORDS = word_table(word=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), fold=True)


class WuManber:
    """Search for many equally long word sequences (``patterns``: tuples of numbers)."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.m = m = len(patterns[0])
        self.block = b = 2 if m > 1 else 1
        self.free = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                key = p[end - b : end] if b > 1 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.free), m - end)
            self.buckets.setdefault(key, []).append((p, k))

    def search(self, words: list[int]) -> list[tuple[int, int]]:
        """(first word, pattern) of each occurrence, overlapping ones too."""
        found, n, m, b = [], len(words), self.m, self.block
        shift, free, buckets = self.shift, self.free, self.buckets
        at = m
        while at <= n:
            key = (words[at - 2], words[at - 1]) if b > 1 else words[at - 1]
            jump = shift.get(key, free)
            if jump:
                at += jump
                continue
            for p, k in buckets[key]:
                if tuple(words[at - m : at]) == p:
                    found.append((at - m, k))
            at += 1
        return found


#: A window's name: 128 bits of hash of its words.
_KEY = "unhex(md5(words))"


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of (item_id, text): window (hash of its words), words joined by spaces, n words and
    item_id as a string, a row for each item and window.

    An item of fewer words, but not none, is one window; null and wordless texts have none. Windows of
    null item_ids are there, with a null.
    """

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, before = words_of(batch.column("text"), WORDS)
            words, rows, texts, sizes = words.to_pylist(), [], [], []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = words[before[i] : before[i + 1]]
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    part = own[k : k + window]
                    rows.append(item)
                    texts.append(b" ".join(part).decode())
                    sizes.append(len(part))
            yield pa.record_batch({"item_id": pa.array(rows, pa.string()), "words": pa.array(texts, pa.string()), "n": pa.array(sizes, pa.int32())})

    cut_up = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut_items, "item_id string, words string, n int")
    return cut_up.distinct().withColumn("window", F.expr(_KEY))


def _search(docs: DataFrame, text: str, patterns: list) -> DataFrame:
    """Adds a block's hits to the columns ``n``, ``spans`` and ``windows``; ``patterns``: (window, words, n)."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def merged(spans: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in sorted(zip(spans[::2], spans[1::2])):
            if out and a <= out[-1]:
                out[-1] = max(b, out[-1])
            else:
                out += (a, b)
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        by_size: dict[int, list] = {}
        for name, words, n in sent.value:
            p = tuple(numbers.setdefault(w, len(numbers)) for w in words.encode().split(b" "))
            by_size.setdefault(n, []).append((p, name))
        engines = [(WuManber([p for p, _ in own]), [name for _, name in own]) for own in by_size.values()]
        for batch in batches:
            for part in slices(batch, text):
                words, before = words_of(part.column(text), WORDS)
                codes, distinct = coded(words)
                number = np.array([numbers.get(w, -1) for w in distinct.to_pylist()], np.int64)
                codes = number[codes].tolist() if len(codes) else []
                spans, windows = part.column("spans").to_pylist(), part.column("windows").to_pylist()
                for i in range(len(part)):
                    own, found, hit = codes[before[i] : before[i + 1]], [], set(windows[i])
                    for engine, names in engines:
                        for at, k in engine.search(own):
                            found += (at, at + engine.m)
                            hit.add(names[k])
                    if found:
                        windows[i] = sorted(hit)
                        spans[i] = merged(spans[i] + found)
                new = {"n": pa.array(np.diff(before)), "spans": pa.array(spans, pa.list_(pa.int32())), "windows": pa.array(windows, pa.list_(pa.binary()))}
                yield pa.record_batch({c: new[c] if c in new else part.column(c) for c in part.schema.names})

    return docs.mapInArrow(find, docs.schema)


def _found(docs: DataFrame, windows: DataFrame, block_windows: int) -> DataFrame:
    """``docs`` with columns c0, c1 ... for its own, and n, spans, windows (sorted)."""
    small_batches(docs.sparkSession)
    patterns = windows.select("window", "words", "n").distinct()
    blocks = max(1, -(-patterns.count() // block_windows))
    patterns = patterns.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    text = f"c{docs.columns.index('text')}"
    found = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = found.select("*", F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<binary>)").alias("windows"))
    for k in range(blocks):
        block = [(bytes(r.window), r.words, r.n) for r in patterns.filter(F.col("block") == k).collect()]
        found = _search(found if k == 0 else cut(found), text, block)
    return found


def _named(found: DataFrame, windows: DataFrame) -> DataFrame:
    """``found`` with ``items``: item_ids of its windows, sorted as strings.

    Item lists are made once for each distinct set of windows, since copies of a passage have the same
    one; what is searched for and sent to the executors holds no item_ids, so a window may be in any
    number of items. Texts are searched a second time for the sets rather than written. Rows without
    hits meet nothing and are dealt by their own numbers.
    """
    key = F.sha2(F.array_join(F.transform("windows", lambda w: F.hex(w)), ""), 256)
    sets = found.filter(F.size("windows") > 0).select(key.alias("key"), "windows").dropDuplicates(["key"])
    items = sets.select("key", F.explode("windows").alias("window")).join(windows.select("window", "item_id"), "window")
    lists = items.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    own = F.when(F.size("windows") > 0, key).otherwise(F.monotonically_increasing_id().cast("string"))
    return found.withColumn("key", own).join(lists, "key", "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def _hits() -> Column:
    """Hit words: ends less begins, which alternate in a row of spans."""
    return F.expr("aggregate(spans, 0L, (a, x) -> x - a)")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, items_sha256, contaminated, and hit_spans (first
    word, word after the last, of each run of hit words, flat).

    A document word is hit if it lies in any occurrence of any window. Null and empty texts have no
    words and no hits; null item_ids are in no list, but their windows count as hits. Every window is searched for in every document: where there are more than
    ``block_windows`` of them, block after block, with a written table between two blocks, so that
    what is sent to the executors has that bound. Columns of ``docs`` with the names of results are
    replaced. Repeated rows each get their result; empty tables give no rows, or no hits.
    """
    docs = without(docs, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hit_spans")
    windows = cut(windows_of(benchmark, window))
    found = _named(_found(docs, windows, block_windows), windows)
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.col("n").alias("n_words"),
        _hits().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("spans").alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.0, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without those of whose words more than the share ``most_hit`` is hit; same columns."""
    found = _found(docs, cut(windows_of(benchmark, window)), block_windows).filter(_hits() <= F.lit(most_hit) * F.col("n"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
