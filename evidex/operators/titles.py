"""Pairs of titles within a share of edits, found by their rarest pieces.

An edit touches at most one of a set of disjoint pieces, so a title within k edits of another keeps all but
k of them, moved by k places at most. Pieces are ordered from rare to frequent, the same way on both sides,
and each title takes its first ones until they hold k + m disjoint ones, with m of two or more. Of two titles
within k edits, the one whose pieces end first then has m pieces at least that are among the other's, near
their places: pairs that share fewer are never compared.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.graph import cut, small_batches

#: Buckets that pieces are counted in; the counts of all of them are sent to all tasks.
BUCKETS = 1 << 18
#: Characters of a block of titles on either side, and shared pieces that are looked at at a time.
LEFT_CHARS, RIGHT_CHARS, MATCHES = 4 << 20, 8 << 20, 1 << 21
#: Counts that a title's pairs of characters are kept in, and pairs of titles that are held against each other by them at a time.
SKETCH, PAIRS = 512, 8192
#: Characters of titles that are cut up at a time.
CHARS = 1 << 20


def levels(least: float) -> list[tuple[int, float, float]]:
    """(length of pieces, least and greatest length of a title) of each level.

    Longer pieces are rarer but need longer titles: one of L characters holds k + 2 disjoint ones only
    if they are no longer than L / (k + 2). The level of a pair is that of its shorter title, so a title
    belongs to a level up to that level's longest partner.
    """
    most = max(1, math.floor(least / (1 - least)))  # what pieces of very long titles could have
    sizes = sorted({max(1, q) for q in (1, most // 4, most // 2, 2 * most // 3, most - 2, most - 1)})
    ends = [next((n for n in range(1, 10_000) if all((edits(m, least) + 2) * q <= m for m in (n, n + 1, 2 * n))), 10_000) for q in sizes]
    ends = [0, *ends[1:], math.inf]
    return [(q, a, b / least) for q, a, b in zip(sizes, ends, ends[1:]) if a < b]


def edits(length: int, least: float) -> int:
    """Most edits between a title of a length and any that is alike."""
    return max(0, math.ceil(round(length * (1 - least) / least, 9)) - 1)


def _cut_up(texts: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(title, place, hash) of every piece of ``q`` characters; of a shorter title, its whole."""
    joined = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.append(0, np.cumsum(sizes))
    mixed = (joined + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed = np.append(mixed, np.zeros(q, np.uint64))
    h = np.zeros(len(joined), np.uint64)
    title = np.repeat(np.arange(len(sizes)), sizes)
    end = begins[title + 1]
    at = np.arange(len(joined))
    for j in range(q):
        inside = at + j < end
        h = np.where(inside, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + len(joined)], h)
    kept = (at + q <= end) | (at == begins[title])
    h = (h[kept] + np.uint64(q)) * np.uint64(0x94D049BB133111EB)
    return title[kept], (at - begins[title])[kept], (h ^ (h >> np.uint64(31))).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.utf8_length(batch.column("t")).to_numpy(zero_copy_only=False))
    begin = 0
    for end in np.append(np.flatnonzero(np.diff(sizes // CHARS)) + 1, len(sizes)).tolist():
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def _by_level(part: pa.RecordBatch, steps: list[tuple[int, float, float]]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """(length of pieces, rows, their titles and sizes) of the levels that have any of the titles."""
    sizes = pc.utf8_length(part.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
    for q, low, high in steps:
        own = np.flatnonzero((sizes >= low) & (sizes < high))
        if len(own):
            yield q, pa.array(own), part.column("t").take(pa.array(own)), sizes[own]


def piece_counts(titles: DataFrame, least: float) -> np.ndarray:
    """How often pieces of each bucket occur in ``titles`` (t): ``BUCKETS`` numbers, counted in tasks."""
    steps = levels(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _slices(batch):
                for q, _, texts, _ in _by_level(part, steps):
                    sums += np.bincount(_cut_up(texts, q)[2] & (BUCKETS - 1), minlength=BUCKETS)
        own = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(own), "n": pa.array(sums[own])})

    found = titles.select("t").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _first_pieces(place: np.ndarray, q: int, wanted: int, group: np.ndarray) -> tuple[int, int]:
    """(how many of the pieces, rarest first, hold ``wanted`` disjoint ones, how many disjoint ones they hold).

    ``group`` tells where equal pieces end; they are taken together.
    """

    def disjoint(n: int) -> int:
        count, free = 0, -1
        for p in np.sort(place[:n]).tolist():
            if p >= free:
                count, free = count + 1, p + q
        return count

    ends = np.flatnonzero(np.append(np.diff(group) != 0, True)) + 1
    low, high = 0, len(ends) - 1
    if disjoint(int(ends[high])) <= wanted:
        return int(ends[high]), disjoint(int(ends[high]))
    while low < high:
        mid = (low + high) // 2
        if disjoint(int(ends[mid])) >= wanted:
            high = mid
        else:
            low = mid + 1
    return int(ends[low]), disjoint(int(ends[low]))


def _ranked(texts: pa.Array, q: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(title, place, hash) of every piece by title and rarest first, and where each title's begin, with the end."""
    title, place, h = _cut_up(texts, q)
    order = np.lexsort((place, h, counts[h & (BUCKETS - 1)], title))
    return title[order], place[order], h[order], np.append(0, np.cumsum(np.bincount(title, minlength=len(texts))))


def rare_pieces(titles: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(id, t, q, taken, sure) of ``titles`` (id, t) by level: how many of its rarest pieces a title takes, and how many disjoint ones a partner must share."""
    sent, steps = titles.sparkSession.sparkContext.broadcast(counts), levels(least)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                for q, own, texts, sizes in _by_level(part, steps):
                    _, place, h, ends = _ranked(texts, q, sent.value)
                    taken, sure = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                    k = np.array([edits(int(n), least) for n in sizes], np.int64)
                    more = np.maximum(2, (sizes // q - k) // 2)  # beyond k; long titles can spare some
                    for i in range(len(sizes)):
                        taken[i], got = _first_pieces(place[ends[i] : ends[i + 1]], q, int(k[i] + more[i]), h[ends[i] : ends[i + 1]])
                        sure[i] = min(int(more[i]), max(1, got - int(k[i])))
                    yield pa.record_batch({"id": part.column("id").take(own), "t": texts, "q": pa.array(np.full(len(sizes), q)), "taken": pa.array(taken), "sure": pa.array(sure)})

    return titles.select("id", "t").mapInArrow(pick, "id binary, t string, q long, taken long, sure long")


class Pieces:
    """The rarest pieces of a block of ``rare_pieces``: ``title``, ``place`` and ``gram`` of each.

    Of each title: its ``ids``, ``texts`` and ``sizes``, ``most`` is how many edits a title that is no longer may be
    away, ``far`` how many any may be, ``sure`` is how many disjoint pieces a partner must share.
    """

    def __init__(self, table: pa.Table, q: int, counts: np.ndarray, least: float):
        self.ids, self.texts = table.column("id").combine_chunks(), table.column("t").combine_chunks()
        taken, self.sure = table.column("taken").to_numpy(), table.column("sure").to_numpy()
        self.sizes = pc.utf8_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.most = (np.ceil(np.round(self.sizes * (1 - least), 9)) - 1).astype(np.int64)
        self.far = np.array([edits(int(n), least) for n in self.sizes], np.int64)
        begin, parts = 0, []
        for part in _slices(pa.RecordBatch.from_arrays([self.texts], ["t"])):
            title, place, h, ends = _ranked(part.column("t"), q, counts)
            kept = np.arange(len(title)) - ends[title] < taken[begin + title]
            parts.append((begin + title[kept], place[kept], h[kept]))
            begin += len(part)
        self.title, self.place, self.gram = (np.concatenate(x) for x in zip(*parts))


def _met(a: Pieces, b: Pieces, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(titles of ``a``, titles of ``b``) that share enough of their pieces near their places; ``MATCHES`` or so are looked at at a time."""
    known, code = np.unique(b.gram, return_inverse=True)
    wide = int(max(a.place.max(initial=0), b.place.max(initial=0))) + 1
    at = code * wide + b.place  # pieces of one kind stand together, by place
    order = np.argsort(at, kind="stable")
    at, other, there = at[order], b.title[order], b.place[order]
    where = np.searchsorted(known, a.gram)
    own = np.flatnonzero(known[np.minimum(where, max(0, len(known) - 1))] == a.gram) if len(known) else np.zeros(0, np.int64)
    where, title, place = where[own], a.title[own], a.place[own]
    far = a.far[title]
    low = np.searchsorted(at, where * wide + np.maximum(place - far, 0))
    n = np.searchsorted(at, where * wide + np.minimum(place + far, wide - 1), side="right") - low
    spots = wide // q + 1
    kept = np.zeros(0, np.int64)
    begin, total = 0, np.cumsum(n)
    for end in np.append(np.flatnonzero(np.diff(total // MATCHES)) + 1, len(n)).tolist():
        if end <= begin:
            continue
        size = n[begin:end]
        x = np.repeat(np.arange(begin, end), size)
        y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + low[x]
        i, j = title[x], other[y]
        most = np.maximum(a.most[i], b.most[j])  # edits of a pair: those that its longer title allows
        near = (np.abs(place[x] - there[y]) <= most) & (np.abs(a.sizes[i] - b.sizes[j]) <= most)
        found = (i[near] * len(b.sizes) + j[near]) * spots + place[x][near] // q  # disjoint pieces are in different spots
        kept = np.append(kept, np.unique(found))
        last = title[end] if end < len(n) else len(a.sizes)  # pairs of titles before this one are whole
        done = kept // spots // len(b.sizes) < last
        pair, shared = np.unique(np.unique(kept[done]) // spots, return_counts=True)
        i, j = np.divmod(pair, len(b.sizes))
        enough = shared >= np.minimum(a.sure[i], b.sure[j])
        yield i[enough], j[enough]
        kept, begin = kept[~done], end


def _may_be_alike(a: Pieces, b: Pieces, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs differ in no more pairs of neighbouring characters than their edits allow, four for each edit."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        sketches = []
        for side, rows in ((a, x), (b, y)):
            used, back = np.unique(rows, return_inverse=True)
            title, _, h = _cut_up(side.texts.take(pa.array(used)), 2)
            n = np.bincount(title * SKETCH + (h >> 8) % SKETCH, minlength=len(used) * SKETCH)  # more in a bucket than it holds only makes pairs nearer
            sketches.append(np.minimum(n, 32767).astype(np.int16).reshape(-1, SKETCH)[back])
        apart = np.abs(sketches[0] - sketches[1]).sum(axis=1, dtype=np.int64)
        out[k : k + PAIRS] = apart <= 4 * np.maximum(a.most[x], b.most[y])
    return out


def title_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids of titles (id, t) that share enough of their rarest pieces near their places.

    Titles are sent by classes of length, a left one to its own class and the two beside it, and meet there
    in blocks of ``LEFT_CHARS`` by ``RIGHT_CHARS`` characters. They are cut up in the block, so that neither
    pieces nor pairs that share too few, or that differ in too many pairs of characters, are shuffled.
    """
    counts = piece_counts(left.select("t").union(right.select("t")), least)
    spark = left.sparkSession
    sent = spark.sparkContext.broadcast(counts)
    kind = F.floor(F.log(F.length("t")) / -math.log(least * (1 - 1e-9)))  # alike ones are in neighbouring classes
    a = cut(rare_pieces(left, counts, least)).withColumn("kind", F.explode(F.sequence(kind - 1, kind + 1)))
    b = cut(rare_pieces(right, counts, least)).withColumn("kind", kind)
    chars = lambda df, most, name: df.groupBy("q", "kind").agg(F.ceil(F.sum(F.length("t")) / most).alias(name))
    blocks = cut(chars(a, LEFT_CHARS, "na").join(chars(b, RIGHT_CHARS, "nb"), ["q", "kind"]))  # a row for each level and class of length
    every = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)) + 1
    names, by, tasks = ("id", "t", "taken", "sure"), ("q", "kind", "pa", "pb"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = a.join(F.broadcast(blocks), ["q", "kind"]).select(*names, "q", "kind", own("na").alias("pa"), every("nb").alias("pb"))
    b = b.join(F.broadcast(blocks), ["q", "kind"]).select(*names, "q", "kind", every("na").alias("pa"), own("nb").alias("pb"))

    def work(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        found = [(pa.array([], pa.binary()), pa.array([], pa.binary()))]
        if len(one) and len(other):
            q = key[0].as_py()
            x, y = Pieces(one, q, sent.value, least), Pieces(other, q, sent.value, least)
            for i, j in _met(x, y, q):
                alike = _may_be_alike(x, y, i, j)
                found.append((x.ids.take(pa.array(i[alike])), y.ids.take(pa.array(j[alike]))))
        return pa.table({"a": pa.chunked_array([x for x, _ in found]), "b": pa.chunked_array([y for _, y in found])})

    a, b = (df.repartition(tasks, *by) for df in (a, b))  # few bytes, but long to compare
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(work, "a binary, b binary").distinct()


def distance(a: str, b: str, most: int) -> int | None:
    """Edits between two texts, None beyond ``most``: a column of differences at a time, as bits of two numbers (Myers)."""
    if abs(len(a) - len(b)) > most:
        return None
    begin = len(os.path.commonprefix((a, b)))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b))  # no more than most, as lengths differ by no more
    has: dict[str, int] = {}
    for k, c in enumerate(a):
        has[c] = has.get(c, 0) | 1 << k
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, edits = whole, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = has.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (whole & ~(across | more)), more & across
        edits += 1 if up & last else -1 if down & last else 0
        if edits - left > most:
            return None  # each character that is left takes one edit off at most
        up, down = (up << 1 | 1) & whole, (down << 1) & whole
        same |= less
        more, less = down | (whole & ~(same | up)), up & same
    return edits


def title_pairs(left: DataFrame, right: DataFrame, least: float = 0.9, first: bool = False) -> DataFrame:
    """(ord, other) of titles whose edit similarity passes ``least`` (over a half, under one); with ``first``, only the least other.

    Candidates by rare pieces are compared exactly; equal titles are compared once, and empty ones never. With
    ``first`` those of a title are compared in order of ``other``, and none after one that is alike.
    """
    if not 0.5 < least < 1:
        raise ValueError("least lies between 0.5 and 1")
    one, other = _titles(left), _titles(right)
    small_batches(left.sparkSession)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda d, key, name: d.select(_title_id(F.lower("title")).alias(key), F.col("ord").alias(name))
    texts = other.withColumnsRenamed({"id": "b", "t": "tb"})
    pairs = title_candidates(one, other, least)
    if first:
        pairs = pairs.join(rows(right, "b", "other").groupBy("b").agg(F.min("other").alias("other")), "b")
    order = ["a", "other", "b"] if first else ["a", "b"]
    pairs = pairs.join(texts, "b").repartition(tasks, "a")  # few bytes, but long to compare
    pairs = pairs.join(one.withColumnsRenamed({"id": "a", "t": "ta"}).repartition(tasks, "a"), "a").sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            a, alike = batch.column("a").to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())):
                if first and a[i] == found:
                    continue
                longest = max(len(x), len(y))
                edits = distance(x, y, math.ceil(longest * (1 - least)))
                if edits is not None and 1 - edits / longest > least:
                    found = a[i]
                    alike.append(i)
            yield batch.select(order).take(pa.array(alike, pa.int64()))

    same = pairs.select(*order, "ta", "tb").mapInArrow(compare, pairs.select(*order).schema).join(rows(left, "a", "ord"), "a")
    if first:
        return same.select("ord", "other")
    return same.join(rows(right, "b", "other"), "b").select("ord", "other")


def _title_id(t: Column) -> Column:
    """A title by 128 bits of hash, as the title itself would go along with each of its pieces."""
    return F.unhex(F.md5(t))


def _titles(papers: DataFrame) -> DataFrame:
    """(id, t) of the distinct titles, written once."""
    return cut(papers.select(F.lower("title").alias("t")).filter("t <> ''").distinct().select(_title_id(F.col("t")).alias("id"), "t"))
