"""Language of a text: the nearest of several centroids of each language, by cosine of TF-IDF letter grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import cut, slices, small_batches, text_bytes, without

#: Buckets that grams are hashed into, lengths of grams in bytes, and buckets whose counts travel in one row.
BUCKETS, GRAMS, CHUNK = 4096, (1, 2, 3, 4), 64
#: Texts that centroids are fitted on, for each language, and the languages that are learnt, the most frequent first.
MOST_TEXTS, MOST_LANGS = 1500, 1000
#: Centroids of a language, steps that move them, and the share of a language's texts that lie within its reach.
CENTROIDS, STEPS, REACH = 4, 8, 0.995

LETTER = r"\p{L}"
#: What each byte becomes: ASCII letters and all of other scripts stay, the rest is one space.
_KEPT = np.where(np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)


def gram_counts(texts: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """How often each text has grams of each bucket: a row for each text.

    Texts are put in lower case, runs of anything but letters are one space, and grams don't cross the
    ends of a text or of a run of spaces; null texts have none.
    """
    n = len(texts)
    data, begins = text_bytes(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    data = _KEPT[data]
    doc = np.repeat(np.arange(n), np.diff(begins))
    space = data == 32
    first = np.ones(len(data), bool)
    first[1:] = ~space[:-1] | (doc[1:] != doc[:-1])
    data, doc, space = data[~space | first], doc[~space | first], space[~space | first]
    out = np.zeros(n * buckets, np.int64)
    h = np.zeros(len(data), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        if len(data) < size:
            break
        last = slice(size - 1, len(data))
        h = (h[: len(data) - size + 1] if size == 1 else h[:-1]) * np.uint32(0x01000193) + data[last] + np.uint32(1)
        if size in GRAMS:
            fine = doc[: len(data) - size + 1] == doc[last]
            if size > 2:  # a space only at either end
                inner = np.append(0, np.cumsum(space))
                fine &= inner[size - 1 : len(data)] - inner[1 : len(data) - size + 2] == 0
            slot = ((h[fine] + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
            out += np.bincount(doc[last][fine] * buckets + slot, minlength=n * buckets)
    return out.reshape(n, buckets)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (0 where a text has no gram)."""
    v = (np.log1p(counts) * idf).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Languages:
    """Inverse document frequencies, and centroids (one to a row) with their languages and reaches."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reach: np.ndarray

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, its cosine) of each text; ties: the smaller number."""
        cos = vectors(gram_counts(texts, len(self.idf)), self.idf) @ self.centroids.T
        best = np.round(cos, 6).argmax(axis=1)
        return best, np.clip(np.round(cos[np.arange(len(best)), best].astype(float), 6), 0, 1)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have grams of each bucket, over all rows of ``docs`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sums += (gram_counts(part.column("text"), buckets) > 0).sum(axis=0)
                n += len(part)
        if n:
            rows = [sums[k : k + CHUNK] for k in range(0, buckets, CHUNK)]
            yield pa.record_batch({"chunk": pa.array(range(-1, len(rows)), pa.int32()), "counts": pa.array([[n], *[r.tolist() for r in rows]], pa.list_(pa.int64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                sums[chunk] = sums.get(chunk, 0) + counts.values.to_numpy()
        yield pa.record_batch({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "chunk int, counts array<long>")
    found = {r.chunk: r.counts for r in parts.repartition("chunk").mapInArrow(add, "chunk int, counts array<long>").collect()}  # buckets / CHUNK rows and one
    if not found:
        return 0, np.zeros(buckets, np.int64)
    return found[-1][0], np.concatenate([found[k] for k in range(-(-buckets // CHUNK))])


def _cluster(v: np.ndarray, k: int, steps: int) -> np.ndarray:
    """``k`` centroids at most of rows of length 1: each next one starts from the row that is furthest from all before."""
    c = v[:1]
    while len(c) < k:
        near = (v @ c.T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        c = np.vstack([c, v[near.argmin()]])
    for _ in range(steps):
        own = (v @ c.T).argmax(axis=1)
        mean = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    return c


def fit_languages(docs: DataFrame, most_texts: int = MOST_TEXTS, centroids: int = CENTROIDS, buckets: int = BUCKETS) -> bytes:
    """The model of ``docs`` (text, lang; doc_id), pickled.

    Document frequencies are counted over all rows with a lang and a text; centroids are fitted, for each
    of the ``MOST_LANGS`` most frequent languages, on ``most_texts`` of its texts that have a letter at
    most, chosen by hash. A language's reach is the distance that ``REACH`` of these texts don't
    pass. Without such rows no language is known.
    """
    rows = docs.filter("lang is not null and text is not null").select(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]).alias("h"), "text", "lang")
    n, df = document_frequencies(rows, buckets)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    lettered = rows.filter(F.col("text").rlike(LETTER))
    counts = lettered.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    share = (2 * most_texts / F.col("count")).alias("share")  # twice what is wanted, so that hardly a row too many is shuffled
    some = lettered.join(F.broadcast(counts.select("lang", share)), "lang").filter(F.abs(F.col("h") / 2.0**63) < F.greatest("share", F.lit(1e-15)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = cut(some.withColumn("place", place).filter(F.col("place") <= most_texts).select("lang", "text", "place"))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        v = np.concatenate([vectors(gram_counts(part.column("text"), buckets), idf) for b in table.combine_chunks().to_batches() for part in slices(b, "text", 1 << 20)])
        c = _cluster(v, centroids, STEPS)
        reach = float(np.quantile(1 - (v @ c.T).max(axis=1), REACH))
        return pa.table({"lang": [key[0].as_py()], "reach": [reach], "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    found = sorted(sample.groupBy("lang").applyInArrow(fit, "lang string, reach double, centroids binary").collect(), key=lambda r: r.lang)  # MOST_LANGS rows
    parts = [np.frombuffer(r.centroids, np.float32).reshape(-1, buckets) for r in found]
    names = [r.lang for r, c in zip(found, parts) for _ in c]
    reach = np.array([r.reach for r, c in zip(found, parts) for _ in c])
    return pickle.dumps(Languages(idf, np.concatenate(parts) if parts else np.zeros((0, buckets), np.float32), names, reach))


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted.

    lang_pred is the language of the nearest centroid and score its cosine; a text that is null or has no
    letter, or any text where no language was learnt, is ``und`` with score 0. accepted is false for
    those, and for texts further from their centroid than its language's texts are. Whole texts count;
    repeated rows and null ids each get their result; columns of the results' names are replaced.
    """
    small_batches(docs.sparkSession)
    names = ("lang_pred", "score", "accepted")
    docs = without(docs, *names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = f"c{docs.columns.index('text')}"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Languages = pickle.loads(sent.value)
        langs = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                own = part.column(text)
                known = pc.fill_null(pc.match_substring_regex(own, LETTER), False).to_numpy(zero_copy_only=False) & bool(m.langs)
                best, cos = m.nearest(own) if m.langs else (np.zeros(len(part), np.int64),) * 2
                near = known & (1 - cos <= (m.reach[best] if m.langs else 0))
                new = {"lang_pred": pa.array(langs[np.where(known, best, len(m.langs))], pa.string()), "score": pa.array(np.where(known, cos, 0.0)), "accepted": pa.array(near)}
                yield pa.record_batch({c: part.column(c) for c in part.schema.names} | new)

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = named.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema
    return named.mapInArrow(name, schema).toDF(*docs.columns, *names)
