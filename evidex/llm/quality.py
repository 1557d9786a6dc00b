"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets. Two multinomials over the
buckets are counted: one over all documents, one over the trusted documents among them. The trusted
one has the raw one as its prior, with ``PRIOR`` times the weight of the trusted text itself, so a
bucket's log ratio depends on shares only: a corpus twice over has the same ratios. A document's score
is the mean over its n-grams, which doesn't depend on its length either.

The threshold comes from the trusted documents: they are dealt into folds by doc_id, each is scored by
the trusted text of the other folds, as a document is that nobody has labelled, and at most
``QUANTILE`` of them may lie below the threshold. Every document is then scored by one table of weights
and held against that one number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import SPACES, coded, cut, pairs, slices, small_batches, text_bytes, without, word_table, words_of

BUCKETS = 1 << 18
#: Weight of the raw multinomial in the trusted one, in trusted n-grams for each trusted n-gram.
PRIOR = 0.3
#: Most of the trusted documents that may score below the threshold, as a share.
QUANTILE = 0.01
#: Parts of the trusted documents; each is scored by the others.
FOLDS = 4
#: Steps of the threshold for one unit of score.
STEPS = 1000
#: Repeated windows have so many words.
WINDOW = 5
#: Rules: fewest words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20

WORDS = word_table(other_than=SPACES)
LINES = word_table(other_than=b"\n")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(codes: np.ndarray, distinct: pa.Array, before: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and every pair of neighbours in a document."""
    mix = np.uint64(0xFF51AFD7ED558CCD)
    hashed = np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.uint64)
    words = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    both = doc[1:] == doc[:-1]
    two = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * mix)[both]
    grams = np.concatenate([words * mix, two]) >> np.uint64(40)
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][both]])


#: Buckets whose counts travel in one row.
CHUNK = 1024
#: Tasks that rows with one doc_id are dealt over when they meet the trusted ids.
SALTS = 4
#: Buckets of trusted ids that are sent to all tasks, to drop other documents before the shuffle.
ID_BUCKETS = 1 << 20


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size * 8, "zstd", asbytes=True), "<i8")


def trusted_texts(docs: DataFrame, trusted: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(text, fold) of the rows of ``docs`` whose doc_id ``trusted`` has, written to the shared folder.

    A row comes once however often ``trusted`` names it; null doc_ids are never trusted; rows with one
    doc_id are in one fold. Rows whose doc_id falls into a bucket without a trusted id are dropped where
    they are read; ``ID_BUCKETS`` numbers are all that this sends, and with many ids it drops fewer rows.
    The others meet the ids by a shuffle; rows with one doc_id are dealt over ``SALTS`` tasks by their text.
    """
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    ids = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_trusted")).filter("_trusted is not null").distinct()
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(ID_BUCKETS)).cast("int")
    held = cut(ids.select(bucket("_trusted").alias("_bucket")).distinct())
    ids = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("shuffle_hash")
    own = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    own = own.join(F.broadcast(held), bucket("doc_id") == F.col("_bucket"), "left_semi")
    own = own.join(ids, (F.col("doc_id") == F.col("_trusted")) & (salt == F.col("_salt")), "left_semi")
    return cut(own.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")), "zstd")


def count_grams(rows: DataFrame, groups: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams of ``rows`` (text, fold: 0 to groups - 1) by fold and bucket; the driver gets no more than that.

    Each task counts into one array and sends it in compressed rows of ``CHUNK`` buckets, which are
    added up where their number falls. Null texts count nothing.
    """
    size = min(CHUNK, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, buckets), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, before = words_of(part.column("text"), WORDS)
                grams, doc = features(*coded(words), before, buckets)
                fold = part.column("fold").to_numpy()[doc]
                sums += np.bincount(fold * buckets + grams, minlength=groups * buckets).reshape(groups, buckets)
        if sums.any():
            packed = [_pack(sums[:, k : k + size]) for k in range(0, buckets, size)]
            yield pa.record_batch({"chunk": pa.array(range(len(packed)), pa.int32()), "counts": pa.array(packed, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + _unpack(packed, groups * min(size, buckets - chunk * size))
        yield pa.record_batch({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([_pack(x) for x in sums.values()], pa.binary())})

    small_batches(rows.sparkSession)
    model = rows.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    sums = np.zeros((groups, buckets), np.int64)
    for chunk, packed in model.collect():  # buckets / CHUNK rows
        end = min(buckets, (chunk + 1) * size)
        sums[:, chunk * size : end] = _unpack(packed, groups * (end - chunk * size)).reshape(groups, -1)
    return sums


def weights_of(raw: np.ndarray, trust: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket; 0 where nothing is counted, and everywhere without trusted text."""
    if not trust.sum():
        return np.zeros(len(raw))
    p_raw = np.where(raw > 0, raw, 1) / max(1, raw.sum())
    return np.where(raw > 0, np.log((trust / trust.sum() + prior * p_raw) / ((1 + prior) * p_raw)), 0.0)


def ratios(grams: np.ndarray, doc: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The mean weight of each of ``n`` documents' n-grams; 0 for none."""
    return np.round(np.bincount(doc, weights=table[grams], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1), 9)


def threshold_of(own: DataFrame, tables: list[np.ndarray | None], quantile: float = QUANTILE) -> float:
    """The highest step that at most ``quantile`` of ``own`` (text, fold) lie below, each scored by its fold's table.

    Texts that fail the rule for fewest words don't count, nor do folds without a table. Without any
    text there is nothing to hold others against: minus infinity. The driver gets a count for each step.
    """
    sent = own.sparkSession.sparkContext.broadcast(tables)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, before = words_of(part.column("text"), WORDS)
                fold = part.column("fold").to_numpy()
                grams, doc = features(*coded(words), before, next(len(t) for t in sent.value if t is not None))
                at = np.zeros(len(part))
                for k, table in enumerate(sent.value):
                    if table is not None:
                        at = np.where(fold == k, ratios(grams, doc, len(part), table), at)
                counted = (np.diff(before) >= LEAST_WORDS) & np.array([t is not None for t in sent.value])[fold]
                yield pa.record_batch({"step": pa.array(np.floor(at[counted] * STEPS).astype(np.int64))})

    if all(t is None for t in tables):
        return float("-inf")
    counts = sorted(own.mapInArrow(place, "step long").groupBy("step").count().collect())
    below, best, total = 0, float("-inf"), sum(n for _, n in counts)
    for step, n in counts:
        if below <= quantile * total:
            best = step / STEPS
        below += n
    return best


def per_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[begins[1:]] - total[begins[:-1]]


def rule_counts(texts: pa.Array, words=None) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    data, begins = text_bytes(texts)
    words, before = words or words_of(texts, WORDS)
    codes, _ = coded(words)
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    out = {"n_words": n, "word_chars": per_text((WORDS[data] < 256) & (data & 0xC0 != 0x80), begins), "n_symbols": per_text(SYMBOLS[data], begins)}

    lines, line_before = words_of(texts, LINES)
    line_codes, line_texts = coded(lines)
    full = np.array([bool(x.strip(SPACES)) for x in line_texts.to_pylist()], bool)
    line_doc = np.repeat(np.arange(len(n)), np.diff(line_before))
    key = pairs(line_doc, line_codes)
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    again = earlier & full[line_codes] if len(key) else earlier
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=len(n))

    covered = np.zeros(len(codes) + 1, np.int64)
    if len(codes) >= WINDOW:
        two = pairs(codes[:-1], codes[1:])
        four = pairs(two[:-2], two[2:])
        five = pairs(four[:-1], codes[4:])  # words i to i + 4
        at = np.flatnonzero(doc[: len(five)] == doc[4:])
        key = pairs(doc[at], five[at])
        at = at[np.bincount(key)[key] > 1] if len(key) else at
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-1]) > 0, before)
    return out


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """``docs`` with the counts, base_failed, ratio (double; 0 without words) and kept.

    Null and empty texts have no words, so they fail the rules. Columns with the names of results are
    replaced; other columns pass; repeated rows each get their result.
    """
    small_batches(docs.sparkSession)
    names = (*COUNTS, "base_failed", "ratio", "kept")
    docs = without(docs, *names)
    text = f"c{docs.columns.index('text')}"
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                words, before = words_of(part.column(text), WORDS)
                counts = rule_counts(part.column(text), (words, before))
                ratio = ratios(*features(*coded(words), before, len(table)), len(part), table)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                columns = {c: part.column(c) for c in part.schema.names} | {k: pa.array(counts[k].astype(np.int64)) for k in COUNTS}
                yield pa.record_batch(columns | {"base_failed": pa.array(failed), "ratio": pa.array(ratio), "kept": pa.array(~failed & (ratio >= threshold))})

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = {k: F.lit(0).cast("long") for k in COUNTS} | {"base_failed": F.lit(True), "ratio": F.lit(0.0), "kept": F.lit(True)}
    return named.mapInArrow(score, named.withColumns(more).schema).toDF(*docs.columns, *names)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, quantile: float = QUANTILE, folds: int = FOLDS) -> tuple[np.ndarray, float]:
    """(weights, threshold) from all of ``docs`` and from ``trusted`` (doc_id)."""
    raw = count_grams(docs.select("text", F.lit(0).alias("fold")), 1, buckets)[0]
    own = trusted_texts(docs, trusted, folds)
    trust = count_grams(own, folds, buckets)
    others = [trust.sum(axis=0) - trust[k] for k in range(folds)]
    threshold = threshold_of(own, [weights_of(raw, o, prior) if o.any() else None for o in others], quantile)
    return weights_of(raw, trust.sum(axis=0), prior), threshold


def quality(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """Fit the weights and the threshold on ``docs`` and ``trusted`` (doc_id), then score every document.

    Without trusted documents every ratio is 0 and the counted rules alone decide.
    """
    return score_documents(docs, *fit(docs, trusted, **options))
