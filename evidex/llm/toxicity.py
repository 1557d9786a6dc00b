"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first 3, 4, 5 and 6
characters, so inflected and compound forms share most of theirs. Filters of several widths slide
over the words; each filter's highest value in the text (zero at least) is its feature, and a
logistic layer turns features into the score. The first embedding number starts from how much more
often the bucket occurs in toxic texts; all weights are then trained by Adagrad.

The model is fitted on all labelled rows, whole texts. They are dealt by a hash into shards of about
``SHARD_ROWS``; each shard trains a network from the same start in a task, and the weights are then
averaged by their rows, an embedding over the shards that moved it. A judge so made learns from three
folds of four and scores the fourth, which it didn't see: that sets the thresholds by language and, as a
mean of networks is too cautious, the scale of its scores. The network itself learns from all folds.
Every document is scored, over its whole text.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evidex.llm.common import coded, cut, slices, small_batches, without, word_table, words_of

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that one task trains on at a time.
SHARD_ROWS = 5000
#: Pieces that the embeddings are averaged in, and passes over each shard where there are several.
PIECES, SHARD_EPOCHS = 64, 2
#: Texts whose words are counted at a time.
COUNTED = 500
#: Digits of the log odds that thresholds are chosen among, so that a language has a bounded number of them.
DIGITS = 2
BATCH, RATE = 32, 0.05
#: Most bits of the filter that rows pass before they meet their labels.
ID_BITS = 1 << 27
#: Passes over the rows of a single shard: as many as show the network so many texts, within these bounds.
SHOWN, LEAST_EPOCHS, MOST_EPOCHS = 15_000, 3, 40

#: Words hold ASCII letters (folded) and digits, and all characters beyond ASCII.
WORDS = word_table(word=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), fold=True)


def word_features(distinct: pa.Array) -> np.ndarray:
    """Buckets of each word and of its first characters; a row for each word."""
    if not len(distinct):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64)
    words = distinct.cast(pa.large_string())
    columns = [np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.int64)]
    for k in PREFIXES:
        starts = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        crc = np.array([zlib.crc32(w.encode(), k) for w in starts.dictionary.to_pylist()], np.int64)
        columns.append(crc[starts.indices.to_numpy()])
    return np.stack(columns, axis=1) % BUCKETS


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each distinct word, the texts' words as numbers with pads after each text, begins).

    The number of distinct words stands for a pad; each text has as many pads as the widest filter
    less one reaches, so no window joins two texts.
    """
    words, before = words_of(texts, WORDS)
    codes, distinct = coded(words)
    features = word_features(distinct)
    pad = max(WIDTHS) - 1
    n = len(before) - 1
    begins = before + pad * np.arange(n + 1)
    out = np.full(int(begins[-1]), len(features), np.int64)
    out[np.arange(len(codes)) + pad * np.repeat(np.arange(n), np.diff(before))] = codes
    return features, out, begins


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.01, (BUCKETS, DIMS)).astype(np.float32)
        self.conv = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:  # each filter begins by looking for what the first number shows
            c[:, 0, :] = np.abs(c[:, 0, :]) + 0.2
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.head = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.offset = np.float32(-1.0)

    def seed_embeddings(self, features: np.ndarray, codes: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> None:
        """First numbers: z-scores of the log odds of buckets in toxic and other texts, by texts that hold them."""
        counts = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        for k in range(0, len(labels), COUNTED):  # a few texts at a time, as each word has several buckets
            at = begins[k : k + COUNTED + 1]
            own = codes[at[0] : at[-1]]
            real = own < len(features)
            doc, word = np.divmod(np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at))[real] * len(features) + own[real]), max(1, len(features)))
            doc, bucket = np.divmod(np.unique((doc[:, None] * BUCKETS + features[word]).ravel()), BUCKETS)
            for y in (0, 1):
                counts[y] += np.bincount(bucket[labels[k + doc] == y], minlength=BUCKETS)
        sizes = [max(1, int((labels == y).sum())) for y in (0, 1)]
        prior = (counts[0] + counts[1] + 1) / (sum(sizes) + 2)
        odds = np.log((counts[1] + 4 * prior) / (sizes[1] + 4)) - np.log((counts[0] + 4 * prior) / (sizes[0] + 4))
        z = odds / np.sqrt(1 / (counts[1] + 4 * prior) + 1 / (counts[0] + 4 * prior))
        self.embed[:, 0] += np.clip(z, -2, 6).astype(np.float32) / 4

    def words(self, features: np.ndarray) -> np.ndarray:
        """The embedding of each distinct word, and zeros for the pad."""
        return np.vstack([self.embed[features].sum(axis=1, dtype=np.float32), np.zeros((1, DIMS), np.float32)])

    def maps(self, words: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """Each width's filter values at each position; minus infinity at pads."""
        out = []
        for c, b in zip(self.conv, self.bias):
            y = np.full((len(codes), FILTERS), b, np.float32)
            for j in range(len(c)):
                y[: len(codes) - j] += (words @ c[j])[codes[j:]]
            y[codes == len(words) - 1] = -np.inf
            out.append(y)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        features, codes, begins = padded(texts)
        if not len(codes):
            return np.zeros(len(texts))
        words = self.words(features)
        top = np.hstack([np.maximum.reduceat(y, begins[:-1], axis=0) for y in self.maps(words, codes)])
        z = np.maximum(top, 0) @ self.head + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def fit(self, texts: pa.Array, labels: np.ndarray, seed: int = 7, epochs: int | None = None, sums: dict | None = None) -> None:
        """``sums`` are those of another fit that this one goes on from; its seeds stay."""
        epochs = epochs or min(MOST_EPOCHS, max(LEAST_EPOCHS, SHOWN // max(1, len(labels))))
        features, codes, begins = padded(texts)
        if not len(labels) or not len(codes):
            return
        if not sums:
            self.seed_embeddings(features, codes, begins, labels)
        sums = {} if sums is None else sums

        def step(key, at, param, grad) -> None:
            total = sums.setdefault(key, np.full(param.shape, 0.01, np.float32))
            if at is None:
                total += grad * grad
                param -= RATE * grad / np.sqrt(total)
            else:  # rows at ``at``, which are distinct
                total[at] += grad * grad
                param[at] -= RATE * grad / np.sqrt(total[at])

        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                docs = order[k : k + BATCH]
                own = np.concatenate([codes[begins[d] : begins[d + 1]] for d in docs])
                ends = np.cumsum(begins[docs + 1] - begins[docs])
                used, local = np.unique(own, return_inverse=True)
                pad = used == len(features)
                feats = features[np.where(pad, 0, used)] if len(features) else np.zeros((len(used), 5), np.int64)
                words = self.embed[feats].sum(axis=1, dtype=np.float32)
                words[pad] = 0
                padded_words = np.vstack([words, np.zeros((1, DIMS), np.float32)])
                numbers = np.where(pad[local], len(words), local)
                maps = self.maps(padded_words, numbers)
                heads = np.append(0, ends[:-1])
                where = [np.stack([y[a:b].argmax(axis=0) + a for a, b in zip(heads, ends)]) for y in maps]
                top = np.hstack([np.take_along_axis(y, p, axis=0) for y, p in zip(maps, where)])
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-(act @ self.head + self.offset)))
                d = ((p - labels[docs]) / len(docs)).astype(np.float32)
                back = d[:, None] * self.head * (top > 0)
                step("head", None, self.head, act.T @ d)
                total = sums.setdefault("offset", np.float32(0.01)) + d.sum() ** 2
                sums["offset"] = total
                self.offset -= np.float32(RATE * d.sum() / np.sqrt(total))
                grad_words = np.zeros_like(padded_words)
                for i, (c, b, at) in enumerate(zip(self.conv, self.bias, where)):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    grad = np.zeros_like(c)
                    for j in range(len(c)):
                        rows = numbers[np.minimum(at + j, len(numbers) - 1)]
                        grad[j] = np.einsum("bfd,bf->df", padded_words[rows], g)
                        np.add.at(grad_words, rows, g[:, :, None] * c[j].T[None])
                    step(f"bias{i}", None, b, g.sum(axis=0))
                    step(f"conv{i}", None, c, grad)
                moved = np.flatnonzero(np.abs(grad_words[:-1]).sum(axis=1) * ~pad)
                if len(moved):
                    rows, inverse = np.unique(feats[moved].ravel(), return_inverse=True)
                    grad = np.zeros((len(rows), DIMS), np.float32)
                    np.add.at(grad, inverse, np.repeat(grad_words[moved], feats.shape[1], axis=0))
                    step("embed", rows, self.embed, grad)


def best_thresholds(scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, times: np.ndarray | None = None) -> dict[str, float]:
    """For each language the threshold with the best F1; midway between scores, near 0.5 among equals.

    ``times`` tells how many rows each score stands for.
    """
    times = np.ones(len(scores), np.int64) if times is None else times
    out = {}
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        s, y, n = scores[own], labels[own], times[own]
        cuts = np.unique(s)
        tries = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
        tries = tries[np.argsort(np.abs(tries - 0.5), kind="stable")]
        order = np.argsort(s, kind="stable")
        first = np.searchsorted(s[order], tries)
        above = lambda m: (m.sum() - np.append(0, np.cumsum(m[order])))[first]
        f1 = 2 * above(n * (y == 1)) / np.maximum(1, above(n) + int(n[y == 1].sum()))
        out[lang] = float(tries[np.argmax(np.round(f1, 12))])
    return out


def calibration(odds: np.ndarray, labels: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of log odds under which ``labels`` are likeliest, by Newton's steps; a weak prior holds 1 and 0."""
    x, w, y = np.column_stack([odds, np.ones(len(odds))]), np.array([1.0, 0.0]), labels.astype(float)
    loss = lambda w: float((times * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + ((w - [1, 0]) ** 2).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (times * (p - y)) + (w - [1, 0])
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _pieces(net: Network, start: Network, rows: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(number, weights times rows, rows that moved them) of the pieces of a network; the last has all but embeddings."""
    moved = (net.embed != start.embed).any(axis=1) * np.float64(rows)
    for i, (new, m) in enumerate(zip(np.split(net.embed, PIECES), np.split(moved, PIECES))):
        yield i, np.where(m[:, None] > 0, new, 0).astype(np.float32).tobytes(), np.where(m > 0, rows, 0).astype(np.int64).tobytes()
    rest = np.concatenate([*[c.ravel() for c in net.conv], *net.bias, net.head, [net.offset]]).astype(np.float32)
    yield PIECES, rest.tobytes(), np.array([rows], np.int64).tobytes()


def _assembled(pieces: dict[int, bytes]) -> Network:
    net = Network()
    for i, own in enumerate(np.split(net.embed, PIECES)):
        made = np.frombuffer(pieces[i], np.float32).reshape(own.shape)
        own[:] = np.where(np.isnan(made), own, made)  # rows that no shard moved
    rest, at = np.frombuffer(pieces[PIECES], np.float32), 0
    for w in (*net.conv, *net.bias, net.head):
        w[:] = rest[at : at + w.size].reshape(w.shape)
        at += w.size
    net.offset = np.float32(rest[at])
    return net


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (judge, piece) of rows in that order: the mean of weights by their rows, held one piece at a time."""
    slot, total, rows = None, None, None

    def made() -> pa.RecordBatch:
        mean = np.divide(total, rows[:, None], out=np.full_like(total, np.nan), where=rows[:, None] > 0).astype(np.float32)
        return pa.record_batch({"judge": [slot[0]], "piece": pa.array([slot[1]], pa.int64()), "weights": pa.array([mean.tobytes()], pa.binary())})

    for batch in batches:
        for judge, piece, weights, n in zip(*(batch.column(c).to_pylist() for c in ("judge", "piece", "weights", "n"))):
            n = np.frombuffer(n, np.int64)
            w = np.frombuffer(weights, np.float32).reshape(len(n), -1).astype(np.float64)
            if slot != (judge, piece):
                if slot is not None:
                    yield made()
                slot, total, rows = (judge, piece), np.zeros_like(w), np.zeros(len(n), np.int64)
            total += w * n[:, None]
            rows += n
    if slot is not None:
        yield made()


def may_be_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is one of the distinct ``ids`` (id), and a few others, picked where they are read.

    Sixteen bits or so for each id, set by hash, go to all tasks, ``ID_BITS`` (16 MB) at most; beyond that
    more of the other rows pass. Ids of types whose hashes don't agree all pass.
    """
    ours, theirs = docs.schema["doc_id"].dataType, ids.schema["id"].dataType
    whole = all(isinstance(t, IntegralType) for t in (ours, theirs))
    if ours != theirs and not whole:
        return docs
    n = min(ID_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long") if whole else F.col(c)), F.lit(n)) + 1
    held = ids.select(slot("id").alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    at = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("_slot", slot("doc_id")).join(F.broadcast(cut(held)), F.bitmap_bucket_number("_slot") == F.col("_part"))
    return met.filter(F.getbit(byte, at % 8) == 1).select(*docs.columns)


def fit_classifier(docs: DataFrame, labels: DataFrame, most_toxic: int | None = None, most_clean: int | None = None, most_chars: int | None = None) -> bytes:
    """A fitted network and thresholds, pickled. ``labels`` (doc_id, toxic) are the ones to learn from.

    Null ids, labels and texts are left out; of several labels of one document the highest counts. All other
    rows are learnt from, whole, unless the caller sets bounds: ``most_toxic`` and ``most_clean`` rows by the
    hashes of doc_id and text, texts up to ``most_chars`` characters. Without a toxic and a clean label there
    is nothing to learn, and every score is the untrained network's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang")).filter("text is not null")
    if most_chars is not None:
        rows = rows.filter(F.length("text") <= most_chars)

    known = cut(known)
    rows = may_be_among(rows, known)

    def labelled(rows: DataFrame) -> DataFrame:
        found = rows.join(known.hint("merge"), F.col("doc_id") == F.col("id")).select("doc_id", "text", "lang", F.col("toxic").cast("long").alias("toxic"))
        for test, most in (("toxic = 1", most_toxic), ("toxic <> 1", most_clean)):
            if most is not None:
                first = found.filter(test).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(most)
                found = cut(first.union(found.filter(f"not ({test})")))
        return found

    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(4)) == 0
    shards = max(1, -(-known.count() // SHARD_ROWS))
    dealt = labelled(rows).withColumns({"fold": fold, "shard": F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))})
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("text"), "lang")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, n = [], None, 0
        for batch in batches:
            at = batch.column("shard").to_numpy()
            a = 0
            while a < len(at):
                if held and (at[a] != shard or n == SHARD_ROWS):
                    yield from trained(pa.Table.from_batches(held))
                    held, n = [], 0
                shard = at[a]
                b = min(int(np.searchsorted(at, shard, side="right")), a + SHARD_ROWS - n)
                held.append(batch.slice(a, b - a))
                a, n = b, n + b - a
        if held:
            yield from trained(pa.Table.from_batches(held))

    def trained(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, toxic = table.column("text").combine_chunks(), (table.column("toxic").to_numpy() == 1).astype(np.int64)
        fold = table.column("fold").to_numpy()
        start = Network()
        net, sums = Network(), {}
        for judge in (True, False):
            if shards == 1:
                net, own, epochs = Network(), ~(fold & judge), None
            else:  # the network goes on from the judge, with the fold that this one didn't see
                own, epochs = fold ^ judge, SHARD_EPOCHS
            if own.any():
                net.fit(texts.filter(pa.array(own)), toxic[own], epochs=epochs, sums=sums if shards > 1 else None)
            if own.any() or shards > 1:
                for piece, weights, n in _pieces(net, start, int((~(fold & judge)).sum())):
                    yield pa.record_batch({"judge": [judge], "piece": pa.array([piece], pa.int64()), "weights": pa.array([weights], pa.binary()), "n": pa.array([n], pa.binary())})

    parts = dealt.mapInArrow(fit, "judge boolean, piece long, weights binary, n binary")
    means = parts.repartition("judge", "piece").sortWithinPartitions("judge", "piece").mapInArrow(_averaged, "judge boolean, piece long, weights binary").collect()  # two networks
    nets = {}
    for judge in (False, True):
        own = {r.piece: bytes(r.weights) for r in means if r.judge == judge}
        nets[judge] = _assembled(own) if own else Network()
    thresholds = {}
    if any(r.judge for r in means):
        judged = score_toxicity(labelled(rows.filter(fold)), pickle.dumps((nets[True], {})))
        odds = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("score")))
        seen = judged.groupBy("lang", F.round(F.ln(odds / (1 - odds)), DIGITS).alias("odds"), (F.col("toxic") == 1).cast("long").alias("toxic")).agg(F.count("*").alias("n")).collect()  # some thousand rows for each language at most
        if seen:
            odds, toxic, langs, n = (np.array([r[c] for r in seen], kind) for c, kind in (("odds", float), ("toxic", np.int64), ("lang", object), ("n", np.int64)))
            scale, shift = calibration(odds, toxic, n) if shards > 1 else (1.0, 0.0)
            net = nets[False]
            net.head, net.offset = np.float32(scale) * net.head, np.float32(scale * net.offset + shift)
            thresholds = best_thresholds(1 / (1 + np.exp(-(scale * odds + shift))), toxic, langs, n)
    return pickle.dumps((nets[False], thresholds))


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with score (double, 0 to 1), predicted (int, score >= 0.5), lang_threshold and flagged.

    flagged compares the score with the threshold of the row's lang (0.5 where there is none or it
    wasn't fitted). Null and empty texts have the score of a text without features. Columns with the
    names of results are replaced; repeated rows each get their result.
    """
    small_batches(docs.sparkSession)
    names = ("score", "predicted", "lang_threshold", "flagged")
    docs = without(docs, *names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = f"c{docs.columns.index('text')}"
    lang = f"c{docs.columns.index('lang')}" if "lang" in docs.columns else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, thresholds = pickle.loads(sent.value)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                s = np.round(net.scores(part.column(text)), 9)
                t = np.array([thresholds.get(x or "", 0.5) for x in part.column(lang).to_pylist()]) if lang else np.full(len(part), 0.5)
                new = {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32)), "lang_threshold": pa.array(t), "flagged": pa.array(s >= t)}
                yield pa.record_batch({c: part.column(c) for c in part.schema.names} | new)

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = named.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "lang_threshold": F.lit(0.0), "flagged": F.lit(True)}).schema
    return named.mapInArrow(score, schema).toDF(*docs.columns, *names)
