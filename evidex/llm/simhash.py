"""Near-duplicate documents: SimHash fingerprints linked through a covering code's anchors.

Two fingerprints of 64 bits that differ in at most 3 agree, up to one bit, in one of their halves.
In each half, 31 bits are read as a word of the Hamming code of length 31, whose code words are the
anchors: its covering radius is 1, so every fingerprint has a home anchor within one bit. Each
fingerprint is replicated to all anchors within the covering radius plus the threshold of the half,
2 bits: the home itself and 15 more, or the code word alone where the fingerprint is one. Whatever
is within the threshold of a fingerprint then stands at that one's home anchor, so comparing per
anchor, homes against replicas, finds every link. The 32nd bit of a half plays no part in anchors.

The syndrome of a word is the number of the bit in which it differs from its code word (0: none),
and the pairs of bits whose numbers give the syndrome by exclusive or lead to the other 15 anchors:
all of it is arithmetic in built-in functions. Equal fingerprints are one node, and different nodes
within 3 bits number at most 43,744 for any node, so links grow with the number of documents and
not with the square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import SPACES, cut, hot_join, slices, small_batches, text_bytes, word_table

LIMIT = 3
SHINGLE = 3


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The SimHash (uint64) of each text's word shingles; a text without words has 0."""
    import xxhash

    table = word_table(other_than=SPACES, fold=True)
    data, begins = text_bytes(texts)
    mapped = table[data]
    inside = mapped < 256
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = begins[:-1][begins[:-1] < len(data)]
    start[at] = inside[at]
    gap = np.zeros(len(data), bool)
    gap[1:] = ~inside[1:] & inside[:-1]
    gap[at] = False
    kept = inside | gap  # words, and one byte after each for the space that joins it to the next
    joined = np.where(inside, mapped, 32).astype(np.uint8)[kept].tobytes()
    place = np.cumsum(kept) - 1
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:] | start[1:]
    first, end = place[start], place[inside & last] + 1
    before = np.searchsorted(np.flatnonzero(start), begins)
    n = np.diff(before)
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    ends = np.cumsum(shingles)
    total = int(ends[-1]) if len(ends) else 0
    doc = np.repeat(np.arange(len(n)), shingles)
    head = before[:-1][doc] + np.arange(total) - (ends - shingles)[doc]
    tail = np.minimum(head + shingle, before[1:][doc]) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(first[head].tolist(), end[tail].tolist())), np.uint64, total)
    out = np.zeros(len(n), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    sums = np.zeros((len(n), 64), np.int64)
    for k in range(0, total, 1 << 16):
        h, d = hashes[k : k + (1 << 16)], doc[k : k + (1 << 16)]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.append(0, np.flatnonzero(np.diff(d)) + 1)
        sums[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    out = ((2 * sums > shingles[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, for every row; null text: no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                fp = fingerprints(part.column("text"), shingle).view(np.int64)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "fp": pa.array(fp)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text").mapInArrow(compute, "doc_id long, text_hash long, fp long")


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _half(which: int):
    return F.col("fp").bitwiseAND(F.lit((1 << 31) - 1)) if which == 0 else F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit((1 << 31) - 1))


def _syndrome(word):
    """Number (1 to 31) of the bit by which ``word`` misses its code word, or 0."""
    total = F.lit(0).cast("long")
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        total = total + F.bit_count(word.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)).cast("long") * (1 << j)
    return total


#: Pieces of the other half: with at most three differing bits there, one of four is equal.
PIECES = 4


def _pieces(which: int):
    """(piece, its bits) of a half as one number, for each piece."""
    word = _half(which)
    return F.array(*[F.shiftright(word, 8 * j).bitwiseAND(F.lit(255)) + 256 * j for j in range(PIECES)])


def anchors(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, replicas) of distinct ``fp``: rows (half, anchor, piece, fp).

    The half that differs least has one differing bit at most, so a home meets a replica at its anchor;
    the other half then has three at most, and an equal piece.
    """
    homes, replicas = [], []
    bit = lambda number: F.when(number == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), number - 1).cast("long"))
    for which in (0, 1):
        rows = nodes.select("fp", _half(which).alias("word")).withColumn("s", _syndrome(F.col("word")))
        home = F.col("word").bitwiseXOR(bit(F.col("s")))
        homes.append(rows.select(F.lit(which).alias("half"), home.alias("anchor"), F.explode(_pieces(1 - which)).alias("piece"), "fp"))
        near = F.when(F.col("s") == 0, F.array(home)).otherwise(
            F.concat(
                F.array(home),
                F.transform(
                    F.filter(F.sequence(F.lit(1).cast("long"), F.lit(31).cast("long")), lambda i: (i != F.col("s")) & (i < i.bitwiseXOR(F.col("s")))),
                    lambda i: F.col("word").bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(F.col("s")))),
                ),
            )
        )
        near_rows = rows.select(F.lit(which).alias("half"), F.explode(near).alias("anchor"), "fp")
        replicas.append(near_rows.select("half", "anchor", F.explode(_pieces(1 - which)).alias("piece"), "fp"))
    return homes[0].union(homes[1]), replicas[0].union(replicas[1])


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``limit`` or fewer differing bits (limit <= 3)."""
    if not 0 <= limit <= 3:
        raise ValueError("the anchors cover up to 3 differing bits")
    homes, replicas = anchors(nodes)
    pairs = homes.withColumnRenamed("fp", "a").hint("merge").join(replicas.withColumnRenamed("fp", "b"), ["half", "anchor", "piece"])
    return pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)).select("a", "b").distinct()


#: Parts that the rows of one key are dealt into where a key can be a large group's.
SALTS = 16


def salted_join(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one`` (a row for each key), a key's rows dealt by ``by`` over SALTS tasks.

    Like the other joins here, it is a merge join by a hint: Spark takes a table for as large as the files it
    was read from, however many rows a generator makes of each, and would send all of them to the driver.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [key, "salt"], how).drop("salt")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of ``pairs`` (a, b).

    Each round finds the smallest root of a root among a node and its neighbours, and hands it to
    the node and also to the node's own root, so whole trees hook onto smaller ones beside them: a
    path of 300,000 nodes, whatever its numbering, takes about 20 rounds. Rounds go on until nothing
    changes. What a round makes is written to the shared folder; the driver only sees whether rows
    changed.
    """
    both = cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a")))
    roots = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        jump = roots.filter("root <> node").select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        grand = salted_join(roots, jump, "root", "node", "left").select("node", "root", F.coalesce("beyond", "root").alias("grand"))
        seen = both.join(grand.select(F.col("node").alias("other"), F.col("grand").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        low = grand.join(seen, "node").select("node", F.col("root").alias("was"), F.least("grand", "theirs").alias("low"))
        own, hook = F.struct("node", "was", "low"), F.struct(F.col("was").alias("node"), F.lit(None).cast("long").alias("was"), "low")
        told = low.select(F.inline(F.array(own, hook)))
        moved = cut(told.groupBy("node").agg(F.min("low").alias("root"), F.max("was").alias("was")))
        if moved.filter(F.col("root") != F.col("was")).isEmpty():
            return moved.select("node", "root")
        roots = moved.select("node", "root")


def _classes(docs: DataFrame, shingle: int, limit: int) -> tuple[DataFrame, int]:
    """(doc_id, text_hash, fp, component_id, n_links, root) of every row, and the number of rows."""
    small_batches(docs.sparkSession)
    fps = cut(with_fingerprints(docs, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("size")))
    pairs = cut(links(nodes.select("fp"), limit))
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    joined = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").join(degree.hint("merge"), "fp", "left")
    joined = joined.select("fp", "size", "least_id", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = salted_join(joined, least, "root", "fp").select("fp", "size", "component_id", "n_links", "root")
    n = fps.count()
    return hot_join(fps, classes, ["fp"], n), n


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id, n_links.

    component_id is the smallest doc_id that links of ``limit`` or fewer bits reach, itself included;
    n_links counts the fingerprints linked to its own. Texts without words have fingerprint 0 and
    link like any other. Rows whose doc_id is null get a result too, but never name a component; one
    that reaches no doc_id has a null component_id. Repeated rows share a fingerprint and so a
    component. An empty table gives no rows; other columns are not read.
    """
    return _classes(docs, shingle, limit)[0].select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; same columns.

    A null doc_id counts as the largest; rows with one doc_id go by the hash of their texts, and of
    repeated rows one stays.
    """
    rows, n = _classes(docs, shingle, limit)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = rows.groupBy("root", order.alias("row")).agg(F.count("*").alias("size"))
    kept = cut(rows.groupBy("root").agg(F.min(F.struct("row", "size")).alias("first")).select("first.row.*", "first.size"))
    key = ["none", "id", "hash"]
    keys = kept.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"), "size")
    doc_id = F.col("doc_id").cast("long")
    named = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), _text_hash().alias("hash"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = hot_join(named, keys, key, n)
    if not kept.filter("size > 1").isEmpty():
        out = out.dropDuplicates(key)
    return out.drop(*key).toDF(*docs.columns)
