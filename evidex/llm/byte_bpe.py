"""Byte-level BPE by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and gathers them in blocks. A block is one row: the rows'
   other columns, the pre-tokens of each text by their position as numbers into the block's list of
   distinct words, and that list, dealt into parts by a hash of the word. Blocks are written once, in
   buckets of their number.
2. The parts are shuffled by that hash. Wherever a word came from, it meets its equals in one
   partition, where it is encoded once; its ids go back into each part in the part's own order.
3. The parts return to their block, and the numbers are replaced by ids position by position. As the
   written blocks are bucketed, only the parts move.

Decoding looks each id up in the token-byte table, which has the vocabulary's size.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evidex.llm.common import filesystem, shared_dir, small_batches, without

#: Bytes of text in a block, about; a longer text is a block by itself.
BLOCK_BYTES = 16 << 20
#: Most parts that words are dealt into by hash, and so most tasks of step 2.
WORD_PARTS = 2048
#: Most words that a task keeps encoded in step 2.
CACHED_WORDS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a rank file."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


#: Words that are replaced by their ids at a time.
_PIECE = 1 << 18

_BLOCK = "block string, carried binary, codes binary, counts binary, parts array<binary>"
_PART = "block string, part int, words binary"


def _make_blocks(named: DataFrame, text: str, carry: list[str], pattern: str, parts: int) -> DataFrame:
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        held: list[pa.RecordBatch] = []
        numbers: dict[str, int] = {}
        codes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            carried = table[0] if table else held[0]
            words = [w.encode("utf-8", "surrogatepass") for w in numbers]
            part = np.array([zlib.crc32(w) % parts for w in words], np.int64)
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat = np.concatenate([*codes, np.zeros(0, np.uint32)])
            flat = rank[flat].astype("<u4") if len(flat) else flat.astype("<u4")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            lists = [_words_blob([words[k] for k in order[a:b].tolist()]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()  # byte by byte they pack better
            counts = np.array([len(c) for c in codes], "<u4").tobytes()
            row = {"block": [uuid.uuid4().hex], "carried": [_pack(carried)], "codes": [pa.compress(planes, "zstd", asbytes=True)], "counts": [counts], "parts": [lists]}
            return pa.record_batch([pa.array(row["block"]), pa.array(row["carried"], pa.binary()), pa.array(row["codes"], pa.binary()), pa.array(row["counts"], pa.binary()), pa.array(row["parts"], pa.list_(pa.binary()))], ["block", "carried", "codes", "counts", "parts"])

        for batch in batches:
            texts, begin = batch.column(text), 0
            for i in range(len(batch)):
                t = texts[i].as_py() or ""
                toks = split(t)
                codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in toks), np.uint32, len(toks)))
                size += len(t)
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(begin, i + 1 - begin).select(carry))
                    begin = i + 1
                    yield flush()
                    held, numbers, codes, size = [], {}, [], 0
            if begin < len(batch):
                held.append(batch.slice(begin).select(carry))
        if held:
            yield flush()

    return named.select(text, *carry).mapInArrow(cut_up, _BLOCK)


def _words_blob(words: list[bytes]) -> bytes:
    """Distinct words: how many, their sizes, their bytes."""
    sizes = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return sizes + b"".join(words)


def _words_from(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(blob, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    begins = np.append(4 * (n + 1), ends[:-1])
    return [blob[a:b] for a, b in zip(begins.tolist(), ends.tolist())]


def _encode_parts(parts: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for block, part, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = _words_from(blob)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > CACHED_WORDS:
                    known.clear()
                    new = words
                for w in new:
                    known[w] = np.array(one(w.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                found = [known[w] for w in words]
                sizes = np.array([len(x) // 4 for x in found], "<u4")
                body = np.frombuffer(b"".join(found), "<u4")
                packed = pa.compress(np.ascontiguousarray(np.concatenate([sizes, body]).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)
                yield pa.record_batch([pa.array([block]), pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([packed], pa.binary())], ["block", "part", "n_words", "n_ids", "ids"])

    return parts.mapInArrow(encode, "block string, part int, n_words long, n_ids long, ids binary")


def _numbers(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, n * 4, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def _assemble(block: pa.Table, parts: pa.Table, schema: pa.Schema) -> pa.Table:
    if not len(block):
        return schema.empty_table()
    row = block.slice(0, 1).to_pylist()[0]
    carried = _unpack(row["carried"])
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    total = int(counts.sum())
    codes = _numbers(row["codes"], total) if total else np.zeros(0, "<u4")
    sizes, bodies = [], []
    for p in sorted(parts.to_pylist(), key=lambda p: p["part"]):
        if p["n_words"]:
            both = _numbers(p["ids"], p["n_words"] + p["n_ids"])
            sizes.append(both[: p["n_words"]])
            bodies.append(both[p["n_words"] :])
    size = np.concatenate([*sizes, np.zeros(0, "<u4")]).astype(np.int32)
    body = np.concatenate([*bodies, np.zeros(0, "<u4")]).astype(np.int32)
    first = (np.cumsum(size) - size).astype(np.int32)
    ends = np.append(0, np.cumsum(size[codes], dtype=np.int64))
    ids = np.empty(int(ends[-1]), np.int32)
    for k in range(0, total, _PIECE):  # piece by piece, as the places of all ids would take many times their room
        some = codes[k : k + _PIECE]
        a, b = int(ends[k]), int(ends[k + len(some)])
        ids[a:b] = body[np.repeat(first[some] - (ends[k : k + len(some)] - a), size[some]) + np.arange(b - a)]
    offsets = ends[np.append(0, np.cumsum(counts))].astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
    return carried.append_column("ids", column).cast(schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all but text unless given) of ``docs`` and ids (array<int>) of each text.

    Each match of ``pattern`` is encoded separately by the ranks, without special tokens. Null and
    empty texts have no ids. Repeated rows each get theirs; an ``ids`` column of ``docs`` is replaced;
    an empty table gives no rows. Words of any number of documents are encoded where their hash
    falls, so a word that all documents hold costs one entry for each block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "ids")
    keep = tuple(c for c in docs.columns if c != "text") if keep is None else keep
    columns = [f"c{docs.columns.index(k)}" for k in keep]
    text = f"c{docs.columns.index('text')}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    carry = columns or [text]

    path = shared_dir(spark, "bpe_blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")  # common.scratch drops the table with its folder
    n_parts = min(n, WORD_PARTS)
    blocks = _make_blocks(named, text, carry, pattern, n_parts)
    blocks.write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    parts = blocks.select("block", F.posexplode("parts").alias("part", "words")).filter(F.length("words") > 4)  # more than a count of 0
    encoded = _encode_parts(parts.repartition(n_parts, "part"), ranks_path, pattern).repartition(n, "block")

    out = named.select(*carry).withColumn("ids", F.lit(None).cast("array<int>")).schema
    arrow = to_arrow_schema(out)

    def join(block: pa.Table, own: pa.Table) -> pa.Table:
        return _assemble(block, own, arrow)

    joined = blocks.select("block", "carried", "codes", "counts").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(join, out)
    return joined.select(*[F.col(c).alias(k) for c, k in zip(columns, keep)], "ids")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with decoded (binary): the bytes of its ids (array<int>) by the token-byte table.

    Null ids decode to no bytes; an id that the table lacks is an error.
    """
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    sent = encoded.sparkSession.sparkContext.broadcast(table)
    encoded = without(encoded, "decoded")
    named = encoded.toDF(*[f"c{i}" for i in range(len(encoded.columns))])
    ids = f"c{encoded.columns.index('ids')}"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.__getitem__
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                decoded = [b"".join(map(token, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in part.column(ids)]
                yield pa.record_batch([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    schema = named.withColumn("decoded", F.lit(None).cast("binary")).schema
    return named.mapInArrow(look_up, schema).toDF(*encoded.columns, "decoded")
