"""Token ids in Arrow files: equal-length sequences with masks, open to zero-copy random access.

A file is an Arrow IPC file (the stream format plus a footer of batch positions) whose batches hold
``rows_per_batch`` rows of two fixed-size lists: ``ids`` (uint16 where the vocabulary fits, else
uint32) and ``mask`` (true where an id counts). All ids of a file's documents follow one another
through the rows; only the last row is padded. Because rows have one size, id ``k`` of a file stands
in row ``k // length`` at ``k % length`` and is reached without reading before it (``SequenceFile``).
Beside each ``.arrow`` file an ``.index.arrow`` file holds (doc_id, start, n_tokens) with starts
counted within the file; the manifest adds each file's place in the whole order.
"""

from __future__ import annotations

import contextlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import SPACES, coded, filesystem, open_write, shared_dir, slices, small_batches, word_table, words_of

#: Most words that a worker keeps encoded between batches.
CACHED_WORDS = 1_000_000

_cache: dict[tuple[str, bytes], bytes] = {}


def _kinds() -> np.ndarray:
    """ASCII letters and digits 1, ASCII punctuation but the apostrophe 2: the vocabulary's pattern
    always ends a piece where these meet, and its normaliser joins nothing there."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 2
    for a, b in ((48, 58), (65, 91), (97, 123)):
        kinds[a:b] = 1
    kinds[39] = 0
    return kinds


#: The normalisers and the pieces of the kind of vocabulary that ``encode_texts`` can take word by word.
NORMALISERS = ("NFC", "Replace", "Lowercase")
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rules = json.loads(tokenizer.to_str())
    normalisers = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
    split = next(iter((rules["pre_tokenizer"] or {}).get("pretokenizers", [])), {})
    if tuple(normalisers) != NORMALISERS or split.get("pattern") != {"Regex": PIECES} or not split.get("invert"):
        raise ValueError("texts are encoded word by word, which needs a vocabulary that folds case and drops white space")
    return tokenizer


def encode_texts(texts: pa.Array, tokenizer, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of all texts in a row, and how many come before each text.

    White space is dropped and letters are folded by this kind of vocabulary, so a text's ids are
    its words' ids in order; each distinct word of a batch goes through the tokenizer once.
    """
    words, before = words_of(texts, word_table(other_than=SPACES, fold=True), _kinds())
    codes, distinct = coded(words)
    names = distinct.to_pylist()
    new = [w for w in names if (path, w) not in _cache]
    if len(_cache) + len(new) > CACHED_WORDS:
        _cache.clear()
        new = names
    for k in range(0, len(new), 20_000):
        part = new[k : k + 20_000]
        for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
            _cache[path, w] = np.array(e.ids, np.uint32).tobytes()
    found = [_cache[path, w] for w in names]
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    flat = np.frombuffer(b"".join(found), np.uint32)
    first = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(first[codes] - (ends - each), each) + np.arange(total)
    return flat[place], np.append(0, ends)[before]


class SequenceWriter:
    """Cuts one stream of ids into rows of ``length`` and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows_per_batch: int):
        self.length, self.rows, self.dtype = length, rows_per_batch, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.left: list[np.ndarray] = []
        self.n = 0

    def write(self, ids: np.ndarray) -> None:
        self.left.append(ids.astype(self.dtype))
        self.n += len(ids)
        whole = self.length * self.rows
        if self.n >= whole:
            ids = np.concatenate(self.left)
            for k in range(0, len(ids) // whole * whole, whole):
                self._batch(ids[k : k + whole], whole)
            self.left = [ids[len(ids) // whole * whole :]]
            self.n = len(self.left[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate([*self.left, np.zeros(0, self.dtype)])
        if len(ids):
            self._batch(np.append(ids, np.zeros(-len(ids) % self.length, self.dtype)), len(ids))
        self.out.close()


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, length: int = 2048, rows_per_batch: int = 64, n_files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order; returns the manifest.

    Null and empty texts have only the end id. Null doc_ids come first; rows with one doc_id stand
    in the order of their texts' hashes, so repeated rows are all kept. An empty table writes no file.
    Other columns are not read. Manifest: file, n_docs, n_tokens, start (ids in all files before).
    Rows are dealt by range of doc_id, hash of text and, among equal rows, the input partition they come
    from, into ``n_files`` parts or as many as Spark finds fit; so one doc_id's rows fill as many files
    as they need. A task that runs again writes the same file under the same name.
    """
    small_batches(docs.sparkSession)
    vocab = _tokenizer(tokenizer_path).get_vocab_size()
    dtype = np.dtype(np.uint16 if max(vocab - 1, end_id) < 1 << 16 else np.uint32)
    out_dir = out_dir.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, writer, path, shard = _tokenizer(tokenizer_path), None, "", -1
        docs_in, counts = [], []
        with contextlib.ExitStack() as files:
            for batch in batches:
                for part in slices(batch, "text"):
                    if writer is None:
                        shard = part.column("shard")[0].as_py()
                        path = f"{out_dir}/part-{shard:06d}"
                        writer = SequenceWriter(files.enter_context(open_write(path + ".arrow")), dtype, length, rows_per_batch)
                    ids, before = encode_texts(part.column("text"), tokenizer, tokenizer_path)
                    writer.write(np.insert(ids, before[1:], end_id))
                    docs_in.append(part.column("doc_id"))
                    counts.append(np.diff(before) + 1)
            if writer is not None:
                writer.close()
        if writer is not None:
            n = np.concatenate(counts)
            index = pa.table({"doc_id": pa.chunked_array(docs_in).cast(pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
            with open_write(path + ".index.arrow") as sink, pa.ipc.new_file(sink, index.schema) as out:
                out.write_table(index, max_chunksize=1 << 16)
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "file": [path], "n_docs": [len(n)], "n_tokens": [int(n.sum())]})

    order = ("doc_id", "hash", "split")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("split"))
    ordered = keyed.repartitionByRange(*([n_files] if n_files else []), *order).select("doc_id", "text", F.spark_partition_id().alias("shard"), "hash", "split").sortWithinPartitions(*order).drop("hash", "split")
    files = sorted(ordered.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long").collect())  # a row for each file
    rows, start = [], 0
    for f in files:
        rows.append((f.file, f.n_docs, f.n_tokens, start))
        start += f.n_tokens
    return docs.sparkSession.createDataFrame(rows, "file string, n_docs long, n_tokens long, start long")


class SequenceFile:
    """Random access to a file's rows and ids. Where the file system is local the file is memory-mapped,
    and rows, and ids that one batch holds, are views of the map: no byte of them is copied. The mask is
    one bit an id, so it comes as an Arrow array, which reads bits in place."""

    def __init__(self, path: str):
        fs, at = filesystem(path + ".arrow")
        self.source = pa.memory_map(at) if isinstance(fs, LocalFileSystem) else fs.open_input_file(at)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.per = self.reader.get_batch(0).num_rows * self.length if self.reader.num_record_batches else 0
        self.last = -1, None, None

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids of a batch in a row, and their mask."""
        if self.last[0] != k:
            batch = self.reader.get_batch(k)
            self.last = k, batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
        return self.last[1:]

    def row(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Row ``k`` of all rows: its ids and its mask."""
        b, at = divmod(k * self.length, self.per)
        ids, mask = self.batch(b)
        return ids[at : at + self.length], mask.slice(at, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``: only the batches that hold them are opened."""
        found = [self.batch(b)[0][max(0, start - b * self.per) : start + n - b * self.per] for b in range(start // self.per, -(-(start + n) // self.per))]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def marked(self, start: int, n: int) -> int:
        """How many of these ids the mask marks."""
        return sum(self.batch(b)[1][max(0, start - b * self.per) : start + n - b * self.per].true_count for b in range(start // self.per, -(-(start + n) // self.per)))

    def close(self) -> None:
        self.last = -1, None, None
        self.source.close()


def read_tokens(path: str, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of one file."""
    return SequenceFile(path).tokens(start, n)


def read_token_files(manifest: DataFrame, files_per_task: int = 1) -> DataFrame:
    """Each document as its files hold it, by random access: doc_id, start, n_tokens, ids_crc32, file, masked.

    ``masked`` counts the document's ids that the mask marks; it equals n_tokens.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["file"] + ".index.arrow")
                body = SequenceFile(row["file"])
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, ns = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        places = list(zip(starts.tolist(), ns.tolist()))
                        crcs = [zlib.crc32(body.tokens(s, n).astype("<u4").tobytes()) for s, n in places]
                        masked = [body.marked(s, n) for s, n in places]
                        yield pa.record_batch({"doc_id": part.column("doc_id"), "start": pa.array(starts + row["start"]), "n_tokens": pa.array(ns), "ids_crc32": pa.array(crcs, pa.int64()), "file": pa.array([row["file"]] * len(ns)), "masked": pa.array(masked, pa.int64())})
                body.close()

    n = max(1, -(-manifest.count() // files_per_task))
    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, masked long")


def token_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read every document back from the files (see the two functions)."""
    return read_token_files(write_token_files(docs, out_dir or shared_dir(docs.sparkSession, "tokens"), tokenizer_path, **options))
