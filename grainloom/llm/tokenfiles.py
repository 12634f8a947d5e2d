"""Token ids in ORC files: the binary output that training jobs read.

One row holds one document: its key, its ids (the end id last), how many
ids come before it within its file (`at`) and the number of its file
(`part`). ORC stores the integers with run-length encoding, keeps
statistics for each stripe and each row group of ROW_GROUP rows, and a
Bloom filter of the keys for each row group, so a reader of a few
documents opens the row groups that may hold them only, and a reader of
everything takes stripes in parallel. Files are in ascending order of
keys, and of rows within a file. A second small table, one row a file,
says how many ids and documents the files before hold: `start`, a
document's place among all ids, is the file's offset plus `at`. So no task
sees more than its own range of keys, and a lost executor costs its files.

Rows are dealt out by key, then a hash of the text, then their place in
the input, so rows that repeat one key (even with one text) spread over
files too; they follow one another in that order. Defined cases: a null
text is the empty one (its only id is the end id); a null key comes
first; special tokens in a text are recognised as the tokenizer itself
does; an empty table gives files without rows; extra columns are ignored.
No text is cut short.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _CHUNK, _PRE, TreeBpe
from .common import slices, slim

#: The id behind each document.
END = 1
#: Rows of a row group of the index (and of its Bloom filter), bytes of a stripe, and share of keys that a Bloom filter passes wrongly.
ROW_GROUP, STRIPE, WRONG = 1000, 16 << 20, 0.01
#: Files' offsets are broadcast up to so many files (about 40 bytes each), and joined by shuffle beyond.
BROADCAST_FILES = 1_000_000
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000

#: Text that is cut into pre-tokens here: see bpe._PLAIN.
_TEXT = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*+")


class PackedBpe(TreeBpe):
    """Ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path, cache=REMEMBERED)
        self.packed: dict[str, bytes] = {}
        self.coded = [i.to_bytes(4, "little") for i in range(max(self.vocab.values()) + 1)]

    def word(self, w: str) -> bytes:
        """The ids of one pre-token in lower case, remembered if it is short."""
        if len(w) >= self.long:
            return b"".join([self.coded[self.vocab[t]] for t in self.slowly(w)])
        alike = w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet)
        out = b"".join([self.coded[t.id] for t in self.model.tokenize(alike)])
        if len(w) < 64:
            if len(self.packed) >= REMEMBERED:
                self.packed.clear()
            self.packed[w] = out
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids of a text: by pre-tokens where its characters are plain, otherwise as the tokenizer cuts it."""
        if not text:
            return b""
        if _TEXT.fullmatch(text) and "<|" not in text:
            known = self.packed
            return b"".join([known.get(w) or self.word(w) for w in _PRE.findall(text.lower())])
        return b"".join([self.coded[self.vocab[t]] for raw in _CHUNK.findall(text) for t in self.slowly(raw)])


_BUILT: dict[str, PackedBpe] = {}


def _tokenizer(path: str) -> PackedBpe:
    """One for each worker process."""
    if path not in _BUILT:
        _BUILT[path] = PackedBpe(path)
        slim()
    return _BUILT[path]


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Encodes the texts and writes them below path: the ids, and the offsets of their files."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("key", "h", "row").sortWithinPartitions("key", "h", "row").select("key", "text")
    ending = np.array([end], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = _tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for b in (s for batch in batches for s in slices(batch)):
            each = [bpe.ids(t) + ending for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) // 4 for x in each])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(each), "<i4"), pa.int32()))
            at = before + np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part), pa.int32()), pa.array(at, pa.int64()), ids], ["key", "part", "at", "ids"])
            before += int(ends[-1])
        slim()

    options = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": WRONG, "orc.row.index.stride": ROW_GROUP, "orc.stripe.size": STRIPE, "orc.compress": "ZSTD"}
    ordered.mapInArrow(run, f"key {kind}, part int, at bigint, ids array<int>").withColumnRenamed("key", key).write.options(**options).orc(f"{path}/ids")
    files = spark.read.orc(f"{path}/ids").groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids").cast("long")).alias("tokens"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    offsets = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")) for c in ("documents", "tokens")}
    files.withColumns(offsets).coalesce(1).write.orc(f"{path}/files")


def read(spark: SparkSession, path: str, keys: Sequence | None = None, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it) and ids of all documents, or of those with one of keys (row groups that can't hold them are skipped)."""
    rows, files = spark.read.orc(f"{path}/ids"), spark.read.orc(f"{path}/files").select("part", "tokens_before")
    if keys is not None:
        rows = rows.where(F.col(key).isin(list(keys)))
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    return rows.join(files, "part").select(key, (F.col("tokens_before") + F.col("at")).alias("start"), "ids")


def checksums(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of rows of read()."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    out = tokens.select(F.col(key).alias("key"), "start", "ids").mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("key", key)
