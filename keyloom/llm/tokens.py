"""Token ids in Parquet list columns.

``write_tokens`` range-sorts documents by id, encodes them, ends each with one id, and
writes files whose token column is dictionary-coded and whose id and count columns are
delta-coded (Parquet writer version 2), in row groups and pages of set sizes with page
indexes, so a reader can fetch counts without tokens, or tokens of an id range.
``read_tokens`` reads the files back with positions in the whole stream; ``read_range``
reads some columns of an id range, of which the row groups and pages outside the range
are skipped.

Defined results: texts that spell an added token (as ``<|endoftext|>``) get its id, as the
tokenizer gives it; a null text is an empty one (only the end id); null ids come first;
repeated rows and tied ids are all written, ordered by id, then by text digest; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir

#: Words whose ids a worker remembers; the table is emptied when it is full.
CACHE_WORDS = 1_000_000
FILES = "shard int, seq long, id long, n_tokens long, tokens array<int>"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE of whole texts, with the ids of each word looked up once.

    The vocabulary's pre-tokenizer always cuts before a space or line end that follows
    other than white space and precedes other than white space, and after such a line
    end. Texts in which all spaces and line ends are of this kind are cut there; others,
    and texts that spell one of the vocabulary's added tokens, go to the tokenizer whole.
    The tokenizer encodes each new word, many in one string.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.has_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.known: dict[str, bytes] = {}  # key -> ids
        # a token's name has one character for each of its bytes
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for name, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(name)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    @staticmethod
    def keys(text: str) -> list[str]:
        """NUL and the first word; then each word after a space, or after a line end with that line end."""
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]
        return out

    def learn(self, new: list[str], lead: str) -> None:
        """Encode the words of keys in strings of many, each after ``lead``, and tell their ids apart by their bytes."""
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            words = part if lead == " " else [k[1:] for k in part]
            data, at = self.whole(lead + lead.join(words)), 0
            ends = np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(data, "<u4")]), np.cumsum([1 + len(w.encode()) for w in words])) + 1
            for k, e in zip(part, ends.tolist()):
                self.known[k] = data[(at + (k[0] == "\0")) * 4 : e * 4]
                at = e

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get = self.known.get
        special = {n for n, t in enumerate(texts) if self.has_added(t)}
        cut = [[] if n in special else self.keys(t) for n, t in enumerate(texts)]
        found = [list(map(get, k)) for k in cut]
        holes = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {k[i] for k, at in zip(cut, holes) for i in at}
        after_space, after_end = [], []
        for k in new:
            word = k[1:] if k[:1] in ("\0", "\n") else k
            if word and not word[0].isspace() and not word[-1].isspace():
                (after_space if word is k else after_end).append(k)
        self.learn(after_space, " ")
        self.learn(after_end, "\n")
        for n, at in enumerate(holes):
            for i in at:
                found[n][i] = get(cut[n][i])
        for n, ids in enumerate(found):
            if n in special or None in ids:  # white space beside white space
                found[n] = [self.whole(texts[n])]
        return [b"".join(x) for x in found]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, row_group_bytes: int = 32 << 20, page_rows: int = 2000) -> None:
    """Write (shard, seq, id, n_tokens, tokens) files in ascending order of the id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seq, end = encoder(tokenizer_path), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [x + end for x in codes.encode([t or "" for t in part.column(2).to_pylist()])]
                counts = [len(x) // 4 for x in ids]
                offsets = [0]
                for n in counts:
                    offsets.append(offsets[-1] + n)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(range(seq, seq + len(ids)), pa.int64()), part.column(1), pa.array(counts, pa.int64()), lists], ["shard", "seq", "id", "n_tokens", "tokens"])
                seq += len(ids)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))
    rows = rows.select(F.spark_partition_id().alias("shard"), "id", "text")
    done = rows.mapInArrow(encode, FILES)
    writer = done.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
    for name in ("shard", "seq", "id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(out)


def read_range(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: tuple[str, ...] = ("id", "n_tokens", "tokens")) -> DataFrame:
    """Columns of the documents with ids from ``low`` to ``high``: only these columns and the pages that may hold such ids are read."""
    files = spark.read.schema(FILES).parquet(path)
    if low is not None:
        files = files.where(F.col("id") >= low)
    if high is not None:
        files = files.where(F.col("id") <= high)
    return files.select(*columns)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of the files; ``start`` counts all ids before a document.

    Starts need a running sum inside a shard only; the shards' own sums are a table with
    a row for each shard.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = lists.offsets.to_pylist()
            crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["shard", "seq", "id", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("sum"))
    sums = sums.select("shard", (F.sum("sum").over(Window.orderBy("shard")) - F.col("sum")).alias("before"))
    rows = files.mapInArrow(digest, "shard int, seq long, id long, n_tokens long, ids_crc32 long").join(sums, "shard")
    run = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(F.col("id").alias(id_col), (F.col("before") + F.sum("n_tokens").over(run) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    path = new_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, id_col, text_col, **params)
    return read_tokens(docs.sparkSession, path, id_col)
