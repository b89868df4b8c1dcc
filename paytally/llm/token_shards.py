"""Token ids in fixed-width bit packing, with random access.

Documents are range-sorted by id, or by a column that orders them, and encoded; every id takes the least bits that hold the largest
id of the vocabulary. The files are Parquet rows of blocks: a block holds the packed ids of whole
documents (``block_ids`` ids or more, one document at least), its documents and where each ends,
and the position of its first id in its shard. A manifest holds each shard's first position among
all ids. So an id at a global position is one lookup of a shard, one of a block, and a shift.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paytally.llm.common import texts

BLOCK_IDS = 1 << 16
_BLOCK_SCHEMA = "shard int, first long, n_ids int, bits int, doc_ids array<long>, ends array<int>, packed binary"
_BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int32())),
        ("packed", pa.binary()),
    ]
)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit little-endian fields."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    out = []
    for start in range(0, len(ids), BLOCK_IDS):  # a multiple of 8, so parts end on whole bytes
        part = ids[start : start + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        fields = np.unpackbits(part, axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(fields, bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from the ``first`` one on, read at their bit offsets without decoding those before."""
    if count is None:
        count = len(packed) * 8 // bits - first
    if bits == 16:
        return np.frombuffer(packed, "<u2", count, first * 2).astype(np.uint32)
    at = (np.arange(count, dtype=np.int64) + first) * bits
    low = int(at[0]) >> 3 if count else 0
    data = np.frombuffer(packed, np.uint8)[low : ((first + count) * bits + 7) // 8]
    data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    byte = (at >> 3) - low
    value = data[byte].copy()
    for k in range(1, 5):
        value |= data[byte + k] << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


_encoders: dict[tuple, WordEncoder] = {}
# Between a letter and an ASCII sign other than an apostrophe the tokenizer always cuts.
_CUT = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, remembering the ids of words.

    With ``by_word``, for tokenizers that drop white space and never join over it, a text's ids are
    the ids of its words. Frequent words are encoded once per task process; the memory is emptied
    when it holds ``most_words`` words. Without it every text is encoded whole.
    """

    def __init__(self, path: str, by_word: bool = True, most_words: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.by_word = by_word
        self.most_words = most_words
        self.words: dict[bytes, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        one = self._whole("1")
        self.separator = int(np.frombuffer(one, "<u4")[0]) if len(one) == 4 else None

    @classmethod
    def shared(cls, path: str, by_word: bool) -> WordEncoder:
        """The process's encoder for a file: tasks that follow each other share its memory."""
        key = (path, by_word)
        if key not in _encoders:
            _encoders[key] = cls(path, by_word)
        return _encoders[key]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(text)
        words = _CUT.sub(b" ", text.encode().lower()).split()  # the tokenizer lowers A-Z as well
        if len(self.words) > self.most_words:
            self.words.clear()
        missing = set(words).difference(self.words)
        if missing:
            self._learn(missing)
        return b"".join(map(self.words.__getitem__, words))

    def _learn(self, missing: set[bytes]) -> None:
        # A digit is always a token of its own here, so words without a 1 pass in one call, 1s between them.
        plain = [w for w in missing if b"1" not in w] if self.separator is not None else []
        for start in range(0, len(plain), 256):
            some = plain[start : start + 256]
            ids = np.frombuffer(self._whole(b"1".join(some).decode()), "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) == len(some) - 1:
                begins, ends = [0, *(cuts * 4 + 4).tolist()], [*(cuts * 4).tolist(), len(ids) * 4]
                whole = ids.tobytes()
                self.words.update((w, whole[a:b]) for w, a, b in zip(some, begins, ends))
        for word in missing:
            if word not in self.words:
                self.words[word] = self._whole(word.decode())


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    by_word: bool = True,
    block_ids: int = BLOCK_IDS,
    order_col: str | None = None,
) -> None:
    """Encode every whole text, append ``end_id`` to each, and write blocks and manifest under ``path``.

    Ascending order of ``order_col``, if one is named, then of id, nulls first; rows that repeat an
    id each have their own ids, in the order of their texts. A null or empty text is its end id
    alone. An empty table writes no block.
    """
    order = [] if order_col is None else [F.col(order_col).alias("_order")]
    ordered = texts(docs, *order, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    by = ["_order", "doc_id"] if order else ["doc_id"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = WordEncoder.shared(tokenizer, by_word)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names, ends, size, first = [], [], 0, 0

        def block() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(ids), "<u4"), encoder.bits)
            row = [[shard], [first], [size], [encoder.bits], [names], [ends], [packed]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW
            )

        for batch in batches:
            for at in range(batch.num_rows):
                part = encoder.encode(batch.column(1)[at].as_py()) + end
                ids.append(part)
                size += len(part) // 4
                names.append(batch.column(0)[at].as_py())
                ends.append(size)
                if size >= block_ids:
                    yield block()
                    first += size
                    ids, names, ends, size = [], [], [], 0
        if names:
            yield block()

    blocks = ordered.mapInArrow(encode, _BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    _manifest(read_blocks(docs.sparkSession, path)).write.parquet(f"{path}/manifest")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")


def _manifest(blocks: DataFrame) -> DataFrame:
    """(shard, n_ids, start): one row per written partition, so the window below sees few rows."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, n_ids long, start long").parquet(f"{path}/manifest")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, computed from the unpacked files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["packed"], row["bits"], 0, row["n_ids"]).astype("<u4")
                begins = [0, *row["ends"][:-1]]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, row["ends"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(crcs), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["first"] + b for b in begins], pa.int64()),
                        pa.array([b - a for a, b in zip(begins, row["ends"])], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = read_blocks(spark, path).mapInArrow(
        digest, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    placed = rows.join(manifest(spark, path).select("shard", F.col("start").alias("_start")), "shard")
    return placed.select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from global position ``start`` on; reads only the blocks that hold them."""
    shards = sorted((r.start, r.n_ids, r.shard) for r in manifest(spark, path).collect())
    out, at = [], max(0, bisect.bisect_right([s[0] for s in shards], start) - 1)
    for shard_start, n_ids, shard in shards[at:]:
        if shard_start >= start + count:
            break
        low, high = max(start, shard_start) - shard_start, min(start + count, shard_start + n_ids) - shard_start
        here = read_blocks(spark, path).where(
            (F.col("shard") == shard) & (F.col("first") < high) & (F.col("first") + F.col("n_ids") > low)
        )
        for row in here.orderBy("first").select("first", "n_ids", "bits", "packed").toLocalIterator():
            a, b = max(low - row.first, 0), min(high - row.first, row.n_ids)
            out.append(unpack(row.packed, row.bits, a, b - a))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
