"""Collocated phrases by counting Apriori-safe candidates with double-array tries.

Words are counted first; words of at least ``least`` occurrences get consecutive numbers, and the texts
become arrays of these numbers, 0 between pieces and for rarer words, in the shared folder. Candidates grow by one
word at a time: neighbours whose words are frequent, then neighbours whose pairs are frequent; counts
are summed per task before the shuffle. Candidates are sorted, numbered and cut into blocks of at
most ``BLOCK_PHRASES``; each block's trie is a double array over the bytes of the word numbers,
built by one task and read by the scanning tasks block by block. A scan holds the states of all positions
of a chunk in one array and advances them together, byte level by byte level; positions without a
transition leave. Accepting states are counted with bincount, and the tasks' counts are summed.

Blocks are ranges of the first word, so a position takes part in one block (two at a border), however
many blocks there are. Nothing that grows with the corpus passes the driver or is held whole by a task.

A null text is empty and a null language is ``und``. Repeated rows count each time. A text of
any length is read whole; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paytally.llm.common import saved
from paytally.session import shared_dir

BLOCK_WORDS = 1_000_000
BLOCK_PHRASES = 150_000
_FLUSH_WORDS = 250_000
_FLUSH_KEYS = 1_000_000
_CHUNK_WORDS = 250_000
_SCAN_WORDS = 1_500_000
_SALTS = 32
_BREAK = 0xFF  # in no UTF-8 text
_PIECES = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_MARK = bytes([_BREAK])
_COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64())])
_KEY_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
_CODES = pa.schema([("codes", pa.binary())])


def split(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a mark between pieces."""
    return (text or "").encode().lower().translate(_PIECES).replace(_MARK, b" \xff ").split()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column(0)[row].as_py(), split(batch.column(1)[row].as_py())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ``<lang>\\t<word>``; with an empty word, of all words of the language."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        keys, values = [], []
        for lang, words in counts.items():
            words.pop(_MARK, None)
            keys += [f"{lang}\t{word.decode()}" for word in words] + [f"{lang}\t"]
            values += [*words.values(), sum(words.values())]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], schema=_COUNTS)

    for lang, words in _texts(batches):
        counts[lang].update(words)
        if sum(map(len, counts.values())) >= _FLUSH_WORDS:
            yield flush()
    yield flush()


def _numbered(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """Rows with consecutive numbers from 1 on, in the order of their partitions, and how many rows there are."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = saved(df.select("*", part.alias("_part"), place.alias("_place")), name)
    sizes = rows.groupBy("_part").count().orderBy("_part").collect()  # a row per partition
    before, total = [], 0
    for size in sizes:
        before.append((size["_part"], total + 1))
        total += size["count"]
    first = df.sparkSession.createDataFrame(before, "_part int, _first long")
    number = (F.col("_first") + F.col("_place")).alias(column)
    return rows.join(F.broadcast(first), "_part").select(*df.columns, number), total


def _read(path: str) -> pa.Table:
    """A folder of Parquet files in the shared folder, read by a task."""
    store, inside = fs.FileSystem.from_uri(path)
    return pq.read_table(inside, filesystem=store, partitioning=None, use_threads=False)


def _encoded(path: str, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to arrays of word numbers. A chunk's distinct words are looked up in the dictionary block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(1)
        seen: dict[str, dict[bytes, int]] = {}
        chunk: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal numbers, held
            prefixed = [(lang.encode() + b"\t", words) for lang, words in seen.items()]
            keys = pa.array([prefix + w for prefix, words in prefixed for w in words], pa.binary())
            local = np.array([n for _, words in prefixed for n in words.values()], np.int64)
            code = np.zeros(len(local) + 1, np.int32)
            for block in range(blocks):
                table = _read(f"{path}/block={block}")
                at = pc.index_in(keys, value_set=table["key"].cast(pa.binary()).combine_chunks())
                found = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                code[local[found]] = table["id"].to_numpy()[at.take(pa.array(found)).to_numpy()]
            out = code[np.concatenate(chunk)] if chunk else np.zeros(0, np.int32)
            numbers, held = count(1), 0
            seen.clear()
            chunk.clear()
            del keys, local, code
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], schema=_CODES)

        for lang, words in _texts(batches):
            if lang not in seen:
                seen[lang] = defaultdict(numbers.__next__)
            codes = np.fromiter(map(seen[lang].__getitem__, words), np.int32, len(words))
            chunk.append(np.append(codes, np.int32(0)))  # a break after each text; the mark has no number either
            held += len(words)
            if held >= _CHUNK_WORDS or sum(map(len, seen.values())) >= _FLUSH_WORDS:
                yield flush()
        yield flush()

    return run


class Trie:
    """A double array over bytes: the child of a state by a byte is the slot ``base[state] + byte``, if ``check`` there names the state."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray, width: int):
        self.base, self.check, self.value, self.width = base, check, value, width

    @classmethod
    def build(cls, phrases: np.ndarray, width: int) -> Trie:
        """``phrases``: rows of word numbers, 0 after their last word. ``value`` is the row at its accepting state."""
        n, most = phrases.shape
        here = np.zeros(n, np.int64)  # node of each phrase so far; 0 is the root
        parents, labels, nodes = [], [], 1
        for word in range(most):
            alive = np.flatnonzero(phrases[:, word] > 0)
            for byte in reversed(range(width)):
                label = (phrases[alive, word] >> (8 * byte)) & 255
                keys, inverse = np.unique(here[alive] * 256 + label, return_inverse=True)
                parents.append(keys >> 8)
                labels.append(keys & 255)
                here[alive] = nodes + inverse
                nodes += len(keys)
        parent, label = np.concatenate([[0], *parents]), np.concatenate([[0], *labels])
        base = cls._placed(parent[1:], label[1:], nodes)
        slot = base[parent] + label
        slot[0] = 0
        size = int(max(slot.max(), base.max())) + 257
        out = [np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)]
        out[0][slot] = base
        out[1][slot[1:]] = slot[parent[1:]]
        out[2][slot[here]] = np.arange(n)
        return cls(*out, width)

    @staticmethod
    def _placed(parent: np.ndarray, label: np.ndarray, nodes: int) -> np.ndarray:
        """A base for each node with children such that no two children share a slot; wide nodes first."""
        base = np.zeros(nodes, np.int64)
        order = np.argsort(parent, kind="stable")
        parent, label = parent[order], label[order]
        owners, first, width = np.unique(parent, return_index=True, return_counts=True)
        size = 2 * nodes + 512
        used = np.zeros(size + 256, bool)
        draw = np.random.default_rng(0)
        left = np.argsort(-width, kind="stable")
        for wide in np.unique(width)[::-1]:
            some = left[width[left] == wide]
            for _ in range(60):
                if not len(some):
                    break
                at = draw.integers(1, size, len(some))
                slots = at[:, None] + label[first[some][:, None] + np.arange(wide)]
                free = ~used[slots].any(axis=1)
                tried = slots[free]
                _, back, times = np.unique(tried, return_inverse=True, return_counts=True)
                alone = (times[back.reshape(tried.shape)] == 1).all(axis=1)  # not wanted by another node of this round
                if not alone.any() and len(tried):
                    alone[0] = True
                ok = np.flatnonzero(free)[alone]
                used[slots[ok].ravel()] = True
                base[owners[some[ok]]] = at[ok]
                some = np.delete(some, ok)
            for node in some:  # no room found: at the end
                base[owners[node]] = len(used)
                used = np.concatenate([used, np.zeros(256, bool)])
                used[base[owners[node]] + label[first[node] : first[node] + wide]] = True
        return base

    def advance(self, codes: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each word: the positions that still have a state, and the phrases accepted there (-1: none).

        ``codes`` ends with ``words`` zeros, so that no position reads beyond it.
        """
        state = np.zeros(len(at), np.int32)
        for word in range(words):
            code = codes[at + word]
            for byte in reversed(range(self.width)):
                after = self.base[state] + ((code >> (8 * byte)) & 255)
                ok = np.flatnonzero(self.check[after] == state)
                at, state, code = at[ok], after[ok], code[ok]
            yield at, self.value[state]


def _tries(phrases: DataFrame, total: int, width: int, block_phrases: int) -> tuple[str, list]:
    """Tries of the phrases (``id`` from 1 on in the order of c1, c2, c3) in the shared folder, and each one's range."""
    spark = phrases.sparkSession

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        trie = Trie.build(block[["c1", "c2", "c3"]].to_numpy(np.int64), width)
        arrays = [x.tobytes() for x in (trie.base, trie.check, trie.value)]
        row = [int(block["block"].iloc[0]), int(block["c1"].min()), int(block["c1"].max()), int(block["id"].min()), *arrays]
        return pd.DataFrame([row], columns=["block", "low", "high", "first", "base", "check", "value"])

    blocks = phrases.withColumn("block", ((F.col("id") - 1) / block_phrases).cast("long"))
    built = blocks.groupBy("block").applyInPandas(
        build, "block long, low long, high long, first long, base binary, check binary, value binary"
    )
    path = shared_dir(spark, "tries")
    built.write.partitionBy("block").parquet(path)
    if not total:
        return path, []
    return path, spark.read.parquet(path).select("block", "low", "high", "first").orderBy("block").collect()


_loaded: dict[str, Trie] = {}


def _trie(path: str, block: int, width: int) -> Trie:
    """A block's trie; the one used last stays with the process."""
    name = f"{path}/block={block}"
    if name not in _loaded:
        _loaded.clear()
        row = _read(name).select(["base", "check", "value"])
        _loaded[name] = Trie(*(np.frombuffer(row[c][0].as_buffer(), np.int32) for c in row.column_names), width)
    return _loaded[name]


def _accepted(codes: np.ndarray, path: str, blocks: list, width: int, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per word and block: word, positions, numbers of the accepted phrases."""
    for block in blocks:
        at = np.flatnonzero((codes >= block["low"]) & (codes <= block["high"]))
        if len(at):
            trie = _trie(path, block["block"], width)
            for word, (where, value) in enumerate(trie.advance(codes, at, words)):
                hit = value >= 0
                yield word, where[hit], value[hit], block["first"]


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    """Chunks with zeros at their end, several together, so that a trie is loaded once for many positions."""
    held, end = [], np.zeros(words, np.int32)
    for batch in batches:
        for row in range(batch.num_rows):
            held += [np.frombuffer(batch.column(0)[row].as_py(), np.int32), end]
            if sum(map(len, held)) >= _SCAN_WORDS:
                codes = np.concatenate(held)
                held.clear()
                yield codes
    yield np.concatenate([*held, end])


def _summed(keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of keys, summed over as many as are held at once."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], schema=_KEY_COUNTS)

    for some in keys:
        held.append(some)
        size += len(some)
        if size >= _FLUSH_KEYS:
            yield flush()
            size = 0
    yield flush()


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def keys() -> Iterator[np.ndarray]:
        for codes in _chunks(batches, 1):
            at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            yield (codes[at].astype(np.int64) << 32) | codes[at + 1]

    return _summed(keys())


def _triple_keys(path: str, blocks: list, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring frequent pairs, as two pair numbers in a key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for codes in _chunks(batches, 2):
            pair = np.zeros(len(codes), np.int64)
            for word, where, value, first in _accepted(codes, path, blocks, width, 2):
                if word == 1:
                    pair[where] = value + first
            at = np.flatnonzero((pair[:-1] > 0) & (pair[1:] > 0))
            yield (pair[at] << 32) | pair[at + 1]

    return lambda batches: _summed(keys(batches))


def _phrase_counts(path: str, blocks: list, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _chunks(batches, 3):
            counts: dict[int, np.ndarray] = {}
            for _, _, value, first in _accepted(codes, path, blocks, width, 3):
                n = np.bincount(value)
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there + first, pa.int64()), pa.array(n[there], pa.int64())], schema=_KEY_COUNTS
                )

    return keys


def _written(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks in the shared folder, in small row groups: a reading task holds its split's rows at once."""
    path = shared_dir(chunks.sparkSession, name)
    chunks.write.option("parquet.block.size", 4 << 20).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def _frequent(found: DataFrame, least: int) -> DataFrame:
    # The tasks have summed already: dealing the rows first spares them a second, nearly useless map.
    return found.repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exactly: products are decimals, the division is integral."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    scaled = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled, (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def mine(
    docs: DataFrame, least: int = 10, covered_percent: int = 50, top: int = 2000, block_phrases: int = BLOCK_PHRASES,
    block_words: int = BLOCK_WORDS, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Each language's ``top`` phrases of two or three words by how far their parts go together.

    ``a`` counts a phrase of at least ``least`` occurrences, ``l`` and ``r`` its two parts at the cut with the lowest score, ``n``
    the language's words. A phrase inside a longer one with ``covered_percent`` of its count is left out.
    """
    rows = _rows(docs, text_col, lang_col)
    counted = rows.mapInArrow(_word_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = saved(counted.where((F.col("n") >= least) | F.col("key").endswith("\t")), "words")
    words, n_words = _numbered(counted.where(~F.col("key").endswith("\t")), "id", "words")
    width = max(1, (n_words.bit_length() + 7) // 8)
    blocks = -(-n_words // block_words)
    dictionary = shared_dir(docs.sparkSession, "dictionary")
    numbered = words.select("key", F.col("id").cast("int").alias("id"), ((F.col("id") - 1) / block_words).cast("int").alias("block"))
    numbered.write.partitionBy("block").parquet(dictionary)
    codes = _written(rows.mapInArrow(_encoded(dictionary, blocks), "codes binary"), "codes")

    pairs = saved(_frequent(codes.mapInArrow(_pair_keys, "key long, n long"), least).select("key"), "pairs")
    low = F.lit((1 << 32) - 1)
    pair = (F.shiftright("key", 32).alias("c1"), F.col("key").bitwiseAND(low).alias("c2"))
    pairs = pairs.select(*pair, F.lit(0).cast("long").alias("c3"))
    pairs, n_pairs = _numbered(pairs.repartitionByRange("c1", "c2").sortWithinPartitions("c1", "c2"), "id", "pairs")
    path, ranges = _tries(pairs, n_pairs, width, block_phrases)

    triples = _frequent(codes.mapInArrow(_triple_keys(path, ranges, width), "key long, n long"), least)
    triples = saved(triples.select(F.shiftright("key", 32).alias("head"), F.col("key").bitwiseAND(low).alias("tail")), "triples")
    head = pairs.select(F.col("id").alias("head"), "c1", "c2")
    tail = pairs.select(F.col("id").alias("tail"), F.col("c2").alias("c3"))
    triples = triples.join(head, "head").join(tail, "tail").select("c1", "c2", "c3")
    phrases = saved(pairs.select("c1", "c2", "c3").unionByName(triples), "phrases")
    phrases = phrases.repartitionByRange("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3")
    phrases, n_phrases = _numbered(phrases, "id", "phrases")
    path, ranges = _tries(phrases, n_phrases, width, block_phrases)
    found = codes.mapInArrow(_phrase_counts(path, ranges, width), "key long, n long")
    found = found.groupBy("key").agg(F.sum("n").alias("a"))
    phrases = saved(phrases.join(found, phrases["id"] == found["key"]).select("c1", "c2", "c3", "a"), "phrase-counts")
    return _ranked(phrases, words, counted.where(F.col("key").endswith("\t")), covered_percent, top)


def _ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, covered_percent: int, top: int) -> DataFrame:
    one = words.select("id", "n", F.substring_index("key", "\t", -1).alias("word"), "key")
    word = lambda k: one.select(F.col("id").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("word").alias(f"w{k}"))
    lang = F.expr("substring(key, 1, length(key) - length(word) - 1)").alias("lang")
    first = one.select(F.col("id").alias("c1"), F.col("n").alias("n1"), F.col("word").alias("w1"), lang)
    two, three = phrases.where("c3 = 0").drop("c3"), phrases.where("c3 > 0")

    longest = three.select(F.inline(F.array(F.struct("c1", "c2", "a"), F.struct(F.col("c2").alias("c1"), F.col("c3").alias("c2"), "a"))))
    longest = longest.groupBy("c1", "c2").agg(F.max("a").alias("within"))
    kept = two.join(longest, ["c1", "c2"], "left").where(
        F.col("within").isNull() | (100 * F.col("within").cast("decimal(20,0)") < covered_percent * F.col("a").cast("decimal(20,0)"))
    )
    kept = kept.join(first, "c1").join(word(2), "c2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"),
        _score(F.col("a"), F.col("n1"), F.col("n2")).alias("score"),
    )
    heads = two.select("c1", "c2", F.col("a").alias("n12"))
    tails = two.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("a").alias("n23"))
    cut = three.join(heads, ["c1", "c2"]).join(tails, ["c2", "c3"]).join(first, "c1").join(word(2), "c2").join(word(3), "c3")
    cuts = F.array(*(
        F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
        for k, x, y in ((1, "n1", "n23"), (2, "n12", "n3"))
    ))
    cut = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    best = kept.unionByName(cut).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # a task that ranks a whole language reads the best of each salt only
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    total = totals.select(F.expr("substring(key, 1, length(key) - 1)").alias("lang"), "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
