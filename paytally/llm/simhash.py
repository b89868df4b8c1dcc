"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint is the majority bit vector of the XXH64 hashes of its word shingles. Two
fingerprints link when they differ in at most ``budget`` bits. The 64 bits form a ring of
``budget + 1`` segments. If two fingerprints differ in at most ``budget`` bits, some segment starts
a chain in which the differences of its first l segments sum to at most ``l * budget / segments``,
for every l. The first segment of that chain is then equal in both, which gives the key of an
equi-grouping; the longer chains prune the pairs inside a group before the full Hamming check.

Scale: equal fingerprints count once. A key with more than ``group_rows`` fingerprints is refined
by the chain's second segment, in which one bit may differ (one masked copy per bit); what is still
larger is dealt out as pairs of tiles, so no task holds more than about ``group_rows`` fingerprints
of one key. A group returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import per_batch, saved, space_words, texts

BITS = 64
SEED = 42
_KEY = ["ring", "segment", "masked_bit", "masked_value", "tile_a", "tile_b"]
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIRS_AT_ONCE = 1 << 20


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The XXH64 hashes of all word shingles; that of all words together if they are no more than one holds."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bits set in over half of the shingle hashes; 0 for a text without words."""
    words = space_words(text)
    return int(majority(shingle_hashes(words, shingle))) if words else 0


def majority(hashes: np.ndarray) -> np.uint64:
    count = np.zeros(BITS, np.int64)
    # A byte holds the sums of 255 rows, so most of the adding is done on bytes.
    for start in range(0, len(hashes), 255 * 64):
        part = hashes[start : start + 255 * 64]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:
            sums = bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8)
            count += sums.sum(axis=0, dtype=np.int64)
        count += bits[whole:].sum(axis=0, dtype=np.int64)
    majority = (2 * count > len(hashes)).astype(np.uint8)
    return np.packbits(majority, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, bits): the fingerprint of every row as a signed 64-bit integer."""
    source = texts(docs, id_col, text=text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])

    def of(columns):
        prints = np.array([fingerprint(t, shingle) for t in columns["text"]], np.uint64)
        return {"doc_id": columns["doc_id"], "bits": prints.view(np.int64)}

    renamed = source.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return renamed.mapInArrow(per_batch(of, schema), "doc_id long, bits long")


def segments(budget: int) -> list[tuple[int, int]]:
    """(offset, width) of each of the ``budget + 1`` segments of the ring."""
    n = budget + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _slice(offset: int, width: int):
    return F.shiftrightunsigned("bits", offset).bitwiseAND(F.lit((1 << width) - 1))


def _grouped(prints: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """Fingerprints under every key of the first chain segment, large keys refined or tiled."""
    ring = segments(budget)
    first = prints.select(
        "bits",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("ring"), _slice(*s).alias("segment")) for i, s in enumerate(ring)])
        ).alias("key"),
    ).select("bits", "key.ring", "key.segment", F.lit(-1).alias("masked_bit"), F.lit(-1).cast("long").alias("masked_value"))
    plain, large = _split(first, _KEY[:2], group_rows)
    tiled = None
    if large is not None:
        large = large.drop("rows", "masked_bit", "masked_value")
        refined, dense = _split(large.withColumn("m", F.explode(_masked(ring))).select("bits", *_KEY[:2], "m.*"), _KEY[:4], group_rows)
        plain = plain.unionByName(refined)
        if dense is not None:
            tiles = F.ceil(F.col("rows") * 2 / group_rows)
            every = F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))
            both = dense.select("bits", *_KEY[:4], F.pmod(F.xxhash64("bits"), tiles).alias("own"), every.alias("other"))
            tiled = both.select(
                "bits", *_KEY[:4], F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b")
            )
    zero = F.lit(0).cast("long")
    whole = plain.select("bits", *_KEY[:4], zero.alias("tile_a"), zero.alias("tile_b"))
    return whole if tiled is None else whole.unionByName(tiled)


def _masked(ring: list[tuple[int, int]]):
    """Values of the chain's second segment with one bit cleared, for each bit: equal for prints one bit apart."""
    choice = None
    for i in range(len(ring)):
        offset, width = ring[(i + 1) % len(ring)]
        value = _slice(offset, width)
        masks = F.array(
            *[
                F.struct(F.lit(b).alias("masked_bit"), value.bitwiseAND(F.lit(~(1 << b))).alias("masked_value"))
                for b in range(width)
            ]
        )
        here = F.col("ring") == i
        choice = F.when(here, masks) if choice is None else choice.when(here, masks)
    return choice


def _split(rows: DataFrame, key: list[str], group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``group_rows`` rows, and the others with their count, if there are others."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows)
    sizes = saved(sizes, "large-keys")
    if sizes.isEmpty():
        return rows, None
    return rows.join(sizes, key, "left_anti"), rows.join(sizes, key)


def links_in_group(prints: np.ndarray, start: int, budget: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links that a chain from segment ``start`` admits."""
    chain = _chain(start, budget)
    n, found, total = len(prints), [], 0
    step = max(1, _PAIRS_AT_ONCE // n)
    for low in range(0, n, step):
        high = min(low + step, n)
        differing = prints[low:high, None] ^ prints[None, low:]
        rows, columns = np.nonzero(np.bitwise_count(differing & chain[0][0]) <= chain[0][1])
        later = columns > rows
        rows, columns = rows[later], columns[later]
        values = differing[rows, columns]
        keep = _passes(values, chain[1:])
        found.append((rows[keep] + low, columns[keep] + low))
        total += len(found[-1][0])
        if total > 8 * n + 1000:
            return _dense_forest(prints, chain)
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for rows, columns in found:
        for a, b in zip(rows.tolist(), columns.tolist()):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((a, b))
    return forest


def _chain(start: int, budget: int) -> list[tuple[np.uint64, int]]:
    """(mask of the first l segments from ``start``, differing bits allowed), for l from 2 on."""
    ring = segments(budget)
    n, mask, steps = len(ring), 0, []
    for length in range(1, n + 1):
        offset, width = ring[(start + length - 1) % n]
        mask |= ((1 << width) - 1) << offset
        if length > 1:
            steps.append((np.uint64(mask), length * budget // n))
    return steps


def _passes(values: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    keep = np.arange(len(values))
    for mask, most in chain:
        keep = keep[np.bitwise_count(values[keep] & mask) <= most]
    return keep


def _dense_forest(prints: np.ndarray, chain: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Breadth-first trees; each print meets only those that no tree holds yet."""
    rest, forest = np.arange(len(prints)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _passes(prints[rest] ^ prints[at], chain)
            if len(near):
                reached = rest[near]
                forest += [(int(at), int(x)) for x in reached]
                queue += reached.tolist()
                rest = np.delete(rest, near)
    return forest


def links(prints: DataFrame, budget: int = 4, group_rows: int = 8192) -> DataFrame:
    """(a, b) with a < b: for each group a forest of its links; together they join what is linked.

    ``prints`` has one row per distinct fingerprint.
    """

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            size = len(now["bits"])
            if not size:
                continue
            new = np.zeros(size, bool)
            for c in _KEY:
                new[1:] |= now[c][1:] != now[c][:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            yield _edges(now, starts[:-1], starts[1:])
            held = {c: now[c][starts[-1] :] for c in now}
        if held is not None:
            yield _edges(held, [0], [len(held["bits"])])

    def _edges(rows, starts, ends) -> pa.RecordBatch:
        out_a, out_b = [], []
        for start, end in zip(starts, ends):
            if end - start < 2:
                continue
            bits = rows["bits"][start:end]
            for a, b in links_in_group(bits.view(np.uint64), int(rows["ring"][start]), budget):
                low, high = sorted((int(bits[a]), int(bits[b])))
                out_a.append(low)
                out_b.append(high)
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=_EDGES)

    grouped = _grouped(prints, budget, group_rows)
    dealt = grouped.repartition(*[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has one.

    Large-star and small-star steps alternate until nothing changes. A hub's rows meet a single
    minimum, so its side of the join can be split. Each round is written to the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    budget: int = 4,
    group_rows: int = 8192,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): every row with the class of near copies it belongs to.

    ``component_id`` is the smallest id in the class. Null and wordless texts have fingerprint zero,
    which links like any other. Rows that repeat an id are each kept; a null id is kept and is never
    a class's smallest, so that a class of null ids alone has a null ``component_id``. An empty table
    gives no rows. Only the two named columns are read.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = saved(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("bits"), budget, group_rows)).withColumnRenamed("node", "bits")
    rooted = distinct.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("bits", "component_id")
    return prints.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
