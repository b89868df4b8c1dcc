"""Near copies by SimHash and pigeonring filtering, completed to exact similarity of word shingles.

A text is the set of the XXH64 hashes of its five-word shingles. Two texts link when the Jaccard
similarity of their sets is ``SIMILARITY`` or more. The operator ``simhash`` proposes first: texts of equal
fingerprints, and forests of the links its pigeonring filter finds within ``BUDGET`` bits; whole sets decide on each.
At 0.8 two fingerprints differ in about 10 of 64 bits, and segments for budgets that reach most such
pairs are 3 or 4 bits wide, which filters nothing. So prefix filtering finds the links between the classes
that are left: in any one order of all hashes, two such sets
share a hash among the first ``n - ceil(s * n) + 1`` of each, so grouping those prefixes by hash
proposes every such pair; sizes and places in the prefix drop most others, and the whole sets
decide. Nothing is left to chance.

Scale: only prefixes, a fifth of the hashes, are shuffled, and equal texts count once. Hashes that
are frequent in a sample come last in the order, rarer ones first, so prefixes seldom hold them;
the order changes the work, never the result. Groups with members in different
classes are covered by stars: the first in an order of
the round meets all that may be like it, the first of the others likewise, until none is left. Rounds go on until
one finds less than a twentieth of the first round's links; each joins the classes of the round before, so components
are sought among classes only. Last, only members that are in different classes even then meet each other, so a group of mutual copies costs its length, not its square. Before a pair is proposed, parities of its sets decide: each of ``BITS`` bits tells whether
an odd number of a set's hashes fall on it, so two sets differ in at least as many hashes as their
parities differ in bits, and pairs that differ in too many go. Texts are read again for proposed
pairs only. A task holds one group of one hash, of numbers only. What the stage wrote for
itself is deleted at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import ROWS_AT_ONCE, discard, saved, space_words
from paytally.llm.simhash import components, links, majority, shingle_hashes

SHINGLE = 5
#: Numerator and denominator of the least similarity.
SIMILARITY = (4, 5)
#: Bits in which fingerprints that propose a pair may differ.
BUDGET = 4
BITS = 512
_PARITY = [f"b{i}" for i in range(BITS // 64)]
_SAMPLE = 4000
_MOST_FREQUENT = 50_000
_PAIRS_AT_ONCE = 1 << 19


def text_key(text: str) -> Column:
    """A digest that names a text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _hashes(text: str | None) -> np.ndarray:
    return shingle_hashes(space_words(text), SHINGLE)


def tokens(text: str | None) -> np.ndarray:
    """The distinct shingle hashes, ascending; one for a text of few or no words."""
    return np.unique(_hashes(text).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set: those not in ``frequent`` ascending, then the others by ``rank``."""
    num, den = SIMILARITY
    length = len(found) - -(-len(found) * num // den) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        place = np.where(frequent[at] == found, rank[at], 0)
        found = found[np.argsort(place, kind="stable")]
    return found[:length]


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes fall on each of ``BITS`` bits, as 64-bit integers."""
    odd = np.bincount(found & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide_parity(found: np.ndarray) -> bytes:
    """A parity of about four bits a hash. Half of its length folded on the other is that of half the bits."""
    size = max(BITS, 1 << (4 * len(found) - 1).bit_length())
    return np.packbits((np.bincount(found & (size - 1), minlength=size) & 1).astype(np.uint8)).tobytes()


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, bits, other_n, other_bits) but those whose parities differ too much."""
    num, den = SIMILARITY
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        n = batch.column("n").to_numpy().astype(np.int64) + batch.column("other_n").to_numpy()
        for row in range(batch.num_rows):
            x, y = sorted((np.frombuffer(batch.column(c)[row].as_py(), np.uint64) for c in ("bits", "other_bits")), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep[row] = int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (num + den) <= n[row] * (den - num)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _near_enough(parities: np.ndarray, others: np.ndarray, n: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes (rows of parities) can be similar enough."""
    num, den = SIMILARITY
    apart = np.bitwise_count((parities ^ others).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return apart * (num + den) <= (n.astype(np.int64) + other_n) * (den - num)


def _sets(texts: DataFrame, name: str, kind: str, frequent=None) -> DataFrame:
    """(name, n, tokens) of rows (name, text): all hashes and their wide parity, or with ``frequent`` the prefix, and the parity and fingerprint of all."""
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])
    extra = [("bits", pa.binary())] if frequent is None else [(b, pa.int64()) for b in [*_PARITY, "print"]]
    schema = pa.schema([*schema, *extra])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                hashes = [_hashes(t) for t in part.column(1).to_pylist()]
                sets = [np.unique(h.view(np.int64)) for h in hashes]
                kept = sets if frequent is None else [prefix(s, *frequent) for s in sets]
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept), pa.int64()))
                columns = [part.column(0).cast(schema.field(0).type), pa.array([len(s) for s in sets], pa.int32()), lists]
                if frequent is None:
                    columns.append(pa.array(map(_wide_parity, sets), pa.binary()))
                else:
                    bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, len(_PARITY))
                    columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(_PARITY))]
                    columns.append(pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    more = ", bits binary" if frequent is None else "".join(f", {b} long" for b in [*_PARITY, "print"])
    return texts.select(name, "text").mapInArrow(of, f"{name} {kind}, n int, tokens array<long>{more}")


def _frequent(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several texts of a sample hold, ascending, and the rank of each from 1, rarest first."""
    nth = max(1, keyed.count() // _SAMPLE)
    sample = keyed.where(F.pmod(F.xxhash64("key"), F.lit(nth)) == 0).dropDuplicates(["key"])
    held = _sets(sample, "key", "string").select(F.explode("tokens").alias("token"))
    often = held.groupBy("token").count().where("count > 2")
    rows = often.orderBy(F.desc("count"), "token").limit(_MOST_FREQUENT).collect()
    hashes = np.array([r[0] for r in rows], np.int64)
    ascending = np.argsort(hashes)
    return hashes[ascending], (len(rows) - np.arange(len(rows)))[ascending]


def _can_link(n, place, other_n, other_place, least):
    """Whether sets whose first common hash has these places in them can be similar enough."""
    num, den = SIMILARITY
    return least(n - place, other_n - other_place) * (num + den) >= (n + other_n) * num


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one hash, of batches sorted by hash, if they are in different classes."""
    held = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        if not len(now["token"]):
            continue
        cuts = np.flatnonzero(now["token"][1:] != now["token"][:-1]) + 1
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, starts[1:]):
            if (now["label"][start:end] != now["label"][start]).any():
                yield {c: v[start:end] for c, v in now.items()}
        held = {c: v[starts[-1] :] for c, v in now.items()}
    if held is not None and (held["label"] != held["label"][0]).any():
        yield held


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups whose members are in different classes."""
    for group in _groups(batches):
        yield pa.RecordBatch.from_pydict({c: v for c, v in group.items() if c != "label"})


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows of one hash: each row once with the first that may be like it, if in different classes."""
    for group in _groups(batches):
        label, number = group["label"], group["number"]
        n, place = group["n"].astype(np.int64), group["pos"].astype(np.int64)
        bits = np.stack([group[b] for b in _PARITY], axis=1)
        left, a, b = np.arange(len(n)), [], []
        while len(left) > 1:
            first, others = left[0], left[1:]
            can = _can_link(n[others], place[others], n[first], place[first], np.minimum)
            at = np.flatnonzero(can)
            like = others[at]
            at = at[_near_enough(bits[like], np.broadcast_to(bits[first], bits[like].shape), n[like], n[first])]
            met = others[at]
            met = met[label[met] != label[first]]
            a.append(np.minimum(number[met], number[first]))
            b.append(np.maximum(number[met], number[first]))
            left = np.delete(others, at)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of all rows of one hash that are in different classes and can link."""
    for group in _groups(batches):
        yield from _pairs_of(group)


def _pairs_of(group: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    label, number = group["label"], group["number"]
    n, place = group["n"].astype(np.int64), group["pos"].astype(np.int64)
    bits = np.stack([group[b] for b in _PARITY], axis=1)
    step = max(1, _PAIRS_AT_ONCE // len(n))
    for low in range(0, len(n), step):
        here = slice(low, low + step)
        can = _can_link(n[here, None], place[here, None], n[None, low:], place[None, low:], np.minimum)
        rows, columns = np.nonzero(can & (label[here, None] != label[None, low:]))
        rows, columns = rows[columns > rows] + low, columns[columns > rows] + low
        near = _near_enough(bits[rows], bits[columns], n[rows], n[columns])
        rows, columns = rows[near], columns[near]
        if len(rows):
            a, b = number[rows], number[columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _verified(pairs: DataFrame, keyed: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    """The pairs whose whole sets are similar enough; only texts in pairs are read and hashed."""
    asked = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number"))).distinct()
    keys = numbered.select("number", "key").join(asked, "number", "left_semi")
    found = keyed.join(keys, "key").dropDuplicates(["number"])
    sets = saved(_sets(found, "number", "long"), "whole-sets")
    left = sets.select(F.col("number").alias("a"), "n", "bits")
    right = sets.select(F.col("number").alias("b"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"))
    pairs = pairs.join(left, "a").join(right, "b").mapInArrow(_unlike, "a long, b long")  # before whole sets move
    left = sets.select(F.col("number").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("number").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    num, den = SIMILARITY
    common = F.size(F.array_intersect("x", "y"))
    near = saved(both.where(common * (num + den) >= (F.size("x") + F.size("y")) * num).select("a", "b"), name)
    discard(sets)
    return near


def _print_pairs(numbered: DataFrame) -> DataFrame:
    """(a, b) of texts whose fingerprints are equal, each with the first, or linked by the pigeonring filter's forests."""
    prints = saved(numbered.groupBy("print").agg(F.min("number").alias("first")), "prints")
    same = numbered.join(prints, "print").where("number <> first").select(F.col("first").alias("a"), F.col("number").alias("b"))
    near = links(prints.select(F.col("print").alias("bits")), BUDGET)
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("print").alias(end), F.col("first").alias(f"first_{end}")), end)
    ends = F.col("first_a"), F.col("first_b")
    found = same.unionByName(near.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")))
    found = saved(found.distinct(), "print-pairs")
    discard(prints)
    return found


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): components are sought among the classes that these join."""
    for end in ("a", "b"):
        more = more.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    ends = more.select(*(F.coalesce(f"root_{end}", end).alias(end) for end in ("a", "b")))
    joined = components(ends.where("a <> b").distinct())
    moved = labels.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    single = joined.join(labels, "node", "left_anti")  # in no class before
    return saved(moved.unionByName(single), "labels")


def classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, class): of every distinct text, named by ``text_key``, the class of near copies it belongs to.

    A class is what links join. Texts without words are copies of each other; a text of up to five
    words is one shingle. The numbers that name classes may differ between runs, the classes not.
    """
    keyed = docs.select(text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    prefixes = _sets(keyed, "key", "string", _frequent(keyed))
    once = prefixes.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "tokens", *_PARITY, "print")))
    numbered = saved(once.withColumn("number", F.monotonically_increasing_id()), "prefixes")
    columns = ["token", "number", "n", "pos", *_PARITY]

    tried = _print_pairs(numbered)
    edges = _verified(tried, keyed, numbered, "print-links")
    labels = saved(components(edges), "labels")
    spent = [numbered, tried, edges, labels]

    def labelled(rows: DataFrame, order: Column | str) -> DataFrame:
        label = F.coalesce("root", "number").alias("label")
        rows = rows.join(labels, F.col("number") == F.col("node"), "left").select(*columns, label)
        return rows.repartition("token").sortWithinPartitions("token", order)

    hashes = numbered.select("number", "n", *_PARITY, F.posexplode("tokens").alias("pos", "token")).select(*columns)
    left = saved(labelled(hashes, "number").mapInArrow(_open, hashes.schema), "open-groups")
    spent.append(left)

    def joined(propose, name: str, order: Column | str) -> int:
        """Verify what is proposed and take in its links; how many there are."""
        nonlocal labels, tried
        found = labelled(left, order).mapInArrow(propose, "a long, b long").distinct()
        found = saved(found.join(tried, ["a", "b"], "left_anti"), f"{name}-pairs")
        more = _verified(found, keyed, numbered, f"{name}-links")
        tried = tried.unionByName(found)
        count = more.count()
        if count:
            labels = _merged(labels, more)
        spent.extend([found, more, labels])
        return count

    first = last = joined(_stars, "star", F.xxhash64("number", F.lit(0)))
    rounds = 1
    while last * 20 > first:
        last = joined(_stars, "star", F.xxhash64("number", F.lit(rounds)))
        rounds += 1
    joined(_pairs, "other", "number")
    named = numbered.select("key", "number").join(labels, F.col("number") == F.col("node"), "left")
    named = saved(named.select("key", F.coalesce("root", "number").alias("class")), "classes")
    discard(*spent)
    return named
