"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items, as word sequences, go into one automaton for each block of items. A document's words
stream through each once; the state always stands for the longest suffix read so far that occurs in
some item. A match of ``span`` words or more means that a window of an item ends here. An item of
fewer words is one window of its own length.

Scale: the items are dealt to blocks of about ``block_words`` words, at most the words of one item more.
A task builds a block's automaton and writes it to the shared folder as flat arrays; the driver sees
neither items nor automata. A scanning task holds one block at a time and loads the next for a
whole batch of documents. The documents are never shuffled and pass through Python once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally.llm.common import _TO_WORDS, ROWS_AT_ONCE, alnum_words
from paytally.session import shared_dir

SPAN = 10
#: Words of a block of items. A task that holds a block needs about half a kilobyte a word.
BLOCK_WORDS = 250_000
#: Columns that marked documents get: merged spans [first, end, first, end, ...], named items, words.
HITS, ITEMS, WORDS = "_hit_spans", "_hit_items", "_n_words"
_MARKS = T.StructType(
    [
        T.StructField(HITS, T.ArrayType(T.LongType())),
        T.StructField(ITEMS, T.ArrayType(T.StringType())),
        T.StructField(WORDS, T.LongType()),
    ]
)
#: The flat arrays of an automaton. Lists per state lie one after another; ``*_first`` tells where each begins.
_ARRAYS = {"moves": np.int64, "to": np.int32, "link": np.int32, "length": np.int32, "window": np.int32,
           "short_from": np.int32, "item_first": np.int32, "item": np.int32, "short_first": np.int32,
           "short": np.int32, "short_size": np.int32}
_FLAT = "vocabulary array<binary>, names array<string>, " + ", ".join(f"{name} binary" for name in _ARRAYS)


class Builder:
    """Generalised suffix automaton over words, with the items whose windows end in a state.

    A null name stands for items without one: their windows are windows, but name nothing.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], span: int = SPAN):
        self.span = span
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for word in ids:
                    last = self._extend(last, word)
        self.window = self._window_states()
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in coded:
            self._place(name, ids)
        self.short_from = self._nearest_short()

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            exact = self.length[to] == self.length[at] + 1
            self.link[new] = to if exact else self._clone(at, word, to)
        else:
            self.link[new] = 0
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, of: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[of]))
        self.link[clone] = self.link[of]
        self.link[of] = clone
        while at >= 0 and self.next[at].get(word) == of:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.length)), key=self.length.__getitem__)

    def _window_states(self) -> list[int]:
        """For each state of ``span`` words or more, the suffix state that holds exactly ``span`` words."""
        window = [-1] * len(self.length)
        for s in self._by_length():
            if self.length[s] >= self.span:
                up = self.link[s]
                window[s] = window[up] if self.length[up] >= self.span else s
        return window

    def _place(self, name: str | None, ids: list[int]) -> None:
        at = 0
        for n, word in enumerate(ids, 1):
            at = self.next[at][word]
            if n >= self.span:
                self.items.setdefault(self.window[at], set()).add(name)
        if len(ids) < self.span:
            self.short.setdefault(at, []).append((len(ids), name))

    def _nearest_short(self) -> list[int]:
        """For each state, itself or the nearest suffix state where a short item ends; 0 if none."""
        nearest = [0] * len(self.length)
        for s in self._by_length():
            nearest[s] = s if s in self.short else nearest[self.link[s]]
        return nearest

    def flat(self) -> dict[str, list | bytes]:
        """The automaton as arrays."""
        states, width = len(self.length), max(1, len(self.vocabulary))
        names = sorted({name for found in self.items.values() for name in found if name is not None}
                       | {name for found in self.short.values() for _, name in found if name is not None})
        number: dict[str | None, int] = {name: i for i, name in enumerate(names)} | {None: -1}
        items = [sorted(number[name] for name in self.items.get(s, ())) for s in range(states)]
        short = [self.short.get(s, []) for s in range(states)]
        moves = sorted((s * width + word, to) for s, after in enumerate(self.next) for word, to in after.items())
        arrays = {
            "moves": [key for key, _ in moves],
            "to": [to for _, to in moves],
            "link": self.link,
            "length": self.length,
            "window": self.window,
            "short_from": self.short_from,
            "item_first": [0, *accumulate(map(len, items))],
            "item": [i for some in items for i in some],
            "short_first": [0, *accumulate(map(len, short))],
            "short": [number[name] for some in short for _, name in some],
            "short_size": [size for some in short for size, _ in some],
        }
        flat = {name: np.array(arrays[name], kind).tobytes() for name, kind in _ARRAYS.items()}
        return {"vocabulary": list(self.vocabulary), "names": names, **flat}


class Automaton:
    """An automaton read from its arrays."""

    def __init__(self, flat: dict[str, list | bytes], span: int = SPAN):
        arrays = {name: np.frombuffer(flat[name], kind).tolist() for name, kind in _ARRAYS.items()}
        self.span, self.names = span, flat["names"]
        self.vocabulary = {word: i for i, word in enumerate(flat["vocabulary"])}
        self.moves = dict(zip(arrays["moves"], arrays["to"]))
        self.link, self.length, self.window = arrays["link"], arrays["length"], arrays["window"]
        self.short_from, self.item_first, self.item = arrays["short_from"], arrays["item_first"], arrays["item"]
        self.short_first, self.short, self.short_size = arrays["short_first"], arrays["short"], arrays["short_size"]
        self.least = min([span, *self.short_size])

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as merged, ascending [first, end, first, end, ...] word indexes, and the names of items found."""
        moves, link, length, least, span = self.moves, self.link, self.length, self.least, self.span
        width = max(1, len(self.vocabulary))
        state = matched = 0
        spans: list[int] = []
        found: set[int] = set()
        for end, word in enumerate(map(self.vocabulary.get, words), 1):
            if word is None:
                state = matched = 0
                continue
            to = moves.get(state * width + word)
            while to is None:  # the root has a move for every known word
                state = link[state]
                matched = length[state]
                to = moves.get(state * width + word)
            state = to
            matched += 1
            if matched >= least:
                reach = 0
                if matched >= span:
                    reach = span
                    at = self.window[state]
                    found.update(self.item[self.item_first[at] : self.item_first[at + 1]])
                at = self.short_from[state]
                while at:
                    for i in range(self.short_first[at], self.short_first[at + 1]):
                        if self.short_size[i] <= matched:
                            reach = max(reach, self.short_size[i])
                            found.add(self.short[i])
                    at = self.short_from[link[at]]
                if reach:
                    _add(spans, end - reach, end)
        return spans, {self.names[i] for i in found if i >= 0}


def _add(spans: list[int], first: int, end: int) -> None:
    """Append a span that ends at or after all before it."""
    while spans and spans[-2] >= first:
        del spans[-2:]
    if spans and spans[-1] >= first:
        spans[-1] = end
    else:
        spans += [first, end]


def _merge(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return a or b
    out: list[int] = []
    pairs = sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])])
    for first, end in pairs:
        if out and out[-1] >= first:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def build(benchmark: DataFrame, item_col: str, text_col: str, span: int, block_words: int) -> tuple[str, int]:
    """Write the automata of the items to the shared folder; the folder, and how many blocks there may be."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / block_words))  # a word and its gap are two characters at least

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        names = [None if name is None or name != name else name for name in rows["item"]]
        flat = Builder([(name, alnum_words(text)) for name, text in zip(names, rows["text"])], span).flat()
        return pd.DataFrame({"block": [rows["block"].iloc[0]], **{name: [value] for name, value in flat.items()}})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("long"))
    path = shared_dir(benchmark.sparkSession, "automata")
    built = blocks.groupBy("block").applyInPandas(of_block, f"block long, {_FLAT}")
    built.write.partitionBy("block").parquet(path)
    return path, n


def _load(path: str, block: int, span: int) -> Automaton | None:
    """A block's automaton, read by a task; none if no item fell into the block."""
    store, inside = fs.FileSystem.from_uri(f"{path}/block={block}")
    if store.get_file_info(inside).type == fs.FileType.NotFound:
        return None
    return Automaton(pq.read_table(inside, filesystem=store, partitioning=None, use_threads=False).to_pylist()[0], span)


class _Scanner:
    """Marks of batches of texts. The block used last is kept and begins the next batch."""

    def __init__(self, path: str, n: int, span: int):
        self.path, self.blocks, self.span = path, list(range(n)), span
        self.held: tuple[int, Automaton | None] | None = None

    def marks(self, texts: list[str | None]) -> tuple[list[list[int]], list[set[str]], list[int]]:
        """For each text its hit spans, the items found, and its number of words."""
        spans: list[list[int]] = [[] for _ in texts]
        found: list[set[str]] = [set() for _ in texts]
        counts = [0] * len(texts)
        for block in self.blocks:
            if self.held is None or self.held[0] != block:
                self.held = None  # before the next is loaded
                self.held = block, _load(self.path, block, self.span)
            automaton = self.held[1]
            for i, text in enumerate(texts):
                words = alnum_words(text)
                counts[i] = len(words)
                if automaton is not None and words:
                    hit, items = automaton.scan(words)
                    if hit:
                        spans[i] = _merge(spans[i], hit)
                        found[i] |= items
        self.blocks.reverse()
        return spans, found, counts


def _marked(batches: Iterator[pa.RecordBatch], at: int, scanner: _Scanner) -> Iterator[tuple]:
    """Each batch with the marks of its texts; only with several blocks is a whole one of Spark's batches marked at once."""
    for whole in batches:
        rows = ROWS_AT_ONCE if len(scanner.blocks) == 1 else max(1, whole.num_rows)
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            texts = batch.column(at).to_pylist()
            yield batch, texts, *scanner.marks(texts)


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents with their merged hit spans in words, the items found, and their word count.

    All columns pass through, but for any that are named like the three, which are replaced. A null or
    wordless text has no words and no hits. Items without words have no window; those with a null id
    hit words and name no item; an id that repeats stands for the union of its texts, and equal texts
    under two ids are two items. An empty benchmark hits nothing; no documents give no rows.
    """
    docs = docs.drop(HITS, ITEMS, WORDS)
    path, n = build(benchmark, item_col, item_text_col, span, block_words)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, spans, found, counts in _marked(batches, at, _Scanner(path, n, span)):
            marks = [
                pa.array(spans, pa.list_(pa.int64())),
                pa.array([sorted(names) for names in found], pa.list_(pa.string())),
                pa.array(counts, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, HITS, ITEMS, WORDS])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *_MARKS.fields]))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: words, hit words, items found with their digest, contaminated or not."""
    text_col = options.get("text_col", "text")
    marked = mark(docs.select(id_col, text_col), benchmark, **options)
    ends = F.filter(HITS, lambda _, i: i % 2 == 1)
    starts = F.filter(HITS, lambda _, i: i % 2 == 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select(
        id_col,
        F.col(WORDS).alias("n_words"),
        (total(ends) - total(starts)).alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"),
        (F.size(HITS) > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """The digest of found items as ``report`` gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def without_spans(text: str, spans: list[int]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    data = text.encode()
    gap = np.frombuffer(data.translate(_TO_WORDS), np.uint8) == 0x20
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for first, end in zip(spans[::2], spans[1::2]):
        out.append(data[at : starts[first]])
        at = int(ends[end - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    max_coverage: float = 0.5,
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without their hit spans; those hit in over ``max_coverage`` of their words go.

    Rows and columns keep their order, names and types; only a hit document's text changes. Nulls, empty
    texts and benchmarks behave as in ``mark``.
    """
    path, n = build(benchmark, item_col, item_text_col, span, block_words)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, spans, _, counts in _marked(batches, at, _Scanner(path, n, span)):
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            keep = pa.array([h <= max_coverage * words for h, words in zip(hit, counts)], pa.bool_())
            if any(hit):
                cleaned = [without_spans(t, s) if s else t for t, s in zip(texts, spans)]
                columns = list(batch.columns)
                columns[at] = pa.array(cleaned, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(keep)

    return docs.mapInArrow(cut, docs.schema)
