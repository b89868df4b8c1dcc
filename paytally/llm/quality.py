"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are cut into bins at quantiles of the training rows. Each tree grows level by level: one
histogram per node, statistic and bin of the loss's slope and curvature, summed at once, gives every
node's best cut. All trees are complete and flattened into arrays, so that numpy walks a batch of
documents down every tree level by level.

Scale: the trees are fitted on at most ``most_rows`` labelled rows; scoring is one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import crc32_of, per_batch, saved, texts

MOST_ROWS = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_SIGNS = re.compile(r"[^\w\s]")
_SIGN_ENDS = re.compile(r"[!#$%&*+=@^_|~]{2,}")

FEATURES = (
    "words", "characters per word", "upper-case share", "digit share", "sign share", "space share",
    "words with signs at the end", "bars per word", "distinct word share", "commonest word share",
    "distinct pair share", "lines per word", "distinct line share", "repeated line characters", "longest line share",
    "sentence ends per word", "commas per word", "lines that begin a sentence", "longest word", "non-ASCII share",
)


def statistics(text: str | None) -> list[float]:
    """The document's figures; all zero for a null or wordless text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    by_line = [line for line in text.split("\n") if line.strip()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    line_counts = Counter(by_line)
    ascii_size = len(text.encode("ascii", "ignore"))
    squeezed = "".join(words)
    upper = sum(map(str.isupper, squeezed)) if not squeezed.islower() else 0
    return [
        float(np.log1p(n)),
        len(squeezed) / n,
        upper / len(squeezed),
        sum(text.count(d) for d in "0123456789") / size,
        len(_SIGNS.findall(text)) / size,
        (size - len(squeezed)) / size,
        len(_SIGN_ENDS.findall(text)) / n,
        text.count("|") / n,
        len(counts) / n,
        max(counts.values()) / n,
        pairs,
        len(by_line) / n,
        len(line_counts) / max(1, len(by_line)),
        sum(len(line) * (k - 1) for line, k in line_counts.items()) / size,
        max(map(len, by_line), default=0) / size,
        (text.count(".") + text.count("?")) / n,
        text.count(",") / n,
        sum(line[0].isupper() for line in by_line) / max(1, len(by_line)),
        float(np.log1p(max(map(len, counts)))),
        1 - ascii_size / size,
    ]


@dataclass
class Trees:
    """Complete trees of equal depth; children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # the value at or under which a row goes left
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0
) -> Trees:
    """Fit trees to the logistic loss; without rows or with one class only, the prior is the score."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, width = 2**depth - 1, x.shape[1]
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(feature, cut, leaf, start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    offset = np.arange(width) * bins
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes = 2**level
            at = node - (nodes - 1)
            cell = (at[:, None] * (width * bins) + offset + binned).ravel()
            sums = [
                np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
                for v in (slope, curve)
            ]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge)
            gain -= all_g**2 / (all_h + ridge)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1  # no cut after the last bin
            best = gain.reshape(nodes, -1).argmax(axis=1)
            worth = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            chosen, place = best // bins, best % bins
            for k in np.flatnonzero(worth):
                feature[t, nodes - 1 + k], cut[t, nodes - 1 + k] = chosen[k], edges[chosen[k]][place[k]]
            right = worth[at] & (binned[np.arange(len(y)), chosen[at]] > place[at])
            node = 2 * node + 1 + right
        at = node - inner
        g, h = (np.bincount(at, v, inner + 1) for v in (slope, curve))
        leaf[t] = -rate * g / (h + ridge)
        total += leaf[t][at]
    return Trees(feature, cut, leaf, start)


def _figures(source: DataFrame, extra: dict[str, pa.DataType], schema: str) -> DataFrame:
    arrow = pa.schema([*extra.items(), ("x", pa.list_(pa.float64()))])

    def of(columns):
        return {**{c: columns[c] for c in extra}, "x": [statistics(t) for t in columns["text"]]}

    return source.mapInArrow(per_batch(of, arrow), schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = MOST_ROWS,
) -> Trees:
    """Fit on at most ``most_rows`` labelled rows, those whose id has the smallest hash.

    Rows with a null label, without a document, or in the held-out fold are not learned from; an id
    labelled twice has the smaller label, and of an id with several texts the smallest is learned.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where((F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) != HELD_OUT) & F.col("y").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = saved(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "quality-sample")
    source = texts(docs, F.col(id_col).alias("doc_id"), text=text_col)
    learned = source.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    learned = learned.select("y", "text")  # most_rows rows at most
    table = _figures(learned, {"y": pa.int32()}, "y int, x array<double>").toArrow()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = table["y"].to_numpy().astype(np.float64)
    by_value = np.lexsort((y, *x.T))  # the same trees whatever order the rows arrive in
    return boost(x[by_value], y[by_value])


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null or wordless text has zero statistics and a score like any other. Rows that repeat an id
    are each scored; a null id is held out of nothing and stays null. An empty table gives no rows.
    Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(columns):
        x = np.array([statistics(t) for t in columns["text"]], np.float64).reshape(-1, len(FEATURES))
        return {"doc_id": columns["doc_id"], "score": shared.value.score(x)}

    source = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    scored = source.mapInArrow(per_batch(of, schema), "doc_id long, score double")
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
