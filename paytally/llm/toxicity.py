"""Toxicity by class-conditional Kneser-Ney models.

Two character models read words, one of toxic and one of ordinary text: the probability of a
character after up to ``order - 1`` characters of its word. Each class has its own counts at the
highest order; both back off to the same lower-order Kneser-Ney distribution, whose continuation
counts come from both classes together. A rare expression is so judged by what it shares with known
ones, and where a class has no evidence the shared backoff cancels in the ratio. A document compares
the two log-likelihoods, normalised by length, over its whole text, over windows of words and over
single words; a logistic curve fitted on texts the models have not seen turns that into a score.

Scale: the models are fitted on at most ``rows_per_class`` labelled rows a class, so their size does
not follow the data; they are broadcast as sorted arrays. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import ROWS_AT_ONCE, crc32_of, per_batch, saved, texts

ORDER = 6
DISCOUNT = 0.75
ROWS_PER_CLASS = 2500
PARTS, WHOLE = 4, -1
TOXIC_WEIGHT = 3
REMEMBERED = 200_000  # tokens whose ratio a task process keeps
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = 10  # the line feed that stands for both ends of a word
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class KneserNey:
    """Log-likelihood ratios, toxic over ordinary, of characters after their history."""

    gram: np.ndarray  # sorted hashes of history and character
    gram_ratio: np.ndarray
    history: np.ndarray  # sorted hashes of histories
    history_ratio: np.ndarray  # ratio for a character not seen after the history
    row_of: dict[str, int] = field(default_factory=dict, repr=False, compare=False)  # remembered tokens
    rows: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)), repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "row_of": {}, "rows": np.zeros((2, 0))}

    def ratios(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word, its end included."""
        codes, histories, word_of = _positions(words)
        grams = _mix(histories, codes)
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        before = np.minimum(np.searchsorted(self.history, histories), len(self.history) - 1)
        backed = np.where(self.history[before] == histories, self.history_ratio[before], 0.0)
        ratio = np.where(self.gram[at] == grams, self.gram_ratio[at], backed)
        return np.bincount(word_of, ratio, len(words))

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Ratios and characters of the tokens: the sum over its runs of letters. Remembers tokens."""
        known = self.row_of
        if len(known) > REMEMBERED:
            known.clear()
        missing = [t for t in set(tokens) if t not in known]
        if missing:
            runs = [_LETTERS.findall(t.lower()) for t in missing]
            flat = [w for r in runs for w in r]
            owner = np.repeat(np.arange(len(missing)), [len(r) for r in runs])
            ratio = np.bincount(owner, self.ratios(flat), len(missing)) if flat else np.zeros(len(missing))
            start, end = len(known), len(known) + len(missing)
            if end > self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros((2, max(end, self.rows.shape[1])))], axis=1)
            self.rows[:, start:end] = ratio, [sum(map(len, r)) for r in runs]
            known.update(zip(missing, range(start, end)))
        return self.rows[:, np.fromiter(map(known.__getitem__, tokens), np.intp, len(tokens))]


#: The arrays of a model, and their types.
ARRAYS = {"gram": np.uint64, "gram_ratio": np.float64, "history": np.uint64, "history_ratio": np.float64}


def _mix(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    mixed = (state ^ (code + np.uint64(1))) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _positions(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character and end of the words: its code, the hash of its history, its word's index."""
    text = "\n" + "".join(w + "\n" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    histories = _histories(codes, order - 1)[0]
    ends = np.cumsum(codes == _EDGE) - 1
    word_of = ends - (codes == _EDGE)
    return codes[1:], histories[1:], word_of[1:]


def _histories(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of up to ``length`` characters before each, from the word's edge at most, and if it holds the edge."""
    state = np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)
    for back in range(1, length + 1):
        previous = np.concatenate([np.full(back, _EDGE, np.uint64), codes[:-back]])[: len(codes)]
        state = np.where(inside, _mix(state, previous), state)
        inside &= previous != _EDGE
    return state, ~inside


def fit_model(words: list[str], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER) -> KneserNey:
    """The ratio model from words with their counts in toxic and in ordinary texts."""
    codes, histories, word_of = _positions(words, order)
    gram, first, gram_of = np.unique(_mix(histories, codes), return_index=True, return_inverse=True)
    counts = [np.bincount(gram_of, np.asarray(c, np.float64)[word_of], len(gram)) for c in (toxic, ordinary)]
    full = histories[first]
    del histories, word_of, gram_of
    # Shorter histories follow from the longest, so one position stands for all of its gram.
    codes = np.concatenate([np.full(1, _EDGE, np.uint64), codes])
    shared = np.full(len(gram), 1.0 / max(1, len(np.unique(codes))))
    for length in range(order - 1):
        histories, edge = (a[first + 1] for a in _histories(codes, length))
        shorter = _mix(histories, codes[first + 1])
        longer = _mix(_histories(codes, length + 1)[0][first + 1], codes[first + 1])
        _, at, of = np.unique(shorter, return_index=True, return_inverse=True)
        _, one_longer = np.unique(longer, return_index=True)
        kinds = np.bincount(of[one_longer], minlength=len(at)).astype(np.float64)
        # A history that begins at the word's edge cannot be extended: its plain counts are used.
        count = np.where(edge[at], np.bincount(of, counts[0] + counts[1], len(at)), kinds)
        shared = _interpolate(histories, of, at, count, shared)
    history, history_of = np.unique(full, return_inverse=True)
    likelihood, left = [], []
    for of_gram in counts:
        total = np.bincount(history_of, of_gram, len(history))
        seen = np.bincount(history_of, of_gram > 0, len(history))
        known = total > 0
        weight = np.where(known, DISCOUNT * seen / np.maximum(total, 1), 1.0)
        own = np.maximum(of_gram - DISCOUNT, 0) / np.maximum(total[history_of], 1)
        likelihood.append(own + weight[history_of] * shared)
        left.append(weight)
    return KneserNey(
        gram, np.log(likelihood[0] / likelihood[1]), history, np.log(left[0] / left[1])
    )


def _interpolate(histories, gram_of, first, count, lower) -> np.ndarray:
    """Interpolated probability, per position, from the counts per gram and the lower order."""
    history, history_of = np.unique(histories[first], return_inverse=True)
    total = np.bincount(history_of, count, len(history))
    kinds = np.bincount(history_of, minlength=len(history))
    own = np.maximum(count - DISCOUNT, 0) / total[history_of]
    return (own + DISCOUNT * kinds[history_of] / total[history_of] * lower[first])[gram_of]


#: What a document is judged by; every figure is a ratio of log-likelihoods over a length.
FEATURES = (
    "whole text", "best 20 words", "best 5 words", "best word", "best plain", "second plain", "third plain",
    "strong words", "words",
)
_WINDOWS = (20, 5, 1)


def features(text: str | None, model: KneserNey) -> list[float]:
    ratio, length = model.tokens((text or "").split())
    if not length.sum():
        return [0.0] * len(FEATURES)
    sums, lengths = np.concatenate([[0], np.cumsum(ratio)]), np.concatenate([[0], np.cumsum(length)])
    out = [sums[-1] / lengths[-1]]
    for width in _WINDOWS:
        width = min(width, len(ratio))
        over = lengths[width:] - lengths[:-width]
        out.append(float(np.max((sums[width:] - sums[:-width]) / np.maximum(over, 4))))
    # Distinct words: one odd word that repeats is weaker evidence than several.
    top = np.sort(np.unique(ratio))[::-1][:3].clip(-2, 8)
    top = np.concatenate([top, np.full(3 - len(top), -2.0)])
    strong = np.unique(ratio[ratio > 3])
    return [*out, *top.tolist(), float(np.log1p(strong.sum())), float(np.log1p(len(ratio)))]


@dataclass
class Toxicity:
    model: KneserNey
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def score(self, rows: list[str | None]) -> np.ndarray:
        return self.of(np.array([features(t, self.model) for t in rows], np.float64).reshape(-1, len(FEATURES)))

    def of(self, x: np.ndarray) -> np.ndarray:
        x = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> Toxicity:
    """Fit on at most ``rows_per_class`` labelled rows of each class, those of smallest hash.

    Rows with a null label or text, without a document, or in the held-out fold are not learned
    from; an id labelled twice is toxic if one label says so, and of an id with several texts the smallest is
    learned. With one class missing, every score is that of the other. Models are fitted in tasks, one after another;
    the driver holds the last.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.where((F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) != HELD_OUT) & F.col("toxic").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    sample = [rows.where(F.col("toxic") == k).orderBy(*by_hash).limit(rows_per_class) for k in (0, 1)]
    bounded = saved(sample[0].unionByName(sample[1]), "toxic-sample")  # 2 * rows_per_class rows at most
    source = texts(docs, F.col(id_col).alias("doc_id"), text=text_col).where("text is not null")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(PARTS)).cast("int")
    learned = source.join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    learned = saved(learned.select("text", "toxic", fold.alias("fold")), "toxic-texts")
    schema = pa.schema([("toxic", pa.int32()), ("fold", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def count(columns):
        counted: Counter = Counter()
        for text, toxic, part in zip(columns["text"], columns["toxic"], columns["fold"]):
            counted.update((toxic, part, w) for w in _LETTERS.findall(text.lower()))
        rows = [(*key, n) for key, n in counted.items()]
        return dict(zip(schema.names, zip(*rows))) if rows else {name: [] for name in schema.names}

    counted = learned.mapInArrow(per_batch(count, schema), "toxic int, fold int, word string, n long")
    # Every part's words count in the models that leave out another part, and in the one that leaves out none.
    models = F.filter(F.array(*map(F.lit, [WHOLE, *range(PARTS)])), lambda k: k != F.col("fold"))
    counted = counted.withColumn("without", F.explode(models)).groupBy("without", "word").agg(
        *[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(c) for c, k in (("toxic", 1), ("ordinary", 0))]
    )
    counted = saved(counted, "toxic-words")

    def model(words: pd.DataFrame) -> KneserNey:
        words = words.sort_values("word")
        return fit_model(words["word"].tolist(), words["toxic"].to_numpy(), words["ordinary"].to_numpy())

    def unseen(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"toxic": [], "x": []})
        fitted = model(words) if len(words) else _nothing()  # the model that has not seen the rows
        return pd.DataFrame({"toxic": rows["toxic"], "x": [features(t, fitted) for t in rows["text"]]})

    def arrays(words: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({name: [value.tobytes()] for name, value in vars(model(words)).items() if name in ARRAYS})

    held = counted.where(F.col("without") != WHOLE).groupBy("without").cogroup(learned.groupBy("fold"))
    seen = held.applyInPandas(unseen, "toxic int, x array<double>").toArrow()
    whole = counted.where(F.col("without") == WHOLE).groupBy("without")
    last = whole.applyInPandas(arrays, ", ".join(f"{name} binary" for name in ARRAYS)).first()
    fitted = KneserNey(*(np.frombuffer(last[c], t) for c, t in ARRAYS.items())) if last else _nothing()
    x = np.array(seen["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = seen["toxic"].to_numpy().astype(np.float64)
    # Each class counts for as many rows as the labels have of it, toxic rows TOXIC_WEIGHT times.
    share = np.array([sizes.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)]) * [1, TOXIC_WEIGHT]
    return Toxicity(fitted, *_logistic(x, y, share[y.astype(int)]))


def _nothing() -> KneserNey:
    none = np.zeros(1)
    return KneserNey(np.zeros(1, np.uint64), none, np.zeros(1, np.uint64), none)


def _logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0):
    """Centre, scale and weights of a ridge logistic regression, by Newton steps."""
    if not len(x):
        width = x.shape[1]
        return np.zeros(width), np.ones(width), np.zeros(width + 1)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (importance * (p - y)) + penalty * weights
        curve = (z * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return centre, scale, weights


def score(docs: DataFrame, fitted: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null, empty or letterless text has neutral ratios, and a score like any other. Rows that
    repeat an id are each scored; a null id is held out of nothing and stays null. An empty table
    gives no rows. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(columns):
        return {"doc_id": columns["doc_id"], "score": shared.value.score(columns["text"])}

    source = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    scored = source.mapInArrow(per_batch(of, schema), "doc_id long, score double")
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def without_toxic(docs: DataFrame, fitted: Toxicity, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is under ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                text = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array(shared.value.score(text) < threshold))

    return docs.mapInArrow(keep, docs.schema)
