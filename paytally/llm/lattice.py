"""Language-model scores by a subword lattice.

Every word is a lattice of the ways to spell it with the pieces of an existing vocabulary. Pieces
have unigram scores, counted over the distinct training words; forward recursion in log space sums
all segmentations. A training word is one more piece, which spans the word: it has the word's own
discounted frequency, and the mass that the discount frees goes to spelling. So a word's
probability is

    P(w) = max(c(w) - d, 0) / N + (d * V / N) * sum over spellings of the product of piece scores

Texts come in classes, such as languages, whose word frequencies differ. Each class discounts its
own counts once more and falls back on P; a text's probability is the product over its words and
one end, in each class, summed over the classes by their share of the training texts.

Scale: all training tokens are counted, combined per batch of texts before the shuffle. Each
distinct word is spelled once, wherever it occurs. The commonest words, ``frequent`` at most, are broadcast; only the rarer occurrences are joined to the word table, so no join key is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import ROWS_AT_ONCE, crc32_of, per_batch, saved, space_words, texts

FOLDS, HELD_OUT = 10, 0
#: Bound of the broadcast word list: so many words of at most so many bytes.
FREQUENT = 200_000
FREQUENT_BYTES = 64
CLASSES = 7
_START = "▁"  # how the vocabulary marks the beginning of a word
PRIOR_PIECES = 1000
#: Characters, and words, that one step of spelling holds at most.
CELLS, WORDS_AT_ONCE = 100_000, 10_000


def train_fold(id_col: str):
    """True for rows that may be learned from; a null id counts as learned."""
    return F.coalesce(F.pmod(crc32_of(id_col), F.lit(FOLDS)) != HELD_OUT, F.lit(True))


class Spelling:
    """Log probabilities of words by all their segmentations into pieces, under several sets of scores at once."""

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_scores: np.ndarray, ends: np.ndarray):
        """``scores``, ``byte_scores`` (256) and ``ends`` have a column, or an entry, a set."""
        self.place = {piece: i for i, piece in enumerate(pieces)}
        self.scores = np.vstack([scores, np.full(scores.shape[1], -np.inf)])  # the last row: no such piece
        self.bytes, self.ends = byte_scores, ends
        self.longest = max(map(len, pieces), default=1)

    def log_probabilities(self, words: list[str], sets: list[int]) -> np.ndarray:
        """words x sets. Words of equal length go through the forward recursion together, all sets at once."""
        out = np.empty((len(words), len(sets)))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, members in by_length.items():
            at_once = max(1, CELLS // (length + 1))
            for start in range(0, len(members), at_once):
                part = members[start : start + at_once]
                out[part] = self._forward([_START + words[i] for i in part], length + 1, sets)
        return out

    def _forward(self, texts: list[str], length: int, sets: list[int]) -> np.ndarray:
        scores, find, none = self.scores[:, sets], self.place.get, len(self.place)
        characters: dict[str, int] = {}
        spelled = np.array([[characters.setdefault(c, len(characters)) for c in text] for text in texts])
        # A character is always the bytes it is made of.
        of_bytes = np.array([self.bytes[list(c.encode())].sum(axis=0) for c in characters])[:, sets]
        forward = np.zeros((min(self.longest, length) + 1, len(texts), len(sets)))  # by position, in a ring
        ring = len(forward)
        for end in range(1, length + 1):
            starts = range(max(0, end - self.longest), end)
            piece = np.array([[find(text[start:end], none) for text in texts] for start in starts])
            used = np.flatnonzero((piece < none).any(axis=1))
            arcs = [forward[(end - 1) % ring] + of_bytes[spelled[:, end - 1]]]
            arcs += [forward[starts[k] % ring] + scores[piece[k]] for k in used.tolist()]
            best = arcs[0] if len(arcs) == 1 else np.maximum.reduce(arcs)
            total = best if len(arcs) == 1 else best + np.log(sum(np.exp(arc - best) for arc in arcs))
            forward[end % ring] = total
        return forward[length % ring] + self.ends[sets]


def spelling(model_path: str, counts: np.ndarray) -> Spelling:
    """Piece scores from sets x (how often each vocabulary piece and, last, the word end occurs); all have some mass."""
    model = _model(model_path)
    scores = np.log((counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)).T
    normal, bytes_ = [], np.zeros((256, len(counts)))
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[3:5], 16)] = scores[i]
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append(i)
    return Spelling([model.id_to_piece(i) for i in normal], scores[normal], bytes_, scores[-1])


def spellings(model_path: str, counts: np.ndarray) -> Spelling:
    """The first set is for all words, then one a class, whose counts are filled up with a few of the general ones."""
    every = counts.sum(axis=0)
    general = every / max(1.0, every.sum()) * PRIOR_PIECES
    return spelling(model_path, np.vstack([every, counts + general]))


_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def classes(source: DataFrame, most: int = CLASSES) -> list[str]:
    """The ``most`` commonest values of ``class`` among training rows."""
    rows = source.where("train").where(F.col("class").isNotNull()).groupBy("class").count()
    return [r["class"] for r in rows.orderBy(F.desc("count"), "class").limit(most).collect()]


def count_words(source: DataFrame, n_classes: int) -> DataFrame:
    """(word, c0, c1, ...): every word of all rows, and how often training rows of each class hold it."""
    counts = [f"c{z}" for z in range(n_classes)]
    schema = pa.schema([("word", pa.binary()), *((c, pa.int64()) for c in counts)])

    def count(columns):
        counted: list[Counter] = [Counter() for _ in counts]
        every: set[bytes] = set()
        for text, train, z in zip(columns["text"], columns["train"], columns["z"]):
            words = space_words(text)
            every.update(words)
            if train:
                counted[z].update(words)
        words = list(every)
        return {"word": words, **{c: [n.get(w, 0) for w in words] for c, n in zip(counts, counted)}}

    typed = ", ".join(f"{c} long" for c in counts)
    words = source.mapInArrow(per_batch(count, schema), f"word binary, {typed}")
    return words.groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])


def count_pieces(words: DataFrame, n_classes: int, model_path: str) -> np.ndarray:
    """classes x (pieces and the word end): how often each occurs in a class's distinct words.

    At most classes * vocabulary rows come back.
    """
    schema = pa.schema([("z", pa.int32()), ("piece", pa.int32()), ("n", pa.int64())])
    counts = [f"c{z}" for z in range(n_classes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        total = np.zeros((n_classes, model.get_piece_size() + 1), np.int64)
        for batch in batches:
            text = [w.decode() for w in batch.column(0).to_pylist()]
            held = np.column_stack([batch.column(c).to_numpy() for c in counts]) > 0
            for start in range(0, len(text), 4096):
                ids = model.encode(text[start : start + 4096], num_threads=1)
                flat = np.array([i for word in ids for i in word], np.int64)
                of = np.repeat(np.arange(len(ids)), [len(word) for word in ids])
                for z in range(n_classes):
                    here = held[start : start + 4096, z]
                    total[z, :-1] += np.bincount(flat[here[of]], minlength=total.shape[1] - 1)
                    total[z, -1] += here.sum()
        z, piece = np.nonzero(total)
        rows = [pa.array(z, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[z, piece], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, schema=schema)

    counted = words.select("word", *counts).mapInArrow(count, "z int, piece int, n long")
    out = np.zeros((n_classes, _model(model_path).get_piece_size() + 1))
    for row in counted.groupBy("z", "piece").agg(F.sum("n").alias("n")).collect():
        out[row.z, row.piece] = row.n
    return out


@dataclass
class Mass:
    """What a discounted frequency needs: tokens, what each seen word gives up, and what that frees."""

    tokens: int
    discount: float
    freed: float

    @classmethod
    def of(cls, tokens: int, kinds: int, once: int, twice: int) -> Mass:
        discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        return cls(tokens, discount, discount * kinds / tokens if kinds else 1.0)

    def log(self, count: np.ndarray, log_rest: np.ndarray) -> np.ndarray:
        """Log probability of words counted ``count`` times; ``log_rest`` is theirs in what the freed mass goes to."""
        own = np.maximum(count - self.discount, 0) / max(1, self.tokens)
        return np.logaddexp(np.log(np.maximum(own, 1e-300)), math.log(self.freed) + log_rest)


def spell_words(words: DataFrame, model: Spelling, everything: Mass, each: list[Mass]) -> DataFrame:
    """(word, c, p0, p1, ...): the words with their count and their log10 probability in every class.

    A class spells words its own way. For training words, whose spelling adds next to nothing to
    their own frequency, the general spelling stands for all.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)
    names, counts = [f"p{z}" for z in range(len(each))], [f"c{z}" for z in range(len(each))]
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), *((p, pa.float64()) for p in names)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, WORDS_AT_ONCE):
                batch = whole.slice(start, WORDS_AT_ONCE)
                count = np.array([batch.column(c).to_numpy() for c in counts], np.float64)
                total = count.sum(axis=0)
                words = [w.decode() for w in batch.column("word").to_pylist()]
                spelled = np.empty((len(words), len(each)))
                for group, sets in ((total > 0, [0]), (total == 0, list(range(1, len(each) + 1)))):
                    chosen = np.flatnonzero(group)
                    spelled[chosen] = shared.value.log_probabilities([words[i] for i in chosen.tolist()], sets)
                logs = [
                    mass.log(n, everything.log(total, spelled[:, z])) / math.log(10)
                    for z, (mass, n) in enumerate(zip(each, count))
                ]
                columns = [batch.column("word"), pa.array(total.astype(np.int64)), *map(pa.array, logs)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    typed = ", ".join(f"{p} double" for p in names)
    return words.select("word", *counts).mapInArrow(of, f"word binary, c long, {typed}")


def commonest(spelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the words, the commonest: all with a count of at least some threshold.

    The threshold comes from a histogram of the counts in eighths of octaves, so no task takes a list from all others.
    """
    bin_ = F.when(F.col("c") > 0, F.floor(F.log2("c") * 8)).otherwise(-1)
    bins = spelled.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    threshold, taken = None, 0
    for row in sorted(bins, key=lambda r: -r.bin):
        taken += row.n
        if taken > most:
            break
        threshold = row.least
    return spelled.where(F.lit(False) if threshold is None else F.col("c") >= threshold)


def score(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = "lang",
    frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``model_path`` is a sentencepiece vocabulary with byte pieces. ``class_col`` tells the training
    rows' classes apart, the commonest ``CLASSES`` and the rest with nulls as one more; scored rows
    are summed over all classes, whatever their own. A null or wordless text is its end token alone.
    Rows that repeat an id are each scored; a null id is learned from and stays null. Without
    training rows the counts are zero and words have their spelling's probability. An empty table
    gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    label = F.col(class_col).cast("string") if class_col in docs.columns else F.lit(None).cast("string")
    ids = [F.col(id_col).cast("long").alias("doc_id"), label.alias("class")]
    source = texts(docs, *ids, text=text_col).withColumn("train", train_fold("doc_id"))
    named = classes(source)
    n_classes = len(named) + 1
    known_class = F.array_position(F.array(*map(F.lit, named)).cast("array<string>"), F.col("class")) - 1
    source = source.withColumn("z", F.coalesce(F.when(known_class >= 0, known_class), F.lit(len(named))).cast("int"))

    words = saved(count_words(source.select("train", "z", "text"), n_classes), "words")
    ends = {r.z: r["count"] for r in source.where("train").groupBy("z").count().collect()}
    total = sum((F.col(f"c{z}") for z in range(1, n_classes)), F.col("c0"))
    sums = []
    for name, c in (("all", total), *((f"c{z}", F.col(f"c{z}")) for z in range(n_classes))):
        for part, value in (("n", c), ("kinds", F.when(c > 0, 1)), ("once", F.when(c == 1, 1)), ("twice", F.when(c == 2, 1))):
            sums.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_{part}"))
    sums = words.agg(*sums).first()
    of = lambda name, more: Mass.of(*(sums[f"{name}_{p}"] + (more if p == "n" else 0) for p in ("n", "kinds", "once", "twice")))
    n_ends = sum(ends.values())  # each training text ends once
    everything = of("all", n_ends)
    each = [of(f"c{z}", ends.get(z, 0)) for z in range(n_classes)]
    n, v = everything.tokens, sums["all_kinds"] + (n_ends > 0)
    model = spellings(model_path, count_pieces(words.where(total > 0), n_classes, model_path))
    spelled = saved(spell_words(words, model, everything, each), "spelled")
    base_of = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    end_known, end_base = int(n_ends > 0), base_of(n_ends)
    end_logs = np.array([math.log10(max(ends.get(z, 0), 0.1) / max(m.tokens, 1)) for z, m in enumerate(each)])
    priors = [math.log10((ends.get(z, 0) + 0.1) / (n_ends + 0.1 * n_classes)) for z in range(n_classes)]
    logs = [f"p{z}" for z in range(n_classes)]

    short = spelled.where(F.octet_length("word") <= FREQUENT_BYTES)
    common = commonest(short, frequent).toArrow()
    count = common["c"].to_numpy().astype(np.float64)
    figures = np.column_stack(
        [count > 0, np.log10((count + 0.1) / (n + 0.1 * (v + 1))), *(common[p].to_numpy() for p in logs)]
    )
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(common["word"].to_pylist())}, figures))
    out = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base", pa.float64()), *((p, pa.float64()) for p in logs),
            ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
        ]
    )

    def listed_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table = shared.value[0].get, shared.value[1]
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    in_text = Counter(space_words(text))
                    at = list(map(find, in_text))
                    here = [(i, k) for i, k in zip(at, in_text.values()) if i is not None]
                    sums = np.array([k for _, k in here], np.float64) @ table[[i for i, _ in here]] if here else np.zeros(len(logs) + 2)
                    rest = [(w, k) for i, (w, k) in zip(at, in_text.items()) if i is None]
                    rows.append(
                        (
                            row, doc_id, in_text.total() + 1, end_known + int(sums[0]), end_base + sums[1],
                            *(end_logs + sums[2:]).tolist(), [w for w, _ in rest], [k for _, k in rest],
                        )
                    )
                    row += 1
                if rows:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), out)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)

    typed = ", ".join(f"{p} double" for p in logs)
    first = saved(
        source.select("doc_id", "text").mapInArrow(
            listed_part,
            f"row long, doc_id long, n_tokens long, n_known long, base double, {typed}, "
            "rare array<binary>, times array<int>",
        ),
        "listed",
    )
    rare = first.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    log_base = F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1)))
    joined = rare.join(spelled, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_n_known"),
        F.sum(F.col("times") * log_base).alias("more_base"),
        *[F.sum(F.col("times") * F.col(p)).alias(f"more_{p}") for p in logs],
    )
    whole = first.drop("rare", "times").join(joined, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    by_class = [plus(p) + F.lit(prior) for p, prior in zip(logs, priors)]
    best = F.greatest(*by_class) if n_classes > 1 else by_class[0]
    summed = sum((F.pow(F.lit(10.0), p - best) for p in by_class[1:]), F.pow(F.lit(10.0), by_class[0] - best))
    return whole.select(
        "doc_id",
        (~train_fold("doc_id")).alias("held_out"),
        "n_tokens",
        plus("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        plus("base").alias("base_score"),
        (best + F.log10(summed)).alias("score"),
    )
