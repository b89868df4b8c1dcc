"""The stages of the corpus pipeline on small inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

import corpus_pipeline
from paytally.llm import mixing, near_copies
from paytally.session import shared_dir


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(150)] + ["the", "same", "words", "in", "every", "text"] * 3
        for copy in range(12):  # most copies differ from the base in 1 to 5 words, so they are similar by 0.72 to 0.95
            words = list(base)
            for at in rng.choice(150, copy % 6, replace=False):
                words[at] = f"x{rng.integers(1e9)}"
            texts.append(" ".join(words))
    texts += ["", " ", "a b", "A  b", "a b c"]
    rows = list(enumerate(texts))
    root, sets = list(range(len(rows))), [_shingles(t) for t in texts]
    for _ in range(len(rows)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[r] == r for r in root):
            break
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r for r in root})
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_tokens_are_in_training_order(spark):
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word "), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int"))).alias("text"),
        F.when(F.col("id") % 4 == 0, "few").when(F.col("id") % 4 == 1, "some").otherwise("most").alias("source"),
    )
    want = [r.doc_id for r in mixing.mix(docs).collect()]
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    shuffled = mixed.repartition(3, F.xxhash64("text"))
    found = corpus_pipeline.pack_tokens(spark, shuffled, "").orderBy("start").collect()
    assert [r.doc_id for r in found] == want != sorted(want)


def test_near_copies_of_rows_without_an_id_of_their_own(spark):
    one, two, three = (" ".join(f"{name}{i}" for i in range(30)) for name in "abc")
    rows = [(1, one, "x"), (1, two, "x"), (1, two, "x"), (2, two, "y"), (None, one, "z"), (None, three, "z"), (None, three, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = [(1, one, "x"), (1, two, "x"), (None, three, "z")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_parities_never_part_near_copies():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        apart = int(rng.integers(0, max(1, len(a) // 4)))
        b = np.unique(np.concatenate([a[apart:], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, apart + 1)))]))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            sizes = np.array([len(a)]), np.array([len(b)])
            assert near_copies._near_enough(near_copies.parity(a)[None], near_copies.parity(b)[None], *sizes).all()
            row = {"a": [1], "b": [2], "n": [len(a)], "other_n": [len(b)], "bits": [near_copies._wide_parity(a)],
                   "other_bits": [near_copies._wide_parity(b)]}
            assert next(near_copies._unlike(iter([pa.RecordBatch.from_pydict(row)]))).num_rows == 1


def test_stages_keep_columns_of_any_name(spark):
    names = ["_row", "row", "_n_words", "_hit_spans", "_hit_items", "training_position", "key", "class", "at", "number"]
    texts = ["one two three four five six seven " * 3, "", None, "quite another text of some words here", "quite another text of some words here"]
    rows = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"{n} string" for n in names)]))
    docs.sparkSession.createDataFrame([("i", "a b c d e f g h i j k")], "item_id string, text string").write.mode(
        "overwrite").parquet(f"{(folder := shared_dir(spark, 'clash'))}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]
    clean = corpus_pipeline.remove_benchmark(spark, docs, folder)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns[:-1] == docs.columns and mixed.columns[-1] == "training_position_"
    assert corpus_pipeline.pack_tokens(spark, mixed, folder).count() == mixed.count() > 0
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.remove_benchmark, corpus_pipeline.mix_sources):
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_near_copies_are_proposed_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_open", lambda batches: (b.slice(0, 0).drop_columns(["label"]) for b in batches))
    base = [f"w{i}" for i in range(300)]
    near, far = [*base[:299], "x"], [f"v{i}" for i in range(300)]
    texts = [" ".join(words) for words in (base, near, [*base, *base], far)]  # repeats: equal sets almost
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r["class"] for r in near_copies.classes(docs).collect()}
    keys = [r.key for r in docs.orderBy("doc_id").select(near_copies.text_key("text").alias("key")).collect()]
    base_class, near_class, twice_class, far_class = (found[k] for k in keys)
    assert base_class == near_class == twice_class != far_class
