"""A corpus from raw documents to packed training tokens, stage by stage.

Each stage reads what the stage before kept. All but the last return the columns of documents, to
which mixing adds the position in training that orders the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.llm import decontaminate, mixing, near_copies, token_shards, toxicity
from paytally.llm.common import saved, ship, table
from paytally.llm.queries import END_ID, TOKENIZER
from paytally.session import shared_dir


POSITION = "training_position"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays, null ids last.

    Texts whose five-word shingles are similar by 0.8 or more are near copies; op4's contract is its own.
    Rows are known by a digest of all their columns, so rows that share an id, or have none, are
    compared by their texts like any others. Among equal ids the smallest digest stays.
    """
    ship(spark)
    row = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    keys = docs.select("doc_id", row.alias("row"), near_copies.text_key("text").alias("key"))
    ordered = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    least = keys.join(near_copies.classes(docs), "key").groupBy("class").agg(F.min(ordered).alias("least"))
    # Whole rows travel as one struct, so their column names cannot clash with the plan's.
    rows = docs.select(row.alias("row"), F.struct(*docs.columns).alias("document"))
    kept = rows.join(least.select("least.row"), "row", "left_semi")
    return kept.dropDuplicates(["row"]).select("document.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; texts that are mostly benchmark go.

    Null and empty texts, repeated rows and rows without an id stay as they are.
    """
    ship(spark)
    # Other columns go through under names of their own: theirs may be those of the scan.
    plain = [c if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)]
    cleaned = decontaminate.decontaminate(docs.toDF(*plain), table(spark, sf_dir, "benchmark"))
    return cleaned.toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them, each copy with its position in the curriculum.

    The position is the last column; a column of documents that has its name already keeps it. Null and empty
    texts count no words and are placed like others; repeated rows are documents of their own.
    """
    ship(spark)
    name = POSITION
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return mixing.mix(docs, position_col=name)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the last column, the mix's position; one row per document copy, read back."""
    ship(spark)
    path = shared_dir(spark, "corpus-tokens")
    token_shards.write(docs, path, public_tokenizers.path(TOKENIZER), END_ID, order_col=docs.columns[-1])
    return token_shards.documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("tokens", pack_tokens),
]

#: SQL can express neither the models of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
