"""The operators as registered queries over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paytally.llm import (
    collocations,
    decontaminate,
    html_text,
    lattice,
    licence,
    mixing,
    neighbours,
    quality,
    simhash,
    spelling_variants,
    token_counts,
    token_shards,
    toxicity,
)
from paytally.llm.common import ship, table
from paytally.session import shared_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PIECES = "piece_bpe_32k.model"


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = shared_dir(spark, "token-shards")
    tokenizer = public_tokenizers.path(TOKENIZER)
    token_shards.write(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return token_shards.documents(spark, path)


def op2_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licence.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.summary(table(spark, sf_dir, "documents"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    words = spelling_variants.words(table(spark, sf_dir, "documents"), slip_every=97)
    return spelling_variants.variants(words)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_shards,
        op2_licence,
        op3_toxicity,
        op4_simhash,
        op5_neighbours,
        op6_html_text,
        op7_quality,
        op8_mixing,
        op9_lattice,
        op10_decontaminate,
        op11_token_counts,
        op12_spelling_variants,
        op13_collocations,
    )
}

SQL: dict[str, str] = {
    "op8_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS place
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
            FROM sized GROUP BY source
        ), weighted AS (
            SELECT *, [5, 2, 1][turn + 1] AS weight, source_size * 3 AS most FROM sources
        ), leveled AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                (sum(source_size) OVER () - coalesce(sum(most) OVER (
                    ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
            FROM weighted
        ), final AS (
            SELECT min_by(level, CAST(most AS DOUBLE) / weight) FILTER (most > level * weight) AS level FROM leveled
        ), goals AS (
            SELECT l.source, l.turn, l.source_size, l.total,
                CAST(CASE WHEN l.most > l.level * l.weight THEN l.weight * f.level ELSE l.most END AS DOUBLE) AS target
            FROM leveled l, final f
        ), placed AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word
            FROM sized
        ), copied AS (
            SELECT p.doc_id, p.size, g.source_size, g.target, g.turn, g.total,
                least(p.first_word / g.target, 1.0) AS share,
                CASE WHEN g.source_size > 0 THEN CAST(least(greatest(
                    floor((g.target - p.first_word - p.size / 2) / g.source_size) + 1, 0), 3) AS INTEGER) ELSE 0 END AS copies
            FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
            CASE WHEN copies = 0 THEN -1 ELSE CAST(floor(total * CASE turn
                WHEN 0 THEN CASE WHEN share <= 1.0
                    THEN (sqrt(greatest(2.25 + -2.0 * share, 0.0)) - 1.5) / -1.0 ELSE 1.0 END
                WHEN 1 THEN share
                ELSE (sqrt(greatest(0.25 + 2.0 * share, 0.0)) - 0.5) / 1.0 END) AS BIGINT) END AS position
        FROM copied
    """,
    "op10_decontaminate": r"""
        WITH alphabet AS (
            SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower
        ), doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents, alphabet
        ), item_words AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), upper, lower),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark, alphabet
        ), sized_items AS (
            SELECT item, words, least(len(words), 10) AS size FROM item_words WHERE len(words) > 0
        ), item_windows AS (
            SELECT item, size, unnest(list_transform(range(1, len(words) - size + 2),
                lambda i: array_to_string(words[i:i + size - 1], ' '))) AS gram
            FROM sized_items
        ), doc_windows AS (
            SELECT doc_id, size, unnest(list_transform(range(1, len(words) - size + 2),
                lambda i: {'first': i, 'gram': array_to_string(words[i:i + size - 1], ' ')}), recursive := true)
            FROM doc_words, (SELECT DISTINCT size FROM sized_items) WHERE len(words) >= size
        ), found AS (
            SELECT d.doc_id, d.first, d.size, w.item FROM doc_windows d JOIN item_windows w USING (size, gram)
        ), hit AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(first, first + size)) AS word FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
            FROM documents
        ), counted AS (
            SELECT doc, run, count(*) AS n FROM runs GROUP BY doc, run
        ), bytes AS (  -- of UTF-8; all code points are below 256
            SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)]
                    ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
            FROM counted
        ), digests AS (  -- CRC-32 bit by bit: each byte is followed by eight shifts
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes,
                lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
            FROM bytes
        ), slipped AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
                || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
            FROM digests
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), shortened AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other FROM shortened a JOIN shortened b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT s.word, w.word FROM shortened s JOIN words w ON s.rest = w.word
            UNION SELECT w.word, s.word FROM shortened s JOIN words w ON s.rest = w.word
        ), best AS (
            SELECT near.word, count(*) AS n_near, min({'least': -o.n, 'word': other}) AS best
            FROM near JOIN words o ON o.word = other GROUP BY near.word
        ), formed AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
                CASE WHEN -b.best.least >= 2 * w.n THEN b.best.word END AS form,
                CASE WHEN -b.best.least >= 2 * w.n THEN -b.best.least END AS form_n
            FROM words w LEFT JOIN best b USING (word)
        ), followed AS (
            SELECT word, word AS at FROM formed
            UNION ALL SELECT c.word, f.form FROM followed c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
        ), roots AS (
            SELECT c.word, c.at AS root FROM followed c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)
        ), one AS (
            SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(words) AS w FROM pieces) GROUP BY lang, w
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
        ), two AS (
            SELECT lang, g.w1, g.w2, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(words)),
                lambda i: {'w1': words[i], 'w2': words[i + 1]})) AS g FROM pieces)
            GROUP BY lang, g.w1, g.w2 HAVING count(*) >= 10
        ), three AS (
            SELECT lang, g.w1, g.w2, g.w3, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(words) - 1),
                lambda i: {'w1': words[i], 'w2': words[i + 1], 'w3': words[i + 2]})) AS g FROM pieces)
            GROUP BY lang, g.w1, g.w2, g.w3 HAVING count(*) >= 10
        ), longest AS (
            SELECT lang, w1, w2, max(f) AS f FROM (
                SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY lang, w1, w2
        ), cuts AS (
            SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one y ON y.lang = t.lang AND y.w = t.w2
            LEFT JOIN longest m ON m.lang = t.lang AND m.w1 = t.w1 AND m.w2 = t.w2
            WHERE m.f IS NULL OR 100 * m.f < 50 * t.f
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
            FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1
            JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
            FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
            JOIN one y ON y.lang = t.lang AND y.w = t.w3
        ), scored AS (
            SELECT lang, phrase, a, l, r, k,
                CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score
            FROM cuts
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
