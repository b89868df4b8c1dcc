"""Licence scan by a positional rare-token index.

Templates are licence notices as word sequences. The index holds, for each template, only its words
of highest IDF over the scanned corpus, with their offsets. A file's occurrences of such words
propose places (template, start), one occurrence being enough: postings are joined by union, and
verification of each place replaces their intersection by relative position. A place counts if its words match the template's to the template's own degree and every
mandatory key phrase stands where the template has it. An exact template has its rarest word alone
as anchor: wherever it stands, that word does, so no place is missed.

Scale: two passes over the texts, no shuffle but of the document frequencies of licence words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import alnum_words, per_batch, texts

#: Phrases whose every place counts, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Template:
    """A notice. ``degree``: least share of its IDF that must match; 1 asks for every word."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    degree: float = 1.0
    base: bool = False


TEMPLATES = (
    *(Template(label, phrase, base=True) for phrase, label in BASE.items()),
    Template("mit", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
             "and associated documentation files", ("hereby granted free of charge",), 0.8),
    Template("apache-2.0", "the apache license version 2 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.8),
    Template("epl", "eclipse public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", ("source and binary forms",), 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
             "fee is hereby granted", ("with or without fee",), 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered",), 0.8),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
)
_ANCHORS = 4


@dataclass
class Index:
    """Postings of anchor words, and what is needed to verify a proposed place."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]
    words: list[list[bytes]] = field(init=False)
    keys: list[list[int]] = field(init=False)  # offsets of the words of the mandatory key phrases
    postings: dict[bytes, list[tuple[int, int]]] = field(init=False)

    def __post_init__(self):
        self.words = [alnum_words(t.text) for t in self.templates]
        self.keys = [_key_offsets(w, t.keys) for w, t in zip(self.words, self.templates)]
        self.postings = {}
        for number, (words, template) in enumerate(zip(self.words, self.templates)):
            anchors = 1 if template.degree >= 1 else _ANCHORS
            rarest = sorted(range(len(words)), key=lambda i: (-self.idf.get(words[i], 0.0), i))
            for offset in rarest[:anchors]:
                self.postings.setdefault(words[offset], []).append((number, offset))
        self.anchors = frozenset(self.postings)

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of IDF matched) of every place that holds, each once."""
        if self.anchors.isdisjoint(words):
            return []
        proposed = set()
        for at, word in enumerate(words):
            if word in self.postings:
                proposed.update((number, at - offset) for number, offset in self.postings[word])
        found = []
        for number, start in sorted(proposed):
            share = self._matched(words, number, start)
            if share >= self.templates[number].degree:
                found.append((number, start, min(1.0, share)))
        return found

    def _matched(self, words: list[bytes], number: int, start: int) -> float:
        template, size = self.words[number], len(words)
        hit = [0 <= start + i < size and words[start + i] == word for i, word in enumerate(template)]
        if all(hit):
            return 1.0
        if self.templates[number].degree >= 1 or not all(hit[i] for i in self.keys[number]):
            return 0.0
        weight = [self.idf.get(w, 0.0) for w in template]
        return sum(w for w, h in zip(weight, hit) if h) / max(sum(weight), 1e-9)


def _key_offsets(words: list[bytes], keys: Iterable[str]) -> list[int]:
    offsets: list[int] = []
    for key in map(alnum_words, keys):
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        offsets += range(start, start + len(key))
    return offsets


def build_index(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The index, weighted by how many documents hold each licence word; counts all documents."""
    vocabulary = frozenset(w for t in templates for w in alnum_words(t.text))
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(columns):
        seen: Counter = Counter()
        for text in columns["text"]:
            seen.update(vocabulary.intersection(alnum_words(text)))
        seen[b""] = len(columns["text"])  # no word is empty: the number of documents
        return {"word": list(seen), "n": list(seen.values())}

    counted = texts(docs, text=text_col).mapInArrow(per_batch(count, schema), "word binary, n long")
    n = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.get(b"", 0)
    return Index(templates, {w: math.log((total + 1) / (n.get(w, 0) + 0.5)) + 1e-6 for w in vocabulary})


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word`` are their
    smallest and largest start (null without one); ``score`` is the best place's matched share, 0
    without a place. A null or wordless text has no words and empty labels. Rows that repeat an id
    are each scanned; an empty table gives no rows. Only the two named columns are read.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, text_col, templates))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ]
    )

    def of(columns):
        rows = [_row(i, alnum_words(t), index.value) for i, t in zip(columns["doc_id"], columns["text"])]
        return dict(zip(schema.names, zip(*rows))) if rows else {name: [] for name in schema.names}

    source = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    return source.mapInArrow(
        per_batch(of, schema),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )


def _row(doc_id, words: list[bytes], index: Index) -> tuple:
    places = index.places(words)
    base = [(start, index.templates[k].label) for k, start, _ in places if index.templates[k].base]
    starts = [start for start, _ in base]
    return (
        doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in base})),
        ",".join(sorted({index.templates[k].label for k, _, _ in places})),
        max((share for _, _, share in places), default=0.0),
    )
