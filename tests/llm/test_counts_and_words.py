"""Token counts, spelling variants and collocations: the library, brute force, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paytally.llm import collocations, spelling_variants, token_counts
from paytally.llm.queries import SQL, QUERIES
from compare import connect, differences

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n long, word string, key long, id int, _part int, form string"
ODD = [
    None, "", " \t\n", "a<|endoftext|>b <|endoftext|><|startoftext|>", "<|ENDOFTEXT|>", "aaaa aaaaa " + "a" * 41,
    "ab" * 3000, "x" * 5000, "İstanbul K ﬁ ſ ß ẞ Σίσυφος ΣΑΣ 12½²", "日本語テキスト", "👩‍👩‍👧‍👦 🏳️‍🌈", "it's don't I'LL 'S 's''s",
    "a\x00b\x85c\x1cd\x1e e​f", "é É á̧ ́", "नमस्ते दुनिया",
]


@pytest.fixture
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, "another text of id three"), (None, "no id")]
    return spark.createDataFrame([(d, t, None if i % 3 else "en", "s", 1, "w", 2, 3, 4, "f") for i, (d, t) in enumerate(rows)], DOCS)


def test_token_counts_equal_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = token_counts.count(docs, TOKENIZER, limit=30)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for row in docs.collect():
        n = len(tokenizer.encode(row.text or "", add_special_tokens=False).ids)
        want.append((row.doc_id, len((row.text or "").encode()), n, n > 30))
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert token_counts.count(docs.where("false"), TOKENIZER).count() == 0


def test_token_counts_of_random_texts():
    draw = random.Random(1)
    pool = [*range(32, 127)] * 5 + [*range(0xA0, 0x180)] * 2 + [*range(0x300, 0x400), *range(0x4E00, 0x4E20)]
    pool += [0x1F600, 0xFB01, 0x2126, 0x212A, 0x10400, 0x1E900, 0xAC00, 0x1100, 0x1161]
    some = ["".join(map(chr, draw.choices(pool, k=draw.randint(1, 60)))) for _ in range(2000)]
    some += ["".join(draw.choices("ethinaors", k=draw.randint(1, 400))) for _ in range(200)]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [len(e.ids) for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    counter = token_counts.Counter(TOKENIZER)
    assert counter.count(some) == want
    # With hardly any memory, and in small parts, the counts are the same.
    assert token_counts.Counter(TOKENIZER, most_words=50, most_symbols=40).count(some, most_chars=500) == want


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(counts):
    near = {w: [x for x in counts if _near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("group_words", [32, 2, 0])
def test_variants_equal_brute_force(spark, group_words):
    draw = random.Random(group_words)
    counts = {"a": 4, "b": 2, "ab": 9, "é": 1, "日本": 3, "日": 7, "x" * 300: 5, "x" * 301: 11, "y" + "x" * 299: 2}
    for _ in range(400):
        word = "".join(draw.choices("abé", k=draw.randint(3, 7)))
        counts[word] = draw.choice([1, 2, 3, 4, 8, 16, 40])
    rows = [(w, n, "extra", False) for w, n in counts.items()]
    vocabulary = spark.createDataFrame(rows, "word string, n int, form string, longer boolean")
    found = spelling_variants.variants(vocabulary, group_words=group_words)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(counts) and set(got) == _variants(counts)


def test_words_of_texts_and_slips(spark, docs):
    texts = [(7, "Größe größe GRÖSSE straße-straße naïve×naïve école"), (7, "größe " * 50), (None, "größe größe größe")]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    want = Counter()
    for row in rows.collect():
        run = ""
        for c in (row.text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if row.doc_id is None else row.doc_id}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
                run = ""
    found = {r.word: r.n for r in spelling_variants.words(rows, 2, 4, slip_every=3).collect()}
    assert found == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2}
    empty = spelling_variants.words(docs.where("false"))
    assert empty.count() == 0 and spelling_variants.variants(empty).count() == 0


def _phrases(rows, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ",;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = defaultdict(list)
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        if len(words) == 2 and any(
            l == lang and len(w) == 3 and b >= least and 100 * b >= percent * a and words in (w[:2], w[1:])
            for (l, *w), b in f.items()
        ):
            continue
        cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])], k) for k in range(1, len(words))]
        score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for l, r, k in cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, i, p.decode(), -a, l, r, n[lang], -s)
        for lang, some in found.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1)
    }


def test_collocations_equal_brute_force(spark, docs):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        lang = draw.choice(["en", "de", None, "und", "x\ty"])
        words = [draw.choice(["a", "b", "c", "É", "éa", "b c", "w%d" % draw.randint(0, 30)]) for _ in range(60)]
        rows.append((lang, "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for w in words)))
    rows += [("en", "One, two one two. ONE\ttwo " * 30), ("en", None), (None, "")] + [("de", "same row again and again")] * 12
    table = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "key long, text string, lang string, n int")
    for options in ({}, {"block_phrases": 7, "block_words": 5}, {"top": 5, "least": 3, "covered_percent": 90}):
        found = collocations.mine(table, **options)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = _phrases(rows, options.get("least", 10), options.get("covered_percent", 50), options.get("top", 2000))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_trie_finds_what_it_holds(n):
    draw = np.random.default_rng(n)
    phrases = np.unique(draw.integers(1, 70000, (n, 3)) * (draw.random((n, 3)) < [1, 1, 0.5]), axis=0)
    trie = collocations.Trie.build(phrases, 3)
    codes = np.append(np.concatenate([np.append(p[p > 0], 0) for p in phrases] or [np.zeros(1, int)]), [0] * 3).astype(np.int32)
    accepted = {}
    for word, (at, value) in enumerate(trie.advance(codes, np.flatnonzero(codes), 3)):
        for a, v in zip(at[value >= 0], value[value >= 0]):
            assert (phrases[v][: word + 1] == codes[a : a + word + 1]).all() and not phrases[v][word + 1 :].any()
            accepted[v] = True
    assert len(accepted) == len(phrases)


def test_scores_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**12 + 1, 10**12 + 7, 10**12 + 13), (3, 3, 3), (999_999, 10**6, 10**6), (10, 10**15, 10**15), (2 * 10**12, 2 * 10**12, 2 * 10**12 + 1)]
    found = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in found.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (l * r) for a, l, r in rows]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == ""
