"""The operators on small inputs: nulls, empty and odd rows, ties, clashing columns, brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paytally.llm import decontaminate, html_text, lattice, licence, mixing, neighbours, quality, simhash
from paytally.llm import token_shards, toxicity
from paytally.llm.common import alnum_words
from paytally.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_words long, size int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "alpha beta " * 3000


@pytest.fixture
def docs(spark):
    rows = [
        (1, "One two three. Isn't 1 of 11, é, ½?", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, LONG, "de", "b"),
        (4, LONG, "de", "b"),
        (None, "a text with <|endoftext|> in it", "en", None),
    ]
    return spark.createDataFrame([(*r, 7, 7) for r in rows], DOCS)


@pytest.fixture
def none(docs):
    return docs.where("false")


def test_token_files_round_trip(spark, docs, none):
    path = shared_dir(spark, "t")
    token_shards.write(docs, path, TOKENIZER, block_ids=50)
    found = [tuple(r) for r in token_shards.documents(spark, path).orderBy("start").collect()]
    tokenizer, start, want, every = Tokenizer.from_file(TOKENIZER), 0, [], []
    for row in docs.orderBy(F.asc_nulls_first("doc_id")).collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1]
        want.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, every = start + len(ids), every + ids
    assert found == want
    assert token_shards.token_range(spark, path, 5, 300).tolist() == every[5:305]
    empty = shared_dir(spark, "t")
    token_shards.write(none, empty, TOKENIZER)
    assert token_shards.documents(spark, empty).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_unpack_reads_anywhere(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype(np.uint32)
    packed = token_shards.pack(ids, bits)
    assert len(packed) == (777 * bits + 7) // 8
    assert (token_shards.unpack(packed, bits, 100, 600) == ids[100:700]).all()


def test_licence_places(spark, docs, none):
    rows = [(9, "All rights reserved. CC BY-NC 4.0, all rights reserved")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    found = licence.scan(docs.select("doc_id", "text").unionByName(more)).where("doc_id = 9").first()
    assert (found.n_base, found.first_word, found.last_word) == (3, 0, 8)
    assert (found.base_labels, found.labels, found.score) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0)
    assert licence.scan(docs).where("labels <> ''").count() == 0
    assert licence.scan(none).count() == 0


def test_toxicity_on_odd_rows(spark, docs, none):
    texts = [(i, "you are a dreadful zorb" if i % 2 else "have a pleasant walk", i % 2) for i in range(40)]
    known = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    fitted = toxicity.fit(known, known)
    scores = {r.doc_id: r.score for r in toxicity.score(known, fitted).collect()}
    assert min(scores[i] for i in scores if i % 2) > max(scores[i] for i in scores if not i % 2)
    assert toxicity.score(docs, fitted).where("score between 0 and 1").count() == 6
    assert toxicity.score(none, toxicity.fit(none, known)).count() == 0
    assert toxicity.without_toxic(docs, fitted).columns == docs.columns


def test_near_duplicates_equal_brute_force(spark, docs, none):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(i, base.replace("w7 ", f"x{i} ") if i < 12 else f"other {i} text of its own {i}") for i in range(30)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in rows.collect()]
    root = list(range(len(prints)))
    for _ in root:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((prints[i][0] for i in range(len(root)) if root[i] == r and prints[i][0] is not None), default=None)
             for r in root}
    want = sorted((str(d), f"{p:016x}", str(least[root[i]])) for i, (d, p) in enumerate(prints))
    for group_rows in (8192, 4):
        found = simhash.near_duplicates(rows, group_rows=group_rows).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    assert simhash.near_duplicates(none).count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    x = np.random.default_rng(0).standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [1.0]), (None, [1.0] * 16), (680, [None] * 16)]
    found = neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), block_rows=200)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    want = set()
    for q in range(0, 600, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-score)[:20]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(empty).count() == 0


def test_neighbours_of_few_rows_ties_repeats_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 1.0]), (2, [0.5, -1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (0, [9.0, 0.0])]
    short = [(20, [1.0]), (5, [2.0]), (40, [3.0]), (60, [1.0, 1.0, 1.0])]
    both = spark.createDataFrame(rows + short, "vec_id long, embedding array<double>")
    extra = both.selectExpr("*", "'x' as v", "1L as dim", "2L as longest", "3 as block", "4 as part", "5 as rank")
    found = neighbours.nearest(extra).orderBy("query_id", "rank").collect()
    # An id that repeats asks once, with its smaller vector; equal scores go by the smaller id; lengths are searched apart.
    assert [tuple(r) for r in found] == [
        (0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 2, 0.5), (0, 4, 3, 0.5),
        (20, 1, 40, 3.0), (20, 2, 5, 2.0), (40, 1, 5, 6.0), (40, 2, 20, 3.0),
    ]


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; small</h1><p>First  <b>par</b>agraph "
        "with enough words to be the text of an article, surely.<p>Second&nbsp;one<br>here.</article>"
        "<div id=comments><p>A reader says so</p></div><footer>&copy; us</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    want = "Big & small First paragraph with enough words to be the text of an article, surely. Second one here."
    assert (found[1].text, found[1].n_chars) == (want, len(want))
    assert found[2].text == found[None].text == ""


def test_quality_trees_split_and_score(spark, docs, none):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality.boost(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (3, None)], "doc_id long, quality int")
    fitted = quality.fit(docs, labels)
    assert quality.score(docs, fitted).where("score between 0 and 1").count() == 6
    assert quality.score(none, fitted).count() == 0


def test_mix_reaches_its_targets(spark, docs, none):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "tiny").otherwise("mid").alias("source"),
    )
    found = mixing.summary(rows).toPandas()
    whole = found.groupby("source_size").agg(target=("target", "max"), taken=("taken", "sum"))
    assert abs(whole.target.sum() - found["size"].sum()) < 1e-6 * found["size"].sum()
    assert ((whole.target - whole.taken).abs() <= 18).all()
    assert (found.taken <= 3 * found["size"]).all()
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == found.copies.sum()
    assert mixing.summary(docs).count() == 6 and mixing.summary(none).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_lattice_sums_all_segmentations(spark, docs, none):
    pieces = ["▁a", "b", "▁ab", "▁", "a"]
    scores = np.array([[-1.0, -4.0], [-2.0, -1.0], [-2.5, -3.0], [-3.0, -1.5], [-1.5, -0.5]])
    byte_scores = np.full((256, 2), [-9.0, -8.0])
    model = lattice.Spelling(pieces, scores, byte_scores, np.array([-0.5, -0.25]))

    def spelled(text, of):  # every segmentation, one after another
        if not text:
            return 1.0
        one = math.exp(byte_scores[0, of] * len(text[0].encode())) * spelled(text[1:], of)
        return one + sum(
            math.exp(scores[i, of]) * spelled(text[len(p) :], of) for i, p in enumerate(pieces) if text.startswith(p)
        )

    words = ["ab", "", "ba", "é", "abab", "xaab", "ab"]
    want = [[math.log(spelled("▁" + w, of)) + (-0.5, -0.25)[of] for of in (0, 1)] for w in words]
    assert model.log_probabilities(words, [0, 1]) == pytest.approx(np.array(want), abs=1e-9)
    assert model.log_probabilities(words, [1])[:, 0] == pytest.approx(np.array(want)[:, 1], abs=1e-9)
    assert model.log_probabilities([], [0]).shape == (0, 1)
    found = lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"), frequent=1).collect()
    assert len(found) == 6 and all(r.score < 0 and r.base_score < 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (2, 3)} == {1}
    assert lattice.score(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_lattice_scores_equal_brute_force(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(11)
    words = ["river", "stone", "rivers", "ice", "ab", "straße", "x9"]
    rows = [(i, " ".join(rng.choice(words, i % 12, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05]))) for i in range(1, 60)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(7, "New word here"), (7, "river ZZ"), (None, "stone once"), (70, None), (held[0], "unseen Unseen iced é")]
    train = [t or "" for i, t in rows if i not in held]
    count = Counter(w for t in train for w in t.lower().split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    freed = discount * len(count) / n
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = np.zeros(model.get_piece_size() + 1)
    for word in count:
        for i in model.encode(word):
            kinds[i] += 1
        kinds[-1] += 1
    log_of = lambda k: np.log((k + 0.1) / (k + 0.1).sum())
    seen, unseen = log_of(kinds), log_of(kinds + kinds / kinds.sum() * lattice.PRIOR_PIECES)
    place = {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}

    def spelled(text, scores):
        ways = [1.0]
        for end in range(1, len(text) + 1):
            way = ways[-1] * math.exp(sum(scores[bytes_[b]] for b in text[end - 1].encode()))
            way += sum(ways[k] * math.exp(scores[place[text[k:end]]]) for k in range(end) if text[k:end] in place)
            ways.append(way)
        return ways[-1] * math.exp(scores[-1])

    def probability(word):
        own = max(count[word] - discount, 0) / n
        return own + freed * (own + freed * spelled("▁" + word, seen if count[word] else unseen))

    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = []
    for i, text in rows:
        tokens = (text or "").lower().split()
        score = sum(math.log10(probability(w)) for w in tokens) + math.log10(len(train) / n)
        plain = sum(base(count[w]) for w in tokens) + base(len(train))
        want.append((i or -1, len(tokens) + 1, 1 + sum(w in count for w in tokens), n, round(plain, 6), round(score, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as c", "1L as row", "2 as z")
    for frequent in (0, 3, 200_000):  # the list and the join give the same
        found = lattice.score(docs, path, class_col=None, frequent=frequent).collect()
        got = [
            (r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found
        ]
        assert sorted(got) == sorted(want)


def test_contamination_equals_brute_force(spark, docs, none):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(str(i), text(n)) for i, n in enumerate((30, 12, 10, 4, 0, 25))] + [("6", None), ("7", "a b c a b c a b c a b")]
    items += [("1", text(11)), (None, text(12)), (None, "c c c c"), items[5]]  # ids that repeat, no id, a repeated row
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = spark.createDataFrame([(i, text(300) + " " + items[0][1]) for i in range(8)], "doc_id long, text string")
    windows = {}
    for name, t in items:
        words = alnum_words(t)
        size = min(10, len(words))
        for j in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[j : j + size]), set()).add(name)
    for block_words in (2_000_000, 30):
        found = {r.doc_id: r for r in decontaminate.report(rows, benchmark, block_words=block_words).collect()}
        for doc_id, t in rows.collect():
            words, hit, names = alnum_words(t), set(), set()
            for size in {len(w) for w in windows}:
                for j in range(len(words) - size + 1):
                    if tuple(words[j : j + size]) in windows:
                        hit.update(range(j, j + size))
                        names |= windows[tuple(words[j : j + size])] - {None}
            row = found[doc_id]
            assert (row.n_words, row.n_hit, row.n_items) == (len(words), len(hit), len(names))
            assert row.items_sha256 == decontaminate.items_digest(list(names))
    long_items = benchmark.where("item_id = '0'")
    cleaned = decontaminate.decontaminate(rows, long_items)
    assert decontaminate.report(cleaned, long_items).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == 6
    assert decontaminate.report(none, benchmark).count() == 0
    nothing = decontaminate.report(docs, benchmark.where("false")).collect()
    assert len(nothing) == 6 and not any(r.n_hit or r.n_items or r.contaminated for r in nothing)
    named = docs.withColumns({c: F.lit("x") for c in (decontaminate.HITS, decontaminate.ITEMS, decontaminate.WORDS)})
    for block_words in (2_000_000, 30):
        assert sorted(map(str, decontaminate.decontaminate(named, benchmark, block_words=block_words).collect())) == sorted(
            map(str, named.collect())
        )
    assert sorted(r[decontaminate.WORDS] for r in decontaminate.mark(named, benchmark).collect())[:2] == [0, 0]
    assert decontaminate.report(named, benchmark).count() == 6


@pytest.mark.parametrize("around", ["layout has-sidebar", "no-sidebar", "nav-open", "social-enabled"])
def test_main_text_inside_a_hinted_wrapper(around):
    body = "<p>The first long sentence of the text itself, with many words.</p><p>And the second one, no shorter than that.</p>"
    want = "The first long sentence of the text itself, with many words. And the second one, no shorter than that."
    side = "<div class='sidebar'><p>Other pages of this site</p></div><div class=share>Tell all your friends</div>"
    for inside in (f"<div class=row><article>{body}</article>{side}</div>", f"<div><div>{body}</div></div>{side}"):
        page = f"<html><body><div class='{around}'>{inside}</div><div id=comments><p>A reader</p></div></body></html>"
        assert html_text.main_text(page) == want


LEAD = "<p>An article begins with a first paragraph that is long enough to be its text, and to count.</p>"
LEAD_TEXT = "An article begins with a first paragraph that is long enough to be its text, and to count."


@pytest.mark.parametrize(
    "part, want",
    [
        ("<h2 id='related-work'>Related work</h2><p>Others did so.</p>", "Related work Others did so."),
        ("<h2 id=search>Search</h2><p>Trees are searched.</p>", "Search Trees are searched."),
        ("<p class='notice-period'>Three months are usual.</p>", "Three months are usual."),
        ("<section id='comments-on-method'><h2>Method</h2><p>It holds.</p></section>", "Method It holds."),
        ("<figure><img src=x><figcaption>Fig. 1: a tree</figcaption></figure>", "Fig. 1: a tree"),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p>", "So x=2 here."),
        ("<section id=search><p>" + "How one searches a tree. " * 5 + "</p></section>", ("How one searches a tree. " * 5).strip()),
        ("<div class='related-posts'><ul><li><a href=x>Another text</a></ul></div>", ""),
        ("<section id=comments><p>" + "A reader wrote all this. " * 20 + "</p></section>", ""),
        ("<div class='ad-slot-2'>Buy it</div><p class=ad>Buy this</p><div id=newsletter-signup>Mail</div>", ""),
        ("<div class='layout no-sidebar'><div class=row><p>Deep inside.</p><div class=share>Share</div></div></div>", "Deep inside."),
    ],
)
def test_main_text_keeps_the_article(part, want):
    whole = f"{LEAD_TEXT} {want}".strip()
    for page in ("<main><article>%s%s</article></main><p>Read on at our shop.</p>", "<article>%s%s</article>", "<div>%s%s</div>"):
        assert html_text.main_text("<body><nav>Home</nav>" + page % (LEAD, part) + "<footer>We</footer></body>") == whole


def test_extract_rows(spark):
    page = f"<article>{LEAD}" + "<p>More of it.</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, "v", "<p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 as n_chars")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = LEAD_TEXT + " More of it." * 20_000
    assert sorted((r.page_id, r.text) for r in found.collect()) == [(1, want), (1, want), (2, "")]
    assert html_text.extract(pages.where("false")).count() == 0


def test_neighbours_recall_beside_a_hot_vector(spark):
    x = np.random.default_rng(7).standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1::3] = x[1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(rows).collect():
        got.setdefault(r.query_id, []).append(r.score)
    for q in range(0, 4096, 20):
        score = np.delete(x @ x[q], q)
        assert (np.array(got[q]) >= np.sort(score)[-20] - 1e-12).sum() >= 16
