import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_rows import ODD_ROWS

from vigilog.llm import lm, toxicity
from vigilog.llm.html_text import extracted, main_text
from vigilog.llm.queries import QUERIES
from vigilog.llm.words import Words


def test_main_text_of_every_page(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op1_density_text"](spark, sf).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        inner = re.sub(r"</?b>", "", page[page.index("<article>") + 9:page.index("</article>")])
        assert got[k]["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[k]["n_chars"] == len(got[k]["text"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; text\n\n only", "plain & text only"), ("<a", ""), ("1 < 2", "1 < 2"),
    ("<p>a<p>b <script>var x='<p>'</script>c", "a b c"), ("<div>x</div><div>x</div>", "x x"), ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<main><p>One <i>t</i>wo</p><aside>no</aside><p>three</main><footer>no</footer>", "One two three"),
    ("<body><header>Site</header><article><header><h1>T</h1></header><p>Text</p></article><div class='cookie-notice'>We use</div>", "T Text"),
    ("<div id=content><p>" + "Long words that matter here. " * 5 + "</p><p>More of them, and more.</p></div><div class='comments'><p>" + "Reader. " * 90 + "</div>",
     "Long words that matter here. " * 5 + "More of them, and more."),
    ("<div><h2>T</h2><p>" + "Some long text here. " * 9 + "</p></div><ul><li><a href=x>one link</a></li><li><a href=y>two</a></li></ul>", "T " + ("Some long text here. " * 9).strip()),
    ("<form>no<input></form><p hidden>no</p><p style='display: none'>no</p><p>yes<br>it is", "yes it is"),
])
def test_main_text_of_small_pages(page, text):
    assert main_text(page) == text


def test_hostile_pages_take_linear_time(spark):
    for page in ("<div>" * 50_000, '<p "' * 50_000, "<a '" * 50_000 + ">", "</x>" * 50_000 + "<script>" * 500, "<b>" * 50_000 + "</i>" * 50_000, "<a>" * 20_000 + "<p>" * 20_000):
        main_text(page + "end")
    df = spark.createDataFrame([(1, None, "t"), (2, "<p>x", "t"), (2, "<p>x", "t")], "page_id long, html string, text string")
    assert [r[0] for r in df.select(extracted(df["html"])).collect()] == ["", "x", "x"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_convolution_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    tried = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(p for _, p, _ in tried) <= sum(p and y for y, p, _ in tried) + 1
    toxic, clean = ([s for y, _, s in tried if y == k] for k in (1, 0))
    assert np.mean([t > c for t in toxic for c in clean]) > 0.6


def test_convolution_finds_a_planted_pair_of_words():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(600):
        words = [f"w{n}" for n in rng.integers(0, 60, rng.integers(5, 60))]
        if k % 4 == 0:
            at = rng.integers(0, len(words))
            words[at:at] = ["Bad,", "word."]
        elif k % 4 == 1:
            words += ["word"] + words[:3] + ["bad"]
        texts.append(" ".join(words))
        labels.append(k % 4 == 0)
    labels = np.array(labels, np.float32)
    model = toxicity.fit([toxicity.buckets(t) for t in texts[:400]], labels[:400])
    scores = model.scores(texts[400:])
    assert ((scores >= 0.5) == (labels[400:] == 1)).mean() > 0.95
    long = " ".join(["w1"] * 250_000 + ["bad", "word"] + ["w2"] * 10)
    assert model.scores([long])[0] >= 0.5 > model.scores([None, ""])[0]
    assert np.allclose(model.scores(texts[400:410]), [model.scores([t])[0] for t in texts[400:410]])


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, None), (None, 1, 1), (9, 1, 1), (6, 0, 0), (8, 0, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.classified(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert {r["score"] for r in toxicity.classified(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classified(none, labels).count() == 0


def test_language_model_counts_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    words = {d: t.encode().lower().split() for d, t in docs.items()}
    counts = Counter(w for d in docs if not held[d] for w in words[d])
    ends = sum(not h for h in held.values())
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    base, score = 0.0, 0.0
    for r in QUERIES["op2_recurrent_score"](spark, sf).collect():
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own) + 1, total)
        assert r["n_known"] == sum(w in counts for w in own) + 1
        want = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own) + math.log10((ends + 1) / (total + kinds + 1))
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
        if r["held_out"]:
            base += r["base_score"]
            score += r["score"]
    assert score > 0.95 * base  # both negative: a better log-likelihood on texts it has not seen


def small_book():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(1, 1 << 60, 30).astype(np.uint64))
    book = lm.Lexicon(hashes, np.full(30, 5), np.arange(1, 31), 9, 200, 40, np.full(lm._SHAPES, 3.0), np.full(lm._SHAPES, 2.0), np.full(lm._SHAPES, 0.5))
    book.members = [np.arange(0, 1), np.arange(1, 11), np.arange(11, 31)]
    book.class_of = np.repeat([0, 1, 2], [1, 10, 20])
    book.weight = np.full(31, 5.0)
    return book


def test_network_is_a_distribution_and_its_gradients_are_right():
    net = lm.Network(small_book())
    every = np.arange(net.words + lm._SHAPES)
    h = np.repeat(np.random.default_rng(1).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), len(every), axis=0)
    assert math.isclose(np.exp(net.log_parts(h, every)).sum(), 1, rel_tol=1e-4)
    # A word's shares of its shape class, with all unseen words, sum to one.
    book = net.book
    share = 10 ** book.shares(np.array([0, 0, 0]), np.array([2, 1, 0]))
    assert math.isclose(share.sum(), 1, rel_tol=1e-9)
    # One step against differences of the loss.
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, net.words + lm._SHAPES, lm.STEPS) for _ in range(lm.LANES)]
    loss = lambda n: -sum(n.score(texts)) * math.log(10) / (lm.STEPS * lm.LANES)
    big = 1e8  # with huge squares, a step is the gradient times rate / sqrt(squares)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    moved = lm.Network(small_book())
    for name in net.NAMES:
        setattr(moved, name, getattr(net, name).copy())
    moved.train(texts, math.sqrt(big), [np.full(p.shape, big) for p in moved.parameters()])
    for name in net.NAMES:
        mine, grad = getattr(net, name), getattr(net, name) - getattr(moved, name)
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        eps = 1e-4
        mine[at] += eps
        up = loss(net)
        mine[at] -= 2 * eps
        down = loss(net)
        mine[at] += eps
        assert math.isclose((up - down) / (2 * eps), grad[at], rel_tol=0.05, abs_tol=1e-5), name


def test_state_runs_through_whole_texts():
    net = lm.Network(small_book())
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, n) for n in (1, 700, 3, 50)]
    h, last, total = np.zeros((1, lm.HIDDEN), np.float32), 0, 0.0
    for s in texts[1].tolist():
        h = net.step(np.array([last]), h)[0]
        total += float(net.log_parts(h, np.array([s]))[0])
        last = s
    assert math.isclose(net.score(texts)[1], total / math.log(10), rel_tol=1e-4)


def test_language_model_of_odd_rows(spark, odd, none):
    rows = lm.scored(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    twice = [r for r in rows if r["doc_id"] == 5]
    assert len(twice) == 2 and math.isclose(twice[0]["score"], twice[1]["score"]) and math.isclose(twice[0]["base_score"], twice[1]["base_score"])
    assert all(math.isfinite(r["score"]) and r["n_known"] <= r["n_tokens"] for r in rows)
    assert lm.scored(none).count() == 0
    unseen = odd.where("doc_id = 10")  # crc32 leaves another remainder, or there is nothing to learn from
    assert all(math.isfinite(r["score"]) for r in lm.scored(unseen).collect())


def test_word_arrays_match_words(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", "A\x0bb\x1c c"]
    words = Words(texts)
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)] == plain
    assert len(set(words.hash.tolist())) == len(set(plain)) and len({(h, w) for h, w in zip(words.hash.tolist(), plain)}) == len(set(plain))


def test_every_training_document_is_learned_from_once(spark):
    from pyspark.sql import functions as F

    from vigilog.llm import lm
    docs = spark.range(200).select(F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 7 == 2).alias("held_out")).withColumn("text_hash", F.xxhash64("text"))
    met = [r["text"] for k in range(lm.ROUNDS) for r in lm.round_texts(docs, k).collect()]
    assert sorted(met) == sorted(f"text {k}" for k in range(200) if k % 7 != 2)


@pytest.mark.parametrize("name", ["content has-sidebar", "content no-sidebar", "post-with-comments", "social-article", "share-prices", "search-result-page", "main-content"])
def test_words_in_names_of_wrappers_do_not_lose_the_article(name):
    said = [f"Sentence {k} of an article that goes on for a while about rivers and ferries." for k in range(8)]
    text = "".join(f"<p>{t}</p>" for t in said)
    page = (f"<body><nav><a href=/>Home</a></nav><div class='{name}'><h1>Title</h1>{text}<div class='sidebar'>Most read</div>"
            "<div id='comments'><p>Nice one, I liked it a lot and said so.</p></div></div><footer>Imprint</footer></body>")
    assert main_text(page) == " ".join(["Title", *said])
    # Without the wrapper's name nothing else changes.
    assert main_text(page.replace(f" class='{name}'", "")) == " ".join(["Title", *said])


def test_long_comments_stay_out():
    article = "".join(f"<p>Line {k} of the article about the old bridge over the river.</p>" for k in range(4))
    comments = "".join(f"<div class='comment'><p>Comment {k}: I do not agree with any of this at all, sorry.</p></div>" for k in range(12))
    got = main_text(f"<body><div>{article}</div><div class='comments'>{comments}</div></body>")
    assert "Comment" not in got and got.count("Line") == 4
