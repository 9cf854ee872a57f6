from collections import Counter

import corpus_pipeline
from corpus_rows import ODD_ROWS, documents
from test_similar import exact_classes

from vigilog.llm import mixing, quality
from vigilog.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf), "test-stage")
        before = [r.asDict() for r in docs.collect()]
        after = [r.asDict() for r in out.collect()]
        if name == "quality rules":
            fails = {r["doc_id"] for r in before if any(bad(r["text"]) for bad in RULES)}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - fails and fails
        elif name == "near duplicates":
            group = exact_classes([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == set(group.values())
        elif name == "repeated passages":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"] for r in after} <= set(texts)
            assert all(Counter(r["text"].split()) <= Counter(texts[r["doc_id"]].split()) for r in after)
        elif name == "source mix":
            words = Counter()
            for r in after:
                words[r["source"]] += len(r["text"].split())
            goals = {r["source"]: int(r["target"]) for r in mixing.mix(docs).collect()}
            assert dict(words) == {s: n for s, n in goals.items() if n}
        else:
            assert Counter(r["doc_id"] for r in after if r["start"] == 0) == Counter(r["doc_id"] for r in before)
        if name != "packing":
            assert out.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in after)
        docs = out
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(whole.collect()) == sorted(docs.collect())


RULES = [
    lambda t: len(t.split()) < 10,
    lambda t: 5 * sum(t.count(c) for c in "#*$%&|<>") > len(t.split()),
    lambda t: 100 * repeated_words(t.split()) > 20 * len(t.split()),
    lambda t: 2 * (len(x := [y for y in t.split("\n") if y.strip()]) - len(set(x))) > len(x),
    lambda t: sum(map(len, t.split())) > 40 * len(t.split()),
]


def repeated_words(words):
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    return len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for rows in (odd, none):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = saved(stage(spark, docs, ""), "test-stage")
            assert out.columns == rows.columns
            docs = out
        n = corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
        assert (n > 0) == (rows is odd)
    for _, stage in corpus_pipeline.STAGES:  # each by itself as well
        stage(spark, odd, "").count()
    assert quality.ledger(odd)[0].count() == len(ODD_ROWS) and documents
