import zlib
from collections import Counter, defaultdict

import numpy as np
from corpus_rows import ODD_ROWS, PROSE, documents

from vigilog.llm import packing, topk
from vigilog.llm.queries import QUERIES

HARD = ["a<|endoftext|>b c <|startoftext|> É́ x", "it's IT'S ''s ﬁ ½ ² ǅ İstanbul ẞ ß STRASSE Ÿ ÿ ª º µ × ÷ a×b x\x1cy \x00 \x7f 12ab34",
        "~!@#$%^&*()[]{}_-+=|\\:;\"<>,.?/ 中文 한국어 🙂👍🏽 é́ ΑΣ Σ x y\u0085z", "", PROSE]


def reference_ids(texts):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(packing.vocabulary())
    return [np.array([*e.ids, packing.END_ID], "<u4").tobytes() for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def whole(rows, texts):
    """All ids lie in one piece each, sequences are gapless, and none is longer than a window."""
    wanted, got = Counter(reference_ids(texts)), Counter()
    parts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        parts[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, own in parts.items():
        copies = sum(s == 0 for s, _, _ in own)
        by_start = defaultdict(list)
        for s, ids, n in own:
            by_start[s].append((ids, n))
        assert copies
        if copies == 1:
            data = b"".join(by_start[s][0][0] for s in sorted(by_start))
            assert all(n == len(data) // 4 for v in by_start.values() for _, n in v)
            got[data] += 1
    assert not got - wanted
    for own in places.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return places


def test_word_by_word_ids_are_the_tokenizers(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + HARD
    coder = packing.WordTokenizer(packing.vocabulary())
    end = np.array([packing.END_ID], "<u4").tobytes()
    assert [coder.ids(t) + end for t in texts] == reference_ids(texts)


def test_packs_of_documents_are_whole_and_dense(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, keep_ids=True).collect()
    texts = [r["text"] for r in docs.collect()]
    places = whole(rows, texts)
    used = sum(r["length"] for r in rows)
    sizes = [sum(n for _, n in p) for p in places.values()]
    assert used == sum(len(i) // 4 for i in reference_ids(texts))
    assert used >= 0.97 * sum(s if s.bit_count() == 1 else packing.WINDOW for s in sizes)
    query = QUERIES["op7_window_packing"](spark, sf)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, query.collect())) == sorted(tuple(r[c] for c in query.columns) for r in rows)
    full = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs, keep_ids=True)).collect()}
    assert len(full) == len(places) and sum(len(r["ids"]) for r in full.values()) == 4 * used


def test_packs_of_odd_rows(spark, odd, none):
    rows = packing.pack(odd, keep_ids=True).collect()
    whole(rows, [t for _, t, _, _ in ODD_ROWS])
    assert sum(r["start"] == 0 for r in rows) == len(ODD_ROWS)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack(none).count() == 0


def test_least_squares_and_layout():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 3, (12, 40)).astype(float)
    want = np.where(rng.random(40) < 0.2, rng.integers(1, 50, 40), 0).astype(float)
    x = packing.nnls(a, a @ want)
    assert (x >= 0).all() and np.allclose(a @ x, a @ want, atol=1e-4)
    b = rng.normal(0, 5, 12)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-4 and abs(slope[x > 1e-9]).max(initial=0) < 1e-4
    assert packing.combinations(4) == [(4,), (3, 1), (2, 2), (2, 1, 1)]
    for counts in ({}, {256: 5}, {1: 1000}, {200: 7, 56: 7}, {150: 10}, {k: (k * 37) % 11 for k in range(1, 257)}, {100: 10 ** 9, 56: 10 ** 9, 3: 5}):
        placed = Counter()
        for sizes, n in packing.layout(counts):
            assert n > 0 and sum(sizes) <= 256
            for s in sizes:
                placed[s] += n
        assert placed == Counter({k: v for k, v in counts.items() if v})


def plain_top(rows, every, k):
    scaled = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    out = []
    for q in sorted(scaled):
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(scaled[q], v)), i) for i, v in scaled.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_search_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1 + k % 5, 12).astype(np.float32).tolist()) for k in range(-40, 600)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(2000, [0.0] * 12), (2100, [1e20] * 12)]
    bad = [(3000, None), (3100, [float("nan")] * 12), (3200, [None] * 12), (3300, [float("inf")] + [0.0] * 11), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad], "vec_id long, embedding array<float>, score string, longest string")
    fine = [r for r in rows if r[0] != 2100]
    got = sorted(map(tuple, topk.top_k(df.where("vec_id <> 2100 or vec_id is null")).collect()))
    assert got == sorted(plain_top(fine, 100, 10))
    huge = sorted(map(tuple, topk.top_k(df).collect()))
    assert len(huge) == len(plain_top(rows, 100, 10)) and {r[2] for r in huge if r[0] == 0 and r[3] > 2 ** 53} <= {2100}
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [0.25, 9.0]), (0, [1.0]), (100, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(few).collect())) == [
        (0, 1, 1, 524288), (0, 2, 2, 262144), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 0, 0), (100, 3, 1, 0), (100, 4, 2, 0)]
    assert topk.top_k(few.limit(0)).count() == 0


def test_query_blocks_for_all_stripes_are_not_broadcast(spark):
    # Their file is small, the copies that are read from it are 96 times as many.
    df = spark.range(3000).selectExpr("id as vec_id", "transform(sequence(1, 8), x -> cast(sin(id * x) as float)) as embedding")
    found = topk.top_k(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert found.count() == 300
