import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from corpus_rows import ODD_ROWS, PROSE, documents

from vigilog.llm import passages, simhash
from vigilog.llm.common import WORDS
from vigilog.llm.components import components
from vigilog.llm.queries import QUERIES


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)] + [(2000, 2001 + k) for k in range(500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(links, {n for link in links for n in link})
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_anchors_meet_within_two_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    x[0] = 0
    y = x.copy()
    for k in range(400):
        for bit in rng.choice(64, k % 3, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    balls = []
    for points in (x, y):
        ball = defaultdict(set)
        for anchor, point in zip(*simhash.anchors(points)):
            ball[int(point)].add(int(anchor))
            assert (int(anchor) ^ int(point) & ~1).bit_count() <= 2
        balls.append(ball)
    assert all(balls[0][int(a)] & balls[1][int(b)] for a, b in zip(x, y))
    assert max(map(len, balls[0].values())) <= 32


def test_simhash_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(links, ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_anchors"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_simhash_of_odd_rows(spark, odd, none):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == len(ODD_ROWS)
    by_id = {d: (f, c) for d, f, c in got if d is not None}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert by_id[4][1] == by_id[5][1] == 4 and by_id[10][1] == 9
    assert {c for d, _, c in got if d is None} == {1, 4}
    left = [r["doc_id"] for r in simhash.deduplicated(odd).collect()]
    assert sorted(left) == [1, 4, 6, 7, 8, 9, 11]
    assert simhash.near_duplicates(none).count() == simhash.deduplicated(none).count() == 0
    twice = documents(spark, [(5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (None, "alone here", "en", "a"), (None, "other words stand", "en", "a")])
    assert sorted((r["doc_id"] or 0) for r in simhash.deduplicated(twice).collect()) == [0, 0, 5]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(9)
    clean = [(k, " ".join(sentence(rng, rng.randint(3, 12)) for _ in range(12)) + "\nLicensed to all.", "en", "a") for k in range(60)]
    passage = " ".join(sentence(rng, 8) for _ in range(9))
    hosts = []
    for k in range(100, 130):
        words = " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(8)).split()
        at = rng.randrange(len(words))
        hosts.append((k, " ".join(words[:at] + passage.split() + words[at:]), "en", "a"))
    long_line = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(120))
    near = [(200, long_line, "en", "a"), (201, long_line.replace(" ", " x ", 1), "en", "a"), (202, " ".join(long_line.split()[:115]), "en", "a")]
    found = passages.repeated(documents(spark, clean + hosts + near)).collect()
    gone = defaultdict(int)
    for r in found:
        gone[r["doc_id"]] += r["n_words"]
        assert r["kept_doc_id"] is not None and r["kept_doc_id"] < r["doc_id"]
    assert set(gone) == set(range(101, 130)) | {201, 202}
    assert all(n >= 60 for d, n in gone.items())
    left = {r["doc_id"]: r["text"] for r in passages.removed(documents(spark, clean + hosts + near)).collect()}
    assert all(left[d] == t for d, t, *_ in clean) and left[100] == hosts[0][1]
    assert sum(" ".join(passage.split()[8:]) in t for t in left.values()) == 1
    assert 201 not in left and 202 not in left


def test_links_by_rare_shingles_are_all_links():
    rng = random.Random(1)
    for _ in range(200):
        base = [frozenset(rng.sample(range(40), rng.randint(1, 20))) for _ in range(4)]
        sets = list({frozenset(rng.choice(base) ^ ({rng.randrange(40)} if rng.random() < 0.7 else set())) for _ in range(12)} - {frozenset()})
        if len(sets) < 2:
            continue
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if passages.jaccard(sets[i], sets[j]) >= passages.SIMILARITY]
        assert roots(pairs, range(len(sets))) == roots(passages.linked_members(sets), range(len(sets)))


def test_variants_of_one_template_take_time_in_proportion():
    template = [f"w{k}" for k in range(50)]
    sets = [passages.shingle_set(" ".join(template[:k % 50] + [f"x{k}"] + template[k % 50 + 1:])) for k in range(50_000)]
    begin = time.process_time()
    links = passages.linked_members(sets)
    assert time.process_time() - begin < 20
    few = roots([(i, j) for i in range(100) for j in range(i) if passages.jaccard(sets[i], sets[j]) >= passages.SIMILARITY], range(100))
    got = roots(links, range(len(sets)))
    assert all(got[k] == few[k % 50] for k in range(len(sets))) and len(set(got.values())) == 41


def test_hot_anchors_keep_one_place_in_all(spark):
    rng = random.Random(23)
    passage, other = ([f"p{rng.randrange(10 ** 7)}" for _ in range(n)] for n in (70, 55))
    rows = [(k if k % 5 else -k, " ".join([f"h{k}"] * (k % 3) + passage + [f"t{k}"] + other * (k % 2)), None, "a") for k in range(1, 60)] + [(None, " ".join(passage), None, "a")]
    named, _ = passages._told_apart(documents(spark, rows), "doc_id", "text")
    plain, dealt = ({(r["doc_id"], r["text_hash"], k) for r in passages.stretches(named, n).collect() for k in range(r["word"], r["word"] + r["n_words"])} for n in (10 ** 6, 7))
    assert plain == dealt and len(dealt) == 59 * 70 + 29 * 55
    assert {r["doc_id"] for r in passages.stretches(named, 7).where("kept_doc_id is null").collect()} > {1}


def test_every_later_place_of_50_words_is_marked(spark, sf):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spans = defaultdict(list)
    for r in QUERIES["op4_repeated_passages"](spark, sf).collect():
        spans[r["doc_id"]].append((r["start"], r["end"]))
    first, later = {}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        found = list(WORDS.finditer(r["text"] or ""))
        words = [m[0].translate(lower) for m in found]
        for k in range(len(words) - 49):
            doc, at = first.setdefault(tuple(words[k:k + 50]), (r["doc_id"], k))
            if doc != r["doc_id"] or k >= at + 50:
                later += 1
                assert any(a <= found[k].start() and found[k + 49].end() <= b for a, b in spans[r["doc_id"]]), (r["doc_id"], k)
    assert later > 100


def test_paragraphs_cover_texts_and_bands_recall():
    texts = ["A b c d. E f g h!\nI j k l", "", None, "é ü ö x y zz. \n\n  q", "one"]
    p = passages.Paragraphs(texts)
    spans = [(int(t), texts[t][a:b]) for t, a, b in zip(p.text, p.start, p.end)]
    assert [t for t, _ in spans] == [0, 0, 0, 3, 3, 4]
    assert [s for _, s in spans] == ["A b c d. ", "E f g h!\n", "I j k l", texts[3][:-1], "q", "one"]
    assert p.n_words.tolist() == [4, 4, 4, 5, 1, 1]
    rng = random.Random(4)
    met = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(49)]
        other = words[:44] + ["q"] + words[45:]  # five of 50 shingles differ: similarity 40 / 50
        keys = [set(passages.Paragraphs([" ".join(w)]).bands()[0].tolist()) for w in (words, other)]
        met += bool(keys[0] & keys[1])
    assert met >= 294


def test_passages_of_odd_rows(spark, odd, none):
    found = passages.repeated(odd).collect()
    assert {r["doc_id"] for r in found} >= {4, 5, 10}
    assert all(r["doc_id"] not in (1, 2, 3, 6, 7, 8, 11) for r in found)
    out = passages.removed(odd)
    assert out.columns == odd.columns
    left = out.collect()
    assert {r["doc_id"] for r in left} >= {1, 2, 3, 6, 7, 8, 11} and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in left)
    assert passages.repeated(none).count() == passages.removed(none).count() == 0


def test_passage_query_catches_shared_runs(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    holders = defaultdict(set)
    for d, t in docs.items():
        words = t.lower().split()
        for k in range(len(words) - 79):
            holders[tuple(words[k:k + 80])].add(d)
    later = set().union(*[sorted(v)[1:] for v in holders.values() if len(v) > 1])
    assert later and later <= {r["doc_id"] for r in QUERIES["op4_repeated_passages"](spark, sf).collect()}


def test_shared_runs_of_51_words_go_whole_wherever_they_stand(spark):
    rng = random.Random(17)
    words = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    runs = [words(51) for _ in range(20)] + [[w + '."' if k % 9 == 4 else w for k, w in enumerate(words(51))], [f"é{w}。" for w in words(51)]]
    rows, left = [], {}
    for k, run in enumerate(runs):
        for doc in (k, 1000 + k):
            head, tail = words(rng.randint(0, 40)), words(rng.randint(1, 40))
            rows.append((doc, " ".join(head + run + tail), "en", "a"))
            left[doc] = " ".join(head + tail if doc >= 1000 else head + run + tail)
    again = words(60)
    rows.append((2000, " ".join(again + ["between"] + again + ["after"]), "en", "a"))
    left[2000] = " ".join(again + ["between", "after"])
    rows.append((2001, "ha " * 200, "en", "a"))
    left[2001] = "ha " * 50
    docs = documents(spark, rows)
    assert {r["doc_id"]: r["text"] for r in passages.removed(docs).collect()} == left
    found = {r["doc_id"]: (r["n_words"], r["kept_doc_id"]) for r in passages.repeated(docs).collect()}
    assert found == {1000 + k: (51, k) for k in range(len(runs))} | {2000: (60, 2000), 2001: (150, 2001)}
