import random
from collections import Counter

import numpy as np
from corpus_rows import ODD_ROWS, documents

from vigilog.llm import similar


def shingles(text):
    """Five-word shingles in plain Python; the whole sequence if there are fewer words."""
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def exact_classes(rows):
    """The smallest id of each id's class, by comparing all sets that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    group, having = {d: d for d in sets}, {}
    for d in sorted(sets):
        for other, both in Counter(o for s in sets[d] for o in having.get(s, ())).items():
            if both / (len(sets[d]) + len(sets[other]) - both) >= 0.8 and group[other] != group[d]:
                low, high = sorted((group[other], group[d]))
                group = {k: low if v == high else v for k, v in group.items()}
        for s in sets[d]:
            having.setdefault(s, []).append(d)
    return group


def classes(df):
    members = {}
    for r in df.collect():
        members.setdefault(r["component"], []).append(r["doc_id"])
    return {d: min(m) for m in members.values() for d in m}


def test_classes_equal_exact_jaccard(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert classes(similar.similar_texts(spark.read.parquet(f"{sf}/documents.parquet"))) == exact_classes(rows)


def test_planted_near_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 1 + k % 3):
            edited = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                edited[at] = "changed"
            rows.append((10 * k + c, " ".join(edited).upper() if c == 2 else " ".join(edited)))
    got = classes(similar.similar_texts(documents(spark, [(d, t, "en", "a") for d, t in rows])))
    want = exact_classes(rows)
    linked = [d for d in want if want[d] != d]
    assert sum(got[d] == want[d] for d in linked) >= 0.97 * len(linked) > 0
    assert all(want[got[d]] == want[d] for d in got)


def test_large_group_of_variants_and_texts_just_too_far(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    near = []
    for k in range(1500):
        edited = list(words)
        edited[rng.randrange(300)] = f"own{k}"
        near.append((k, " ".join(edited), "en", "a"))
    # A third of the words are the same in all of these.
    far = [(5000 + k, " ".join(words[:100] + [f"x{k}y{j}" for j in range(200)]), "en", "a") for k in range(300)]
    docs = documents(spark, near + far)
    left = {r["doc_id"] for r in similar.deduplicated(docs).collect()}
    assert left == {0} | {5000 + k for k in range(300)}


def test_odd_and_empty_tables(spark, odd, none):
    out = similar.deduplicated(odd)
    assert out.columns == odd.columns
    # Null, empty and blank texts are one class, copies of prose and of the long text another each; the null id sorts last.
    kept = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert kept == sorted([1, 4, 6, 7, 8, 9, 11], key=str)
    assert similar.similar_texts(odd).count() == len(ODD_ROWS)
    assert similar.deduplicated(none).count() == similar.similar_texts(none).count() == 0


def test_rows_of_one_id_and_text_and_ids_without_texts(spark):
    rows = [(None, "a b c d e f", "en", "a"), (None, "a b c d e f", "en", "b"), (7, None, "en", "a"), (7, None, "en", "a"), (2 ** 60 + 1, "z", "en", "a"), (2 ** 60 + 1, "y", "en", "a")]
    got = sorted(((r["doc_id"], r["text"]) for r in similar.deduplicated(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, "a b c d e f"), (7, None), (2 ** 60 + 1, "z"), (2 ** 60 + 1, "y")], key=str)


def test_points_within_two_bits_share_an_anchor():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 31, 300)
    x[0] = 0
    y = x.copy()
    for k in range(300):
        for bit in rng.choice(31, k % 3, replace=False):
            y[k] ^= 1 << int(bit)
    balls = []
    for points in (x, y):
        ball = [set() for _ in points]
        for at, anchor in zip(*similar.anchors(points)):
            ball[at].add(int(anchor))
            assert (int(anchor) ^ int(points[at])).bit_count() <= 2
        balls.append(ball)
    assert all(a & b for a, b in zip(*balls)) and max(map(len, balls[0])) <= 16


def test_texts_just_similar_enough_are_found_whatever_their_fingerprints(spark):
    rng = random.Random(11)
    rows = []
    for k in range(200):
        size = rng.choice([30, 60, 200])
        words = [f"w{rng.randrange(9000)}" for _ in range(size)]
        edited = list(words)
        for at in range(len(words)):  # edits, from the end on, while the pair stays similar enough
            trial = list(edited)
            trial[-1 - at] = f"own{k}x{at}"
            if len(shingles(" ".join(words)) & shingles(" ".join(trial))) < 0.8 * len(shingles(" ".join(words)) | shingles(" ".join(trial))):
                break
            edited = trial
        # Something that many texts begin or end with alike.
        shared = " ".join(f"c{j}" for j in range(12))
        rows += [(2 * k, shared + " " + " ".join(words)), (2 * k + 1, shared + " " + " ".join(edited))]
    assert classes(similar.similar_texts(documents(spark, [(d, t, "en", "a") for d, t in rows]))) == exact_classes(rows)


def test_later_links_are_followed_between_components_only(spark, monkeypatch):
    followed = []
    kept = similar.components
    monkeypatch.setattr(similar, "components", lambda links: followed.append(links.count()) or kept(links))
    # Two groups of copies of a text, one with an edit, tied by one text between them.
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[:-1] + [f"own{k}"])) for k in range(60)]
    assert len(set(classes(similar.similar_texts(documents(spark, [(d, t, "en", "a") for d, t in rows]))).values())) == 1
    assert len(followed) >= 2 and followed[0] >= 50 > 10 >= max(followed[1:])


def test_components_with_further_links_are_those_of_all_links(spark):
    rng = random.Random(2)
    pairs = [[(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (150, 60, 40)]
    made = [spark.createDataFrame(p, "a long, b long") for p in pairs]
    roots = similar.saved(similar.components(made[0]), "roots")
    for links in made[1:]:
        roots = similar._tied(roots, links)
    got = [tuple(r) for r in roots.collect()]
    want = [tuple(r) for r in similar.components(made[0].unionAll(made[1]).unionAll(made[2])).collect()]
    # A text linked to itself alone is its own component in either form, told or not.
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)
