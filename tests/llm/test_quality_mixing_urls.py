from collections import Counter, defaultdict

from corpus_rows import ODD_ROWS, documents
from vigilog.llm import mixing, quality, urls


def test_ledger_of_odd_rows(spark, odd, none):
    out, name = quality.ledger(odd)
    assert name == "ledger_" and set(odd.columns) < set(out.columns)
    rows = [(r["doc_id"], r[name]) for r in out.collect()]
    assert len(rows) == len(ODD_ROWS)
    for doc, m in rows:
        if doc in (1, 2, 3):
            assert m["n_words"] == m["word_chars"] == m["n_repeat_words"] == 0 and m["fail_bits"] & 1
    assert {m["n_words"] for d, m in rows if d == 9} == {120_000}
    assert quality.ledger(none)[0].count() == 0


def test_measures_by_hand():
    words = "a b c d e f a b c d e g".split()
    assert quality.repeat_words(words) == 10
    assert quality.repeat_words("x x x x x x".split()) == 6
    assert quality.repeat_words("a b c d".split()) == 0
    m = dict(zip(quality.MEASURES, quality.measure("a #b\n\na #b\n a #b\n")))
    assert m == {"n_words": 6, "word_chars": 9, "n_symbols": 3, "n_lines": 3, "n_dup_lines": 1, "n_repeat_words": 0}


def test_policies_and_ablation(spark):
    texts = ["too short", "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11", "# # # # # # # # # # # #", "a# b# c# d# e# f# g# h# i# j# k#", "<>"]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    assert [r["doc_id"] for r in quality.filtered(docs).collect()] == [1]
    assert quality.filtered(docs).columns == docs.columns
    out, name = quality.ledger(docs)
    got = {r["rule"]: (r["failing"], r["failing_alone"], r["kept_without"]) for r in quality.ablation(out.select(f"{name}.*")).collect()}
    assert got["few_words"] == (2, 1, 2) and got["symbols"] == (3, 1, 2) and got["repeated_windows"] == (1, 0, 1)


def test_mix_is_exact_and_stable(spark, odd, none):
    rows = [(k, " ".join(["w"] * (k % 17)), "en", None if k % 5 == 4 else f"s{k % 5}") for k in range(400)]
    docs = documents(spark, rows)
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    sizes, taken, goal = Counter(), Counter(), {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(taken[s] == int(goal[s]) and goal[s] <= 2 * sizes[s] for s in sizes)
    # Shares by weight, with the excess of limited sources shared again.
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        for s in over or free:
            want[s] = 2 * sizes[s] if over else weight[s] * level
            left -= want[s]
        free -= over or set(free)
    assert all(abs(want[s] - goal[s]) < 1e-6 * max(1, want[s]) for s in order)
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert mixing.mix(odd).count() == len(ODD_ROWS)


def test_mixed_texts_meet_the_budget(spark, odd):
    docs = documents(spark, [(k, f" lead{k}  a\nb c d", "en", f"s{k % 2}") for k in range(41)])
    words = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and f" lead{r['doc_id']}  a\nb c d".startswith(r["text"])
    assert dict(words) == {r["source"]: int(r["target"]) for r in mixing.mix(docs).collect()}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() > 0


def test_automaton_against_plain_matching():
    import fnmatch
    import random
    rng = random.Random(3)
    globs = ["a*b", "*", "**", "a?c", "*.com/**", "ab**", "**/x", "é*", "a/b", "", "*a*b*c", "?" * 70 + "z"] + [f"{'q' * k}*z" for k in range(40)]
    names = ["".join(rng.choice("abcxqz/.é") for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["", "y" * 70 + "z", "x.com/a/b", "q" * 39 + "z"]

    def covers(glob, name):
        import re
        parts = re.split(r"(\*\*|\*|\?)", glob)
        return re.fullmatch("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), name, re.S) is not None

    found = urls.Automaton.packed(globs).matches(names)
    assert found.shape == (len(names), len(globs)) and fnmatch
    for name, row in zip(names, found):
        assert row.tolist() == [covers(g, name) for g in globs], name
    assert urls.Automaton.packed(globs).matches([]).shape == (0, len(globs))


def test_urls_of_all_kinds(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "https://example.com/en/"), (5, "http://a.net/es/1"),
            (6, "http://net"), (7, "x://y.org/a?://com/"), (8, "https://casino.org/x.com/"), (9, "http://a.com"), (10, "http://a.com/" + "z" * 100_000), (3, "u://com/")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, judged string")
    out, name = urls.judged(pages)
    assert name == "judged_"
    got = [(r["page_id"], r[name]["rule"], r[name]["verdict"], r[name]["host"]) for r in out.collect()]
    assert got == [
        (1, None, "allow", ""), (2, None, "allow", ""), (3, "www.example.com/en/", "allow", "www.example.com"), (4, "example.com/en/", "block", "example.com"),
        (5, "net/es/", "block", "a.net"), (6, None, "allow", "net"), (7, None, "allow", "y.org"), (8, None, "block", "casino.org"), (9, None, "allow", "a.com"),
        (10, "com/", "allow", "a.com"), (3, "com/", "allow", "com")]
    assert urls.judged(pages.limit(0))[0].count() == 0
