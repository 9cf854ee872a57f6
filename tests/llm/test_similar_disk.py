"""What the exact search of near copies sends through shuffles and keeps on disk."""

from vigilog.llm import similar


def test_beginnings_meet_in_one_narrow_shuffle(spark):
    rows = [(1, 1, 9, [10, 11, 12]), (2, 1, 9, [10, 13]), (3, 3, 9, [12, 13, 14]), (3, 3, 9, [12, 13, 14]), (4, 4, 9, [15])]
    starts = spark.createDataFrame(rows, "node long, root long, size long, start array<long>")
    found = similar._apart(starts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert {(r["key"], r["node"]) for r in found.collect()} == {(12, 1), (12, 3), (13, 2), (13, 3)}
    assert found.count() == 4


def test_texts_begun_anew_are_not_stored(spark, monkeypatch):
    names = []
    kept = similar.saved
    monkeypatch.setattr(similar, "saved", lambda df, name: names.append(name) or kept(df, name))
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{words} {k} {k + 1} {k + 2} {k + 3} {k + 4} " + " ".join(f"x{k}y{j}" for j in range(60))) for k in range(40)], "doc_id long, text string")
    assert similar.similar_texts(docs).select("component").distinct().count() == 40
    assert "similar-often" in names and "similar-starts" not in names
    after = names[names.index("similar-often"):]
    assert "similar-texts" not in after[:after.index("similar-missed")]
