"""Sums by which words are hashed and the network learns: the same values as the plain forms, in fewer passes."""

import numpy as np

from vigilog.llm import lm, words


def test_rows_are_summed_by_id_without_a_cell_for_each_number():
    rng = np.random.default_rng(1)
    for ids in (np.array([5, 2, 5, 5, 0]), np.array([1 << 40, 7, 7, 3, 1 << 40]), np.zeros(0, np.int64)):
        rows = rng.normal(size=(len(ids), 3)).astype(np.float32)
        got_ids, sums = lm.sums_by(ids, rows)
        assert got_ids.tolist() == sorted(set(ids.tolist())) and sums.dtype == np.float32
        for k, s in zip(got_ids, sums):
            assert np.allclose(s, rows[ids == k].sum(axis=0))


def test_sigmoid_of_any_size():
    x = np.array([[-1000, -90, -1, 0, 1, 90, 1000]], np.float32)
    with np.errstate(all="raise", under="ignore"):
        lm._sigmoid(x)
    assert np.allclose(x, [[0, 0, 0.26894143, 0.5, 0.7310586, 1, 1]])


def test_word_hashes_do_not_depend_on_the_size_of_their_group(monkeypatch):
    texts = ["The quick brown fox", None, "", "é" * 50 + " x", "a " * 1000, "the QUICK"]
    running = words.Words(texts).hash
    monkeypatch.setattr(words, "_POWERS", 0)
    assert (words.Words(texts).hash == running).all()
    monkeypatch.undo()
    assert (np.concatenate([words.Words([t]).hash for t in texts]) == running).all()
    assert running[0] == running[-2]
