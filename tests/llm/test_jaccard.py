import numpy as np
import pytest

from papyra.llm import jaccard


def brute(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [16, 1])
def test_groups_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = np.random.default_rng(5)
    texts = [(0, None), (1, ""), (2, "A b"), (3, "a B")]
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 500, 150)]
        for _ in range(20):
            t = list(base)
            for p in rng.integers(0, 150, rng.integers(0, 6)):
                t[p] = f"x{rng.integers(0, 99)}"
            texts.append((len(texts), " ".join(t)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.jaccard_groups(df, 3, 90).collect()}
    assert got == brute(texts, 3, 90)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.jaccard_groups(df, 3, 90).collect()] == [(None, 2, None)]
    assert jaccard.jaccard_groups(df.limit(0), 3, 90).count() == 0


def test_components(spark):
    # 5 is the least of its neighbours, all of which join 1 or 2
    edges = spark.createDataFrame([(9, 5), (9, 1), (8, 5), (8, 2), (7, 7), (20, 21)], "a long, b long")
    got = {r.node: r.comp for r in jaccard.components(edges).collect()}
    assert got == {9: 1, 5: 1, 1: 1, 8: 1, 2: 1, 20: 20, 21: 20}
