"""Toxicity cuts a few MB of texts into words at a time, and that changes no score and no column."""

import numpy as np
import pyarrow as pa

from papyra.llm import toxicity
from papyra.llm.words import Words, buffers


def test_few_megabytes_of_words_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, 20_000)) for _ in range(60)] + [None, "", "w1 w1 w2"]
    weight = np.where(rng.random(1 << toxicity.BITS) < 0.01, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    single = [float(toxicity.score_batch(pa.array([t], pa.string()), weight, 0.5)[0]) for t in texts]
    alone = [toxicity.columns_of(pa.array([t], pa.string()))[0].tolist() for t in texts]
    sizes = []

    def words(column, *a, **b):
        sizes.append(int(np.diff(buffers(column)[1]).sum()))
        return Words(column, *a, **b)

    monkeypatch.setattr(toxicity, "Words", words)
    whole = pa.array(texts, pa.string())
    assert 5 << 20 < np.diff(buffers(whole)[1]).sum() < 8 << 20
    assert toxicity.score_batch(whole, weight, 0.5).tolist() == single
    assert [c.tolist() for c in toxicity.columns_of(whole)] == alone
    assert len(sizes) > 2 and max(sizes) <= 4 << 20
    assert len(toxicity.score_batch(whole.slice(0, 0), weight, 0.5)) == 0 == len(toxicity.columns_of(whole.slice(0, 0)))
