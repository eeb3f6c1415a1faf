"""Top-k search over many cells, and what of it may pass through the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def by_loop(rows, k=5):
    fine = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    out = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1 << 6, 1 << 12, 1 << 20])  # narrow and in float32; wide, or in float64, in part; all wide
@pytest.mark.parametrize("hold", [1, 1 << 7, topk.HOLD])
def test_cells_equal_a_loop(spark, scale, hold):
    rng = random.Random(7)
    rows = [(i, [rng.randint(-9, 9) * rng.choice([1, scale]) / 8 for _ in range(6)]) for i in range(420)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # ties, within blocks and across slices
    rows += [(i, [1.0, 2.0]) for i in (600, 601, 602)] + [(650, [3.0]), (700, []), (701, [])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, pack=32, group=3, hold=hold).collect()
    assert sorted(map(tuple, got)) == by_loop(rows)


def test_copies_of_queries_are_not_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    rows = [(i, [i % 7 / 8, 1.0, -0.5]) for i in range(400)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, pack=16, group=2)
    assert sorted(map(tuple, found.collect())) == by_loop(rows)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:|+*\-()0-9]*", x).group()) for x in plan]
    sent = [x for i, x in enumerate(plan) if any("BroadcastExchange" in plan[j] and all(depth[m] > depth[j] for m in range(j + 1, i + 1)) for j in range(i))]
    assert not [x for x in sent if "Generate" in x], "the copies of queries would pass through the driver"


def test_equal_vectors_keep_their_smallest_ids(spark):
    """Any of the smallest ids may be a query's own, or be there many times."""
    rows = [(i, [0.5, 1.0]) for i in (0, 1, 1, 1, 1, 1, 1, 1, 2, 50, 51, 52, 53, 54, 55, 56, 100)] + [(i, [0.25, 2.0]) for i in (0, 150, 7, 8, 9)] + [(200, [-1.0, 0.0])]
    for own in (0, 50, 100, 150, 200):  # each id asks with one row
        asked = [r for j, r in enumerate(rows) if r[0] != own or r not in rows[:j]]
        want = [r for r in by_loop(asked, 6) if r[0] == own and own != 0]
        got = topk.top_k(spark.createDataFrame(asked, SCHEMA), F.col("vec_id") == own, k=6, pack=4, group=1).collect()
        assert len(got) == 6 and all(r.vec_id != own for r in got)
        if want:
            assert sorted(map(tuple, got)) == want
