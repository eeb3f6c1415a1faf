import duckdb
import numpy as np
from pyspark.sql import functions as F

from papyra.llm import jaccard, leaks, topk, toxicity


def by_sql(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(sql).fetchall())


def test_leaks_of_items_that_share_an_id_or_have_none(spark, tmp_path):
    first, second, third = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    docs = [(1, f"x {second} y"), (2, f"{third} {first}"), (3, "few words z"), (4, "nothing here")]
    items = [(7, first), (7, second), (7, second), (None, third), (None, "few words"), (8, first)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = by_sql(leaks.oracle(), tmp_path, "documents", "benchmark")
    assert sorted(map(tuple, leaks.op8_benchmark_decontamination(spark, str(tmp_path)).collect())) == want
    assert [w[2] for w in want] == [12, 24, 2, 0]
    # the same in several groups
    found = leaks.contamination(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")), max_item_bytes=60)
    assert {r.doc_id: r.item_ids for r in found.collect()} == {1: [7], 2: [7, 8, None], 3: [None], 4: []}


def test_top_k_of_rows_that_share_an_id(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 4) / 8]) for i in rng.integers(0, 60, 400)] + [(0, [1.0, 0.5, 0.0, 0.0])]
    rows += [(3, [9.0, 9.0, 9.0, 9.0])] * 3 + [(4, [-9.0, -9.0, -9.0, -9.0])] * 8
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = by_sql(topk.oracle(), tmp_path, "embeddings")
    assert len(want) == 10
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    for pack in (topk.PACK, 16):
        assert sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0, pack=pack, group=pack).collect())) == want


def test_keep_one_of_rows_that_share_an_id(spark):
    base = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    near = lambda w, k: " ".join(w[:k] + ["other"] + w[k + 1 :])
    full = [" ".join(w) for w in base]
    rows = [(1, full[0]), (5, near(base[0], 59)), (5, full[1])]  # 5's second text is no copy
    rows += [(2, full[2]), (2, near(base[2], 59)), (9, near(base[2], 0))]  # two near copies share the least id
    rows += [(3, full[3]), (3, full[3]), (3, full[3].upper()), (4, full[3])]
    rows += [(6, ""), (6, ""), (6, None), (7, " "), (None, full[0]), (None, full[0])]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    real = [(r.doc_id, r.text) for r in got if r.doc_id is not None and (r.text or "").strip()]
    assert sorted(i for i, _ in real) == [1, 2, 3, 5]
    assert (1, full[0]) in real and (5, full[1]) in real and (3, full[3].upper()) in real
    assert sorted((r.doc_id, str(r.text)) for r in got if not (r.text or "").strip()) == [(6, ""), (6, "None"), (7, " ")]
    assert sum(r.doc_id is None for r in got) == 2


def test_sample_of_rows_that_share_an_id(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "learn", lambda positive, unlabelled, confirmed, prior: seen.update(p=len(positive), u=len(unlabelled)))
    rows = [(i, f"text {i}") for i in range(200)] + [(i, f"again {j}") for i in range(20) for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_positive=5, max_unlabelled=50)
    assert seen == {"p": 5, "u": 50}
