import math

import duckdb
import pytest
from pyspark.sql import functions as F

from papyra.operators import retrieval

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(retrieval.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(retrieval.ORACLES[name])
    names = [d[0] for d in want.description]
    df = retrieval.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want.fetchall()))
    assert rows


@pytest.mark.parametrize(("window", "overlap"), [(4, 0), (4, 3), (64, 16)])
def test_chunks_equal_a_loop(spark, window, overlap):
    texts = [(i, None if i == 1 else "  ".join(f"w{j}" for j in range(i))) for i in range(80)]
    want = set()
    for i, t in texts:
        w, at, k = (t or "").split(), 0, 0
        while w:
            want.add((f"{i}:e:{k}", " ".join(w[at : at + window])))
            if at + window >= len(w):
                break
            at, k = at + window - overlap, k + 1
    got = retrieval.structural_chunks(spark.createDataFrame(texts, "id int, t string"), F.col("id"), F.lit("e"), F.col("t"), window, overlap)
    assert {tuple(r) for r in got.collect()} == want


def test_zero_vectors_and_bad_arguments(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    q = spark.createDataFrame([([3.0, 4.0],)], "q array<double>")
    got = {r.id: r.score for r in retrieval.vector_query(rows, q, 5, F.lit(True), "id", "v").collect()}
    assert got[1] == 0 and math.isclose(got[2], 1)
    with pytest.raises(ValueError):
        retrieval.vector_query(rows, q, 0, F.lit(True), "id", "v")
    with pytest.raises(ValueError):
        retrieval.assembled(rows, "id", "id", f"with {retrieval.PHRASE}", 10)
    with pytest.raises(ValueError):
        retrieval.structural_chunks(rows, F.col("id"), F.lit("e"), F.lit("x"), 4, 4)


def test_near_ties_rank_by_the_exact_score(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0])], "id int, v array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r.id for r in retrieval.vector_query(rows, q, 1, F.lit(True), "id", "v").collect()] == [2]
    with pytest.raises(Exception, match="unequal dimensions"):
        retrieval.vector_query(rows, spark.createDataFrame([([1.0],)], "q array<double>"), 1, F.lit(True), "id", "v").collect()


def test_words_end_at_separators(spark):
    text = "a\x1cb\x1dc\x1ed\x1fe\u00a0f\u2028g"
    got = spark.createDataFrame([(text,)], "t string").select(retrieval.tokens(F.col("t")).alias("w")).first().w
    assert got == text.split()
