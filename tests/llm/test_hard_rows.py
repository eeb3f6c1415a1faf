"""Hard rows for the operators: nulls, empty texts, ties, repeated rows, empty tables, clashing columns, rules spelt out."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import chat, jaccard, langid, leaks, mixing, shards, topk, toxicity, urls

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for themselves.
CLASHES = ["_id", "_times", "_leaks", "_toxic", "_gone", "_again", "_row", "_source", "_size", "_key", "leaks", "row", "id", "size", "at", "times", "bucket", "hash", "name", "node", "h", "value", "i"]


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def small_docs(spark, n=120):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + ".", "en", rng.choice(["a", "b", None]), None) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (None, "one two", None, "b", 7), (5, rows[5][1], "en", "a", None), (n + 2, rows[7][1], "en", "a", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("stage", ["toxicity", "jaccard", "leaks", "mixing"])
def test_stages_leave_other_columns_alone(spark, stage):
    docs = with_clashes(small_docs(spark))
    labels = spark.createDataFrame([(i, 0, int(i < 9)) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12))), (None, None)], "item_id long, text string")
    made = {"toxicity": lambda d: toxicity.drop_toxic(d, labels), "jaccard": jaccard.keep_one, "leaks": lambda d: leaks.decontaminate(d, items), "mixing": mixing.mix}[stage]
    out = made(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == 7 for r in rows for c in CLASHES)
    assert made(docs.limit(0)).count() == 0
    if stage == "jaccard":
        ids = [r.doc_id for r in rows]
        assert ids.count(5) == 1 and 122 not in ids and None in ids and 120 in ids
    if stage == "leaks":
        assert len(rows) == docs.count()


def test_no_operator_changes_the_session(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    jaccard.jaccard_groups(small_docs(spark)).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-4, 4) / 8 for _ in range(6)]) for i in range(300)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (None, [1.0] * 6), (350, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, pack=64, group=4).collect()
    import math

    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=True)), d) for d, v in fine.items() if d != q and len(v) == len(fine[q]))[:5]
            want |= {(q, r + 1, d, -s) for r, (s, d) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_chats_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|a<|", "", None, "日本 🙂 ﬁ", "a" * 3000, " \n\n "]
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", texts[(c + t) % len(texts)]) for c in range(8) for t in range(5)] + [(8, None, None, "null turn"), (8, 1, "assistant", "a"), (8, 1, "assistant", "a"), (None, 0, "user", "lost")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    held, _ = chat.encoder(chat.MODEL)
    for r in made.collect():
        want = sorted(((-1 if t is None else t), ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id)
        assert chat.parse(r.formatted) == [(ro, x) for _, ro, x in want]
        assert held.decode(r.token_ids) == r.formatted
        assert [chat.unescape(held.decode(r.token_ids[s.start : s.stop])) for s in r.loss] == [x for _, ro, x in want if ro == "assistant"]
    assert made.limit(0).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judged(url):
    """The five rules, spelt out here once more."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in urls.LISTED_HOSTS) else "allow"


@pytest.mark.parametrize("words", [urls.MAX_WORDS, 32])
def test_url_rules(spark, monkeypatch, words):
    monkeypatch.setattr(urls, "MAX_WORDS", words)
    hosts = ["example.org", "a.EXAMPLE.org", "notexample.org", "x.com", "com", "net", "spam-farm.example.com", "a.spam-farm.example.net", "casino-win.example.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1x", "/en/2", "/fr/9", "/de/", "/fr/?de", "?x=/fr/", "#/de/"]
    every = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://a://b/fr/"]
    df = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(with_clashes(df)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(every)}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_mix_counts_equal_rows_at_the_cut(spark):
    rows = [(None, "same words here " * 5, "a")] * 40 + [(1, "other " * 10, "b"), (2, None, "b"), (3, "alone", None)] + [(i, "some more words", "c") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).collect()
    assert len(got) == len(rows)
    taken, target, most = {}, {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size], most[r.source_size] = r.target, max(most.get(r.source_size, 0), r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in taken)
    words = sum(len(r.text.split()) for r in mixing.mix(df).collect())
    assert words == sum(taken.values())
    again = mixing.mix_sizes(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_by_a_salted_plan_equals_the_broadcast(spark, monkeypatch):
    docs = small_docs(spark)
    want = sorted(map(str, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sizes(docs).collect())) == want


def test_shards_keep_columns_that_come_later(spark, tmp_path):
    t = shards.ShardedTable(spark, str(tmp_path))
    for k in range(3):
        t.append(spark.createDataFrame([(k,)], "doc_id long").coalesce(1))
    for k in range(3, 5):
        t.append(spark.createDataFrame([(k, "x")], "doc_id long, extra string").coalesce(1))
    version = t.compact()
    assert len(t.shards(version)) < 5
    assert sorted(map(tuple, t.read().collect())) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]
    assert t.read(1).columns == ["doc_id"]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("a",)], "doc_id string"))


def test_leaks_in_several_passes_equal_one(spark):
    rng = random.Random(6)
    items = [(i % 25, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for i in range(60)]
    docs = [(i, " ".join(rng.choices("abcdefghij", k=60))) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, leaks.contamination(d, b).collect()))
    assert sorted(map(str, leaks.contamination(d, b, max_item_bytes=200, max_pass_bytes=1).collect())) == one


def test_hostile_markup_is_linear(spark):
    for part in ("<script ", "<", "<!--", "<style></script>", "&a"):
        assert langid.visible(part * 300000) is not None
    page = spark.createDataFrame([(1, "http://a.org/", "<html lang='de'" + " <html" * 200000)], "page_id long, url string, html string")
    docs = spark.createDataFrame([("der hund", "de"), ("the dog", "en")], "text string, lang string")
    assert langid.identify(page, docs).count() == 1


def test_pipeline_on_hard_rows(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    docs = small_docs(spark).unionByName(spark.createDataFrame([(200, "clean words before " * 6 + item + " and after it " * 4, "en", "a", 1)], DOCS))
    with_clashes(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i < 9)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        rows = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        if name == "benchmark decontamination":
            left = [r.text for r in rows.where("doc_id = 200").collect()]
            assert all("q5" not in t and "clean words" in t for t in left)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "shard", "shard_bytes", "version"]
    assert sorted(r.doc_id or -1 for r in final.collect()) == sorted(r.doc_id or -1 for r in rows.collect())


def test_sharding_equals_its_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = shards.op4_sharding(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
