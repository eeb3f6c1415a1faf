"""Operators that SQL can't express, against plain Python: language ID, sharding, toxicity scores, near copies of the pipeline."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from papyra.llm import chat, jaccard, langid, shards, tokens, topk, toxicity

COLUMNS, EVIDENCE, STRENGTH = 1 << 16, 24, 4.0


def columns(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % (1 << 32)) >> 16 for i in range(len(b) - 3)]


def shares(logs):
    raised = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(raised) for x in raised]


def judged(pages, docs):
    """page_id, lang, probability, text_lang of each page, one page and one language at a time."""
    names = sorted({x for _, x in docs if x is not None})
    counts = {x: Counter() for x in names}
    for t, x in docs:
        if x is not None:
            counts[x].update(columns(t or ""))
    logs = {x: {c: math.log((k + 1) / (c0.total() + COLUMNS)) for c, k in c0.items()} for x, c0 in counts.items()}
    least = {x: math.log(1 / (c0.total() + COLUMNS)) for x, c0 in counts.items()}
    rows = []
    for i, url, html in pages:
        g = columns(re.sub(r"&#?\w+;", " ", re.sub(r"<[^>]*>", " ", html or "")))
        ll = [sum(logs[x].get(c, least[x]) for c in g) * (min(len(g), EVIDENCE) / len(g) if g else 1) for x in names]
        ll = [x - max(ll) for x in ll]
        host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
        said = re.search(r"<html lang='(\w+)'", html or "")
        said = said[1] if said and said[1] in names else None
        rows.append((i, ll, shares(ll), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said))
    sums = defaultdict(lambda: [0.0] * len(names))
    for _, _, p, host, domain, suffix, said in rows:
        for key in ("all", ("h", host), ("d", domain), ("s", suffix), *([("m", said)] if said else [])):
            sums[key] = [a + round(b * 1e6) / 1e6 for a, b in zip(sums[key], p, strict=True)]
    base = [(x + 1) / (sum(sums["all"]) + len(names)) for x in sums["all"]]
    marks = [k for k in sums if k[0] == "m"]
    out = {}
    for i, ll, p, host, domain, suffix, said in rows:
        h, d, s = ([max(0.0, a - b) for a, b in zip(sums[k], p, strict=True)] for k in (("h", host), ("d", domain), ("s", suffix)))
        smooth = lambda c, q: [(a + STRENGTH * b) / (sum(c) + STRENGTH) for a, b in zip(c, q, strict=True)]
        prior, of_suffix = smooth(h, smooth(d, base)), smooth(s, base)
        total = []
        for j in range(len(names)):
            mark = math.log((sums["m", said][j] + 0.5) / (sum(sums[k][j] for k in marks) + 0.5 * (len(marks) + 1))) if said else 0.0
            total.append(ll[j] + mark + math.log(prior[j]) + STRENGTH / (STRENGTH + sum(h)) * math.log(of_suffix[j] / base[j]))
        post = shares(total)
        out[i] = names[post.index(max(post))], max(post), names[ll.index(max(ll))]
    return out


def test_languages_equal_brute_force(spark):
    rng = random.Random(9)
    own = {x: [("".join(rng.choices("abcdefghijklmnop", k=6))) for _ in range(40)] for x in ("aa", "bb", "cc")}
    docs = [(" ".join(rng.choices(own[x], k=60)), x) for x in own for _ in range(4)] + [(None, "aa"), ("", "bb"), ("none here", None)]
    pages = []
    for i in range(90):
        x = rng.choice(list(own))
        html = f"<html lang='{rng.choice([x, x, 'aa', 'zz'])}'><p>{' '.join(rng.choices(own[x], k=rng.choice([0, 1, 3, 30])))}&amp; x</p></html>"
        pages.append((i, f"http://{rng.choice(['www.', 'a.', ''])}{x}-site.{rng.choice(['org', 'de'])}/p{i}" if i % 9 else None, html if i % 11 else None))
    pages += [pages[4], (90, "", ""), (91, "http://HOT.org/", "<p>abcd</p>")] + [(100 + i, "http://hot.org/", f"<p>{own['bb'][i]}</p>") for i in range(30)]
    pages = [(k, *p[1:]) for k, p in enumerate(pages)]
    d, p = spark.createDataFrame(docs, "text string, lang string"), spark.createDataFrame(pages, "page_id long, url string, html string")
    got = langid.identify(p.withColumns({"lang": F.lit("x"), "ll": F.lit(1), "host": F.lit(2)}), d).collect()
    want = judged(pages, docs)
    assert len(got) == len(want) == len(pages)
    for r in got:
        lang, share, by_text = want[r.page_id]
        assert (r.lang, r.text_lang) == (lang, by_text) and abs(r.probability - share) < 1e-6


def test_shards_hold_the_rows_they_are_said_to(spark, tmp_path):
    docs = spark.createDataFrame([(i % 90 if i % 13 else None, "x" * (i * 7 % 50), "shard") for i in range(400)], "doc_id long, text string, shard string").repartition(9)
    got = shards.shard(docs, str(tmp_path)).collect()
    claimed = defaultdict(list)
    for r in got:
        claimed[r.shard, r.shard_bytes].append(r.doc_id)
    files = {(n, os.path.getsize(f"{tmp_path}/shards/{n}")): pq.read_table(f"{tmp_path}/shards/{n}").column("doc_id").to_pylist() for n, _ in claimed}
    order = lambda d: {k: sorted(v, key=str) for k, v in d.items()}
    assert order(claimed) == order(files)
    named = {x["path"].split("/shards/")[1] for x in shards.ShardedTable(spark, str(tmp_path)).shards()}
    assert named == {n for n, _ in files} and {r.version for r in got} == {2}


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (shards.ShardedTable(spark, str(tmp_path)) for _ in range(2))
    one.append(spark.createDataFrame([(1,)], "doc_id long"))
    parent = two.versions()[-1]
    one.append(spark.createDataFrame([(2,)], "doc_id long"))
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        two._commit(two.schema(parent), two.shards(parent), parent)
    assert sorted(r.doc_id for r in one.read().collect()) == [1, 2] and [r.doc_id for r in one.read(parent).collect()] == [1]


def test_merges_leave_no_tier_full():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.choice([1, 900, 1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 27]) for _ in range(rng.randint(0, 80))]
        groups = shards.plan_merges(sizes)
        merged = {i for g in groups for i in g}
        left = [n for i, n in enumerate(sizes) if i not in merged] + [sum(sizes[i] for i in g) for g in groups]
        assert sum(left) == sum(sizes)
        # of the shards that nothing merged, fewer than fanout are in a tier
        alone = Counter(int(math.log(max(n, 1 << 16) / (1 << 16), 4) + 1e-9) for i, n in enumerate(sizes) if i not in merged and n < shards.TARGET)
        assert all(k < shards.FANOUT for k in alone.values())


def test_scores_equal_sums_over_features():
    rng = random.Random(5)
    texts = [None, "", " \n ", "One one ONE", "x" * 70000] + [" ".join(rng.choices(["bad", "good", "日本", "longerword", "a"], k=rng.randint(1, 300))) for _ in range(30)]
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    some = toxicity.columns_of(pa.array(texts))
    for c in some:
        weight[c] = np.random.default_rng(len(c)).normal(size=len(c))
    got = toxicity.score_batch(pa.array(texts), weight, 0.25)
    want = [1 / (1 + math.exp(-min(60, max(-60, float(weight[c].astype(float).sum()) + 0.25)))) for c in some]
    assert np.allclose(got, want, atol=1e-6)


def test_toxic_rows_are_learnt_from_positive_and_unlabelled(spark):
    rng = random.Random(8)
    plain, bad = [f"w{i}" for i in range(300)], [f"b{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = rng.choices(plain, k=40) + (rng.choices(bad, k=6) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "clash"))
        if toxic and i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    told = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, told).where("held_out").collect()}
    right = sum(p == int(i % 5 == 0) for i, p in got.items())
    assert len(got) > 200 and right / len(got) > 0.95
    left = {r.doc_id for r in toxicity.drop_toxic(docs, told).collect()}
    assert sum(i % 5 != 0 for i in left) / 1200 > 0.97 and sum(i % 5 == 0 for i in left) < 30


def test_near_copies_of_five_words(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = rng.choices([f"w{i}" for i in range(900)], k=rng.choice([5, 20, 80]))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = jaccard.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(group)) and len(set(group)) < len(texts)


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, "some words", 0), (1, "some words", 0), (2, None, 1), (None, "x", 2)]
    more = {"n_tokens": F.lit("a"), "batch": F.lit(1), "i": F.lit(2), "rank": F.lit(3)}
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").withColumns(more)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == [("1", 10), ("1", 10), ("2", 0), ("None", 1)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>").withColumns({"score": F.lit("a"), "pack": F.lit(1), "v": F.lit(2), "dim": F.lit(3)})
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256), (0, 3, 2, 128 * 256)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string").withColumns({"formatted": F.lit(1), "loss": F.lit(2), "turns": F.lit(3)})
    assert [chat.parse(r.formatted) for r in chat.format_chats(chats).collect()] == [[("user", "a"), ("assistant", "b")]]
