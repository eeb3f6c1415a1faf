import numpy as np

from papyra.llm import langid


def words(rng, n):
    return ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(n)]


def test_more_languages_than_one_model_holds(spark):
    rng = np.random.default_rng(4)
    own = {f"tag{i:03}": words(rng, 12) for i in range(langid.MAX_LANGS + 44)}
    docs = spark.createDataFrame([(" ".join(w * 4), x) for x, w in own.items()], "text string, lang string")
    asked = {i: x for i, x in enumerate(list(own)[::11])}
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", f"<p>{' '.join(own[x])}</p>") for i, x in asked.items()], "page_id long, url string, html string")
    got = langid.identify(pages, docs).collect()
    assert {r.page_id: r.text_lang for r in got} == {r.page_id: r.lang for r in got} == asked
    assert all(0.5 < r.probability <= 1 for r in got)


def test_blocks_of_languages_equal_one_model(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    read = lambda: {r.page_id: r for r in langid.op7_language_id(spark, d).collect()}
    one = read()
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    blocks = read()
    assert one.keys() == blocks.keys()
    for i, r in one.items():
        assert r[:2] == (i, blocks[i].lang) and r[3:] == blocks[i][3:]
        assert abs(r.probability - blocks[i].probability) < 1e-6
