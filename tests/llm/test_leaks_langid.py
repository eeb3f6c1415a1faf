from papyra.llm import langid, leaks


def test_leaks_equal_brute_force(spark):
    item = " ".join(f"q{i}" for i in range(14))
    docs = [(1, f"x y {item} z"), (2, None), (3, "short one here"), (4, " ".join(item.split()[:9]))]
    items = [(7, item), (8, "short one"), (9, None)]
    got = leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leaks.brute_force([t for _, t in docs], dict(items))
    assert [(r.n_words, sum(s.stop - s.start for s in r.spans)) for r in sorted(got, key=lambda r: r.doc_id)] == [w[:2] for w in want]


def test_languages(spark):
    docs = spark.createDataFrame([("the cat and the dog went home " * 20, "en"), ("der hund und die katze gehen " * 20, "de"), (None, "de"), ("x", None)], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>the dog and the cat</p>"), (2, None, "<p>die katze und der hund</p>"), (3, "http://a.org/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in langid.identify(pages, docs).collect()}
    assert got == {1: "en", 2: "de", 3: "en"}
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}
