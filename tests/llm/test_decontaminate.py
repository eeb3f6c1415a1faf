"""Decontamination needs one Python worker a task, and its texts equal those of a plain loop, in one pass and in several."""

import random
import re

import pytest

from papyra.llm import leaks

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text, items, window, most):
    """The text without its hits; False if it goes whole."""
    if text is None:
        return None
    at = [m.span() for m in WORD.finditer(low(text))]
    words, hit = [low(text)[a:b] for a, b in at], set()
    for item in items:
        w = WORD.findall(low(item or ""))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            part = w[k : k + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
    if len(hit) > most * len(words):
        return False
    out, end = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[end : at[i][0]]
        end = at[i][1]
    return out + text[end:]


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "zwölf", "Q"]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 6, 9, 14, 4)] + [None, "", "..."]
    texts = [None, "", " ,. ", items[2], f"{items[0]}  end", f"begin... {items[1]}"]
    for _ in range(80):
        parts = [rng.choice([*items[:5], *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(7)]]) for _ in range(rng.randint(1, 6))]
        texts.append("".join(p.upper() + rng.choice([" ", ", ", "\n", " — "]) if rng.random() < 0.3 else p + " " for p in parts))
    return texts, items


@pytest.mark.parametrize("bounds", [{}, {"max_item_bytes": 20, "max_pass_bytes": 1}])
def test_texts_equal_a_plain_loop(spark, bounds):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in leaks.decontaminate(docs, benchmark, window=5, **bounds).collect()}
    want = {i: plain(t, items, 5, leaks.MAX_COVERAGE) for i, t in enumerate(texts)}
    assert sum(x is False for x in want.values()) > 5 and sum(x not in (False, t) for x, t in zip(want.values(), texts, strict=True)) > 5
    assert got == {i: (x, None if x is None else len(x)) for i, x in want.items() if x is not False}


def test_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    out = leaks.decontaminate(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert out.collect() == [(1, "a  d e f g")]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
