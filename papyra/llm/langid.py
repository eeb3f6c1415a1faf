"""Language identification of web pages by Bayesian evidence fusion.

For each page and language four parts are added up, and softmax gives the posterior:

* the visible text's log-likelihood under byte 4-gram models, which are counted over all documents with a language;
  n-grams of a text depend on each other, so the mean per n-gram counts as at most ``evidence`` independent ones;
* the declared markup language (``<html lang>``), given the language;
* the address suffix (the host's last label), given the language;
* the host's prior, smoothed towards its domain (last two labels), that towards all pages, that towards equal shares.

The last three are estimated by grouped aggregation of the text posteriors of all pages (soft counts, so no page
is decided before its evidence is together); a page's own count is taken out of its host and domain. Sums are made by
partial aggregation, so a host with most of the pages is no hot spot; only the tables of declared values and
n-gram counts reach the driver or are broadcast, and both are bounded: ``DECLARED`` values of languages known from the documents, and
``FEATURES`` columns for each language.

Up to ``MAX_LANGS`` languages have one dense model. More are held in blocks of so many, and of each only the columns
that its documents have; the work for a page and the tables of declared values grow with the number of languages.

Null or empty html has no text evidence and no declaration, null urls have the empty host: such pages get what the
other parts say, at last the shares of all pages. Repeated rows are pages of their own, and of
languages with equal posteriors the first by name wins. Without any document with a language lang is null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import bounded, cut
from papyra.llm.urls import host_of
from papyra.llm.words import buffers

FEATURES = 1 << 16
PIECE = 1 << 20
EVIDENCE = 24.0
#: Languages of one dense model, or of a block.
MAX_LANGS = 256
#: Numbers of a table of hosts, domains or suffixes up to which it is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_CELLS = 1 << 20
_ENTITY = re.compile(r"&#?\w+;")
_ELEMENT = re.compile(r"<(script|style|template|noscript)\b", re.I)
_CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript")}
_HTML, _LANG = r"(?is)<html\b([^>]*)", r"(?is)\slang\s*=\s*[\"']?\s*([a-z]{2,3})"


def visible(html: str) -> str:
    """html without elements that aren't shown, comments, tags and entities, in time linear in its length.

    What is never closed is looked for once: an unclosed element or comment is a tag, an unclosed tag is text.
    """
    out, at, n = [], 0, len(html)
    open_for_good: set[str] = set()
    while at < n:
        here = html.find("<", at)
        if here < 0:
            break
        end = -1
        if (m := _ELEMENT.match(html, here)) and (name := m[1].lower()) not in open_for_good:
            if closed := _CLOSING[name].search(html, m.end()):
                end = closed.end()
            else:
                open_for_good.add(name)
        if end < 0 and "!" not in open_for_good and html.startswith("<!--", here):
            end = html.find("-->", here + 4) + 3
            if end < 3:
                open_for_good.add("!")
                end = -1
        if end < 0:
            end = html.find(">", here) + 1
            if not end:
                break
        out.append(html[at:here])
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", " ".join(out))


def grams(raw: np.ndarray) -> np.ndarray:
    """Columns of a text's byte 4-grams, A-Z lower-cased, from pieces of a bounded size."""
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    b = raw.astype(np.uint32)
    b += 32 * ((b >= 65) & (b <= 90)).astype(np.uint32)
    x = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _pieces(raw: np.ndarray):
    for k in range(0, max(1, len(raw) - 3), PIECE):
        yield raw[k : k + PIECE + 3]


class Dense:
    """Log-probabilities of all columns for each language of a block."""

    def __init__(self, counts: np.ndarray):
        counts = counts + 1.0
        self.model = np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T)
        self.n = self.model.shape[1]

    def of(self, g: np.ndarray) -> np.ndarray:
        return self.model[g].sum(axis=0)


class Sparse:
    """The same from the counts that aren't 0: each column has a language's least log-probability and log(1 + count)."""

    def __init__(self, lang: np.ndarray, column: np.ndarray, count: np.ndarray, n: int):
        order = np.argsort(column, kind="stable")
        self.n, self.lang = n, lang[order].astype(np.int32)
        self.first = np.searchsorted(column[order], np.arange(FEATURES + 1))
        self.more = np.log1p(count[order])
        self.least = -np.log(np.bincount(lang, count, n) + FEATURES)

    def of(self, g: np.ndarray) -> np.ndarray:
        g, times = np.unique(g, return_counts=True)
        size = self.first[g + 1] - self.first[g]
        at = np.repeat(self.first[g] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return times.sum() * self.least + np.bincount(self.lang[at], self.more[at] * np.repeat(times, size), self.n)


def text_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[Dense] | list[Sparse]]:
    """Languages by name, and the models of their blocks in that order, from all documents that have a language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            raw, at = buffers(b.column(0))
            for d, lang in enumerate(b.column(1).to_pylist()):
                if len(total) >= MAX_LANGS and lang not in total:
                    yield from told(total)
                    total.clear()
                sums = total.setdefault(lang, np.zeros(FEATURES, np.int64))
                for piece in _pieces(raw[at[d] : at[d + 1]]):
                    sums += np.bincount(grams(piece), minlength=FEATURES)
        yield from told(total)

    def told(total: dict[str, np.ndarray]):
        for lang, sums in total.items():
            f = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f), pa.array(sums[f])], names=["lang", "f", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null")
    names = sorted(r.l for r in rows.select("l").distinct().collect())
    summed = rows.mapInArrow(count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    if len(names) > MAX_LANGS:
        summed = cut(summed, "grams")
    models = []
    for k in range(0, len(names), MAX_LANGS):
        block = names[k : k + MAX_LANGS]
        got = (summed if len(block) == len(names) else summed.where(F.col("lang").isin(block))).toArrow()
        where = {x: i for i, x in enumerate(block)}
        lang = np.array([where[x] for x in got.column("lang").to_pylist()], np.int64)
        column, n = got.column("f").to_numpy(), got.column("n").to_numpy()
        if len(block) < len(names):
            models.append(Sparse(lang, column, n, len(block)))
        else:
            counts = np.zeros((len(block), FEATURES))
            counts[lang, column] = n
            models.append(Dense(counts))
    return names, models


def text_evidence(html: Column, spark: SparkSession, models: list[Dense] | list[Sparse], evidence: float) -> Column:
    """For each language the tempered log-likelihood, largest 0."""
    shared = [spark.sparkContext.broadcast(m) for m in models]

    def run(column: pa.Array) -> pa.Array:
        held, out = [b.value for b in shared], []
        for t in column.to_pylist():
            total, n = np.zeros(sum(m.n for m in held)), 0
            for piece in _pieces(np.frombuffer(visible(t or "").encode(), np.uint8)):
                g = grams(piece)
                total += np.concatenate([m.of(g) for m in held])
                n += len(g)
            total = total * (min(n, evidence) / n) if n else total
            out.append(total - total.max())
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(html)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def _shares(logs: np.ndarray) -> np.ndarray:
    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _posterior(n: int):
    """Softmax of each row's logs."""

    def run(logs: pa.Array) -> pa.Array:
        return pa.array(list(_shares(_matrix(logs, n))), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def _fused(prior: list[float], strength: float):
    """identify's posterior: position of the best (of equal ones the first), its probability, position of the text's best.

    A page's own soft counts are taken out of its host's, domain's and suffix's. The host's prior holds its suffix
    already as far as the host's own pages say so; the suffix counts for the rest.
    """
    base = np.array(prior)

    def run(ll: pa.Array, p: pa.Array, by_host: pa.Array, by_domain: pa.Array, by_suffix: pa.Array, said: pa.Array) -> pa.Array:
        logs, own, host, domain, suffix, declared = (_matrix(c, len(base)) for c in (ll, p, by_host, by_domain, by_suffix, said))
        host, domain, suffix = (np.maximum(0.0, c - own) for c in (host, domain, suffix))
        size = host.sum(axis=1, keepdims=True)
        smoothed = lambda c, q: (c + strength * q) / (c.sum(axis=1, keepdims=True) + strength)
        prior_of_host = smoothed(host, smoothed(domain, base))
        post = _shares(logs + declared + np.log(prior_of_host) + strength / (strength + size) * np.log(smoothed(suffix, base) / base))
        parts = [pa.array(post.argmax(axis=1), pa.int32()), pa.array(post.max(axis=1), pa.float64()), pa.array(logs.argmax(axis=1), pa.int32())]
        return pa.StructArray.from_arrays(parts, names=["best", "probability", "text_best"])

    return F.arrow_udf(run, "best int, probability double, text_best int")


def _sums(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """by, s: component sums of the array column ``p``, of length n, rounded so that their order does not matter."""
    whole = lambda x: F.sum(F.round(x * 1e6).cast("long")) / F.lit(1e6)
    if n <= MAX_LANGS:
        return rows.groupBy(*by).agg(F.array(*[whole(F.get("p", F.lit(i))) for i in range(n)]).alias("s"))
    # a plan with a sum for each language would be too large
    each = rows.select(*by, F.posexplode("p").alias("k", "x")).groupBy(*by, "k").agg(whole(F.col("x")).alias("x"))
    return each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s")).select(*by, F.col("s.x").alias("s"))


def identify(pages: DataFrame, docs: DataFrame, evidence: float = EVIDENCE, strength: float = 4.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """page_id, lang, probability, declared, suffix, host and text_lang (by the text alone) for each page."""
    pages, docs = bounded(pages), bounded(docs)
    spark = pages.sparkSession
    names, models = text_models(docs, text_col, lang_col)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("u"), F.col(f"`{html_col}`").cast("string").alias("h"))
    host = F.regexp_replace(host_of(F.col("u")), ":\\d*$", "")
    # the first <html> tag alone, so that hostile markup is read once
    found = F.lower(F.regexp_extract(F.regexp_extract("h", _HTML, 1), _LANG, 1))
    rows = rows.select("page_id", "h", host.alias("host"), F.when(found.isin(names), found).alias("declared"))
    rows = rows.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    if not names:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "declared", "suffix", "host", F.lit(None).cast("string").alias("text_lang"))
    n = len(names)
    rows = rows.withColumn("ll", text_evidence(F.col("h"), spark, models, evidence)).drop("h")
    rows = cut(rows.withColumn("p", _posterior(n)("ll")), "langid")
    every = _sums(rows, n).first()
    every = [float(x or 0.0) for x in every.s] if every and every.s else [0.0] * n
    total = sum(every)
    prior = [(x + 1.0) / (total + n) for x in every]  # all pages, smoothed towards equal shares
    out = rows
    for c in ("host", "domain", "suffix"):
        table = cut(_sums(rows, n, c).withColumnRenamed("s", f"by_{c}"), f"langid-{c}")
        out = out.join(F.broadcast(table) if table.count() * n <= BROADCAST_CELLS else table, c, "left")
    by_declared = {r.declared: list(r.s) for r in _sums(rows.where("declared is not null"), n, "declared").collect()}
    some = [sum(v[i] for v in by_declared.values()) for i in range(n)]
    table = {d: [float(np.log((v[i] + 0.5) / (some[i] + 0.5 * (len(by_declared) + 1)))) for i in range(n)] for d, v in by_declared.items()}
    out = out.join(F.broadcast(spark.createDataFrame(list(table.items()), "declared string, said array<double>")), "declared", "left")
    said = F.coalesce("said", F.array_repeat(F.lit(0.0), n)).alias("said")
    post = _fused(prior, strength)(*("ll", "p", "by_host", "by_domain", "by_suffix", "said"))
    out = out.select("page_id", "declared", "suffix", "host", "ll", "p", "by_host", "by_domain", "by_suffix", said).withColumn("r", post)
    name = F.array(*map(F.lit, names))
    return out.select("page_id", F.get(name, F.col("r.best")).alias("lang"), F.col("r.probability").alias("probability"), "declared", "suffix", "host", F.get(name, F.col("r.text_best")).alias("text_lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
