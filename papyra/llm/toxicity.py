"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained with numpy from confirmed toxic examples and
unlabelled text. Its risk is the class-prior-corrected, non-negative estimator: with prior p and logistic loss l,

    p * mean_P l(g, +1) + max(0, mean_U l(g, -1) - p * mean_P l(g, -1)),

and a step with a negative second part climbs that part instead. The prior is the share of toxic rows among all
labelled training rows. Only columns that confirmed examples have clearly more often than
unlabelled text are fitted, with an L1 proximal step, so most weights are zero.

Only rows whose ``crc32(doc_id as text) mod 5`` is not 0 are learnt from; labels, lang, source and doc_id are never
inputs of a score. The sample to fit is bounded: at most ``max_positive`` toxic and ``max_unlabelled`` other rows,
those with the smallest hash of their id, and of rows that share an id one, that with the smallest columns as bytes; all
rows are scored, over their whole texts.

Null and empty texts have no features and get the score of the bias alone. Without any toxic row to learn from, every score
is 0. A doc_id that is labelled more than once is toxic if any of its labels says so. Rows map one to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import bounded, slices
from papyra.llm.words import SPACE_WORDS, Words, buffers, mix

BITS = 20
PREFIXES = (4, 5)
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000


def features(w: Words) -> list[np.ndarray]:
    """For each kind of feature a column for each word of the batch."""
    kinds = [w.hashes, *(mix(w.prefix[p] + np.uint64(977 * p)) for p in PREFIXES)]
    return [(h >> np.uint64(64 - BITS)).astype(np.int32) for h in kinds]


def again(col: np.ndarray) -> np.ndarray:
    """The column that says that a text has this column's feature at least twice."""
    return (mix(col.astype(np.uint64) + np.uint64(1 << BITS)) >> np.uint64(64 - BITS)).astype(np.int32)


def columns_of(text: pa.Array) -> list[np.ndarray]:
    """The distinct columns of each text."""
    out = []
    for lo, hi in slices(buffers(text)[1]):
        w = Words(text.slice(lo, hi - lo), SPACE_WORDS, prefixes=PREFIXES)
        kinds = features(w)
        for d in range(len(w)):
            cols, n = np.unique(np.concatenate([k[w.first[d] : w.first[d + 1]] for k in kinds]), return_counts=True)
            out.append(np.unique(np.concatenate([cols, again(cols[n >= 2])])))
    return out


def _sums(weight: np.ndarray, cols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row of a CSR matrix of ones."""
    total = np.concatenate([[0.0], np.cumsum(weight[cols], dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), first


def telling(positive: list[np.ndarray], others: list[np.ndarray], ratio: float = 2.5, margin: float = 4.0) -> np.ndarray:
    """Columns that confirmed rows have at least ratio times as often as others.

    Their log-likelihood ratio must exceed what the best of so many columns has by chance by margin.
    """
    k, u = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for side, rows in ((k, positive), (u, others)):
        for r in rows:
            side[r] += 1
    share = len(positive) / max(1, len(positive) + len(others))
    n = k + u
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (k * np.log(np.where(k > 0, k / (n * share), 1)) + u * np.log(np.where(u > 0, u / (n * (1 - share)), 1)))
        often = k / max(1, len(positive)) >= ratio * u / max(1, len(others))
    return (k > 0) & often & (g >= margin + 2 * np.log(max(1, np.count_nonzero(n))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, confirmed: list[bool] | None = None, epochs: int = 40, batches: int = 16, rate: float = 0.05, l1: float = 0.01, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the hashed columns, and the bias. confirmed: which unlabelled rows are among the positive ones."""
    weight = np.zeros(1 << BITS, np.float32)
    if not positive:
        return weight, -np.inf
    if not unlabelled:
        return weight, np.inf
    keep = telling(positive, [r for r, c in zip(unlabelled, confirmed or [False] * len(unlabelled), strict=True) if not c])
    names = np.flatnonzero(keep)
    where = np.cumsum(keep) - 1
    positive = [where[r[keep[r]]].astype(np.int32) for r in positive]
    unlabelled = [where[r[keep[r]]].astype(np.int32) for r in unlabelled]
    n = len(names)
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    b, mb, vb = float(np.log(prior / (1 - prior))), 0.0, 0.0
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        step = rate * (1 - epoch / epochs) + rate / 20
        for k in range(batches):
            p_rows = [positive[i] for i in order_p[k::batches]] or [positive[i] for i in order_p[:1]]
            u_rows = [unlabelled[i] for i in order_u[k::batches]] or [unlabelled[i] for i in order_u[:1]]
            (pc, pf), (uc, uf) = _csr(p_rows), _csr(u_rows)
            gp, gu = _sums(w, pc, pf) + b, _sums(w, uc, uf) + b
            # d l(g,+1)/dg = -sigmoid(-g); d l(g,-1)/dg = sigmoid(g)
            minus = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            dp_pos = -prior * _sigmoid(-gp) / len(p_rows)
            dp_neg, du_neg = -prior * _sigmoid(gp) / len(p_rows), _sigmoid(gu) / len(u_rows)
            dp, du = (dp_pos + dp_neg, du_neg) if minus >= 0 else (-dp_neg, -du_neg)
            grad = np.bincount(pc, np.repeat(dp, np.diff(pf)), n) + np.bincount(uc, np.repeat(du, np.diff(uf)), n)
            gb = dp.sum() + du.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a = step * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= a * m / (np.sqrt(v) + 1e-6)
            b -= a * mb / (np.sqrt(vb) + 1e-6)
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
    weight[names] = w
    return weight, b


def spread(rows: list[np.ndarray]) -> list[int]:
    """Positions of rows that aren't near copies of an earlier one, by the two smallest hashes of their columns.

    Copies of one text would make all of its words look telling.
    """
    seen, out = set(), []
    for i, r in enumerate(rows):
        key = tuple(np.sort(mix(r.astype(np.uint64)))[:2].tolist())
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def calibrated(model: tuple[np.ndarray, float], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """The model with its bias moved so that 0.5 is where the F1 estimated from rows not fitted is best.

    From positive and unlabelled rows: recall is the positives' share above, and precision is
    prior * recall over the unlabelled rows' share above.
    """
    weight, bias = model
    if not positive or not unlabelled:
        return model
    gp = np.sort([float(weight[r].sum()) + bias for r in positive])
    gu = np.sort([float(weight[r].sum()) + bias for r in unlabelled])
    levels = np.unique(np.concatenate([gp, gu]))
    cuts = (levels[1:] + levels[:-1]) / 2
    if not len(cuts):
        return model
    recall = 1 - np.searchsorted(gp, cuts) / len(gp)
    above = np.maximum(1 - np.searchsorted(gu, cuts) / len(gu), prior * recall)
    f = 2 * prior * recall / (prior + above)
    best = np.flatnonzero(f >= f.max() - 1e-12)  # of cuts that are as good the one that takes least
    return weight, bias - float(cuts[best[-1]])


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], confirmed: list[bool], prior: float) -> tuple[np.ndarray, float]:
    """Train on three quarters of the rows, near copies left out, and calibrate on the rest."""
    positive = [positive[i] for i in spread(positive)]
    few = spread(unlabelled)
    unlabelled, confirmed = [unlabelled[i] for i in few], [confirmed[i] for i in few]
    part = lambda rows, here: [r for k, r in enumerate(rows) if (k % 4 == 3) is here]
    model = train(part(positive, False), part(unlabelled, False), prior, part(confirmed, False))
    return calibrated(model, part(positive, True), part(unlabelled, True), prior)


def score_batch(text: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """The model's probability for each text; equals the sum over columns_of(text), columns without weight passed over."""
    used = weight != 0
    used |= used[again(np.arange(1 << BITS))]
    return np.concatenate([np.zeros(0), *(_scores(text.slice(lo, hi - lo), weight, used, bias) for lo, hi in slices(buffers(text)[1]))])


def _scores(text: pa.Array, weight: np.ndarray, used: np.ndarray, bias: float) -> np.ndarray:
    """score_batch for few texts; used: columns with weight, and those that may lead to one."""
    w = Words(text, SPACE_WORDS, prefixes=PREFIXES)
    doc, cols = [], []
    for k in features(w):
        at = np.flatnonzero(used[k])
        cols.append(k[at])
        doc.append(np.searchsorted(w.first, at, side="right") - 1)
    key, n = np.unique(np.concatenate(doc).astype(np.int64) << np.int64(BITS) | np.concatenate(cols), return_counts=True)
    twice = key[n >= 2]
    twice = twice >> BITS << BITS | again(twice & ((1 << BITS) - 1))
    key = np.unique(np.concatenate([key, twice]))
    total = np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)].astype(np.float64), len(w))
    return _sigmoid(total + bias)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias from the training rows of labels and from other training documents."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    known = known.where(~is_held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    toxic, rows = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not toxic:
        return train([], [], 0.0)
    prior = min(0.99, max(1e-4, toxic / rows))
    order = F.xxhash64(F.lit(17), "i")
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where(F.col("i").isNotNull() & ~is_held_out(F.col("i")))
    few_p = known.where("y = 1").orderBy(order, "i").limit(max_positive).select("i", F.lit(1).alias("p"))
    # confirmed toxic rows are a fixed share of the unlabelled stream as well: they are not taken out of it
    few_u = ids.distinct().orderBy(order, "i").limit(max_unlabelled).select("i", F.lit(0).alias("p"))
    few = F.broadcast(few_p.union(few_u).distinct())  # at most max_positive + max_unlabelled rows
    cols = F.arrow_udf(lambda t: pa.array([c.tobytes() for c in columns_of(t)], pa.binary()), "binary")
    got = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(few, "i").select("i", "p", cols("t").alias("c"))
    table = got.groupBy("i", "p").agg(F.min("c").alias("c")).toArrow()
    order = sorted(range(table.num_rows), key=lambda k, i=table.column("i").to_pylist(), c=table.column("c").to_pylist(): (mix(np.array([i[k]]).astype(np.uint64))[0], c[k]))
    table = table.take(pa.array(order, pa.int64()))
    sides: tuple[list, list] = ([], [])
    ids_of: tuple[list, list] = ([], [])
    for i, p, c in zip(*(table.column(x).to_pylist() for x in "ipc"), strict=True):
        sides[p].append(np.frombuffer(c, np.int32))
        ids_of[p].append(i)
    both = set(ids_of[1])
    return learn(sides[1], sides[0], [i in both for i in ids_of[0]], prior)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> Column:
    """A column with the score of docs' text, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda t: pa.array(score_batch(t, *shared.value), pa.float64()), "double")(F.col(f"`{text_col}`").cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = bounded(docs, 4096)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), scored(docs, model, text_col).alias("score"))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of docs with a score under 0.5, all columns as they are."""
    docs = bounded(docs, 4096)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    return docs.where(scored(docs, model, text_col) < 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
