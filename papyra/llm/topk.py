"""Exact top-k search by inner product, block at a time.

Vectors are cut into blocks of neighbouring ids ("document ranges"). A block keeps its vectors as a dense forward
index and, for each dimension (term), its largest and smallest component. A query's bound for a block is the sum
over terms of its largest possible products with that block. A group of queries goes through a pack's blocks by falling
bound, and each query skips the blocks whose bound is below its k-th best score so far, which it keeps from pack to
pack; blocks with an equal bound are still read, since a tie may go to their smaller ids. Bounds and scores are
whole numbers in float64 (exact up to 2^53), scores in float32 where lengths keep every sum below 2^24, so pruning
loses nothing.

The stated query set meets all vectors in cells: a cell is a share of the queries, of bounded bytes, and a slice of the
vectors. A task gets its cells' rows sorted, holds a cell's queries with their k best and streams its vectors past them,
a pack at a time; only k rows a query and slice come out. The last step keeps k of those. Queries are copied once for
each slice and vectors once for each share, as rows of a shuffle: they are never joined, so nothing can choose to
broadcast the copies through the driver, whatever the table's size.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; queries meet
vectors of their own length only. Every row is a candidate for the queries of other ids, so an id that repeats can
be named once for each of its rows; query rows that share an id are ranked together. Rows with equal score and id give equal
rows, so their order is of no account. Of rows equal in id and vector k are kept, since no more of them can be
among k rows; of equal vectors those of the k + 1 smallest ids are candidates, since equal scores go to smaller ids and
a query passes over one id at most. Fewer than k candidates give as many rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.store import bounded, cut

BLOCK = 256
PACK = 4096
GROUP = 512
#: Bytes of queries that a cell holds, as float32.
HOLD = 32 << 20
#: Vectors of a slice at most; slices that a table is cut into at least, if each has a pack.
SLICE = 1 << 19
SPREAD = 24
#: Bytes of vectors in a pack at most, as float32.
_PACK_BYTES = 8 << 20
#: Cells share tasks beyond so many; only tables of very many vector lengths have as many small cells.
_TASKS = 4096
#: Whole numbers up to this are exact in float32.
_FLOAT32 = 1 << 24
_SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector can't take part."""
    x = vector.cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


class Best:
    """The k best (score, id) of each query of a cell so far; ties to smaller ids. Queries are in order of their ids."""

    def __init__(self, ids: np.ndarray, query: np.ndarray, k: int, group: int = GROUP):
        self.ids, self.query, self.k, self.group = ids, query, k, group
        self.length = float(np.sqrt(np.einsum("ij,ij->i", query, query, dtype=np.float64).max(initial=0)))
        self.score = np.full((len(ids), k), -np.inf)
        self.name = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK) -> None:
        """A pack of vectors; ids rise."""
        cuts = np.arange(0, len(ids), block)
        top = np.maximum.reduceat(vectors, cuts, axis=0).astype(np.float64)
        low = np.minimum.reduceat(vectors, cuts, axis=0).astype(np.float64)
        length = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64).max(initial=0)))
        # no sum of some of a pair's products is above the product of their lengths
        kind = np.float32 if self.length * length < _FLOAT32 - 1 else np.float64
        vectors = vectors.astype(kind, copy=False)
        for at in range(0, len(self.ids), self.group):
            query = self.query[at : at + self.group].astype(np.float64)
            bounds = np.maximum(query, 0) @ top.T + np.minimum(query, 0) @ low.T
            query = query.astype(kind)
            for b in np.argsort(-bounds.max(axis=0), kind="stable"):
                rows = np.flatnonzero(bounds[:, b] >= self.score[at : at + len(query), -1])
                if len(rows):
                    part = slice(cuts[b], cuts[b] + block)
                    self._block(at, rows, query if len(rows) == len(query) else query[rows], ids[part], vectors[part])

    def _block(self, at: int, rows: np.ndarray, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = query @ vectors.T
        rows = rows + at
        own = self.ids[rows]
        for r in range(np.searchsorted(own, ids[0]), np.searchsorted(own, ids[-1], side="right")):
            score[r, np.searchsorted(ids, own[r]) : np.searchsorted(ids, own[r], side="right")] = -np.inf
        least = self.score[rows, -1].astype(score.dtype)
        hit = np.flatnonzero(score.max(axis=1) >= least)
        if not len(hit):
            return
        rows, score, least = rows[hit], score[hit], least[hit]
        if len(ids) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        row, col = np.nonzero(score >= least[:, None])
        # each row's k so far and its new ones, best first, k of which stay
        n, k = len(rows), self.k
        row_ = np.concatenate([np.repeat(np.arange(n), k), row])
        score_ = np.concatenate([self.score[rows].ravel(), score[row, col].astype(np.float64)])
        name_ = np.concatenate([self.name[rows].ravel(), ids[col]])
        order = np.lexsort((name_, -score_, row_))
        starts = np.searchsorted(row_[order], np.arange(n))
        pick = order[(starts[:, None] + np.arange(k)).ravel()]
        self.score[rows], self.name[rows] = score_[pick].reshape(n, k), name_[pick].reshape(n, k)

    def rows(self, size: int = 1 << 16):
        """Batches of query_id, vec_id, score."""
        row, col = np.nonzero(self.score > -np.inf)
        for at in range(0, len(row), size):
            r, c = row[at : at + size], col[at : at + size]
            columns = [pa.array(self.ids[r]), pa.array(self.name[r, c]), pa.array(self.score[r, c].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of rows of one cell; float32 if narrow."""
    narrow, wide = batch.column("narrow"), batch.column("wide")
    if not narrow.null_count:
        flat = narrow.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float32).reshape(len(narrow), len(flat) // len(narrow))
    is_wide = narrow.is_null().to_numpy(zero_copy_only=False)
    out = np.empty((len(narrow), len(wide[int(np.argmax(is_wide))])))
    out[is_wide] = wide.flatten().to_numpy(zero_copy_only=False).reshape(-1, out.shape[1])
    out[~is_wide] = narrow.flatten().to_numpy(zero_copy_only=False).reshape(-1, out.shape[1])
    return out


def _runs(batches):
    """(cell, whether vectors, ids, vectors) of runs of rows of one cell and kind."""
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])) + 1
        for a, b in zip([0, *ends], [*ends, len(cell)], strict=True):
            if a < b:
                part = batch.slice(a, b - a)
                yield int(cell[a]), bool(doc[a]), part.column("vec_id").to_numpy(zero_copy_only=False), _matrix(part)


def search(batches, k: int, pack: int = PACK, group: int = GROUP):
    """Rows of cells, sorted by cell, queries first, and id: batches of each cell's k best of its queries."""
    now, best, ids, vectors, held = None, None, [], [], 0

    def close():
        if best is not None:
            if ids:
                best.meet(np.concatenate(ids), np.concatenate(vectors))
            yield from best.rows()

    for cell, doc, id_, matrix in _runs(batches):
        if cell != now:
            yield from close()
            now, best, ids, vectors, held = cell, None, [], [], 0
        if doc and best is None:
            if not ids:
                continue  # a cell that the hash left without queries
            best = Best(np.concatenate(ids), np.concatenate(vectors), k, group)
            ids, vectors, held = [], [], 0
        size = max(1, min(pack, _PACK_BYTES // max(1, 4 * matrix.shape[1]))) if doc else len(id_)
        while len(id_):
            n = size - held if doc else len(id_)
            ids.append(id_[:n])
            vectors.append(matrix[:n])
            held += len(ids[-1])
            id_, matrix = id_[n:], matrix[n:]
            if doc and held >= size:
                best.meet(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors, held = [], [], 0
    yield from close()


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pack: int = PACK, group: int = GROUP, hold: int = HOLD
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query; is_query is a condition on ``vec_id``."""
    vectors = bounded(vectors, PACK)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null")
    fits = F.forall("v", lambda x: x.between(-(1 << 15), (1 << 15) - 1))
    base = base.select("vec_id", F.when(fits, F.col("v").cast("array<short>")).alias("narrow"), F.when(~fits, F.col("v")).alias("wide"))
    row = ["vec_id", "narrow", "wide"]

    def kept(table: DataFrame, what: str, most: int | None = None) -> DataFrame:
        table = table.groupBy(*row).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
        if most:
            alike = Window.partitionBy(F.xxhash64("narrow", "wide"), "narrow", "wide").orderBy("vec_id")
            table = table.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= most)
        copy = F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
        return cut(table.select(*row, copy, F.greatest(F.size("narrow"), F.size("wide")).alias("dim")), what)

    queries, docs = kept(base.where(is_query), "queries"), kept(base, "vectors", k + 1)
    plan, cells = [], 0  # one row for each vector length that has queries
    sizes = queries.groupBy("dim").agg(F.count("*").alias("q")).join(docs.groupBy("dim").agg(F.count("*").alias("n")), "dim")
    for r in sizes.orderBy("dim").collect():
        slices = max(-(-r.n // SLICE), min(-(-r.n // pack), SPREAD))
        shares = -(-r.q // max(1, hold // max(1, 4 * r.dim)))
        plan.append((r.dim, slices, shares, cells))
        cells += slices * shares
    plan = F.broadcast(vectors.sparkSession.createDataFrame(plan, "dim int, slices int, shares int, first int"))
    # hash slices keep every slice near its size whatever the ids; ids rise inside a slice, and its blocks are ranges of them
    docs = docs.join(plan, "dim").withColumn("slice", F.pmod(F.xxhash64(*row, "copy"), F.col("slices"))).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    asked = queries.join(plan, "dim").withColumn("share", F.pmod(F.xxhash64(F.lit(1), *row, "copy"), F.col("shares")))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cell = (F.col("first") + F.col("slice") * F.col("shares") + F.col("share")).cast("int").alias("cell")
    work = asked.select(cell, F.lit(False).alias("doc"), *row).union(docs.select(cell, F.lit(True).alias("doc"), *row))
    work = work.repartitionById(max(1, min(cells, _TASKS)), F.col("cell")).sortWithinPartitions("cell", "doc", "vec_id")
    found = work.mapInArrow(lambda batches: search(batches, k, pack, group), _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return """
with base as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score
  from base q join base d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5"""
