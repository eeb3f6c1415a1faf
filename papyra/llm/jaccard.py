"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document's row of the matrix is its set of k-word shingles (64-bit hashes). Two documents link when
``100 * intersection >= percent * union``. Equal rows are one class, found by grouping on a hash of the row, so copies
meet no product at all.

Linked rows of sizes a and b differ in at most ``(a + b) * (100 - percent) / (100 + percent)`` n-grams. The columns are
cut into more blocks than that, so linked rows agree wholly in at least ``blocks - bound`` blocks. A row
keeps only its ``bound + 1`` fullest blocks (order: size, then hash), since rows that share s blocks share one that
neither leaves out when it drops its last s - 1. Only cells of the product whose rows share such a block are
computed; all others are below the size-derived bound. How many blocks there are depends on a range of sizes
whose ends differ by the threshold; a row takes part in its own range and in the next one.

Every cell that is computed is computed by a product that accumulates overlap counts: of one row with a block of rows
(``row_product``) or of two row blocks over column blocks (``tile_links``); cells whose sizes can't reach the threshold
are discarded before any row of the matrix moves.

Cells are computed in two rounds. First every row of a block value meets one pivot, which makes
one class of most near copies. Rows of one Arrow batch that share a value meet the batch's first such row, and only
that row goes into the shuffle by value, so a value that very many rows hold arrives once for each batch; there the smallest row
is the pivot. Block values whose rows are all connected by then can't change a component and are left
out. Of the others, values of at most ``FEW`` rows give their cells with each row as a pivot, and larger ones give tiles: their rows are packed
into row blocks of bounded count and bytes, two row blocks that share a value are one tile, and a tile's product is
accumulated over column blocks until every cell is decided, with cells that can't reach their bound
discarded on the way. A tile returns a spanning forest of its links, so no group is written out as pairs. Overlap counts come
from the rows themselves, so every accepted link is exact (up to equal 64-bit hashes).

One pass over the texts writes sizes, names and block values; the rows of the matrix are made again from the text, and only for
documents that share a block. A table is deleted as soon as its successor is written.

Components are found by contraction: every node that has a smaller neighbour joins the smallest such, chains are
shortened by doubling, and the edges between what is left are contracted again. All tables stay distributed.

Null and empty texts have empty sets and link with nothing, nor do rows without an id (null component_id). Repeated
rows are copies. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.store import Scratch, bounded, free_names, if_few, slices
from papyra.llm.words import SPACE_WORDS, Words, buffers, mix, shingles

WORDS, PERCENT = 5, 80
#: Rows of a block value from which on it is worked on in tiles; rows and bytes of a row block; columns of a column block.
FEW, TILE_ROWS, TILE_BYTES, TILE_COLUMNS = 16, 256, 8 << 20, 2048
_SHIFT = np.uint64(32)


def size_ranges(percent: int) -> np.ndarray:
    """Last size of each range; the next one begins above it."""
    last, out = 0, []
    while last < 1 << 40:
        last = (last + 1) * 100 // percent
        out.append(last)
    return np.array(out)


def block_values(row: np.ndarray, percent: int, last: np.ndarray) -> np.ndarray:
    """Hashes of the blocks by which a row (sorted distinct uint64) may meet others."""
    n, off, out = len(row), 100 - percent, []
    own = int(np.searchsorted(last, n))
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(row))])
    for j in (own, own + 1):
        partner = min(int(last[j]), n * 100 // percent)
        bound = (n + partner) * off // (100 + percent)
        if not bound or (j > own and partner <= last[own]):
            continue
        most = 2 * int(last[j]) * off // (100 + percent)
        blocks = most + 1 + most // 6
        part = (row >> _SHIFT) * np.uint64(blocks) >> _SHIFT
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        count = np.diff(np.append(first, n))
        total = mixed[np.append(first[1:], n)] - mixed[first]
        seed = mix(np.array([(j << 32) + 1], np.uint64))[0]
        value = mix(total + mix(part[first] + seed))
        if len(value) > bound:
            value = value[np.lexsort((value, -count))[: bound + 1]]
        else:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), part[first])
            value = np.concatenate([value, np.sort(mix(mix(empty + seed)))[: bound + 1 - len(value)]])
        out.append(value)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(grams: np.ndarray) -> int | None:
    """Hash of a whole row; null for an empty one."""
    if not len(grams):
        return None
    return int(mix(mix(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


SIGNED = "doc_id long, h long, n long, node long, own array<long>, met array<struct<value:long,pivot:long>>"


def signed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """For each row its id, hash of the text, size, node, and block values: own, and those met with a pivot of its batch."""
    last = size_ranges(percent)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(batches):
        for b in batches:
            for lo, hi in slices(buffers(b.column(2))[1], 8 << 20):
                yield part(b.slice(lo, hi - lo))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0)
        n, nodes, values, seen = [], [], [], set()
        for s, known in zip(shingles(Words(b.column(2), SPACE_WORDS), k), ids.is_valid().to_pylist(), strict=True):
            node = node_of(s)
            n.append(len(s))
            nodes.append(node)
            fresh = known and node is not None and node not in seen
            values.append(block_values(s, percent, last) if fresh else np.zeros(0, np.uint64))
            if fresh:
                seen.add(node)
        size = np.array([len(v) for v in values], np.int64)
        every = np.concatenate(values).view(np.int64)
        row = np.repeat(np.arange(len(values)), size)
        _, first, where = np.unique(every, return_index=True, return_inverse=True)
        pivot = row[first[where]]
        mine = pivot == row
        name = np.array([x or 0 for x in nodes], np.int64)
        ends = lambda keep: pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(values)))]), pa.int32())
        own = pa.ListArray.from_arrays(ends(mine), pa.array(every[mine]))
        pairs = pa.StructArray.from_arrays([pa.array(every[~mine]), pa.array(name[pivot[~mine]])], names=["value", "pivot"])
        met = pa.ListArray.from_arrays(ends(~mine), pairs)
        cols = [ids, b.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), own, met]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n", "node", "own", "met"])

    return rows.mapInArrow(run, SIGNED)


def gram_rows(docs: DataFrame, used: DataFrame, repeated: bool, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, n, grams for the documents of used (doc_id, h, node, n)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(column: pa.Array) -> pa.Array:
        out = []
        for lo, hi in slices(buffers(column)[1], 8 << 20):
            out += [s.tobytes() for s in shingles(Words(column.slice(lo, hi - lo), SPACE_WORDS), k)]
        return pa.array(out, pa.binary())

    found = rows.join(if_few(used), ["doc_id", "h"]).select("node", "n", F.arrow_udf(run, "binary")("text").alias("grams"))
    return found.dropDuplicates(["node"]) if repeated else found


def row_product(pivot: np.ndarray, rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of rows reach the threshold with pivot: a sparse vector by sparse matrix product, with overlap counts summed by row."""
    size = np.array([len(r) for r in rows], np.int64)
    near = np.flatnonzero(100 * np.minimum(size, len(pivot)) >= percent * np.maximum(size, len(pivot)))
    overlap = np.zeros(len(rows), np.int64)
    if len(near) and len(pivot):
        column = np.concatenate([rows[i] for i in near])
        row = np.repeat(near, size[near])
        hit = pivot[np.minimum(np.searchsorted(pivot, column), len(pivot) - 1)] == column
        overlap += np.bincount(row[hit], minlength=len(rows))
    return (overlap > 0) & (100 * overlap >= percent * (size + len(pivot) - overlap))


def links(cells: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """a, b of the cells (a, b) whose overlap reaches the threshold; rows: node, n, grams.

    The cells of one b are cut into blocks of bounded count and bytes, so a b with very many cells is many products.
    """
    sizes = rows.select("node", "n")
    sized = cells.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    sized = sized.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    many = F.ceil(F.greatest(F.count("*") / F.lit(TILE_ROWS), F.sum("na") * 8 / F.lit(TILE_BYTES)))
    placed = sized.join(sized.groupBy("b").agg(many.alias("many")), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("many")).alias("part"))
    packs = placed.join(rows.select(F.col("node").alias("a"), "grams"), "a").groupBy("b", "part").agg(F.collect_list("a").alias("names"), F.collect_list("grams").alias("left"))

    def run(names: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for ids, block, pivot in zip(names, left, right, strict=True):
            found = row_product(np.frombuffer(pivot.as_buffer(), np.uint64), [np.frombuffer(x.as_buffer(), np.uint64) for x in block], percent)
            out.append([i for i, yes in zip(ids.as_py(), found, strict=True) if yes])
        return pa.array(out, pa.list_(pa.int64()))

    met = packs.join(rows.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    return met.select(F.explode(F.arrow_udf(run, "array<long>")("names", "left", "right")).alias("a"), "b")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which cells of left x right reach the threshold."""
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    need = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    la, lb = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    ga, gb = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(ga, gb)
    if not len(both):
        return np.zeros(need.shape, bool)

    def columns(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, g), len(both) - 1)
        at, r = at[both[at] == g], r[both[at] == g]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    (ca, ra), (cb, rb) = columns(ga, la), columns(gb, lb)
    rest_a, rest_b = np.bincount(ra, minlength=len(left)), np.bincount(rb, minlength=len(right))
    overlap = np.zeros(need.shape)
    for lo in range(0, len(both), TILE_COLUMNS):
        if not (overlap + np.minimum(rest_a[:, None], rest_b[None, :]) >= need).any():
            break
        a, b = np.zeros((len(left), TILE_COLUMNS), np.float32), np.zeros((len(right), TILE_COLUMNS), np.float32)
        for m, c, r, rest in ((a, ca, ra, rest_a), (b, cb, rb, rest_b)):
            x, y = np.searchsorted(c, [lo, lo + TILE_COLUMNS])
            m[r[x:y], c[x:y] - lo] = 1
            rest -= np.bincount(r[x:y], minlength=len(rest))
        overlap += a @ b.T
    return overlap >= need


def forest(names: list[int], more: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between names (rows) and more (columns)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        a, b = top(names[i]), top(more[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((names[i], more[j]))
    return out


def dense_links(known: DataFrame, rows: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """a, b: links that connect whatever the values of known (value, node) with more than FEW rows can connect."""
    star = known.groupBy("value").agg(F.min("node").alias("b"))
    cluster = components(known.join(star, "value").select(F.col("node").alias("a"), "b").distinct(), tables)
    sized = rows.select("node", "n").join(cluster, "node")
    many = sized.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / F.lit(TILE_ROWS), F.sum("n") * 8 / F.lit(TILE_BYTES))).alias("many"))
    place = F.struct("comp", F.pmod(F.xxhash64("node"), F.col("many")).alias("k"))
    placed = tables.cut(cluster.join(many, "comp").select("node", place.alias("place")), "placed")
    packs = tables.cut(rows.join(placed, "node").groupBy("place").agg(F.collect_list("node").alias("nodes"), F.collect_list("grams").alias("rows")), "packs")
    met = known.join(placed, "node").select("value", "place").distinct()
    tiles = met.toDF("value", "p").join(met.toDF("value", "q"), "value").where("p >= q").select("p", "q").distinct()

    def run(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for names, left, more, right in zip(a, x, b, y, strict=True):
            sets = [[np.frombuffer(r.as_buffer(), np.uint64) for r in side] for side in (left, right)]
            out.append([{"a": u, "b": v} for u, v in forest(names.as_py(), more.as_py(), tile_links(*sets, percent))])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    made = F.arrow_udf(run, "array<struct<a:long,b:long>>")
    out = tiles.join(packs.toDF("p", "a", "x"), "p").join(packs.toDF("q", "b", "y"), "q")
    out = tables.cut(out.select(F.inline(made("a", "x", "b", "y"))), "links")
    tables.drop(cluster, placed, packs)
    return out


def components(edges: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """node, comp for each node of the edges (a, b)."""
    tables = tables or Scratch(edges.sparkSession)
    rest = tables.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    names = rest.select("a").union(rest.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp"))
    names = tables.cut(names, "comp")
    while not rest.isEmpty():
        up = tables.cut(rest.groupBy("a").agg(F.min("b").alias("up")).toDF("node", "up"), "up")
        while True:
            above = up.toDF("up", "above")
            if up.join(above, "up", "left_semi").isEmpty():
                break
            short = tables.cut(up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up")), "up")
            tables.drop(up)
            up = short
        raised = tables.cut(names.join(up.toDF("comp", "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "comp")
        fewer = tables.cut(_raised(_raised(rest, up).toDF("b", "a"), up).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        tables.drop(names, rest, up)
        names, rest = raised, fewer
    tables.drop(rest)
    return names


def _raised(edges: DataFrame, up: DataFrame) -> DataFrame:
    """edges with column a replaced by its top; columns a, b."""
    return edges.join(up.toDF("a", "up"), "a", "left").select(F.coalesce("up", "a").alias("a"), "b")


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of docs."""
    return grouped(docs, k, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """For each row doc_id, h (hash of the text), n, node, comp (names the component whatever ids its rows have), component_id."""
    docs = bounded(docs)
    tables = Scratch(docs.sparkSession)
    both = tables.cut(signed(docs, k, percent, id_col, text_col), "signed")
    every = tables.cut(both.select("doc_id", "h", "n", "node"), "every")
    # a row that met a pivot in its batch is done; of the others the smallest of each value is the pivot
    pivot = F.first("node").over(Window.partitionBy("value").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    stars = both.select("node", F.explode("own").alias("value")).select("value", F.col("node").alias("a"), pivot.alias("b"))
    batch = both.select("node", F.explode("met").alias("m")).select("m.value", F.col("node").alias("a"), F.col("m.pivot").alias("b"))
    stars = tables.cut(stars.union(batch).where("a <> b"), "stars")
    tables.drop(both)
    classes = tables.cut(every.where("doc_id is not null and node is not null").groupBy("node", "n").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("node", "n", "r.*"), "classes")
    shared = tables.cut(stars.select("value", F.col("a").alias("node")).union(stars.select("value", "b")).distinct(), "shared")
    first = tables.cut(stars.select("a", "b").distinct(), "cells")
    tables.drop(stars)
    used = tables.cut(classes.join(shared.select("node").distinct(), "node"), "used")
    repeated = every.join(used, ["doc_id", "h"], "left_semi").count() > used.count()
    rows = tables.cut(gram_rows(docs, used, repeated, k, id_col, text_col), "rows")
    tables.drop(used)
    found = tables.cut(links(first, rows, percent), "links")
    comp = components(found, tables)
    known = shared.join(comp, "node", "left").select("value", "node", F.coalesce("comp", "node").alias("comp"))
    open_values = known.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("value", "size")
    known = tables.cut(known.join(open_values, "value"), "open")
    tables.drop(shared)
    few = known.where(F.col("size") <= FEW).select("value", "node", "comp")
    x, y = few.toDF("value", "a", "ca"), few.toDF("value", "b", "cb")
    cells = tables.cut(x.join(y, "value").where("a > b and ca <> cb").select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "cells")
    more = tables.cut(links(cells, rows, percent), "links")
    tables.drop(first, cells)
    dense = known.where(F.col("size") > FEW).select("value", "node")
    if not dense.isEmpty():
        tiled = dense_links(dense, rows, percent, tables)
        both = tables.cut(more.union(tiled), "links")
        tables.drop(more, tiled)
        more = both
    tables.drop(rows, known)
    if not more.isEmpty():
        whole = components(found.union(more), tables)
        tables.drop(comp)
        comp = whole
    # classes without a link name themselves
    named = classes.join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    named = tables.cut(named, "named")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    real = every.where("doc_id is not null and node is not null").join(named, "node")
    none = F.lit(None).cast("long")
    rest = every.where("doc_id is null or node is null").withColumns({"comp": none, "component_id": F.when(F.col("node").isNull(), F.col("doc_id"))})
    columns = ["doc_id", "h", "n", "node", "comp", "component_id"]
    out = tables.cut(real.select(columns).union(rest.select(columns)), "groups")
    tables.drop_all(out)
    return out


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of docs: of those with its smallest id that with the smallest node, then text.

    Rows without an id stay, and rows with an empty set of shingles, of which one stays for each id and text; of rows
    with equal id and text that stays whose columns are smallest as JSON. Columns are those of docs, whatever their names.
    """
    groups = grouped(docs, k, percent, id_col, text_col).where("doc_id is not null").withColumn("g", F.coalesce("node", "h"))
    real = groups.where("node is not null")
    chosen = real.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("r")).select("r.doc_id", F.col("r.node").alias("g"))
    names = free_names(docs, "id", "hash", "name", "row")
    text = F.col(f"`{text_col}`").cast("string")
    key = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(text)]

    def met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        side = if_few(keys.toDF(*names[: len(keys.columns)]))
        return rows.join(side, (key[0] == F.col(names[0])) & (key[1] == F.col(names[1])), how)

    tables = Scratch(docs.sparkSession)
    gone = tables.cut(real.select("doc_id", "h", "g").distinct().join(chosen, ["doc_id", "g"], "left_anti").select("doc_id", "h"), "gone")
    left = groups.join(gone, ["doc_id", "h"], "left_anti")
    twice = left.groupBy("doc_id", "g").count().where("count > 1")
    again = tables.cut(left.join(twice, ["doc_id", "g"]).select("doc_id", "h", "g").distinct(), "again")
    out = met(docs, gone, "left_anti")
    if again.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = met(out, again, "inner").select(key[0].alias(names[0]), F.col(names[2]), F.struct(text.alias("t"), F.to_json(row).alias("j")).alias(names[1]), row.alias(names[3]))
    one = one.groupBy(names[0], names[2]).agg(F.min_by(names[3], names[1]).alias(names[3])).select(f"{names[3]}.*")
    return met(out, again.drop("g"), "left_anti").unionByName(one)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


def oracle() -> str:
    """DuckDB SQL for op5: all overlaps by a join on shingles, then the smallest id that links reach."""
    return r"""
with recursive cut as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from cut),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as r from sets union select reach.doc_id, links.y from reach join links on links.x = reach.r)
select sets.doc_id, len(s) as n_shingles, min(r) as component_id from sets join reach on reach.doc_id = sets.doc_id group by sets.doc_id, len(s)"""
