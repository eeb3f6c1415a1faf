"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources in code point order (null last) have the weights given, repeating. They share a total of ``share`` times all
sizes by weight; a target stops at ``cap`` times its source's size and the excess is shared out again by weight, which
is the level L with sum(min(cap * size, L * weight)) = total, found with prefix sums over sources ordered by cap/weight.

A source is taken whole as often as its target holds it (complete epochs). For the rest each document has the key
-ln(u)/quality with u from a hash of its id, and the documents with the smallest keys are taken up to the remaining
budget: a document belongs if at least half of it lies inside. So a source's total misses its target by at most half of
the document at the cut, and reruns agree.

A source may hold most rows, so no window runs over a whole source: sizes are first summed by source and one of
``buckets`` ranges of the key (partial sums on the map side), and only the documents of the one range in which a
source's budget ends are put in order. What is known of each source is broadcast where sources are counted to be at most
``MOST_SOURCES``; beyond that it is joined by a shuffle, on the source and one of ``SALTS`` numbers, so that a source's rows
meet it in as many tasks.

Null texts have size 0 and take nothing; null sources are one source; the key of a null id comes from the text;
repeated rows are documents of their own, and where the budget ends between equal rows so many of them are taken as
lie at least half inside. Of rows that differ in other columns only, those with the smallest row as JSON come first. Columns
of docs may have any names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.llm.store import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096
CAP = 3.0
#: Sources up to which their plan is broadcast (some 100 bytes each), and parts of a source in the shuffle beyond that.
MOST_SOURCES, SALTS = 1 << 16, 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """0.25 to 1: prose has a sentence mark for each ten words or fewer."""
    marks = F.coalesce(F.regexp_count(text, F.lit("[.!?]")), F.lit(0)).cast("double")
    return F.lit(0.25) + F.lit(0.75) * F.least(F.lit(1.0), F.lit(10.0) * marks / F.greatest(size.cast("double"), F.lit(1.0)))


def key_of(doc_id: Column, text: Column, quality: Column) -> Column:
    """-ln(u)/quality, u in (0, 1) from 48 bits of the md5 of the id, or of the text's md5 where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.ln((bits + F.lit(0.5)) / F.lit(281474976710656.0)) / quality


def _bucket(key: Column, buckets: int) -> Column:
    return F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-key))).cast("int")


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, buckets: int, quality: Column | None, whole: bool) -> DataFrame:
    """id, source, size, at (key, id, size, hash of the text: the order of a source's rows), bucket; if whole, row, all of docs' columns."""
    col = lambda c: F.col(f"`{c}`")
    kept = [F.struct(*[col(c) for c in docs.columns]).alias("row")] if whole else []
    text = col(text_col).cast("string")
    weight = [quality.cast("double").alias("quality")] if quality is not None else []
    out = docs.select(col(id_col).cast("long").alias("id"), col(source_col).cast("string").alias("source"), text.alias("text"), *weight, *kept)
    out = out.withColumn("size", size_of(F.col("text")))
    if quality is None:
        out = out.withColumn("quality", quality_of(F.col("text"), F.col("size")))
    key = key_of(F.col("id"), F.col("text"), F.col("quality")).alias("key")
    out = out.select("id", "source", "size", F.struct(key, "id", "size", F.xxhash64("text").alias("h")).alias("at"), *(["row"] if whole else []))
    return out.withColumn("bucket", _bucket(F.col("at.key"), buckets))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target from one row a source."""
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))))
    out = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    out = out.withColumn("level", (total - before) / rest).withColumn("place", F.row_number().over(by_level))
    full = F.col("most") / F.col("w") <= F.col("level")
    first = F.min(F.when(~full, F.struct("place", "level"))).over(every)
    return out.select("source", "source_size", F.when(full, F.col("most")).otherwise(first.level * F.col("w")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float, tables: Scratch) -> DataFrame:
    """For each source: source_size, target, epochs, and where its fraction ends (end_bucket; end: last at; take: how many rows with it)."""
    parts = tables.cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mixing")
    aims = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = tables.cut(aims.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("upto", F.sum("n").over(run)).alias("p").join(aims.alias("a"), _same("p", "a"))
    ends = ends.where("upto > budget and upto - n <= budget and n > 0").select("p.source", F.col("bucket").alias("end_bucket"), (F.col("budget") - (F.col("upto") - F.col("n"))).alias("left"))
    ends = tables.cut(ends, "ends")
    near = _with_plan(rows, ends).where(F.col("bucket") == F.col("end_bucket")).groupBy("source", "left", "at").agg(F.count("*").alias("c"))
    size = F.col("at.size")
    before = F.sum(size * F.col("c")).over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - size * F.col("c")
    # of c equal rows the j-th lies at least half inside if before + j * size - size / 2 <= left
    take = F.least(F.col("c"), F.greatest(F.lit(0), F.floor((F.col("left") - F.col("before")) / size + F.lit(0.5)))).cast("long")
    last = near.where(size > 0).withColumn("before", before).withColumn("take", take).where("take > 0")
    last = last.groupBy("source").agg(F.max(F.struct("at", "take")).alias("end")).select("source", F.col("end.at").alias("end"), F.col("end.take").alias("take"))
    out = aims.alias("a").join(ends.alias("e"), _same("a", "e"), "left").select("a.*", "end_bucket")
    return tables.cut(out.alias("a").join(last.alias("l"), _same("a", "l"), "left").select("a.*", "end", "take"), "plan")


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with their source's line of planned."""
    more = [f"p.{c}" for c in planned.columns if c != "source"]
    if planned.count() <= MOST_SOURCES:
        return rows.alias("r").join(F.broadcast(planned).alias("p"), _same("r", "p")).select("r.*", *more)
    salted = planned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    here = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    return here.alias("r").join(salted.alias("p"), _same("r", "p") & (F.col("r.salt") == F.col("p.salt"))).select(*[f"r.{c}" for c in rows.columns], *more)


def times(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with source_size, target and times, how often each is taken."""
    out = _with_plan(rows, planned)
    at_end = F.coalesce(F.col("at") == F.col("end"), F.lit(False))
    inside = F.coalesce((F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (F.col("at") < F.col("end"))), F.lit(False))
    names = [*rows.columns, "source_size", "target"]
    plain = out.where(~at_end).select(*names, F.when(F.col("size") > 0, F.col("epochs") + inside.cast("long")).otherwise(F.lit(0).cast("long")).alias("times"))
    # equal rows at the end are counted, not listed, until some of them are taken once more
    whole = "row" in rows.columns
    json = F.to_json("row") if whole else F.lit("")
    first = [F.first(c).alias(c) for c in [*(x for x in names if x != "source"), "epochs", "take"]]
    equal = out.where(at_end).withColumn("json", json).groupBy("source", "json").agg(*first, F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source").orderBy("json").rowsBetween(Window.unboundedPreceding, 0))
    equal = equal.withColumn("more", F.greatest(F.lit(0), F.least(F.col("c"), F.col("take") - (upto - F.col("c")))))
    equal = equal.select(*names, "epochs", "more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"))
    return plain.unionByName(equal.select(*names, (F.col("epochs") + (F.col("i") <= F.col("more")).cast("long")).alias("times")))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, buckets: int = BUCKETS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; quality: positive weight of a row, by default from its prose."""
    tables = Scratch(docs.sparkSession)
    rows = tables.cut(measured(docs, id_col, source_col, text_col, buckets, quality, False), "measured")
    out = times(rows, plan(rows, weights, share, cap, tables))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, buckets: int = BUCKETS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None) -> DataFrame:
    """The rows of the mix, columns as in docs; a document that is taken n times is there n times."""
    tables = Scratch(docs.sparkSession)
    rows = measured(docs, id_col, source_col, text_col, buckets, quality, True)
    planned = plan(tables.cut(rows.drop("row"), "measured"), weights, share, cap, tables)
    tables.drop_all(planned)
    out = times(rows, planned).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i")).select("row.*")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    return """
with m as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    coalesce(len(regexp_extract_all(text, '[.!?]')), 0) as marks,
    (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 12)) as bigint) + 0.5::double) / 281474976710656.0::double as u from documents),
k as (select *, -ln(u) / (0.25::double + 0.75::double * least(1.0::double, 10.0::double * marks / greatest(cast(size as double), 1.0::double))) as key from m),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
    3.0::double * source_size as most from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level,
    row_number() over (order by most / w, source nulls last) as place from w),
f as (select min(place) as place from l where most / w > level),
t as (select l.source, source_size, case when most / w <= level then most else (select level from l l2, f where l2.place = f.place) * w end as target from l),
r as (select k.doc_id, k.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
    sum(k.size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and current row) as upto
  from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(size * (epochs + case when upto - size / 2.0 <= target - epochs * source_size then 1 else 0 end) as bigint) as taken from r"""
