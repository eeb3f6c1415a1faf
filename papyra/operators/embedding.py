"""Embedding sets: elements, chunks, ids and keys, index state, retention, default sets.

An index is three tables (sets, entries, defaults); each operation maps old tables to new ones, which a ``SnapshotTable`` commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import text as T
from papyra.operators.reading import _ctx, _session, last_of
from papyra.operators.retrieval import cosine, hash_embedding
from papyra.sources import corpus
from papyra.sources.corpus import WITH

SET_KEY = ("tenant_id", "document_id", "mask_id", "mask_version", "template_id", "template_version")


def semantic_elements(values: DataFrame, resolved: DataFrame) -> DataFrame:
    """Present values with the role and section of their mask entry; of an element's entries the last one counts."""
    entries = last_of(resolved, ["template_id", "template_version", "element_id"], F.col("ord")).select("template_id", "template_version", "element_id", "semantic_role", "section_path", "mask_id", "mask_version")
    return values.where("state = 'present'").join(entries, ["template_id", "template_version", "element_id"])


def semantic_chunks(rows: DataFrame) -> DataFrame:
    """One chunk a value: chunk_id, text, section_path; a null role is an error."""
    role = F.coalesce("semantic_role", F.raise_error(F.lit("an element without a role")).cast("string"))
    return rows.select(F.concat_ws(":", "document_id", "element_id", F.lit(0)).alias("chunk_id"), "document_id", role.alias("semantic_role"), "section_path", F.col("value").alias("text"))


def heading_paths(elements: DataFrame) -> DataFrame:
    """template_id, template_version, element_id, section_path: the dotted number that a value region's label begins with."""
    path = F.when(F.col("kind") == "value_region", T.section_number(F.col("label_text")))
    return elements.select("template_id", "template_version", "element_id", path.alias("section_path")).where("section_path is not null")


def structural_elements(values: DataFrame, elements: DataFrame) -> DataFrame:
    """Present values with the section of their heading, if their template has one for them."""
    return values.where("state = 'present'").join(heading_paths(elements), ["template_id", "template_version", "element_id"], "left")


def set_tier(mask_id: Column) -> Column:
    return F.when(mask_id.isNull(), "structural").otherwise("semantic")


def checked_keys(sets: DataFrame) -> DataFrame:
    """sets with tier; an empty tenant or document, or an id without its version, is an error."""
    pair = lambda a, b: F.col(a).isNull() == F.col(b).isNull()
    fine = (F.coalesce("tenant_id", F.lit("")) != "") & (F.coalesce("document_id", F.lit("")) != "") & pair("mask_id", "mask_version") & pair("template_id", "template_version")
    return sets.withColumn("tier", F.when(fine, set_tier(F.col("mask_id"))).otherwise(F.raise_error(F.lit("the key of an embedding set is incomplete")).cast("string")))


def build_key(document: Column, mask_id: Column, mask_version: Column, template_id: Column, template_version: Column) -> Column:
    """Idempotency key of a build job; what is missing is written None."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    semantic = F.concat_ws(":", F.lit("embedding-build"), document, F.lit("mask"), mask_id, none(mask_version))
    structural = F.concat_ws(":", F.lit("embedding-build"), document, F.lit("structural"), none(template_id), none(template_version))
    return F.when(mask_id.isNull(), structural).otherwise(semantic)


def encode_payload(sets: DataFrame) -> Column:
    """The six parts of a key as JSON; nulls are kept."""
    return F.to_json(F.struct(*SET_KEY), {"ignoreNullFields": "false"})


def decode_payload(payload: Column) -> Column:
    return F.from_json(payload, "tenant_id string, document_id string, mask_id string, mask_version int, template_id string, template_version int")


def same_key(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in SET_KEY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def register(sets: DataFrame, new: DataFrame) -> DataFrame:
    """sets with new ones that aren't there yet, as building."""
    fresh = new.dropDuplicates(list(SET_KEY)).alias("n").join(sets.alias("s"), same_key("n", "s"), "left_anti")
    return sets.unionByName(fresh.select(*SET_KEY, F.lit("building").alias("status"), "created_at"))


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with new ones in place of those of the same set and chunk."""
    both = entries.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    return last_of(both, [*SET_KEY, "chunk_id"], F.col("turn")).drop("turn")


def missing_entries(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks that a resumed build has still to embed."""
    return wanted.alias("w").join(entries.select(*SET_KEY, "chunk_id").alias("e"), same_key("w", "e") & (F.col("w.chunk_id") == F.col("e.chunk_id")), "left_anti")


def mark_complete(sets: DataFrame, keys: DataFrame) -> DataFrame:
    done = sets.alias("s").join(keys.select(*SET_KEY).distinct().withColumn("done", F.lit(True)).alias("k"), same_key("s", "k"), "left")
    return done.select("s.*", "k.done").withColumn("status", F.when(F.col("done"), "complete").otherwise(F.col("status"))).drop("done")


def set_defaults(defaults: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """defaults (one key a tenant and document) switched to keys; one that isn't complete is an error."""
    met = keys.alias("k").join(sets.alias("s"), same_key("k", "s"), "left").select("k.*", "s.status")
    fine = met.withColumn("tenant_id", F.when(F.col("status") == "complete", F.col("tenant_id")).otherwise(F.raise_error(F.lit("only a complete set can be the default")).cast("string"))).drop("status")
    return defaults.join(fine.select("tenant_id", "document_id"), ["tenant_id", "document_id"], "left_anti").select(*SET_KEY).unionByName(fine.select(*SET_KEY))


def collectable(sets: DataFrame, defaults: DataFrame, keep: int) -> DataFrame:
    """Complete sets beyond the newest keep ones of their document; a default or a set that is being built never is."""
    if keep < 1:
        raise ValueError("at least one set must be kept")
    newest = Window.partitionBy("tenant_id", "document_id").orderBy(F.col("created_at").desc(), "seq")
    ranked = sets.where("status = 'complete'").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") > keep)
    return ranked.alias("r").join(defaults.alias("d"), same_key("r", "d"), "left_anti").drop("rank")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of sets, entries or defaults but those of the sets gone."""
    return rows.alias("r").join(gone.select(*SET_KEY).alias("g"), same_key("r", "g"), "left_anti")


def delete_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    return rows.where(F.col("tenant_id") != tenant)


def query_set(entries: DataFrame, key: DataFrame, vector: DataFrame, limit: int, section: str | None = None) -> DataFrame:
    """chunk_id, score of the nearest entries of one set (key: its one row) to one vector (one row, column q); ties by chunk_id.

    Unequal dimensions and an unknown set are errors.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    found = entries.alias("e").join(F.broadcast(key).alias("k"), same_key("e", "k")).select("e.*")  # one row
    if section is not None:
        found = found.where(F.col("section_path") == section)
    scored = found.join(F.broadcast(vector)).select("chunk_id", cosine(F.col("vector"), F.col("q")).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def run_build(sets: DataFrame, entries: DataFrame, defaults: DataFrame, key: DataFrame, chunks: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, entries, defaults) after a build: what is missing is embedded, the set is complete, and only then the default.

    chunks: the set's key, chunk_id, section_path, text. A set that is complete already has nothing missing and stays as it is.
    """
    left = missing_entries(chunks, entries).select(*SET_KEY, "chunk_id", "section_path", hash_embedding(F.col("text"), dimension).alias("vector"))
    done = mark_complete(register(sets, key), key)
    return done, upsert(entries, left), set_defaults(defaults, done, key.select(*SET_KEY))


def _sets(spark, sf_dir) -> DataFrame:
    e = corpus.read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.concat(F.lit("t-"), k % 5).alias("tenant_id"), F.concat(F.lit("doc_"), k % 400).alias("document_id"), F.when(k % 3 != 0, F.concat(F.lit("m_"), k % 3)).alias("mask_id"), F.when(k % 3 != 0, (k / 7 % 50).cast("int")).alias("mask_version"),
        F.when(k % 3 == 0, "tmpl_order").alias("template_id"), F.when(k % 3 == 0, (k / 7 % 50).cast("int")).alias("template_version"), F.when(k % 10 == 0, "building").otherwise("complete").alias("status"), (k * 31 % 1009).alias("created_at"), k.alias("seq"),
    )


def q_semantic_chunks(spark, sf_dir):
    return semantic_chunks(semantic_elements(*_one_context(spark, sf_dir))).select("chunk_id", "semantic_role", "section_path", "text")


def _one_context(spark, sf_dir):
    values, resolved = _session("t-1", spark, sf_dir)
    return values, resolved.where("system_context = 'erp'")


def q_heading_section_paths(spark, sf_dir):
    return heading_paths(corpus.elements(spark))


def q_structural_elements(spark, sf_dir):
    return structural_elements(_session("t-1", spark, sf_dir)[0], corpus.elements(spark)).select("document_id", "element_id", "value", "section_path")


def q_build_keys(spark, sf_dir):
    s = checked_keys(_sets(spark, sf_dir))
    key = build_key(F.col("document_id"), F.col("mask_id"), F.col("mask_version"), F.col("template_id"), F.col("template_version"))
    back = decode_payload(encode_payload(s))
    return s.select("seq", "tier", key.alias("key"), back["mask_id"].alias("mask_id"), back["template_version"].alias("template_version"))


def q_retention_gc(spark, sf_dir):
    s = _sets(spark, sf_dir)
    defaults = s.where("seq % 97 = 1").select(*SET_KEY)
    return collectable(s, defaults, 3).select("seq")


def q_default_set(spark, sf_dir):
    s = _sets(spark, sf_dir).drop("seq").where("status = 'complete'")
    newest = s.groupBy("tenant_id", "document_id").agg(F.max_by(F.struct("mask_id", "mask_version", "template_id", "template_version"), F.struct("created_at", F.coalesce("mask_version", "template_version"))).alias("k")).select("tenant_id", "document_id", "k.*")
    return set_defaults(newest.limit(0), s, newest.where("tenant_id = 't-1'").dropDuplicates(["tenant_id", "document_id"])).groupBy("tenant_id").agg(F.countDistinct("document_id").alias("n"))


def q_tenant_delete(spark, sf_dir):
    return delete_tenant(_sets(spark, sf_dir), "t-1").groupBy("tenant_id").agg(F.count("*").alias("n"))


def _index(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "embeddings")
    key = [F.lit("t-1").alias("tenant_id"), F.concat(F.lit("doc_"), F.col("vec_id") % 4).alias("document_id"), F.lit(None).cast("string").alias("mask_id"), F.lit(None).cast("int").alias("mask_version"), F.lit("tmpl").alias("template_id"), F.lit(1).alias("template_version")]
    return e.select(*key, F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.concat(F.lit("s"), F.col("vec_id") % 3).alias("section_path"), F.col("embedding").alias("vector"))


def q_set_query(spark, sf_dir):
    index = _index(spark, sf_dir)
    key = index.where("document_id = 'doc_1'").select(*SET_KEY).limit(1)
    vector = corpus.read(spark, sf_dir, "embeddings").where("vec_id = 5").select(F.col("embedding").alias("q"))
    return query_set(index, key, vector, 20, "s2").select("chunk_id", F.round("score", 6).alias("score"))


def q_index_upsert(spark, sf_dir):
    index = _index(spark, sf_dir)
    new = index.where("chunk_id like '%7'").withColumn("section_path", F.lit("new"))
    more = index.where("chunk_id like '%9'").withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    return upsert(index, new.unionByName(more)).groupBy("document_id", "section_path").agg(F.count("*").alias("n"))


def q_build_resume(spark, sf_dir):
    index = _index(spark, sf_dir)
    return missing_entries(index, index.where("section_path <> 's0'")).select("document_id", "chunk_id")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_SETS = """with s as (select 't-' || event_id % 5 as tenant_id, 'doc_' || event_id % 400 as document_id, case when event_id % 3 <> 0 then 'm_' || event_id % 3 end as mask_id, case when event_id % 3 <> 0 then floor((event_id / 7.0::double) % 50)::int end as mask_version,
  case when event_id % 3 = 0 then 'tmpl_order' end as template_id, case when event_id % 3 = 0 then floor((event_id / 7.0::double) % 50)::int end as template_version, case when event_id % 10 = 0 then 'building' else 'complete' end as status, event_id * 31 % 1009 as created_at, event_id as seq from events)
"""
_IDX = "with i as (select 'doc_' || vec_id % 4 as document_id, lpad(vec_id::varchar, 12, '0') as chunk_id, 's' || vec_id % 3 as section_path, embedding::double[] as v, vec_id from embeddings) "
ORACLES = {
    "semantic_chunks": _ctx("t-1") + "select document_id || ':' || dv.element_id || ':0' as chunk_id, semantic_role, section_path, value as text from dv join ram using (template_id, template_version, element_id) where system_context = 'erp' and state = 'present'",
    "heading_section_paths": WITH + r"select template_id, template_version, element_id, nullif(regexp_extract(label_text, '^(\d+(\.\d+)+)\s', 1), '') as section_path from elements where kind = 'value_region' and regexp_matches(label_text, '^(\d+(\.\d+)+)\s')",
    "structural_elements": _ctx("t-1") + r", h as (select template_id, template_version, element_id, regexp_extract(label_text, '^(\d+(\.\d+)+)\s', 1) as section_path from elements where kind = 'value_region' and regexp_matches(label_text, '^(\d+(\.\d+)+)\s')) select document_id, element_id, value, section_path from dv left join h using (template_id, template_version, element_id) where state = 'present'",
    "build_keys": _SETS + "select seq, case when mask_id is null then 'structural' else 'semantic' end as tier, case when mask_id is null then 'embedding-build:' || document_id || ':structural:' || coalesce(template_id, 'None') || ':' || template_version else 'embedding-build:' || document_id || ':mask:' || mask_id || ':' || mask_version end as key, mask_id, template_version from s",
    "retention_gc": _SETS + """, r as (select *, row_number() over (partition by tenant_id, document_id order by created_at desc, seq) as k from s where status = 'complete')
select seq from r where k > 3 and not exists (select 1 from s d where d.seq % 97 = 1 and d.tenant_id = r.tenant_id and d.document_id = r.document_id and d.mask_id is not distinct from r.mask_id and d.mask_version is not distinct from r.mask_version and d.template_id is not distinct from r.template_id and d.template_version is not distinct from r.template_version)""",
    "default_set": _SETS + "select tenant_id, count(distinct document_id) as n from s where tenant_id = 't-1' and status = 'complete' group by tenant_id",
    "tenant_delete": _SETS + "select tenant_id, count(*) as n from s where tenant_id <> 't-1' group by tenant_id",
    "set_query": _IDX + "select chunk_id, round(list_cosine_similarity(v, (select v from i where vec_id = 5)), 6) as score from i where document_id = 'doc_1' and section_path = 's2' order by list_cosine_similarity(v, (select v from i where vec_id = 5)) desc, chunk_id limit 20",
    "index_upsert": _IDX + "select document_id, section_path, count(*) as n from (select document_id, case when chunk_id like '%7' then 'new' else section_path end as section_path from i union all select document_id, section_path from i where chunk_id like '%9') group by all",
    "build_resume": _IDX + "select document_id, chunk_id from i where section_path = 's0'",
}
