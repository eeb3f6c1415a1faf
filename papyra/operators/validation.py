"""Validation of artifacts: each check maps tables to violations (document_id, path, code); no message holds a value.

Checks are registered in ``CHECKS`` in the order of their output; ``validate`` unites them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.reading import last_of
from papyra.sources import corpus
from papyra.sources.corpus import WITH

# The forms of fingerprints and hashes, and how many elements each relation has.
FINGERPRINT, HEX = r"\Afpv\d+:sha256:[0-9a-f]{64}\z", r"\A[0-9a-f]{64}\z"
CARDINALITY = {"compatible": (1, 1, 1, 1), "split": (1, 1, 2, None), "merged": (2, None, 1, 1), "ambiguous": (1, None, 1, None), "removed": (1, None, 0, 0), "added": (0, 0, 1, None)}


def _where(rows: DataFrame, broken: Column, path: str, code: str) -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(False))).select("document_id", F.concat(F.lit(f"{path}/"), F.col("ord").cast("string")).alias("path"), F.lit(code).alias("code"))


def unknown_element(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Observations, of documents with a template, whose element it does not have."""
    known = elements.select("template_id", "template_version", "element_id")
    left = rows.where("template_id is not null").join(known, ["template_id", "template_version", "element_id"], "left_anti")
    return _where(left, F.lit(True), "observations", "unknown-element-id")


def envelope_mismatch(rows: DataFrame) -> DataFrame:
    """Envelopes (artifact_id, artifact_version) that disagree with their bodies."""
    return _where(rows, ~F.col("artifact_id").eqNullSafe(F.col("content_id")) | ~F.col("artifact_version").eqNullSafe(F.col("content_version")), "envelope", "envelope-body-mismatch")


def missing_provenance(rows: DataFrame) -> DataFrame:
    return _where(rows, F.col("artifact_sha256").isNull(), "observations", "missing-provenance")


def state_value_conflict(rows: DataFrame) -> DataFrame:
    return _where(rows, (F.col("state") == "present") != F.col("value").isNotNull(), "observations", "state-value-conflict")


def unknown_space(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """Observations in a coordinate space that their document did not record (spaces: document_id, coordinate_space)."""
    return _where(rows.where("coordinate_space is not null").join(spaces, ["document_id", "coordinate_space"], "left_anti"), F.lit(True), "observations", "unknown-coordinate-space")


def page_out_of_range(rows: DataFrame) -> DataFrame:
    return _where(rows, ~F.col("page").between(1, F.col("page_count")), "observations", "page-out-of-range")


def malformed_transform(rows: DataFrame) -> DataFrame:
    finite = F.forall("transform_to_source", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _where(rows, ~((F.size("transform_to_source") == 6) & finite), "observations", "malformed-transform")


def corrected_by_required(rows: DataFrame) -> DataFrame:
    return _where(rows, (F.col("method") == "human") & F.col("corrected_by").isNull(), "observations", "corrected-by-required-for-human-method")


CHECKS: list[Callable[[dict[str, DataFrame]], DataFrame]] = [
    lambda b: unknown_element(b["rows"], b["elements"]),
    lambda b: envelope_mismatch(b["rows"]),
    lambda b: missing_provenance(b["rows"]),
    lambda b: state_value_conflict(b["rows"]),
    lambda b: unknown_space(b["rows"], b["spaces"]),
    lambda b: page_out_of_range(b["rows"]),
    lambda b: malformed_transform(b["rows"]),
    lambda b: corrected_by_required(b["rows"]),
]


def register_check(check: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    CHECKS.append(check)


def validate(bundle: dict[str, DataFrame]) -> DataFrame:
    """All violations, with the place of their check in the order."""
    return reduce(DataFrame.unionByName, [c(bundle).withColumn("place", F.lit(i)) for i, c in enumerate(CHECKS)])


def reports(documents: DataFrame, violations: DataFrame) -> DataFrame:
    """document_id, n, ok: a document is ok if nothing is wrong with it."""
    n = violations.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("ok"))


def mask_scope(masks: DataFrame) -> DataFrame:
    vendor = F.when((F.col("scope") == "vendor") & F.col("tenant_id").isNotNull(), "vendor-mask-with-tenant").when((F.col("scope") == "customer") & F.col("tenant_id").isNull(), "customer-mask-missing-tenant")
    return masks.select("mask_id", "mask_version", vendor.alias("code")).where("code is not null")


def mask_attribution(entries: DataFrame) -> DataFrame:
    """Both codes may fire for one entry."""
    a = F.when(F.col("overridden") & F.col("inherited_mask_id").isNull(), "overridden-without-inherited-from")
    b = F.when((F.col("origin") == "vendor") & F.col("inherited_mask_id").isNull() & F.col("validated_by").isNull(), "vendor-entry-missing-validated-by")
    return entries.select("mask_id", "mask_version", "ord", F.explode(F.array_compact(F.array(a, b))).alias("code"))


def fingerprint_format(templates: DataFrame) -> DataFrame:
    """A trailing newline is no part of a fingerprint."""
    return templates.where(~F.coalesce(F.col("fingerprint").rlike(FINGERPRINT), F.lit(False))).select("document_id", F.lit("bad-fingerprint-format").alias("code"))


def page_sequence(pages: DataFrame) -> DataFrame:
    """document_id of documents whose pages aren't 1 to n, once each, or have no size; sizes may differ."""
    listed = pages.groupBy("document_id", "page_count").agg(F.array_sort(F.collect_list("page")).alias("p"), F.bool_and((F.col("width") > 0) & (F.col("height") > 0)).alias("sized"))
    return listed.where(~((F.col("p") == F.sequence(F.lit(1), F.col("page_count"))) & F.col("sized"))).select("document_id")


def lineage_cardinality(lineage: DataFrame) -> DataFrame:
    """Entries (old_ids, new_ids, relation) with a wrong number of elements for their relation, or repeated ones."""
    def within(size: Column, low: int, high: int | None) -> Column:
        return (size >= low) & (F.lit(True) if high is None else size <= high)

    fine = F.lit(False)
    for relation, (a, b, c, d) in CARDINALITY.items():
        fine = fine | ((F.col("relation") == relation) & within(F.size("old_ids"), a, b) & within(F.size("new_ids"), c, d))
    once = (F.size(F.array_distinct("old_ids")) == F.size("old_ids")) & (F.size(F.array_distinct("new_ids")) == F.size("new_ids"))
    return lineage.where(~(fine & once))


def source_hash(sources: DataFrame) -> DataFrame:
    """Documents whose bytes (content) don't have the hash that their provenance names."""
    return sources.where(F.sha2("content", 256) != F.col("artifact_sha256")).select("document_id")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, nulls being equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def private_template_scope(masks: DataFrame, templates: DataFrame) -> DataFrame:
    """Masks on a tenant's own template (template_id, owner) that aren't that tenant's customer masks."""
    own = templates.where("owner is not null")
    return masks.join(own, "template_id").where(~((F.col("scope") == "customer") & F.col("tenant_id").eqNullSafe(F.col("owner")))).select("mask_id", "mask_version")


def mutated(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keys that new lacks or has with another body: what an append-only table refuses."""
    gone = old.join(new, list(keys), "left_anti").select(*keys, F.lit("deleted").alias("change"))
    changed = old.alias("o").join(new.alias("n"), list(keys)).where(~F.col("o.body").eqNullSafe(F.col("n.body"))).select(*keys, F.lit("updated").alias("change"))
    return gone.unionByName(changed)


#: Keys of an observation's JSON, and what each must be.
STRICT = {"element_id": "STRING", "state": "STRING", "version": "BIGINT", "confidence": "DOUBLE|DECIMAL", "sha256": "STRING"}


def strict_errors(text: Column, schema: dict[str, str] = STRICT) -> Column:
    """Why JSON text is refused, as an array: keys that aren't known or are missing, types (nothing is converted), ranges."""
    v = F.try_parse_json(text)
    names = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    unknown = F.transform(F.array_sort(F.array_except(names, F.array(*map(F.lit, sorted(schema))))), lambda n: F.concat(F.lit("unknown:"), n))
    found = [F.when(v.isNull(), "malformed")]
    for name, kinds in sorted(schema.items()):
        kind = F.regexp_replace(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), r"\(.*\)", "")
        found.append(F.when(v.isNotNull() & ~F.array_contains(names, F.lit(name)), f"missing:{name}").when(v.isNotNull() & ~F.coalesce(kind.isin(*kinds.split("|")), F.lit(False)), f"type:{name}"))
    number = lambda n: F.try_variant_get(v, f"$.{n}", "double")
    found += [F.when(number("version") < 1, "range:version"), F.when(~number("confidence").between(0, 1), "range:confidence"), F.when(~F.try_variant_get(v, "$.sha256", "string").rlike(HEX), "range:sha256")]
    return F.concat(unknown, F.array_compact(F.array(*found)))


def _bundle(spark, sf_dir) -> dict[str, DataFrame]:
    pages = corpus.registered(spark, sf_dir).select("document_id", "page_count")
    key = F.col("o_orderkey")
    at = lambda n, then, other: F.when(key % n == 0, then).otherwise(other)
    good = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    rows = corpus.observations(spark, sf_dir).join(pages, "document_id").withColumns({
        "value": at(37, F.lit("oops"), F.col("value")), "page": at(43, F.col("page") + 5, F.col("page")), "element_id": at(47, F.lit("stray"), F.col("element_id")),
        "artifact_sha256": at(53, F.lit(None), F.col("artifact_sha256")), "coordinate_space": at(59, F.lit("page-9"), F.col("coordinate_space")),
        "transform_to_source": F.when(key % 61 == 0, F.slice(good, 1, 5)).when(key % 67 == 0, F.array_append(F.slice(good, 1, 5), F.lit(float("inf")))).otherwise(good),
        "artifact_id": at(71, F.lit("x"), F.col("content_id")), "artifact_version": F.col("content_version"),
    })
    spaces = corpus.registered(spark, sf_dir).select("document_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda p: F.concat(F.lit("page-"), p))).alias("coordinate_space"))
    return {"rows": rows, "elements": corpus.elements(spark), "spaces": spaces}


NAMES = ("v1_unknown_element", "v2_envelope_mismatch", "v3_missing_provenance", "v7_state_value", "v8_unknown_space", "v9_page_range", "v10_transform", "v11_corrected_by")


def _single(i: int):
    return lambda spark, sf_dir: CHECKS[i](_bundle(spark, sf_dir))


def q_validation_all(spark, sf_dir):
    return validate(_bundle(spark, sf_dir)).groupBy("place", "code").agg(F.count("*").alias("n"))


def q_validation_report(spark, sf_dir):
    return reports(corpus.registered(spark, sf_dir), validate(_bundle(spark, sf_dir)))


def _bad_masks(spark) -> DataFrame:
    return corpus.masks(spark).unionByName(spark.sql("select 'm_bad' as mask_id, 1 as mask_version, 't-1' as tenant_id, 'vendor' as scope, 'tmpl_order' as template_id, 1 as template_version, 'erp' as system_context, true as active union all select 'm_worse', 1, null, 'customer', 'tmpl_own', 1, 'erp', true"))


def q_v4_mask_scope(spark, sf_dir):
    return mask_scope(_bad_masks(spark))


def q_v5_mask_attribution(spark, sf_dir):
    return mask_attribution(corpus.entries(spark))


def q_v6_fingerprint_format(spark, sf_dir):
    form = F.concat(F.lit("fpv1:sha256:"), F.sha2("document_id", 256), F.when(F.col("o_orderkey") % 3 == 0, "\n").when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    return fingerprint_format(corpus.registered(spark, sf_dir).select("document_id", form.alias("fingerprint")))


def q_v12_page_sequence(spark, sf_dir):
    docs = corpus.registered(spark, sf_dir)
    page = F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page")
    return page_sequence(docs.select("document_id", "o_orderkey", "page_count", page).select("document_id", "page_count", F.when((F.col("o_orderkey") % 9 == 0) & (F.col("page") == 2), 1).otherwise(F.col("page")).alias("page"), F.when(F.col("o_orderkey") % 14 == 0, 0.0).otherwise(595.0).alias("width"), F.lit(842.0).alias("height")))


def q_v13_lineage_cardinality(spark, sf_dir):
    rows = corpus.registered(spark, sf_dir).selectExpr("document_id", "case o_orderkey % 4 when 0 then 'compatible' when 1 then 'split' when 2 then 'removed' else 'merged' end as relation", "transform(sequence(1, 1 + o_orderkey % 3), x -> concat('a', x)) as old_ids", "case when o_orderkey % 5 = 0 then array('b', 'b') else array('b') end as new_ids")
    return lineage_cardinality(rows).select("document_id", "relation")


def q_v14_source_hash(spark, sf_dir):
    return source_hash(_bundle(spark, sf_dir)["rows"].select("document_id", F.when(F.col("o_orderkey") % 8 == 0, "other").otherwise(F.col("document_id")).cast("binary").alias("content"), F.sha2("document_id", 256).alias("artifact_sha256")).distinct())


def q_v15_active_mask_uniqueness(spark, sf_dir):
    return repeated_keys(_bad_masks(spark).where("active"), "tenant_id", "template_id", "system_context")


def q_v16_append_only(spark, sf_dir):
    old = corpus.registered(spark, sf_dir).select("document_id", "content_version", F.col("content_id").alias("body"))
    k = F.substring("document_id", 5, 20).cast("long")
    new = old.where(k % 16 != 0).withColumn("body", F.when(k % 15 == 0, "changed").otherwise(F.col("body")))
    return mutated(old, new, "document_id", "content_version")


def q_v17_private_template(spark, sf_dir):
    owners = spark.sql("select * from values ('tmpl_own', 't-1'), ('tmpl_order', null) as o(template_id, owner)")
    return private_template_scope(_bad_masks(spark), owners)


def q_v0_strict_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"element_id":"a","state":"present","version":'), F.when(k % 3 == 0, "0").when(k % 5 == 0, '"1"').otherwise("1"), F.lit(',"confidence":'), F.when(k % 7 == 0, "1.5").otherwise("0.5"), F.lit(',"sha256":"'), F.sha2("document_id", 256), F.when(k % 11 == 0, '","more":1}').when(k % 13 == 0, '"').otherwise('"}'))
    return corpus.registered(spark, sf_dir).select("document_id", F.array_join(strict_errors(text), ",").alias("errors"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")} | {n: _single(i) for i, n in enumerate(NAMES)}

_BAD = WITH.rstrip() + """, b as (select obs.* replace (case when obs.o_orderkey % 37 = 0 then 'oops' else value end as value, case when obs.o_orderkey % 43 = 0 then page + 5 else page end as page, case when obs.o_orderkey % 47 = 0 then 'stray' else element_id end as element_id,
  case when obs.o_orderkey % 53 = 0 then null else artifact_sha256 end as artifact_sha256), page_count from obs join reg using (document_id)),
viol as (select document_id, 'observations/' || ord as path, 'unknown-element-id' as code, 0 as place from b where template_id is not null and not exists (select 1 from elements e where e.template_id = b.template_id and e.template_version = b.template_version and e.element_id = b.element_id)
 union all select document_id, 'envelope/' || ord, 'envelope-body-mismatch', 1 from b where o_orderkey % 71 = 0
 union all select document_id, 'observations/' || ord, 'missing-provenance', 2 from b where o_orderkey % 53 = 0
 union all select document_id, 'observations/' || ord, 'state-value-conflict', 3 from b where (state = 'present') <> (value is not null)
 union all select document_id, 'observations/' || ord, 'unknown-coordinate-space', 4 from b where o_orderkey % 59 = 0
 union all select document_id, 'observations/' || ord, 'page-out-of-range', 5 from b where page > page_count
 union all select document_id, 'observations/' || ord, 'malformed-transform', 6 from b where o_orderkey % 61 = 0 or o_orderkey % 67 = 0
 union all select document_id, 'observations/' || ord, 'corrected-by-required-for-human-method', 7 from b where method = 'human' and corrected_by is null)
"""
_BADMASKS = WITH.rstrip() + ", bm as (select * from masks union all select 'm_bad', 1, 't-1', 'vendor', 'tmpl_order', 1, 'erp', true union all select 'm_worse', 1, null, 'customer', 'tmpl_own', 1, 'erp', true) "
ORACLES = {n: _BAD + f"select document_id, path, code from viol where place = {i}" for i, n in enumerate(NAMES)} | {
    "validation_all": _BAD + "select place, code, count(*) as n from viol group by all",
    "validation_report": _BAD + "select document_id, count(viol.code) as n, count(viol.code) = 0 as ok from reg left join viol using (document_id) group by document_id",
    "v4_mask_scope": _BADMASKS + "select mask_id, mask_version, case scope when 'vendor' then 'vendor-mask-with-tenant' else 'customer-mask-missing-tenant' end as code from bm where (scope = 'vendor') = (tenant_id is not null)",
    "v5_mask_attribution": WITH + "select mask_id, mask_version, ord, 'overridden-without-inherited-from' as code from entries where overridden and inherited_mask_id is null union all select mask_id, mask_version, ord, 'vendor-entry-missing-validated-by' from entries where origin = 'vendor' and inherited_mask_id is null and validated_by is null",
    "v6_fingerprint_format": WITH + "select document_id, 'bad-fingerprint-format' as code from reg where o_orderkey % 3 = 0 or o_orderkey % 5 = 0",
    "v12_page_sequence": WITH + "select document_id from reg where o_orderkey % 9 = 0 or o_orderkey % 14 = 0",
    "v13_lineage_cardinality": WITH + """, l as (select document_id, case o_orderkey % 4 when 0 then 'compatible' when 1 then 'split' when 2 then 'removed' else 'merged' end as relation, 1 + o_orderkey % 3 as o, o_orderkey % 5 = 0 as twice from reg)
select document_id, relation from l where not (not twice and ((relation = 'compatible' and o = 1) or (relation = 'merged' and o >= 2)))""",
    "v14_source_hash": WITH + "select document_id from reg where o_orderkey % 8 = 0",
    "v15_active_mask_uniqueness": _BADMASKS + "select tenant_id, template_id, system_context, count(*) as n from bm where active group by all having count(*) > 1",
    "v16_append_only": WITH + "select document_id, content_version, case when o_orderkey % 16 = 0 then 'deleted' else 'updated' end as change from reg where o_orderkey % 16 = 0 or o_orderkey % 15 = 0",
    "v17_private_template": _BADMASKS + "select mask_id, mask_version from bm where template_id = 'tmpl_own' and not (scope = 'customer' and tenant_id is not distinct from 't-1')",
    "v0_strict_parse": WITH + """select document_id, case when o_orderkey % 13 = 0 and o_orderkey % 11 <> 0 then 'malformed' else concat_ws(',', case when o_orderkey % 11 = 0 then 'unknown:more' end,
  case when o_orderkey % 5 = 0 and o_orderkey % 3 <> 0 then 'type:version' end, case when o_orderkey % 3 = 0 then 'range:version' end, case when o_orderkey % 7 = 0 then 'range:confidence' end) end as errors from reg""",
}
