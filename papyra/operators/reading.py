"""The read path: projections, mask selection, values by role, sections, search, provenance.

Functions take and return DataFrames that a session has filtered already. Masks and their entries are joined without a
broadcast hint: Spark broadcasts them where it knows them to be small, and shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.plans.session import TenantSession
from papyra.sources import corpus
from papyra.sources.corpus import WITH

KEY = ("tenant_id", "document_id", "content_id", "content_version")
MASK_KEY = ("template_id", "template_version", "system_context")
PROVENANCE = ("artifact_sha256", "page", "coordinate_space", "method", "component_version", "corrected_by")
MOST_FOUND = 100


def last_of(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last one."""
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("last_", F.row_number().over(newest)).where("last_ = 1").drop("last_")


def provenance_json() -> Column:
    """Provenance as JSON without null keys."""
    return F.to_json(F.struct(*PROVENANCE))


def decode_values(contents: DataFrame) -> DataFrame:
    """One row an observation of artifacts (tenant_id, document_id, content_id, content_version, body.observations), in their order.

    A null tenant is an error. An artifact without observations gives no row.
    """
    tenant = F.coalesce("tenant_id", F.raise_error(F.lit("a content without a tenant")).cast("string"))
    rows = contents.select(tenant.alias("tenant_id"), "document_id", "content_id", "content_version", F.posexplode("body.observations").alias("ord", "o"))
    return rows.select(*KEY, "ord", "o.element_id", "o.state", "o.value", F.to_json("o.provenance").alias("provenance"))


def decode_entries(masks: DataFrame) -> DataFrame:
    """One row an entry of artifacts (mask_id, mask_version, tenant_id, body.entries); attribution and target are flat."""
    rows = masks.select("mask_id", "mask_version", "tenant_id", F.posexplode("body.entries").alias("ord", "e"))
    return rows.select("mask_id", "mask_version", "tenant_id", "ord", "e.element_id", "e.semantic_role", "e.target.schema", "e.target.field", "e.target.datatype", "e.attribution.overridden", F.col("e.attribution.inherited_from.mask_id").alias("inherited_mask_id"))


def document_values(documents: DataFrame, values: DataFrame) -> DataFrame:
    """Values of the content that each document names."""
    named = documents.select(*KEY, "template_id", "template_version")
    return values.drop("template_id", "template_version").join(named, list(KEY))


def resolved_masks(masks: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the one active mask of each template, version and context: the tenant's own before the vendor's."""
    order = Window.partitionBy(*MASK_KEY).orderBy((F.col("scope") == "customer").desc(), "mask_id", "mask_version")
    picked = masks.where("active").withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick", "active")
    m, e = picked.alias("m"), entries.alias("e")
    same = F.col("m.tenant_id").eqNullSafe(F.col("e.tenant_id")) & (F.col("m.mask_id") == F.col("e.mask_id")) & (F.col("m.mask_version") == F.col("e.mask_version"))
    return m.join(e, same).select("m.*", *[f"e.{c}" for c in entries.columns if c not in ("tenant_id", "mask_id", "mask_version")])


def value_by_role(values: DataFrame, resolved: DataFrame, context: str, role: str) -> DataFrame:
    """For each document the first value, by element, that has the role in the context; untemplated documents have none."""
    r = resolved.where((F.col("system_context") == context) & (F.col("semantic_role") == role)).select("template_id", "template_version", "element_id", "mask_id")
    found = values.join(r, ["template_id", "template_version", "element_id"])
    first = Window.partitionBy("document_id").orderBy("element_id", "ord")
    return found.withColumn("pick", F.row_number().over(first)).where("pick = 1").drop("pick")


def sections(values: DataFrame, resolved: DataFrame, context: str) -> DataFrame:
    """Values with the section paths of their elements; a value of an untemplated document meets every template's."""
    r = resolved.where((F.col("system_context") == context) & F.col("section_path").isNotNull()).alias("r")
    v = values.alias("v")
    fits = F.col("v.template_id").isNull() | ((F.col("v.template_id") == F.col("r.template_id")) & (F.col("v.template_version") == F.col("r.template_version")))
    return v.join(r, (F.col("v.element_id") == F.col("r.element_id")) & fits).select("v.*", "r.section_path", "r.semantic_role")


def section_values(found: DataFrame, path: str) -> DataFrame:
    return found.where(F.col("section_path") == path)


def contains(text: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ in needle are wildcards, a backslash before another character is dropped."""
    out, k = "", 0
    while k < len(needle):
        if needle[k] == "\\" and k + 1 < len(needle):
            k += 1
            out += "\\" + needle[k] if needle[k] in "%_\\" else needle[k]
        elif needle[k] == "\\":
            out += "\\\\"
        else:
            out += needle[k]
        k += 1
    return text.ilike(f"%{out}%")


def search_sections(found: DataFrame, needle: str, limit: int, document_id: str | None = None) -> DataFrame:
    """At most limit values that hold needle, by document, section, element and role."""
    if isinstance(limit, bool) or not 1 <= limit <= MOST_FOUND:
        raise ValueError(f"limit {limit} is not within 1 and {MOST_FOUND}")
    hits = found.where(contains(F.col("value"), needle))
    if document_id is not None:
        hits = hits.where(F.col("document_id") == document_id)
    return hits.orderBy("document_id", "section_path", "element_id", "semantic_role").limit(limit)


def mask_rows(entries: DataFrame, mask_id: str, version: int, overridden: bool | None = None) -> DataFrame:
    rows = entries.where((F.col("mask_id") == mask_id) & (F.col("mask_version") == version))
    return rows if overridden is None else rows.where(F.col("overridden") == overridden)


def baseline_toggle(resolved: DataFrame, template: str, version: int, context: str, overridden_only: bool = False) -> DataFrame:
    rows = resolved.where((F.col("template_id") == template) & (F.col("template_version") == version) & (F.col("system_context") == context))
    return rows.where("overridden") if overridden_only else rows


def uncovered_elements(elements: DataFrame, masks: DataFrame, entries: DataFrame, mask_id: str, version: int) -> DataFrame:
    """Elements of the mask's template version that the vendor mask has no entry for, labels left out."""
    mask = masks.where((F.col("mask_id") == mask_id) & (F.col("mask_version") == version))
    vendor = F.when(F.col("scope") == "vendor", F.col("template_id")).otherwise(F.raise_error(F.lit("only a vendor mask has a worklist")).cast("string"))
    named = mask.select(vendor.alias("template_id"), "template_version")
    covered = mask_rows(entries, mask_id, version).select("element_id")
    return elements.where("kind <> 'label'").join(named, ["template_id", "template_version"]).join(covered, "element_id", "left_anti").select("element_id", "kind")


def _session(tenant: str | None, spark: SparkSession, sf_dir: str):
    s = TenantSession("read_api", tenant)
    values = document_values(s.table(corpus.registered(spark, sf_dir), "documents"), s.table(corpus.observations(spark, sf_dir), "values"))
    return values, resolved_masks(s.table(corpus.masks(spark), "masks"), s.table(corpus.entries(spark), "entries"))


VALUE = ("document_id", "element_id", "ord", "state", "value", "template_id", "template_version", "content_version")


def q_document_values(spark, sf_dir):
    return _session("t-1", spark, sf_dir)[0].select(*VALUE, "method", F.round("confidence_calibrated", 6).alias("calibrated"))


def q_document_values_by_id(spark, sf_dir):
    return _session("t-1", spark, sf_dir)[0].where(F.col("o_orderkey") < 1000).orderBy("document_id", "element_id").select(*VALUE)


def q_document_values_no_tenant(spark, sf_dir):
    return _session(None, spark, sf_dir)[0].select(*VALUE)


def q_resolved_active_masks(spark, sf_dir):
    return _session("t-1", spark, sf_dir)[1].select("mask_id", "mask_version", *MASK_KEY, "element_id", "semantic_role", "section_path")


def q_resolved_no_tenant(spark, sf_dir):
    return _session(None, spark, sf_dir)[1].select("mask_id", "mask_version", *MASK_KEY, "element_id", "semantic_role")


def q_resolve_active_mask(spark, sf_dir):
    return baseline_toggle(_session("t-1", spark, sf_dir)[1], "tmpl_order", 1, "erp").orderBy("element_id").select("mask_id", "element_id", "semantic_role", "overridden")


def q_baseline_toggle(spark, sf_dir):
    return baseline_toggle(_session("t-1", spark, sf_dir)[1], "tmpl_order", 1, "erp", True).select("mask_id", "element_id", "semantic_role")


def q_mask_entries_overridden(spark, sf_dir):
    rows = TenantSession("read_api", "t-1").table(corpus.entries(spark), "entries")
    return mask_rows(rows, "m_t1", 2, True).select("ord", "element_id", "semantic_role", "inherited_mask_id")


def q_value_by_role(spark, sf_dir):
    return value_by_role(*_session("t-1", spark, sf_dir), "erp", "order_no").select("document_id", "element_id", "state", "value", "mask_id")


def q_section_read(spark, sf_dir):
    return section_values(sections(*_session("t-1", spark, sf_dir), "erp"), "body").select("document_id", "element_id", "semantic_role", "section_path", "state", "value")


def q_section_search(spark, sf_dir):
    return search_sections(sections(*_session("t-1", spark, sf_dir), "erp"), "urg_nt", 50).select("document_id", "section_path", "element_id", "semantic_role", "value")


def q_section_search_ilike(spark, sf_dir):
    return sections(*_session("t-1", spark, sf_dir), "erp").where(contains(F.col("value"), "urgent")).select("document_id", "semantic_role", "value")


def q_provenance_lookup(spark, sf_dir):
    values = _session("t-1", spark, sf_dir)[0].where("element_id = 'total'")
    return values.select("document_id", "element_id", *PROVENANCE, (F.size(F.json_object_keys(provenance_json())) == 6).alias("complete"))


def q_uncovered_elements(spark, sf_dir):
    return uncovered_elements(corpus.elements(spark), corpus.masks(spark), corpus.entries(spark), "m_vendor", 1)


def _contents(spark, sf_dir):
    o = corpus.observations(spark, sf_dir)
    item = F.struct("ord", "element_id", "state", "value", F.struct(*PROVENANCE).alias("provenance"))
    return o.groupBy(*KEY).agg(F.struct(F.array_sort(F.collect_list(item)).alias("observations")).alias("body"))


def q_decode_document_values(spark, sf_dir):
    got = decode_values(_contents(spark, sf_dir))
    return got.select(*KEY, "ord", "element_id", "state", "value", F.get_json_object("provenance", "$.method").alias("method"), F.get_json_object("provenance", "$.corrected_by").alias("corrected_by"))


def q_decode_mask_entries(spark, sf_dir):
    e = corpus.entries(spark)
    from_mask = F.when(F.col("inherited_mask_id").isNotNull(), F.struct(F.col("inherited_mask_id").alias("mask_id"), F.col("inherited_version").alias("version")))
    item = F.struct("ord", "element_id", "semantic_role", F.struct(F.col("target_schema").alias("schema"), "field", "datatype").alias("target"), F.struct("overridden", from_mask.alias("inherited_from")).alias("attribution"))
    return decode_entries(e.groupBy("mask_id", "mask_version", "tenant_id").agg(F.struct(F.array_sort(F.collect_list(item)).alias("entries")).alias("body")))


def q_isolation_counts(spark, sf_dir):
    """Rows that each tenant sees of its documents, and of masks."""
    out = None
    for t in ("t-0", "t-1", "t-2", None):
        s = TenantSession("worker", t)
        docs = s.table(corpus.registered(spark, sf_dir), "documents").agg(F.count("*").alias("n_documents"))
        both = docs.crossJoin(s.table(corpus.masks(spark), "masks").agg(F.count("*").alias("n_masks")))  # one row each
        row = both.select(F.lit(t or "none").alias("tenant"), "n_documents", "n_masks")
        out = row if out is None else out.unionByName(row)
    return out


def q_synthesis_masks(spark, sf_dir):
    return TenantSession("synthesis").table(corpus.masks(spark), "masks").select("mask_id", "mask_version", "scope")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}


def _ctx(tenant: str | None) -> str:
    own = f"tenant_id = '{tenant}'" if tenant else "false"
    return WITH + f""", dv as (select obs.* from obs join reg using (tenant_id, document_id, content_id, content_version) where {own}),
am as (select *, row_number() over (partition by template_id, template_version, system_context order by case when scope = 'customer' then 0 else 1 end, mask_id, mask_version) as pick
  from masks where active and (tenant_id is null or {own})),
ram as (select am.mask_id, am.mask_version, am.template_id, am.template_version, am.system_context, e.ord, e.element_id, e.semantic_role, e.section_path, e.overridden, e.enum_map, e.field, e.datatype, e.target_schema
  from am join entries e on am.tenant_id is not distinct from e.tenant_id and am.mask_id = e.mask_id and am.mask_version = e.mask_version where pick = 1),
sec as (select dv.*, ram.section_path, ram.semantic_role from dv join ram on dv.element_id = ram.element_id and ram.section_path is not null and ram.system_context = 'erp'
  and (dv.template_id is null or (dv.template_id = ram.template_id and dv.template_version = ram.template_version)))
"""


_V = "document_id, element_id, ord, state, value, template_id, template_version, content_version"
ORACLES = {
    "document_values": _ctx("t-1") + f"select {_V}, method, round(confidence_calibrated, 6) as calibrated from dv",
    "document_values_by_id": _ctx("t-1") + f"select {_V} from dv where o_orderkey < 1000",
    "document_values_no_tenant": _ctx(None) + f"select {_V} from dv",
    "resolved_active_masks": _ctx("t-1") + "select mask_id, mask_version, template_id, template_version, system_context, element_id, semantic_role, section_path from ram",
    "resolved_no_tenant": _ctx(None) + "select mask_id, mask_version, template_id, template_version, system_context, element_id, semantic_role from ram",
    "resolve_active_mask": _ctx("t-1") + "select mask_id, element_id, semantic_role, overridden from ram where template_id = 'tmpl_order' and template_version = 1 and system_context = 'erp'",
    "baseline_toggle": _ctx("t-1") + "select mask_id, element_id, semantic_role from ram where template_id = 'tmpl_order' and template_version = 1 and system_context = 'erp' and overridden",
    "mask_entries_overridden": WITH + "select ord, element_id, semantic_role, inherited_mask_id from entries where mask_id = 'm_t1' and mask_version = 2 and overridden",
    "value_by_role": _ctx("t-1") + """select document_id, element_id, state, value, mask_id from (select dv.*, mask_id, row_number() over (partition by document_id order by dv.element_id, dv.ord) as r
  from dv join ram on dv.template_id = ram.template_id and dv.template_version = ram.template_version and dv.element_id = ram.element_id where system_context = 'erp' and semantic_role = 'order_no') where r = 1""",
    "section_read": _ctx("t-1") + "select document_id, element_id, semantic_role, section_path, state, value from sec where section_path = 'body'",
    "section_search": _ctx("t-1") + "select document_id, section_path, element_id, semantic_role, value from sec where value ilike '%urg_nt%' order by document_id, section_path, element_id, semantic_role limit 50",
    "section_search_ilike": _ctx("t-1") + "select document_id, semantic_role, value from sec where value ilike '%urgent%'",
    "provenance_lookup": _ctx("t-1") + "select document_id, element_id, artifact_sha256, page, coordinate_space, method, component_version, corrected_by, corrected_by is not null as complete from dv where element_id = 'total'",
    "uncovered_elements": WITH + "select element_id, kind from elements where template_id = 'tmpl_order' and template_version = 1 and kind <> 'label' and element_id not in (select element_id from entries where mask_id = 'm_vendor' and mask_version = 1)",
    "decode_document_values": WITH + "select tenant_id, document_id, content_id, content_version, ord - 1 as ord, element_id, state, value, method, corrected_by from obs",
    "decode_mask_entries": WITH + "select mask_id, mask_version, tenant_id, ord - 1 as ord, element_id, semantic_role, target_schema as schema, field, datatype, overridden, inherited_mask_id from entries",
    "isolation_counts": WITH + """select t as tenant, (select count(*) from reg where tenant_id = t) as n_documents, (select count(*) from masks where tenant_id is null or tenant_id = t) as n_masks
  from (values ('t-0'), ('t-1'), ('t-2'), ('none')) as n(t)""",
    "synthesis_masks": WITH + "select mask_id, mask_version, scope from masks where scope = 'vendor'",
}
