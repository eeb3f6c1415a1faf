"""Lineage of template versions, migration of masks, materialised customer masks, activation.

Templates and masks are small tables, but all functions take many pairs of versions at once and shuffle by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.geometry import overlap_share
from papyra.sources import corpus
from papyra.sources.corpus import WITH

#: Share of the smaller box that two boxes must have in common.
OVERLAP = 0.5
BOX = ("x0", "y0", "x1", "y1")


def relation(olds: Column, news: Column) -> Column:
    a, b = F.size(olds), F.size(news)
    return F.when((a == 1) & (b == 1), "compatible").when((a == 1) & (b >= 2), "split").when((a >= 2) & (b == 1), "merged").otherwise("ambiguous")


def by_anchor(old: DataFrame, new: DataFrame) -> DataFrame:
    """Elements of both versions that share kind and label text."""
    side = lambda df, name: df.where("label_text is not null").groupBy("template_id", "kind", "label_text").agg(F.array_sort(F.collect_list("element_id")).alias(name))
    both = side(old, "old_ids").join(side(new, "new_ids"), ["template_id", "kind", "label_text"])
    return both.select("template_id", "old_ids", "new_ids", relation(F.col("old_ids"), F.col("new_ids")).alias("relation"))


def merged_sets(edges: Column) -> Column:
    """Connected components of an array of structs (o, n), as arrays of o and n that begin with a letter for their side."""
    def step(sets: Column, e: Column) -> Column:
        pair = F.array(F.concat(F.lit("o"), e["o"]), F.concat(F.lit("n"), e["n"]))
        met = lambda s: F.arrays_overlap(s, pair)
        whole = F.array_distinct(F.concat(F.flatten(F.filter(sets, met)), pair))
        return F.concat(F.filter(sets, lambda s: ~met(s)), F.array(whole))

    return F.aggregate(edges, F.array().cast("array<array<string>>"), step)


def by_geometry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Components of elements whose boxes overlap on the same page and kind. A template's edges are few: its elements on a page."""
    o, n = old.alias("o"), new.alias("n")
    same = (F.col("o.template_id") == F.col("n.template_id")) & (F.col("o.page") == F.col("n.page")) & (F.col("o.kind") == F.col("n.kind"))
    near = overlap_share(*[[F.col(f"{s}.{c}") for c in BOX] for s in "on"]) >= OVERLAP
    edges = o.join(n, same & near).select("o.template_id", F.struct(F.col("o.element_id").alias("o"), F.col("n.element_id").alias("n")).alias("e"))
    sets = edges.groupBy("template_id").agg(F.array_sort(F.collect_set("e")).alias("edges")).select("template_id", F.explode(merged_sets(F.col("edges"))).alias("s"))
    side = lambda c: F.array_sort(F.transform(F.filter("s", lambda x: x.startswith(c)), lambda x: F.substring(x, 2, 1000000)))
    found = sets.select("template_id", side("o").alias("old_ids"), side("n").alias("new_ids"))
    labels = lambda df, name: df.select("template_id", F.array("element_id").alias(f"{name}_ids"), F.col("label_text").alias(f"{name}_label"))
    found = found.join(labels(old, "old"), ["template_id", "old_ids"], "left").join(labels(new, "new"), ["template_id", "new_ids"], "left")
    kind = relation(F.col("old_ids"), F.col("new_ids"))
    return found.select("template_id", "old_ids", "new_ids", F.when((kind == "compatible") & (F.col("old_label") != F.col("new_label")), "ambiguous").otherwise(kind).alias("relation"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """template_id, old_ids, new_ids, relation: by anchors, then by geometry, then what only one version has; sorted by ids."""
    def rest(df: DataFrame, matched: DataFrame, name: str) -> DataFrame:
        return df.join(matched.select("template_id", F.explode(f"{name}_ids").alias("element_id")), ["template_id", "element_id"], "left_anti")

    anchored = by_anchor(old, new)
    old_1, new_1 = rest(old, anchored, "old"), rest(new, anchored, "new")
    placed = by_geometry(old_1, new_1)
    none = F.array().cast("array<string>")
    removed = rest(old_1, placed, "old").select("template_id", F.array("element_id").alias("old_ids"), none.alias("new_ids"), F.lit("removed").alias("relation"))
    added = rest(new_1, placed, "new").select("template_id", none.alias("old_ids"), F.array("element_id").alias("new_ids"), F.lit("added").alias("relation"))
    return anchored.unionByName(placed).unionByName(removed).unionByName(added).orderBy("template_id", "old_ids", "new_ids")


def draft(entries: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries carried to the new version, worklist) of masks; an element without lineage, or a mask of which nothing is carried, is an error."""
    old = lineage.select("template_id", F.explode("old_ids").alias("element_id"), "relation", "old_ids", "new_ids")
    met = entries.join(old, ["template_id", "element_id"], "left")
    met = met.withColumn("relation", F.coalesce("relation", F.raise_error(F.lit("an element has no lineage")).cast("string")))
    carried = met.where("relation = 'compatible'").withColumns({"element_id": F.col("new_ids")[0], "inherited_mask_id": F.col("mask_id"), "inherited_version": F.col("mask_version")})
    carried = carried.withColumn("mask_version", F.col("mask_version") + 1).drop("relation", "old_ids", "new_ids")
    ids = lambda c: F.array_join(c, ",").alias(c)
    review = met.where("relation not in ('compatible', 'removed')").select("mask_id", "ord", "element_id", "relation", ids("old_ids"), ids("new_ids"))
    named = entries.select("mask_id", "template_id").distinct()
    added = lineage.where("relation = 'added'").join(named, "template_id").select("mask_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("element_id"), "relation", ids("old_ids"), ids("new_ids"))
    return carried, review.unionByName(added)


TAKEN = ("semantic_role", "target_schema", "field", "datatype", "enum_map", "section_path")


def materialize(baseline: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every entry of a vendor baseline, in its order, with a customer's overrides (element_id and ``TAKEN``, validated_by).

    An override of an element that the baseline lacks, or a second one of an element, is an error.
    """
    n = overrides.groupBy("element_id").agg(F.count("*").alias("times"), *[F.first(c).alias(f"own_{c}") for c in (*TAKEN, "validated_by")])
    out = baseline.join(n, "element_id", "full")
    broken = F.col("ord").isNull() | (F.coalesce("times", F.lit(0)) > 1)
    own = F.col("times").isNotNull()
    cols = {c: F.when(own, F.col(f"own_{c}")).otherwise(F.col(c)) for c in TAKEN}
    cols |= {"origin": F.when(own, "customer").otherwise("vendor"), "overridden": own, "validated_by": F.col("own_validated_by"), "inherited_mask_id": F.col("mask_id"), "inherited_version": F.col("mask_version")}
    cols["ord"] = F.when(broken, F.raise_error(F.lit("an override is unknown to the baseline, or repeated")).cast("int")).otherwise(F.col("ord"))
    return out.withColumns(cols).drop("times", *[f"own_{c}" for c in (*TAKEN, "validated_by")])


def adopt_baseline(new_baseline: DataFrame, current: DataFrame) -> DataFrame:
    """A customer mask's overrides over a newer baseline, as the mask's next version."""
    version = current.agg((F.max("mask_version") + 1).alias("v"), F.max("mask_id").alias("m"))  # one row
    own = current.where("overridden").select("element_id", *TAKEN, "validated_by")
    return materialize(new_baseline, own).drop("mask_id", "mask_version").join(F.broadcast(version)).withColumnsRenamed({"v": "mask_version", "m": "mask_id"})


def next_active(masks: DataFrame, mask_id: str, version: int, scopes: frozenset[str] = frozenset()) -> DataFrame:
    """masks with the active flags after an activation: others of its tenant, template and context fall, whatever their template version.

    A vendor mask needs the scope ``admin``.
    """
    t = masks.where((F.col("mask_id") == mask_id) & (F.col("mask_version") == version)).select(*[F.col(c).alias(f"t_{c}") for c in ("tenant_id", "template_id", "system_context", "scope", "mask_version", "mask_id")]).limit(1)
    if "admin" not in scopes:
        t = t.withColumn("t_scope", F.when(F.col("t_scope") == "vendor", F.raise_error(F.lit("publishing a vendor mask needs the scope admin")).cast("string")).otherwise(F.col("t_scope")))
    same = F.col("tenant_id").eqNullSafe(F.col("t_tenant_id")) & (F.col("template_id") == F.col("t_template_id")) & (F.col("system_context") == F.col("t_system_context"))
    it = (F.col("mask_id") == F.col("t_mask_id")) & (F.col("mask_version") == F.col("t_mask_version"))
    out = masks.join(F.broadcast(t), same, "left")  # one row
    return out.withColumn("active", F.when(F.col("t_scope").isNotNull(), it).otherwise(F.col("active"))).select(masks.columns)


def deactivate_context(masks: DataFrame, tenant: str | None, template_id: str, context: str) -> DataFrame:
    gone = F.col("tenant_id").eqNullSafe(F.lit(tenant)) & (F.col("template_id") == template_id) & (F.col("system_context") == context)
    return masks.withColumn("active", F.col("active") & ~gone)


def activation_blockers(masks: DataFrame, elements: DataFrame, entries: DataFrame) -> DataFrame:
    """mask_id, mask_version, code of masks that may not be activated: no such template version, or entries of elements that it lacks."""
    known = elements.select("template_id", "template_version").distinct()
    lost = masks.join(known, ["template_id", "template_version"], "left_anti").select("mask_id", "mask_version", F.lit("template-missing").alias("code"))
    e = entries.join(masks.select("mask_id", "mask_version", "template_id", "template_version"), ["mask_id", "mask_version"])
    strange = e.join(elements, ["template_id", "template_version", "element_id"], "left_anti").select("mask_id", "mask_version", F.lit("unknown-element-id").alias("code")).distinct()
    return lost.unionByName(strange)


def _versions(spark):
    e = corpus.elements(spark)
    return e.where("template_version = 1"), e.where("template_version = 2")


def _flat(lineage: DataFrame) -> DataFrame:
    return lineage.select("template_id", F.array_join("old_ids", ",").alias("old_ids"), F.array_join("new_ids", ",").alias("new_ids"), "relation")


def q_lineage_anchor(spark, sf_dir):
    return _flat(by_anchor(*_versions(spark)))


def q_lineage_overlap(spark, sf_dir):
    return _flat(by_geometry(*_versions(spark)))


def q_lineage_report(spark, sf_dir):
    return _flat(compare(*_versions(spark)))


def q_lineage_components(spark, sf_dir):
    """Components of 500 bipartite graphs, of parts and supplier classes of large order lines."""
    p = corpus.read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select((F.col("l_orderkey") % 500).alias("g"), F.struct(F.col("l_partkey").cast("string").alias("o"), (F.col("l_suppkey") % 7).cast("string").alias("n")).alias("e"))
    return p.groupBy("g").agg(F.array_sort(F.collect_set("e")).alias("edges")).select("g", F.size(merged_sets(F.col("edges"))).alias("n_components"))


def _entries(spark, mask, version):
    return corpus.entries(spark).where(f"mask_id = '{mask}' and mask_version = {version} and element_id <> 'gone'").withColumn("template_id", F.lit("tmpl_order"))


def q_mask_draft(spark, sf_dir):
    return draft(_entries(spark, "m_vendor", 1), compare(*_versions(spark)))[0].select("mask_id", "mask_version", "ord", "element_id", "semantic_role", "inherited_mask_id", "inherited_version")


def q_mask_worklist(spark, sf_dir):
    return draft(_entries(spark, "m_vendor", 1), compare(*_versions(spark)))[1]


def q_materialize_mask(spark, sf_dir):
    own = corpus.entries(spark).where("mask_id = 'm_t1' and mask_version = 1")
    return materialize(_entries(spark, "m_vendor", 1), own).select("ord", "element_id", "semantic_role", "datatype", "origin", "overridden", "validated_by", "inherited_mask_id")


def q_adopt_baseline(spark, sf_dir):
    return adopt_baseline(_entries(spark, "m_vendor", 1), corpus.entries(spark).where("mask_id = 'm_t1' and mask_version = 1")).select("mask_id", "mask_version", "ord", "element_id", "semantic_role", "overridden")


def q_release_activation(spark, sf_dir):
    return next_active(corpus.masks(spark), "m_t1", 1).select("mask_id", "mask_version", "active")


def q_release_vendor(spark, sf_dir):
    return next_active(corpus.masks(spark), "m_vendor2", 1, frozenset({"admin"})).select("mask_id", "mask_version", "active")


def q_deactivate_context(spark, sf_dir):
    return deactivate_context(corpus.masks(spark), None, "tmpl_order", "erp").select("mask_id", "mask_version", "active")


def q_activation_blockers(spark, sf_dir):
    return activation_blockers(corpus.masks(spark), corpus.elements(spark), corpus.entries(spark))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_LINE = WITH.replace("with reg", "with recursive reg", 1).rstrip() + """, o as (select * from elements where template_version = 1), n as (select * from elements where template_version = 2),
an as (select a.template_id, a.ids as old_ids, b.ids as new_ids, a.l as ol, b.l as nl from (select template_id, kind, label_text, string_agg(element_id, ',' order by element_id) as ids, count(*) as l from o where label_text is not null group by all) a
  join (select template_id, kind, label_text, string_agg(element_id, ',' order by element_id) as ids, count(*) as l from n where label_text is not null group by all) b using (template_id, kind, label_text)),
o1 as (select * from o where label_text is null or not exists (select 1 from n where n.kind = o.kind and n.label_text = o.label_text)), n1 as (select * from n where label_text is null or not exists (select 1 from o where o.kind = n.kind and n.label_text = o.label_text)),
ed as (select o1.element_id as o, n1.element_id as n from o1 join n1 using (page, kind) where least(o1.x1, n1.x1) > greatest(o1.x0, n1.x0) and least(o1.y1, n1.y1) > greatest(o1.y0, n1.y0)
  and (least(o1.x1, n1.x1) - greatest(o1.x0, n1.x0)) * (least(o1.y1, n1.y1) - greatest(o1.y0, n1.y0)) >= 0.5 * least((o1.x1 - o1.x0) * (o1.y1 - o1.y0), (n1.x1 - n1.x0) * (n1.y1 - n1.y0))),
rc as (select distinct o as seed, o from ed union select rc.seed, b.o from rc join ed a on a.o = rc.o join ed b on b.n = a.n),
cp as (select o, min(seed) as root from rc group by o),
gm as (select 'tmpl_order' as template_id, string_agg(distinct ed.o, ',' order by ed.o) as old_ids, string_agg(distinct ed.n, ',' order by ed.n) as new_ids, count(distinct ed.o) as ol, count(distinct ed.n) as nl,
  count(distinct o1.label_text) filter (n1.label_text <> o1.label_text) as changed from cp join ed on ed.o = cp.o join o1 on o1.element_id = ed.o join n1 on n1.element_id = ed.n group by root),
li as (select template_id, old_ids, new_ids, case when ol = 1 and nl = 1 then 'compatible' when ol = 1 then 'split' when nl = 1 then 'merged' else 'ambiguous' end as relation, 0 as part from an
  union all select template_id, old_ids, new_ids, case when ol = 1 and nl = 1 and changed > 0 then 'ambiguous' when ol = 1 and nl = 1 then 'compatible' when ol = 1 then 'split' when nl = 1 then 'merged' else 'ambiguous' end, 1 from gm
  union all select template_id, element_id, '', 'removed', 2 from o1 where element_id not in (select o from ed) union all select template_id, '', element_id, 'added', 3 from n1 where element_id not in (select n from ed))
"""
_ALLGEO = _LINE.replace("o1 as (select * from o where label_text is null or not exists (select 1 from n where n.kind = o.kind and n.label_text = o.label_text))", "o1 as (select * from o)").replace("n1 as (select * from n where label_text is null or not exists (select 1 from o where o.kind = n.kind and n.label_text = o.label_text))", "n1 as (select * from n)")
ORACLES = {
    "lineage_anchor": _LINE + "select template_id, old_ids, new_ids, relation from li where part = 0",
    "lineage_overlap": _ALLGEO + "select template_id, old_ids, new_ids, relation from li where part = 1",
    "lineage_report": _LINE + "select template_id, old_ids, new_ids, relation from li",
    "lineage_components": """with recursive e as (select distinct l_orderkey % 500 as g, l_partkey as o, l_suppkey % 7 as n from lineitem where l_quantity >= 49),
r as (select g, o as seed, o from e union select r.g, r.seed, b.o from r join e a on a.g = r.g and a.o = r.o join e b on b.g = a.g and b.n = a.n), c as (select g, o, min(seed) as root from r group by g, o)
select g, count(distinct root)::int as n_components from c group by g""",
    "mask_draft": _LINE + "select mask_id, mask_version + 1 as mask_version, ord, new_ids as element_id, semantic_role, mask_id as inherited_mask_id, mask_version as inherited_version from entries join li on old_ids = element_id where mask_id = 'm_vendor' and relation = 'compatible'",
    "mask_worklist": _LINE + "select mask_id, ord, element_id, relation, old_ids, new_ids from entries join li on list_contains(string_split(old_ids, ','), element_id) where mask_id = 'm_vendor' and relation not in ('compatible', 'removed') union all select 'm_vendor', null, null, relation, old_ids, new_ids from li where relation = 'added'",
    "materialize_mask": WITH + """select b.ord, b.element_id, coalesce(o.semantic_role, b.semantic_role) as semantic_role, coalesce(o.datatype, b.datatype) as datatype, case when o.element_id is null then 'vendor' else 'customer' end as origin, o.element_id is not null as overridden, o.validated_by, 'm_vendor' as inherited_mask_id
  from entries b left join entries o on o.mask_id = 'm_t1' and o.mask_version = 1 and o.element_id = b.element_id where b.mask_id = 'm_vendor' and b.element_id <> 'gone'""",
    "adopt_baseline": WITH + """select 'm_t1' as mask_id, 2 as mask_version, b.ord, b.element_id, coalesce(o.semantic_role, b.semantic_role) as semantic_role, o.element_id is not null as overridden
  from entries b left join entries o on o.mask_id = 'm_t1' and o.mask_version = 1 and o.element_id = b.element_id where b.mask_id = 'm_vendor' and b.element_id <> 'gone'""",
    "release_activation": WITH + "select mask_id, mask_version, case when tenant_id = 't-1' then mask_version = 1 else active end as active from masks",
    "release_vendor": WITH + "select mask_id, mask_version, case when tenant_id is null and system_context = 'erp' then mask_id = 'm_vendor2' else active end as active from masks",
    "deactivate_context": WITH + "select mask_id, mask_version, active and not (tenant_id is null and system_context = 'erp') as active from masks",
    "activation_blockers": WITH + "select distinct mask_id, mask_version, 'unknown-element-id' as code from entries e join masks m using (mask_id, mask_version) where not exists (select 1 from elements l where l.template_id = m.template_id and l.template_version = m.template_version and l.element_id = e.element_id)",
}
