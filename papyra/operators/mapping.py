"""Mapping of observations to typed records: references, masks, coercion, schema, outcome, corrections, held documents.

All steps work on rows (document, entry), so one plan maps every document of a tenant. A mask and a target schema are small and
known to the driver; a schema becomes column predicates when the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators.reading import _ctx, _session, last_of, mask_rows
from papyra.plans.session import TenantSession
from papyra.sources import corpus

THRESHOLD = 0.75
SCHEMAS = {
    ("order_v1", 1): {
        "required": ["order_no", "ordered_on", "total"],
        "additionalProperties": False,
        "properties": {"order_no": {"type": "number"}, "ordered_on": {"type": "string"}, "total": {"type": "number"}, "closed": {"type": "boolean"}, "note": {"type": "string", "minLength": 4}},
    }
}


class UnknownSchema(KeyError):
    pass


def schema_of(schema_id: str, version: int, registry: dict = SCHEMAS) -> dict:
    if (schema_id, version) not in registry:
        raise UnknownSchema(f"{schema_id} v{version}")
    return registry[schema_id, version]


def single_schema(entries: DataFrame) -> DataFrame:
    """mask_id, mask_version, target_schema of each mask; more than one schema in a mask is an error."""
    one = F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise(F.raise_error(F.lit("a mask binds more than one target schema")).cast("string"))
    return entries.groupBy("mask_id", "mask_version").agg(F.collect_set("target_schema").alias("s")).select("mask_id", "mask_version", one.alias("target_schema"))


def resolve_refs(documents: DataFrame, template_id: str, version: int) -> DataFrame:
    """documents with fits: whether each is of the mask's template version; a null reference isn't."""
    fits = F.col("template_id").eqNullSafe(F.lit(template_id)) & F.col("template_version").eqNullSafe(F.lit(version))
    return documents.withColumn("fits", fits)


def entry_values(documents: DataFrame, values: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each entry of the documents' template version, with the document's last observation of its element, if any."""
    e = entries.select("template_id", "template_version", F.col("ord").alias("entry"), "element_id", "field", "datatype", "enum_map")
    v = last_of(values, ["document_id", "element_id"], F.col("ord")).select("document_id", "element_id", "state", "value", F.col("confidence_calibrated").alias("calibrated"), "method")
    return documents.select("document_id", "template_id", "template_version").join(e, ["template_id", "template_version"]).join(v, ["document_id", "element_id"], "left")


def apply_mask(rows: DataFrame) -> DataFrame:
    """rows with kind: blank, unreadable, text, mapped or issue; and said, the text or mapped value, and flag, whether it is a boolean."""
    hit = F.try_element_at(F.from_json("enum_map", "map<string,variant>"), F.col("value"))
    known = F.col("enum_map").isNotNull()
    kind = (
        F.when(F.col("state").isNull() | F.col("state").isin("empty", "not_applicable", "not_found"), "blank")
        .when(F.col("state") == "unreadable", "unreadable").when(~known, "text").when(hit.isNotNull(), "mapped").otherwise("issue")
    )
    out = rows.withColumns({"kind": kind, "hit": F.when(known, hit)})
    flag = F.coalesce(F.schema_of_variant("hit") == "BOOLEAN", F.lit(False))
    said = F.when(F.col("kind") == "text", F.col("value")).when(F.col("kind") == "mapped", F.col("hit").cast("string"))
    return out.withColumns({"flag": flag, "said": said}).drop("hit")


def coerce_scalar(rows: DataFrame) -> DataFrame:
    """rows with number, txt and flagged (one of them set) and issue, by datatype; nothing for rows that aren't decoded."""
    said, kind = F.col("said"), F.col("datatype")
    decoded = F.col("kind").isin("text", "mapped")
    number = F.when(decoded & ~F.col("flag") & (kind == "number"), T.to_number(said))
    txt = F.when(decoded & ~F.col("flag") & ((kind == "string") | ((kind == "date") & T.is_date(said))), said)
    flagged = F.when(decoded & F.col("flag") & (kind == "boolean"), said == "true")
    out = rows.withColumns({"number": number, "txt": txt, "flagged": flagged})
    none = F.coalesce(F.col("number").isNull() & F.col("txt").isNull() & F.col("flagged").isNull(), F.lit(True))
    return out.withColumn("issue", F.when(F.col("kind") == "issue", "enum-map-miss").when(decoded & none, "datatype-mismatch"))


def coerce_table(text: Column, columns: list[tuple[str, str]]) -> Column:
    """Rows of a table's text, or null if any of them doesn't fit: the first line is the header, and of each other the last
    tokens go to the last columns and the rest to the first one. Cells are numbers or strings that aren't empty."""
    width = len(columns)

    def cells(line: Column) -> Column:
        words = T.tokens(line)
        texts = [F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - F.lit(width - 1))), " ")]
        texts += [F.try_element_at(words, F.lit(k - width)) for k in range(1, width)]
        made = [T.to_number(t) if kind == "number" else F.nullif(t, F.lit("")) for t, (_, kind) in zip(texts, columns, strict=True)]
        fine = F.size(words) >= width
        for c in made:
            fine = fine & c.isNotNull()
        return F.when(fine, F.struct(*[c.alias(n) for c, (n, _) in zip(made, columns, strict=True)]))

    every = T.lines(text)
    rows = F.transform(F.slice(every, F.lit(2), F.greatest(F.lit(0), F.size(every) - 1)), cells)
    known = all(kind in ("number", "string") for _, kind in columns)
    return F.when(F.lit(known) & (F.size(every) > 0) & F.forall(rows, lambda r: r.isNotNull()), rows)


def fields(rows: DataFrame) -> DataFrame:
    """One row a document and field: the last entry that gave it a value."""
    given = rows.where("issue is null and kind in ('text', 'mapped')")
    return last_of(given, ["document_id", "field"], F.col("entry"))


def bind_issues(documents: DataFrame, bound: DataFrame, schema: dict) -> DataFrame:
    """document_id, field, code for each way in which a document's fields break the schema."""
    needed = documents.select("document_id", F.explode(F.array(*map(F.lit, sorted(schema["required"])))).alias("field"))
    missing = needed.join(bound.select("document_id", "field"), ["document_id", "field"], "left_anti").withColumn("code", F.lit("required-field-missing"))
    known = schema["properties"]
    wrong = F.lit(False)
    for name, spec in known.items():
        column = {"number": "number", "string": "txt", "boolean": "flagged"}[spec["type"]]
        broken = F.col(column).isNull() | (F.length("txt") < spec.get("minLength", 0) if spec["type"] == "string" else F.lit(False))
        wrong = wrong | ((F.col("field") == name) & broken)
    code = F.when(~F.col("field").isin(*known), F.lit("unknown-field") if schema.get("additionalProperties") is False else F.lit(None)).when(wrong, "schema-type-mismatch")
    return missing.unionByName(bound.select("document_id", "field", code.alias("code")).where("code is not null"))


def review_items(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """document_id, place, element_id, field, reason, calibrated, method: what is below the threshold, then what is unreadable, by entry."""
    below = rows.where(F.col("issue").isNull() | (F.col("issue") != "enum-map-miss")).where("kind in ('text', 'mapped')").where(F.col("calibrated") < threshold)
    cols = ["document_id", "entry", "element_id", "field", "calibrated", "method"]
    items = below.select(*cols, F.lit("below_threshold").alias("reason"), F.lit(0).alias("part"))
    return items.unionByName(rows.where("kind = 'unreadable'").select(*cols, F.lit("unreadable").alias("reason"), F.lit(1).alias("part")))


def outcomes(documents: DataFrame, rows: DataFrame, schema: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """document_id, outcome, contract_validation, error_category for each document (with fits); no schema is a technical failure."""
    none = F.lit(None).cast("string")
    if schema is None:
        verdict = F.when(F.col("fits"), F.struct(F.lit("failed").alias("outcome"), F.lit("not_evaluated").alias("contract_validation"), F.lit("technical").alias("error_category")))
    else:
        uncertain = review_items(rows, threshold).groupBy("document_id").agg(F.max(F.col("field").isin(*schema["required"])).alias("required_uncertain"))
        mapped = documents.where("fits")
        issues = rows.where("issue is not null").select("document_id").unionByName(bind_issues(mapped, fields(rows), schema).select("document_id")).distinct().withColumn("broken", F.lit(True))
        documents = documents.join(uncertain, "document_id", "left").join(issues, "document_id", "left")
        as_struct = lambda o, c, e: F.struct(F.lit(o).alias("outcome"), F.lit(c).alias("contract_validation"), (F.lit(e) if e else none).alias("error_category"))
        verdict = F.when(F.col("fits"), F.when(F.col("required_uncertain"), as_struct("pending_review", "not_evaluated", "extraction_uncertainty")).when(F.col("broken"), as_struct("rejected", "failed", "contract")).otherwise(as_struct("completed", "passed", None)))
    waiting = F.struct(F.lit("pending_template_review").alias("outcome"), F.lit("not_evaluated").alias("contract_validation"), none.alias("error_category"))
    return documents.select("document_id", F.coalesce(verdict, waiting).alias("v")).select("document_id", "v.*")


def records(results: DataFrame, rows: DataFrame, schema: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One typed record a completed document; uncertain fields, all optional there, are left out."""
    done = results.where("outcome = 'completed'").select("document_id")
    out = review_items(rows, threshold).select("document_id", "field").distinct()
    kept = fields(rows).join(done, "document_id", "left_semi").join(out, ["document_id", "field"], "left_anti")
    column = {"number": "number", "string": "txt", "boolean": "flagged"}
    return done.join(kept.groupBy("document_id").agg(*[F.max(F.when(F.col("field") == n, F.col(column[s["type"]]))).alias(n) for n, s in schema["properties"].items()]), "document_id", "left")


def fold_rulesets(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """results with completed documents that a ruleset refused (verdicts: document_id, ok) as rejected by business rule."""
    refused = verdicts.groupBy("document_id").agg(F.bool_and("ok").alias("ok"))
    out = results.join(refused, "document_id", "left")
    fell = F.coalesce((F.col("outcome") == "completed") & ~F.col("ok"), F.lit(False))
    return out.select("document_id", F.when(fell, "rejected").otherwise(F.col("outcome")).alias("outcome"), "contract_validation", F.when(fell, "business_rule").otherwise(F.col("error_category")).alias("error_category"))


def flatten_record(rows: DataFrame, scalars: list[str], table: str) -> DataFrame:
    """document_id, path, value: scalars by name, cells of the array of structs as table/row/column; a null leaf is an error."""
    whole = lambda c: F.coalesce(c.cast("string"), F.raise_error(F.lit("a record's leaf is null")).cast("string"))
    flat = rows.select("document_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, scalars)), F.array(*[whole(F.col(c)) for c in scalars]))).alias("path", "value"))
    inner = [f.name for f in rows.schema[table].dataType.elementType.fields]
    cells = rows.select("document_id", F.posexplode(table).alias("i", "r"))
    paths = F.array(*[F.struct(F.concat(F.lit(f"{table}/"), "i", F.lit(f"/{n}")).alias("path"), whole(F.col(f"r.{n}")).alias("value")) for n in inner])
    return flat.unionByName(cells.select("document_id", F.inline(paths)))


def correct(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """values with corrected observations (corrections: document_id, element_id, new_value, by), as a new content version of their documents."""
    c = last_of(corrections, ["document_id", "element_id"], F.col("new_value")).withColumn("fixed", F.lit(True))
    touched = corrections.select("document_id").distinct().withColumn("touched", F.lit(1))
    out = values.join(c, ["document_id", "element_id"], "left").join(touched, "document_id", "left")
    fixed = F.col("fixed").isNotNull()
    human = {"value": "new_value", "state": F.lit("present"), "confidence_raw": F.lit(1.0), "confidence_calibrated": F.lit(1.0), "method": F.lit("human"), "corrected_by": "by"}
    cols = {k: F.when(fixed, F.col(v) if isinstance(v, str) else v).otherwise(F.col(k)) for k, v in human.items()}
    cols["content_version"] = F.col("content_version") + F.coalesce("touched", F.lit(0))
    return out.withColumns(cols).drop("new_value", "by", "fixed", "touched")


def correction_audit(corrections: DataFrame) -> DataFrame:
    """What was corrected by whom, without the value."""
    return corrections.select("document_id", "element_id", "by")


def hold(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.lit("pending_template_review").alias("state"))


def release_held(held: DataFrame, values: DataFrame, elements: DataFrame, template_id: str, version: int) -> DataFrame:
    """document_id, action, unresolved: map as it is if all observed elements are the template's, else extract again."""
    known = elements.where((F.col("template_id") == template_id) & (F.col("template_version") == version)).select("element_id")
    strange = values.join(held.select("document_id"), "document_id", "left_semi").join(known, "element_id", "left_anti")
    strange = strange.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("element_id")), ",").alias("unresolved"))
    out = held.select("document_id").join(strange, "document_id", "left")
    return out.select("document_id", F.when(F.col("unresolved").isNull(), "map_without_reextraction").otherwise("reextract").alias("action"), F.coalesce("unresolved", F.lit("")).alias("unresolved"))


def _rows(spark, sf_dir):
    values, resolved = _session("t-1", spark, sf_dir)
    docs = resolve_refs(TenantSession("worker", "t-1").table(corpus.registered(spark, sf_dir), "documents"), "tmpl_order", 1).select("document_id", "template_id", "template_version", "fits")
    mask = resolved.where("system_context = 'erp' and template_version = 1")
    return docs, coerce_scalar(apply_mask(entry_values(docs.where("fits"), values, mask)))


def q_map_resolve(spark, sf_dir):
    return _rows(spark, sf_dir)[0].select("document_id", "fits")


def q_map_apply_mask(spark, sf_dir):
    return _rows(spark, sf_dir)[1].select("document_id", "element_id", "field", "kind", "said", "flag")


def q_map_coerce_scalar(spark, sf_dir):
    return _rows(spark, sf_dir)[1].select("document_id", "field", F.round("number", 6).alias("number"), "txt", "flagged", "issue")


def q_map_single_schema(spark, sf_dir):
    return single_schema(corpus.entries(spark))


def q_map_bind_issues(spark, sf_dir):
    docs, rows = _rows(spark, sf_dir)
    return bind_issues(docs.where("fits"), fields(rows), schema_of("order_v1", 1))


def q_map_review_items(spark, sf_dir):
    return review_items(_rows(spark, sf_dir)[1]).select("document_id", "part", "entry", "element_id", "reason", F.round("calibrated", 6).alias("calibrated"))


def q_map_outcome(spark, sf_dir):
    return outcomes(*_rows(spark, sf_dir), schema_of("order_v1", 1))


def q_map_unknown_schema(spark, sf_dir):
    return outcomes(*_rows(spark, sf_dir), None)


def q_map_record(spark, sf_dir):
    docs, rows = _rows(spark, sf_dir)
    schema = schema_of("order_v1", 1)
    return records(outcomes(docs, rows, schema), rows, schema)


def q_map_ruleset_fold(spark, sf_dir):
    docs, rows = _rows(spark, sf_dir)
    verdicts = corpus.registered(spark, sf_dir).select("document_id", (F.col("o_orderkey") % 3 != 0).alias("ok"))
    return fold_rulesets(outcomes(docs, rows, schema_of("order_v1", 1)), verdicts)


COLUMNS = [("item", "string"), ("qty", "number"), ("price", "number")]


def tables_of(spark, sf_dir) -> DataFrame:
    line = F.concat_ws(" ", F.concat(F.lit("P"), "l_partkey"), F.when(F.col("l_partkey") % 97 != 0, F.col("l_quantity").cast("bigint")), F.when(F.col("l_suppkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("l_linenumber").cast("string")))
    rows = corpus.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("ls"))
    return rows.select(F.concat(F.lit("doc_"), "l_orderkey").alias("document_id"), F.array_join(F.concat(F.array(F.lit("Item Qty Price")), F.col("ls.t")), "\n").alias("text"))


def q_map_coerce_table(spark, sf_dir):
    made = tables_of(spark, sf_dir).select("document_id", coerce_table(F.col("text"), COLUMNS).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["qty"])
    return made.select("document_id", F.col("rows").isNull().alias("issue"), F.size("rows").alias("n_rows"), total.alias("qty"), F.array_join("rows.item", "|").alias("items"))


def q_record_flatten(spark, sf_dir):
    made = tables_of(spark, sf_dir).select("document_id", F.length("text").alias("size"), coerce_table(F.col("text"), COLUMNS).alias("lines")).where("lines is not null")
    flat = flatten_record(made, ["size"], "lines")
    return flat.select("document_id", "path", F.coalesce(T.to_number(F.col("value")).cast("string"), "value").alias("value")).where("path not like '%/price'")


def _corrections(spark, sf_dir):
    docs = corpus.registered(spark, sf_dir).where("tenant_id = 't-1' and o_orderkey % 5 = 0")
    return docs.select("document_id", F.lit("number").alias("element_id"), F.lit("42").alias("new_value"), F.lit("u-9").alias("by"))


def q_correction(spark, sf_dir):
    values = correct(_session("t-1", spark, sf_dir)[0], _corrections(spark, sf_dir))
    return values.select("document_id", "element_id", "state", "value", "method", "corrected_by", "content_version", F.round("confidence_calibrated", 6).alias("calibrated"))


def q_correction_remap(spark, sf_dir):
    values, resolved = _session("t-1", spark, sf_dir)
    docs = _rows(spark, sf_dir)[0]
    mask = resolved.where("system_context = 'erp' and template_version = 1")
    rows = coerce_scalar(apply_mask(entry_values(docs.where("fits"), correct(values, _corrections(spark, sf_dir)), mask)))
    return outcomes(docs, rows, schema_of("order_v1", 1)).groupBy("outcome").agg(F.count("*").alias("n"))


def q_correction_audit(spark, sf_dir):
    return correction_audit(_corrections(spark, sf_dir))


def q_held_release(spark, sf_dir):
    held = hold(corpus.registered(spark, sf_dir).where("tenant_id = 't-1' and template_id is null"))
    return release_held(held, corpus.observations(spark, sf_dir).where("state <> 'not_found'"), corpus.elements(spark), "tmpl_order", 2)


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_MAP = _ctx("t-1").rstrip() + r""",
docs as (select document_id, template_id, template_version, coalesce(template_id = 'tmpl_order' and template_version = 1, false) as fits from reg where tenant_id = 't-1'),
ev as (select d.document_id, m.ord as entry, m.element_id, m.field, m.datatype, m.enum_map, dv.state, dv.value, dv.confidence_calibrated as calibrated, dv.method
  from docs d join ram m on m.system_context = 'erp' and m.template_id = d.template_id and m.template_version = d.template_version left join dv on dv.document_id = d.document_id and dv.element_id = m.element_id where fits),
am1 as (select *, case when enum_map is not null and value is not null then json_extract(enum_map, '$."' || value || '"') end as hit from ev),
ap as (select *, case when state is null or state in ('empty', 'not_applicable', 'not_found') then 'blank' when state = 'unreadable' then 'unreadable' when enum_map is null then 'text'
    when hit is not null then 'mapped' else 'issue' end as kind, coalesce(json_type(hit) = 'BOOLEAN', false) as flag from am1),
sd as (select *, case kind when 'text' then value when 'mapped' then hit ->> '$' end as said from ap),
co as (select *, case when datatype = 'number' and not flag and regexp_full_match(said, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') then said::double end as number,
  case when not flag and (datatype = 'string' or (datatype = 'date' and regexp_full_match(said, '\d{4}-\d{2}-\d{2}') and try_cast(said as date) is not null)) then said end as txt,
  case when flag and datatype = 'boolean' then said = 'true' end as flagged from sd),
rw as (select *, case when kind = 'issue' then 'enum-map-miss' when kind in ('text', 'mapped') and number is null and txt is null and flagged is null then 'datatype-mismatch' end as issue from co),
fl as (select * from (select *, row_number() over (partition by document_id, field order by entry desc) as r from rw where issue is null and kind in ('text', 'mapped')) where r = 1),
bi as (select document_id, field, 'required-field-missing' as code from (select document_id, unnest(['order_no', 'ordered_on', 'total']) as field from docs where fits) n
    where not exists (select 1 from fl where fl.document_id = n.document_id and fl.field = n.field)
  union all select document_id, field, 'schema-type-mismatch' from fl where (field in ('order_no', 'total') and number is null) or (field in ('ordered_on', 'note') and txt is null) or (field = 'closed' and flagged is null) or (field = 'note' and length(txt) < 4)),
ri as (select document_id, 0 as part, entry, element_id, field, 'below_threshold' as reason, calibrated from rw where kind in ('text', 'mapped') and calibrated < 0.75
  union all select document_id, 1, entry, element_id, field, 'unreadable', calibrated from rw where kind = 'unreadable'),
oc as (select document_id, case when not fits then 'pending_template_review' when exists (select 1 from ri where ri.document_id = docs.document_id and field in ('order_no', 'ordered_on', 'total')) then 'pending_review'
    when exists (select 1 from rw where rw.document_id = docs.document_id and issue is not null) or exists (select 1 from bi where bi.document_id = docs.document_id) then 'rejected' else 'completed' end as outcome from docs),
res as (select document_id, outcome, case outcome when 'rejected' then 'failed' when 'completed' then 'passed' else 'not_evaluated' end as contract_validation,
  case outcome when 'pending_review' then 'extraction_uncertainty' when 'rejected' then 'contract' end as error_category from oc)
"""
_REMAP = _MAP.replace(", dv as (select obs.* from obs", ", dv as (select obs.* replace (case when element_id = 'number' and obs.o_orderkey % 5 = 0 then '42' else value end as value, case when element_id = 'number' and obs.o_orderkey % 5 = 0 then 'present' else state end as state, case when element_id = 'number' and obs.o_orderkey % 5 = 0 then 1.0 else confidence_calibrated end as confidence_calibrated) from obs")
_TABLE = r"""with li as (select l_orderkey, l_linenumber, 'P' || l_partkey as item, case when l_partkey % 97 <> 0 then l_quantity::bigint end as qty, case when l_suppkey % 50 <> 0 then l_linenumber end as price, concat_ws(' ', item, qty, coalesce(price::varchar, 'n/a')) as line from lineitem),
t as (select 'doc_' || l_orderkey as document_id, bool_or(qty is null or price is null) as issue, count(*)::int as n, sum(qty)::double as q, string_agg(item, '|' order by l_linenumber, line) as items from li group by l_orderkey),
ok as (select * from t where not issue)
"""
ORACLES = {
    "map_resolve": _MAP + "select document_id, fits from docs",
    "map_apply_mask": _MAP + "select document_id, element_id, field, kind, said, flag from rw",
    "map_coerce_scalar": _MAP + "select document_id, field, round(number, 6) as number, txt, flagged, issue from rw",
    "map_single_schema": corpus.WITH + "select mask_id, mask_version, min(target_schema) as target_schema from entries group by all",
    "map_bind_issues": _MAP + "select * from bi",
    "map_review_items": _MAP + "select document_id, part, entry, element_id, reason, round(calibrated, 6) as calibrated from ri",
    "map_outcome": _MAP + "select * from res",
    "map_unknown_schema": _MAP + "select document_id, case when fits then 'failed' else 'pending_template_review' end as outcome, 'not_evaluated' as contract_validation, case when fits then 'technical' end as error_category from docs",
    "map_record": _MAP + """, kept as (select * from fl where not exists (select 1 from ri where ri.document_id = fl.document_id and ri.field = fl.field))
select res.document_id, max(number) filter (field = 'order_no') as order_no, max(txt) filter (field = 'ordered_on') as ordered_on, max(number) filter (field = 'total') as total, bool_or(flagged) filter (field = 'closed') as closed,
  max(txt) filter (field = 'note') as note from res left join kept using (document_id) where outcome = 'completed' group by res.document_id""",
    "map_ruleset_fold": _MAP + """select res.document_id, case when outcome = 'completed' and o_orderkey % 3 = 0 then 'rejected' else outcome end as outcome, contract_validation,
  case when outcome = 'completed' and o_orderkey % 3 = 0 then 'business_rule' else error_category end as error_category from res join reg using (document_id)""",
    "map_coerce_table": _TABLE + "select document_id, issue, case when not issue then n end as n_rows, case when not issue then q end as qty, case when not issue then items end as items from t",
    "record_flatten": _TABLE + """, texts as (select 'doc_' || l_orderkey as document_id, 'Item Qty Price' || chr(10) || string_agg(line, chr(10) order by l_linenumber, line) as text from li group by l_orderkey),
cells as (select 'doc_' || l_orderkey as document_id, row_number() over (partition by l_orderkey order by l_linenumber, line) - 1 as i, item, qty from li)
select document_id, 'size' as path, length(text)::double::varchar as value from texts join ok using (document_id)
union all select document_id, 'lines/' || i || '/item', item from cells join ok using (document_id) union all select document_id, 'lines/' || i || '/qty', qty::double::varchar from cells join ok using (document_id)""",
    "correction": _ctx("t-1") + """, f as (select *, element_id = 'number' and o_orderkey % 5 = 0 as fixed from dv)
select document_id, element_id, case when fixed then 'present' else state end as state, case when fixed then '42' else value end as value, case when fixed then 'human' else method end as method,
  case when fixed then 'u-9' else corrected_by end as corrected_by, content_version + case when o_orderkey % 5 = 0 then 1 else 0 end as content_version, round(case when fixed then 1.0 else confidence_calibrated end, 6) as calibrated from f""",
    "correction_remap": _REMAP + "select outcome, count(*) as n from oc group by outcome",
    "correction_audit": corpus.WITH + "select document_id, 'number' as element_id, 'u-9' as by from reg where tenant_id = 't-1' and o_orderkey % 5 = 0",
    "held_release": corpus.WITH + """, h as (select document_id from reg where tenant_id = 't-1' and template_id is null),
s as (select document_id, string_agg(distinct element_id, ',' order by element_id) as u from obs where state <> 'not_found' and element_id not in (select element_id from elements where template_version = 2) group by document_id)
select document_id, case when u is null then 'map_without_reextraction' else 'reextract' end as action, coalesce(u, '') as unresolved from h left join s using (document_id)""",
}
