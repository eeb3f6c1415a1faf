"""A document view of the test tables: registrations, observations, spans, masks and templates.

Each table is a DataFrame here and a common table expression of the same name in ``WITH``, which oracles build on. The
literal tables (masks, entries, templates) are one text that both dialects read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MASKS = """select * from (values
 ('m_vendor', 1, cast(null as string), 'vendor', 'tmpl_order', 1, 'erp', true),
 ('m_vendor2', 1, null, 'vendor', 'tmpl_order', 2, 'erp', true),
 ('m_crm', 1, null, 'vendor', 'tmpl_order', 1, 'crm', true),
 ('m_t1', 1, 't-1', 'customer', 'tmpl_order', 1, 'erp', false),
 ('m_t1', 2, 't-1', 'customer', 'tmpl_order', 1, 'erp', true),
 ('m_t2', 1, 't-2', 'customer', 'tmpl_order', 2, 'erp', true),
 ('m_t3', 1, 't-3', 'customer', 'tmpl_order', 1, 'erp', true)
) as m(mask_id, mask_version, tenant_id, scope, template_id, template_version, system_context, active)"""

ENTRIES = """select * from (values
 ('m_vendor', 1, cast(null as string), 1, 'number', 'order_number', 'order_v1', 'order_no', 'number', cast(null as string), 'head', 'vendor', cast(null as string), cast(null as int), false, 'v-1'),
 ('m_vendor', 1, null, 2, 'date', 'order_date', 'order_v1', 'ordered_on', 'date', null, 'head', 'vendor', null, null, false, 'v-1'),
 ('m_vendor', 1, null, 3, 'total', 'total_amount', 'order_v1', 'total', 'number', null, 'body.sums', 'vendor', null, null, false, 'v-1'),
 ('m_vendor', 1, null, 4, 'status', 'status_code', 'order_v1', 'closed', 'boolean', '{"F":true,"O":false}', 'body', 'vendor', null, null, false, 'v-1'),
 ('m_vendor', 1, null, 5, 'gone', 'never_seen', 'order_v1', 'note', 'string', null, null, 'vendor', null, null, false, 'v-1'),
 ('m_vendor2', 1, null, 1, 'number', 'order_number', 'order_v1', 'order_no', 'number', null, 'head', 'vendor', null, null, false, 'v-1'),
 ('m_vendor2', 1, null, 2, 'priority', 'urgency', 'order_v1', 'note', 'string', null, 'body', 'vendor', null, null, false, null),
 ('m_crm', 1, null, 1, 'number', 'case_number', 'case_v1', 'case_no', 'string', null, 'head', 'vendor', null, null, false, 'v-2'),
 ('m_t1', 1, 't-1', 1, 'number', 'old_number', 'order_v1', 'order_no', 'string', null, 'head', 'customer', 'm_vendor', 1, true, null),
 ('m_t1', 2, 't-1', 1, 'number', 'order_no', 'order_v1', 'order_no', 'number', null, 'head', 'customer', 'm_vendor', 1, true, null),
 ('m_t1', 2, 't-1', 2, 'total', 'amount_due', 'order_v1', 'total', 'number', null, 'body', 'vendor', 'm_vendor', 1, false, null),
 ('m_t1', 2, 't-1', 3, 'date', 'day', 'order_v1', 'ordered_on', 'date', null, 'body', 'vendor', 'm_vendor', 1, false, null),
 ('m_t1', 2, 't-1', 4, 'status', 'done', 'order_v1', 'closed', 'boolean', '{"F":true,"O":false}', 'body', 'customer', null, null, true, null),
 ('m_t1', 2, 't-1', 5, 'priority', 'urgency', 'order_v1', 'note', 'string', '{"1-URGENT":"now","2-HIGH":"soon"}', 'body', 'customer', 'm_vendor', 1, true, null),
 ('m_t2', 1, 't-2', 1, 'priority', 'urgency', 'order_v1', 'note', 'string', null, 'body', 'customer', null, null, true, null),
 ('m_t3', 1, 't-3', 1, 'number', 'order_number', 'order_v1', 'order_no', 'number', null, 'head', 'customer', null, null, false, null)
) as e(mask_id, mask_version, tenant_id, ord, element_id, semantic_role, target_schema, field, datatype, enum_map, section_path, origin, inherited_mask_id, inherited_version, overridden, validated_by)"""

ELEMENTS = """select * from (values
 ('tmpl_order', 1, 1, 'lbl_number', 'label', 1, 60e0, 680e0, 110e0, 692e0, 'Order 1.1 No', false),
 ('tmpl_order', 1, 2, 'number', 'value_region', 1, 120e0, 680e0, 200e0, 692e0, '1.1 Number', false),
 ('tmpl_order', 1, 3, 'date', 'value_region', 1, 120e0, 660e0, 200e0, 672e0, '1.2 Date', false),
 ('tmpl_order', 1, 4, 'total', 'value_region', 1, 120e0, 640e0, 200e0, 652e0, 'Total', false),
 ('tmpl_order', 1, 5, 'status', 'value_region', 1, 120e0, 620e0, 200e0, 632e0, 'State', true),
 ('tmpl_order', 1, 6, 'priority', 'value_region', 1, 120e0, 600e0, 200e0, 612e0, 'Priority', false),
 ('tmpl_order', 1, 7, 'lines', 'table', 2, 60e0, 300e0, 300e0, 500e0, cast(null as string), false),
 ('tmpl_order', 1, 8, 'memo', 'value_region', 2, 60e0, 200e0, 160e0, 240e0, null, true),
 ('tmpl_order', 2, 1, 'lbl_number', 'label', 1, 60e0, 680e0, 110e0, 692e0, 'Order 1.1 No', false),
 ('tmpl_order', 2, 2, 'order_number', 'value_region', 1, 122e0, 681e0, 202e0, 693e0, '1.1 Number', false),
 ('tmpl_order', 2, 3, 'date', 'value_region', 1, 120e0, 660e0, 200e0, 672e0, '1.2 Date', false),
 ('tmpl_order', 2, 4, 'total_net', 'value_region', 1, 120e0, 640e0, 160e0, 652e0, 'Net', false),
 ('tmpl_order', 2, 5, 'total_tax', 'value_region', 1, 160e0, 640e0, 200e0, 652e0, 'Tax', false),
 ('tmpl_order', 2, 6, 'status', 'value_region', 1, 121e0, 621e0, 201e0, 633e0, 'Status', true),
 ('tmpl_order', 2, 7, 'lines', 'table', 2, 60e0, 300e0, 300e0, 500e0, null, false),
 ('tmpl_order', 2, 8, 'signature', 'value_region', 2, 300e0, 40e0, 400e0, 80e0, 'Signed', false)
) as t(template_id, template_version, ord, element_id, kind, page, x0, y0, x1, y1, label_text, optional)"""

STATE = """case when (o_orderkey + i) % 11 = 0 then 'empty' when (o_orderkey + i) % 13 = 0 then 'unreadable'
  when (o_orderkey + i) % 17 = 0 then 'not_found' else 'present' end"""
RAW = """case i when 1 then case when o_orderkey % 19 = 0 then 'n/a' else cast(o_orderkey as string) end
  when 2 then case when o_orderkey % 23 = 0 then '2026-02-30' else substr(cast(o_orderdate as string), 1, 10) end
  when 3 then cast(cast(floor(o_totalprice) as bigint) as string) when 4 then o_orderstatus else o_orderpriority end"""
#: Columns of an observation but for its state and value; the same text in both dialects.
PLAIN = """tenant_id, document_id, content_id, content_version, template_id, template_version, o_orderkey, cast(i as int) as ord,
  case i when 1 then 'number' when 2 then 'date' when 3 then 'total' when 4 then 'status' else 'priority' end as element_id,
  cast(50 + (o_orderkey * 37 + i * 7) % 51 as double) / 100e0 as confidence_raw,
  cast(50 + (o_orderkey * 37 + i * 7) % 51 as double) / 100e0 * 0.97e0 as confidence_calibrated,
  cast(1 + (o_orderkey + i) % 3 as int) as page, 120e0 + o_orderkey % 7 as x0, 700e0 - 20 * i as y0, 180e0 + o_orderkey % 7 as x1, 712e0 - 20 * i as y1,
  case when o_orderkey % 29 = 0 then 'human' when o_orderkey % 10 = 0 then 'ocr' else 'pdf_text' end as method,
  case when o_orderkey % 58 = 0 then 'u-1' end as corrected_by, concat('page-', 1 + (o_orderkey + i) % 3) as coordinate_space, 'x-1.0' as component_version"""
REGISTERED = """select o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority, concat('doc_', o_orderkey) as document_id, concat('t-', c_nationkey % 5) as tenant_id,
  case when o_orderkey % 7 <> 0 then 'tmpl_order' end as template_id, case when o_orderkey % 7 <> 0 then cast(1 + o_orderkey % 2 as int) end as template_version,
  concat('content_', o_orderkey) as content_id, 1 as content_version, cast(2 + o_orderkey % 2 as int) as page_count
  from {orders} join {customer} on o_custkey = c_custkey"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: ids, tenant, template (null where none), pages."""
    return spark.sql(REGISTERED, orders=read(spark, sf_dir, "orders"), customer=read(spark, sf_dir, "customer"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a document, in element order; value is null unless the state is present."""
    rows = registered(spark, sf_dir).selectExpr("*", "explode(array(1, 2, 3, 4, 5)) as i").selectExpr("*", f"{STATE} as state")
    return rows.selectExpr(*_columns(PLAIN), "state", f"case when state = 'present' then {RAW} end as value", "sha2(document_id, 256) as artifact_sha256")


def _columns(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def masks(spark: SparkSession) -> DataFrame:
    return spark.sql(MASKS)


def entries(spark: SparkSession) -> DataFrame:
    return spark.sql(ENTRIES)


def elements(spark: SparkSession) -> DataFrame:
    return spark.sql(ELEMENTS)


WITH = f"""with reg as ({REGISTERED.format(orders="orders", customer="customer")}),
obs_i as (select *, {STATE} as state from reg, (values (1), (2), (3), (4), (5)) as n(i)),
obs as (select {PLAIN}, state, case when state = 'present' then {RAW} end as value, sha256(document_id) as artifact_sha256 from obs_i),
masks as ({MASKS}), entries as ({ENTRIES}), elements as ({ELEMENTS})
"""


#: Spans of templated documents: labels and values near their places in version 1, some moved, missing or changed, and table cells.
SPANS = """select document_id, o_orderkey, tenant_id, page_count, ord * 10 as ord, page, label_text_ as text, lx0 + o_orderkey % 4 as x0, y0 + o_orderkey % 3 as y0, lx0 + 45 + o_orderkey % 4 as x1, y1 + o_orderkey % 3 as y1,
    cast(60 + (o_orderkey + ord) % 40 as double) / 100e0 as confidence from (select *, case when o_orderkey % 31 = 0 and ord = 3 then concat('X', label_text) else label_text end as label_text_ from {placed}) a
  where label_text is not null and (o_orderkey + ord) % 29 <> 0
 union all select document_id, o_orderkey, tenant_id, page_count, ord * 10 + n, page, concat('v', ord, '-', n, '-', o_orderkey % 1000), x0 + 3 + 30 * (n % 2) + o_orderkey % 4, y0 + 1 + o_orderkey % 3 - (n // 2) * 0e0, x0 + 28 + 30 * (n % 2) + o_orderkey % 4, y0 + 9 + o_orderkey % 3,
    cast(40 + (o_orderkey * 7 + ord * 13 + n) % 60 as double) / 100e0 from {placed} b, (values (1), (2)) as n(n)
  where kind = 'value_region' and (o_orderkey + ord) % 11 <> 0 and (n = 1 or (o_orderkey + ord) % 5 = 0)
 union all select document_id, o_orderkey, tenant_id, page_count, ord * 10 + n, page, concat('c', n), x0 + 40 * n, y1 - 14e0, x0 + 40 * n + 30, y1 - 2e0, 0.9e0
  from {placed} c, (values (1), (2), (3), (4)) as n(n) where kind = 'table' and n <= 2 + o_orderkey % 5"""
PLACED = """select document_id, o_orderkey, tenant_id, page_count, e.*, case when e.kind = 'label' then e.x0 else e.x0 - 50 end as lx0
  from {reg} r join {elements} e on r.template_id = e.template_id and e.template_version = 1"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACED, reg=registered(spark, sf_dir), elements=elements(spark))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS.replace("//", "div"), placed=placed(spark, sf_dir))


WITH_SPANS = WITH.rstrip() + f""", placed as ({PLACED.format(reg="reg", elements="elements")}), spans as ({SPANS.format(placed="placed")})
"""
