"""Metrics: recorders map result rows to events (name, kind, value, dims), which counters, histograms and rates add up.

Dimensions hold ids, hashes, states and numbers only, never values of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import extraction, mapping
from papyra.operators.extraction import percentile
from papyra.operators.reading import _ctx
from papyra.sources import corpus

CATEGORIES = ("regional_model", "full_analysis", "ocr")


def event(name: str, kind: str, value, /, **dims) -> Column:
    pairs = [x for k, v in dims.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), (value if isinstance(value, Column) else F.lit(value)).cast("double").alias("value"), made.alias("dims"))


def record(rows: DataFrame, *events: tuple[Column | None, Column]) -> DataFrame:
    """name, kind, value, dims: for each row the events whose conditions hold (None: always)."""
    return rows.select(F.inline(F.array_compact(F.array(*[e if c is None else F.when(c, e) for c, e in events]))))


def routing(decisions: DataFrame) -> DataFrame:
    return record(decisions, (None, event("routing.latency_ms", "histogram", F.col("latency_ms"), routed_to="routed_to")), (None, event("routing.decisions", "counter", 1, routed_to="routed_to")), (F.col("template_id").isNotNull(), event("routing.candidate_hits", "counter", 1)), (F.col("status").isNotNull(), event("routing.verification_results", "counter", 1, result="status")))


def gate(assessed: DataFrame) -> DataFrame:
    return record(assessed, (None, event("gate.confidence", "histogram", F.col("assessed"), route="route")))


def extraction_cost(costs: DataFrame) -> DataFrame:
    return record(costs, (None, event("extraction.cost", "histogram", F.col("cost"), category="category")))


def mapping_results(results: DataFrame) -> DataFrame:
    return record(results, (None, event("mapping.outcomes", "counter", 1, outcome="outcome", error_category=F.coalesce("error_category", F.lit("none")))))


def mapping_reviews(items: DataFrame) -> DataFrame:
    return record(items, (None, event("mapping.review_items", "counter", 1, reason="reason", method="method")))


def unmapped(notes: DataFrame) -> DataFrame:
    return record(notes, (None, event("unmapped.notes", "counter", 1, note_id="note_id")), (None, event("unmapped.region_recurrence", "counter", 1, region_hash="region_hash")))


def migration(carried: DataFrame, worklist: DataFrame) -> DataFrame:
    return record(carried, (None, event("migration.relations", "counter", 1, relation=F.lit("compatible")))).unionByName(record(worklist, (None, event("migration.relations", "counter", 1, relation="relation"))))


def held(documents: DataFrame, now: float) -> DataFrame:
    return record(documents, (None, event("held.backlog", "counter", 1)), (None, event("held.age_s", "histogram", F.lit(now) - F.col("held_at"))))


def jobs(states: DataFrame) -> DataFrame:
    return record(states, (None, event("jobs.status", "counter", 1, kind="job_kind", status="status")), (F.col("status") == "queued", event("builds.scheduled", "counter", 1)), (F.col("switch_ms").isNotNull(), event("builds.switch_ms", "histogram", F.col("switch_ms"))))


def denials(rows: DataFrame) -> DataFrame:
    return record(rows, (None, event("isolation.denials", "counter", 1, role="role", resource="resource")))


def _dims() -> Column:
    return T.joined_versions(F.col("dims")).alias("dims")


def counters(events: DataFrame) -> DataFrame:
    """name, dims (k=v;...), total."""
    return events.where("kind = 'counter'").groupBy("name", _dims()).agg(F.sum("value").alias("total"))


def histograms(events: DataFrame) -> DataFrame:
    x = F.col("value")
    return events.where("kind = 'histogram'").groupBy("name", _dims()).agg(F.count("*").alias("n"), F.round(F.min(x), 6).alias("least"), F.round(F.max(x), 6).alias("most"), F.round(F.avg(x), 6).alias("mean"), F.round(percentile(x, 0.95), 6).alias("p95"))


def derived_rates(events: DataFrame) -> DataFrame:
    """Shares of the routing counters: candidate hits, slow paths, accepted verifications."""
    total = lambda c: F.sum(F.when(c, F.col("value")).otherwise(0.0))
    n = lambda name: F.col("name") == f"routing.{name}"
    share = lambda a, b: F.round(F.try_divide(total(a), total(b)), 6)
    return events.where("kind = 'counter'").agg(share(n("candidate_hits"), n("decisions")).alias("candidate_hit"), share(n("decisions") & (F.col("dims")["routed_to"] == "full_analysis"), n("decisions")).alias("slow_path"), share(n("verification_results") & (F.col("dims")["result"] == "accepted"), n("verification_results")).alias("verify_accept"))


def dimension_values(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.map_values("dims")).alias("value")).distinct()


def leaky_dimensions(events: DataFrame) -> DataFrame:
    """Dimension values that aren't ids."""
    return dimension_values(events).where(~T.id_shaped(F.col("value")))


def cost_ledger(costs: DataFrame) -> DataFrame:
    """tenant_id, category (null: all), total, not 0; an unknown category or a negative cost is an error."""
    fine = F.col("category").isin(*CATEGORIES) & (F.col("cost") >= 0)
    checked = costs.withColumn("cost", F.when(fine, F.col("cost")).otherwise(F.raise_error(F.lit("an unknown category or a negative cost")).cast("double")))
    out = checked.groupingSets([["tenant_id"], ["tenant_id", "category"]], "tenant_id", "category").agg(F.sum("cost").alias("total"), F.grouping("category").alias("every"))
    return out.where("total > 0 or every = 1").select("tenant_id", F.when(F.col("every") == 0, F.col("category")).alias("category"), F.round("total", 6).alias("total"))


def cost_cap(costs: DataFrame, cap: float) -> DataFrame:
    """Tenants over the cap, itemised: total and categories as k=v."""
    item = F.concat("category", F.lit("="), F.format_string("%.1f", "total"))
    ledger = cost_ledger(costs)
    return ledger.groupBy("tenant_id").agg(F.max(F.when(F.col("category").isNull(), F.col("total"))).alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), item))), ";").alias("items")).where(F.col("total") > cap)


def lookup(metrics: Column, path: str) -> Column:
    """A number of nested JSON by dotted path; a missing one is an error."""
    found = F.get_json_object(metrics, f"$.{path}").cast("double")
    return F.coalesce(found, F.raise_error(F.lit(f"no metric {path}")).cast("double"))


def scorecard(criteria: DataFrame, targets: DataFrame) -> DataFrame:
    """criterion, passed: accepted and all its targets (op gte or lte) met; criteria must be 1 to 16."""
    met = F.when(F.col("op") == "gte", F.col("value") >= F.col("bound")).when(F.col("op") == "lte", F.col("value") <= F.col("bound"))
    held_ = targets.groupBy("criterion").agg(F.bool_and(F.coalesce(met, F.lit(False))).alias("met"))
    return criteria.join(held_, "criterion", "left").select("criterion", (F.col("accepted") & F.coalesce("met", F.lit(True))).alias("passed"))


def target_gaps(criteria: DataFrame, n: int = 16) -> DataFrame:
    """Criteria that are missing or strange."""
    wanted = criteria.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("criterion"))
    missing = wanted.join(criteria, "criterion", "left_anti").select("criterion", F.lit("missing").alias("gap"))
    return missing.unionByName(criteria.join(wanted, "criterion", "left_anti").select("criterion", F.lit("unknown").alias("gap")))


def log_record(rows: DataFrame) -> DataFrame:
    """operation, outcome and ids of a log row; what isn't shaped like an id is blanked, and counted."""
    cols = ["operation", "document_id", "outcome"]
    kept = [F.when(T.id_shaped(F.col(c)), F.col(c)).alias(c) for c in cols]
    dropped = sum((F.coalesce((~T.id_shaped(F.col(c)) & F.col(c).isNotNull()).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    return rows.select(*kept, dropped.alias("n_dropped"))


def _decisions(spark, sf_dir) -> DataFrame:
    keys, pairs, checks = extraction._routing(spark, sf_dir)
    out = extraction.route(keys, pairs, extraction.verdicts(checks, "document_id", "rank")).join(corpus.registered(spark, sf_dir).select("document_id", "o_orderkey"), "document_id")
    return out.withColumn("latency_ms", (F.col("o_orderkey") % 997).cast("double"))


def _costs(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return corpus.read(spark, sf_dir, "events").select(F.concat(F.lit("t-"), k % 20).alias("tenant_id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 3 + 1).cast("int")).alias("category"), F.when(k % 20 == 7, 0.0).otherwise((k % 5).cast("double")).alias("cost"))


def q_metric_counters(spark, sf_dir):
    docs, rows = mapping._rows(spark, sf_dir)
    results = mapping.outcomes(docs, rows, mapping.schema_of("order_v1", 1))
    return counters(mapping_results(results).unionByName(mapping_reviews(mapping.review_items(rows))))


def q_metric_histograms(spark, sf_dir):
    return histograms(routing(_decisions(spark, sf_dir)))


def q_routing_metrics(spark, sf_dir):
    return counters(routing(_decisions(spark, sf_dir)))


def q_derived_rates(spark, sf_dir):
    return derived_rates(routing(_decisions(spark, sf_dir)))


def q_gate_metrics(spark, sf_dir):
    return histograms(gate(extraction.cascade_born_digital(corpus.spans(spark, sf_dir), 0.8, 0.6)))


def q_cost_metrics(spark, sf_dir):
    return histograms(extraction_cost(_costs(spark, sf_dir)))


def q_cost_rollup(spark, sf_dir):
    return cost_ledger(_costs(spark, sf_dir))


def q_cost_cap(spark, sf_dir):
    return cost_cap(_costs(spark, sf_dir), 900.0)


def q_unmapped_metrics(spark, sf_dir):
    from papyra.functions.geometry import region_hash

    s = corpus.spans(spark, sf_dir).where("ord > 70")
    return counters(unmapped(s.select(F.concat(F.lit("n-"), "ord").alias("note_id"), region_hash(F.col("page"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("region_hash"))))


def q_held_metrics(spark, sf_dir):
    return histograms(held(corpus.registered(spark, sf_dir).where("template_id is null").select((F.col("o_orderkey") % 100).alias("held_at")), 100.0))


def q_job_metrics(spark, sf_dir):
    k = F.col("event_id")
    e = corpus.read(spark, sf_dir, "events").select(F.when(k % 2 == 0, "a").otherwise("b").alias("job_kind"), F.when(k % 3 == 0, "queued").otherwise("completed").alias("status"), F.when(k % 7 == 0, k % 11).alias("switch_ms"))
    return counters(jobs(e))


def q_denial_metrics(spark, sf_dir):
    k = F.col("event_id")
    return counters(denials(corpus.read(spark, sf_dir, "events").select(F.when(k % 2 == 0, "worker").otherwise("read_api").alias("role"), F.concat(F.lit("r-"), k % 3).alias("resource"))))


def q_migration_metrics(spark, sf_dir):
    from papyra.operators import lineage

    return counters(migration(*lineage.draft(lineage._entries(spark, "m_vendor", 1), lineage.compare(*lineage._versions(spark)))))


def q_leaky_dimensions(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 1000 == 0, "free text here").otherwise(F.concat(F.lit("id-"), F.col("event_id") % 50)).alias("x"))
    return leaky_dimensions(record(e, (None, event("x", "counter", 1, x="x"))))


def q_scorecard(spark, sf_dir):
    c = spark.range(1, 17).select(F.col("id").cast("int").alias("criterion"), (F.col("id") != 9).alias("accepted"))
    n = corpus.read(spark, sf_dir, "events").agg(F.to_json(F.struct(F.struct(F.count("*").alias("events")).alias("run"))).alias("m"))
    t = spark.sql("select * from values (1, 'gte', 1e0), (2, 'lte', 1e0), (3, 'gte', 1e9) as t(criterion, op, bound)").join(F.broadcast(n)).withColumn("value", lookup(F.col("m"), "run.events"))
    return scorecard(c, t)


def q_target_gaps(spark, sf_dir):
    return target_gaps(corpus.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("criterion")).where("criterion <> 4"))


def q_operation_log(spark, sf_dir):
    d = corpus.registered(spark, sf_dir)
    return log_record(d.select(F.lit("get_document_value").alias("operation"), F.when(F.col("o_orderkey") % 6 == 0, "Jane Doe, 1 Main St").otherwise(F.col("document_id")).alias("document_id"), F.lit("ok").alias("outcome"))).groupBy("operation", "outcome", "n_dropped").agg(F.count("document_id").alias("n"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_R = extraction._ROUTE.rstrip() + ", rl as (select *, (o_orderkey % 997)::double as l from ro) "
_C = "with c as (select 't-' || event_id % 20 as tenant_id, ['regional_model', 'full_analysis', 'ocr'][event_id % 3 + 1] as category, case when event_id % 20 = 7 then 0.0::double else (event_id % 5)::double end as cost from events) "
ORACLES = {
    "metric_counters": mapping._MAP + """select 'mapping.outcomes' as name, 'error_category=' || coalesce(error_category, 'none') || ';outcome=' || outcome as dims, count(*)::double as total from res group by all
 union all select 'mapping.review_items', 'method=' || method || ';reason=' || reason, count(*)::double from ri join (select document_id, entry, method from rw) using (document_id, entry) group by all""",
    "metric_histograms": _R + "select 'routing.latency_ms' as name, 'routed_to=' || routed_to as dims, count(*) as n, min(l) as least, max(l) as most, round(avg(l), 6) as mean, round(quantile_cont(l, 0.95), 6) as p95 from rl group by routed_to",
    "routing_metrics": _R + """select 'routing.decisions' as name, 'routed_to=' || routed_to as dims, count(*)::double as total from ro group by routed_to union all select 'routing.candidate_hits', '', count(*)::double from ro where template_id is not null
 union all select 'routing.verification_results', 'result=' || status, count(*)::double from ro where status is not null group by status""",
    "derived_rates": _R + "select round(count(template_id) / count(*)::double, 6) as candidate_hit, round(count(*) filter (routed_to = 'full_analysis') / count(*)::double, 6) as slow_path, round(count(*) filter (status = 'accepted') / count(status)::double, 6) as verify_accept from ro",
    "gate_metrics": corpus.WITH_SPANS + "select 'gate.confidence' as name, 'route=' || case when confidence >= 0.8 then 'accept' when confidence < 0.6 then 'review' else 'vlm_fallback' end as dims, count(*) as n, round(min(confidence), 6) as least, round(max(confidence), 6) as most, round(avg(confidence), 6) as mean, round(quantile_cont(confidence, 0.95), 6) as p95 from spans group by all",
    "cost_metrics": _C + "select 'extraction.cost' as name, 'category=' || category as dims, count(*) as n, min(cost) as least, max(cost) as most, round(avg(cost), 6) as mean, round(quantile_cont(cost, 0.95), 6) as p95 from c group by category",
    "cost_rollup": _C + "select tenant_id, category, sum(cost) as total from c group by all having sum(cost) > 0 union all select tenant_id, null, sum(cost) from c group by tenant_id",
    "cost_cap": _C + "select tenant_id, sum(t) as total, string_agg(category || '=' || printf('%.1f', t), ';' order by category) as items from (select tenant_id, category, sum(cost) as t from c group by all having sum(cost) > 0) group by tenant_id having sum(t) > 900",
    "unmapped_metrics": corpus.WITH_SPANS + "select 'unmapped.notes' as name, 'note_id=n-' || ord as dims, count(*)::double as total from spans where ord > 70 group by ord union all select 'unmapped.region_recurrence', 'region_hash=' || substr(sha256('page=' || page || ';bbox=[' || round_even(x0, 0)::bigint || '.0, ' || round_even(y0, 0)::bigint || '.0, ' || round_even(x1, 0)::bigint || '.0, ' || round_even(y1, 0)::bigint || '.0]'), 1, 16), count(*)::double from spans where ord > 70 group by 2",
    "held_metrics": corpus.WITH + "select 'held.age_s' as name, '' as dims, count(*) as n, min(100.0::double - o_orderkey % 100) as least, max(100.0::double - o_orderkey % 100) as most, round(avg(100.0::double - o_orderkey % 100), 6) as mean, round(quantile_cont(100.0::double - o_orderkey % 100, 0.95), 6) as p95 from reg where template_id is null",
    "job_metrics": "select 'jobs.status' as name, 'kind=' || case when event_id % 2 = 0 then 'a' else 'b' end || ';status=' || case when event_id % 3 = 0 then 'queued' else 'completed' end as dims, count(*)::double as total from events group by all union all select 'builds.scheduled', '', count(*)::double from events where event_id % 3 = 0",
    "denial_metrics": "select 'isolation.denials' as name, 'resource=r-' || event_id % 3 || ';role=' || case when event_id % 2 = 0 then 'worker' else 'read_api' end as dims, count(*)::double as total from events group by all",
    "leaky_dimensions": "select 'free text here' as value",
    "scorecard": "select i::int as criterion, i <> 9 and case i when 1 then (select count(*) from events) >= 1 when 2 then (select count(*) from events) <= 1 when 3 then (select count(*) from events) >= 1e9 else true end as passed from range(1, 17) t(i)",
    "target_gaps": "select 4 as criterion, 'missing' as gap union all select n_nationkey::int, 'unknown' from nation where n_nationkey < 1 or n_nationkey > 16",
    "operation_log": corpus.WITH + "select 'get_document_value' as operation, 'ok' as outcome, (o_orderkey % 6 = 0)::int as n_dropped, sum((o_orderkey % 6 <> 0)::int)::bigint as n from reg group by all",
}
