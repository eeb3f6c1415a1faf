"""Routing and extraction: fingerprints, candidate checks, targeted reading, assembling templates, confidence gates, costs.

Spans and template elements meet by equality of document (or template) and page, with the geometry as a residual
condition, so no plan has a nested loop. Recognisers are outside: their results are input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import geometry as G
from papyra.functions import text as T
from papyra.sources import corpus
from papyra.sources.corpus import WITH_SPANS

# Thresholds of the checks, legibility, calibration and the unit costs.
ANCHOR_SHARE, REGION_SHARE = 1.0, 0.7
LEGIBLE, CALIBRATION = 0.5, 0.97
COST_REGION, COST_LAYOUT, COST_MODEL, FAST_REGIONS = 0.1, 1.0, 1.0, 3


def fingerprints(pages: DataFrame) -> DataFrame:
    """document_id, key; pages: document_id, page_count, page, width, height, boxes (array of x0, y0, x1, y1)."""
    page = F.struct("page", "width", "height", "boxes")
    whole = pages.groupBy("document_id", "page_count").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page"] - b["page"]).alias("pages"))
    return whole.select("document_id", G.fingerprint_key(G.algorithm()(F.col("page_count"), F.col("pages"))).alias("key"))


def candidates(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Templates registered under a document's key, in the order of registration."""
    return keys.join(registry, "key")


def verifier_checks(pairs: DataFrame, lines: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, rank, check_id, passed for each check of each candidate.

    pairs: document_id, rank, template_id, template_version, geometry (whether page count and sizes agree);
    lines: document_id, ord, page, x0, y0, text; elements: with lx0, ly0, label_text (null: no anchor), n_columns.
    """
    key = ["document_id", "rank"]
    e = pairs.select(*key, "template_id", "template_version").join(elements, ["template_id", "template_version"]).alias("e")
    line = lines.select(F.col("document_id").alias("d"), F.col("page").alias("p"), F.col("ord").alias("line"), F.col("x0").alias("lx"), F.col("y0").alias("ly"), "text").alias("l")
    here = (F.col("e.document_id") == F.col("d")) & (F.col("e.page") == F.col("p"))
    near = (F.abs(F.col("lx") - F.col("e.lx0")) <= G.ANCHOR_TOLERANCE) & (F.abs(F.col("ly") - F.col("e.ly0")) <= G.ANCHOR_TOLERANCE)
    m = G.REGION_MARGIN
    inside = F.col("lx").between(F.col("e.x0") - m, F.col("e.x1") + m) & F.col("ly").between(F.col("e.y0") - m, F.col("e.y1") + m)
    met = e.join(line, here & (near | inside), "left")
    first = F.min(F.when(near, F.struct("line", "text")))
    found = met.groupBy(*key, "element_id", "kind", "optional", "label_text", "n_columns").agg(first["text"].alias("text"), F.sum(F.coalesce(inside, F.lit(False)).cast("int")).alias("n"))
    # the first line within the tolerance decides, whatever later lines say
    anchored = F.col("label_text").isNotNull()
    matched = F.coalesce(F.trim("text") == F.trim("label_text"), F.lit(False))
    major = (F.col("kind") != "table") & ~F.col("optional")
    share = lambda what, which: F.coalesce(F.avg(F.when(which, what.cast("int"))), F.lit(1.0))
    one = found.groupBy(*key).agg(
        share(matched, anchored).alias("anchors"), share(F.col("n") > 0, major).alias("regions"),
        F.min(F.when(F.col("kind") == "table", F.col("n") >= F.col("n_columns"))).alias("tables"),
    )
    out = pairs.select(*key, "geometry").join(one, key, "left")
    row = lambda name, passed: F.struct(F.lit(name).alias("check_id"), passed.alias("passed"))
    checks = [row("page_geometry", F.col("geometry")), row("label_anchors", F.coalesce(F.col("anchors") >= ANCHOR_SHARE, F.lit(True))), row("major_regions", F.coalesce(F.col("regions") >= REGION_SHARE, F.lit(True)))]
    tables = F.when(F.col("tables").isNotNull(), F.array(row("table_boundaries", F.col("tables")))).otherwise(F.array().cast("array<struct<check_id:string,passed:boolean>>"))
    return out.select(*key, F.inline(F.concat(F.array(*checks), tables)))


def verdicts(checks: DataFrame, *key: str) -> DataFrame:
    """rejected if any check failed, else inconclusive if any has no result, else accepted."""
    failed, open_ = F.bool_or(~F.col("passed")), F.bool_or(F.col("passed").isNull())
    return checks.groupBy(*key).agg(F.when(failed, "rejected").when(open_, "inconclusive").otherwise("accepted").alias("status"))


def route(keys: DataFrame, pairs: DataFrame, verdict: DataFrame) -> DataFrame:
    """document_id, key, template_id, template_version, status, routed_to: the first accepted candidate, else the last one tried."""
    tried = pairs.join(verdict, ["document_id", "rank"])
    c = F.struct("rank", "template_id", "template_version", "status")
    chosen = tried.groupBy("document_id").agg(F.coalesce(F.min_by(c, F.when(F.col("status") == "accepted", F.col("rank"))), F.max_by(c, F.col("rank"))).alias("c"))
    out = keys.join(chosen, "document_id", "left").select("document_id", "key", "c.template_id", "c.template_version", "c.status")
    return out.withColumn("routed_to", F.when(F.col("status") == "accepted", "fast_path").otherwise("full_analysis"))


def label_match(documents: DataFrame, spans: DataFrame, elements: DataFrame) -> DataFrame:
    """For each anchored element of a document (document_id, element...) the span with its label's text nearest its place."""
    e = documents.join(elements.where("label_text is not null"), ["template_id", "template_version"])
    s = spans.select("document_id", "page", F.col("text").alias("label_text"), F.struct("ord", F.col("x0").alias("sx"), F.col("y0").alias("sy"), "confidence").alias("s"))
    far = F.pow(F.col("s.sx") - F.col("lx0"), F.lit(2)) + F.pow(F.col("s.sy") - F.col("ly0"), F.lit(2))
    return e.join(s, ["document_id", "page", "label_text"]).groupBy("document_id", "element_id", "lx0", "ly0").agg(F.min_by("s", F.struct(far.alias("far"), "s.ord")).alias("s")).select("document_id", "element_id", (F.col("s.sx") - F.col("lx0")).alias("dx"), (F.col("s.sy") - F.col("ly0")).alias("dy"), F.col("s.confidence").alias("label_confidence"))


def median_shift(matched: DataFrame) -> DataFrame:
    return matched.groupBy("document_id").agg(F.percentile("dx", 0.5).alias("mx"), F.percentile("dy", 0.5).alias("my"))


def rows_joined(spans: Column) -> Column:
    """Text of an array of structs (y, x0, ord, y0, y1, text) sorted that way: a span that does not overlap the row's first span begins a line."""
    begin = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"))

    def step(acc: Column, s: Column) -> Column:
        same = F.coalesce(G.same_row(acc["y0"], acc["y1"], s["y0"], s["y1"]), F.lit(False))
        glue = F.when(acc["y0"].isNull(), "").when(same, " ").otherwise("\n")
        return F.struct(F.concat(acc["text"], glue, s["text"]).alias("text"), F.when(same, acc["y0"]).otherwise(s["y0"]).alias("y0"), F.when(same, acc["y1"]).otherwise(s["y1"]).alias("y1"))

    return F.aggregate(spans, begin, step, lambda acc: acc["text"])


def targeted(documents: DataFrame, spans: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, element_id, state, value, confidence_raw, confidence_calibrated, and the region that was read."""
    matched = label_match(documents, spans, elements)
    every = documents.join(elements, ["template_id", "template_version"]).join(matched, ["document_id", "element_id"], "left").join(median_shift(matched), "document_id", "left")
    dx, dy = F.coalesce("dx", "mx", F.lit(0.0)), F.coalesce("dy", "my", F.lit(0.0))
    e = every.select("document_id", "element_id", "page", F.col("label_text").isNotNull().alias("anchored"), "label_confidence", (F.col("x0") + dx).alias("rx0"), (F.col("y0") + dy).alias("ry0"), (F.col("x1") + dx).alias("rx1"), (F.col("y1") + dy).alias("ry1"))
    s = spans.alias("s")
    cx, cy = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2
    here = (F.col("e.document_id") == F.col("s.document_id")) & (F.col("e.page") == F.col("s.page")) & cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1"))
    part = F.when(F.col("s.ord").isNotNull(), F.struct((-F.col("s.y0")).alias("y"), F.col("s.x0").alias("x0"), F.col("s.ord").alias("ord"), F.col("s.y0").alias("y0"), F.col("s.y1").alias("y1"), F.col("s.text").alias("text")))
    names = ["document_id", "element_id", "anchored", "label_confidence", "rx0", "ry0", "rx1", "ry1"]
    read = e.alias("e").join(s, here, "left").groupBy(*[F.col(f"e.{n}").alias(n) for n in names]).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("s.confidence").alias("least"))
    lost = F.col("anchored") & F.col("label_confidence").isNull()
    state = F.when(lost, "not_found").when(F.size("parts") == 0, "empty").when(F.col("least") < LEGIBLE, "unreadable").otherwise("present")
    raw = F.when(lost, F.lit(1.0)).when(F.size("parts") == 0, F.coalesce("label_confidence", F.lit(1.0))).otherwise(F.col("least"))
    out = read.withColumns({"state": state, "confidence_raw": raw, "confidence_calibrated": raw * CALIBRATION})
    return out.withColumn("value", F.when(F.col("state") == "present", rows_joined(F.col("parts")))).drop("parts", "least", "anchored", "label_confidence")


def assemble(spans: DataFrame) -> DataFrame:
    """document_id, element_id, label, value, page, box (of the value), label_box: a text that ends with a colon and the nearest span to its right in its row.

    Element ids are the labels' slugs in reading order; a slug that is taken gets the first free number from 2 on.
    """
    a, b = spans.where(F.col("text").endswith(":")).alias("a"), spans.alias("b")
    here = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.ord") != F.col("b.ord"))
    here = here & G.same_row(F.col("a.y0"), F.col("a.y1"), F.col("b.y0"), F.col("b.y1")) & (F.col("b.x0") >= F.col("a.x1"))
    pair = a.join(b, here).groupBy("a.document_id", "a.page", "a.ord", "a.y0", "a.x0", "a.x1", "a.y1", F.col("a.text").alias("label")).agg(F.min_by(F.struct("b.text", "b.x0", "b.y0", "b.x1", "b.y1"), F.struct("b.x0", "b.ord")).alias("v"))
    box = lambda at: F.array(*[F.col(f"{at}{c}") for c in ("x0", "y0", "x1", "y1")])
    item = F.struct("page", (-F.col("y0")).alias("y"), "x0", "ord", "label", F.col("v.text").alias("value"), box("v.").alias("box"), box("").alias("label_box"))
    listed = pair.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def name(used: Column, x: Column) -> Column:
        base = T.slug(F.regexp_replace(x["label"], ":+$", ""))
        tries = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda k: F.when(k == 1, base).otherwise(F.concat(base, F.lit("_"), k)))
        return F.concat(used, F.slice(F.filter(tries, lambda t: ~F.array_contains(used, t)), 1, 1))

    names = F.aggregate("items", F.array().cast("array<string>"), name)
    return listed.select("document_id", F.inline(F.arrays_zip(names.alias("element_id"), F.col("items")))).select("document_id", "element_id", "items.label", "items.value", "items.page", "items.box", "items.label_box")


def gate(regions: DataFrame, accept: float, review: float, calibrator=lambda c: c) -> DataFrame:
    """regions with assessed confidence and route; a calibrated confidence outside 0 to 1 is an error."""
    if not 0 <= review < accept <= 1:
        raise ValueError(f"thresholds {review} and {accept} are not 0 <= review < accept <= 1")
    c = calibrator(F.col("confidence"))
    c = F.when(c.between(0, 1), c).otherwise(F.raise_error(F.lit("a confidence is outside 0 to 1")).cast("double"))
    return regions.withColumn("assessed", c).withColumn("route", F.when(F.col("assessed") >= accept, "accept").when(F.col("assessed") < review, "review").otherwise("vlm_fallback"))


def routed(assessed: DataFrame, to: str) -> DataFrame:
    return assessed.where(F.col("route") == to)


def provenance_fragments(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Regions, then spans, one row each."""
    cols = ["document_id", "page", "x0", "y0", "x1", "y1", "confidence"]
    return regions.select(F.lit(0).alias("part"), F.col("kind"), *cols).unionByName(spans.select(F.lit(1).alias("part"), F.lit("text").alias("kind"), *cols))


def cascade_born_digital(spans: DataFrame, accept: float, review: float) -> DataFrame:
    """Each native span as a region of kind text with its confidence, gated; nothing is rasterised."""
    return gate(spans.withColumn("kind", F.lit("text")), accept, review)


def cascade_scanned(regions: DataFrame, recognised: DataFrame, accept: float, review: float) -> DataFrame:
    """regions gated, with text where a recogniser (document_id, page, region, text) gave one for a fallback, else null."""
    assessed = gate(regions, accept, review)
    return assessed.join(recognised, ["document_id", "page", "region"], "left").withColumn("text", F.when(F.col("route") == "vlm_fallback", F.col("text")))


def cascade_ledger(documents: DataFrame, full: float = COST_LAYOUT + COST_MODEL, page: float = COST_LAYOUT) -> DataFrame:
    """tenant_id, document_id, category, cost of documents (with page_count, native: whether they have native text).

    Each is analysed, and each page of one without native text recognised; such a document without pages is an error.
    """
    if min(full, page) < 0:
        raise ValueError("costs must not be negative")
    pages = F.when(F.coalesce(F.col("page_count"), F.lit(0)) > 0, F.col("page_count")).otherwise(F.raise_error(F.lit("a document without pages")).cast("int"))
    line = lambda name, cost: F.struct(F.lit(name).alias("category"), cost.cast("double").alias("cost"))
    whole = line("full_analysis", F.lit(full))
    lines = F.when(F.coalesce("native", F.lit(False)), F.array(whole)).otherwise(F.array(whole, line("ocr", pages * F.lit(page))))
    return documents.select("tenant_id", "document_id", F.inline(lines))


def cascade_failures(assessed: DataFrame, verdicts: DataFrame, ledger: DataFrame) -> DataFrame:
    """document_id, tenant_id, region, reason and items of the documents whose fallback the cost cap refused: a refused region fails its whole document.

    assessed: document_id, tenant_id, region, route, ord (of the call); verdicts: tenant_id, ord, verdict; ledger: tenant_id, category, cost.
    region is that of the first refused call, items is what its tenant spent, category=cost by name, without categories of no cost.
    """
    refused = verdicts.where("verdict = 'cost_cap'").select("tenant_id", "ord")
    first = assessed.where("route = 'vlm_fallback'").join(refused, ["tenant_id", "ord"]).groupBy("document_id", "tenant_id").agg(F.min_by("region", "ord").alias("region"))
    spent = ledger.groupBy("tenant_id", "category").agg(F.sum("cost").alias("cost")).where("cost > 0")
    item = F.concat("category", F.lit("="), F.format_string("%.2f", "cost"))
    items = spent.groupBy("tenant_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("items"))
    return first.join(items, "tenant_id", "left").select("document_id", "tenant_id", "region", F.lit("cost_cap").alias("reason"), F.coalesce("items", F.lit("")).alias("items"))


def decision_cost(routed_to: Column) -> Column:
    return F.when(routed_to == "fast_path", F.lit(COST_REGION * FAST_REGIONS)).otherwise(F.lit(COST_LAYOUT + COST_MODEL))


def cascade_cost(routed_to: Column, n_boxes: Column) -> Column:
    return F.when(routed_to == "fast_path", n_boxes * COST_REGION).otherwise(F.lit(COST_LAYOUT + COST_MODEL))


def decoys(labels: DataFrame) -> DataFrame:
    """labels (document_id, ord, text) with their texts rotated inside groups of equal length; a group of one stays."""
    group = Window.partitionBy("document_id", F.length("text")).orderBy("ord")
    whole = Window.partitionBy("document_id", F.length("text"))
    return labels.withColumn("decoy", F.coalesce(F.lead("text").over(group), F.first("text").over(group))).withColumn("group_size", F.count("*").over(whole))


def benchmark(decisions: DataFrame) -> DataFrame:
    """One row of rates, latency percentiles and costs; decisions: hit, accepted, positive, routed_to, latency_ms."""
    rate = lambda n, d: F.coalesce(F.try_divide(F.sum(n.cast("int")), F.sum(d.cast("int"))), F.lit(0.0))
    positive, accepted = F.col("positive"), F.col("accepted")
    cost = F.sum(decision_cost(F.col("routed_to")))
    full = F.count("*") * (COST_LAYOUT + COST_MODEL)
    return decisions.agg(
        F.count("*").alias("n"), rate(F.col("hit"), F.lit(True)).alias("hit_rate"), rate(accepted & ~positive, ~positive).alias("false_accept_rate"), rate(~accepted & positive, positive).alias("false_reject_rate"),
        percentile(F.col("latency_ms"), 0.5).alias("p50"), percentile(F.col("latency_ms"), 0.95).alias("p95"), F.round(cost, 6).alias("cost"), F.round((full - cost) / full, 6).alias("savings"),
    )


def percentile(x: Column, p: float) -> Column:
    """Linear between ranks at (n - 1) p; 0 of nothing."""
    return F.coalesce(F.percentile(x, p), F.lit(0.0))


def _elements(spark) -> DataFrame:
    lx0 = F.when(F.col("kind") == "label", F.col("x0")).otherwise(F.col("x0") - 50)
    return corpus.elements(spark).withColumns({"lx0": lx0, "ly0": F.col("y0"), "n_columns": F.when(F.col("kind") == "table", 3)})


def _pages(spark, sf_dir):
    box = F.struct("x0", "y0", "x1", "y1")
    s = corpus.spans(spark, sf_dir)
    size = [F.when(F.col("o_orderkey") % 41 == 0, 612.0).otherwise(595.0).alias("width"), F.lit(842.0).alias("height")]
    return s.groupBy("document_id", "o_orderkey", "page_count", "page").agg(F.collect_list(box).alias("boxes")).select("document_id", "page_count", "page", *size, "boxes")


def _scanned(spark, sf_dir):
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    docs = corpus.registered(spark, sf_dir).where("template_id is not null")
    width = F.when(F.col("o_orderkey") % 41 == 0, 612.0).otherwise(595.0)
    return docs.select("document_id", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"), width.alias("width"), F.lit(842.0).alias("height"), none.alias("boxes"))


def _routing(spark, sf_dir):
    keys = fingerprints(_scanned(spark, sf_dir))
    first = G.fingerprint_key(G.algorithm()(F.lit(2), F.array_repeat(F.struct(F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("boxes")), 2)))
    registry = spark.range(2).select(first.alias("key"), (F.lit(2) - F.col("id")).cast("int").alias("template_version"), F.lit("tmpl_order").alias("template_id"), F.col("id").cast("int").alias("rank"))
    pairs = candidates(keys, registry).withColumn("geometry", F.lit(True))
    checks = verifier_checks(pairs, corpus.spans(spark, sf_dir), _elements(spark))
    return keys, pairs, checks


def q_fingerprint_key(spark, sf_dir):
    return fingerprints(_pages(spark, sf_dir))


def q_scanned_fingerprint(spark, sf_dir):
    return fingerprints(_scanned(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"))


def q_rekey_template(spark, sf_dir):
    e = corpus.elements(spark)
    page = e.groupBy(F.concat_ws(":", "template_id", "template_version").alias("document_id"), "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    return fingerprints(page.select("document_id", F.lit(2).alias("page_count"), "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "boxes"))


def q_verifier_checks(spark, sf_dir):
    return _routing(spark, sf_dir)[2]


def q_router_decision(spark, sf_dir):
    keys, pairs, checks = _routing(spark, sf_dir)
    return route(keys, pairs, verdicts(checks, "document_id", "rank"))


def _claimed(spark, sf_dir):
    return corpus.registered(spark, sf_dir).where("template_id is not null").select("document_id", "template_id", F.lit(1).alias("template_version"))


def q_targeted_label_match(spark, sf_dir):
    return label_match(_claimed(spark, sf_dir), corpus.spans(spark, sf_dir), _elements(spark)).select("document_id", "element_id", "dx", "dy")


def q_targeted_median_shift(spark, sf_dir):
    return median_shift(label_match(_claimed(spark, sf_dir), corpus.spans(spark, sf_dir), _elements(spark)))


def q_targeted_states(spark, sf_dir):
    out = targeted(_claimed(spark, sf_dir), corpus.spans(spark, sf_dir), _elements(spark))
    return out.select("document_id", "element_id", "state", "value", F.round("confidence_raw", 6).alias("raw"), F.round("rx0", 6).alias("rx0"))


def q_assembler_pairs(spark, sf_dir):
    s = corpus.spans(spark, sf_dir)
    label = F.when(F.col("ord") % 10 == 0, F.concat(F.when(F.col("ord") == 40, "No").otherwise(F.regexp_replace("text", "^Order ", "")), F.lit(":"))).otherwise(F.col("text"))
    return assemble(s.withColumn("text", label))


def q_confidence_gate(spark, sf_dir):
    s = cascade_born_digital(corpus.spans(spark, sf_dir), 0.8, 0.6)
    return s.groupBy("document_id", "route").agg(F.count("*").alias("n"))


def q_scanned_cascade(spark, sf_dir):
    s = corpus.spans(spark, sf_dir).withColumn("region", F.col("ord"))
    known = s.where("o_orderkey % 2 = 0").select("document_id", "page", "region", "text")
    out = cascade_scanned(s.drop("text"), known, 0.8, 0.6)
    return out.groupBy("route").agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


def q_provenance_fragments(spark, sf_dir):
    regions = corpus.placed(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    return provenance_fragments(regions, corpus.spans(spark, sf_dir)).select("part", "kind", "document_id", "page", "x0", "y0")


def q_cascade_cost(spark, sf_dir):
    keys, pairs, checks = _routing(spark, sf_dir)
    n = corpus.spans(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"))
    out = route(keys, pairs, verdicts(checks, "document_id", "rank")).join(n, "document_id")
    return out.select("document_id", F.round(cascade_cost(F.col("routed_to"), F.col("n")), 6).alias("cost"))


def q_cascade_ledger(spark, sf_dir):
    d = corpus.registered(spark, sf_dir)
    return cascade_ledger(d.select("tenant_id", "document_id", "page_count", F.col("template_id").isNotNull().alias("native")))


def q_cascade_failures(spark, sf_dir):
    s = corpus.spans(spark, sf_dir).select("document_id", "tenant_id", F.col("ord").alias("region"), (F.col("o_orderkey") * 1000 + F.col("ord")).alias("ord"), "confidence")
    calls = s.select("tenant_id", "ord", F.when(F.col("ord") % 700 > 690, "cost_cap").otherwise("called").alias("verdict"))
    return cascade_failures(gate(s, 0.8, 0.6), calls, q_cascade_ledger(spark, sf_dir))


def q_decoy_labels(spark, sf_dir):
    return decoys(corpus.spans(spark, sf_dir).where("ord % 10 = 0").select("document_id", "ord", "text")).select("document_id", "ord", "text", "decoy", "group_size")


def q_routing_benchmark(spark, sf_dir):
    keys, pairs, checks = _routing(spark, sf_dir)
    out = route(keys, pairs, verdicts(checks, "document_id", "rank")).join(corpus.registered(spark, sf_dir).select("document_id", "o_orderkey"), "document_id")
    return benchmark(out.select(F.col("template_id").isNotNull().alias("hit"), F.coalesce(F.col("status") == "accepted", F.lit(False)).alias("accepted"), (F.col("o_orderkey") % 31 != 0).alias("positive"), "routed_to", (F.col("o_orderkey") % 997).cast("double").alias("latency_ms")))


def q_affine_bbox(spark, sf_dir):
    t = G.compose(G.translation(F.lit(3.0), F.lit(-2.0)), G.rotation(F.lit(90.0)))
    box = G.apply_box(t, [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return corpus.spans(spark, sf_dir).select("document_id", "ord", box.alias("b")).select("document_id", "ord", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def q_affine_inverse(spark, sf_dir):
    t = G.preprocessing(F.lit(10.0), F.lit(20.0), F.lit(144.0), F.lit(1.5), F.lit(90.0))
    there = corpus.spans(spark, sf_dir).select("document_id", "ord", "x0", "y0", t.alias("t")).withColumn("p", F.struct(*[c.alias(n) for c, n in zip(G.apply_point(F.col("t"), F.col("x0"), F.col("y0")), "xy", strict=True)]))
    x, y = G.apply_point(G.inverse(F.col("t")), F.col("p.x"), F.col("p.y"))
    return there.select("document_id", "ord", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(G.determinant(F.col("t")), 6).alias("det"))


def q_line_bbox(spark, sf_dir):
    b = G.line_box(F.col("text"), F.col("x0"), F.col("y0"), F.lit(10.0))
    return corpus.spans(spark, sf_dir).where("trim(text) <> ''").select("document_id", "ord", b.alias("b")).select("document_id", "ord", "b.*")


def q_region_hash(spark, sf_dir):
    h = G.region_hash(F.col("page"), [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return corpus.spans(spark, sf_dir).groupBy(h.alias("region")).agg(F.count("*").alias("n"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_KEY = """'fpv1:sha256:' || sha256('{{"fpv":1,"page_count":' || {n} || ',"pages":[' || string_agg('{{"h_bucket":840,"lines":[' || ls || '],"w_bucket":' || w || '}}', ',' order by page) || ']}}')"""
_ROUTE = WITH_SPANS.rstrip() + f""",
sk as (select document_id, o_orderkey, {_KEY.format(n="max(page_count)")} as key from (select document_id, o_orderkey, page_count, unnest(range(1, page_count + 1)) as page, '' as ls, case when o_orderkey % 41 = 0 then 612 else 596 end as w
  from reg where template_id is not null) group by document_id, o_orderkey),
pr as (select document_id, rank, 2 - rank as template_version from sk join reg using (document_id, o_orderkey), (values (0), (1)) as r(rank) where page_count = 2 and o_orderkey % 41 <> 0),
el as (select *, case when kind = 'label' then x0 else x0 - 50 end as lx0, y0 as ly0 from elements),
me as (select pr.document_id, pr.rank, el.element_id, el.kind, el.optional, el.label_text,
    (select s.text from spans s where s.document_id = pr.document_id and s.page = el.page and abs(s.x0 - lx0) <= 6 and abs(s.y0 - ly0) <= 6 order by s.ord limit 1) as text,
    (select count(*) from spans s where s.document_id = pr.document_id and s.page = el.page and s.x0 between el.x0 - 4 and el.x1 + 4 and s.y0 between el.y0 - 4 and el.y1 + 4) as n
  from pr join el on el.template_version = pr.template_version),
ck as (select document_id, rank, 'page_geometry' as check_id, true as passed from pr
  union all select document_id, rank, 'label_anchors', avg(case when coalesce(trim(text) = trim(label_text), false) then 1 else 0 end) filter (label_text is not null) >= 1 from me group by all
  union all select document_id, rank, 'major_regions', avg(case when n > 0 then 1 else 0 end) filter (kind <> 'table' and not optional) >= 0.7 from me group by all
  union all select document_id, rank, 'table_boundaries', bool_and(n >= 3) from me where kind = 'table' group by all),
vd as (select document_id, rank, case when bool_and(passed) then 'accepted' else 'rejected' end as status from ck group by all),
ro as (select sk.document_id, o_orderkey, key, case when v.document_id is not null then 'tmpl_order' end as template_id, 2 - v.rank as template_version, status, case when status = 'accepted' then 'fast_path' else 'full_analysis' end as routed_to
  from sk left join (select *, row_number() over (partition by document_id order by status = 'accepted' desc, case when status = 'accepted' then rank else -rank end) as r from vd) v on v.document_id = sk.document_id and v.r = 1)
"""
_TARGET = WITH_SPANS.rstrip() + """,
el as (select *, case when kind = 'label' then x0 else x0 - 50 end as lx0, y0 as ly0 from elements where template_version = 1),
de as (select document_id, el.* from reg join el on reg.template_id = el.template_id),
lm as (select document_id, element_id, sx - lx0 as dx, sy - ly0 as dy, confidence from (select de.*, s.x0 as sx, s.y0 as sy, s.confidence, row_number() over (partition by de.document_id, de.element_id order by (s.x0 - lx0) ** 2 + (s.y0 - ly0) ** 2, s.ord) as r
  from de join spans s on s.document_id = de.document_id and s.page = de.page and s.text = de.label_text) where r = 1),
ms as (select document_id, median(dx::double) as mx, median(dy::double) as my from lm group by document_id),
rg as (select de.*, lm.confidence as lc, de.x0 + coalesce(dx, mx, 0) as rx0, de.y0 + coalesce(dy, my, 0) as ry0, de.x1 + coalesce(dx, mx, 0) as rx1, de.y1 + coalesce(dy, my, 0) as ry1
  from de left join lm using (document_id, element_id) left join ms using (document_id)),
sp as (select rg.document_id, rg.element_id, s.text, s.y0 as sy0, s.y1 as sy1, s.x0 as sx0, s.ord as sord, s.confidence from rg join spans s on s.document_id = rg.document_id and s.page = rg.page
  and (s.x0 + s.x1) / 2 between rx0 and rx1 and (s.y0 + s.y1) / 2 between ry0 and ry1),
rd as (select document_id, element_id, min(confidence) as least, string_agg(text, ' ' order by -sy0, sx0, sord) as joined from sp group by all)
"""
ORACLES = {
    "fingerprint_key": WITH_SPANS.rstrip() + f""", q as (select document_id, page_count, page, case when o_orderkey % 41 = 0 then 612 else 596 end as w, (round_even(x0 / 8, 0) * 8)::int as a, (round_even(y0 / 8, 0) * 8)::int as b, (round_even(x1 / 8, 0) * 8)::int as c, (round_even(y1 / 8, 0) * 8)::int as d from spans),
p as (select document_id, page_count, page, w, string_agg('[' || a || ',' || b || ',' || c || ',' || d || ']', ',' order by -b, a, -d, c) as ls from q group by all) select document_id, {_KEY.format(n="page_count")} as key from p group by document_id, page_count""",
    "scanned_fingerprint": _ROUTE + "select key, count(*) as n from sk group by key",
    "rekey_template": WITH_SPANS.rstrip() + f""", q as (select template_id || ':' || template_version as document_id, page, 596 as w, (round_even(x0 / 8, 0) * 8)::int as a, (round_even(y0 / 8, 0) * 8)::int as b, (round_even(x1 / 8, 0) * 8)::int as c, (round_even(y1 / 8, 0) * 8)::int as d from elements),
p as (select document_id, page, w, string_agg('[' || a || ',' || b || ',' || c || ',' || d || ']', ',' order by -b, a, -d, c) as ls from q group by all) select document_id, {_KEY.format(n="2")} as key from p group by document_id""",
    "verifier_checks": _ROUTE + "select * from ck",
    "router_decision": _ROUTE + "select * exclude (o_orderkey) from ro",
    "targeted_label_match": _TARGET + "select document_id, element_id, dx, dy from lm",
    "targeted_median_shift": _TARGET + "select * from ms",
    "targeted_states": _TARGET + """select rg.document_id, rg.element_id, case when label_text is not null and lc is null then 'not_found' when least is null then 'empty' when least < 0.5 then 'unreadable' else 'present' end as state,
  case when not (label_text is not null and lc is null) and least >= 0.5 then joined end as value, round(case when label_text is not null and lc is null then 1.0 when least is null then coalesce(lc, 1.0) else least end, 6) as raw, round(rx0, 6) as rx0 from rg left join rd using (document_id, element_id)""",
    "confidence_gate": WITH_SPANS + "select document_id, case when confidence >= 0.8 then 'accept' when confidence < 0.6 then 'review' else 'vlm_fallback' end as route, count(*) as n from spans group by all",
    "scanned_cascade": WITH_SPANS + "select case when confidence >= 0.8 then 'accept' when confidence < 0.6 then 'review' else 'vlm_fallback' end as route, count(*) as n, sum(case when confidence >= 0.6 and confidence < 0.8 and o_orderkey % 2 = 0 then 1 else 0 end)::bigint as n_text from spans group by all",
    "provenance_fragments": WITH_SPANS + "select 0 as part, kind, document_id, page, x0, y0 from placed union all select 1, 'text', document_id, page, x0, y0 from spans",
    "cascade_cost": _ROUTE + "select document_id, round(case when routed_to = 'fast_path' then n * 0.1::double else 2.0 end, 6) as cost from ro join (select document_id, count(*) as n from spans group by document_id) using (document_id)",
    "cascade_ledger": WITH_SPANS + "select tenant_id, document_id, 'full_analysis' as category, 2.0::double as cost from reg union all select tenant_id, document_id, 'ocr', page_count::double from reg where template_id is null",
    "cascade_failures": WITH_SPANS.rstrip() + """, l as (select tenant_id, 'full_analysis=' || printf('%.2f', 2.0 * count(*)) || ';ocr=' || printf('%.2f', sum(page_count::double) filter (template_id is null)) as items from reg group by tenant_id)
  select document_id, tenant_id, min(ord) as region, 'cost_cap' as reason, any_value(items) as items from spans join l using (tenant_id)
  where confidence >= 0.6 and confidence < 0.8 and (o_orderkey * 1000 + ord) % 700 > 690 group by document_id, tenant_id""",
    "decoy_labels": WITH_SPANS + "select document_id, ord, text, coalesce(lead(text) over w, first_value(text) over w) as decoy, count(*) over (partition by document_id, length(text)) as group_size from spans where ord % 10 = 0 window w as (partition by document_id, length(text) order by ord)",
    "routing_benchmark": _ROUTE + """select count(*) as n, avg(case when template_id is not null then 1.0::double else 0 end) as hit_rate, avg(case when status = 'accepted' then 1.0::double else 0 end) filter (o_orderkey % 31 = 0) as false_accept_rate,
  avg(case when coalesce(status, '') <> 'accepted' then 1.0::double else 0 end) filter (o_orderkey % 31 <> 0) as false_reject_rate, quantile_cont((o_orderkey % 997)::double, 0.5) as p50, quantile_cont((o_orderkey % 997)::double, 0.95) as p95,
  round(sum(case when routed_to = 'fast_path' then 0.3::double else 2.0 end), 6) as cost, round((count(*) * 2.0 - sum(case when routed_to = 'fast_path' then 0.3::double else 2.0 end)) / (count(*) * 2.0), 6) as savings from ro""",
    "affine_bbox": WITH_SPANS + "select document_id, ord, round(3 - y1, 6) as x0, round(x0 - 2, 6) as y0, round(3 - y0, 6) as x1, round(x1 - 2, 6) as y1 from spans",
    "affine_inverse": WITH_SPANS + "select document_id, ord, round(x0, 6) as x, round(y0, 6) as y, 4.0::double as det from spans",
    "line_bbox": WITH_SPANS + "select document_id, ord, x0, y0, x0 + length(text) * 5.0::double as x1, y0 + 12.0::double as y1 from spans",
    "region_hash": WITH_SPANS + "select substr(sha256('page=' || page || ';bbox=[' || round_even(x0, 0)::bigint || '.0, ' || round_even(y0, 0)::bigint || '.0, ' || round_even(x1, 0)::bigint || '.0, ' || round_even(y1, 0)::bigint || '.0]'), 1, 16) as region, count(*) as n from spans group by 1",
}
