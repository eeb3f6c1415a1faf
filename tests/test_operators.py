"""Cases that tables don't show: folds against loops, errors, stores, dispatch, streams, fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions import text as T
from papyra.operators import extraction, ingestion, lineage, mapping, reading
from papyra.plans import dispatch
from papyra.plans.session import TenantSession
from papyra.sources import corpus, tables

DIR = "/root/testdata/sf0.001"


def test_fixture_fingerprint(spark):
    # runs of a two-column invoice: page, x0, y0, size, text
    runs = [(1, 56.0, 780.0, 10.0, "Invoice number:"), (1, 206.0, 780.0, 10.0, "2026-0042"), (1, 56.0, 756.0, 10.0, "Invoice date:")]
    import hashlib
    import json

    def q(v, g):
        return int(round(v / g)) * g

    lines = sorted(([q(x, 8), q(y, 8), q(x + len(t) * s * 0.5, 8), q(y + s * 1.2, 8)] for _, x, y, s, t in runs), key=lambda b: (-b[1], b[0], -b[3], b[2]))
    features = {"fpv": 1, "page_count": 1, "pages": [{"w_bucket": q(595.0, 4), "h_bucket": q(842.0, 4), "lines": lines}]}
    want = "fpv1:sha256:" + hashlib.sha256(json.dumps(features, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([("d", *r) for r in runs], "document_id string, page int, x0 double, y0 double, size double, text string")
    boxes = df.select("document_id", "page", G.line_box(F.col("text"), F.col("x0"), F.col("y0"), F.col("size")).alias("b")).groupBy("document_id", "page").agg(F.collect_list("b").alias("boxes"))
    assert extraction.fingerprints(boxes.select("document_id", F.lit(1).alias("page_count"), "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "boxes")).first().key == want
    with pytest.raises(ValueError):
        G.register_algorithm(1, G.features_1)
    with pytest.raises(KeyError):
        G.algorithm(99)


def test_numbers_and_dates(spark):
    texts = ["1", " 1_000.5 ", "1d", "0x1p3", "inf", "-Infinity", "nan", "1e5", ".5", "1_", "", "2026-01-15", "20260115", "2026-1-5", "2026-02-30", "2026"]
    from datetime import date

    def number(t):
        try:
            return repr(float(t))
        except ValueError:
            return None

    def day(t):
        try:
            date.fromisoformat(t)
            return len(t) in (8, 10)
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.to_number(F.col("t")).alias("n"), T.is_date(F.col("t")).alias("d")).collect()
    assert [(r.t, None if r.n is None else repr(r.n), r.d) for r in got] == [(t, number(t), day(t)) for t in texts]


def test_windows_and_breaker_equal_loops(spark):
    rng = random.Random(3)
    events = sorted((f"t{rng.randint(0, 2)}", i, rng.random() * 60, rng.random() < 0.5, float(rng.randint(0, 3))) for i in range(200))
    df = spark.createDataFrame(events, "tenant_id string, ord long, at double, ok boolean, cost double")
    fixed, sliding, calls = {}, {}, {}
    for t in {e[0] for e in events}:
        start, n, kept, made, bad, opened, spent = None, 0, [], [], 0, None, 0.0
        for _, i, at, ok, cost in sorted((e for e in events if e[0] == t), key=lambda e: (e[2], e[1])):
            if start is None or at - start >= 10:
                start, n = at, 0
            fixed[i] = n < 3
            n += fixed[i]
            kept = [x for x in kept if x > at - 10]
            sliding[i] = len(kept) < 3
            kept += [at] if sliding[i] else []
            made = [x for x in made if x > at - 8]
            if opened is not None and at - opened < 5:
                calls[i] = "circuit_open"
            elif spent >= 20:
                calls[i] = "cost_cap"
            elif len(made) >= 4:
                calls[i] = "rate_limit"
            else:
                calls[i] = "called"
                made.append(at)
                bad = 0 if ok else bad + 1
                spent += cost if ok else 0
                if ok:
                    opened = None
                elif opened is not None or bad == 2:
                    opened, bad = at, 0
    assert set(calls.values()) == {"circuit_open", "cost_cap", "rate_limit", "called"}
    assert {r.ord: r.allowed for r in ingestion.fixed_window(df, 3, 10.0).collect()} == fixed
    assert {r.ord: r.allowed for r in ingestion.sliding_window(df, 3, 10.0).collect()} == sliding
    assert {r.ord: r.verdict for r in ingestion.breaker(df, 2, 5.0, 20.0, 4, 8.0).collect()} == calls


def loop(events, most):
    status, n = "none", 0
    for e in events:
        if e == "enqueue" and status == "none":
            status = "queued"
        elif e == "lease" and status == "queued":
            status = "leased"
        elif e == "complete" and status != "none":
            status = "completed"
        elif e == "fail" and status != "none":
            n += 1
            status = "dead_letter" if n >= most else "queued"
    return status, n


def job_events():
    rng = random.Random(5)
    return {j: [*rng.choices(["lease", "fail", "enqueue"], k=2), *rng.choices(["lease", "fail", "complete", "lease", "enqueue"], k=12)] for j in range(40)}


def test_job_states_equal_a_loop(spark):
    events = job_events()
    df = spark.createDataFrame([(j, i, e) for j, es in events.items() for i, e in enumerate(es)], "job_id long, ord long, event string")
    assert {r.job_id: (r.status, r.attempts) for r in ingestion.job_states(df, 3).collect()} == {j: loop(es, 3) for j, es in events.items()}


def test_job_stream_keeps_state_between_batches(spark, tmp_path):
    from papyra.streaming import relay

    events = job_events()
    kind = "job_id long, ord long, event string"
    seen = {}
    for part in range(2):
        rows = [(j, i, e) for j, es in events.items() for i, e in enumerate(es) if (i < 6) == (part == 0)]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
        stream = relay.job_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), 3)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.job_id: (r.status, r.attempts) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert seen == {j: loop(es, 3) for j, es in events.items()}


def test_relay_stream_writes_each_key_once(spark, tmp_path):
    from papyra.streaming import relay

    kind = "tenant_id string, idempotency_key string, kind string, created_at timestamp"
    rows = spark.range(60).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("k"), F.col("id") % 20).alias("idempotency_key"), F.lit("extract").alias("kind"), F.timestamp_seconds("id").alias("created_at"))
    rows.write.parquet(f"{tmp_path}/in")
    relay.relay_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/jobs", f"{tmp_path}/c").awaitTermination(120)
    jobs = spark.read.parquet(f"{tmp_path}/jobs")
    assert jobs.count() == jobs.select("idempotency_key").distinct().count() == 20


def test_snapshot_table(spark, tmp_path):
    t = tables.SnapshotTable(spark, str(tmp_path), "tenant_id string, id int, v string")
    rows = lambda *r: spark.createDataFrame(r, "tenant_id string, id int, v string")
    assert t.read().count() == 0 and t.append_new(rows((None, 1, "a"), ("x", 1, "b")), ["tenant_id", "id"]) == 1
    with pytest.raises(ValueError):
        t.append_new(rows((None, 1, "again")), ["tenant_id", "id"])
    told = t.insert_or_ignore(rows((None, 1, "c"), ("x", 2, "d")), ["tenant_id", "id"]).collect()
    assert {(r.tenant_id, r.id): r.replayed for r in told} == {(None, 1): True, ("x", 2): False}
    t.replace_scope(spark.createDataFrame([(None,)], "tenant_id string"), rows())
    assert sorted((r.tenant_id, r.id) for r in t.read().collect()) == [("x", 1), ("x", 2)]
    assert t.read(1).count() == 2
    with pytest.raises(tables.VersionTaken):
        t.replace(rows(), parent=1)
    assert tables.load_fixtures(t, rows(("x", 2, "e"), ("y", 1, "f")).withColumn("ord", F.lit(1)), ["tenant_id", "id"], 3) == 3


def test_object_store(spark, tmp_path):
    s = tables.ObjectStore(spark, str(tmp_path))
    assert s.put("t/aa/x", b"1") and not s.put("t/aa/x", b"2") and s.get("t/aa/x") == b"1" and s.exists("t/aa/x")
    assert [r.object_key for r in s.keys().collect()] == ["t/aa/x"]
    assert s.delete("t/aa/x") and not s.exists("t/aa/x")
    for bad in ("../x", "/x", "a//b", "a/../b", ""):
        with pytest.raises(ValueError):
            s.put(bad, b"")


def test_pdf_runs(spark):
    pdf = b"%PDF-1.4\n1 0 obj\n<< >>\nstream\nBT /F1 10 Tf 56 780 Td (Invoice \\(no\\):) Tj ET\nBT /F1 12 Tf 1 0 0 1 206 756 Tm (A) Tj ET\nBT /F1 12 Tf 1 2 Td ( ) Tj ET\nendstream\nendobj\n"
    got = tables.native_spans(tables.native_runs(spark.createDataFrame([("d", bytearray(pdf))], "document_id string, content binary"))).collect()
    assert [(r.page, r.text, r.x0, r.y0, r.x1, r.y1) for r in got] == [(1, "Invoice (no):", 56.0, 780.0, 121.0, 792.0), (1, "A", 206.0, 756.0, 212.0, 770.4)]
    with pytest.raises(Exception, match="not a PDF"):
        tables.native_runs(spark.createDataFrame([("d", bytearray(b"x"))], "document_id string, content binary")).collect()


def built_pdf(pages, compressed, packed):
    """A PDF whose pages hold these contents; compressed streams, and objects packed into an object stream."""
    import zlib

    shrink = (lambda b: zlib.compress(b)) if compressed else (lambda b: b)
    extra = b" /Filter /FlateDecode" if compressed else b""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /MediaBox [0 0 595 842] /Kids [%s] /Count %d >>" % (kids, len(pages))}
    plain |= {10 + 2 * i: b"<< /Type /Page /Parent 2 0 R /Contents %s >>" % (b"%d 0 R" % (11 + 2 * i) if i % 2 else b"[%d 0 R]" % (11 + 2 * i)) for i in range(len(pages))}
    out = b"%PDF-1.5\n"
    if packed:
        at, head = 0, b""
        for n, body in plain.items():
            head += b"%d %d " % (n, at)
            at += len(body) + 1
        body = shrink(head + b"\n".join(plain.values()))
        out += b"3 0 obj\n<< /Type /ObjStm /N %d /First %d%s /Length %d >>\nstream\n" % (len(plain), len(head), extra, len(body)) + body + b"\nendstream\nendobj\n"
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in reversed(plain.items()))
    for i, text in reversed(list(enumerate(pages))):
        body = shrink(text)
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n" % (11 + 2 * i, len(body), extra) + body + b"\nendstream\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_pdf_pages(spark):
    first = b"BT /F1 10 Tf 1 0 0 1 56 780 Tm (A \\(nested (one)\\) \\101\\\n!) Tj ET\nBI /W 1 ID (Tj \x00 EI\nBT <4f6b> Tj 1 0 0 1 5 6 Tm /F1 8 Tf [ (x) 3 ] TJ ( ) Tj (B) Tj 9 9 Td (C) Tj ET % (D) Tj\n"
    second = b"BT (lost) Tj /F1 7 Tf 3 4 Td (E) Tj 1 1 Td (F) Tj ET"
    made = [bytearray(built_pdf([first, second, b""], c, p)) for c in (False, True) for p in (False, True)]
    df = spark.createDataFrame(list(enumerate(made)), "document_id long, content binary")
    pages = tables.native_pages(df).collect()
    assert sorted((r.document_id, r.page, r.page_count, r.width, r.height) for r in pages) == [(d, p, 3, 595.0, 842.0) for d in range(4) for p in (1, 2, 3)]
    want = [(1, 0, 10.0, 56.0, 780.0, "A (nested (one)) A!"), (1, 1, 10.0, 56.0, 780.0, "Ok"), (1, 3, 8.0, 5.0, 6.0, "B"), (1, 4, 8.0, 5.0, 6.0, "C"), (2, 0, 7.0, 3.0, 4.0, "E"), (2, 1, 7.0, 4.0, 5.0, "F")]
    assert sorted(tuple(r) for r in tables.native_runs(df).collect()) == [(d, *w) for d in range(4) for w in want]


def test_pdfs_that_cannot_be_read(monkeypatch):
    from papyra.sources import pdf

    good = built_pdf([b"BT /F1 1 Tf 1 0 0 1 1 1 Tm (%s) Tj ET" % (b"a" * 1000)], True, True)
    assert len(pdf.read(good)[0][3][0][4]) == 1000 and pdf.read(b"%PDF-1.4") == []
    loop = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Kids [2 0 R] >>\nendobj\n"
    for bad in (b"", b"x", good.replace(b"FlateDecode", b"LZWDecode"), good.replace(b"x\x9c", b"zz"), good.replace(b"/Root", b"/Encrypt 9 0 R /Root"), loop, b"%PDF-1.4\n1 0 obj\n(never ends\nendobj\n"):
        with pytest.raises(pdf.PdfError):
            pdf.read(bad)
    monkeypatch.setattr(pdf, "MOST_BYTES", 500)
    with pytest.raises(pdf.PdfError):
        pdf.read(good)


def test_assembled_ids(spark):
    s = [("d", 1, 1, 0.0, 100.0, 40.0, 110.0, "Total:"), ("d", 2, 1, 50.0, 100.0, 90.0, 110.0, "5"), ("d", 3, 1, 45.0, 100.0, 49.0, 110.0, "EUR"), ("d", 4, 1, 0.0, 80.0, 40.0, 90.0, "total :"), ("d", 5, 1, 50.0, 81.0, 90.0, 91.0, "7"), ("d", 6, 1, 0.0, 60.0, 9.0, 70.0, "Alone:")]
    df = spark.createDataFrame(s, "document_id string, ord int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [(r.element_id, r.value) for r in extraction.assemble(df).collect()] == [("el_total", "EUR"), ("el_total_2", "7")]


def test_assembled_pairs_equal_a_loop(spark):
    rng = random.Random(7)
    texts = ["Total:", "total 2:", "TOTAL::", "x", "No.:", "5", "é:", ":"]
    spans = [(f"d{rng.randint(0, 9)}", i, rng.randint(1, 2), float(rng.randint(0, 9) * 20), float(rng.randint(0, 12) * 8), rng.choice(texts)) for i in range(400)]
    spans = [(d, i, p, x, y, x + 18, y + 10, t) for d, i, p, x, y, t in spans]
    want = []
    for d in {s[0] for s in spans}:
        here, used = [s for s in spans if s[0] == d], set()
        for a in sorted((s for s in here if s[7].endswith(":")), key=lambda s: (s[2], -s[4], s[3])):
            right = [b for b in here if b is not a and b[2] == a[2] and a[4] < b[6] and b[4] < a[6] and b[3] >= a[5]]
            if right:
                v = min(right, key=lambda s: s[3])
                base = "el_" + re.sub("[^a-z0-9]+", "_", a[7].lower().rstrip(":")).strip("_")
                name = next(n for n in (base if k == 1 else f"{base}_{k}" for k in range(1, 500)) if n not in used)
                used.add(name)
                want.append((d, name, a[7], v[7], a[2], list(v[3:7]), list(a[3:7])))
    df = spark.createDataFrame(spans, "document_id string, ord int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [tuple(r) for r in extraction.assemble(df).collect()]
    assert any(n.endswith("total_2_2") for _, n, *_ in want) and sorted(got) == sorted(want)


def test_rows_are_told_by_their_first_span(spark):
    s = [(-10.0, 1.0, 1, 10.0, 20.0, "a"), (-9.0, 5.0, 2, 9.0, 19.0, "b"), (-0.5, 0.0, 3, 0.5, 9.5, "c")]
    one = spark.createDataFrame([(s,)], "s array<struct<y:double,x0:double,ord:int,y0:double,y1:double,text:string>>")
    assert one.select(extraction.rows_joined(F.col("s"))).first()[0] == "a b\nc"


def test_errors_are_raised(spark):
    with pytest.raises(Exception, match="no inverse"):
        spark.range(1).select(G.inverse(G.transform_of([0, 0, 0, 0, 1, 1]))).collect()
    with pytest.raises(ValueError):
        G.transform_of([1.0])
    with pytest.raises(ValueError):
        extraction.gate(spark.range(1), 0.5, 0.5)
    with pytest.raises(mapping.UnknownSchema):
        mapping.schema_of("maintenance_v1", 1)
    two = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b")], "mask_id string, mask_version int, target_schema string")
    with pytest.raises(Exception, match="more than one"):
        mapping.single_schema(two).collect()
    base = corpus.entries(spark).where("mask_id = 'm_vendor'")
    with pytest.raises(Exception, match="override"):
        lineage.materialize(base, base.withColumn("element_id", F.lit("strange"))).collect()
    with pytest.raises(Exception, match="admin"):
        lineage.next_active(corpus.masks(spark), "m_vendor2", 1).collect()


@pytest.mark.parametrize(("needle", "texts"), [("a%c", ["abc", "xaxxcx", "ab"]), (r"a\%c", ["a%c", "abc"]), (r"\b", ["B", "a"]), ("_", ["", "x"])])
def test_search_text(spark, needle, texts):
    import re

    pattern, k = "", 0
    while k < len(needle):
        c = needle[k]
        if c == "\\" and k + 1 < len(needle):
            k += 1
            pattern += re.escape(needle[k])
        else:
            pattern += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.where(reading.contains(F.col("t"), needle)).collect()] == [t for t in texts if re.search(pattern, t, re.I | re.S)]


def test_dispatch(spark):
    t = {"documents": corpus.registered(spark, DIR), "values": corpus.observations(spark, DIR), "masks": corpus.masks(spark), "entries": corpus.entries(spark)}
    reader = dispatch.Reader(TenantSession("read_api", "t-1"), t)
    one = reader.values().where("template_version = 1").select("document_id").first().document_id
    row = dispatch.dispatch(reader, "get_document_value", {"document_id": one, "system_context": "erp", "semantic_role": "order_no"}).collect()
    assert len(row) == 1 and row[0].mask_id == "m_t1"
    assert dispatch.dispatch(dispatch.Reader(TenantSession("read_api"), t), "get_provenance", {"document_id": one, "element_id": "number"}).count() == 0
    for name, given, code in [
        ("drop", {}, "unknown_operation"), ("get_provenance", {"x": 1}, "unknown_parameter"), ("get_provenance", {"document_id": "d"}, "missing_parameter"),
        ("get_provenance", {"document_id": 1, "element_id": "e"}, "wrong_type"), ("search_document_sections", {"query": "q", "system_context": "c", "limit": True}, "wrong_type"),
        ("search_document_sections", {"query": "q", "system_context": "c", "limit": 21}, "out_of_bounds"),
    ]:
        with pytest.raises(dispatch.Refused) as e:
            dispatch.dispatch(reader, name, given)
        assert e.value.code == code
    with pytest.raises(PermissionError):
        TenantSession("synthesis").table(t["documents"], "documents")
    with pytest.raises(ValueError):
        reading.search_sections(t["values"], "x", 101)
