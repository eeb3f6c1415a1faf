"""Ingestion and jobs: upload gates, idempotent registration, outbox, job states, rate limits, circuit breakers.

A job's state is a fold over the ordered array of its few events. Rate limits and circuit breakers replay a tenant's events, of any number, as a
sorted stream; streams (``papyra.streaming``) keep the same state between batches.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.retrieval import ATTEMPTS, delay, identity
from papyra.sources import corpus

# Signatures of media types and the largest upload.
SIGNATURES = {"application/pdf": b"%PDF-"}
MOST_BYTES = 25 << 20


def register_signature(media_type: str, prefix: bytes) -> None:
    SIGNATURES[media_type] = prefix


def sanitized(content: Column) -> Column:
    """Hook before hashing; passes content through."""
    return content


def gate(content: Column, media_type: Column, most: int = MOST_BYTES) -> Column:
    """accepted, too_large, unsupported_media_type or bad_signature; size is looked at first."""
    begins = F.lit(None).cast("boolean")
    for kind, prefix in SIGNATURES.items():
        begins = F.when(media_type == kind, F.substring(content, 1, len(prefix)) == F.lit(prefix)).otherwise(begins)
    return F.when(F.octet_length(content) > most, "too_large").when(begins.isNull(), "unsupported_media_type").when(~begins, "bad_signature").otherwise("accepted")


def ingest(uploads: DataFrame) -> DataFrame:
    """uploads (tenant_id, content, intent, ord) with ids, and replayed: whether the same tenant sent the same bytes for the same purpose before."""
    out = uploads.select("*", *identity(F.col("tenant_id"), sanitized(F.col("content")), F.col("intent")))
    first = out.groupBy("tenant_id", "idempotency_key").agg(F.min("ord").alias("first"))
    return out.join(first, ["tenant_id", "idempotency_key"]).withColumn("replayed", F.col("ord") > F.col("first")).drop("first")


def object_keys(documents: DataFrame) -> DataFrame:
    """Keys that documents register; those whose body has none are left out."""
    return documents.select("tenant_id", F.get_json_object("body", "$.object_key").alias("object_key")).where("object_key is not null")


def orphans(stored: DataFrame, registered: DataFrame, tenant: str) -> DataFrame:
    """Stored keys under the tenant's prefix that nothing registers."""
    return stored.where(F.col("object_key").startswith(f"{tenant}/")).join(registered.select("object_key"), "object_key", "left_anti")


def pending(outbox: DataFrame, limit: int) -> DataFrame:
    return outbox.where(~F.col("relayed")).orderBy("created_at", "outbox_id").limit(limit)


def mark_relayed(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """outbox with the rows of done (outbox_id) relayed; once more changes nothing."""
    gone = done.select("outbox_id").distinct().withColumn("now_", F.lit(True))
    return outbox.join(gone, "outbox_id", "left").withColumn("relayed", F.col("relayed") | F.coalesce("now_", F.lit(False))).drop("now_").select(outbox.columns)


def relay(outbox: DataFrame, jobs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(outbox, jobs) after a drain: each pending row becomes a job once, by tenant and key, however often it is relayed."""
    rows = pending(outbox, limit)
    fresh = rows.select("tenant_id", "idempotency_key", "kind").dropDuplicates(["tenant_id", "idempotency_key"]).join(jobs, ["tenant_id", "idempotency_key"], "left_anti")
    return mark_relayed(outbox, rows), jobs.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in jobs.columns]))


def job_states(events: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """job_id, status, attempts, due_after: events (job_id, ord, event in enqueue, lease, fail, complete), in order.

    Only queued jobs are leased. A failure counts whatever the status: the job waits, or ends when it was the last attempt. Completing
    a job twice changes nothing, and what happens to a job before it is enqueued is passed over.
    """
    start = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"))

    def step(s: Column, e: Column) -> Column:
        kind, known = e["event"], s["status"] != "none"
        failed = known & (kind == "fail")
        n = s["attempts"] + failed.cast("int")
        status = (
            F.when(~known & (kind == "enqueue"), "queued").when((kind == "lease") & (s["status"] == "queued"), "leased")
            .when(failed, F.when(n >= most, "dead_letter").otherwise("queued")).when(known & (kind == "complete"), "completed").otherwise(s["status"])
        )
        return F.struct(status.alias("status"), n.alias("attempts"))

    whole = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "event"))).alias("es"))
    out = whole.select("job_id", F.aggregate("es", start, step).alias("s")).select("job_id", "s.*")
    return out.withColumn("due_after", F.when((F.col("status") == "queued") & (F.col("attempts") > 0), delay(F.col("attempts"))))


def lease_next(jobs: DataFrame, kind: str, now: float) -> DataFrame:
    """The first queued and due job of a kind, in the order of insertion."""
    return jobs.where((F.col("kind") == kind) & (F.col("status") == "queued") & (F.coalesce("due", F.lit(0.0)) <= now)).orderBy("seq").limit(1)


def fixed_window(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events (tenant_id, ord, at) with allowed: at most limit in a window, which begins with the first event after the last one ended."""

    def tenant():
        start, n = None, 0

        def step(at: float) -> bool:
            nonlocal start, n
            if start is None or at - start >= window:
                start, n = at, 0
            fine = n < limit
            n += fine
            return fine

        return step

    return _replayed(events, [], tenant, "allowed", "boolean", pa.bool_())


def sliding_window(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The same with the calls allowed in the last window before each event."""

    def tenant():
        kept: deque[float] = deque()

        def step(at: float) -> bool:
            while kept and kept[0] <= at - window:
                kept.popleft()
            if len(kept) >= limit:
                return False
            kept.append(at)
            return True

        return step

    return _replayed(events, [], tenant, "allowed", "boolean", pa.bool_())


def breaker(calls: DataFrame, failures: int, cool: float, cap: float, rate: int = 10, window: float = 1.0) -> DataFrame:
    """calls (tenant_id, ord, at, ok, cost) with verdict: refused by the open circuit, the cost cap or the rate limit, in this order, or called.

    The circuit opens after so many failures in a row and lets a call through after cool seconds: if that fails it opens again. The cap
    refuses once as much as it is spent, so the call that passes it is still made; only calls that succeed cost anything. Refusals are no
    failures, and a circuit that has cooled down stays ready for its trial. A null ok is a failure, a null cost 0.
    """
    if min(cap, cool, window) <= 0 or min(failures, rate) < 1:
        raise ValueError("failures, cool, cap, rate and window must be positive")

    def tenant():
        bad, opened, spent = 0, None, 0.0
        kept: deque[float] = deque()

        def step(at: float, ok: bool, cost: float) -> str:
            nonlocal bad, opened, spent
            if opened is not None and at - opened < cool:
                return "circuit_open"
            if spent >= cap:
                return "cost_cap"
            while kept and kept[0] <= at - window:
                kept.popleft()
            if len(kept) >= rate:
                return "rate_limit"
            kept.append(at)
            if ok:
                bad, opened, spent = 0, None, spent + cost
            elif opened is not None or bad + 1 >= failures:
                bad, opened = 0, at
            else:
                bad += 1
            return "called"

        return step

    return _replayed(calls, [F.coalesce(F.col("ok").cast("boolean"), F.lit(False)), F.coalesce(F.col("cost").cast("double"), F.lit(0.0))], tenant, "verdict", "string", pa.string())


def _replayed(events: DataFrame, more: list[Column], tenant, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """tenant_id, ord and what tenant()'s step says of (at, *more), for each tenant's events by time, then ord.

    The events of a tenant are sorted in one partition (which spills) and stream through: no task holds more than a batch and the state.
    """
    rows = events.select(F.col("tenant_id").cast("string"), F.col("at").cast("double").alias("at"), F.col("ord").cast("long").alias("ord"), *[c.alias(f"more_{i}") for i, c in enumerate(more)])
    rows = rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "at", "ord")

    def run(batches):
        held, step = object(), None
        for b in batches:
            said = []
            columns = [c.to_pylist() for i, c in enumerate(b.columns) if i != 2]
            for t, *e in zip(*columns, strict=True):
                if t != held:
                    held, step = t, tenant()
                said.append(step(*e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(said, arrow)], ["tenant_id", "ord", name])

    return rows.mapInArrow(run, f"tenant_id string, ord long, {name} {kind}")


def _uploads(spark, sf_dir) -> DataFrame:
    d = corpus.read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(F.concat(F.lit("t-"), k % 3).alias("tenant_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.when(k % 2 == 0, "extract").otherwise("map").alias("intent"), k.alias("ord"))


def _log(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return corpus.read(spark, sf_dir, "events").select(F.concat(F.lit("t-"), k % 200).alias("tenant_id"), k.alias("ord"), (k * 7 % 5000 / 10).alias("at"), (k % 3 != 0).alias("ok"), (k % 4).cast("double").alias("cost"))


def q_ingest_dedup(spark, sf_dir):
    return ingest(_uploads(spark, sf_dir)).select("ord", "ingestion_id", "replayed")


def q_magic_byte_gate(spark, sf_dir):
    u = _uploads(spark, sf_dir)
    content = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(b"%PDF-"), F.col("content"))).otherwise(F.col("content"))
    return u.select("ord", gate(content, F.when(F.col("ord") % 5 == 0, "text/html").otherwise("application/pdf"), 5000).alias("verdict"))


def q_orphan_objects(spark, sf_dir):
    made = ingest(_uploads(spark, sf_dir))
    body = F.when(F.col("ord") % 4 == 0, F.lit("{}")).otherwise(F.to_json(F.struct("object_key")))
    return orphans(made.select("object_key").distinct(), object_keys(made.select("tenant_id", body.alias("body"))), "t-1")


def q_registered_object_keys(spark, sf_dir):
    made = ingest(_uploads(spark, sf_dir))
    body = F.when(F.col("ord") % 4 == 0, F.lit("{}")).otherwise(F.to_json(F.struct("object_key")))
    return object_keys(made.select("tenant_id", body.alias("body")))


def _outbox(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return corpus.read(spark, sf_dir, "events").select(k.alias("outbox_id"), F.concat(F.lit("t-"), k % 3).alias("tenant_id"), F.concat(F.lit("key-"), k % 500).alias("idempotency_key"), F.lit("extract").alias("kind"), (k * 13 % 101).alias("created_at"), (k % 6 == 0).alias("relayed"))


def q_outbox_pending(spark, sf_dir):
    return pending(_outbox(spark, sf_dir), 100).select("outbox_id", "created_at")


def q_outbox_relay(spark, sf_dir):
    jobs = spark.createDataFrame([], "tenant_id string, idempotency_key string, kind string")
    return relay(_outbox(spark, sf_dir), jobs, 100)[1]


def q_outbox_marked(spark, sf_dir):
    o = _outbox(spark, sf_dir)
    return mark_relayed(o, o.where("outbox_id % 10 = 0")).groupBy("tenant_id", "relayed").agg(F.count("*").alias("n"))


def q_job_status_fold(spark, sf_dir):
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("enqueue", "lease", "fail", "lease", "complete", "lease", "fail"))), (k / 400 % 7).cast("int") + 1)
    return job_states(corpus.read(spark, sf_dir, "events").select((k % 400).alias("job_id"), k.alias("ord"), kind.alias("event")), 3)


def q_job_lease(spark, sf_dir):
    k = F.col("event_id")
    jobs = corpus.read(spark, sf_dir, "events").select(k.alias("seq"), F.when(k % 2 == 0, "a").otherwise("b").alias("kind"), F.when(k % 5 == 0, "queued").otherwise("leased").alias("status"), (k % 17).cast("double").alias("due"))
    return lease_next(jobs, "b", 3.0).select("seq", "due")


def q_fixed_rate_limit(spark, sf_dir):
    return fixed_window(_log(spark, sf_dir), 3, 60.0)


def q_sliding_rate_limit(spark, sf_dir):
    return sliding_window(_log(spark, sf_dir), 3, 60.0)


def q_circuit_breaker(spark, sf_dir):
    return breaker(_log(spark, sf_dir), 2, 30.0, 40.0)


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_UP = """with u as (select 't-' || doc_id % 3 as tenant_id, sha256(coalesce(text, '')) as sha, case when doc_id % 2 = 0 then 'extract' else 'map' end as intent, doc_id as ord, text from documents),
k as (select *, tenant_id || '/' || substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha as object_key from u)
"""
_BOX = "with o as (select event_id as outbox_id, 't-' || event_id % 3 as tenant_id, 'key-' || event_id % 500 as idempotency_key, event_id * 13 % 101 as created_at, event_id % 6 = 0 as relayed from events) "
ORACLES = {
    "ingest_dedup": _UP + "select ord, substr(sha256(tenant_id || chr(10) || sha || chr(10) || intent), 1, 32) as ingestion_id, ord > min(ord) over (partition by tenant_id, sha, intent) as replayed from k",
    "magic_byte_gate": "select doc_id as ord, case when octet_length(encode(coalesce(text, ''))) + case when doc_id % 3 = 0 then 5 else 0 end > 5000 then 'too_large' when doc_id % 5 = 0 then 'unsupported_media_type' when doc_id % 3 = 0 or starts_with(text, '%PDF-') then 'accepted' else 'bad_signature' end as verdict from documents",
    "orphan_objects": _UP + "select distinct object_key from k where tenant_id = 't-1' and object_key not in (select object_key from k where ord % 4 <> 0)",
    "registered_object_keys": _UP + "select tenant_id, object_key from k where ord % 4 <> 0",
    "outbox_pending": _BOX + "select outbox_id, created_at from o where not relayed order by created_at, outbox_id limit 100",
    "outbox_relay": _BOX + "select distinct tenant_id, idempotency_key, 'extract' as kind from (select * from o where not relayed order by created_at, outbox_id limit 100)",
    "outbox_marked": _BOX + "select tenant_id, relayed or outbox_id % 10 = 0 as relayed, count(*) as n from o group by all",
    "job_lease": "select event_id as seq, (event_id % 17)::double as due from events where event_id % 2 = 1 and event_id % 5 = 0 and event_id % 17 <= 3 order by event_id limit 1",
}
