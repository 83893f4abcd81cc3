"""Queries that run the streaming forms over the supplied tables until all is read."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.config import ENGINES
from proofmill.plans.registry import ORACLES, query
from proofmill.streaming import jobs as J
from proofmill.plans.views import sql_of, table
from proofmill.streaming.run import appended, counted, counting, file_stream, new_home, updated


def _events(spark, sf_dir, *more: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("click", "view"), "PASS").when(F.col("event_type") == "error", "MANUAL").otherwise("pending")
    return file_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"), "event_type", *more)


_STATUS = "(select user_id as session_id, ts, event_id as seq, event_type, case when event_type in ('click', 'view') then 'PASS' when event_type = 'error' then 'MANUAL' else 'pending' end as status from @events)"


@query(f"select session_id, count(*) as done, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'MANUAL') as manual, arg_max(status, (ts, seq)) as last_status from {_STATUS} group by 1")
def str_progress(spark, sf_dir):
    return updated(J.progress(_events(spark, sf_dir)), ["session_id"], "progress").drop("batch")


@query(f"select session_id, arg_max(status, (ts, seq)) as status from {_STATUS} group by 1")
def str_session_state(spark, sf_dir):
    return updated(J.session_state(_events(spark, sf_dir)), ["session_id"], "state").drop("batch")


@query("select strftime(ts, '%Y-%m') as month, engine, cast(sum(delta) as bigint) as calls from @v_usage where engine is not null and delta > 0 group by 1, 2")
def str_engine_counters(spark, sf_dir):
    kind = F.col("event_type")
    engine = F.when(kind == "click", "google").when(kind == "view", "azure").when(kind == "purchase", "ocrspace")
    events = file_stream(spark, f"{sf_dir}/events.parquet").select("ts", engine.alias("engine"), (F.col("event_id") % 4 - 1).alias("delta"))
    return updated(J.engine_counters(events), ["month", "engine"], "counters").drop("batch")


@query("select date_trunc('day', ts) as day, user_id as session_id, count(*) as n from @events group by 1, 2 having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) from @events) - interval 7 days")
def str_expired_days(spark, sf_dir):
    return appended(J.expired_days(_events(spark, sf_dir)), "expired").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""
with u as (select cast(user_id as varchar) as key, cast(event_id as varchar) as id, ts, lead(ts) over (partition by user_id order by ts, cast(event_id as varchar)) as newer from @events where event_type = 'purchase'),
w as (select date_trunc('millisecond', max(ts)) - interval 10 minutes as mark from @events where event_type = 'purchase')
select key, id, ts as created, ts + interval 7 days as expired from u, w where newer > ts + interval 7 days or (newer is null and ts + interval 7 days <= mark)""")
def str_expired_uploads(spark, sf_dir):
    """Uploads, one for each purchase of a user, that no newer one replaced within their time."""
    uploads = _events(spark, sf_dir, "event_id").where("event_type = 'purchase'").select(F.col("session_id").alias("key"), "ts", F.col("event_id").alias("id"))
    found = appended(J.expired_entries(uploads), "uploads")
    return found.select("key", "id", F.col("created").cast("timestamp_ntz").alias("created"), F.col("expired").cast("timestamp_ntz").alias("expired"))


#: Deliveries of the events: a quarter of the month each, every tenth event with the next one, and events 3 modulo 50 without a time.
_DELIVERY = "cast(least(floor((day(ts) - 1) / 8) + case when event_id % 10 = 0 then 1 else 0 end, 3) as bigint)"


@query(f"""
with e as (select {_DELIVERY} as delivery, case when event_id % 50 <> 3 then ts end as ts from @events),
m as (select delivery, count(*) as rows, count(*) - count(ts) as untimed, max(ts) as newest from e group by 1),
w as (select *, date_trunc('millisecond', max(newest) over (order by delivery rows between unbounded preceding and 1 preceding)) - interval 1 day as mark from m)
select w.delivery, w.rows, w.untimed, count(e.ts) as late from w left join e on w.delivery = e.delivery and e.ts <= w.mark group by all""")
def str_late_rows(spark, sf_dir):
    """Rows that come behind the watermark, of four deliveries; the stream stops after each and goes on from its checkpoint."""
    events = table(spark, sf_dir, "events").withColumn("delivery", F.expr(_DELIVERY))
    status = F.when(F.col("event_type").isin("click", "view"), "PASS").otherwise("pending")
    rows = events.select("delivery", F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 50 != 3, F.col("ts")).cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"))
    home = new_home(spark, "late")
    found = []
    for k in range(4):
        rows.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{home}/in")
        with counting(spark) as counts:
            updated(J.progress(counted(file_stream(spark, f"{home}/in")), "1 day"), ["session_id"], "late", home=home)
            found.append(counts.table(spark).groupBy().agg(F.lit(k).cast("long").alias("delivery"), *(F.sum(c).alias(c) for c in ("rows", "untimed", "late"))))
    return functools.reduce(DataFrame.unionByName, found)


@query("select distinct user_id as session_id, event_type from @events")
def str_consume_once(spark, sf_dir):
    return appended(J.consume_once(_events(spark, sf_dir), ["session_id", "event_type"]).select("session_id", "event_type"), "once")


@query(f"select session_id, arg_max(seq, (ts, seq)) as seq, arg_max(status, (ts, seq)) as status from {_STATUS} group by 1")
def str_upsert(spark, sf_dir):
    last = lambda batch: J.upserts(batch.withColumn("at", F.struct("ts", "seq")), ["session_id"], "at").select("session_id", "seq", "status")
    return updated(_events(spark, sf_dir), ["session_id"], "upsert", last, "append").drop("batch")


@query(f"with c as (select session_id, event_type as mode, floor((row_number() over (partition by session_id, event_type order by seq) - 1) / 16) as chunk from {_STATUS}) select session_id, mode, cast(chunk as bigint) as chunk, count(*) as n from c group by 1, 2, 3")
def str_request_batches(spark, sf_dir):
    """Chunks of the requests of each micro-batch; a table of one file is one micro-batch."""
    requests = _events(spark, sf_dir).select("session_id", F.col("event_type").alias("mode"), "seq")
    return updated(requests, [], "chunks", J.request_batches, "append").groupBy("session_id", "mode", "batch", "chunk").agg(F.count("*").alias("n")).drop("batch")


#: Two deliveries of the events: those of the first half of the month, and the others.
_HALF = "case when day(ts) <= 15 then 0 else 1 end"


@query(f"""
with e as (select user_id as session_id, event_type as mode, cast(event_id % 2 as int) as lane, {_HALF} as half, ts from @events),
w as (select date_trunc('millisecond', max(ts) filter (where half = 0)) - interval 10 minutes as first, date_trunc('millisecond', max(ts)) - interval 10 minutes as last from e),
k as (select session_id, mode, lane, count(*) filter (where half = 0) as a, count(*) filter (where half = 1) as b,
  date_trunc('millisecond', max(ts) filter (where half = 0)) + interval 3 days as a_until, date_trunc('millisecond', max(ts)) + interval 3 days as until from e group by all),
p as (select k.*, coalesce(a_until <= w.first, false) as cut, until <= w.last as ended from k, w),
c as (select session_id, mode, lane, case when cut then a // 16 + b // 16 else (a + b) // 16 end as full_chunks,
  case when cut and a % 16 > 0 then a % 16 else 0 end as cut_rest, case when ended then (case when cut then b else a + b end) % 16 else 0 end as end_rest from p)
select session_id, mode, lane, cast(full_chunks as bigint) as full_chunks, cast((cut_rest > 0)::int + (end_rest > 0)::int as bigint) as short_chunks, cast(full_chunks * 16 + cut_rest + end_rest as bigint) as requests
from c where full_chunks > 0 or cut_rest > 0 or end_rest > 0""")
def str_carried_batches(spark, sf_dir):
    """Chunks that fill up over two deliveries; the stream stops after the first and goes on from its checkpoint."""
    events = table(spark, sf_dir, "events").withColumn("half", F.expr(_HALF))
    rows = events.select("half", F.col("user_id").alias("session_id"), F.col("event_type").alias("mode"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    home = new_home(spark, "carried")
    for k in range(2):
        rows.where(F.col("half") == k).drop("half").write.mode("append").parquet(f"{home}/in")
        chunks = appended(J.carried_batches(file_stream(spark, f"{home}/in"), "3 days", lanes=2), "carried", home)
    n = F.size("requests")
    return chunks.groupBy("session_id", "mode", "lane").agg(F.count_if(n == 16).alias("full_chunks"), F.count_if(n < 16).alias("short_chunks"), F.sum(n).alias("requests"))


@query()
def str_vote(spark, sf_dir):
    """The vote over readings as they come; all three readings of a zone do, so it equals agg_majority_vote."""
    docs = file_stream(spark, f"{sf_dir}/documents.parquet")
    n, text = F.col("doc_id"), F.col("text")
    azure = (
        F.when(n % 5 == 0, F.concat(F.lit("## "), text)).when(n % 5 == 1, text).when(n % 5 == 2, F.when(F.col("lang") != "de", F.expr(sql_of("@upper(text)", "spark"))).otherwise(text))
        .when(n % 5 == 3, F.expr("substr(text, 1, cast(floor(length(text) / 2.0) as int))")).otherwise(F.concat(text, F.lit(" extra")))
    )
    space = F.when(n % 3 == 0, F.concat(text, F.lit("!"))).when(n % 3 == 1, text).otherwise("")
    engine = F.col("engine")
    rows = docs.withColumn("engine", F.explode(F.array(*map(F.lit, ENGINES)))).select(
        n.alias("zone_id"), "engine", F.when(engine == "google", text).when(engine == "azure", azure).otherwise(space).alias("text"),
        F.when((n % 17 == 0) | ((n % 11 == 0) & (engine == "google")), "engine_exception").alias("error"), F.timestamp_seconds(F.lit(1_700_000_000) + n).alias("ts"),
    )
    votes = appended(J.streaming_vote(rows), "vote")
    return votes.select("zone_id", "engine", F.md5(F.col("text").cast("binary")).alias("digest"), "rule", "status", "reason", "n_readings", "n_valid")


def _same_as_batch() -> None:
    import proofmill.plans.texts  # noqa: F401

    ORACLES["str_vote"] = ORACLES["agg_majority_vote"]


_same_as_batch()
