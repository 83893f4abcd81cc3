"""Queries on sessions: verdicts, judge, reviews, roll-ups, usage, templates, geometry, responses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.config import PROTECTED_REASONS
from proofmill.functions import compare as X
from proofmill.functions import geometry as G
from proofmill.functions import responses as R
from proofmill.functions import text as T
from proofmill.operators import reports as O
from proofmill.operators import usage as U
from proofmill.operators import verdicts as V
from proofmill.plans import duck as D
from proofmill.plans.registry import query
from proofmill.plans.views import view
from proofmill.sources import catalog as C
from proofmill.sources import sinks as K
from proofmill.sources.shared import shared_dir, written

_PROTECTED = ", ".join(D.q(r) for r in PROTECTED_REASONS)


def _results(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_results")


# --- verdicts ----------------------------------------------------------------

_STATE = """select id, id % 19 <> 0 as image_ok, case when id % 17 <> 0 then 1 end as box, id % 13 <> 0 as crop_ok, case when id % 11 <> 0 then ref_text else ' ' end as en_reference,
  case when id % 7 <> 0 then ref_text end as en_reading, id % 5 <> 0 as section_found, status as sel_status, reason as sel_reason from @v_results"""


@query(f"""with s as ({_STATE}), e as (select *, case when not image_ok then 'image_read_error' when box is null then 'missing_bbox' when not crop_ok then 'crop_required' when trim(en_reference) = '' then 'missing_en_reference_text'
when trim(coalesce(en_reading, '')) = '' then 'missing_en_ocr_text' when not section_found then 'no_reference_section' end as early from s)
select id, case when early is null then sel_status else 'MANUAL' end as status, coalesce(early, sel_reason) as reason from e""")
def ver_session(spark, sf_dir):
    n = F.col("id")
    rows = _results(spark, sf_dir).select(
        "id", (n % 19 != 0).alias("image_ok"), F.when(n % 17 != 0, F.array(F.lit(1))).alias("bbox"), (n % 13 != 0).alias("crop_ok"),
        F.when(n % 11 != 0, F.col("ref_text")).otherwise(" ").alias("en_reference"), F.when(n % 7 != 0, F.col("ref_text")).alias("en_reading"),
        (n % 5 != 0).alias("section_found"), F.col("status").alias("sel_status"), F.col("reason").alias("sel_reason"),
    )
    return V.session_verdict(rows).select("id", "status", "reason")


_RUN = "select id, case when id % 4 = 3 then 'MANUAL' else 'OK' end as status, case when id % 4 = 3 then 'no_consensus' end as reason, case when id % 5 = 0 then 'logo' else 'ocr' end as type, id % 3 <> 0 as applied, case when id % 3 <> 0 then id % 2 = 0 end as match_pass, cast(id % 7 as int) as n_engines from @v_results"


@query(f"""with r as ({_RUN}), m as (select *, status = 'OK' and coalesce(applied and not match_pass, false) and type <> 'logo' as miss from r)
select id, case when n_engines = 0 or miss then 'MANUAL' else status end as status, case when n_engines = 0 then 'no_engines_configured' when miss then 'no_text_match' else reason end as reason from m""")
def ver_run(spark, sf_dir):
    n = F.col("id")
    rows = _results(spark, sf_dir).select(
        "id", F.when(n % 4 == 3, "MANUAL").otherwise("OK").alias("status"), F.when(n % 4 == 3, "no_consensus").alias("reason"), F.when(n % 5 == 0, "logo").otherwise("ocr").alias("type"),
        (n % 3 != 0).alias("applied"), F.when(n % 3 != 0, n % 2 == 0).alias("match_pass"), (n % 7).cast("int").alias("n_engines"),
    )
    return V.run_verdict(rows).select("id", "status", "reason")


_FR = "lower(coalesce(lang, '')) = 'fr'"


@query(f"""with r as (select zone_id as id, lang, text, case when zone_id % 29 = 0 then '' else ref end as ref, case when zone_id % 23 = 0 then 'missing_bbox' else 'no_match' end as reason, zone_id % 6 = 0 as disagree, zone_id % 10 = 3 as outlier,
  case zone_id % 5 when 0 then 'pass' when 1 then 'fail' end as judge from @v_refs),
e as (select *, {D.strict('text', _FR)} = {D.strict('ref', _FR)} as eq, ref <> '' and reason not in ({_PROTECTED}) as judged from r),
v as (select id, case when judged then case when outlier then 'translator_outlier' when disagree then 'engines_disagree' when eq then 'strict_equal' when judge = 'pass' then 'llm_adjudicated' when judge = 'fail' then 'llm_rejected' else 'localized_mismatch' end else reason end as reason from e)
select id, reason, case when reason in ('strict_equal', 'llm_adjudicated') then 'PASS' else 'MANUAL' end as status from v""")
def ver_image(spark, sf_dir):
    n = F.col("zone_id")
    rows = view(spark, sf_dir, "v_refs").select(
        n.alias("id"), "lang", "text", F.when(n % 29 == 0, "").otherwise(F.col("ref")).alias("ref_text"), F.when(n % 23 == 0, "missing_bbox").otherwise("no_match").alias("reason"), F.lit("MANUAL").alias("status"),
        (n % 6 == 0).alias("disagree"), (n % 10 == 3).alias("outlier"), F.when(n % 5 == 0, "pass").when(n % 5 == 1, "fail").alias("judge"),
    )
    return V.image_verdict(rows).select("id", "reason", "status")


def _judge(x: str) -> str:
    return f"lower({D.sub(D.display(x, _FR), r'[\[\]<>()]', ' ')})"


_REQUESTS = f"""with n as (select lang, text, ref, {D.soft('text')} as a, {D.soft('ref')} as b, {D.lines('text', D.soft)} as la, {D.lines('ref', D.soft)} as lb from @v_refs),
s as (select *, {D.similarity('a', 'b')} as s from n where a <> b and not (len(la) > 0 and list_sort(la) = list_sort(lb))),
g as (select lang, {_judge('text')} as ocr, {_judge('ref')} as ref from s where s between 0.75 and 0.99),
k as (select distinct sha1(lang || chr(0) || lower(ocr) || chr(0) || lower(ref)) as key, lang from g)"""


def _requests(spark, sf_dir) -> DataFrame:
    grey = X.grey_zone(view(spark, sf_dir, "v_refs")).withColumn("match_pass", F.lit(False)).withColumnRenamed("ref", "ref_text")
    return V.judge_requests(grey)


@query(_REQUESTS + " select key, lang from k")
def ver_judge_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("key", "lang")


@query(_REQUESTS + " select key, lang from k where key >= '8'")
def join_cache_misses(spark, sf_dir):
    requests = written(_requests(spark, sf_dir).select("key", "lang"), "judge-requests")
    return V.cache_misses(requests, requests.where("key < '8'").select("key")).select("key", "lang")


@query("""with r as (select id, case id % 3 when 0 then 'pass' when 1 then 'fail' end as verdict, id % 4 = 0 as ok from @v_results)
select id, ok or coalesce(verdict = 'pass', false) as match_pass, case when not ok and verdict = 'pass' then 'llm_adjudicated' when ok then 'exact' else 'none' end as match_mode from r""")
def ver_apply_replies(spark, sf_dir):
    n = F.col("id")
    rows = _results(spark, sf_dir).select("id", n.alias("key"), (n % 4 == 0).alias("match_pass"), F.when(n % 4 == 0, "exact").otherwise("none").alias("match_mode"))
    replies = rows.select(n.alias("key"), n.alias("reply_id"), F.when(n % 3 == 0, "pass").when(n % 3 == 1, "fail").alias("verdict")).where("verdict is not null")
    return V.apply_replies(rows, replies).select("id", "match_pass", "match_mode")


_DECISIONS = "select event_id % 1500 as result_id, ts, case event_type when 'click' then 'ok' when 'error' then 'error' else 'maybe' end as decision from @events"


@query(f"with d as ({_DECISIONS}) select result_id, arg_max(decision, (ts, decision)) as decision from d where decision in ('ok', 'error') and result_id in (select doc_id from @documents) group by 1")
def ver_review_decisions(spark, sf_dir):
    kind = F.col("event_type")
    decisions = view(spark, sf_dir, "events").select(
        (F.col("event_id") % 1500).alias("result_id"), "ts", F.when(kind == "click", "ok").when(kind == "error", "error").otherwise("maybe").alias("decision")
    )
    return V.review_decisions(decisions, view(spark, sf_dir, "documents").select(F.col("doc_id").alias("result_id")))


@query(f"select id as result_id, case when reason in ({_PROTECTED}) or id % 2 = 1 then status else 'PASS' end as status, case when reason in ({_PROTECTED}) or id % 2 = 1 then reason else 'llm_adjudicated' end as reason from @v_results")
def snk_updated_verdicts(spark, sf_dir):
    rows = _results(spark, sf_dir).select(F.col("id").alias("result_id"), "status", "reason")
    new = rows.where("result_id % 2 = 0").select("result_id", F.lit("PASS").alias("status"), F.lit("llm_adjudicated").alias("reason"))
    return V.updated_verdicts(rows, new)


_REASON_ROWS = ", ".join(f"('{r}', '{s}')" for r, s in V.REASONS)


@query(f"select k.reason, k.usual_status, count(r.reason) as n from (values {_REASON_ROWS}) k(reason, usual_status) left join @v_results r on k.reason = r.reason group by 1, 2")
def ver_reasons(spark, sf_dir):
    """How often each reason of the catalogue occurs in the results."""
    known = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(s).alias("usual_status")) for r, s in V.REASONS])).alias("r")).select("r.*")
    return known.join(_results(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").na.fill(0, ["n"])


@query("""with r as (select id, lang, case id % 5 when 0 then 'translator_outlier' when 1 then 'engines_disagree' when 2 then 'llm_rejected' when 3 then 'localized_mismatch' else 'no_match' end as reason from @v_results)
select id, case reason when 'translator_outlier' then 'Numbers differ (' || lang || '): missing 7, 8' when 'engines_disagree' then 'No two engines read the same text.'
when 'llm_rejected' then 'Judge: diff: OCR ''a0'' vs reference ''(empty)''; diff: OCR ''a1'' vs reference ''(empty)''; diff: OCR ''a2'' vs reference ''(empty)'' (+1 more)'
when 'localized_mismatch' then 'The text differs from its reference and the judge had no verdict.' end as detail from r""")
def ver_reason_text(spark, sf_dir):
    n = F.col("id")
    reason = F.when(n % 5 == 0, "translator_outlier").when(n % 5 == 1, "engines_disagree").when(n % 5 == 2, "llm_rejected").when(n % 5 == 3, "localized_mismatch").otherwise("no_match")
    diffs = F.array(*[F.struct(F.lit(f"a{k}").alias("ocr"), F.lit("").alias("ref"), F.lit("").alias("kind")) for k in range(4)])
    none = F.array().cast("array<string>")
    return _results(spark, sf_dir).select("id", V.reason_text(reason, F.col("lang"), F.array(F.lit("7"), F.lit("8")), none, diffs).alias("detail"))


# --- roll-ups ------------------------------------------------------------------


@query("""select session_id, image_name, case when bool_or(status <> 'PASS') then 'MANUAL' else 'PASS' end as status, case when bool_and(coalesce(decision = 'ok', false)) then 'ok' when bool_or(coalesce(decision = 'error', false)) then 'error' end as decision,
coalesce(first(reason order by id) filter (where status <> 'PASS'), first(reason order by id)) as reason, md5(first(ref_text order by id)) as digest, first(confidence order by id) as confidence, string_agg(cast(id as varchar), ',' order by id) as ids from @v_results group by 1, 2""")
def agg_image_rollup(spark, sf_dir):
    out = O.image_rollup(_results(spark, sf_dir))
    return out.select("session_id", "image_name", "status", "decision", "reason", F.md5(F.col("ref_text").cast("binary")).alias("digest"), "confidence", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("select cast(floor(zone_id / 4) as bigint) as image_id, md5(coalesce(string_agg(text, chr(10) order by ord) filter (where text <> ''), '')) as digest from (select zone_id, text, zone_id * 3 + case engine when 'google' then 0 when 'azure' then 1 else 2 end as ord from @v_readings) group by 1")
def agg_image_text(spark, sf_dir):
    order = F.col("zone_id") * 3 + F.when(F.col("engine") == "google", 0).when(F.col("engine") == "azure", 1).otherwise(2)
    rows = view(spark, sf_dir, "v_readings").select(F.floor(F.col("zone_id") / 4).alias("image_id"), order.alias("ord"), "text")
    return O.joined_text(rows, ["image_id"]).select("image_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select cast(floor(zone_id / 4) as bigint) as image_id, md5(coalesce(string_agg(text, chr(10) order by zone_id) filter (where engine = 'google' and text <> ''), '')) as google,
md5(coalesce(string_agg(text, chr(10) order by zone_id) filter (where engine = 'azure' and text <> ''), '')) as azure, md5(coalesce(string_agg(text, chr(10) order by zone_id) filter (where engine = 'ocrspace' and text <> ''), '')) as ocrspace from @v_readings group by 1""")
def agg_engine_texts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_readings").select(F.floor(F.col("zone_id") / 4).alias("image_id"), F.col("zone_id").alias("ord"), "engine", "text")
    out = O.engine_texts(rows, ["image_id"])
    return out.select("image_id", *[F.md5(F.col(e).cast("binary")).alias(e) for e in ("google", "azure", "ocrspace")])


_TARGETS = "(select session_id as job_id, id % 5 as target_id, case when id % 31 = 0 then 'error' when status = 'PASS' then 'OK' else status end as status from @v_results)"
_TARGET_ROLLUP = f"select job_id, target_id, case when bool_or(status = 'error') then 'error' when bool_or(status = 'MANUAL') then 'MANUAL' else 'OK' end as status from {_TARGETS} group by 1, 2"


def _targets(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("id") % 31 == 0, "error").when(F.col("status") == "PASS", "OK").otherwise(F.col("status"))
    return O.target_rollup(_results(spark, sf_dir).select(F.col("session_id").alias("job_id"), (F.col("id") % 5).alias("target_id"), status.alias("status")))


@query(_TARGET_ROLLUP)
def agg_target_rollup(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(f"with t as ({_TARGET_ROLLUP}) select job_id, count(*) filter (where status = 'OK') as ok, count(*) filter (where status = 'MANUAL') as manual, count(*) filter (where status = 'error') as error, count(*) as total from t group by 1")
def agg_job_totals(spark, sf_dir):
    return O.job_totals(_targets(spark, sf_dir))


_TOTALS = """select session_id, count(*) as total, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status <> 'PASS') as manual, count(*) filter (where status <> 'PASS' and decision is null) as unresolved,
count(*) filter (where status <> 'PASS' and decision is null) = 0 as resolved, count(*) filter (where disagree) as disagreeing, round(coalesce(avg(coalesce(confidence, 0)), 0), 4) as mean_confidence from @v_results group by 1"""


@query(_TOTALS)
def agg_session_totals(spark, sf_dir):
    return O.session_totals(_results(spark, sf_dir))


@query("""with c as (select session_id, reason, count(*) as n from @v_results group by 1, 2) select session_id, string_agg(reason || '=' || cast(n as varchar), ',' order by reason) as reasons from c group by 1""")
def agg_reason_counts(spark, sf_dir):
    entries = F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return O.reason_counts(_results(spark, sf_dir)).select("session_id", F.array_join(entries, ",").alias("reasons"))


def _calls(spark, sf_dir) -> DataFrame:
    n = F.col("id")
    return _results(spark, sf_dir).select("session_id", (n % 2 == 0).alias("called"), (n % 10 == 0).alias("from_cache"), F.when(n % 3 != 0, n / 10000.0).alias("cost"), F.when(n % 4 == 0, "pass").otherwise("fail").alias("verdict"))


_CALLS = "(select session_id, id % 2 = 0 as called, id % 10 = 0 as from_cache, case when id % 3 <> 0 then id / 10000.0 end as cost, case when id % 4 = 0 then 'pass' else 'fail' end as verdict from @v_results)"


@query(f"select session_id, count(*) filter (where called and not from_cache) as calls, round(cast(sum(case when called and not from_cache then coalesce(cost, 0) else 0 end) as double), 6) as cost, count(*) filter (where called and verdict = 'pass') as flips from {_CALLS} group by 1")
def agg_judge_totals(spark, sf_dir):
    return O.judge_totals(_calls(spark, sf_dir))


_META = f"""
with t as (select session_id, count(*) as total, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status <> 'PASS') as manual, count(*) filter (where status <> 'PASS' and decision is null) as unresolved,
  count(*) filter (where disagree) as disagreeing, min(id) % 12 as section_no from @v_results group by 1),
c as (select session_id, count(*) filter (where called and not from_cache) as calls, round(cast(sum(case when called and not from_cache then coalesce(cost, 0) else 0 end) as double), 6) as cost, count(*) filter (where called and verdict = 'pass') as flips from {_CALLS} group by 1),
n as (select session_id, reason, count(*) as n, min(image_name) as image from @v_results where reason is not null group by 1, 2),
r as (select session_id, string_agg('"' || reason || '":' || n, ',' order by reason) as reasons, string_agg('"' || reason || '":"See ' || image || '"', ',' order by reason) as texts from n group by 1)
select t.session_id, '{{"total":' || total || ',"passed":' || passed || ',"manual":' || manual || ',"unresolved":' || unresolved || ',"disagreeing":' || disagreeing || ',"section_no":' || section_no || ',"section_name":"NAME ' || section_no
  || '","calls":' || calls || ',"flips":' || flips || ',"cost":' || cost || ',"reasons":{{' || reasons || '}},"reason_texts":{{' || texts || '}}}}' as meta
from t join c using (session_id) join r using (session_id)"""


@query(_META)
def agg_session_meta(spark, sf_dir):
    rows = _results(spark, sf_dir)
    locked = rows.groupBy("session_id").agg((F.min("id") % 12).alias("section_no"))
    locked = locked.withColumn("section_name", F.concat(F.lit("NAME "), F.col("section_no")))
    details = rows.select("session_id", "reason", F.concat(F.lit("See "), F.col("image_name")).alias("detail")).where("reason is not null")
    return O.session_meta(rows, _calls(spark, sf_dir), locked, details)


_PAGE = "select *, (select count(*) from @v_results where status <> 'PASS') as total_rows, cast((select greatest(1, ceil(count(*) / 20.0)) from @v_results where status <> 'PASS') as bigint) as total_pages from (select id, reason, status from @v_results where status <> 'PASS' order by id limit 20 offset 20)"


@query(_PAGE)
def lim_page(spark, sf_dir):
    return O.page(_results(spark, sf_dir).where("status <> 'PASS'").select("id", "reason", "status"), 2)


@query(_PAGE)
def lim_page_indexed(spark, sf_dir):
    """The page of a table that was written in order once: it reads that page's ranges, and counts nothing."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    K.write_pages(_results(spark, sf_dir).where("status <> 'PASS'").select("id", "reason", "status"), path)
    return K.read_page(spark, path, 2)


@query("select id, lang, row_number() over (partition by session_id order by case when lower(lang) like 'en%' then 0 else 1 end, id) as place, session_id from @v_results")
def lim_english_first(spark, sf_dir):
    return O.places(_results(spark, sf_dir).select("id", "lang", "session_id"), F.col("id"))


@query("with l as (select distinct session_id, lang from @v_results) select session_id, lang from (select *, row_number() over (partition by session_id order by lang) as r from l) where r <= 2")
def lim_first_languages(spark, sf_dir):
    return O.first_languages(_results(spark, sf_dir), ["session_id"])


@query("select session_id, id, substr(ref_text, 1, 200) as preview from @v_results where status <> 'PASS'")
def src_session_results(spark, sf_dir):
    rows = K.session_results(_results(spark, sf_dir), hide_pass=True)
    return rows.select("session_id", "id", K.preview(F.col("ref_text")).alias("preview"))


@query("select image_name from @v_results where decision = 'error'")
def snk_rejected_paths(spark, sf_dir):
    return O.rejected_paths(_results(spark, sf_dir))


_PAYLOADS = "with r as (select distinct session_id, image_name from @v_results where decision = 'error'), p as (select session_id, image_name, md5(string_agg(ref_text, '' order by id)) as payload from @v_results group by 1, 2) select r.session_id, r.image_name, payload from r join p using (session_id, image_name)"


@query(_PAYLOADS)
def join_rejected_payloads(spark, sf_dir):
    rows = _results(spark, sf_dir)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("id", "ref_text")))["ref_text"], "")
    payloads = rows.groupBy("session_id", "image_name").agg(F.md5(text.cast("binary")).alias("payload"))
    return O.rejected_payloads(rows, payloads)


def _bucketed(rows: DataFrame, name: str) -> DataFrame:
    return K.save_bucketed(rows, f"{name}_{uuid.uuid4().hex}")


@query(_PAYLOADS)
def join_bucketed_payloads(spark, sf_dir):
    """As join_rejected_payloads, from tables whose rows of a session are stored together."""
    rows = _bucketed(_results(spark, sf_dir), "results")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("id", "ref_text")))["ref_text"], "")
    payloads = rows.groupBy("session_id", "image_name").agg(F.md5(text.cast("binary")).alias("payload"))
    return O.rejected_payloads(rows, _bucketed(payloads, "payloads"))


@query(_TOTALS)
def agg_bucketed_totals(spark, sf_dir):
    return O.session_totals(_bucketed(_results(spark, sf_dir), "results"))


_MERGED = "select session_id, image_name, max(id) as id, arg_max(status, id) as status from @v_results group by 1, 2"


@query(_MERGED)
def snk_merge(spark, sf_dir):
    """The last result of each image, merged from three deliveries of which one comes twice."""
    path = f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}"
    rows = _results(spark, sf_dir).select("session_id", "image_name", "id", "status")
    for number in (2, 0, 1, 0):
        K.merge(rows.where(F.col("id") % 3 == number), path, ["session_id", "image_name"], "id", number)
    return K.merged(spark, path)


@query("select session_id, id, status from @v_results")
def snk_append_verdicts(spark, sf_dir):
    """What is read back from a table to which results were appended, a folder for each session."""
    path = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    for passed in ("status = 'PASS'", "status <> 'PASS'"):
        K.append_verdicts(_results(spark, sf_dir).where(passed).select("session_id", "id", "status"), path)
    return spark.read.parquet(path).select(F.col("session_id").cast("long").alias("session_id"), "id", "status")


@query("""select id, '{"id":' || id || ',"image_name":"' || image_name || '","status":"' || status || '","reason":"' || reason || '","reference":{"confidence":' || confidence || ',"score_top1":null,"score_top2":2.5,"margin":0.0}}' as document from @v_results""")
def snk_documents(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumns({"score_top1": F.lit(None).cast("double"), "score_top2": F.lit(2.5), "margin": F.lit(0.0)})
    return O.result_documents(rows)


@query("select event_id, '{\"event\":\"call\",\"ts_utc\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"user_id\":' || user_id || '}' as line from @events")
def snk_event_rows(spark, sf_dir):
    events = view(spark, sf_dir, "events")
    return K.event_rows(events, "call", "ts", "user_id", keys=("event_id",))


@query("""with r as (select doc_id % 23 as session_id, doc_id as idx, 40 as total from @documents), d as (select *, least(count(*) over (partition by session_id order by idx rows unbounded preceding), total) as done from r)
select session_id, idx, done, cast(round(100.0 * done / total) as bigint) as percent from d""")
def win_progress(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select((F.col("doc_id") % 23).alias("session_id"), F.col("doc_id").alias("idx"), F.lit(40).cast("long").alias("total"))
    return O.progress(rows)


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from @events group by 1")
def snk_latest(spark, sf_dir):
    rows = view(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return O.latest(rows, ["user_id"], "at").select("user_id", "event_id", "event_type")


# --- usage -----------------------------------------------------------------------

_MONTHLY = "select strftime(ts, '%Y-%m') as month, cast(coalesce(sum(delta) filter (where engine = 'google'), 0) as bigint) as google, cast(coalesce(sum(delta) filter (where engine = 'azure'), 0) as bigint) as azure, cast(coalesce(sum(delta) filter (where engine = 'ocrspace'), 0) as bigint) as ocrspace from @v_usage where engine is not null and delta > 0 group by 1"


@query(_MONTHLY)
def agg_engine_usage(spark, sf_dir):
    return U.engine_usage(view(spark, sf_dir, "v_usage"))


@query(f"with u as ({_MONTHLY}), m as (select distinct date_trunc('month', ts) as d from @v_usage union select date_trunc('month', max(ts)) + interval 1 month from @v_usage) select strftime(d, '%Y-%m') as month, strftime(d, '%B %Y') as label, coalesce(google, 0) as google, coalesce(azure, 0) as azure, coalesce(ocrspace, 0) as ocrspace from m left join u on strftime(d, '%Y-%m') = u.month")
def agg_month_usage(spark, sf_dir):
    events = view(spark, sf_dir, "v_usage")
    start = F.date_trunc("month", "ts")
    days = events.select(start.alias("first_day")).distinct().union(events.agg((F.date_trunc("month", F.max("ts")) + F.expr("interval 1 month")).alias("first_day"))).distinct()
    return U.month_usage(U.engine_usage(events), days.select(G.month_id(F.col("first_day")).alias("month"), "first_day"))


@query("select strftime(ts, '%Y-%m') as month, cast(sum(delta) as bigint) as calls, round(sum(greatest(coalesce(cost, 0), 0)), 6) as cost from @v_usage where delta > 0 group by 1")
def agg_judge_usage(spark, sf_dir):
    return U.judge_usage(view(spark, sf_dir, "v_usage"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y-%m') as month, event_id % 9 = 0 or ts >= (select max(ts) from @events) - interval 7 days as kept from @events")
def dat_expiry(spark, sf_dir):
    events = view(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    created = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return events.select("event_id", G.iso_z(F.col("ts")).alias("iso"), G.month_id(F.col("ts")).alias("month"), G.not_expired(created, now).alias("kept"))


# --- geometry ----------------------------------------------------------------------


@query("""with z as (select zone_id, x1, y1, x2, y2, w, h, w / 320.0 as sx, h / 200.0 as sy from @v_zones),
a as (select *, greatest(0, least(cast(floor(x1 * sx) as int), w - 1)) as a1, greatest(0, least(cast(floor(y1 * sy) as int), h - 1)) as b1, greatest(1, least(cast(ceil(x2 * sx) as int), w)) as a2, greatest(1, least(cast(ceil(y2 * sy) as int), h)) as b2,
  greatest(0, least(cast(trunc(x1 * sx) as int), w)) as c1, greatest(0, least(cast(trunc(y1 * sy) as int), h)) as d1, greatest(0, least(cast(trunc(x2 * sx) as int), w)) as c2, greatest(0, least(cast(trunc(y2 * sy) as int), h)) as d2 from z)
select zone_id, concat_ws(',', a1, b1, case when a2 <= a1 then least(w, a1 + 1) else a2 end, case when b2 <= b1 then least(h, b1 + 1) else b2 end) as scaled,
case when c2 > c1 and d2 > d1 then concat_ws(',', c1, d1, c2, d2) end as cut, x1 < x2 and y1 < y2 as valid from a""")
def mth_scale_bbox(spark, sf_dir):
    box, source, actual = F.array("x1", "y1", "x2", "y2"), F.array(F.lit(320), F.lit(200)), F.array("w", "h")
    joined = lambda a: F.array_join(a.cast("array<string>"), ",")
    return view(spark, sf_dir, "v_zones").select(
        "zone_id", joined(G.scale_bbox(box, source, actual)).alias("scaled"), joined(G.scale_bbox_cut(box, source, actual)).alias("cut"), G.valid_bbox(box).alias("valid")
    )


@query("""with s as (select zone_id, w, h, greatest(1024.0 / w, 768.0 / h) as k, w < 1024 or h < 768 as small from @v_zones)
select zone_id, small as upscaled, case when small then cast(round_even(w * (greatest(cast(1024 as double) / w, cast(768 as double) / h)), 0) as int) else w end as width, case when small then cast(round_even(h * (greatest(cast(1024 as double) / w, cast(768 as double) / h)), 0) as int) else h end as height from s""")
def mth_upscale(spark, sf_dir):
    return view(spark, sf_dir, "v_zones").select("zone_id", G.upscaled(F.col("w"), F.col("h")).alias("u")).select("zone_id", "u.upscaled", "u.width", "u.height")


_SHA = "sha256(cast(zone_id as varchar))"


@query(f"""with c as (select zone_id, x1, y1, x2, y2, case when zone_id % 31 = 0 then 0 else w end as w, h, case when zone_id % 7 = 0 then 5 else x2 - x1 end as cw, y2 - y1 as ch, zone_id % 23 = 0 as nobox, zone_id % 29 = 0 as short,
  case zone_id % 11 when 0 then '' when 1 then 'xyz' when 2 then {_SHA} else sha256('o' || cast(zone_id as varchar)) end as osha, {_SHA} as csha, case zone_id % 5 when 0 then 0.0 when 1 then 0.001 end as ratio from @v_zones)
select zone_id, case when nobox then 'missing_bbox' when short then 'invalid_bbox' when x2 <= x1 or y2 <= y1 then 'zero_area' when w <= 0 or h <= 0 then 'invalid_original' when cw <= 0 or ch <= 0 then 'invalid_crop' when cw <> x2 - x1 then 'width_mismatch'
when ch <> y2 - y1 then 'height_mismatch' when cw > w or ch > h then 'exceeds_original' when x1 <= 0 and y1 <= 0 and x2 >= w and y2 >= h then 'full_image'
when cast(cw as double) * ch / (cast(w as double) * h) >= case when ratio is null or ratio <= 0 then 0.95 else least(ratio, 0.95) end then 'too_large' when osha = '' then 'missing_hash' when not regexp_matches(osha, '^[0-9a-fA-F]{{64}}$') then 'invalid_hash' when osha = csha then 'identical' end as fault from c""")
def mth_crop_faults(spark, sf_dir):
    n = F.col("zone_id")
    box = F.array("x1", "y1", "x2", "y2")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = sha(n.cast("string"))
    c = {
        "bbox": F.when(n % 23 == 0, None).when(n % 29 == 0, F.slice(box, 1, 2)).otherwise(box), "original_w": F.when(n % 31 == 0, 0).otherwise(F.col("w")), "original_h": F.col("h"),
        "crop_w": F.when(n % 7 == 0, 5).otherwise(F.col("x2") - F.col("x1")), "crop_h": F.col("y2") - F.col("y1"),
        "original_sha256": F.when(n % 11 == 0, "").when(n % 11 == 1, "xyz").when(n % 11 == 2, own).otherwise(sha(F.concat(F.lit("o"), n.cast("string")))), "crop_sha256": own,
        "ratio": F.when(n % 5 == 0, F.lit(0.0)).when(n % 5 == 1, F.lit(0.001)),
    }
    return view(spark, sf_dir, "v_zones").select("zone_id", G.crop_fault(c).alias("fault"))


@query("""with v as (select zone_id, case zone_id % 6 when 0 then '0' when 1 then '0.75' when 2 then '1.5' when 3 then 'high' when 4 then null else '0.93' end as raw, case when zone_id % 12 = 0 then '' else 'x' end as t from @v_zones),
c as (select zone_id, try_cast(raw as double) as n, t from v), k as (select zone_id, case when n between 0 and 1 and not (n = 0 and t = '') then n end as clean, n from c)
select zone_id, clean, case when coalesce(clean, 0) >= 0.8 then 'HIGH' when coalesce(clean, 0) >= 0.5 then 'MEDIUM' else 'LOW' end as band, coalesce(clean, n, -1.0) as picked from k""")
def mth_confidences(spark, sf_dir):
    n = F.col("zone_id")
    raw = F.when(n % 6 == 0, "0").when(n % 6 == 1, "0.75").when(n % 6 == 2, "1.5").when(n % 6 == 3, "high").when(n % 6 == 5, "0.93")
    clean = G.clean_confidence(raw, F.when(n % 12 == 0, "").otherwise("x"))
    return view(spark, sf_dir, "v_zones").select("zone_id", clean.alias("clean"), G.confidence_band(clean).alias("band"), G.first_finite(clean, raw.try_cast("double"), F.lit(-1.0)).alias("picked"))


@query("select zone_id, case when zone_id % 3 < 2 then w end as width, case when zone_id % 3 < 2 then h end as height from @v_zones")
def mth_image_size(spark, sf_dir):
    """Sizes read from image headers that are put together from the zones' sizes."""
    hex4 = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    swap = lambda c: F.concat(F.lpad(F.hex((c % 256).cast("long")), 2, "0"), F.lpad(F.hex(F.floor(c / 256).cast("long")), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex4(F.col("w")), hex4(F.col("h")))
    gif = F.concat(F.lit("474946383961"), swap(F.col("w")), swap(F.col("h")))
    data = F.unhex(F.when(F.col("zone_id") % 3 == 0, png).when(F.col("zone_id") % 3 == 1, gif).otherwise("FFD8FFE0"))
    return view(spark, sf_dir, "v_zones").select("zone_id", G.image_size(data).alias("s")).select("zone_id", "s.width", "s.height")


# --- templates -----------------------------------------------------------------------

_STORES = "select template_name as name, max(zone_id) as n from @v_zones group by 1"


def _stores(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_zones").groupBy(F.col("template_name").alias("name")).agg(F.max("zone_id").alias("n"))
    at = lambda shift: F.expr("timestamp '2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), (F.col("n") + shift).cast("int"))
    main = rows.where("n % 2 = 0").select("name", C.effective_time(F.when(F.col("n") % 3 != 0, at(5).cast("string")), at(0).cast("string")).alias("updated"))
    fallback = rows.where("n % 4 <> 0").select("name", at(1).alias("updated"))
    return main, fallback


_LISTED = f"""with s as ({_STORES}), m as (select name, timestamp '2024-01-01 00:00:00' + (n + case when n % 3 <> 0 then 5 else 0 end) * interval 1 hour as updated from s where n % 2 = 0),
f as (select name, timestamp '2024-01-01 00:00:00' + (n + 1) * interval 1 hour as updated from s where n % 4 <> 0)"""


@query(_LISTED + " select coalesce(m.name, f.name) as name, coalesce(m.updated, f.updated) as updated from m full join f on m.name = f.name")
def src_catalog_listing(spark, sf_dir):
    return C.listing(*_stores(spark, sf_dir))


@query(_LISTED + " select name, updated from f where name not in (select name from m) and updated >= (select max(updated) from f) - interval 7 days")
def join_missing_templates(spark, sf_dir):
    main, fallback = _stores(spark, sf_dir)
    now = F.lit(fallback.agg(F.max("updated")).first()[0])
    return C.missing_from(main, fallback, now)


@query(_LISTED + " select coalesce(m.name, f.name) as name, coalesce(m.updated, f.updated) as created, case when f.name is not null then timestamp '2030-01-01 00:00:00' else m.updated end as updated from m full join f on m.name = f.name")
def dat_merged(spark, sf_dir):
    main, fallback = _stores(spark, sf_dir)
    old = main.select("name", F.col("updated").alias("created"), "updated")
    return C.merged(old, fallback.select("name", F.col("updated").alias("created")), F.expr("timestamp '2030-01-01 00:00:00'"))


def _templates(spark, sf_dir) -> DataFrame:
    n = F.col("zone_id")
    engines = F.when(n % 9 == 0, F.array().cast("array<string>")).when(n % 400 == 7, F.array(F.lit("other"))).otherwise(F.array(F.lit("google")))
    zone = F.struct(
        F.when(n % 500 == 3, " ").otherwise(F.concat("zone_name", n.cast("string"))).alias("name"), F.when(n % 300 == 1, "text").otherwise("ocr").alias("type"), F.array("x1", "y1", "x2", "y2").alias("bbox"),
        engines.alias("engines"), F.lit(None).cast("map<string,string>").alias("engine_config"), F.lit(None).cast("string").alias("notes"),
    )
    key = F.floor(n / 4)
    rows = view(spark, sf_dir, "v_zones").groupBy(key.alias("k")).agg(F.collect_list(zone).alias("zones"), F.max("w").alias("w"))
    return rows.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("template_name"), F.lit(1).alias("schema_version"), F.array("w", F.col("w") - 600).alias("source_size"), "zones")


@query("""with z as (select cast(floor(zone_id / 4) as bigint) as k, zone_id as n, case when zone_id % 9 = 0 then 0 else 1 end as engines, x1 < x2 and y1 < y2 as ok, w from @v_zones),
f as (select 't' || k as template_name, list_filter([case when max(w) - 600 <= 0 then 'source_size' end, case when bool_or(n % 500 = 3) then 'zone_name_empty' end, case when bool_or(n % 300 = 1) then 'zone_type' end, case when bool_or(not ok) then 'zone_bbox' end,
  case when bool_or(n % 400 = 7 and n % 9 <> 0) then 'engine_not_allowed' end, case when bool_or(n % 300 <> 1 and engines = 0) then 'ocr_without_engine' end], lambda x: x is not null) as faults from z group by k)
select template_name, array_to_string(faults, ',') as faults from f where len(faults) > 0""")
def jsn_template_faults(spark, sf_dir):
    return C.template_faults(_templates(spark, sf_dir)).select("template_name", F.array_join("faults", ",").alias("faults"))


@query("select template_name, zone_name as name, count(*) as n from @v_zones group by 1, 2 having count(*) > 1")
def agg_repeated_names(spark, sf_dir):
    return C.repeated_names(view(spark, sf_dir, "v_zones").select("template_name", F.col("zone_name").alias("name")))


_EXPECTED = "(select lang, 'z' || (doc_id % 50) as zone_name, arg_max(text, doc_id) as text from @documents group by 1, 2)"


@query(f"""with e as {_EXPECTED}, r as (select doc_id, case doc_id % 4 when 0 then 'en-GB' when 1 then null when 2 then 'de' else lang end as lang, 'z' || (doc_id % 60) as zone_name from @documents),
k as (select *, case when lower(lang) like 'en%' then 'en' else lower(coalesce(lang, 'und')) end as l from r)
select k.doc_id, k.zone_name, md5(coalesce(o.text, g.text)) as digest from k left join e o on o.lang = k.l and o.zone_name = k.zone_name left join e g on g.lang = 'en' and g.zone_name = k.zone_name""")
def join_expected_text(spark, sf_dir):
    docs = view(spark, sf_dir, "documents")
    n = F.col("doc_id")
    name = lambda k: F.concat(F.lit("z"), (n % k).cast("string"))
    texts = docs.groupBy("lang", name(50).alias("zone_name")).agg(F.max_by("text", "doc_id").alias("text"))
    nested = texts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("zone_name", "text"))).alias("m"))
    template = nested.agg(F.map_from_entries(F.collect_list(F.struct("lang", "m"))).alias("expected_texts")).withColumn("template_name", F.lit("t"))
    lang = F.when(n % 4 == 0, "en-GB").when(n % 4 == 1, None).when(n % 4 == 2, "de").otherwise(F.col("lang"))
    rows = docs.select("doc_id", lang.alias("lang"), name(60).alias("zone_name"))
    out = C.with_expected(rows, C.expected_texts(template).drop("template_name"))
    return out.select("doc_id", "zone_name", F.md5(F.col("expected_text").cast("binary")).alias("digest"))


@query("""with z as (select template_name, string_agg(target_id || '::' || zone_name || '{"phase2_target_id":"' || target_id || '","phase2_zone_name":"' || zone_name || '"}', ';' order by zone_id) as zones from @v_zones group by 1) select * from z""")
def jsn_build_templates(spark, sf_dir):
    out = C.built_templates(view(spark, sf_dir, "v_zones").select("template_name", F.col("zone_id").alias("ord"), "target_id", "zone_name", F.array("x1", "y1", "x2", "y2").alias("bbox")))
    return out.select("template_name", F.array_join(F.transform("zones", lambda z: F.concat(z["name"], z["notes"])), ";").alias("zones"))


@query("select zone_id, case when zone_id % 4 < 2 then target_id end as target_id, case when zone_id % 4 = 0 then zone_name end as zone_name from @v_zones")
def jsn_zone_notes(spark, sf_dir):
    n = F.col("zone_id")
    notes = F.when(n % 4 == 0, F.to_json(F.struct(F.col("target_id").alias("phase2_target_id"), F.col("zone_name").alias("phase2_zone_name")))).when(
        n % 4 == 1, F.to_json(F.struct(F.col("target_id").alias("phase2_target_id")))
    ).when(n % 4 == 2, "not json").otherwise('{"phase2_target_id": " "}')
    return view(spark, sf_dir, "v_zones").select("zone_id", R.zone_notes(notes).alias("m")).select("zone_id", "m.target_id", "m.zone_name")


@query("with a as (select request_id, attempt, text from @v_attempts where attempt <= 3 and coalesce(text, '') <> '') select r.request_id, min(a.attempt) as attempt, md5(arg_min(a.text, a.attempt)) as digest from (select distinct request_id from @v_attempts) r left join a on a.request_id = r.request_id group by 1")
def win_first_success(spark, sf_dir):
    out = C.first_success(view(spark, sf_dir, "v_attempts"), 3)
    return out.select("request_id", "attempt", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- responses ---------------------------------------------------------------------------


@query("""select zone_id, string_agg(engine || '=' || md5(coalesce(text, '')) || '/' || coalesce(cast(round(confidence, 4) as varchar), 'none'), ';' order by engine) as entries from @v_readings group by 1""")
def jsn_engine_map(spark, sf_dir):
    maps = O.engine_maps(view(spark, sf_dir, "v_readings"))
    parsed = F.from_json("engines", "map<string,struct<text string, confidence double>>")
    entry = lambda e: F.concat(
        e["key"], F.lit("="), F.md5(F.coalesce(e["value"]["text"], F.lit("")).cast("binary")), F.lit("/"), F.coalesce(e["value"]["confidence"].cast("string"), F.lit("none"))
    )
    return maps.select("zone_id", F.array_join(F.transform(F.map_entries(parsed), entry), ";").alias("entries"))


_STRIPPED = f"regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), {D.q(f'(?m)^#+[{T.WS}]*')}, '', 'g')"


@query(f"""select doc_id, case when doc_id % 8 <> 0 and doc_id % 8 <> 7 then md5({_STRIPPED}) end as digest, case when doc_id % 8 in (1, 2, 3, 4, 5, 6) then round((doc_id % 100 / 100.0 + 0.5) / 2, 6) end as confidence from @documents""")
def jsn_block_response(spark, sf_dir):
    n = F.col("doc_id")
    lines = F.split(F.col("text"), "\n")
    words = F.array(F.struct((n % 100 / 100).alias("confidence")), F.struct(F.lit(0.5).alias("confidence")), F.struct(F.lit(None).cast("double").alias("confidence")))
    line = F.transform(lines, lambda x, i: F.struct(x.alias("text"), F.when(i == 0, words).alias("words")))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(line.alias("lines"))).alias("blocks")).alias("readResult")))
    body = F.when(n % 8 == 0, '{"readResult": {"blocks": []}}').when(n % 8 == 7, "{broken").otherwise(body)
    return view(spark, sf_dir, "documents").select("doc_id", R.from_blocks(body).alias("r")).select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"), F.round("r.confidence", 6).alias("confidence"))


@query(f"select doc_id, case when doc_id % 5 in (0, 1) then md5({_STRIPPED}) end as digest from @documents")
def jsn_flat_response(spark, sf_dir):
    n = F.col("doc_id")
    text = F.when(n % 5 == 4, "## ...").otherwise(F.col("text"))
    body = F.to_json(F.struct((n % 5 == 2).alias("IsErroredOnProcessing"), F.when((n % 5).isin(0, 1, 2, 4), n % 5 % 2 + 1).otherwise(4).cast("int").alias("OCRExitCode"), F.array(F.struct(text.alias("ParsedText"))).alias("ParsedResults")))
    return view(spark, sf_dir, "documents").select("doc_id", R.from_flat(body).alias("r")).select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"))


@query("""select doc_id, case when doc_id % 7 <> 0 then md5(case when doc_id % 2 = 0 then trim(text, ' ' || chr(9) || chr(10) || chr(13)) else 'first ' || doc_id end) end as digest, case when doc_id % 7 <> 0 then round(case when doc_id % 10 = 0 then 0.4 else (doc_id % 10 / 10.0 + 0.4) / 2 end, 6) end as confidence from @documents""")
def jsn_annotation_response(spark, sf_dir):
    n = F.col("doc_id")
    blocks = F.array(F.struct((n % 10 / 10).alias("confidence")), F.struct(F.lit(0.4).alias("confidence")))
    full = F.struct(F.col("text"), F.array(F.struct(blocks.alias("blocks"))).alias("pages"))
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("first "), n.cast("string")).alias("description"))).alias("textAnnotations"), full.alias("fullTextAnnotation")))
    body = F.when(n % 7 == 0, '{"error": {"message": "quota"}}').otherwise(body)
    mode = F.when(n % 2 == 0, " Document ").otherwise("text")
    out = view(spark, sf_dir, "documents").select("doc_id", R.from_annotation(body, mode).alias("r"))
    return out.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"), F.round("r.confidence", 6).alias("confidence"))


@query("""select item_id, case when item_id % 5 = 4 then null when item_id % 3 = 0 then 'fail' else 'pass' end as verdict, case when item_id % 5 <> 4 then md5(substr(text, 1, 300)) end as reason,
case when item_id % 5 <> 4 then case when item_id % 3 = 0 then md5(substr(text, 1, 120)) else '' end end as first_ocr, case when item_id % 4 <> 3 then item_id / 1000.0 end as cost from @benchmark""")
def jsn_judge_reply(spark, sf_dir):
    n = F.col("item_id")
    diff = F.array(F.struct(F.col("text").alias("ocr"), F.lit("r").alias("ref"), F.lit("word").alias("kind")))
    real = F.when(n % 3 == 0, diff).otherwise(F.array().cast(f"array<{R.DIFF}>"))
    whole = F.to_json(F.struct(F.lit("pass").alias("verdict"), F.col("text").alias("reason"), real.alias("real_differences"), F.array().cast(f"array<{R.DIFF}>").alias("ocr_noise")))
    body = F.when(n % 5 == 0, whole).when(n % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n % 5 == 2, F.concat(F.lit("Sure: "), whole, F.lit(" Done."))).when(n % 5 == 3, F.concat(F.lit(" "), whole)).otherwise("no json here")
    usage = F.when(n % 4 == 3, '{"usage": {"cost": "free"}}').otherwise(F.concat(F.lit('{"usage": {"cost": '), (n / 1000).cast("string"), F.lit("}}")))
    out = view(spark, sf_dir, "benchmark").select("item_id", R.judge_reply(body).alias("r"), R.judge_cost(usage).alias("cost"))
    first = F.coalesce(F.get("r.real_differences", F.lit(0))["ocr"], F.when(F.col("r").isNotNull(), ""))
    digest = lambda c: F.md5(c.cast("binary"))
    return out.select("item_id", "r.verdict", digest(F.col("r.reason")).alias("reason"), F.when(first == "", "").otherwise(digest(first)).alias("first_ocr"), "cost")


@query(f"select doc_id, len(list_filter(string_split({D.collapse('text')}, ' '), lambda x: x <> '')) <= 3 or coalesce(case when doc_id % 3 <> 0 then doc_id % 100 / 100.0 end < 0.4, false) as partial from @documents")
def agg_partial_readings(spark, sf_dir):
    from proofmill.config import DEFAULT

    confidence = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100 / 100)
    return view(spark, sf_dir, "documents").select("doc_id", R.partial(F.col("text"), confidence, DEFAULT).alias("partial"))
