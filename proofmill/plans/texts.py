"""Queries on texts: normalisation, comparison, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, PLACEHOLDERS
from proofmill.functions import compare as C
from proofmill.functions import text as T
from proofmill.operators import matching as X
from proofmill.operators import sections as S
from proofmill.operators import vote as V
from proofmill.plans import duck as D
from proofmill.plans.registry import query
from proofmill.plans.views import view

FR = "lower(coalesce(lang, '')) = 'fr'"


def _form(spark, sf_dir, form) -> DataFrame:
    rows = view(spark, sf_dir, "v_dirty").withColumn("out", form(F.col("text"), F.col("lang")))
    return rows.select("doc_id", F.length("out").cast("long").alias("n"), F.md5(F.col("out").cast("binary")).alias("digest"))


def _oracle(form: str) -> str:
    return f"with f as (select doc_id, {form} as o from @v_dirty) select doc_id, cast(length(o) as bigint) as n, md5(o) as digest from f"


@query("with f as (select doc_id, nfc_normalize(text) as o from @v_dirty) select doc_id, cast(length(o) as bigint) as n, md5(o) as digest from f")
def nrm_composed(spark, sf_dir):
    rows = T.composed(view(spark, sf_dir, "v_dirty"), "text")
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(_oracle(D.pre("text", FR)))
def nrm_pre_clean(spark, sf_dir):
    return _form(spark, sf_dir, T.pre_clean)


@query(_oracle(D.sub("text", r"(?i)\bAcmeLive\b", "")))
def nrm_brand(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.remove_brand(t, "AcmeLive"))


@query(_oracle(D.sub("text", T.PLACEHOLDER, " ")))
def nrm_placeholders(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.remove_placeholders(t))


_MARKED = "select doc_id, case doc_id % 4 when 0 then '50% x %skin% 7%' when 1 then '%% skin%%date% [a [skin] < Username ><b>' when 2 then '[first_name]%bonus_amount%%x<y>%skin%' else '' end || text as text from @v_dirty"


def _pairs(x: str, a: str, b: str) -> str:
    """DuckDB SQL: x with the pairs of marks around known names replaced by a space, from the left."""
    pattern = D.q(f"{a}[^{b}]+{b}")
    names = ", ".join(D.q(n) for n in PLACEHOLDERS)
    return (
        f"list_reduce(list_concat([''], list_transform(list_zip(string_split_regex({x}, {pattern}), regexp_extract_all({x}, {pattern})), lambda z: z[1] || "
        f"coalesce(case when lower(trim(substr(z[2], 2, length(z[2]) - 2), {D.q(T.WS_CHARS)})) in ({names}) then ' ' else z[2] end, ''))), lambda p, q: p || q)"
    )


@query(f"with m as ({_MARKED}), a as (select doc_id, {_pairs('text', '%', '%')} as t from m), b as (select doc_id, {_pairs('t', chr(92) + '[', chr(92) + ']')} as t from a) select doc_id, md5({_pairs('t', '<', '>')}) as digest from b")
def nrm_placeholder_pairs(spark, sf_dir):
    head = F.expr("case doc_id % 4 when 0 then '50% x %skin% 7%' when 1 then '%% skin%%date% [a [skin] < Username ><b>' when 2 then '[first_name]%bonus_amount%%x<y>%skin%' else '' end")
    rows = view(spark, sf_dir, "v_dirty").select("doc_id", F.concat(head, "text").alias("text"))
    return rows.select("doc_id", F.md5(T.remove_paired_placeholders("text").cast("binary")).alias("digest"))


@query(f"select doc_id, regexp_matches(text, {D.q(T.PLACEHOLDER)}) as has_placeholder, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') as readable from @v_dirty")
def nrm_flags(spark, sf_dir):
    return view(spark, sf_dir, "v_dirty").select("doc_id", T.has_placeholder("text").alias("has_placeholder"), T.has_letter_or_digit("text").alias("readable"))


@query(_oracle(D.strict("text", FR)))
def nrm_strict(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, lang: T.normalize(t, "strict", lang))


@query(_oracle(D.soft("text", FR)))
def nrm_soft(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, lang: T.normalize(t, "soft", lang))


@query(_oracle(D.consensus("text")))
def nrm_consensus(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.normalize(t, "consensus"))


@query(_oracle(D.display("text", FR)))
def nrm_display(spark, sf_dir):
    return _form(spark, sf_dir, T.clean_for_display)


@query(_oracle(D.table_view("text")))
def nrm_table_view(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.table_view(t))


@query(_oracle(f"lower({D.sub(D.display('text', FR), r'[\[\]<>()]', ' ')})"))
def nrm_judge_form(spark, sf_dir):
    return _form(spark, sf_dir, T.judge_form)


@query(_oracle(D.sub("text", rf"(?m)^#+[{T.WS}]*", "")))
def nrm_heading_marks(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.strip_heading_marks(t))


@query(_oracle(D.collapse("text")))
def nrm_whitespace(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: T.collapse(t))


@query(_oracle(f"array_to_string({D.lines('text', D.soft)}, chr(10))"))
def nrm_lines(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: F.array_join(T.normalized_lines(t, "soft"), "\n"))


@query(_oracle("substr(text, 1, 2000)"))
def nrm_truncate(spark, sf_dir):
    return _form(spark, sf_dir, lambda t, _: F.substring(t, 1, 2000))


_COMPARED = f"""
with n as (select zone_id, lang, text, ref, {D.soft('text')} as a, {D.soft('ref')} as b, {D.lines('text', D.soft)} as la, {D.lines('ref', D.soft)} as lb from @v_refs),
m as (select *, case when a = b then 'exact' when len(la) > 0 and list_sort(la) = list_sort(lb) then 'line_multiset' else 'none' end as mode, {D.similarity('a', 'b')} as s from n)
"""


@query(_COMPARED + "select zone_id, mode <> 'none' as pass, mode, round(s, 6) as similarity, cast(len(la) as int) as lines_ocr, cast(len(lb) as int) as lines_ref from m")
def cmp_lines(spark, sf_dir):
    rows = C.compared(view(spark, sf_dir, "v_refs"), "c", F.col("text"), F.col("ref"))
    return rows.select("zone_id", "c.pass", "c.mode", F.round("c.similarity", 6).alias("similarity"), "c.lines_ocr", "c.lines_ref")


@query(f"""
with n as (select zone_id, list_distinct(list_filter(string_split({D.soft('text')}, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split({D.soft('ref')}, ' '), lambda x: x <> '')) as b from @v_refs)
select zone_id, round(case when len(a) > 0 and len(b) > 0 then cast(len(list_intersect(a, b)) as double) / len(list_distinct(list_concat(a, b))) else 0.0 end, 6) as overlap from n""")
def cmp_jaccard(spark, sf_dir):
    sets = F.struct(C.word_set(T.normalize("text", "soft")).alias("a"), C.word_set(T.normalize("ref", "soft")).alias("b"))
    rows = C.once(view(spark, sf_dir, "v_refs"), "w", sets)
    return rows.select("zone_id", F.round(C.jaccard(F.col("w.a"), F.col("w.b")), 6).alias("overlap"))


@query("select doc_id, cast(case when doc_id % 3 = 0 then length(regexp_replace(text, '\\s', '', 'g')) else len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) end as int) as n from @documents")
def fun_token_count(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 3 == 0, "zh-hans").otherwise(F.col("lang"))
    return view(spark, sf_dir, "documents").select("doc_id", S.token_count(F.col("text"), lang).alias("n"))


@query()
def cmp_closest_engine(spark, sf_dir):
    return C.closest_engine(view(spark, sf_dir, "v_readings").where("error is null"), view(spark, sf_dir, "v_refs").select("zone_id", F.col("ref").alias("text")))


@query(f"""
with a as (select zone_id, unnest(list_filter(string_split(lower({D.collapse(D.table_view('text'))}), ' '), lambda x: x <> '')) as token from @v_refs),
b as (select zone_id, unnest(list_filter(string_split(lower({D.collapse(D.table_view('ref'))}), ' '), lambda x: x <> '')) as token from @v_refs),
an as (select zone_id, token, row_number() over (partition by zone_id, token) as n from a), bn as (select zone_id, token, row_number() over (partition by zone_id, token) as n from b)
select coalesce(an.zone_id, bn.zone_id) as zone_id, coalesce(an.token, bn.token) as token, coalesce(an.n, bn.n) as n, case when bn.n is null then 'del' else 'add' end as op
from an full join bn on an.zone_id = bn.zone_id and an.token = bn.token and an.n = bn.n where an.n is null or bn.n is null""")
def cmp_token_diff(spark, sf_dir):
    return C.token_differences(view(spark, sf_dir, "v_refs"))


@query(f"""
with t as (select zone_id, list_filter(string_split(lower({D.collapse(D.table_view('text'))}), ' '), lambda x: x <> '') as a, list_filter(string_split(lower({D.collapse(D.table_view('ref'))}), ' '), lambda x: x <> '') as b from @v_refs)
select zone_id, cast(len(b) - len(a) as bigint) as grown, md5(array_to_string(b, ' ')) as patched from t where a <> b""")
def cmp_ordered_diff(spark, sf_dir):
    """Readings that their ordered differences turn into the references."""
    changed = C.ordered_differences(view(spark, sf_dir, "v_refs"))
    steps = lambda op: F.size(F.filter("ops", lambda x: x["op"] == op))
    patched = F.md5(F.array_join(C.patched(F.col("tokens"), F.col("ops")), " ").cast("binary"))
    return changed.select("zone_id", (steps("add") - steps("del")).cast("long").alias("grown"), patched.alias("patched"))


@query(_COMPARED + """select zone_id, e is not null and l <> '' as applied, case when l = '' then 'lang_missing' when e is null then 'expected_text_missing' end as skip_reason,
case when e is not null and l <> '' then round(s, 4) end as similarity, case when e is not null and l <> '' then mode <> 'none' end as match_pass,
case when e is not null and l <> '' then mode end as match_mode, case when e is not null and l <> '' then s < 0.85 end as below, case when e is not null and l <> '' then printf('%.2f%%', round(s, 4) * 100) end as shown
from (select *, case when zone_id % 9 = 0 then '' else coalesce(lang, '') end as l, case when zone_id % 8 <> 0 then ref end as e from m)""")
def cmp_validation(spark, sf_dir):
    rows = view(spark, sf_dir, "v_refs").withColumn("lang", F.when(F.col("zone_id") % 9 == 0, "").otherwise(F.col("lang")))
    rows = C.validation(rows.withColumn("expected_text", F.when(F.col("zone_id") % 8 != 0, F.col("ref"))))
    v = "validation"
    return rows.select("zone_id", f"{v}.applied", f"{v}.skip_reason", f"{v}.similarity", f"{v}.match_pass", f"{v}.match_mode", f"{v}.below", F.when(F.col(f"{v}.applied"), C.as_percent(F.col(f"{v}.similarity"))).alias("shown"))


_NUMBERS = "list_transform(regexp_extract_all({}, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*'), lambda x: translate(x, '.,', ''))"


@query(f"select zone_id, array_to_string({_NUMBERS.format('en_text')}, ' ') as numbers from @v_facts")
def cmp_numbers(spark, sf_dir):
    return view(spark, sf_dir, "v_facts").select("zone_id", F.array_join(C.numbers("en_text"), " ").alias("numbers"))


@query(f"""
with n as (select zone_id, lang, list_distinct({_NUMBERS.format('en_text')}) as e, list_distinct({_NUMBERS.format('loc_text')}) as l from @v_facts),
f as (select *, list_filter(e, lambda x: not list_contains(l, x)) as m, list_filter(l, lambda x: not list_contains(e, x)) as x from n)
select zone_id, lang, array_to_string(list_sort(m), ',') as missing, array_to_string(list_sort(x), ',') as extra, array_to_string(list_sort(e), ',') as en_numbers from f where len(m) > 0""")
def cmp_number_facts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_facts")
    english, local = rows.select("zone_id", "en_text"), rows.select("zone_id", "lang", "loc_text")
    facts = local.join(english, "zone_id").select("zone_id", "lang", C.number_facts(F.col("en_text"), F.col("loc_text")).alias("f")).where("f is not null")
    joined = lambda c: F.array_join(F.col(f"f.{c}"), ",").alias(c)
    return facts.select("zone_id", "lang", joined("missing"), joined("extra"), joined("en_numbers"))


@query(f"""
with e as (select zone_id, unnest(list_distinct({_NUMBERS.format('en_text')})) as fact from @v_facts), l as (select zone_id, unnest(list_distinct({_NUMBERS.format('loc_text')})) as fact from @v_facts)
select zone_id, fact, 'missing' as side from (select * from e except select * from l) union all select zone_id, fact, 'extra' as side from (select * from l except select * from e)""")
def set_fact_differences(spark, sf_dir):
    rows = view(spark, sf_dir, "v_facts")
    facts = lambda c: rows.select("zone_id", F.explode(F.array_distinct(C.numbers(c))).alias("fact"))
    en, local = facts("en_text"), facts("loc_text")
    return en.exceptAll(local).withColumn("side", F.lit("missing")).unionByName(local.exceptAll(en).withColumn("side", F.lit("extra")))


@query(f"""
with a as (select zone_id, unnest({D.lines('text', D.soft)}) as line from @v_refs), b as (select zone_id, unnest({D.lines('ref', D.soft)}) as line from @v_refs),
d as (select zone_id from (select * from a except all select * from b) union select zone_id from (select * from b except all select * from a))
select zone_id from @v_refs where zone_id not in (select zone_id from d)""")
def set_equal_lines(spark, sf_dir):
    rows = view(spark, sf_dir, "v_refs")
    # Rows whose own lines are equal add as much to either side: only the others are counted.
    sides = F.struct(*(T.normalized_lines(c, "soft").alias(c) for c in ("text", "ref")))
    left = C.once(rows.where(~F.col("text").eqNullSafe(F.col("ref"))), "l", sides).where(F.array_sort("l.text") != F.array_sort("l.ref"))
    marked = lambda c, n: F.transform(f"l.{c}", lambda x: F.struct(x.alias("line"), F.lit(n).alias("n")))
    counts = left.select("zone_id", F.explode(F.concat(marked("text", 1), marked("ref", -1))).alias("o")).groupBy("zone_id", F.col("o.line").alias("line")).agg(F.sum("o.n").alias("n"))
    return rows.select("zone_id").join(counts.where("n <> 0").select("zone_id").distinct(), "zone_id", "left_anti")


@query(_COMPARED + "select zone_id, round(s, 4) as similarity from m where mode = 'none' and s >= 0.75 and s <= 0.99")
def cmp_grey_zone(spark, sf_dir):
    return C.grey_zone(view(spark, sf_dir, "v_refs")).select("zone_id", F.round("similarity", 4).alias("similarity"))


# Texts of lengths that rule the zone out have no distance.
@query(f"""
with n as (select zone_id, {D.soft('text')} as a, {D.soft('ref')} as b, {D.lines('text', D.soft)} as la, {D.lines('ref', D.soft)} as lb from @v_refs),
m as (select zone_id, a, b from n where a <> b and not (len(la) > 0 and list_sort(la) = list_sort(lb)) and least(length(a), length(b)) >= 0.75 * greatest(length(a), length(b))),
s as (select zone_id, {D.whole_similarity('a', 'b')} as s from m)
select zone_id, round(s, 4) as similarity from s where s >= 0.75 and s <= 0.99""")
def cmp_grey_zone_whole(spark, sf_dir):
    out = C.grey_zone(view(spark, sf_dir, "v_refs"), whole=True)
    return out.select("zone_id", F.round("similarity", 4).alias("similarity"))


@query("""
with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from @embeddings where not (vec_id % 2 = 0 and label = 7)),
c as (select vec_id, label, list_transform(v, lambda x: x - list_avg(v)) as v from v),
p as (select z.vec_id, max(list_dot_product(z.v, t.v) / sqrt(list_dot_product(z.v, z.v) * list_dot_product(t.v, t.v))) as s from c z left join c t on z.label = t.label and t.vec_id % 2 = 0 where z.vec_id % 2 = 1 group by 1)
select vec_id, round(s, 4) as score, case when s is null then 'logo_template_missing' when s >= 0.7 then 'OK' else 'logo_mismatch' end as status from p""")
def cmp_vectors(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    even = F.col("vec_id") % 2 == 0
    return X.match_scores(rows.where(~even), rows.where(even & (F.col("label") != 7)))


@query("""
with c as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from @v_crops),
t as (select vec_id as tid, label, list_transform(embedding, lambda x: cast(x as double)) as v, len(embedding) as n from @v_templates),
s as (select *, unnest([0.6::double, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.4]) as f from t),
m as (select *, cast(greatest(round_even(n * f, 0), 1) as int) as m, list_concat([0.0], list_transform(range(1, n + 1), lambda k: list_sum(v[1:k])), [0.0]) as p from s where round_even(n * f, 0) >= 8),
e as (select tid, label, m, n, v, p, list_transform(range(0, m + 1), lambda j: cast(j * n as double) / m) as x from m),
a as (select tid, label, m, n, list_transform(x, lambda y: p[cast(floor(y) as int) + 1] + (y - floor(y)) * coalesce(v[cast(floor(y) as int) + 1], 0.0)) as q from e),
z as (select tid, label, m, list_transform(range(1, m + 1), lambda j: (q[j + 1] - q[j]) * m / n) as r from a),
w as (select c.vec_id, z.m, z.r, c.v, unnest(range(0, len(c.v) - z.m + 1)) as o from c join z on c.label = z.label and z.m <= len(c.v)),
k as (select vec_id, m, r, v[o + 1:o + m] as u from w),
g as (select vec_id, (list_dot_product(u, r) - list_sum(u) * list_sum(r) / m) / sqrt((list_dot_product(u, u) - list_sum(u) * list_sum(u) / m) * (list_dot_product(r, r) - list_sum(r) * list_sum(r) / m)) as score from k),
b as (select vec_id, max(score) as score from g group by 1)
select c.vec_id, round(b.score, 4) as score, case when c.label not in (select label from t) then 'logo_template_missing' when b.score is null then 'logo_template_larger_than_zone' when b.score >= 0.7 then 'OK' else 'logo_mismatch' end as status
from c left join b on c.vec_id = b.vec_id""")
def cmp_vector_matches(spark, sf_dir):
    return X.match_scores(view(spark, sf_dir, "v_crops"), view(spark, sf_dir, "v_templates"), DEFAULT.vector_scales)


_GROUPED = f"""
with r as (select zone_id, engine, coalesce(text, '') as text, error, case when error is null then {D.consensus('text')} end as norm from SOURCE),
g as (select zone_id, norm, count(*) as n, min(engine) as engine from r where norm is not null group by 1, 2),
b as (select zone_id, arg_min(engine, (-n, norm)) as engine, max(n) as size from g group by 1),
l as (select zone_id, arg_min(engine, (-length(norm), text, engine)) as engine from r where norm is not null group by 1),
z as (select zone_id, count(*) as n_readings, count(norm) as n_valid from r group by 1),
p as (select z.*, coalesce(b.size, 0) as size, case when b.size >= 2 then b.engine else l.engine end as engine from z left join b using (zone_id) left join l using (zone_id)),
v as (select p.zone_id, p.engine, r.text, case when size >= 2 then case when n_readings >= 3 then 'majority_2_of_3' else 'match_2' end when n_valid > 0 then 'no_confidence_fallback' end as rule,
  case when size >= 2 then 'OK' else 'MANUAL' end as status, case when n_valid = 0 then 'all_engines_failed' when size < 2 then 'no_consensus' end as reason, n_readings, n_valid
  from p left join r on p.zone_id = r.zone_id and p.engine = r.engine)
"""


def _grouped(source: str) -> str:
    return _GROUPED.replace("SOURCE", source)


def _voted(votes: DataFrame, *more: str) -> DataFrame:
    return votes.select("zone_id", "engine", F.md5(F.col("text").cast("binary")).alias("digest"), "rule", "status", "reason", "n_readings", "n_valid", *more)


@query(_grouped("@v_readings") + "select zone_id, engine, md5(text) as digest, rule, status, reason, n_readings, n_valid from v")
def agg_majority_vote(spark, sf_dir):
    return _voted(V.majority_vote(view(spark, sf_dir, "v_readings")))


@query(_grouped("(select * from @v_readings where trim(coalesce(text, '')) <> '')") + "select zone_id, engine, md5(text) as digest, rule, status, reason, n_readings, n_valid, coalesce(rule = 'no_confidence_fallback' and n_valid >= 2, false) as engines_disagree from v")
def agg_session_vote(spark, sf_dir):
    return _voted(V.disagreement(V.majority_vote(view(spark, sf_dir, "v_readings"), drop_empty=True)), "engines_disagree")


_ASKED = "(select zone_id, engine, case when zone_id % 13 = 0 and engine = 'azure' then null else text end as text, error from @v_readings)"


@query(_grouped(f"(select zone_id, engine, coalesce(text, '') as text, coalesce(error, case when text is null then 'engine_no_result' end) as error from {_ASKED} where zone_id % 19 <> 0 and (zone_id % 5 <> 1 or engine <> 'ocrspace'))") + """
select zone_id, engine, rule, status, reason, n_readings, n_valid from v
union all select doc_id, null, null, 'MANUAL', 'no_engines_configured', 0, 0 from @documents where doc_id % 19 = 0""")
def agg_zone_votes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_readings").withColumn("text", F.when((F.col("zone_id") % 13 == 0) & (F.col("engine") == "azure"), None).otherwise(F.col("text")))
    two, three = F.array(F.lit("google"), F.lit("azure")), F.array(F.lit("google"), F.lit("azure"), F.lit("ocrspace"))
    asked = F.when(F.col("doc_id") % 19 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 5 == 1, two).otherwise(three)
    zones = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("zone_id"), asked.alias("engines"))
    return V.zone_votes(zones, rows).drop("text")


@query("select zone_id, arg_min(engine, (-coalesce(confidence, -1), engine)) as engine, max(confidence) as confidence from @v_readings group by 1")
def agg_best_confidence(spark, sf_dir):
    return V.best_by_confidence(view(spark, sf_dir, "v_readings"))


@query("""with r as (select floor(zone_id / 3) as g, bool_or(coalesce(error is not null, false)) as failed, count(*) filter (where error is not null) as n from @v_readings group by 1)
select cast(g as bigint) as image_id, failed, n from r""")
def agg_any_failed(spark, sf_dir):
    rows = view(spark, sf_dir, "v_readings").withColumn("image_id", F.floor(F.col("zone_id") / 3))
    bad = F.col("error").isNotNull()
    return rows.groupBy("image_id").agg(F.bool_or(bad).alias("failed"), F.count_if(bad).alias("n"))

