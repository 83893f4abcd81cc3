"""Queries on packs and archives: sections, selection, paths, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.config import (
    AVOIDED_NAMES,
    COMPOSITE_LANGUAGES,
    IMAGE_EXTENSIONS,
    LANGUAGE_ALIASES,
    LANGUAGES,
    NOT_LANGUAGES,
    PREFERRED_NAMES,
    TEXT_EXTENSIONS,
    VARIANT_PREFIXES,
)
from proofmill.functions import paths as P
from proofmill.functions import text as T
from proofmill.operators import manifest as M
from proofmill.operators import sections as S
from proofmill.plans import duck as D
from proofmill.plans.registry import query
from proofmill.plans.views import view


def _strip(x: str) -> str:
    return D.sub(f"coalesce({x}, '')", rf"^[{T.WS}]+|[{T.WS}]+$", "")


def _group(x: str, k: int) -> str:
    return f"regexp_extract({x}, {D.q(S.HEADER)}, {k})"


_NAME = _strip(D.sub(_group("line", 2), rf"^[{T.WS}{S.STOPS}]+", ""))
_IS_HEADER = f"regexp_matches(line, {D.q(S.HEADER)})"
_LETTERS = "regexp_replace({}, '[^\\p{{L}}]', '', 'g')"
_CAPITALS = "regexp_replace({}, '[^\\p{{Lu}}]', '', 'g')"


def _likely(n: str) -> str:
    words = f"len(list_filter(string_split({D.collapse(n)}, ' '), lambda x: x <> ''))"
    letters = f"length({_LETTERS.format(n)})"
    return f"({n} <> '' and not regexp_matches({n}, '[!?.,:;]$') and {words} <= 4 and {letters} > 0 and cast(length({_CAPITALS.format(n)}) as double) / greatest({letters}, 1) >= 0.6)"


def pack_lines(spark, sf_dir) -> DataFrame:
    """(pack_id, line_no, line) of the packs."""
    rows = view(spark, sf_dir, "v_pack_texts").select("pack_id", "ord", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    return rows.select("pack_id", (F.col("ord") * 1_000_000 + F.col("pos")).alias("line_no"), "line")


_LINES = "select pack_id, ord * 1000000 + unnest(range(len(string_split(body, chr(10))))) as line_no, unnest(string_split(body, chr(10))) as line from @v_pack_texts"


@query(f"""
with l0 as ({_LINES}), l as (select pack_id, line_no, {_strip('line')} as line from l0),
n as (select *, {_NAME} as hname from l), h as (select *, {_IS_HEADER} and {_likely('hname')} as head, line = '' as blank from n),
w as (select *, sum(case when blank then 0 else 1 end) over (partition by pack_id order by line_no rows unbounded preceding) as stretch, count(*) filter (where head) over (partition by pack_id) as headers from h),
x as (select *, sum(cast(blank as int)) over (partition by pack_id, stretch order by line_no rows unbounded preceding) as blanks from w),
y as (select *, case when headers >= 2 then sum(case when head or (blank and blanks = 2) then 1 else 0 end) over (partition by pack_id order by line_no rows unbounded preceding) else 0 end as ord from x),
g as (select pack_id, ord, max(headers) >= 2 as numbered, first(head order by line_no) as head, first(line order by line_no) as line, first(hname order by line_no) as hname,
  coalesce(string_agg(line, chr(10) order by line_no) filter (where not (head and headers >= 2)), '') as content from y group by 1, 2),
o as (select pack_id, cast(ord as bigint) as ord, case when numbered and head then cast({_group('line', 1)} as int) end as section_no, case when numbered and head then hname else 'UNKNOWN' end as name,
  {_strip('content')} as content, case when numbered and head then line else '' end as raw_header from g)
select pack_id, ord, section_no, name, md5(content) as digest, raw_header from o where content <> '' or raw_header <> ''""")
def win_segment_lines(spark, sf_dir):
    rows = S.segment_lines(pack_lines(spark, sf_dir))
    return rows.select("pack_id", F.col("ord").cast("long").alias("ord"), "section_no", "name", F.md5(F.col("content").cast("binary")).alias("digest"), "raw_header")


_STYLED = "(select pack_id, line_no as ord, case when line_no % 1000000 = 0 and pack_id % 2 = 0 then 'Heading 2' else 'Normal' end as style, case when line_no % 1000000 = 0 and pack_id % 4 = 0 then 'PLAIN TITLE' else line end as text from (" + _LINES + "))"


@query(f"""
with p as (select pack_id, ord, style, {_strip('text')} as line from {_STYLED} where pack_id % 5 <> 4 or ord % 1000000 <> 0),
n as (select *, {_IS_HEADER} as hdr, {_NAME} as hname from p where line <> ''), s as (select *, hdr or regexp_matches(style, '(?i)^\\s*heading\\s*\\d+\\b') as starts from n),
c as (select *, sum(cast(starts as int)) over (partition by pack_id order by ord rows unbounded preceding) as cut, bool_or(starts) over (partition by pack_id) as cutting from s)
select pack_id, cast(cut as bigint) as ord, max(case when starts and hdr then cast({_group('line', 1)} as int) end) as section_no,
  coalesce(max(case when starts and hdr then hname end), max(case when starts then line end), 'UNKNOWN') as name,
  md5(coalesce(string_agg(line, chr(10) order by ord) filter (where not starts), '')) as digest, coalesce(max(case when starts then line end), '') as raw_header
from c where cutting group by pack_id, cut""")
def win_segment_paragraphs(spark, sf_dir):
    rows = pack_lines(spark, sf_dir)
    first = F.col("line_no") % 1_000_000 == 0
    rows = rows.select(
        "pack_id", F.col("line_no").alias("ord"), F.when(first & (F.col("pack_id") % 2 == 0), "Heading 2").otherwise("Normal").alias("style"),
        F.when(first & (F.col("pack_id") % 4 == 0), "PLAIN TITLE").otherwise(F.col("line")).alias("text"),
    ).where((F.col("pack_id") % 5 != 4) | (F.col("ord") % 1_000_000 != 0))
    out = S.segment_paragraphs(rows)
    return out.select("pack_id", F.col("ord").cast("long").alias("ord"), "section_no", "name", F.md5(F.col("content").cast("binary")).alias("digest"), "raw_header")


@query(f"""
with t as (select pack_id * 10 + ord as cell_id, {_strip('case when ord % 3 = 0 then body when ord % 3 = 1 then substr(body, 5) else chr(10) end')} as text from @v_pack_texts),
s as (select cell_id, text, string_split_regex(text, {D.q(T.LINE_END)}) as ls from t where text <> ''), n as (select *, {_strip('ls[1]')} as line from s), h as (select *, {_IS_HEADER} as hdr, {_NAME} as hname from n)
select cell_id, case when hdr then cast({_group('line', 1)} as int) end as section_no, case when hdr then hname else 'UNKNOWN' end as name,
  md5(case when hdr then {_strip('array_to_string(ls[2:], chr(10))')} else text end) as digest, case when hdr then line else '' end as raw_header from h""")
def win_segment_cells(spark, sf_dir):
    body = F.when(F.col("ord") % 3 == 0, F.col("body")).when(F.col("ord") % 3 == 1, F.expr("substr(body, 5)")).otherwise("\n")
    cells = view(spark, sf_dir, "v_pack_texts").select((F.col("pack_id") * 10 + F.col("ord")).alias("cell_id"), body.alias("text"))
    out = S.segment_cells(cells)
    return out.select("cell_id", "section_no", "name", F.md5(F.col("content").cast("binary")).alias("digest"), "raw_header")


def _sql_list(values) -> str:
    return ", ".join(D.q(v) for v in values)


def _forms(x: str, p: str) -> str:
    words = f"list_distinct(list_filter(string_split({D.soft(x)}, ' '), lambda w: w <> ''))"
    return f"{D.strict(x)} as {p}_strict, {D.soft(x)} as {p}_soft, list_sort({D.lines(x, D.strict)}) as {p}_sl, list_sort({D.lines(x, D.soft)}) as {p}_fl, {words} as {p}_words"


_SELECTED = f"""
r as (select zone_id, pack_id, lang, reading, hint_number, hint_name, {_forms('reading', 'r')} from READINGS where length({_strip('reading')}) >= 3),
s as (select pack_id, ord, section_no, name, content, {_forms('content', 's')} from @v_packs),
p0 as (select r.zone_id, r.lang, r.hint_number, r.hint_name, s.*, r_strict, r_soft, r_sl, r_fl, r_words, coalesce(section_no = hint_number, false) as fits from r join s on r.pack_id = s.pack_id),
p1 as (select *, bool_or(fits) over (partition by zone_id) as hit from p0),
p2 as (select * exclude (fits, hit), coalesce(hint_name <> '' and contains(lower(name), lower(hint_name)), false) as named, count(*) over (partition by zone_id) as n from p1 where fits or not hit),
p3 as (select *, named and n > 1 as fits, bool_or(named and n > 1) over (partition by zone_id) as hit from p2),
p4 as (select *, regexp_matches(content, {D.q(T.PLACEHOLDER)}) as ph, r_strict = s_strict or (len(r_sl) > 0 and r_sl = s_sl) as eq, r_soft = s_soft or (len(r_fl) > 0 and r_fl = s_fl) as soft_eq,
  regexp_replace(lower(regexp_extract(name, '^[^\\p{{L}}\\p{{N}}_]*([^{T.WS}]*)', 1)), '[^\\x00-\\x7F]', '', 'g') as word from p3 where fits or not hit),
p5 as (select *, (case when word in ({_sql_list(PREFERRED_NAMES)}) then 1.0 when word in ({_sql_list(AVOIDED_NAMES)}) then -0.5 else 0.0 end) * (case when ph then 0.5 else 1.0 end)
  - (case when len(list_filter(string_split(s_soft, ' '), lambda x: x <> '')) > 50 then 0.3 else 0.0 end)
  + (case when eq then 5.0 when soft_eq then 3.0 when len(r_words) > 0 and len(s_words) > 0 then 2.0 * cast(len(list_intersect(r_words, s_words)) as double) / len(list_distinct(list_concat(r_words, s_words))) else 0.0 end) as score from p4),
p6 as (select *, row_number() over w as rank, lead(score) over w as second, bool_and(ph) over (partition by zone_id) as only_ph, count(*) over (partition by zone_id) as left_ from p5 window w as (partition by zone_id order by score desc, ord)),
b as (select *, coalesce(score - second, 999.0) as delta, only_ph and not (hint_number is not null and left_ = 1) as stuck, case when second is not null then score - second when s_soft <> '' and not ph then 6.8 else 0.0 end as margin from p6 where rank = 1),
c as (select *, case when stuck then 'all_placeholders' when delta < 0.05 and not eq then 'ambiguous_delta' when eq then 'strict_equal' when soft_eq then 'soft_equal_only' else 'no_match' end as reason,
  case when stuck then 0.0 else least(1.0, greatest(0.0, 0.7 * least(1.0, greatest(0.0, (score + 0.8) / 6.8)) + 0.3 * least(1.0, greatest(0.0, margin / 6.8)))) end as confidence from b),
q as (select z.zone_id, c.section_no, c.name, case when length({_strip('z.reading')}) < 3 then 'ocr_too_short' else c.reason end as reason, coalesce(c.delta, 0.0) as delta, c.score as score_top1, c.second as score_top2,
  coalesce(c.confidence, 0.0) as confidence, coalesce(c.margin, 0.0) as margin from READINGS z left join c on z.zone_id = c.zone_id)
"""


def _selected(source: str = "@v_zone_readings", packs: str = "@v_packs") -> str:
    return "with " + _SELECTED.replace("READINGS", source).replace("@v_packs", packs)


_CHOSEN = """select zone_id, section_no, name, case when reason = 'strict_equal' then 'PASS' else 'MANUAL' end as status, reason, reason not in ('strict_equal', 'no_match') as manual_required,
round(delta, 6) as delta, round(score_top1, 6) as score_top1, round(score_top2, 6) as score_top2, round(confidence, 6) as confidence, round(margin, 6) as margin from q"""


def _chosen(out: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("delta", "score_top1", "score_top2", "confidence", "margin")]
    return out.select("zone_id", "section_no", "name", "status", "reason", "manual_required", *rounded)


@query(_selected() + _CHOSEN)
def sel_sections(spark, sf_dir):
    return _chosen(S.select_sections(view(spark, sf_dir, "v_zone_readings"), view(spark, sf_dir, "v_packs")))


@query(_selected("@v_wide_readings", "@v_wide_packs") + _CHOSEN)
def sel_indexed_sections(spark, sf_dir):
    return _chosen(S.select_sections(view(spark, sf_dir, "v_wide_readings"), view(spark, sf_dir, "v_wide_packs"), indexed=True))


_ENGLISH = "(select * from @v_zone_readings where lang = 'en')"
_NAMED = f"n as (select z.zone_id, arg_min(s.section_no, s.ord) as by_name from {_ENGLISH} z join @v_packs s on z.pack_id = s.pack_id where z.hint_number is null and z.hint_name <> '' and contains(lower(s.name), lower(z.hint_name)) group by 1)"
_LOCKED = _selected(f"(select * from {_ENGLISH} where hint_number is null)") + f", {_NAMED}, k as (select z.zone_id, z.pack_id, z.lang, coalesce(z.hint_number, n.by_name, q.section_no) as section_no from {_ENGLISH} z left join n using (zone_id) left join q using (zone_id))"


@query(_LOCKED + "select zone_id, section_no from k")
def sel_locked_section(spark, sf_dir):
    english = view(spark, sf_dir, "v_zone_readings").where("lang = 'en'")
    return S.lock_references(english, view(spark, sf_dir, "v_packs"))


@query("""with l as (select pack_id, lang, section_no, arg_min(content, ord) as content from @v_packs group by 1, 2, 3)
select z.zone_id, z.section_no, md5(l.content) as digest from (select doc_id as zone_id, cast(floor(doc_id / 10) as bigint) as pack_id, lang, cast((doc_id * 7) % 10 + 1 as int) as section_no from @documents) z
left join l on z.pack_id = l.pack_id and z.lang = l.lang and z.section_no = l.section_no""")
def join_localized_section(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("zone_id"), F.floor(F.col("doc_id") / 10).alias("pack_id"), "lang", ((F.col("doc_id") * 7) % 10 + 1).cast("int").alias("section_no")
    )
    out = S.localized_sections(rows, view(spark, sf_dir, "v_packs"))
    return out.select("zone_id", "section_no", F.md5(F.col("content").cast("binary")).alias("digest"))


# --- paths -----------------------------------------------------------------

_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_KIND = f"case when path like '%/' then null when {_EXT} in ({_sql_list(IMAGE_EXTENSIONS)}) then 'image' when {_EXT} in ({_sql_list(TEXT_EXTENSIONS)}) then 'text' when {_EXT} = 'zip' then 'archive' else 'other' end"
_ALIAS = "case {0} " + " ".join(f"when {D.q(a)} then {D.q(b)}" for a, b in LANGUAGE_ALIASES.items()) + " else {0} end"
_COMPOSITE = " ".join(f"when regexp_matches(clean, '(^|[^a-z]){c}($|[^a-z])') then {D.q(c)}" for c in sorted(COMPOSITE_LANGUAGES, key=lambda c: (-len(c), c)))
_KNOWN = f"({_sql_list(LANGUAGES)})"
_PATHS = f"""
f0 as (select archive, ord, path, {_KIND} as kind, regexp_replace({_BASE}, '\\.[^.]*$', '') as stem from @v_files),
f1 as (select *, lower(stem) as low, regexp_replace(regexp_replace(lower(stem), '\\d{{2,4}}x\\d{{2,4}}', '', 'g'), '^[_\\- .]+|[_\\- .]+$', '', 'g') as clean, trim(regexp_extract(lower(stem), '\\(([^)]+)\\)', 1)) as paren from f0),
f2 as (select *, list_filter(string_split_regex(clean, '[^a-z]+'), lambda t: t <> '') as toks from f1),
f3 as (select *, case when paren in ({_sql_list(COMPOSITE_LANGUAGES)}) or paren in {_KNOWN} then paren {_COMPOSITE} else coalesce(
    list_filter(list_transform(range(1, len(toks)), lambda i: case when toks[i] in ({_sql_list(VARIANT_PREFIXES)}) and toks[i + 1] in {_KNOWN} then toks[i + 1] end), lambda t: t is not null)[1],
    list_filter(toks, lambda t: t in {_KNOWN})[-1]) end as code from f2),
files as (select archive, ord, path, kind, case when low in ({_sql_list(NOT_LANGUAGES)}) and low not in {_KNOWN} then null when regexp_matches(stem, '^[a-zA-Z]{{2}}$') then {_ALIAS.format('low')} else {_ALIAS.format('code')} end as lang,
  coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(path, '^.*?!/', ''), '/'), lambda x: x <> '')[:-2], '/'), ''), 'default') as target_id,
  case when regexp_matches(path, '\\d{{2,4}}x\\d{{2,4}}') then cast(string_split(regexp_extract(path, '\\d{{2,4}}x\\d{{2,4}}', 0), 'x')[1] as bigint) * cast(string_split(regexp_extract(path, '\\d{{2,4}}x\\d{{2,4}}', 0), 'x')[2] as bigint) else 0 end as area from f3)
"""


def _files(spark, sf_dir) -> DataFrame:
    return M.entries(view(spark, sf_dir, "v_files"))


@query(f"""with {_PATHS} select archive, ord, path, kind, lang, target_id, area,
case when {_EXT} in ('jpg', 'jpeg') then 'image/jpeg' when {_EXT} in ('png', 'gif', 'webp') then 'image/' || {_EXT} else 'application/octet-stream' end as media_type, coalesce(split_part(lang, '-', 1) in ('ar', 'he', 'il'), false) as rtl,
'sessions/' || replace(path, '..', '_') as storage_key from files where kind is not null""")
def path_features(spark, sf_dir):
    path = F.col("path")
    return _files(spark, sf_dir).select("*", P.media_type(path).alias("media_type"), P.is_rtl(F.col("lang")).alias("rtl"), P.storage_key("sessions", path).alias("storage_key"))


_SHOWN = "case when {0} in ('', 'und') then 'und' when regexp_matches({0}, '^[a-z]{{2}}$') then {0} when length(regexp_replace({0}, '[^a-z]', '', 'g')) >= 2 then substr(regexp_replace({0}, '[^a-z]', '', 'g'), 1, 2) else 'und' end"
_RENAMED = "case {0} when 'cn' then 'zh-hans' when 'kr' then 'ko' when 'ua' then 'uk' else {0} end"


@query(f"""with f as (select archive, ord, {_RENAMED.format("lower(case when ord % 2 = 0 then code else '' end)")} as a, {_RENAMED.format(f"lower(regexp_replace({_BASE}, '\\.[^.]*$', ''))")} as b from @v_files)
select archive, ord, case when {_SHOWN.format('a')} <> 'und' then {_SHOWN.format('a')} else {_SHOWN.format('b')} end as code from f""")
def path_display_code(spark, sf_dir):
    rows = view(spark, sf_dir, "v_files")
    lang = F.when(F.col("ord") % 2 == 0, F.col("code")).otherwise("")
    return rows.select("archive", "ord", P.display_code(lang, F.col("path")).alias("code"))


_USABLE = _PATHS + """, u0 as (select *, bool_or(contains(path, '!/')) over (partition by archive) as nested, bool_or(contains(lower(path), 'images/') or contains(lower(path), 'texts/')) over (partition by archive) as folders from files where kind is not null),
usable as (select archive, ord, path, kind, lang, target_id, area, case when nested then 'nested' when folders then 'folders' else 'mixed' end as layout from u0 where kind in ('image', 'text') and
  case when nested then contains(path, '!/') when folders then (kind = 'image' and contains(lower(path), 'images/')) or (kind = 'text' and contains(lower(path), 'texts/')) else true end)
"""


@query(f"with {_USABLE} select archive, ord, path, kind, layout from usable")
def src_archive_layout(spark, sf_dir):
    return M.usable_entries(_files(spark, sf_dir)).select("archive", "ord", "path", "kind", "layout")


@query(f"""with {_PATHS} select archive, kind, lang, arg_min(path, (case when kind = 'image' then -area else 0 end, ord)) as path from files where kind in ('image', 'text') and lang is not null group by 1, 2, 3""")
def win_one_per_language(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return M.one_per_language(rows, "image").unionByName(M.one_per_language(rows, "text")).select("archive", "kind", "lang", "path")


_BOXES = """boxes as (select target_id, ord, zone_name, case when ord % 6 = 5 then [x1, y1] else [x1, y1, x2, y2] end as bbox from (
  select case when p_partkey >= 24 then 'size_' || cast(p_partkey % 200 as varchar) when p_partkey % 3 = 0 then '300x250' when p_partkey % 3 = 1 then 'promo/x' else '640x480' end as target_id, p_partkey as ord, p_name as zone_name, p_size as x1, cast(p_partkey % 40 as int) as y1,
  cast(p_size + p_partkey % 60 - 5 as int) as x2, cast(p_partkey % 40 + p_size - 1 as int) as y2 from @part))"""


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = view(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    target = F.when(key >= 24, F.concat(F.lit("size_"), (key % 200).cast("string"))).when(key % 3 == 0, "300x250").when(key % 3 == 1, "promo/x").otherwise("640x480")
    y1 = (key % 40).cast("int")
    box = F.array(size, y1, (size + key % 60 - 5).cast("int"), (y1 + size - 1).cast("int"))
    zones = part.select(target.alias("target_id"), key.alias("ord"), F.col("p_name").alias("zone_name"), F.when(key % 6 == 5, F.slice(box, 1, 2)).otherwise(box).alias("bbox"))
    fallback = spark.range(1).select(F.lit("images").alias("target_id"), F.array(*[F.lit(n) for n in (0, 0, 10, 20)]).alias("bbox"))
    return zones, fallback


_EXPANDED = _PATHS + f""", {_BOXES}, images as (select * from files where kind = 'image'),
expanded as (select i.archive, i.path, i.lang, i.target_id, b.zone_name, b.bbox from images i join boxes b on i.target_id = b.target_id where len(b.bbox) = 4 and b.bbox[1] < b.bbox[3] and b.bbox[2] < b.bbox[4]
  union all select archive, path, lang, target_id, null, case when target_id = 'images' then [0, 0, 10, 20] end from images where target_id not in (select target_id from boxes))
"""


@query(f"with {_EXPANDED} select archive, path, lang, target_id, zone_name, array_to_string(bbox, ',') as bbox from expanded")
def join_expand_zones(spark, sf_dir):
    zones, fallback = _boxes(spark, sf_dir)
    out = M.expand_zones(_files(spark, sf_dir).where("kind = 'image'"), zones, fallback)
    return out.withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


@query(f"with {_PATHS} select archive, target_id, count(*) as items, coalesce(bool_or(lang = 'en'), false) as en_available, min(case when lang = 'en' then path end) as preview from files where kind = 'image' group by 1, 2")
def agg_target_summary(spark, sf_dir):
    return M.target_summary(_files(spark, sf_dir).where("kind = 'image'"))


@query(f"""with {_EXPANDED}, a as (select archive, count(*) as entries, count(*) filter (where kind = 'image') as images from files where kind is not null group by 1), b as (select archive, count(*) as queued, count(bbox) as with_bbox from expanded group by 1)
select a.archive, entries, images, coalesce(queued, 0) as queued, coalesce(with_bbox, 0) as with_bbox, coalesce(queued, 0) - coalesce(with_bbox, 0) as without_bbox from a left join b using (archive)""")
def agg_archive_counts(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return M.archive_counts(rows, M.expand_zones(rows.where("kind = 'image'"), *_boxes(spark, sf_dir)))


@query(f"""with {_PATHS}, i as (select distinct archive, lang from files where kind = 'image' and lang is not null), t as (select distinct archive, lang from files where kind = 'text' and lang is not null)
select archive, lang, 'no_text' as gap from (select * from i except select * from t) union all select archive, lang, 'no_image' as gap from (select * from t except select * from i)
union all select archive, target_id as lang, 'no_english' as gap from files where kind = 'image' group by archive, target_id having not coalesce(bool_or(lang = 'en'), false)""")
def join_coverage(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return M.coverage(rows.where("kind = 'image'"), rows.where("kind = 'text'"))


@query(f"""with {_PATHS}, w as (select archive, case when ord % 2 = 0 then path else {_BASE} end as name from files where kind is not null),
e as (select distinct archive, path from files where kind is not null), b as (select archive, {_BASE} as base, arg_min(path, ord) as loose from files where kind is not null group by 1, 2)
select w.archive, w.name, coalesce(e.path, b.loose) as path from w left join e on w.archive = e.archive and w.name = e.path left join b on w.archive = b.archive and regexp_extract(w.name, '([^/]*)$', 1) = b.base""")
def join_path_lookup(spark, sf_dir):
    rows = _files(spark, sf_dir)
    asked = rows.select("archive", F.when(F.col("ord") % 2 == 0, F.col("path")).otherwise(P.basename(F.col("path"))).alias("name"))
    return M.lookup(asked, rows)


@query(f"with {_PATHS}, f as (select archive, arg_min(path, ord) as path from files where kind = 'image' and lang = 'en' group by 1) select archive, ord, path from files join f using (archive, path)")
def win_reference_image(spark, sf_dir):
    return M.reference_image(_files(spark, sf_dir).where("kind = 'image'")).select("archive", "ord", "path")


@query("select zone_id, engine, image_id, cast(floor((row_number() over (partition by image_id, engine order by zone_id) - 1) / 16) as bigint) as chunk from (select *, cast(floor(zone_id / 40) as bigint) as image_id from @v_readings)")
def win_batches(spark, sf_dir):
    rows = view(spark, sf_dir, "v_readings").select("zone_id", "engine", F.floor(F.col("zone_id") / 40).alias("image_id"))
    return M.batches(rows, ("image_id", "engine"), F.col("zone_id"))


@query(f"""with {_PATHS}, i as (select *, case when archive % 5 = 0 then 'de' end as hint from files where kind = 'image'),
w as (select archive, target_id, coalesce(max(hint), case when bool_or(lang = 'en') then 'en' end, min(lang)) as want, arg_min(path, ord) as first from i group by 1, 2),
o as (select i.archive, i.target_id, arg_min(i.path, i.ord) as own from i join w on i.archive = w.archive and i.target_id = w.target_id and i.lang = w.want group by 1, 2)
select w.archive, w.target_id, want as lang, coalesce(own, first) as path from w left join o using (archive, target_id)""")
def lim_batch_language(spark, sf_dir):
    rows = _files(spark, sf_dir).where("kind = 'image'").withColumn("hint", F.when(F.col("archive") % 5 == 0, "de"))
    return M.batch_language(rows)


_SPREAD = "(select template_name, zone_name, ord, case when template_name in ('Brand#1', 'Brand#2', 'Brand#3') then null when ord % 2 = 0 then target_id end as target_id from @v_zones)"


@query(f"""with z as (select *, count(target_id) over (partition by template_name) as n from {_SPREAD}), t as (select distinct template_name, target_id from @v_zones)
select template_name, target_id, zone_name from z where n > 0 and target_id is not null union all select z.template_name, t.target_id, z.zone_name from z join t on z.template_name = t.template_name where n = 0""")
def join_spread_zones(spark, sf_dir):
    rows = view(spark, sf_dir, "v_zones")
    targets = rows.select("template_name", "target_id").distinct()
    free = F.col("template_name").isin("Brand#1", "Brand#2", "Brand#3")
    zones = rows.select("template_name", "zone_name", F.when(~free & (F.col("ord") % 2 == 0), F.col("target_id")).alias("target_id"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
    return M.spread_zones(zones, targets).drop("bbox")


@query("with a as (select page_id as archive, 'Brand#' || (page_id % 40) as file_name from @pages), t as (select distinct template_name from @v_zones) select a.archive, t.template_name from a left join t on a.file_name = t.template_name")
def join_matching_template(spark, sf_dir):
    archives = view(spark, sf_dir, "pages").select(F.col("page_id").alias("archive"), F.concat(F.lit("Brand#"), (F.col("page_id") % 40).cast("string")).alias("file_name"))
    return M.matching_templates(archives, view(spark, sf_dir, "v_zones").select("template_name"))


@query("""with t as (select doc_id, case doc_id % 4 when 0 then 'google,azure' when 1 then ',ocrspace,,' when 2 then '' end as raw from @documents),
e as (select doc_id, case when coalesce(raw, '') = '' then ['google'] else list_filter(string_split(raw, ','), lambda x: x <> '') end as engines from t)
select doc_id, cast(len(engines) as int) as n, array_to_string(engines, ',') as engines from e""")
def fun_engine_list(spark, sf_dir):
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, "google,azure").when(n == 1, ",ocrspace,,").when(n == 2, "")
    rows = view(spark, sf_dir, "documents").select("doc_id", M.engine_list(raw).alias("e"))
    return rows.select("doc_id", F.size("e").alias("n"), M.engine_text(F.col("e")).alias("engines"))
