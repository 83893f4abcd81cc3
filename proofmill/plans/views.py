"""Input views over the supplied tables, defined once in SQL for Spark and for the oracle.

Marks in the SQL: @name is a table or another view; @each(a, b) makes a row of
each value; @lines(x) an array of lines; @flip(a) reverses an array, @join(a)
joins it by line ends, @cut(a; i; n) is its n elements from the i-th on;
@upper(x) is x in capitals, each letter in one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "pages", "conversations", "labels", "events", "embeddings", "part")

_RANGES = "\u00df\u00df\u0149\u0149\u01f0\u01f0\u0390\u0390\u03b0\u03b0\u0587\u0587\u1e96\u1e9a\u1f50\u1f50\u1f52\u1f52\u1f54\u1f54\u1f56\u1f56\u1f80\u1faf\u1fb2\u1fb4\u1fb6\u1fb7\u1fbc\u1fbc\u1fc2\u1fc4\u1fc6\u1fc7\u1fcc\u1fcc\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\u1ffc\u1ffc\ufb00\ufb06\ufb13\ufb17"
#: Letters that Java puts several capitals for (\u00df: SS), and the single capital of each, or itself, that DuckDB has.
MANY_CAPITALS = "".join(chr(c) for k in range(0, len(_RANGES), 2) for c in range(ord(_RANGES[k]), ord(_RANGES[k + 1]) + 1))
ONE_CAPITAL = "".join("\u1e9e" if c == "\u00df" else chr(ord(c) | 8) if "\u1f80" <= c <= "\u1faf" else chr(ord(c) + 9) if c in "\u1fb3\u1fc3\u1ff3" else c for c in MANY_CAPITALS)
# Stretches of those letters are translated, what is between them is Java's; texts without any are so as a whole.
_UPPER = (
    "case when contains({0}, '\u00df') or {0} rlike '[\u0149-\ufb17]' then array_join(transform(regexp_extract_all({0}, '[MANY]+|[^MANY]+', 0), "
    "p -> case when p rlike '^[MANY]' then translate(p, 'MANY', 'ONE') else upper(p) end), '') else upper({0}) end"
).replace("MANY", MANY_CAPITALS).replace("ONE", ONE_CAPITAL)

_MACROS = {
    "spark": {"upper": _UPPER, "each": "explode(array({}))", "lines": "split({}, chr(10))", "flip": "reverse({})", "join": "array_join({}, chr(10))", "str": "cast({} as string)", "list": "array({})", "cut": "slice({0}, {1}, {2})"},
    "duckdb": {"upper": "upper({})", "each": "unnest([{}])", "lines": "string_split({}, chr(10))", "flip": "list_reverse({})", "join": "array_to_string({}, chr(10))", "str": "cast({} as varchar)", "list": "[{}]", "cut": "list_slice({0}, {1}, {1} + {2} - 1)"},
}

_LANGS = "case {} % 9 when 0 then 'en' when 1 then 'de' when 2 then 'zh-hans' when 3 then 'kr' when 4 then 'EN' when 5 then 'pt-pt' when 6 then 'fr' when 7 then 'xx' else 'ua' end"

VIEWS = {
    # Three readings of each document, some failed, some changed.
    "v_readings": """
select doc_id as zone_id, engine, lang,
  case when engine = 'google' then text
       when engine = 'azure' then case doc_id % 5 when 0 then '## ' || text when 1 then text
            when 2 then case when lang <> 'de' then @upper(text) else text end
            when 3 then substr(text, 1, cast(floor(length(text) / 2.0) as int)) else text || ' extra' end
       else case doc_id % 3 when 0 then text || '!' when 1 then text else '' end end as text,
  case when engine = 'google' then cast(doc_id % 100 as double) / 100 when engine = 'azure' then cast(doc_id % 90 as double) / 100 end as confidence,
  case when doc_id % 17 = 0 or (doc_id % 11 = 0 and engine = 'google') then 'engine_exception' end as error
from (select doc_id, lang, text, @each('google', 'azure', 'ocrspace') as engine from @documents) r""",
    # Documents with the characters and marks that normalisation is about.
    "v_dirty": """
select doc_id, lang, case doc_id % 6 when 0 then text when 1 then '\u201c' || text || '\u201d\u2026' when 2 then text || ' %skin% [ Username ] <b> 50% x%'
  when 3 then '## ' || text || '\u00a0#1 \u00adA\u200b' when 4 then 'A\u2013B\u2011C\u2009D \u2605 ' || text || ' \u00ab ok \u00bb !'
  else text || '  \U0001f600 \u2192 \u2022 [ DONE ] AcmeLive' end as text from @documents""",
    # A reference for each document: the same, lines reversed, without its first word, decorated.
    "v_refs": """
select doc_id as zone_id, lang, text,
  case doc_id % 4 when 0 then text when 1 then @join(@flip(@lines(text))) when 2 then substr(text, instr(text, ' ') + 1) else '[ ' || text || ' ]' end as ref
from @documents""",
    # Packs of ten numbered sections.
    "v_packs": """
select cast(floor(doc_id / 10) as bigint) as pack_id, doc_id % 10 as ord, cast(doc_id % 10 + 1 as int) as section_no, lang,
  case doc_id % 5 when 0 then 'BANNER' when 1 then 'PIC 2' when 2 then 'NEWS' when 3 then 'EMAIL' else 'OTHER' end as name,
  case when doc_id % 7 = 0 then text || ' %username%' else text end as content
from @documents""",
    # The packs as lines: header, content, two blank lines.
    "v_pack_texts": """
select pack_id, ord, @str(section_no) || '. ' || name || chr(10) || content || chr(10) || chr(10) as body from @v_packs""",
    # Readings to be matched with the sections of their pack.
    "v_zone_readings": """
select doc_id as zone_id, cast(floor(doc_id / 10) as bigint) as pack_id, lang,
  case doc_id % 6 when 0 then text when 1 then lower(text) when 2 then 'x' when 3 then text || ' more' when 4 then @join(@flip(@lines(text))) else text end as reading,
  case when doc_id % 4 = 0 then cast(doc_id % 10 + 1 as int) when doc_id % 4 = 1 then 99 end as hint_number,
  case when doc_id % 3 = 0 then 'pic' end as hint_name
from @documents""",
    # Twenty-five packs as one, with a few hundred sections.
    "v_wide_packs": """
select cast(floor(pack_id / 25) as bigint) as pack_id, pack_id * 1000 + ord as ord, section_no, lang, name, content from @v_packs""",
    "v_wide_readings": """
select zone_id, cast(floor(pack_id / 25) as bigint) as pack_id, lang, reading, hint_number, case when hint_number is null and zone_id % 4 = 0 then hint_name end as hint_name from @v_zone_readings""",
    # English and localised texts with numbers.
    "v_facts": """
select doc_id as zone_id, lang, text || ' Win 5,000 tokens until June ' || @str(doc_id % 28 + 1) as en_text,
  text || ' 5000 ' || case when doc_id % 7 = 0 then '' else @str(doc_id % 28 + 1) end || case when doc_id % 5 = 0 then ' 77' else '' end as loc_text
from @documents""",
    # Entries of archives.
    "v_files": f"""
select cast(floor(page_id / 10) as bigint) as archive, page_id % 10 as ord, {_LANGS.format('page_id')} as code,
  case page_id % 8 when 0 then '300x250/' || {_LANGS.format('page_id')} || '.png' when 1 then 'images/banner_' || {_LANGS.format('page_id')} || '_700x420.png'
    when 2 then 'texts/Campaign (' || {_LANGS.format('page_id')} || ').docx'
    when 3 then case when floor(page_id / 10) % 3 = 0 then 'pack.zip!/640x480/' else '640x480/' end || {_LANGS.format('page_id')} || '.JPG'
    when 4 then 'logo.gif' when 5 then 'promo/x/' || {_LANGS.format('page_id')} || '_1200x628.webp' when 6 then 'docs/readme_wl_' || {_LANGS.format('page_id')} || '.txt'
    else substr(url, instr(url, '//') + 2) end as path
from @pages""",
    # Engine and judge calls.
    "v_usage": """
select ts, case event_type when 'click' then 'google' when 'view' then 'azure' when 'purchase' then 'ocrspace' end as engine,
  cast(event_id % 4 as bigint) - 1 as delta, case when event_id % 13 = 0 then -value / 1000 when event_id % 7 <> 0 then value / 1000 end as cost,
  user_id, event_id, event_type from @events""",
    # Zones of templates with boxes, some malformed.
    "v_zones": """
select p_partkey as zone_id, p_brand as template_name, p_type as target_id, p_partkey % 50 as ord, p_name as zone_name,
  p_size as x1, cast(p_partkey % 40 as int) as y1, cast(p_size + p_partkey % 60 - 5 as int) as x2, cast(p_partkey % 40 + p_size - 1 as int) as y2,
  cast(200 + p_partkey % 1200 as int) as w, cast(150 + p_partkey % 900 as int) as h, p_retailprice as price from @part""",
    # Result rows of sessions.
    "v_results": """
select d.doc_id as id, cast(d.doc_id % 23 as bigint) as session_id, 'img_' || @str(cast(floor(d.doc_id / 3) as bigint)) || '.png' as image_name, d.lang, d.text as ref_text,
  case d.doc_id % 4 when 0 then 'PASS' else 'MANUAL' end as status,
  case d.doc_id % 4 when 0 then 'strict_equal' when 1 then 'no_match' when 2 then 'missing_bbox' else 'ambiguous_delta' end as reason,
  case when l.toxic = 1 then 'error' when l.quality = 1 then 'ok' end as decision, cast(d.doc_id % 101 as double) / 100 as confidence, d.doc_id % 6 = 0 as disagree
from @documents d left join @labels l on d.doc_id = l.doc_id""",
    # Crops of several lengths, and templates cut from vectors of their kind; some are longer than the crops.
    "v_crops": """
select vec_id, label, @cut(embedding; 1; cast(64 - 4 * (vec_id % 6) as int)) as embedding from @embeddings where vec_id % 2 = 1""",
    "v_templates": """
select vec_id, label, case when label = 5 then @cut(embedding; 1; 64) else @cut(embedding; cast(vec_id % 9 + 1 as int); cast(10 + 4 * (vec_id % 11) as int)) end as embedding
from @embeddings where vec_id % 2 = 0 and label <> 7 and (label <> 5 or vec_id % 5 = 0)""",
    # Engine attempts.
    "v_attempts": """
select conv_id as request_id, turn + 1 as attempt, role, case when turn % 2 = 0 and conv_id % 3 = 0 then '' else text end as text from @conversations""",
}


def sql_of(text: str, dialect: str, tables: dict[str, str] | None = None) -> str:
    """Marked SQL in a dialect; views are put in as subqueries."""

    def one(match: re.Match) -> str:
        name = match[1]
        if name in VIEWS:
            return f"({sql_of(VIEWS[name], dialect, tables)})"
        return (tables or {}).get(name, name)

    for macro, pattern in _MACROS[dialect].items():
        while (at := text.find(f"@{macro}(")) >= 0:
            start = at + len(macro) + 2
            depth, end = 1, start
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[:at] + pattern.format(*text[start : end - 1].split(";")) + text[end:]
    return re.sub(r"@(\w+)", one, text)


def _tables_of(name: str) -> set[str]:
    """The supplied tables that a view reads, through other views too."""
    if name in TABLES:
        return {name}
    return {t for used in re.findall(r"@(\w+)", VIEWS[name]) if used in VIEWS or used in TABLES for t in _tables_of(used)}


#: Tables of fewer bytes in all are one or two splits of a file, which would leave most cores idle.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. One of less than DEALT_BYTES, in fewer files than there are cores, is dealt out to them; larger ones are read as they are split."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < DEALT_BYTES and len(rows.inputFiles()) < cores else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a supplied table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    needed = _tables_of(name)
    tables = {}
    for t in needed:
        tables[t] = f"proofmill_{t}_{abs(hash(sf_dir)) % 10**9}"
        table(spark, sf_dir, t).createOrReplaceTempView(tables[t])
    return spark.sql(sql_of(VIEWS[name], "spark", tables))
