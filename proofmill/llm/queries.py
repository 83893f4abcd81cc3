"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import (
    chat,
    decontaminate,
    exact_dedup,
    infill,
    language,
    licenses,
    line_dedup,
    mixing,
    multiset_hash,
    near_dedup,
    periodic,
    sharding,
    substring_dedup,
)
from proofmill.functions.compare import once
from proofmill.plans.views import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.read_back(chat.format_windows(rows))
    return out.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("turns_text").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents, a tenth of them, chosen by a hash of their id, with a period put in behind a place that the hash gives."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("put"))
    rows = once(rows, "w", F.when(F.col("put"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size("w")
    rows = rows.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    put = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, put).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    out = out.withColumn("best", periodic.strongest(F.col("runs")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiset_hash.edited_by_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        multiset_hash.as_string(F.col("vector")).alias("fingerprint"),
        multiset_hash.as_string(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset_hash.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


_QUERIES = (
    op1_language_id, op2_decontaminate, op3_simhash, op4_substring_dedup, op5_chat_format, op6_mix_sources, op7_line_dedup, op8_exact_dedup, op9_sharding, op10_license_scan,
    op11_periodic_runs, op12_fill_in_middle, op13_fingerprints,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TOKEN = r"'[^\x20\x09-\x0D]+'"

#: CRC-32 of a text of ASCII characters: each is put in, then the register is shifted eight times.
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({}, ''), lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"""
_LIKENESS = (
    "case when {0} = {1} then 1.0 else coalesce(least(greatest(2 * list_dot_product(cast({2} as double[]), cast({3} as double[])) "
    "/ nullif(list_dot_product(cast({2} as double[]), cast({2} as double[])) + list_dot_product(cast({3} as double[]), cast({3} as double[])), 0.0), 0.0), 1.0), 0.0) end"
)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": f"""
with i as (select item_id, regexp_extract_all({_LOWER.format('text')}, {_WORD}) as w from benchmark),
g as (select item_id, w, least(10, len(w)) as n from i where len(w) > 0),
p as (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as a from g),
k as (select distinct item_id, n, array_to_string(w[a:a + n - 1], ' ') as win from p),
d as (select doc_id, text, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) as w from documents),
s as (select distinct n from k),
q as (select doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) as a from d, s where len(w) >= n),
x as (select doc_id, text, n, a, array_to_string(w[a:a + n - 1], ' ') as win from q),
h as (select distinct x.doc_id, x.text, x.a, x.n, k.item_id from x join k on x.n = k.n and x.win = k.win),
c as (select doc_id, text, count(distinct pos) as n_hit from (select doc_id, text, unnest(range(a, a + n)) as pos from h) group by all),
t as (select doc_id, text, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by all)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id and d.text = c.text left join t on d.doc_id = t.doc_id and d.text = t.text""",
        "op4_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_TOKEN}) as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as a from d where len(w) >= 50),
x as (select doc_id, a, array_to_string(w[a:a + 49], ' ') as win from p),
l as (select doc_id, a, min(doc_id) over (partition by win) as least from x),
g as (select distinct doc_id, unnest(range(a, a + 50)) as pos from l where least < doc_id),
f as (select d.doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from d),
r as (select f.doc_id, count(*) as n_words, count(g.pos) as n_removed, string_agg(word, ' ' order by f.pos) filter (where g.pos is null) as kept
      from f left join g on f.doc_id = g.doc_id and f.pos = g.pos group by f.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r on d.doc_id = r.doc_id""",
        "op7_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from d),
k as (select doc_id, pos, line, {_LOWER.format(f'trim(line, {_SPACES})')} as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
g as (select k.doc_id, k.pos, k.line, c.key is not null as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, cast(sum(cast(gone as bigint)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from g group by doc_id""",
        "op8_exact_dedup": f"""
with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d""",
        "op11_periodic_runs": f"""
with c as (select doc_id, regexp_extract_all(coalesce(text, ''), {_TOKEN}) as w, {_CRC32.format('cast(doc_id as varchar)')} as h from documents),
d as (select doc_id, w, len(w) as n, h % 10 = 0 as put, h // 10 as g, (h // 10) % greatest(len(w), 1) as a from c),
t as (select doc_id, n, i, w[1 + case when put and i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end] as word from (select *, unnest(range(n)) as i from d)),
e as (select x.doc_id, y.i - x.i as q, x.i as i from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from e),
l as (select doc_id, q, min(i) as start, count(*) + q as length from s group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)),
r as (select * from l where not exists (select 1 from l as o where o.doc_id = l.doc_id and o.q < l.q and l.q % o.q = 0 and o.start <= l.start and o.start + o.length >= l.start + l.length)),
b as (select *, row_number() over (partition by doc_id order by length / cast(q as double) desc, start, q) as nth from r),
m as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as runs from r group by doc_id),
g as (select distinct doc_id, unnest(range(start + q, start + length)) as i from r),
k as (select t.doc_id, string_agg(word, ' ' order by t.i) as kept from t left join g on t.doc_id = g.doc_id and t.i = g.i where g.i is null group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.q as period, cast(1000 * b.length // b.q as bigint) as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join b on d.doc_id = b.doc_id and b.nth = 1 left join m on d.doc_id = m.doc_id left join k on d.doc_id = k.doc_id""",
        "op12_fill_in_middle": f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as x from documents),
h as (select *, {', '.join(f"cast('0x' || x[{8 * k + 1}:{8 * k + 8}] as bigint) as h{k + 1}" for k in range(4))} from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p""",
        "op13_fingerprints": f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
x as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nx, coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as nid from d),
e as (select *, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) as ed from x),
u as (select doc_id, 0 as k, unnest(string_split(t, chr(10))) as p from e union all select doc_id, 1, unnest(string_split(ed, chr(10))) from e),
g as (select doc_id, k, sha256('0:' || p) || sha256('1:' || p) as h from u),
j as (select doc_id, k, h, unnest(range(40)) as j from g),
c as (select doc_id, k, h, j, 64 * (j // 20) + 15 * (j // 5 % 4) + 5 - j % 5 as z from j),
s as (select doc_id, k, j, sum(cast(2 * instr('0123456789abcdef', h[z]) - 17 as hugeint) * 1099511627776 + (2 * instr('0123456789abcdef', h[z + 5]) - 17) * 1048576 + 2 * instr('0123456789abcdef', h[z + 10]) - 17) as v from c group by all),
m as (select doc_id, k, j, cast((v % 1152921504606846976 + 1152921504606846976) % 1152921504606846976 as bigint) as v from s),
q as (select *, (v + 524288) >> 20 as v1, (((v + 524288) >> 20) + 524288) >> 20 as v2 from m),
f as (select doc_id, k, string_agg(printf('%015x', v), '' order by j) as fp, flatten(list([((v + 524288) & 1048575) - 524288, ((v1 + 524288) & 1048575) - 524288, ((v2 + 524288) & 1048575) - 524288])) as l from (select * from q order by doc_id, k, j) group by doc_id, k),
o as (select e.doc_id, e.n, e.ed, f.fp, f.l, g.fp as efp, g.l as el, h.fp as nfp, h.l as nl from e join f on f.doc_id = e.doc_id and f.k = 0 join f g on g.doc_id = e.doc_id and g.k = 1 join f h on h.doc_id = e.nid and h.k = 0)
select doc_id, n as n_chars, sha256(ed) as edited_sha256, fp as fingerprint, efp as edited_fingerprint, {_LIKENESS.format('fp', 'efp', 'l', 'el')} as near_edited, {_LIKENESS.format('fp', 'nfp', 'l', 'nl')} as near_next
from o""",
    }
