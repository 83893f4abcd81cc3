"""Cutting packs into numbered sections, and choosing the section that a reading matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.config import AVOIDED_NAMES, CJK, DEFAULT, PREFERRED_NAMES, Config
from proofmill.functions import compare as C
from proofmill.functions import geometry as G
from proofmill.functions import text as T
from proofmill.operators import section_index as index
from proofmill.sources.shared import written

#: Full stops of several scripts that may follow a section number.
STOPS = r".\x{2024}\x{589}\x{6D4}\x{FF0E}"
HEADER = rf"^([0-9]+)[{STOPS}]?[{T.WS}]*([^0-9].*)$"
UNNAMED = "UNKNOWN"


def stripped(line: Column) -> Column:
    return F.btrim(F.coalesce(line, F.lit("")), F.lit(T.WS_CHARS))


def header(line: Column) -> Column:
    """struct(number, name) of a header-shaped line, else null. A number beyond an int, as of a card at a line's start, is null; the header stays one."""
    s = stripped(line)
    name = stripped(F.regexp_replace(F.regexp_extract(s, HEADER, 2), rf"^[{T.WS}{STOPS}]+", ""))
    return F.when(s.rlike(HEADER), F.struct(F.regexp_extract(s, HEADER, 1).try_cast("int").alias("number"), name.alias("name")))


def likely_name(name: Column) -> Column:
    """Whether a header's name looks like one: up to four words, mostly capitals, no closing mark."""
    s = stripped(name)
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return (s != "") & ~s.rlike("[!?.,:;]$") & (F.size(T.words(T.collapse(s))) <= 4) & (letters > 0) & (capitals / F.greatest(letters, F.lit(1)) >= 0.6)


def segment_lines(lines: DataFrame, validator=likely_name, least_headers: int = 2) -> DataFrame:
    """(pack_id, ord, section_no, name, content, raw_header) for (pack_id, line_no, line).

    A section starts at each header line that the validator accepts, and at the
    second blank line in a row. Packs with fewer than least_headers headers are
    one unnamed section. Sections without content and header are left out.
    """
    pack = W.partitionBy("pack_id")
    by_line = pack.orderBy("line_no")
    running = by_line.rowsBetween(W.unboundedPreceding, 0)
    h = header(F.col("line"))
    rows = lines.select("pack_id", "line_no", stripped(F.col("line")).alias("line")).withColumn("head", F.when(validator(h["name"]), h) if validator else h)
    rows = rows.withColumn("blank", F.col("line") == "").withColumn("stretch", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(running))
    in_stretch = W.partitionBy("pack_id", "stretch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    blanks = F.sum(F.col("blank").cast("int")).over(in_stretch)
    starts = F.col("head").isNotNull() | (F.col("blank") & (blanks == 2))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("headers", F.count("head").over(pack))
    rows = rows.withColumn("ord", F.when(F.col("headers") >= least_headers, F.sum("starts").over(running)).otherwise(0))
    in_order = F.array_sort(F.collect_list(F.struct("line_no", "line", F.col("head").isNotNull().alias("is_head"))))
    cut = rows.groupBy("pack_id", "ord").agg(in_order.alias("rows"), F.max("headers").alias("headers"), F.min_by("head", "line_no").alias("head"), F.min_by("line", "line_no").alias("first"))
    numbered = F.col("headers") >= least_headers
    body = F.filter("rows", lambda r: ~(r["is_head"] & numbered))
    content = stripped(F.array_join(F.transform(body, lambda r: r["line"]), "\n"))
    head = F.when(numbered, F.col("head"))
    out = cut.select(
        "pack_id", "ord", head["number"].alias("section_no"), F.coalesce(head["name"], F.lit(UNNAMED)).alias("name"), content.alias("content"),
        F.when(head.isNotNull(), F.col("first")).otherwise("").alias("raw_header"),
    )
    return out.where("content <> '' or raw_header <> ''")


def segment_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(pack_id, ord, section_no, name, content, raw_header) for (pack_id, ord, style, text): boundaries are heading styles and header-shaped texts; packs without any have no sections."""
    text = stripped(F.col("text"))
    h = header(F.col("text"))
    heading = F.coalesce(F.col("style"), F.lit("")).rlike(r"(?i)^\s*heading\s*\d+\b")
    rows = paragraphs.select("pack_id", "ord", text.alias("text"), (heading | h.isNotNull()).alias("starts"), h.alias("head")).where("text <> ''")
    running = W.partitionBy("pack_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("cut", F.sum(F.col("starts").cast("int")).over(running)).withColumn("any", F.max("starts").over(W.partitionBy("pack_id"))).where("any")
    body = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("ord", "text"))))
    cut = rows.groupBy("pack_id", F.col("cut").alias("ord")).agg(
        body.alias("body"), F.max(F.when(F.col("starts"), F.col("text"))).alias("raw"), F.max(F.when(F.col("starts"), F.col("head"))).alias("head")
    )
    return cut.select(
        "pack_id", "ord", F.col("head.number").alias("section_no"), F.coalesce("head.name", "raw", F.lit(UNNAMED)).alias("name"),
        F.array_join(F.transform("body", lambda r: r["text"]), "\n").alias("content"), F.coalesce("raw", F.lit("")).alias("raw_header"),
    )


def segment_cells(cells: DataFrame) -> DataFrame:
    """(cell_id, section_no, name, content, raw_header) for (cell_id, text): a cell is a section whose first line may be its header; blank cells give none."""
    text = stripped(F.col("text"))
    lines = F.split(text, T.LINE_END)
    h = header(lines[0])
    rows = cells.select("cell_id", text.alias("text"), lines.alias("lines"), h.alias("h")).where("text <> ''")
    rest = stripped(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), "\n"))
    has = F.col("h").isNotNull()
    return rows.select(
        "cell_id", F.col("h.number").alias("section_no"), F.coalesce("h.name", F.lit(UNNAMED)).alias("name"), F.when(has, rest).otherwise(F.col("text")).alias("content"),
        F.when(has, stripped(F.col("lines")[0])).otherwise("").alias("raw_header"),
    )


def name_score(name: Column) -> Column:
    first = F.regexp_replace(F.lower(F.regexp_extract(name, rf"^[^\p{{L}}\p{{N}}_]*([^{T.WS}]*)", 1)), r"[^\x00-\x7F]", "")
    return F.when(first.isin(*PREFERRED_NAMES), 1.0).when(first.isin(*AVOIDED_NAMES), -0.5).otherwise(0.0)


def token_count(text: Column, lang: Column) -> Column:
    """Words of any text, or its characters but white space where a language has no spaces. A null language has spaces."""
    return F.when(F.coalesce(lang, F.lit("")).isin(*CJK), F.length(F.regexp_replace(text, f"[{T.WS}]", ""))).otherwise(F.size(T.words(T.collapse(text))))


def with_forms(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """rows with what its text is compared by: digests of the strict and soft forms, as wholes and as sorted lines (null without lines), the soft words and their number. Texts and forms needn't travel."""
    soft = F.when(T.may_hold_placeholder(text), F.struct(T.normalize(text, "soft").alias("whole"), T.normalized_lines(text, "soft").alias("lines")))
    rows = C.once(rows, "forms", F.struct(T.strict_lines(text).alias("lines"), soft.alias("soft")))
    whole = lambda lines: F.array_join(lines, " ")
    digest = lambda x: F.md5(x.cast("binary"))
    of_lines = lambda lines: F.when(F.size(lines) > 0, digest(F.array_join(F.array_sort(lines), "\n")))
    lines, other = F.col("forms.lines"), F.col("forms.soft")
    own = F.struct(digest(whole(lines)).alias("strict"), of_lines(lines).alias("strict_lines"), F.coalesce(other["whole"], whole(lines)).alias("text"), other.alias("other"))
    rows = C.once(rows.select(*[c for c in rows.columns if c != "forms"], "forms"), "own", own).drop("forms")
    own, other = F.col("own"), F.col("own.other")
    more = F.struct(
        own["strict"].alias("strict"), own["strict_lines"].alias("strict_lines"), F.when(other.isNull(), own["strict"]).otherwise(digest(other["whole"])).alias("soft"),
        F.when(other.isNull(), own["strict_lines"]).otherwise(of_lines(other["lines"])).alias("soft_lines"), C.word_set(own["text"]).alias("words"), F.size(T.words(own["text"])).alias("n_words"),
    )
    rows = C.once(rows, "more", more)
    named = [F.col(f"more.{c}").alias(f"{prefix}_{c}") for c in ("strict", "soft", "strict_lines", "soft_lines", "words", "n_words")]
    return rows.select("*", *named).drop("own", "more")


def with_section_facts(sections: DataFrame) -> DataFrame:
    """sections with their forms (s_) and has_placeholder. Only languages with spaces are asked for a length."""
    return with_forms(C.once(sections, "has_placeholder", T.has_placeholder("content")), "content", "s")


def _equal(level: str) -> Column:
    return (F.col(f"r_{level}") == F.col(f"s_{level}")) | F.coalesce(F.col(f"r_{level}_lines") == F.col(f"s_{level}_lines"), F.lit(False))


def section_bases(config: Config = DEFAULT) -> tuple[Column, Column]:
    """What a section's score is made of besides the match: for readings in languages with spaces, and without."""
    plain = name_score(F.col("name")) * F.when(F.col("has_placeholder"), 0.5).otherwise(1.0)
    return plain - F.when(F.col("s_n_words") > config.long_text_tokens, 0.3).otherwise(0.0), plain


def score_sections(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pairs of readings (forms r_) and sections (name and facts) with score, strict_equal, soft_equal, has_placeholder, warnings."""
    spaced = ~F.coalesce(F.col("lang"), F.lit("")).isin(*CJK)
    overlap = C.jaccard(F.col("r_words"), F.col("s_words"))
    long = spaced & (F.col("s_n_words") > config.long_text_tokens)
    rows = pairs.withColumn("long_text", long)
    rows = rows.withColumn("strict_equal", _equal("strict")).withColumn("soft_equal", _equal("soft"))
    match = F.when(F.col("strict_equal"), 5.0).when(F.col("soft_equal"), 3.0).otherwise(2.0 * overlap)
    score = name_score(F.col("name")) * F.when(F.col("has_placeholder"), 0.5).otherwise(1.0) - F.when(F.col("long_text"), 0.3).otherwise(0.0) + match
    warnings = F.array_compact(F.array(F.when(F.col("has_placeholder"), "has_placeholder"), F.when(F.col("long_text"), "long_text")))
    return rows.withColumn("score", score).withColumn("warnings", warnings).drop("long_text")


def _fits(name: str) -> Column:
    return F.coalesce({
        "number": F.col("section_no") == F.col("hint_number"),
        "name": (F.col("hint_name") != "") & F.contains(F.lower("name"), F.lower("hint_name")),
    }[name], F.lit(False))


def hint_flags(pairs: DataFrame) -> DataFrame:
    """(zone_id, by_number, by_name): whether a zone's hint_number picks its candidates, and then its hint_name. A hint that fits none (or, for the name, has only one candidate left) picks nothing."""
    number, name = _fits("number"), _fits("name")
    counts = pairs.groupBy("zone_id").agg(F.count_if(number).alias("n"), F.count("*").alias("all"), F.max(number & name).alias("both"), F.max(name).alias("any"))
    by_number = F.col("n") > 0
    left, named = F.when(by_number, F.col("n")).otherwise(F.col("all")), F.when(by_number, F.col("both")).otherwise(F.col("any"))
    return counts.select("zone_id", by_number.alias("by_number"), ((left > 1) & named).alias("by_name"))


def picked() -> Column:
    """Whether a candidate of a zone with hint_flags is one of those that the hints pick."""
    return (_fits("number") | ~F.col("by_number")) & (_fits("name") | ~F.col("by_name"))


def usable() -> Column:
    """Whether a section has words and no placeholder."""
    return (F.col("s_n_words") > 0) & ~F.col("has_placeholder")


def _scored_pairs(asked: DataFrame, sections: DataFrame, config: Config) -> DataFrame:
    """Every reading with every section of its pack that its hints leave; forms are made where texts are read, and texts stay there."""
    # Hints need numbers and names only: they pick the candidates before any text is compared.
    flags = hint_flags(asked.select("zone_id", "pack_id", "hint_number", "hint_name").join(sections.select("pack_id", "section_no", "name"), "pack_id"))
    readings, facts = with_forms(asked, "reading", "r").drop("reading", "r_n_words"), with_section_facts(sections).drop("content")
    scored = score_sections(readings.join(flags, "zone_id").join(facts, "pack_id").where(picked()), config).withColumn("usable", usable())
    scored = scored.select("zone_id", "ord", "section_no", "name", F.col("hint_number").isNotNull().alias("numbered"), "score", "strict_equal", "soft_equal", "has_placeholder", "usable")
    all_ = W.partitionBy("zone_id")
    return scored.withColumn("only_placeholders", F.min("has_placeholder").over(all_)).withColumn("left", F.count("*").over(all_))


def _scored_by_index(asked: DataFrame, sections: DataFrame, config: Config) -> DataFrame:
    """Every reading with the sections among which its two best are, and what the hints left of its pack."""
    hinted = asked.groupBy("pack_id", "hint_number", F.coalesce("hint_name", F.lit("")).alias("hint_name")).agg(F.sum(F.length("reading")).alias("weight"))
    hints = written(index.with_scopes(hinted, sections, hint_flags)[0], "section-scopes")
    scopes = hints.select(*index.SCOPE).distinct()
    of_sections = scopes.join(sections.select("pack_id", "section_no", "name", F.length("content").alias("weight")), "pack_id").where(picked())
    grid = written(index.grid(hints, of_sections), "section-grid")
    # Up to a number of hints, counted first, neither texts nor forms are shuffled to meet them.
    dealt = F.broadcast if hints.count() <= index.BROADCAST_HINTS else lambda rows: rows
    spaced = ~F.coalesce(F.col("lang"), F.lit("")).isin(*CJK)
    readings = asked.select("zone_id", spaced.alias("spaced"), F.col("hint_number").isNotNull().alias("numbered"), index.hint_key().alias("hint"), "reading")
    readings = with_forms(readings.join(dealt(hints.select("hint", "scope").join(grid, "scope")), "hint").drop("hint"), "reading", "r").drop("reading")
    facts = with_section_facts(sections).drop("content").withColumn("usable", usable())
    members = index.members(dealt(scopes.join(grid, "scope")), facts, picked(), section_bases(config), "section_no", "name", "usable", "blocks", "parts")
    found = index.best_two(readings, members, "numbered")
    # Each reading has met each block of its scope once, and a block's first row has its sections.
    all_ = W.partitionBy("zone_id")
    return found.withColumn("only_placeholders", F.min("only").over(all_)).withColumn("left", F.sum("sections").over(all_))


def select_sections(readings: DataFrame, sections: DataFrame, config: Config = DEFAULT, indexed: bool = False) -> DataFrame:
    """A row for each reading (zone_id, pack_id, lang, reading, hint_number, hint_name): the section that it matches best.

    sections has (pack_id, ord, section_no, name, content), ord unique in a
    pack. Returns zone_id, section_no, name, status, reason, manual_required,
    delta, score_top1, score_top2, confidence, margin.

    Readings are scored against all sections of their pack or, with indexed,
    by an index of words of each block of a pack's sections: the same rows, for
    packs of thousands of sections.
    """
    short = F.length(stripped(F.col("reading"))) < 3
    known = sections.select("pack_id").distinct().withColumn("has_sections", F.lit(True))
    if "lang" in sections.columns:
        sections = sections.drop("lang")
    scored = (_scored_by_index if indexed else _scored_pairs)(readings.where(~short), sections, config)
    ranked = W.partitionBy("zone_id").orderBy(F.desc("score"), "ord")
    scored = scored.withColumn("rank", F.row_number().over(ranked)).withColumn("second", F.lead("score").over(ranked)).where("rank = 1")
    delta = F.coalesce(F.col("score") - F.col("second"), F.lit(config.single_delta))
    c = G.reference_confidence(F.col("score"), F.col("second"), F.col("usable"), config)
    stuck = F.col("only_placeholders") & ~(F.col("numbered") & (F.col("left") == 1))
    reason = (
        F.when(stuck, "all_placeholders").when((delta < config.ambiguous_delta) & ~F.col("strict_equal"), "ambiguous_delta")
        .when(F.col("strict_equal"), "strict_equal").when(F.col("soft_equal"), "soft_equal_only").otherwise("no_match")
    )
    best = scored.select(
        "zone_id", "section_no", "name", delta.alias("delta"), F.col("score").alias("score_top1"), F.col("second").alias("score_top2"),
        F.when(stuck, 0.0).otherwise(c["confidence"]).alias("confidence"), c["margin"].alias("margin"), reason.alias("reason"), F.lit(True).alias("found"),
    )
    rows = readings.select("zone_id", "pack_id", F.coalesce(short, F.lit(False)).alias("short")).join(known, "pack_id", "left").join(best, "zone_id", "left")
    reason = F.when(F.col("has_sections").isNull(), "no_sections").when(F.col("short"), "ocr_too_short").otherwise(F.col("reason"))
    rows = rows.withColumn("reason", reason)
    return rows.select(
        "zone_id", "section_no", "name", F.when(F.col("reason") == "strict_equal", "PASS").otherwise("MANUAL").alias("status"), "reason",
        (~F.col("reason").isin("strict_equal", "no_match")).alias("manual_required"), F.coalesce("delta", F.lit(0.0)).alias("delta"), "score_top1", "score_top2",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    )


def lock_references(english: DataFrame, sections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(zone_id, section_no) for English readings: the number hinted at, else the first section whose name contains the hint, else the best match."""
    named = english.where("hint_number is null and hint_name <> ''").join(sections, "pack_id")
    named = named.where(F.contains(F.lower("name"), F.lower("hint_name"))).groupBy("zone_id").agg(F.min_by("section_no", "ord").alias("by_name"))
    free = english.join(named, "zone_id", "left_anti").where("hint_number is null")
    best = select_sections(free, sections, config).select("zone_id", F.col("section_no").alias("by_text"))
    return english.join(named, "zone_id", "left").join(best, "zone_id", "left").select("zone_id", F.coalesce("hint_number", "by_name", "by_text").alias("section_no"))


def localized_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows (zone_id, pack_id, lang, section_no) with content: that language's section of the same number, the first in document order."""
    first = sections.where("section_no is not null").groupBy("pack_id", "lang", "section_no").agg(F.min_by("content", "ord").alias("content"))
    return rows.join(first, ["pack_id", "lang", "section_no"], "left")
