"""Template catalogues: one JSON document for each template, in a main and a fallback store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, ENGINES, Config
from proofmill.functions import geometry as G

ZONE = "struct<name string, type string, bbox array<int>, engines array<string>, engine_config map<string,string>, notes string>"
TEMPLATE = (
    f"template_name string, schema_version int, source_size array<int>, zones array<{ZONE}>, expected_texts map<string,map<string,string>>, "
    "created_at_utc string, updated_at_utc string"
)


def scan_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of a folder of JSON documents; documents that can't be read or have no name are skipped."""
    rows = spark.read.schema(TEMPLATE).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("modified")).where("template_name is not null")


def effective_time(updated: Column, created: Column, modified: Column | None = None) -> Column:
    """When a template counts as changed: its update, else its creation, else its file's time."""
    parts = [F.try_to_timestamp(updated), F.try_to_timestamp(created)]
    return F.coalesce(*parts, modified) if modified is not None else F.coalesce(*parts)


def listing(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """(name, updated): both stores, the main one first where a name is in both; newest first, then by name."""
    both = fallback.select("name", "updated", F.lit(0).alias("p")).unionByName(main.select("name", "updated", F.lit(1).alias("p")))
    rows = both.groupBy("name").agg(F.max_by("updated", "p").alias("updated"))
    return rows.orderBy(F.desc("updated"), "name")


def missing_from(main: DataFrame, fallback: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """Templates that only the fallback store has and that haven't expired: what an import copies."""
    return fallback.where(G.not_expired(F.col("updated"), now, config)).join(main.select("name"), "name", "left_anti")


def merged(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """(name, created, updated) after new (name, created) is saved over old: creation stays, the update is now."""
    both = old.select("name", F.col("created").alias("o"), "updated").join(new.select("name", F.col("created").alias("n"), F.lit(True).alias("saved")), "name", "full")
    return both.select("name", F.coalesce("o", "n", F.when(F.col("saved"), now)).alias("created"), F.when(F.col("saved"), now).otherwise(F.col("updated")).alias("updated"))


def template_faults(templates: DataFrame) -> DataFrame:
    """(template_name, faults): the rules that a template breaks, in order, for templates that break any."""
    zones = F.coalesce("zones", F.array().cast(f"array<{ZONE}>"))
    some = lambda rule: F.coalesce(F.exists(zones, rule), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    engines = lambda z: F.coalesce(z["engines"], F.array().cast("array<string>"))
    allowed = F.array(*map(F.lit, ENGINES))
    size = F.col("source_size")
    names = F.transform(zones, lambda z: z["name"])
    rules = [
        (blank(F.col("template_name")), "name_empty"), (F.coalesce(F.col("schema_version"), F.lit(1)) != 1, "schema_version"),
        (F.coalesce((F.size(size) != 2) | F.exists(size, lambda n: n <= 0), F.lit(True)), "source_size"), (some(lambda z: blank(z["name"])), "zone_name_empty"),
        (some(lambda z: ~F.coalesce(z["type"].isin("ocr", "logo"), F.lit(False))), "zone_type"), (some(lambda z: ~G.valid_bbox(z["bbox"])), "zone_bbox"),
        (some(lambda z: F.size(F.array_except(engines(z), allowed)) > 0), "engine_not_allowed"),
        (some(lambda z: (z["type"] == "ocr") & (F.size(engines(z)) == 0)), "ocr_without_engine"), (F.size(F.array_distinct(names)) != F.size(names), "zone_names_repeat"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))
    return templates.select("template_name", found.alias("faults")).where(F.size("faults") > 0)


def repeated_names(zones: DataFrame) -> DataFrame:
    """(template_name, name, n) of zone names that a template has more than once."""
    return zones.groupBy("template_name", "name").agg(F.count("*").alias("n")).where("n > 1")


def expected_texts(templates: DataFrame) -> DataFrame:
    """(template_name, lang, zone_name, text) from the nested map; what isn't a text is left out."""
    langs = templates.select("template_name", F.explode("expected_texts").alias("lang", "texts"))
    return langs.select("template_name", "lang", F.explode("texts").alias("zone_name", "text")).where("text is not null")


def with_expected(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows (lang, zone_name) with expected_text: that of the language, else the English one; en-* counts as en, null as und."""
    lang = F.when(F.lower("lang").startswith("en"), "en").otherwise(F.lower(F.coalesce("lang", F.lit("und"))))
    own = expected.select(F.col("lang").alias("e_lang"), "zone_name", F.col("text").alias("own"))
    english = expected.where("lang = 'en'").select("zone_name", F.col("text").alias("english"))
    both = rows.withColumn("e_lang", lang).join(own, ["e_lang", "zone_name"], "left").join(english, "zone_name", "left")
    return both.withColumn("expected_text", F.coalesce("own", "english")).drop("e_lang", "own", "english")


def built_templates(zones: DataFrame) -> DataFrame:
    """(template_name, zones): zones (template_name, ord, target_id, zone_name, bbox) named target::zone, with their notes as JSON."""
    notes = F.to_json(F.struct(F.col("target_id").alias("phase2_target_id"), F.col("zone_name").alias("phase2_zone_name")))
    zone = F.struct("ord", F.concat_ws("::", "target_id", "zone_name").alias("name"), "bbox", notes.alias("notes"))
    by = zones.groupBy("template_name").agg(F.array_sort(F.collect_list(zone)).alias("z"))
    return by.select("template_name", F.transform("z", lambda z: F.struct(z["name"].alias("name"), z["bbox"].alias("bbox"), z["notes"].alias("notes"))).alias("zones"))


def first_success(attempts: DataFrame, limit: int) -> DataFrame:
    """(request_id, attempt, text): the first attempt of the first `limit` with a text; null where none has."""
    ok = F.when((F.col("attempt") <= limit) & (F.coalesce("text", F.lit("")) != ""), F.struct("attempt", "text"))
    return attempts.groupBy("request_id").agg(F.min(ok).alias("a")).select("request_id", "a.attempt", "a.text")
