"""Archives as tables of entry paths: layout, targets, choice of files, zones and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, ENGINES, Config
from proofmill.functions import geometry as G
from proofmill.functions import paths as P
from proofmill.operators.ranks import with_ranks


def entries(files: DataFrame) -> DataFrame:
    """(archive, ord, path) with kind, lang, target_id and area; directories are left out."""
    path = F.col("path")
    rows = files.select("archive", "ord", "path", P.file_kind(path).alias("kind"), P.language(path).alias("lang"), P.target_id(path).alias("target_id"), P.area(path).alias("area"))
    return rows.where("kind is not null")


def usable_entries(rows: DataFrame) -> DataFrame:
    """The entries that an archive's layout makes images or texts.

    With inner archives, only their entries count. Without, images/ and texts/
    folders decide if there is one, and else every entry counts.
    """
    by = W.partitionBy("archive")
    low = F.lower("path")
    inner = F.contains(F.col("path"), F.lit("!/"))
    rows = rows.withColumn("nested", F.max(inner).over(by))
    rows = rows.withColumn("folders", F.max(F.contains(low, F.lit("images/")) | F.contains(low, F.lit("texts/"))).over(by))
    in_folder = ((F.col("kind") == "image") & F.contains(low, F.lit("images/"))) | ((F.col("kind") == "text") & F.contains(low, F.lit("texts/")))
    layout = F.when(F.col("nested"), "nested").when(F.col("folders"), "folders").otherwise("mixed")
    keep = F.when(F.col("nested"), inner).when(F.col("folders"), in_folder).otherwise(True)
    return rows.withColumn("layout", layout).where(keep & F.col("kind").isin("image", "text")).drop("nested", "folders")


def one_per_language(rows: DataFrame, kind: str) -> DataFrame:
    """One entry of a kind for each archive and language: the largest image, the first text; ties by order."""
    order = [F.desc("area"), F.asc("ord")] if kind == "image" else [F.asc("ord")]
    by = W.partitionBy("archive", "lang").orderBy(*order)
    rows = rows.where((F.col("kind") == kind) & F.col("lang").isNotNull())
    return rows.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def expand_zones(images: DataFrame, zones: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(archive, path, lang, target_id, zone_name, bbox): images by the zones of their target.

    zones has (target_id, ord, zone_name, bbox), fallback (target_id, bbox) one
    box for targets without zones. Malformed boxes are dropped after it is
    known that a target has zones: it may then have no row. Images of targets
    with neither keep a row without a box.
    """
    listed = zones.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("ord", "zone_name", "bbox"))).alias("zones"))
    rows = images.join(listed, "target_id", "left")
    if fallback is not None:
        one = fallback.where(F.size("bbox") == 4).select("target_id", F.col("bbox").alias("one"))
        rows = rows.join(one, "target_id", "left")
        single = F.when(F.col("one").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("zone_name"), F.col("one").alias("bbox"))))
        rows = rows.withColumn("zones", F.coalesce("zones", single))
    wide = rows.select("archive", "path", "lang", "target_id", F.col("zones").isNull().alias("bare"), F.explode_outer("zones").alias("z"))
    return wide.where(F.col("bare") | G.valid_bbox(F.col("z.bbox"))).select("archive", "path", "lang", "target_id", "z.zone_name", "z.bbox")


def target_summary(images: DataFrame) -> DataFrame:
    """(archive, target_id, items, en_available, preview), in the order of targets."""
    english = F.col("lang") == "en"
    return (
        images.groupBy("archive", "target_id")
        .agg(F.count("*").alias("items"), F.coalesce(F.max(english), F.lit(False)).alias("en_available"), F.min(F.when(english, F.col("path"))).alias("preview"))
        .orderBy("archive", "target_id")
    )


def archive_counts(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """(archive, entries, images, queued, with_bbox, without_bbox)."""
    seen = rows.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "image").alias("images"))
    queued = expanded.groupBy("archive").agg(F.count("*").alias("queued"), F.count("bbox").alias("with_bbox"))
    both = seen.join(queued, "archive", "left").na.fill(0, ["queued", "with_bbox"])
    return both.withColumn("without_bbox", F.col("queued") - F.col("with_bbox"))


def coverage(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(archive, lang, gap): languages with an image and no text, a text and no image, and targets (as lang) without English."""
    a, b = images.select("archive", "lang").distinct(), texts.select("archive", "lang").distinct()
    english = images.where("lang = 'en'").select("archive", "target_id").distinct()
    no_english = images.select("archive", "target_id").distinct().join(english, ["archive", "target_id"], "left_anti")
    parts = [
        a.where("lang is not null").join(b, ["archive", "lang"], "left_anti").withColumn("gap", F.lit("no_text")),
        b.where("lang is not null").join(a, ["archive", "lang"], "left_anti").withColumn("gap", F.lit("no_image")),
        no_english.select("archive", F.col("target_id").alias("lang"), F.lit("no_english").alias("gap")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def batches(rows: DataFrame, keys: tuple[str, ...], *order: Column, config: Config = DEFAULT) -> DataFrame:
    """rows with chunk: every config.batch_size rows of a key in order share one. A key that holds most rows is ranked in many tasks."""
    ranked = with_ranks(rows, keys, list(order), "chunk")
    return ranked.withColumn("chunk", F.floor(F.col("chunk") / config.batch_size))


def lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (archive, name) with path: the stored path of that name, else the first that has its basename."""
    whole = stored.select("archive", F.col("path").alias("name"), F.col("path").alias("exact")).distinct()
    base = stored.groupBy("archive", P.basename(F.col("path")).alias("base")).agg(F.min_by("path", "ord").alias("loose"))
    rows = requests.join(whole, ["archive", "name"], "left").withColumn("base", P.basename(F.col("name"))).join(base, ["archive", "base"], "left")
    return rows.select("archive", "name", F.coalesce("exact", "loose").alias("path"))


def reference_image(images: DataFrame) -> DataFrame:
    """The rows of each archive's first English image."""
    first = images.where("lang = 'en'").groupBy("archive").agg(F.min_by("path", "ord").alias("path"))
    return images.join(first, ["archive", "path"], "left_semi")


def batch_language(rows: DataFrame) -> DataFrame:
    """(archive, target_id, lang, path) for images with an optional hint: the hinted language, else English, else the first; its first image, else the target's first."""
    by = ["archive", "target_id"]
    picked = rows.groupBy(*by).agg(
        F.coalesce(F.max("hint"), F.when(F.max(F.col("lang") == "en"), F.lit("en")), F.min("lang")).alias("want"), F.min_by("path", "ord").alias("first")
    )
    own = rows.join(picked, by).where("lang = want").groupBy(*by).agg(F.min_by("path", "ord").alias("own"))
    return picked.join(own, by, "left").select(*by, F.col("want").alias("lang"), F.coalesce("own", "first").alias("path"))


def spread_zones(zones: DataFrame, targets: DataFrame) -> DataFrame:
    """(template_name, target_id, zone_name, bbox) for zones (template_name, target_id, zone_name, bbox) and targets (template_name, target_id).

    Templates in which no zone names a target lay all their zones over all
    their targets; in the others a zone stays where it is named.
    """
    named = F.count("target_id").over(W.partitionBy("template_name"))
    rows = zones.withColumn("named", named)
    own = rows.where("named > 0 and target_id is not null").select("template_name", "target_id", "zone_name", "bbox")
    free = rows.where("named = 0").select("template_name", "zone_name", "bbox").join(targets, "template_name")
    return own.unionByName(free.select("template_name", "target_id", "zone_name", "bbox"))


def matching_templates(archives: DataFrame, templates: DataFrame) -> DataFrame:
    """(archive, template_name): the template whose name is the archive's file name, null where there is none."""
    names = templates.select(F.col("template_name").alias("file_name"), "template_name").distinct()
    return archives.select("archive", "file_name").join(names, "file_name", "left").select("archive", "template_name")


def engine_list(text: Column) -> Column:
    """The engines of a comma-separated column; empty names are left out, an empty text means the first engine."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda e: e != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(ENGINES[0]))).otherwise(found)


def engine_text(engines: Column) -> Column:
    return F.array_join(engines, ",")
