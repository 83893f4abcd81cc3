"""File paths of archives: kind, language, target, size, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.config import (
    COMPOSITE_LANGUAGES,
    IMAGE_EXTENSIONS,
    LANGUAGE_ALIASES,
    LANGUAGES,
    NOT_LANGUAGES,
    TEXT_EXTENSIONS,
    VARIANT_PREFIXES,
)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    """image, text, archive or other; null for a directory."""
    e = extension(path)
    return (
        F.when(path.endswith("/"), None).when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*TEXT_EXTENSIONS), "text").when(e == "zip", "archive").otherwise("other")
    )


def media_type(path: Column) -> Column:
    e = extension(path)
    return (
        F.when(e.isin("jpg", "jpeg"), "image/jpeg").when(e.isin("png", "gif", "webp"), F.concat(F.lit("image/"), e)).otherwise("application/octet-stream")
    )


def target_id(path: Column) -> Column:
    """The folders of an entry after the first inner archive, or `default`."""
    inner = F.regexp_replace(path, r"^.*?!/", "")
    parts = F.filter(F.split(inner, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")).otherwise("default")


def area(path: Column) -> Column:
    """Width times height if the path holds a size, else 0."""
    found = F.regexp_extract(path, r"\d{2,4}x\d{2,4}", 0)
    sides = F.split(found, "x")
    return F.when(found == "", F.lit(0).cast("long")).otherwise(sides[0].cast("long") * F.element_at(sides, -1).cast("long"))


def alias(code: Column) -> Column:
    """The code that packs use for a language code of file names."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    low = F.lower(code)
    return F.coalesce(F.element_at(table, low), low)


def language(path: Column, brands: tuple[str, ...] = (), not_languages: tuple[str, ...] = ()) -> Column:
    """The language code in a file name, or null; the first rule that finds one decides.

    brands are a site's prefixes before a code, not_languages its stems that are
    never one; both come on top of the fixed lists.
    """
    name = stem(path)
    low = F.lower(name)
    denied = low.isin(*NOT_LANGUAGES, *not_languages) & ~low.isin(*LANGUAGES)
    clean = F.regexp_replace(F.regexp_replace(low, r"\d{2,4}x\d{2,4}", ""), r"^[_\- .]+|[_\- .]+$", "")
    inner = F.trim(F.regexp_extract(low, r"\(([^)]+)\)", 1))
    tokens = F.filter(F.split(clean, "[^a-z]+"), lambda t: t != "")
    known = lambda t: t.isin(*LANGUAGES)
    composite = [F.when(clean.rlike(f"(?<![a-z]){c}(?![a-z])"), c) for c in sorted(COMPOSITE_LANGUAGES, key=lambda c: (-len(c), c))]
    prefixes = (*VARIANT_PREFIXES, *brands)
    after = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.when(F.element_at(tokens, i).isin(*prefixes) & known(F.element_at(tokens, i + 1)), F.element_at(tokens, i + 1))
        ),
        lambda t: t.isNotNull(),
    )
    by_prefix = F.when(F.size(tokens) > 1, F.get(after, F.lit(0)))
    last = F.get(F.reverse(F.filter(tokens, known)), F.lit(0))
    code = F.coalesce(F.when(inner.isin(*COMPOSITE_LANGUAGES) | known(inner), inner), *composite, by_prefix, last)
    return F.when(denied, None).when(name.rlike("^[a-zA-Z]{2}$"), alias(name)).otherwise(alias(code))


def display_code(lang: Column, path: Column) -> Column:
    """A two-letter code to show: the row's language, else the file's stem, else `und`."""

    def shown(value: Column) -> Column:
        v = F.lower(F.coalesce(value, F.lit("")))
        v = F.when(v == "cn", "zh-hans").when(v == "kr", "ko").when(v == "ua", "uk").otherwise(v)
        letters = F.regexp_replace(v, "[^a-z]", "")
        return F.when((v == "") | (v == "und"), "und").when(v.rlike("^[a-z]{2}$"), v).when(F.length(letters) >= 2, F.substring(letters, 1, 2)).otherwise("und")

    own = shown(lang)
    return F.when(own != "und", own).otherwise(shown(stem(F.regexp_replace(path, r"\\", "/"))))


def is_rtl(lang: Column) -> Column:
    return F.coalesce(F.split(lang, "-")[0].isin("ar", "he", "il"), F.lit(False))


def storage_key(prefix: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.replace(name, F.lit(".."), F.lit("_")))
