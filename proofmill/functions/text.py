"""Unicode-aware text normalisation as Column functions.

Everything is built-in expressions on the JVM. Input is taken to be composed
(NFC); `composed` brings a table to that form once, where it is read.
Null texts count as empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofmill.config import PLACEHOLDERS

#: Unicode white space; the \s of Java and of RE2 is ASCII.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters as a list.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Where a line ends.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Deleted: emoji and symbols, arrows and bullets, direction marks, soft hyphens, zero-width characters.
DELETED = (
    r"[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{25B0}-\x{25FF}\x{2190}-\x{21FF}\x{2022}\x{B7}"
    r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{AD}\x{200B}-\x{200D}\x{FEFF}]"
)
SPACES = "\u00A0\u202F\u2009\u2007\u2008\u200A\u3000\u1680\u180E"
DASHES = "\u2013\u2014\u2015\u2012\u2011"
#: Characters folded one to one, and to what; guillemets are folded apart.
FOLDED = SPACES + DASHES + "\u201C\u201D\u2018\u2019\u2039\u203A"
FOLDS = " " * len(SPACES) + "-" * len(DASHES) + "\"\"''''"
GUILLEMETS = "\u00AB\u00BB"
STRICT_DROP = r'[^\p{L}\p{N}_!?".,$%&]+'
STRICT_DROP_FR = r'[^\p{L}\p{N}_!?".,$%&:;\x{AB}\x{BB}]+'
#: Punctuation but the brackets and the percent sign, and white space.
CONSENSUS_DROP = rf"(?:[\p{{P}}&&[^<>\[\]%]]|[{WS}])+"
PLACEHOLDER = "(?i)" + "|".join(
    rf"{a}[{WS}]*(?:{'|'.join(PLACEHOLDERS)})[{WS}]*{b}" for a, b in (("%", "%"), (r"\[", r"\]"), ("<", ">"))
)
#: White space beyond ASCII that ends a line, and that doesn't; what ends a line within ASCII.
_FAR_ENDS = "\u0085  "
_FAR_SPACES = "".join(c for c in WS_CHARS if c > "\x7F" and c not in _FAR_ENDS)
_NEAR_ENDS = r"\n\r\x0B\x0C\x1C\x1D\x1E"
LEVELS = ("strict", "soft", "consensus")
#: Any character but ASCII and the letters from U+00C0 to U+024F. Most texts have none: nothing in them is deleted or
#: folded, and classes of single characters, which match ten times faster, do the work of the general ones.
NOT_PLAIN = r"[^\x00-\x9F\xC0-\x{24F}]"


#: DELETED for searching: an intersection ends at its first part for all ASCII, where a union of ranges tries each.
_DELETED = rf"[\x{{80}}-\x{{10FFFF}}&&{DELETED}]"


def _beyond_ascii(chars: str) -> str:
    return "[\\x{80}-\\x{10FFFF}&&[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]]"


def _folded(text: Column, chars: str, folds: str) -> Column:
    """text with each of some characters beyond ASCII as another one: as translate does it, but by a search for each of the few folds."""
    for to in dict.fromkeys(folds):
        text = F.regexp_replace(text, _beyond_ascii("".join(c for c, f in zip(chars, folds, strict=True) if f == to)), to)
    return text


def _singles(*ranges: tuple[int, int]) -> str:
    """The characters of ranges below U+0100 one by one, for a class: Java looks single characters up in a table, but goes through the ranges of a class one after another."""
    return "".join(f"\\x{c:02X}" for first, last in ranges for c in range(first, last + 1))


PLAIN_LETTERS = _singles((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)) + r"\x{100}-\x{24F}"
PLAIN_WS = _singles((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85))
_KEPT = _singles((ord("a"), ord("z")), (ord("0"), ord("9"))) + '_!?".,$%&'
PLAIN_STRICT_DROP = rf"[^{_KEPT}{PLAIN_LETTERS}]+"
PLAIN_STRICT_DROP_FR = rf"[^{_KEPT}:;{PLAIN_LETTERS}]+"
PLAIN_CONSENSUS_DROP = rf"""[!"#&'()*,\-./:;?@\\_{{}}{PLAIN_WS}]+"""


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _by_kind(text: Column, plain: Column, general: Column) -> Column:
    """plain for texts of plain characters, else general."""
    return F.when(text.rlike(NOT_PLAIN), general).otherwise(plain)


def _is_french(lang: Column | None) -> Column:
    return F.lit(False) if lang is None else F.coalesce(F.lower(lang) == "fr", F.lit(False))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns in composed form. Only texts with a character from U+0300 on reach Python."""
    for name in columns:
        text = F.col(name)
        df = df.withColumn(name, F.coalesce(_nfc(F.when(text.rlike(r"[\x{0300}-\x{10FFFF}]"), text)), text))
    return df


def pre_clean(text: Column | str, lang: Column | None = None) -> Column:
    """Deletes invisible and decorative characters, folds spaces, dashes and quotes; French keeps its guillemets."""
    return _by_kind(_text(text), _text(text), _pre_clean(text, lang))


def _pre_clean(text: Column | str, lang: Column | None) -> Column:
    kept = F.replace(_folded(F.regexp_replace(_text(text), _DELETED, ""), FOLDED, FOLDS), F.lit("\u2026"), F.lit("..."))
    # What is French is asked of the pattern, so that the text before is made once.
    guillemets = _beyond_ascii(GUILLEMETS)
    pattern = F.lit(guillemets) if lang is None else F.when(_is_french(lang), r"(?!)").otherwise(guillemets)
    return F.regexp_replace(kept, pattern, F.lit('"'))


def remove_brand(text: Column, brand: str | None) -> Column:
    """Deletes a site's own name, in any case, where it stands as a word."""
    return text if not brand else F.regexp_replace(text, rf"(?i)(?<!\w)\Q{brand}\E(?!\w)" if not brand.isalnum() else rf"(?i)\b{brand}\b", "")


def remove_placeholders(text: Column | str) -> Column:
    """Known placeholders become a space; other %..%, [..] and <..> stay. Most texts have no character that opens one."""
    t = _text(text)
    return F.when(t.rlike(r"[%\[<]"), F.regexp_replace(t, PLACEHOLDER, " ")).otherwise(t)


def _unless_known(pair: Column) -> Column:
    """A pair of marks and what is between; a space if that is a known name."""
    name = F.lower(F.btrim(F.substr(pair, F.lit(2), F.length(pair) - 2), F.lit(WS_CHARS)))
    return F.when(name.isin(*PLACEHOLDERS), " ").otherwise(pair)


def _without_known(text: Column, pair: str) -> Column:
    """text with a space for each pair of marks around a known name; the text is made once, as the one element of an array."""

    def one(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(f"({pair})"), 1), _unless_known)
        return F.array_join(F.zip_with(F.split(t, pair, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return F.get(F.transform(F.array(text), one), F.lit(0))


def remove_paired_placeholders(text: Column | str) -> Column:
    """As remove_placeholders, but marks pair from the left, %..% first, then [..] and <..>: a pair around an unknown name takes its marks along, so that in `50% x %skin%` no name stands between marks of its own."""
    t = _text(text)
    for a, b in (("%", "%"), (r"\[", r"\]"), ("<", ">")):
        t = _without_known(t, f"{a}[^{b}]+{b}")
    return F.when(_text(text).rlike(r"[%\[<]"), t).otherwise(_text(text))


def may_hold_placeholder(text: Column | str) -> Column:
    """Whether a text has a character that opens a placeholder; in others strict and soft forms are alike."""
    return _text(text).rlike(r"[%\[<]")


def has_placeholder(text: Column | str) -> Column:
    return may_hold_placeholder(text) & _text(text).rlike(PLACEHOLDER)


def collapse(text: Column | str) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    t = _text(text)
    # Most white space is single spaces, which can stay.
    plain = F.regexp_replace(F.regexp_replace(t, f"[{PLAIN_WS.replace(_singles((0x20, 0x20)), '')}]", " "), "  +", " ")
    return F.trim(_by_kind(t, plain, F.regexp_replace(t, f"[{WS}]+", " ")))


def normalize(text: Column | str, level: str = "strict", lang: Column | None = None, brand: str | None = None) -> Column:
    """A text in the form in which it is compared.

    strict keeps letters, digits and ! ? " . , $ % & _; soft drops placeholders
    before that; consensus only lower-cases and turns punctuation other than
    < > [ ] % into spaces. In French strict and soft also keep : ; and guillemets.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(LEVELS)}")
    t = _text(text)
    if level == "consensus":
        low = F.lower(t)
        return F.trim(_by_kind(t, F.regexp_replace(low, PLAIN_CONSENSUS_DROP, " "), F.regexp_replace(low, CONSENSUS_DROP, " ")))

    def form(clean: Column, drop: str, drop_fr: str) -> Column:
        low = F.lower(remove_brand(clean, brand))
        if level == "soft":
            low = remove_placeholders(low)
        plain = F.regexp_replace(low, drop, " ")
        return plain if lang is None else F.when(_is_french(lang), F.regexp_replace(low, drop_fr, " ")).otherwise(plain)

    return F.trim(_by_kind(t, form(t, PLAIN_STRICT_DROP, PLAIN_STRICT_DROP_FR), form(_pre_clean(t, lang), STRICT_DROP, STRICT_DROP_FR)))


def normalized_lines(text: Column | str, level: str = "soft") -> Column:
    """The normalised lines of a text that aren't empty."""
    return F.filter(F.transform(F.split(_text(text), r"[\r\n]+"), lambda x: normalize(x, level)), lambda x: x != "")


def strict_lines(text: Column | str) -> Column:
    """The strict lines of a text that aren't empty, by one pass over it; joined by spaces they are its strict form."""
    t = _text(text)
    kept = lambda clean, drop: F.regexp_replace(F.lower(clean), drop[:-2] + r"\r\n]+", " ")
    return F.filter(F.split(F.trim(_by_kind(t, kept(t, PLAIN_STRICT_DROP), kept(_pre_clean(t, None), STRICT_DROP))), r" ?[\r\n][\r\n ]*"), lambda x: x != "")


def clean_for_display(text: Column | str, lang: Column | None = None, brand: str | None = None) -> Column:
    """For people: cleaned like strict, in its own case, without any %..%; blank lines go."""
    # Without an opening mark nothing is a placeholder, and cleaning makes none: the text that is given is asked, so that the cleaned one is made once.
    clean = remove_brand(pre_clean(text, lang), brand)
    kept = F.when(may_hold_placeholder(text), F.regexp_replace(F.regexp_replace(clean, PLACEHOLDER, " "), "%[^%]+%", " ")).otherwise(clean)
    kept = _folded(kept, _FAR_SPACES + _FAR_ENDS, " " * len(_FAR_SPACES) + "\n" * len(_FAR_ENDS))
    spaced = F.regexp_replace(F.regexp_replace(kept, r"[\t\x1F]", " "), "  +", " ")
    return F.btrim(F.regexp_replace(spaced, f" ?[{_NEAR_ENDS}][ {_NEAR_ENDS}]*", "\n"), F.lit(" \n"))


def table_view(text: Column | str) -> Column:
    """For a table cell: newlines unified, trailing blanks off, quotes and dashes folded, brackets and invisible characters deleted, case kept."""
    unified = F.regexp_replace(F.regexp_replace(_text(text), r"\r\n?", "\n"), r"[\t ]+(\n|\z)", "$1")
    deleted = F.regexp_replace(
        unified,
        r"[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200E}\x{200F}\x{202A}-\x{202E}\x{200B}-\x{200D}\x{FEFF}<>\[\]]", "",
    )
    folded = F.translate(deleted, DASHES + "\u201C\u201D\u00AB\u00BB\u2018\u2019\u2039\u203A", "-----\"\"\"\"''''")
    return _by_kind(_text(text), F.regexp_replace(unified, r"[<>\[\]]", ""), F.replace(folded, F.lit("\u2026"), F.lit("...")))


def judge_form(text: Column | str, lang: Column | None = None, brand: str | None = None) -> Column:
    """As a judge sees it: for display, without brackets, lower-cased."""
    return F.lower(F.regexp_replace(clean_for_display(text, lang, brand), r"[\[\]<>()]", " "))


def strip_heading_marks(text: Column | str) -> Column:
    """Deletes # marks at line starts with the white space that follows. Only \\n ends a line here, as in Python and RE2; by itself Java would take others too."""
    return F.regexp_replace(_text(text), rf"(?dm)^#+[{WS}]*", "")


def has_letter_or_digit(text: Column | str) -> Column:
    return _text(text).rlike(r"[\p{L}\p{N}]")


def words(text: Column) -> Column:
    """The words of a normalised text (single spaces); none if it is empty."""
    return F.array_remove(F.split(text, " "), "")
