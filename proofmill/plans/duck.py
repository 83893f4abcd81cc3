"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from proofmill.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def pre(x: str, french: str | None = None) -> str:
    kept = f"translate({sub(f'coalesce({x}, {q("")})', T.DELETED, '')}, {q(T.FOLDED)}, {q(T.FOLDS)})"
    folded = f"translate({kept}, {q(T.GUILLEMETS)}, {q(chr(34) * 2)})"
    kept = folded if french is None else f"case when {french} then {kept} else {folded} end"
    return f"replace({kept}, {q(chr(0x2026))}, '...')"


def strict(x: str, french: str | None = None, soft: bool = False) -> str:
    low = f"lower({pre(x, french)})"
    low = sub(low, T.PLACEHOLDER, " ") if soft else low
    plain = sub(low, T.STRICT_DROP, " ")
    return f"trim({plain})" if french is None else f"trim(case when {french} then {sub(low, T.STRICT_DROP_FR, ' ')} else {plain} end)"


def soft(x: str, french: str | None = None) -> str:
    return strict(x, french, soft=True)


def consensus(x: str) -> str:
    kept, held = "%[]", "\ue000\ue001\ue002"
    return f"trim(translate({sub(f'translate(lower(coalesce({x}, {q("")})), {q(kept)}, {q(held)})', rf'[\p{{P}}{T.WS}]+', ' ')}, {q(held)}, {q(kept)}))"


def collapse(x: str) -> str:
    return f"trim({sub(f'coalesce({x}, {q("")})', f'[{T.WS}]+', ' ')})"


def lines(x: str, form) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[\\r\\n]+'), lambda l: {form('l')}), lambda l: l <> '')"


def display(x: str, french: str | None = None) -> str:
    kept = sub(sub(pre(x, french), T.PLACEHOLDER, " "), "%[^%]+%", " ")
    return f"array_to_string(list_filter(list_transform(string_split_regex({kept}, {q(T.LINE_END)}), lambda l: {collapse('l')}), lambda l: l <> ''), chr(10))"


def table_view(x: str) -> str:
    unified = sub(sub(f"coalesce({x}, '')", r"\r\n?", "\n"), r"[\t ]+(\n|\z)", r"\1")
    gone = sub(unified, r"[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200E}\x{200F}\x{202A}-\x{202E}\x{200B}-\x{200D}\x{FEFF}<>\[\]]", "")
    return f"replace(translate({gone}, {q(T.DASHES + chr(0x201C) + chr(0x201D) + chr(0xAB) + chr(0xBB) + chr(0x2018) + chr(0x2019) + chr(0x2039) + chr(0x203A))}, {q('-' * 5 + chr(34) * 4 + chr(39) * 4)}), {q(chr(0x2026))}, '...')"


#: DuckDB's levenshtein counts bytes: letters beyond ASCII become capitals, which lower-cased texts don't hold.
WIDE = "\u00e9\u00df\u00f6\u00ed\u00ea\u00fc\u00f1\u00e8\u00f3\u00e7\u00e4"


def whole_similarity(a: str, b: str) -> str:
    x, y = (f"translate({t}, {q(WIDE)}, 'ABCDEFGHIJK')" for t in (a, b))
    return f"1.0 - cast(levenshtein({x}, {y}) as double) / greatest(length({x}), length({y}))"


def similarity(a: str, b: str) -> str:
    x, y = (f"translate(substr({t}, 1, 2000), {q(WIDE)}, 'ABCDEFGHIJK')" for t in (a, b))
    return (
        f"case when substr({a}, 1, 2000) = substr({b}, 1, 2000) then 1.0 when {a} = '' or {b} = '' then 0.0 "
        f"else 1.0 - cast(levenshtein({x}, {y}) as double) / greatest(length({x}), length({y})) end"
    )
