"""Chat formatting into budgeted windows, in DataFrame functions.

A conversation's turns get prefix sums of their tokens. Windows are spans of
whole turns, filled one after another within stretches of the prefix sums, so
that, with the system turn and the history that a window repeats, none is
above the budget unless a single turn is; such a turn has a window of its own.
The system turn opens every window; a window after the first repeats the
turns of the last tokens before it. Only assistant turns that are new in a
window are targets: what is repeated is masked.

A turn is OPEN role MID text CLOSE. Control strings inside roles and texts are
broken up by a backslash after their first character, and backslashes are
doubled, so that formatted windows can be parsed and read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.common import written

BUDGET = 2048
HISTORY = 256
#: Turns whose prefix sums are found in one step.
BLOCK_TURNS = 4096
#: Windows' worth of tokens that are filled in one step.
STRETCH = 64
#: Tokens of a turn's marks, and characters that count as a token.
TURN_TOKENS = 4
CHARS_PER_TOKEN = 4
SYSTEM, TARGET = "system", "assistant"

# The control strings of the template.
OPEN, MID, CLOSE = "[INST]", "[/INST]", "</s>"
#: All control strings: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>; the first character with what must follow.
_CONTROL_RE = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def token_count(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN) + TURN_TOKENS


def _same(a: str, b: str, *names: str) -> list[Column]:
    return [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]


def _numbered(turns: DataFrame) -> DataFrame:
    """turns with `nth`, a number that grows in the order of conversation, turn, role and text.

    The order is cut into ranges of its keys, so that no task holds a hot
    conversation, nor one whose turns are alike or null; only rows that repeat
    all of them share a task. Texts take part with their beginnings when ranges
    are chosen, and as a whole within a range.
    """
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = turns.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    return written(ranged.withColumn("nth", F.monotonically_increasing_id()), "chat-turns")


def _placed(turns: DataFrame) -> DataFrame:
    """(conv, nth, tokens, is_system, ord, start): the place of numbered turns in their conversation, from 0, and the tokens before them; prefix sums are taken within blocks of turns, then over blocks."""
    turns = turns.select("conv", "nth", "tokens", "role", F.floor(F.col("nth") / BLOCK_TURNS).alias("block"))
    inside = W.partitionBy("conv", "block").orderBy("nth")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local = turns.withColumn("at", F.row_number().over(inside) - 1).withColumn("ahead", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    up_to = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("conv", "block", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(up_to), F.lit(0)).alias("t"))
    placed = local.alias("l").join(offsets.alias("r"), _same("l", "r", "conv", "block"))
    placed = placed.select("l.conv", "l.nth", "l.tokens", "l.role", (F.col("l.at") + F.col("r.n")).alias("ord"), (F.col("l.ahead") + F.col("r.t")).alias("start"))
    return written(placed.withColumn("is_system", (F.col("ord") == 0) & (F.col("role") == SYSTEM)).drop("role"), "chat-placed")


def _windows(places: DataFrame) -> DataFrame:
    """(conv, window, stop, first, back): windows hold the turns from ord `window` to before `stop`, `first` is the tokens before them, `back` those that are repeated.

    A window takes new turns while they leave room for the history. One that
    opens with a longer turn keeps room for the turn before it only, if that
    fits, so that a long question and its reply can share it.
    """
    stretches = places.groupBy("conv", "stretch", "room", "reserve").agg(F.array_sort(F.collect_list(F.struct("ord", "from", "tokens"))).alias("turns"))
    long, room, reserve = F.lit(0).cast("long"), F.col("room"), F.col("reserve")
    none = F.array().cast("array<struct<ord:long,from:long>>")

    def add(acc: Column, t: Column) -> Column:
        opens = (F.size(acc["edges"]) == 0) | ((acc["filled"] > 0) & (acc["filled"] + t["tokens"] > acc["cap"]))
        most = F.least(reserve, F.greatest(room - t["tokens"], long))
        before = F.when(acc["last"] < 0, most).when(acc["last"] <= most, acc["last"]).otherwise(long)
        cap = F.when(t["ord"] == 0, room).when(t["tokens"] <= room - reserve, room - reserve).otherwise(room - before)
        return F.struct(
            F.when(opens, t["tokens"]).otherwise(acc["filled"] + t["tokens"]).alias("filled"),
            F.when(opens, cap).otherwise(acc["cap"]).alias("cap"),
            t["tokens"].alias("last"),
            F.when(opens, F.concat(acc["edges"], F.array(F.struct(t["ord"].alias("ord"), t["from"].alias("from"))))).otherwise(acc["edges"]).alias("edges"),
        )

    start = F.struct(long.alias("filled"), long.alias("cap"), F.lit(-1).cast("long").alias("last"), none.alias("edges"))
    end = F.element_at("turns", -1)
    edges = F.concat(F.aggregate("turns", start, add, lambda acc: acc["edges"]), F.array(F.struct((end["ord"] + 1).alias("ord"), (end["from"] + end["tokens"]).alias("from"))))
    pairs = stretches.withColumn("edges", edges).withColumn("pair", F.explode(F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("a"), F.slice("edges", F.lit(2), F.size("edges") - 1).alias("b"))))
    fresh = F.col("pair.b.from") - F.col("pair.a.from")
    return pairs.select(
        "conv", F.col("pair.a.ord").alias("window"), F.col("pair.b.ord").alias("stop"), F.col("pair.a.from").alias("first"),
        F.least(reserve, F.greatest(room - fresh, long)).alias("back"),
    )


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss) for (conv_id, turn, role, text).

    window is the place of its first new turn in the conversation, from 0.
    text is a formatted window, n_repeated the number of its first turns that
    an earlier window holds, loss the spans (start, length, in code points) of
    text that are to be learned. Null texts and roles are empty; null turns
    come first; rows with equal turns are ordered by role and text, and repeated rows are
    turns of their own. A null conv_id is a conversation. No rows give none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"),
        token_count(text).alias("tokens"),
    )
    turns = _numbered(turns)
    placed = _placed(turns)
    systems = written(placed.where("is_system").select("conv", "nth", F.col("tokens").alias("s_tokens")), "chat-systems")
    places = placed.alias("l").join(systems.alias("r"), _same("l", "r", "conv"), "left").select("l.conv", "l.ord", "l.nth", "l.start", "l.tokens", "l.is_system", F.coalesce("r.s_tokens", F.lit(0)).alias("s_tokens"))
    room = F.greatest(F.lit(budget) - F.col("s_tokens"), F.lit(0)).cast("long")
    # The history takes at most half of the room, so that few windows repeat a turn.
    places = places.withColumn("room", room).withColumn("reserve", F.least(F.lit(history), F.floor(F.col("room") / 2)).cast("long"))
    places = places.withColumn("from", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("start") - F.col("s_tokens")).cast("long"))
    places = places.withColumn("tokens", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens")).cast("long")).withColumn("ord", F.col("ord").cast("long"))
    places = places.withColumn("stretch", F.floor(F.col("from") / (STRETCH * F.greatest(F.col("room") - F.col("reserve"), F.lit(1)))))
    places = written(places.drop("start", "s_tokens"), "chat-places")
    spans = written(_windows(places), "chat-spans")

    # Repeated turns start in the cell of a window's last tokens before it, or in the one before.
    cell = max(history, 1)
    ahead = spans.where("window > 0 and back > 0").withColumn("least", F.greatest(F.col("first") - F.col("back"), F.lit(0)))
    ahead = ahead.withColumn("cell", F.explode(F.sequence(F.floor(F.col("least") / cell), F.floor((F.col("first") - 1) / cell))))
    cells = places.where(~F.col("is_system")).select("conv", "ord", "nth", "from", F.floor(F.col("from") / cell).alias("cell"))
    past = ahead.alias("l").join(cells.alias("r"), _same("l", "r", "conv", "cell")).where("r.from >= l.least and r.ord < l.window")
    past = past.select("l.conv", "l.window", F.lit(True).alias("repeated"), "r.ord", "r.nth")
    # Numbers of a conversation follow each other within a range of the order only: new turns find theirs by their place.
    fresh = spans.select("conv", "window", F.lit(False).alias("repeated"), F.explode(F.sequence("window", F.col("stop") - 1)).alias("ord"))
    fresh = fresh.alias("l").join(places.alias("r"), _same("l", "r", "conv", "ord")).select("l.*", "r.nth")
    heads = spans.where("window > 0").alias("l").join(systems.alias("r"), _same("l", "r", "conv"))
    heads = heads.select("l.conv", "l.window", F.lit(True).alias("repeated"), F.lit(0).cast("long").alias("ord"), "r.nth")
    held = written(fresh.unionByName(past).unionByName(heads), "chat-held")
    held = held.join(turns.select("nth", "role", "text"), "nth")

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    body = escape(F.col("text"))
    piece = F.struct(
        F.col("ord").cast("long").alias("ord"), "repeated", head.alias("head"), body.alias("body"), (~F.col("repeated") & (F.col("role") == TARGET)).alias("target")
    )
    whole = held.groupBy("conv", "window").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans_of = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), none.alias("loss")),
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(
                p["target"],
                F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return whole.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.size(F.filter("pieces", lambda p: p["repeated"])).alias("n_repeated"),
        spans_of.alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with `turns` (role, text), the turns that are new in a window, and `learned`, the text under its loss mask; both unescaped."""
    pieces = F.split("text", CLOSE)
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    open_re, mid_re = r"^\[INST\]", r"\[/INST\]"

    def turn(piece: Column) -> Column:
        parts = F.split(F.regexp_replace(piece, open_re, ""), mid_re)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.withColumn("turns", F.transform(fresh, turn)).withColumn("learned", F.array_join(learned, ""))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_text, learned, formatted_chars), a row for each conversation.

    turns_text is role, newline, text, newline of each turn. This joins all of
    a conversation's text in one string: it is for digests and checks.
    """
    read = read_turns(windows).select(
        "conv_id", "window", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("part"), "learned", F.length("text").alias("chars"),
    )
    all_ = F.array_sort(F.collect_list(F.struct("window", "part", "learned")))
    each = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), all_.alias("w"), F.sum("chars").alias("formatted_chars"))
    return each.select("conv_id", "n_turns", F.array_join("w.part", "").alias("turns_text"), F.array_join("w.learned", "").alias("learned"), "formatted_chars")
