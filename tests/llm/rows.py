import random

import pytest

#: Names that the operators use inside; as columns of an input they must change nothing.
CLASHES = ("row", "k_id", "k_text", "words", "hashes", "h", "size", "digit", "group", "fp", "root", "start", "n", "pos", "block", "place", "fraction", "rid", "SLOT", "Shard", "p", "e", "raw", "Pass", "H_BUCKET", "Doc_Rank")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with clashing columns besides."""

    def build(rows, clash=True):
        rows = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        full = [(*r, None if r[1] is None else len(r[1]), *(["x"] * len(CLASHES) if clash else [])) for r in rows]
        schema = SCHEMA + ("".join(f", `{c}` string" for c in CLASHES) if clash else "")
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and blank texts, ties, repeated rows and ids, long texts, other scripts."""
    long = passage(1, 30_000)
    base = passage(2, 120)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "b"), (4, passage(3, 40) + " " + base, "en", "b"), (5, None, "en", "c"), (6, "", "en", None),
        (7, " \n\t ", None, "c"), (8, long, "en", "a"), (9, long + " end", "en", "a"), (10, "ÉCOLE Straße ñandú 東京 العربية", "fr", "d"), (10, "another text with the id of its neighbour", "fr", "d"),
        (11, "same row", "de", "d"), (11, "same row", "de", "d"), (None, base, "de", "a"), (None, None, None, None), (12, "1234 !!! ???", "en", "e"), (13, "one", "de", "e"),
        (14, "a b c d e f g h i j k l", "de", "b"), (-5, base + " " + passage(4, 10), "en", "a"),
    ]
