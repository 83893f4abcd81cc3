"""The index of sections gives the rows that scoring all pairs gives, from few of the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators import section_index as index
from proofmill.operators import sections as S

READINGS = "zone_id long, pack_id long, lang string, reading string, hint_number int, hint_name string"
SECTIONS = "pack_id long, ord long, section_no int, name string, content string"
NAMES = ["NEWS", "PIC", "OTHER", "UNKNOWN", None, "LINKEDIN", "POST"]


def text(rng, words):
    # Frequent words are much more frequent, as in any language.
    return " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(0, 12)))


def cases(seed, packs, sections, readings, words):
    rng = random.Random(seed)
    content = [text(rng, words) for _ in range(sections)]
    content += [rng.choice(content) for _ in range(sections // 3)] + ["", None, "x %skin%", "w1 " * 70, "w1 w2\nw3 w4", "w3 w4\nw1 w2"]
    s = [(k % packs, k, rng.choice([None, 1, 2, 3, k]), rng.choice(NAMES), c) for k, c in enumerate(content)]
    r = []
    for z in range(readings):
        found = rng.choice(content) or "abc"
        reading = rng.choice([found, found.upper(), found + " w0", " ".join(reversed(found.split())), text(rng, words), "w3 w4\nw1 w2", "zzz yyy", "ab", None, "..."])
        hints = rng.choice([(None, None)] * 4 + [(2, None), (999999, "pic"), (None, "new"), (1, "o"), (None, ""), (2, "nothing")])
        r.append((z, rng.choice([*range(packs), packs + 7, None]), rng.choice(["en", "de", "ja", None]), reading, *hints))
    return r, s


@pytest.mark.parametrize(("seed", "packs", "words"), [(1, 2, 40), (3, 5, 8)])
def test_same_rows(spark, seed, packs, words):
    r, s = cases(seed, packs, 240, 300, words)
    readings, sections = spark.createDataFrame(r, READINGS), spark.createDataFrame(s, SECTIONS)
    by_index, by_pairs = (sorted(map(tuple, S.select_sections(readings, sections, indexed=i).collect()), key=str) for i in (True, False))
    assert by_index == by_pairs
    assert len(by_index) == len(r)


def test_empty_tables(spark):
    none, packs = spark.createDataFrame([], READINGS), spark.createDataFrame([], SECTIONS)
    assert S.select_sections(none, packs, indexed=True).count() == 0
    one = spark.createDataFrame([(1, 1, "en", "some text", 3, "pic")], READINGS)
    assert [r.reason for r in S.select_sections(one, packs, indexed=True).collect()] == ["no_sections"]


def test_few_pairs_of_a_large_pack(spark):
    rng = random.Random(5)
    content = [" ".join(f"w{int(3000 * rng.random() ** 3)}" for _ in range(20)) for _ in range(10_000)]
    sections = spark.createDataFrame([(1, k, k, "OTHER", c) for k, c in enumerate(content)], SECTIONS)
    readings = spark.createDataFrame([(z, 1, "en", content[z * 37] + (" w1" if z % 2 else " new"), None, None) for z in range(100)], READINGS)
    facts = S.with_section_facts(sections).drop("content")
    scoped, scopes = index.with_scopes(S.with_forms(readings, "reading", "r"), facts, S.hint_flags)
    found = index.candidates(scoped.withColumn("spaced", F.lit(True)), index.members(scopes, facts, S.picked(), S.section_bases()))
    assert found.count() < 100 * 10_000 / 20
    right = found.where(F.col("ord") == F.col("zone_id") * 37).count()
    assert right == 100
