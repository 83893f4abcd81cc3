import random
import time

import brute
import numpy as np
import pytest
from rows import passage
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from proofmill.llm import decontaminate, language, licenses, queries

SF = "/root/testdata/sf0.01"
ITEMS = [(1, passage(50, 30)), (2, passage(51, 10)), (3, "four short words only"), (4, "!!!"), (5, None), (None, passage(52, 14)), (6, passage(50, 30)), (7, "lone")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "x", "x") for i in ITEMS], "item_id long, text string, words string, hash string")


def dirty_rows():
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = passage(50 + k % 3, 30).split()
        a = rng.randint(0, 20)
        rows.append((2000 + k, passage(300 + k, 25) + " " + " ".join(words[a : a + rng.randint(5, 15)]).title() + ". " + passage(400 + k, 5)))
    return [*rows, (3000, "It has FOUR short, words: only!"), (3001, "lone"), (3002, "alone lones"), (3003, (passage(50, 30) + " ") * 40)]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_contamination(make, items, odd_rows, broadcast_rows):
    rows = [*odd_rows, *dirty_rows()]
    got = decontaminate.contamination(make(rows), items, broadcast_rows).collect()
    expected = brute.contamination([r[:2] for r in rows], ITEMS)
    order = lambda r: ((r[0] is not None, r[0]), *r[1:])
    assert sorted(order((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got) == sorted(map(order, expected))


def test_a_very_long_document(make, items):
    """Time grows with the length of a text, not with its square."""
    words = passage(60, 300_000).split()
    at = [1000, 150_000, 299_000]
    for a in at:
        words[a : a + 12] = passage(50, 30).split()[5:17]
    words[200_000:200_003] = "four", "short", "words"
    start = time.monotonic()
    (got,) = decontaminate.contamination(make([(1, " ".join(words))]), items).collect()
    assert (got.n_words, got.item_ids) == (300_000, ["1", "6"])
    assert got.n_hit == 36 + words.count("lone")
    assert time.monotonic() - start < 30


def test_keep_clean(make, items, odd_rows):
    rows = [*odd_rows, *dirty_rows()]
    docs = make(rows)
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n_hit == 0 for _, _, n_hit, _ in brute.contamination([r[:2] for r in rows], ITEMS))


def test_no_items_or_documents(make, items):
    assert decontaminate.contamination(make([]), items).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(make([(1, "a b c")]), items.limit(0)).collect()] == [0]


def test_language_accuracy(spark):
    """Held-out documents, which the model has not seen."""
    found = queries.op1_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(make, odd_rows):
    docs = make(odd_rows)
    got = language.identify(docs).collect()
    assert len(got) == len(odd_rows)
    unknown = sum(not any(ch.isalpha() for ch in r[1] or "") for r in odd_rows)
    assert sum(r.lang_pred == "und" for r in got) == unknown
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() <= len(odd_rows) - unknown


def test_language_against_plain_counts(make, odd_rows):
    """Predictions and scores are those of a plain naive Bayes; unseen letters have a low score, and a language without text isn't learned."""
    rng = random.Random(6)
    words = {"en": "the house of people is here and there with that".split(), "fr": "la maison des gens est ici avec les autres où".split(), "de": "das haus der leute ist hier und dort über".split()}
    rows = [(100 + k, " ".join(rng.choices(words[lang], k=rng.randint(1, 30))), lang) for k in range(120) for lang in [rng.choice("en en en fr de".split())]]
    rows += [(900 + k, None, "xx") for k in range(12)] + [(950 + k, "123 !", "yy") for k in range(12)]
    rows += [(1000, "中文文本 測試", None), (1001, "Ελληνικά κείμενα", None), (1002, "the house des gens", None), (1003, "ΘΘ the", None)]
    rows += [r[:3] for r in odd_rows]
    docs = make(rows)
    found = docs.select("doc_id", "text", language.predict(docs.sparkSession, language.trained(docs), F.col("text")).alias("p")).collect()
    expected = dict(zip([r[:2] for r in rows], brute.languages(rows), strict=True))
    assert len(found) == len(rows)
    for i, text, (lang, score) in found:
        own, plain = expected[i, text]
        assert lang == own, text
        assert score == pytest.approx(plain, abs=1e-5), text
        assert lang not in ("xx", "yy")
        assert score < 0.1 or i not in (1000, 1001)
    kept = {r.doc_id for r in language.keep_known(make(rows)).collect()}
    assert not kept & {1000, 1001, 900, 950}
    assert 102 in kept


def test_rare_languages_are_learned(make):
    rows = [(k, "some text", "en" if k % 2 else f"l{k}") for k in range(60)]
    docs = make(rows).select("lang", F.col("doc_id").alias("key"), "text")
    assert language.train(docs).languages == ("en", *sorted(f"l{k}" for k in range(0, 60, 2)))


@pytest.mark.parametrize("block", [128, 3])
def test_blocks_of_languages_change_nothing(make, odd_rows, monkeypatch, block):
    rows = [(100 + k, passage(k % 9, 4), f"x{k % 9}", "a") for k in range(90)] + list(odd_rows)
    docs = make(rows)
    monkeypatch.setattr(language, "_CELLS", 900)
    model = language.train(docs.select("lang", F.col("doc_id").alias("key"), "text"), block=block)
    assert len(model.blocks) == -(-len(model.languages) // block)
    texts = [r[1] for r in rows]
    whole = language.train(docs.select("lang", F.col("doc_id").alias("key"), "text"), block=1000)
    (a, x), (b, y) = model.score(texts), whole.score(texts)
    assert a.tolist() == b.tolist()
    assert x == pytest.approx(y, abs=1e-9)
    found = docs.select("text", language.predict(docs.sparkSession, model, F.col("text")).alias("p")).collect()
    names = (*whole.languages, "und")
    assert sorted(str((r.text, r.p.lang_pred)) for r in found) == sorted(str((t, names[k])) for t, k in zip(texts, b, strict=True))


def test_two_thousand_languages(make):
    """Each is learned and predicted; a language has letters of its own."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 12_000)]
    rows = [(2000 * c + k, "".join(letters[6 * k : 6 * k + 6]) * 2, f"l{k:04}") for k in range(2000) for c in range(2)]
    docs = make(rows, clash=False)
    model = language.train(docs.select("lang", F.col("doc_id").alias("key"), "text"))
    assert len(model.languages) == 2000
    assert all("_value" not in vars(b) for b in model.blocks)
    got = docs.select("lang", language.predict(docs.sparkSession, model, F.col("text")).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in got) > 0.99 * len(got)


def test_language_without_labels(make):
    assert [r.lang_pred for r in language.identify(make([(1, "text"), (2, "more")])).collect()] == ["und", "und"]
    assert language.identify(make([])).count() == 0


def test_grams_of_long_texts(monkeypatch):
    """Slices of a text give the n-grams of the whole."""
    texts = ["Ab " * 500, None, "x", "", "éÉ" * 700]
    whole = [(b, o) for b, o in language.grams(texts)]
    monkeypatch.setattr(language, "_SLICE", 64)
    cut = [(b, o) for b, o in language.grams(texts)]
    assert len(cut) > len(whole)
    join = lambda parts: (np.concatenate([b for b, _ in parts], axis=1), np.concatenate([o for _, o in parts]))
    for a, b in zip(join(whole), join(cut), strict=True):
        assert (a == b).all()


def test_licenses(make, odd_rows):
    rows = [*odd_rows, (1, "All Rights Reserved. cc-by CC BY-NC 4.0"), (2, "GNU General Public License; general, public LICENSE!"), (3, "cc by" * 3), (4, "Licensed under the Apache License, Version 2.0.")]
    got = licenses.scan_licenses(make(rows)).collect()
    order = lambda r: tuple((v is not None, v) for v in r)
    expected = [(r[0], *brute.phrases(r[1])) for r in rows]
    assert sorted(order((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(map(order, expected))
    assert "apache-2.0" in {r.labels for r in got}
    assert licenses.scan_licenses(make([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=2, max_size=4), min_size=1, max_size=3), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), max_size=3), st.lists(st.sampled_from("abcd"), max_size=60))
def test_automaton_finds_every_phrase(phrases, templates, text):
    machine = licenses.Automaton(tuple((" ".join(p), "x") for p in phrases), tuple(("y", " ".join(t)) for t in templates))
    _, found, _ = machine.scan(" ".join(text).encode())
    for k, p in enumerate(phrases):
        assert sorted(found.get(k, [])) == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


def plain_cover(text, template):
    """The share of a template that the best chain covers, from all runs that can't grow to the right, each of them the longest that ends there."""
    runs = []
    for end in range(1, len(text) + 1):
        at = {}
        for place in range(1, len(template) + 1):
            n = 0
            while n < min(end, place) and text[end - 1 - n] == template[place - 1 - n]:
                n += 1
            at[place] = n
        n = max(at.values(), default=0)
        grown = end < len(text) and any(at[p] == n and p < len(template) and template[p] == text[end] for p in at)
        if n >= licenses.MIN_MATCH and not grown:
            runs += [(end, place, n) for place in at if at[place] == n]
    best = {}
    for end, place, n in runs:
        best[end, place] = n
        for other_end, other_place, _ in runs:
            over = max(0, other_end - (end - n), other_place - (place - n))
            if other_end < end and over < n and end - n + over - other_end <= licenses.MAX_GAP:
                best[end, place] = max(best[end, place], best[other_end, other_place] + n - over)
    return max(best.values(), default=0) / max(len(template), 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=12), min_size=1, max_size=3), st.lists(st.sampled_from("abcx"), max_size=40))
def test_best_chains(templates, text):
    machine = licenses.Automaton((), tuple(("y", " ".join(t)) for t in templates))
    _, _, covers = machine.scan(" ".join(text).encode())
    expected = {k: plain_cover(text, t) for k, t in enumerate(templates)}
    assert covers == pytest.approx({k: c for k, c in expected.items() if c >= licenses.MIN_COVER})


def test_edited_notices_are_found():
    """A repeated word, or one put in, doesn't break a chain."""
    machine = licenses.automaton()
    scan = lambda t: {machine.templates[k - len(machine.phrases)][0] for k in machine.scan(t.encode())[2]}
    mit = "Permission is hereby granted, free of charge, {} any person obtaining a copy of this software and associated documentation files"
    assert scan(mit.format("to any")) == {"mit"}
    assert scan(mit.format("to the user of this software to")) == {"mit"}


def test_a_table_of_templates(spark, make):
    text = passage(80, 400)
    templates = spark.createDataFrame([("own-1.0", text, "x"), ("own-2.0", passage(81, 50), "x"), (None, "a b c", "x"), ("none", None, "x")], "label string, text string, s string")
    words = text.split()
    docs = make([(1, "Preamble. " + " ".join(words[:200]) + " inserted words " + " ".join(words[200:]).upper()), (2, " ".join(words[:300])), (3, None), (4, passage(82, 9) + " " + passage(81, 50))])
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in licenses.scan_licenses(docs, templates).collect()}
    assert got == {1: ("own-1.0", 1.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("own-2.0", 1.0)}
    assert {r.labels for r in licenses.scan_licenses(docs, templates.limit(0)).collect()} == {""}


def test_templates_of_one_or_two_words(spark, make):
    templates = spark.createDataFrame([("own", "Proprietary"), ("two", "public domain"), ("none", "!")], "label string, text string")
    docs = make([(1, "this is proprietary code"), (2, "PROPRIETARY"), (3, "in the public, domain"), (4, "public the domain"), (5, "proprietary public domain"), (6, None), (7, "public")])
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, templates).collect()}
    assert got == {1: "own", 2: "own", 3: "two", 4: "", 5: "own,two", 6: "", 7: ""}


def test_a_very_long_text_is_scanned(make):
    text = passage(83, 300_000) + " " + licenses.TEMPLATES[2][1]
    start = time.monotonic()
    (got,) = licenses.scan_licenses(make([(1, text)])).collect()
    assert got.labels == "mit"
    assert time.monotonic() - start < 30


def test_spans_need_cover():
    machine = licenses.automaton()
    scan = lambda t: {machine.templates[k - len(machine.phrases)][0] for k in machine.scan(t.encode())[2]}
    template = dict(licenses.TEMPLATES)["isc"]
    words = template.split()
    assert scan(template.upper()) == {"isc"}
    assert scan(" ".join([*words[:9], "oops", *words[10:]])) == {"isc"}
    assert scan(" ".join(words[:6])) == set()
