import hashlib
import random
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, duck_rows, spark_rows
from rows import passage

from pyspark.sql import functions as F

from proofmill.llm import infill, multiset_hash, periodic, queries

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_fill_in_middle", "op13_fingerprints"])
def test_query_against_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(connect(SF), queries.oracle_sql()[name])


# --- runs -----------------------------------------------------------------


def numbered(text):
    known = {}
    return np.array([*(known.setdefault(w, len(known)) for w in text), -1])


@st.composite
def repetitive(draw):
    """Texts with periods, periods within periods, and changes in them."""
    text = []
    for _ in range(draw(st.integers(1, 4))):
        root = draw(st.lists(st.sampled_from("aab"), min_size=1, max_size=draw(st.sampled_from([2, 6, 40]))))
        if draw(st.booleans()):
            root = root * draw(st.integers(2, 5)) + draw(st.lists(st.sampled_from("abc"), max_size=9))
        part = root * draw(st.integers(1, 7))
        for _ in range(draw(st.integers(0, 2))):
            part[draw(st.integers(0, len(part) - 1))] = draw(st.sampled_from("abcd"))
        text += part[draw(st.integers(0, 5)) :] + draw(st.lists(st.sampled_from("abcde"), max_size=12))
    return text[:1500]


@settings(max_examples=400, deadline=None)
@given(repetitive())
def test_runs_are_all_found(text):
    assert periodic.find_runs(numbered(text), len(text)) == brute.runs(text)


def words_of(kind, n):
    if kind == "fibonacci":
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == "thue-morse":
        return [str(k.bit_count() % 2) for k in range(n)]
    if kind == "one":
        return ["a"] * n
    if kind == "nested":  # a period that is itself mostly of small periods
        return (["a"] * 90 + ["b"] * 70 + ["a", "b"] * 60) * (n // 280)
    rng = random.Random(3)
    return [rng.choice("ab") for _ in range(n)]


@pytest.mark.parametrize("kind", ["fibonacci", "thue-morse", "one", "nested", "random"])
def test_runs_of_special_words(kind):
    text = words_of(kind, 3000)
    assert periodic.find_runs(numbered(text), len(text)) == brute.runs(text)


def test_runs_do_not_cross_texts():
    texts = [[b"a", b"b"] * 9, [b"a", b"b"] * 9, [b"a", b"b"] * 13, [], [b"c"] * 30]
    assert periodic._runs_of(texts) == [[], [], [(0, 26, 2)], [], [(0, 30, 1)]]


def test_selected_places_are_consistent():
    """Equal contexts are selected alike, and gaps are short outside periodic regions."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2, 4000)
    words[2000:2600] = words[300:900]
    hashes = periodic._mix(words.astype(np.uint64) + np.uint64(1))
    t = 1
    while t < 64:
        hashes = periodic._pair(hashes[:-t], hashes[t:])
        t *= 2
    at = periodic._selected(hashes, t, [])
    chosen = set(at.tolist())
    assert {k for k in range(300, 900 - 2 * t) if k in chosen} == {k - 1700 for k in range(2000, 2600 - 2 * t) if k in chosen}
    assert np.diff(at).max() <= t
    assert len(at) < 4 * len(words) / t


def test_periodic_rows(make, odd_rows):
    loop = passage(40, 9)
    rows = [*odd_rows, (20, " ".join([passage(41, 12), *[loop] * 5, passage(42, 3)]), "en", "a"), (21, "x " * 40), (22, "y\tz\n" * 11), (23, ("a " * 30 + "b ") * 6)]
    got = periodic.periodic_runs(make(rows)).collect()
    expected = []
    for r in rows:
        words = brute.TOKEN.findall(r[1] or "")
        found = brute.runs(words)
        expected.append((r[0], len(words), found, brute.collapsed(words, found)))
    assert sorted(key((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text)) for r in got) == sorted(map(key, expected))
    assert periodic.periodic_runs(make([])).count() == 0


def test_strongest_run_is_exact(spark):
    runs = [[(0, 50, 10), (3, 25, 5), (9, 24, 6)], [], [(5, 10**6 + 1, 10**6), (6, 10**6 + 2, 10**6 + 1)], [(4, 30, 10), (4, 60, 20)]]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], f"k int, runs array<{periodic.RUN}>")
    got = {r.k: tuple(r.b) if r.b else None for r in rows.select("k", periodic.strongest(F.col("runs")).alias("b")).collect()}
    assert got == {0: (0, 50, 10), 1: None, 2: (5, 10**6 + 1, 10**6), 3: (4, 30, 10)}


def test_runs_of_a_very_long_text(make):
    start = time.monotonic()
    (got,) = periodic.periodic_runs(make([(1, passage(43, 150_000) + " " + (passage(44, 20_000) + " ") * 4 + passage(45, 100_000))])).collect()
    assert [(r.length, r.period) for r in got.runs if r.period > 100] == [(80_000, 20_000)]
    assert time.monotonic() - start < 60


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(concat(unhex('ff'), cast(' a' as binary)) as string) as text")
    (got,) = periodic.periodic_runs(docs).collect()
    assert got.n_words == 2
    (got,) = infill.fill_in_middle(docs).select(F.expr("hex(cast(output as binary))").alias("x")).collect()
    assert "FF" in got.x


# --- fill in the middle ---------------------------------------------------


def plain_infill(doc_id, text, seed=1, unit="char"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if unit == "char":
        units = list(text)
    else:
        units = brute.re.findall(r"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D]|\Z)|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def infill_rows(odd_rows):
    marked = [(5000 + k, f"text {k} with a mark {m} inside") for k in range(20) for m in infill.MARKS]
    almost = [(6000 + k, "<P" * (k % 3) + ">é<S" + "𝄞<" * k) for k in range(60)]
    return [*odd_rows, *marked, *almost, *[(7000 + k, passage(500 + k, k)) for k in range(40)]]


@pytest.mark.parametrize("unit", ["char", "word"])
def test_infill(make, odd_rows, unit):
    rows = infill_rows(odd_rows)
    out = infill.fill_in_middle(make(rows), unit=unit)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = [(r[0], *plain_infill(r[0], r[1], unit=unit), r[1] or "") for r in rows]
    assert sorted(key((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.back)) for r in got) == sorted(map(key, expected))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(make([])).count() == 0


def test_infill_other_settings(make):
    rows = [(k, "some <P> text") for k in range(50)]
    assert {r.form for r in infill.fill_in_middle(make(rows), rate=0, marks=("[a]", "[b]", "[c]")).collect()} == {"plain"}
    out = infill.fill_in_middle(make(rows), seed=7, rate=100, suffix_first=100, marks=("[a].", "[b].", "[c]."))
    got = out.select("form", "output", infill.restored(F.col("output"), F.col("form"), ("[a].", "[b].", "[c].")).alias("t")).collect()
    assert {(r.form, r.t) for r in got} == {("spm", "some <P> text")}
    assert len({r.output for r in got}) > 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aé東𝄞 \n", max_size=30), min_size=1, max_size=6), st.integers(0, 2**32), st.sampled_from([1, 2, 5, 17, 1000]), st.sampled_from(["char", "word"]))
def test_windows_of_bytes_change_nothing(texts, seed, window, unit):
    """Pieces from windows of any size are those of whole texts, also of sliced arrays."""
    rng = np.random.default_rng(seed)
    raw = pa.array([b"before", *(t.encode() for t in texts), b"behind"])[1:-1]
    n = infill.unit_counts(raw, unit)
    cuts = np.sort(rng.integers(0, n + 1, (2, len(texts))), axis=0)
    parts = infill.split_roles(raw, cuts, unit, window)
    assert ["".join(x.as_py().decode() for x in three) for three in zip(*parts)] == texts
    if unit == "char":
        assert [len(x.as_py().decode()) for x in parts[0]] == cuts[0].tolist()
        assert [len(x.as_py().decode()) for x in parts[1]] == (cuts[1] - cuts[0]).tolist()
    else:
        assert infill.unit_counts(parts[0], unit).tolist() == cuts[0].tolist()
    whole = infill.split_roles(raw, cuts, unit)
    assert [p.to_pylist() for p in parts] == [p.to_pylist() for p in whole]


# --- fingerprints ---------------------------------------------------------


def plain_vector(text):
    """Packed sums of digits five apart, in the parts of two digests."""
    sums = [0] * (multiset_hash.LANES // 3)
    for p in (text or "").split("\n"):
        for half in range(2):
            digest = hashlib.sha256(f"{half}:{p}".encode()).hexdigest()
            for part in range(4):
                for k in range(5):
                    three = [2 * int(digest[15 * part + 5 * z + 4 - k], 16) - 15 for z in range(3)]
                    sums[20 * half + 5 * part + k] += (three[0] << 40) + (three[1] << 20) + three[2]
    return [v % (1 << 60) for v in sums]


def test_fingerprints_are_of_multisets(spark, make):
    lines = [passage(600 + k, 8) for k in range(30)]
    mixed = random.Random(1).sample(lines, 30)
    docs = make([(1, "\n".join(lines)), (2, "\n".join(mixed)), (3, "\n".join(lines[:15])), (4, "\n".join(lines[15:])), (5, None), (6, ""), (7, "\n".join([*lines, lines[0]])), (8, "\n".join(passage(900 + k, 8) for k in range(30)))])
    got = {r.doc_id: r for r in multiset_hash.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint == "".join(f"{v:015x}" for v in plain_vector("\n".join(lines)))
    assert got[5].fingerprint == got[6].fingerprint != got[1].fingerprint
    assert got[7].fingerprint != got[1].fingerprint
    v = multiset_hash.fingerprints(docs).select("doc_id", "vector")
    row = v.groupBy().pivot("doc_id", list(range(1, 9))).agg(F.first("vector")).select(
        (multiset_hash.added(F.col("3"), F.col("4")) == F.col("1")).alias("sum"), (multiset_hash.removed(F.col("1"), F.col("4")) == F.col("3")).alias("difference"),
        multiset_hash.likeness(F.col("1"), F.col("3")).alias("half"), multiset_hash.likeness(F.col("1"), F.col("8")).alias("none"), multiset_hash.likeness(F.col("1"), F.col("2")).alias("all"),
    ).first()
    assert row["sum"] and row["difference"]
    assert row["all"] == 1.0
    assert abs(row["half"] - 2 / 3) < 0.2
    assert row["none"] < 0.3


def test_edited_by_next(make, odd_rows):
    many = [(4000 + k, "\n".join(passage(700 + 5 * k + i, 6) for i in range(k % 7))) for k in range(30)]
    rows = [*odd_rows, *many, *[(9000, "again\nand again")] * 5, (None, base := "x\ny"), (None, base)]
    got = multiset_hash.edited_by_next(make(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    ids = sorted(texts, key=lambda i: (i is not None, i))
    for r in got:
        # The next is a row of the same id or the first of the next id.
        nexts = [*texts[r.doc_id], *texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]]
        half = r.n_chars // 2
        edits = {t[: len(t) - half] + x[:half]: x for t in texts[r.doc_id] if len(t) == r.n_chars for x in nexts}
        assert r.edited in edits
        assert r.edited_vector == plain_vector(r.edited)
        assert r.vector in [plain_vector(t) for t in texts[r.doc_id]]
        assert r.next_vector in [plain_vector(x) for x in nexts]
    twice = [r for r in got if r.doc_id == 9000]
    assert sum(r.next_vector == r.vector for r in twice) == 4
    last = max(i for i in texts if i is not None)
    assert any(r.next_vector in [plain_vector(t) for t in texts[None]] for r in got if r.doc_id == last)


def test_next_goes_over_blocks(make, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(multiset_hash, "COPIES", 2)
    rows = [(k, f"{k:03}" * 2) for k in range(40)] + [(7, "007007")] * 6
    got = sorted((r.doc_id, r.edited) for r in multiset_hash.edited_by_next(make(rows)).collect())
    assert got == sorted([(k, f"{k:03}{(k + 1) % 40:03}") for k in range(40)] + [(7, "007007")] * 6)


def test_edits_of_few_rows(make):
    assert multiset_hash.edited_by_next(make([])).count() == 0
    assert [(r.n_chars, r.edited) for r in multiset_hash.edited_by_next(make([(1, "abcd")])).collect()] == [(4, "abab")]
    assert [(r.n_chars, r.edited) for r in multiset_hash.edited_by_next(make([(1, None)])).collect()] == [(0, "")]


def test_a_sum_may_pass_the_modulus(make):
    """Lanes are those of the plain sums, whatever the number of repetitions."""
    text = "line\n" * 300_000
    (got,) = multiset_hash.fingerprints(make([(1, text)])).select("vector").collect()
    one, rest = plain_vector("line"), plain_vector("")
    assert got.vector == [(300_000 * a + b) % (1 << 60) for a, b in zip(one, rest, strict=True)]


def test_likeness_follows_what_is_shared(make):
    for share in (0.2, 0.5, 0.8):
        rows, shared = [], round(100 * share)
        for k in range(12):
            lines = [passage(10_000 + 300 * k + i, 5) for i in range(200 - shared)]
            rows += [(2 * k, "\n".join(lines[:100])), (2 * k + 1, "\n".join([*lines[:shared], *lines[100:]]))]
        found = multiset_hash.fingerprints(make(rows))
        a, b = found.where("doc_id % 2 = 0").select("doc_id", F.col("vector").alias("a")), found.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("b"))
        got = [r.s for r in a.join(b, "doc_id").select(multiset_hash.likeness(F.col("a"), F.col("b")).alias("s")).collect()]
        assert abs(sum(got) / len(got) - share) < 0.1


def test_periods_put_in(make, odd_rows):
    rows = [(k, passage(800 + k, 60)) for k in range(200)] + list(odd_rows)
    for r in queries.with_periods(make(rows)).collect():
        h = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode())
        texts = [x[1] for x in rows if x[0] == r.doc_id]
        if h % 10:
            assert r.text in texts
            continue
        found = []
        for t in texts:
            w = brute.TOKEN.findall(t or "")
            n, g = len(w), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            found.append(" ".join(w) if n else t)
        assert r.text in found
