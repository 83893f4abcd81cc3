import random

from proofmill.functions import compare as C


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_few_edits_are_found_by_their_number():
    r = random.Random(5)
    for _ in range(500):
        a = "".join(r.choice("abß\U0001f600") for _ in range(r.randint(0, 30)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            b[r.randint(0, len(b)) :][:1] = []
            b.insert(r.randint(0, len(b)), r.choice("abc"))
        b = "".join(b[r.randint(0, 2) :])
        few = C._few_edits(C._codes(a), C._codes(b), 32)
        assert few == brute(a, b)
        assert C.within_distance(a, b, 4) == (few if few <= 4 else None)


def test_a_moved_first_word_costs_no_table_of_distances(monkeypatch):
    text = " ".join(str(n * 7919 % 1000) for n in range(1000))
    monkeypatch.setattr(C.np, "packbits", None)
    assert C.within_distance(text[:2000], text[text.index(" ") + 1 :][:2000], 2000) == 4


def test_compared_gives_what_compare_lines_gives(spark):
    pairs = spark.createDataFrame([(1, "a b\nc", "c\na b"), (2, "a", None), (3, None, None), (4, "same", "Same"), (5, "", "x"), (6, "abc", "abd")], "zone_id long, text string, ref string")
    rows = C.compared(pairs, "c", C.F.col("text"), C.F.col("ref"), asked=C.F.col("zone_id") != 5)
    rows = rows.select("zone_id", "c", C.compare_lines(C.F.col("text"), C.F.col("ref")).alias("d")).collect()
    assert all((r.c is None) if r.zone_id == 5 else (r.c == r.d) for r in rows) and len(rows) == 6


def test_insertions_and_deletions():
    r = random.Random(6)
    for k in range(600):
        a = "".join(r.choice("abcß") for _ in range(r.randint(0, 60)))
        b = "".join(r.choice("abcß") for _ in range(r.randint(0, 60))) if k % 2 else a[r.randint(0, 3) : 50] + "xa"
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        assert C.lcs_length(a, b) == row[-1]
        assert C.insertions_and_deletions(a, b) == len(a) + len(b) - 2 * row[-1]


def test_padded_texts_cost_no_bit_rows(monkeypatch):
    text = "word " * 20_000
    monkeypatch.setattr(C.np, "packbits", None)
    assert C.insertions_and_deletions(text, f" x{text}y") == 3
