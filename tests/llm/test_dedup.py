import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from rows import passage

from proofmill.llm import exact_dedup, line_dedup, near_dedup, substring_dedup


def key(row):
    return tuple((v is not None, v) for v in row)


def test_exact(make, odd_rows):
    rows = [*odd_rows, *[(100 + k, "Copy " * 200, "en", "a") for k in range(20)], (200, "COPY " * 200, "en", "a"), (300, "x" * 700 + "1"), (301, "x" * 700 + "2"), (302, "x" * 700 + "1")]
    groups = defaultdict(list)
    for r in rows:
        groups[brute.low(r[1])].append(r[0])
    got = exact_dedup.duplicate_groups(make(rows)).collect()
    best = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    expected = sorted((key((i, best[t], len(ids))) + (brute.sha(t),) for t, ids in groups.items() for i in ids))
    assert sorted(key((r.doc_id, r.keep_id, r.group_size)) + (r.text_sha256,) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_levels_cover_all_bytes():
    for longest in (0, 1, 64, 65, 10**6):
        bounds = exact_dedup.level_bounds(longest)
        assert bounds[0][0] == 0
        assert all(a + w == b for (a, w), (b, _) in zip(bounds, bounds[1:]))
        assert sum(bounds[-1]) >= longest


def test_lines(make, odd_rows):
    common = [(500 + k, f"own {k}\n  Shared LINE \t\n\nshared line\nlast") for k in range(12)]
    few = [(600 + k, "rare\nother") for k in range(9)]
    again = [(620, f"of one id\n{k}") for k in range(12)] + [(None, f"of no id\n{k}") for k in range(10)]
    rows = [*odd_rows, *common, *few, *again]
    got = line_dedup.drop_common_lines(make(rows)).collect()
    expected = brute.without_lines([r[:2] for r in rows])
    assert sorted(key((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in got) == sorted(map(key, expected))


def test_lines_empty_documents(make):
    got = line_dedup.drop_common_lines(make([(k, "gone") for k in range(10)])).collect()
    assert {(r.n_lines, r.n_dropped, r.text) for r in got} == {(1, 1, "")}


@pytest.mark.parametrize("broadcast_bits", [substring_dedup.BROADCAST_BITS, 0])
def test_substrings(make, odd_rows, broadcast_bits):
    shared = passage(7, 90)
    rng = random.Random(5)
    rows = [*odd_rows, *[(700 + k, passage(70 + k, 30) + " " + shared[rng.randint(0, 40) :] + "\n" + passage(170 + k, 30)) for k in range(30)]]
    rows += [(800, "spam " * 6000), (801, "spam " * 3000 + "eggs " + "spam " * 3000), (802, "spam " * 49)]
    got = substring_dedup.remove_repeats(make(rows), broadcast_bits).collect()
    expected = brute.without_repeats([r[:2] for r in rows])
    assert sorted(key((r.doc_id, r.n_words, r.n_removed, r.text)) for r in got) == sorted(map(key, expected))


def test_rolling_hash():
    words = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = substring_dedup.rolling(words, 5, 0xD6E8FEB86659FD93)
    seen = {}
    for k in range(len(words) - 4):
        assert seen.setdefault(tuple(words[k : k + 5]), got[k]) == got[k]
    assert len(set(seen.values())) == len(seen)


def near_rows():
    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = passage(900 + k, 300).split()
        rows.append((1000 + 10 * k, " ".join(words)))
        for c in range(3):
            changed = list(words)
            changed[rng.randrange(300)] = f"new{c}"
            rows.append((1000 + 10 * k + c + 1, " ".join(changed)))
    return rows


def plain_near(rows):
    """(id, text, fingerprint, smallest id of the class) of each row, null and repeated ids too."""
    prints = [brute.fingerprint(r[1]) for r in rows]
    roots = brute.components(dict(enumerate(prints)))
    least = {}
    for k, r in enumerate(rows):
        known = [x for x in (least.get(roots[k]), r[0]) if x is not None]
        least[roots[k]] = min(known, default=None)
    return sorted(key((r[0], f"{prints[k]:016x}", least[roots[k]])) for k, r in enumerate(rows))


def test_near(make, odd_rows):
    rows = [*odd_rows, *near_rows()]
    got = near_dedup.near_duplicates(make(rows)).collect()
    assert sorted(key((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id)) for r in got) == plain_near(rows)


def test_near_splits_large_leaves(make, odd_rows, monkeypatch):
    """Leaves beyond what the first sample can split are split again on their own, and lose no pair."""
    for name, value in (("SAMPLE", 40), ("LEAF_HOMES", 4), ("LARGE_HOMES", 8), ("LEAF_SAMPLE", 30), ("LEAF_ROWS", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = [*odd_rows, *near_rows()]
    got = near_dedup.near_duplicates(make(rows)).collect()
    assert sorted(key((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id)) for r in got) == plain_near(rows)


def test_near_keeps_one(make, odd_rows):
    rows = [*odd_rows, *near_rows()]
    docs = make(rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r.root for r in near_dedup.near_duplicates(docs).collect()}
    assert kept.count() == len(classes)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 3000).astype(np.int64)
    points = np.concatenate([points, points[:500] ^ np.int64(0b1011), points[:500] ^ np.int64(1 << 40)])
    trees = [near_dedup.grow(near_dedup.projection(points, k), 40, 1, k) for k in range(3)]
    assert all(len(t) > 20 for t in trees)
    found = set()
    for k, tree in enumerate(trees):
        homes = 0
        for _, rows, home in near_dedup.route(tree, near_dedup.projection(points, k), 1):
            homes += home.sum()
            a, b = points[rows[home]], points[rows]
            q, h = np.nonzero(np.bitwise_count((b[:, None] ^ a[None, :]).view(np.uint64)) <= 4)
            found |= {(min(x, y), max(x, y)) for x, y in zip(b[q].tolist(), a[h].tolist(), strict=True) if x != y}
        assert homes == len(points)
    expected = set()
    for k in range(len(points)):
        near = points[np.bitwise_count((points ^ points[k]).view(np.uint64)) <= 4]
        expected |= {(min(x, int(points[k])), max(x, int(points[k]))) for x in near.tolist() if x != points[k]}
    assert found == expected


def test_large_leaf_is_a_grid(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF_ROWS", 8)
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == brute.components({r[0]: brute.fingerprint(r[1]) for r in rows})


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a long, b long")
    assert {r.node: r.root for r in near_dedup.components(edges).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100}


@pytest.mark.parametrize("operator", [exact_dedup.duplicate_groups, line_dedup.drop_common_lines, substring_dedup.remove_repeats, near_dedup.near_duplicates, near_dedup.keep_one])
def test_empty_table(make, operator):
    assert operator(make([])).count() == 0
