import random
from collections import Counter, defaultdict

import brute
import pytest
from rows import passage
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.llm import chat, mixing, queries, sharding

CONV = "conv_id long, turn long, role string, text string, pieces string, ord string"
OWN = "</s>[INST] ok [/INST]"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], CONV).repartition(3)


def chats():
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", OWN), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "\\ \\[INST] <s> <<SYS>> <</SYS>> \\\\</s>")]
    rows += [(4, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], passage(t, t % 90)) for t in range(300)]
    rows += [(5, 1, "user", "tie b"), (5, 1, "user", "tie a"), (5, 1, "user", "tie a"), (5, None, "assistant", "first"), (6, 0, "system", "alone"), (7, 0, None, "no role"), (None, 0, "assistant", "no id")]
    return [*rows, (8, 0, "system", "s"), (8, 1, "user", passage(8, 9000)), (8, 2, "assistant", "short"), (8, 3, "assistant", "東京 é \n\n x")]


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (120, 40), (1, 0)])
def test_round_trip(spark, budget, history):
    rows = chats()
    windows = chat.format_windows(conversations(spark, rows), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_text, r.learned) for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c] == (len(turns), "".join(f"{r}\n{x}\n" for _, _, r, x in turns), "".join(x for _, _, r, x in turns if r == "assistant"))
    assert set(got) == set(by)


def test_windows(spark):
    rows = chats()
    windows = chat.format_windows(conversations(spark, rows), 400, 100).where("conv_id = 4").orderBy("window").collect()
    assert len(windows) > 5
    tokens = lambda w: sum(-(-len(t) // 4) + 4 for t in (p.split("[/INST]")[1] for p in w.text.split("</s>")[:-1]))
    assert all(tokens(w) <= 400 for w in windows)
    assert all(w.text.startswith("[INST]system[/INST]") for w in windows)
    assert any(w.n_repeated > 1 for w in windows[1:])
    assert windows[0].n_repeated == 0


def test_windows_around_a_long_turn(spark):
    """One turn above or near the budget changes no window but its own."""
    tokens = lambda t: -(-len(t) // 4) + 4
    for long in (9000, 8000, 6000):
        rows = [(1, t, "assistant" if t % 2 else "user", "x" * (long if t == 150 else 100 + t % 7)) for t in range(300)]
        texts = [r[3] for r in rows]
        windows = chat.format_windows(conversations(spark, rows), 2048, 256).orderBy("window").collect()
        held = [[p.split("[/INST]")[1] for p in w.text.split("</s>")[:-1]] for w in windows]
        at = 0
        for w, turns in zip(windows, held, strict=True):
            assert w.window == at
            assert turns == texts[at - w.n_repeated : at + len(turns) - w.n_repeated]
            at += len(turns) - w.n_repeated
            assert len(turns) == 1 or sum(map(tokens, turns)) <= 2048
            # The history before the long turn is left out where the turn needs the room, and behind it where it is in the way.
            assert w.n_repeated >= 7 or w.window == 0 or 150 <= w.window <= 158
        assert at == 300
        assert len(windows) <= 9


def test_stretches_and_history(spark):
    """Long conversations are filled in several stretches; a long question stays with its reply, a long reply with its question."""
    rows = [(1, t, "assistant" if t % 2 else "user", "y" * (t * 37 % 400)) for t in range(4000)]
    rows += [(2, 0, "system", "s" * 40), (2, 1, "user", "a" * 4000), (2, 2, "assistant", "b" * 3000), (2, 3, "user", "c" * 7400), (2, 4, "assistant", "d" * 60), (2, 5, "user", "e" * 100), (2, 6, "assistant", "f" * 7400)]
    windows = chat.format_windows(conversations(spark, rows), 2048, 256).orderBy("conv_id", "window").collect()
    sizes = [sum(-(-len(p.split("[/INST]")[1]) // 4) + 4 for p in w.text.split("</s>")[:-1]) for w in windows]
    assert max(sizes) <= 2048
    many = [n for w, n in zip(windows, sizes, strict=True) if w.conv_id == 1]
    assert len(many) > 110
    # Turns have up to 104 tokens; the last window of each of the two stretches may be short.
    assert sum(n > 2048 - 2 * 104 for n in many) >= len(many) - 3
    assert all(w.n_repeated > 0 for w in windows if w.conv_id == 1 and w.window)
    shape = [(w.window, "".join(p.split("[/INST]")[1][:1] for p in w.text.split("</s>")[:-1])) for w in windows if w.conv_id == 2]
    assert shape == [(0, "sab"), (3, "scde"), (6, "sdef")]


def test_one_hot_conversation(spark):
    """Rows without an id are one conversation, in order of turn, role and text, however their turns repeat."""
    rows = [(None, k % 3 if k % 7 else None, ("user", "assistant")[k % 2], passage(k % 500, 1 + k % 20)) for k in range(6000)]
    (got,) = chat.read_back(chat.format_windows(conversations(spark, rows).repartition(7))).collect()
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert (got.conv_id, got.n_turns) == (None, 6000)
    assert got.turns_text == "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
    assert got.learned == "".join(x for _, _, r, x in rows if r == "assistant")


def test_no_conversations(spark):
    assert chat.format_windows(conversations(spark, [])).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<>/s[]INSTY ", max_size=30), min_size=1, max_size=20))
def test_escape(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("b", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.b for r in rows)
    assert not any(c in r.e for r in rows for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op5_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert rows[-1].n_turns == 2
    assert (rows[-1].loss_chars, rows[-1].loss_sha256) == (len(OWN), brute.sha(OWN))


def mixed_rows(odd_rows):
    return [*odd_rows, *[(5000 + k, passage(k, k % 70), "en", f"s{k % 5}" if k % 3 else "hot") for k in range(900)], *[(7000 + k, passage(k, 3), "en", "tiny") for k in range(5)]]


def test_mix(make, odd_rows):
    rows = mixed_rows(odd_rows)
    size = lambda t: len(brute.TOKEN.findall(t or ""))
    sizes, largest = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    goal = brute.targets(sizes)
    got = mixing.taken_words(make(rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.size) for r in got) == sorted((r[0] is not None, r[0], size(r[1])) for r in rows)
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in got)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    by_size = {(r[0], size(r[1])): r[3] for r in rows}
    taken = Counter()
    for r in got:
        source = by_size[r.doc_id, r.size]
        assert r.target == pytest.approx(goal[source])
        assert r.source_size == sizes[source]
        taken[source] += r.taken
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(largest[s], 1)
        if s in ("hot", "s1", "s2"):
            assert taken[s] == pytest.approx(goal[s], rel=0.02)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(make(rows)).collect()))


@pytest.mark.parametrize("strata", [100_000, 3])
def test_mix_deals_out_disjoint_blocks(make, odd_rows, monkeypatch, strata):
    """A block of a pass goes to one shard, shards get the quotas of the tree, and every copy of a document is in the shard of its block."""
    monkeypatch.setattr(mixing, "MAX_STRATA", strata)
    monkeypatch.setattr(mixing, "SHARED", 2)
    rows = mixed_rows(odd_rows)
    docs = make(rows)
    plan = mixing.plan(docs, 5).where("pass is not null").withColumn("block", F.pmod(F.shiftrightunsigned("k_hash", 20), F.lit(mixing.BLOCKS))).collect()
    shard_of = {}
    for r in plan:
        assert shard_of.setdefault((r.source, r.block, r["pass"]), r.shard) == r.shard
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.TOKEN.findall(r[1] or ""))
    own = sorted(sizes, key=lambda s: (-sizes[s], s is None, s or ""))[:strata]
    by = defaultdict(Counter)
    for (source, _, _), shard in shard_of.items():
        by["source " + source if source in own and source is not None else "null" if source in own else "rest"][shard] += 1
    if strata > len(sizes):
        quotas = {s: c.total() for s, c in by.items()}
        parts = mixing.split_quotas([quotas[s] for s in sorted(quotas)], 5)
        assert [[by[s][k] for s in sorted(quotas)] for k in range(5)] == parts
    else:
        assert by["rest"].total() > 0
        counts = Counter(shard_of.values())
        assert max(counts.values()) - min(counts.values()) <= 5
    out = mixing.mix(docs, 5)
    parts = out.select(F.spark_partition_id().alias("p"), "shard", "place").collect()
    assert all(a.p != b.p or (a.shard, a.place) <= (b.shard, b.place) for a, b in zip(parts, parts[1:]))
    taken = mixing.taken_words(docs).collect()
    assert sum(len(r.shards.split(",")) for r in taken if r.shards) == out.count()


def test_mix_of_a_long_tail(make):
    """Long documents at the crossing keep no source of many documents from its target."""
    rows = [(1000 * s + k, "w " * (4000 if k == 0 else 9) + str(k), "en", f"s{s:02}") for s in range(12) for k in range(401)]
    got = mixing.taken_words(make(rows)).collect()
    taken, goal = Counter(), {}
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        taken[by_id[r.doc_id]] += r.taken
        goal[by_id[r.doc_id]] = r.target
    assert {s: taken[s] for s in goal} == pytest.approx(goal, rel=0.005)


def test_last_pass(spark):
    """What is missing is less than any document left; many short documents besides long ones leave a small miss."""
    rng = random.Random(1)
    rows = [(k, rng.getrandbits(62), s, rng.randrange(8), int(rng.paretovariate(0.6)), rest) for s, rest in (("a", 5000.0), ("b", 77.5), (None, 3.0), ("d", 0.0)) for k in range(300)]
    # Sources that differ in the places of their documents only: without its long document none has 1,500 words.
    rows += [(k, rng.getrandbits(62), f"e{s}", rng.randrange(8), 1000 if k == 0 else 5, 1500.0) for s in range(30) for k in range(201)]
    docs = spark.createDataFrame(rows, "k_id long, k_hash long, source string, block int, weight long, rest double").repartition(3)
    got = mixing._last_pass(docs).collect()
    assert sorted(r.k_hash for r in got) == sorted(r[1] for r in rows)
    for source, rest in {(r[2], r[5]) for r in rows}:
        mine = [r for r in got if r.source == source]
        gap = rest - sum(r.weight for r in mine if r.last)
        assert gap < min((r.weight for r in mine if not r.last), default=1)
        assert abs(gap) <= (0 if source and source[0] == "e" else 1)


def test_mix_rows_agree_with_taken(make, odd_rows):
    rows = mixed_rows(odd_rows)
    docs = make(rows)
    out = mixing.mix(docs)
    assert set(out.schema["row"].dataType.names) == set(docs.columns)
    copies = Counter(r.doc_id for r in out.select("row.doc_id").collect())
    taken = Counter()
    for r in mixing.taken_words(docs).where("size > 0").collect():
        taken[r.doc_id] += r.taken // r.size
    assert all(copies[k] >= n for k, n in taken.items())
    shards = {r.shard: r["count"] for r in out.groupBy("shard").count().collect()}
    assert set(shards) == set(range(16))


def test_no_documents(make):
    assert mixing.taken_words(make([])).count() == 0
    assert mixing.mix(make([])).count() == 0
    assert sharding.interleave(make([])).count() == 0
    assert sharding.shard_rows(make([])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 16))
def test_tree_keeps_quotas(quotas, shards):
    parts = mixing.split_quotas(quotas, shards)
    assert len(parts) == shards
    assert [sum(c) for c in zip(*parts, strict=True)] == quotas
    totals = [sum(p) for p in parts]
    assert max(totals) - min(totals) <= shards


def test_shards(make, odd_rows):
    rows = mixed_rows(odd_rows)
    got = sharding.interleave(make(rows)).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16))
    assert max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    again = sharding.interleave(make(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("bucket_rows", [7, 50_000])
def test_shards_in_plain_order(make, monkeypatch, bucket_rows):
    """Sorted by hash within a source, then by fractional rank over all, whatever the buckets."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    rows = [(k, passage(k, k % 9), "en", f"s{k % 3}" if k % 4 else f"single{k}") for k in range(300)] + [(None, None, None, None), (301, "", "en", None)]
    docs = make(rows)
    h = F.xxhash64(F.lit(sharding.SEED), F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary"))
    plain = docs.select("doc_id", "source", h.alias("h"), F.xxhash64(F.lit(sharding.SEED + 1), "source").alias("o")).collect()
    by = defaultdict(list)
    for r in plain:
        by[r.source].append(((r.h % 2**64), r.doc_id, r.o))
    places = []
    for source, mine in by.items():
        for rank, (_, i, o) in enumerate(sorted(mine, key=lambda m: m[0])):
            places.append((float(((rank + ((o % 2**64) // 2**11 + 0.5) / 2.0**53)) / len(mine)), i))
    order = [i for _, i in sorted(places, key=lambda p: p[0])]
    n = len(order)
    bounds = [-(-s * n // 16) for s in range(17)]
    expected = {order[p]: (s, p - bounds[s]) for s in range(16) for p in range(bounds[s], bounds[s + 1])}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs).collect()} == expected


def test_few_rows_and_columns(make, odd_rows):
    got = sharding.interleave(make(odd_rows[:3])).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 1]
    docs = make(odd_rows)
    out = sharding.shard_rows(docs)
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns}
    assert {"shard", "slot"} < set(out.columns)
    assert out.select("shard", "slot").distinct().count() == len(odd_rows)
