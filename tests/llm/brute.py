"""Plain re-statements of what the operators of this subpackage must return."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = WORD.findall(low(text))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(item_id)
    for doc_id, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    found |= windows[k]
                    hit |= set(range(p, p + n))
        yield doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)


def fingerprint(text):
    w = TOKEN.findall(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """{key: smallest key that links reach} for {key: fingerprint}."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def without_repeats(docs, window=50):
    starts = defaultdict(set)
    words = [(i, TOKEN.findall(t or "")) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - window + 1):
            if i is not None:
                starts[tuple(w[p : p + window])].add(i)
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[p : p + window])]) < i:
                gone |= set(range(p, p + window))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left, share = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share >= 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / share for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    return out


def without_lines(docs, least=10):
    keys = [[low(x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")] for _, t in docs]
    held = {(n if i is None else None, i, k) for n, ((i, _), ks) in enumerate(zip(docs, keys, strict=True)) for k in ks if k}
    count = Counter(k for _, _, k in held)
    for (i, t), ks in zip(docs, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if count[k] < least]
        yield i, len(ks), len(ks) - len(kept), "\n".join(kept)


def phrases(text):
    w = WORD.findall(low(text))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def grams(text):
    """(unigram, bigram, trigram) buckets of each letter."""
    mask = (1 << 32) - 1
    codes = [32] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text or ""] + [32]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b != 32:
            two = b * 0x9E3779B1 + c * 0x85EBCA6B
            mixed = [(b * 0x27D4EB2F + 1) & mask, (two + 2) & mask, (two + a * 0xC2B2AE35 + 3) & mask]
            mixed = [(m ^ m >> 15) * 0x2C1B3C6D & mask for m in mixed]
            yield mixed[0] >> 18, (mixed[1] >> 16) + (1 << 14), (mixed[2] >> 16) + (1 << 14)


def languages(docs, floor=0.01, evidence=4):
    """(language, score) of each (doc_id, text, lang), learned from those that aren't held out."""
    counts, rows = defaultdict(Counter), Counter()
    for i, text, lang in docs:
        if zlib.crc32(str("" if i is None else i).encode()) % 3 != 1 and lang is not None and text is not None:
            rows[lang] += 1
            for three in grams(text):
                counts[lang].update(three)
    names = sorted(k for k in counts if counts[k])
    total = {k: sum(counts[k].values()) for k in names}
    everyone = sum(rows[k] for k in names)
    prior = {k: math.log(rows[k] / everyone) for k in names}
    seen = {b for k in names for b in counts[k]}
    for _, text, _ in docs:
        found = list(grams(text))
        if not found or not names:
            yield "und", 0.0
            continue
        each = Counter(b for three in found for b in three)
        buckets = (1 << 14) + (1 << 16)
        log = {k: sum(n * math.log1p(counts[k][b] / total[k] * (1 - floor) * buckets / floor) for b, n in each.items() if b in counts[k]) for k in names}
        best = max(names, key=lambda k: log[k] + prior[k])
        weight = min(1.0, evidence / len(found))
        tempered = {k: log[k] * weight + prior[k] for k in names}
        yield best, 1 / sum(math.exp(min(tempered[k] - tempered[best], 700.0)) for k in names) * sum(one in seen for one, _, _ in found) / len(found)


def runs(words):
    """(start, length, period) of every run, by start, then period."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        at = 0
        while at < n - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at < n - q and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if length >= max(24, 3 * q) and not any(q % p == 0 and s <= start and s + size >= start + length for s, size, p in found):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)
