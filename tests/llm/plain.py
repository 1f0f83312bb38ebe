"""The operators of the pipeline in plain Python, written from their definitions."""

import hashlib
import math
import re
import unicodedata
import zlib

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ORDERS, DIM = (2, 3, 4), 1 << 14


def grams(text):
    low = [x if 97 <= x <= 122 or x >= 128 else 32 for x in b" " + text.lower().encode() + b" "]
    for n in ORDERS:
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if not any(a == b == 32 for a, b in zip(g, g[1:])):
                yield (sum(x << 8 * k for k, x in enumerate(g)) + n * 0x01000193) * 2654435761 % 2**32 >> 18


def languages(rows):
    """doc_id -> language, score, ambiguous for rows (doc_id, text, lang), learned from those that are not held out."""
    of = {d: list(grams(t or "")) for d, t, _ in rows}
    learn = [(d, x) for d, _, x in rows if x is not None and zlib.crc32(str("" if d is None else d).encode()) % 4 != 2]
    langs = sorted({x for d, x in learn if of[d]})
    seen = {x: {} for x in langs}
    for d, x in learn:
        for g in of[d]:
            seen[x][g] = seen[x].get(g, 0) + 1
    share = {}
    for x in langs:
        mass = sum(seen[x].values()) + 0.1 * DIM
        share[x] = [0.1 / mass] * DIM
        for g, n in seen[x].items():
            share[x][g] = (n + 0.1) / mass
    bits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(len(langs))] for b in range(2 ** (len(langs) - 1) - 1)]
    tables, weights = [], []
    for bit in bits:
        pos, neg = ([sum(c) / len(c) for c in zip(*(share[x] for x, b in zip(langs, bit) if b == s))] for s in (1, -1))
        tables.append([math.log(a / b) for a, b in zip(pos, neg)])
        weights.append(sum((a - b) * t for a, b, t in zip(pos, neg, tables[-1])))
    out = {}
    for d, t, _ in rows:
        if not any(unicodedata.category(x)[0] == "L" for x in t or ""):
            out[d] = ("und", 0.0, False)
            continue
        margin = [sum(x[g] for g in of[d]) / len(of[d]) for x in tables]
        cost = [sum(w / sum(weights) * math.log1p(math.exp(-6 * m * bit[k])) for m, w, bit in zip(margin, weights, bits)) for k in range(len(langs))]
        p = [math.exp(-6 * (c - min(cost))) for c in cost]
        out[d] = (langs[p.index(max(p))], max(p) / sum(p), len(p) > 1 and sorted(p)[-2] > 0.5 * max(p))
    return out


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(rows):
    """doc_id -> the least doc_id that links reach, for rows (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and 100 * len(x & y) >= 90 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {d: top(d) for d in root}


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contaminated(text, items):
    words, hit = norm(text), set()
    for t in items:
        w = norm(t)
        n = min(len(w), 13)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for j in range(len(words) - n + 1 if n else 0):
            if tuple(words[j : j + n]) in windows:
                hit |= set(range(j, j + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def mixed(rows, slopes=(-0.5, 0.0, 0.5)):
    """(position, doc_id, pass) of every reading in training order, for rows (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, left = {}, sum(total.values()), set(names)
    while left:
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        s = min(over, key=lambda s: 3 * total[s] / weight[s])
        target[s] = 3.0 * total[s]
        rest -= target[s]
        left.remove(s)
    out = []
    for i, s in enumerate(names):
        digest = lambda d, t: hashlib.md5(f"{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        mine = sorted((digest(d, t), d) for d, t, x in rows if x == s)
        at, budget, slope, k = 0, math.floor(target[s] + 0.5), slopes[i % 3], 0
        while at < budget and total[s]:
            for _, d in mine:
                if size[d] and at < budget:
                    share = min(1.0, at / target[s])
                    position = share if slope == 0 else (slope - 1 + math.sqrt((1 - slope) ** 2 + 4 * slope * share)) / (2 * slope)
                    out.append((position, d, k))
                at += size[d]
            k += 1
    return sorted(out)


def hashed(*parts):
    """Spark's xxhash64: each value hashed with the hash before as its seed."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(4, "little"), seed)
    return seed


def shard(key, weights, region=8, rack=4):
    draw = lambda nodes, level: min((-math.log(((hashed(key, level, i) >> 11) + 0.5) / 2**53) / w, i) for i, w in nodes)[1]
    node = lambda size: {k: sum(w for i, w in enumerate(weights) if i // size == k) for k in {i // size for i in range(len(weights))}}
    a = draw(node(region).items(), "region")
    b = draw([(k, w) for k, w in node(rack).items() if k * rack // region == a], "rack")
    return draw([(i, w) for i, w in enumerate(weights) if i // rack == b], "shard")
