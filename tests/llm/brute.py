"""The contracts of the ten queries, computed row by row in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    fps = [(d, simhash(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for d, f in fps:
        r = root(f)
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return [(d, f"{f:016x}", low.get(root(f))) for d, f in fps]


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """Target by source of {source: size}: shares are dealt again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= over


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def floored(v):
    return [math.floor(1024 * float(x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def top_products(rows, k=10, divisor=100):
    rows = {i: floored(v) for i, v in rows if i is not None and usable(v)}
    out = []
    for q in rows:
        if q % divisor == 0:
            scores = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def top_cosines(rows, k=5, divisor=50):
    rows = {i: np.array(v, float) for i, v in rows if i is not None and usable(v) and any(v)}
    out = []
    for q in rows:
        if q % divisor == 0:
            scores = sorted((-float((rows[q] * v).sum() / (np.sqrt((rows[q] ** 2).sum()) * np.sqrt((v**2).sum()))), i) for i, v in rows.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    assign = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    access = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    spans = sorted(assign + access + hexes, key=lambda s: (s[1], order.index(s[0])))
    return len(assign), len(access), len(hexes), hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest(), spans


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def more_secrets(text, classes, allow, base):
    """Spans that entropy adds, window by window."""
    text, spans = text or "", list(base)
    for kind, chars, width, bits, holds in classes:
        for m in re.finditer(f"[{chars}]+", text):
            body = m[0]
            if len(body) < width or not all(re.search(h, body) for h in holds) or re.search(allow, body):
                continue
            hot = [i for i in range(len(body) - width + 1) if entropy(body[i : i + width]) >= bits - 1e-7]
            if hot:
                a, z = m.start() + hot[0], m.start() + hot[-1] + width
                if not any(a < y and x < z for _, x, y in spans):
                    spans.append((kind, a, z))
    return [s for s in spans if s not in base]


def without_repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def ids_crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def by_sequence(pieces):
    out = defaultdict(list)
    for p in pieces:
        out[p["sequence_id"]].append(p)
    return out
