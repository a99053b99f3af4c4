"""The pipeline's near copies against the similarity of all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from palimpsest.llm import shingles, simhash

from . import brute


def sets(text):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept(rows):
    """The least doc_id of each component of pairs with similarity 0.8 or more."""
    s = {d: sets(t) for d, t in rows}
    root = {d: d for d in s}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in s:
        for b in s:
            if a < b and (s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted({top(d) for d in s})


def edited():
    """Texts with copies of one, two, four and more edited words, chains, short texts and texts without words."""
    rng = np.random.default_rng(4)
    out = [None, "", " ", "a b c", "A b  c", "a b c d", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g"]
    for n in (30, 120, 400):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            out.append(" ".join(base))
            for edits in (1, 1, 2, 3, 4, 6, 9):
                copy = list(base)
                for i in rng.integers(0, n, edits):
                    copy[i] = f"x{rng.integers(0, 5000)}"
                out.append(" ".join(copy))
                if edits == 3:
                    base = copy
    return list(enumerate(out))


def test_pipeline_drops_edited_copies(spark):
    data = edited()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = kept(data)
    assert sorted(r.doc_id for r in pipeline.keep_one_copy(spark, docs, "").collect()) == want
    assert simhash.keep_one(docs).count() > len(want)  # two bits of three-word shingles leave edited copies


def test_star_and_rest(spark):
    """A chain whose ends are unlike needs the pairs that the star leaves."""
    words = [f"w{i}" for i in range(200)]
    data = []
    for i in range(40):
        copy = list(words)
        copy[5 * i : 5 * i + 5] = [f"y{j}" for j in range(5)]
        data.append((i, " ".join(copy)))
    for i in range(40, 80):  # each is near its neighbours only
        data.append((i, " ".join(f"z{j}" for j in range(10 * i, 10 * i + 110))))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == kept(data)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, None), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(repr, shingles.keep_one(docs).collect())) == ["Row(doc_id=3, text=None)", "Row(doc_id=None, text='a b c')"]
    assert shingles.keep_one(docs.where("false")).collect() == []


def test_fingerprints_pair_sets(spark):
    """Sets of one fingerprint meet its least set, those of fingerprints within two bits each other's least."""
    data = [(f, n) for f, n in [(0, 10), (1, 10), (3, 10), (7, 10), (1 << 63, 10), (5, 7), (9, 8), (1 << 40 | 1 << 50, 9)]]
    prints = [(i, n, f - (f >> 63 << 64)) for i, (f, n) in enumerate(data)] + [(20, 10, 1), (21, 11, 1), (21, 11, 0), (22, 30, 1)]
    least = {}
    for node, n, f in prints:
        least[f] = min(least.get(f, (node, n)), (node, n))
    met = [((node, n), least[f]) for node, n, f in prints] + [(least[f], least[g]) for f in least for g in least if ((f ^ g) & 2**64 - 1).bit_count() <= 2]
    want = {(min(a, b)[0], max(a, b)[0]) for a, b in met if a[0] != b[0] and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])}
    got = [tuple(r) for r in shingles.fingerprint_pairs(spark.createDataFrame(prints, "node long, n int, print long")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_fingerprints_find_copies_alone(spark, monkeypatch):
    """Without the bands the stage still drops copies within two bits by five words, and only near ones."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 900)]
        data += [" ".join(base), " ".join([*base[:-1], "y"]), " ".join([*base, "z"]), " ".join(base[1:])]
    # One shingle repeated decides every bit, so unlike sets share a fingerprint.
    data += ["a b c d e " * 60 + " ".join(f"{p}{i}" for i in range(40)) for p in "pq"]
    data = list(enumerate(data))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    bits = {d: simhash.simhash(t.encode(), 5) for d, t in data}
    near = {d: sets(t) for d, t in data}
    close = [(a, b) for a in near for b in near if a < b and (bits[a] ^ bits[b]).bit_count() <= 2]
    alike = [(a, b) for a, b in close if 5 * len(near[a] & near[b]) >= 4 * len(near[a] | near[b])]
    assert len(alike) >= 6 and (24, 25) in close and (24, 25) not in alike
    each = shingles._each

    def bandless(docs, fields, make):
        out = each(docs, fields, make)
        return out.withColumn("keys", F.expr("filter(keys, k -> false)")) if "keys" in out.columns else out

    monkeypatch.setattr(shingles, "_each", bandless)
    least = {d: d for d in near}
    for _ in near:  # chains
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == sorted(set(least.values()))
