"""The toxicity models against their definition, written out for a small corpus."""

import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import SparkContext

from palimpsest.llm import toxicity
from palimpsest.llm.common import worker_cache

TOXIC = ["bad idiot word", "you idiot go", "bad idiot word"]
ORDINARY = ["good day word", "a good day to you", "day by day", "good word", "bad day"]
ORDER, D, OWN = 4, 0.75, 1.5


def corpus(texts):
    grams, pairs = Counter(), Counter()
    for t in texts:
        w = toxicity.words_of(t)
        for x in set(w):
            s = "\x02" + x + "\x03"
            grams.update(s[max(0, i - ORDER) : i] for i in range(2, len(s) + 1))
        pairs.update(set(zip(w, w[1:])))
    return grams, pairs


GRAMS, PAIRS = zip(corpus(ORDINARY), corpus(TOXIC))


def model():
    firsts = {a: tuple((sum(n for (x, _), n in PAIRS[c].items() if x == a), sum(min(n, OWN) for (x, _), n in PAIRS[c].items() if x == a)) for c in (0, 1)) for a, _ in PAIRS[0] | PAIRS[1]}
    listed = {p: (PAIRS[0][p], PAIRS[1][p]) for p in PAIRS[0] | PAIRS[1] if max(PAIRS[0][p], PAIRS[1][p]) > OWN}
    return toxicity.fit_counts(GRAMS[1], GRAMS[0], ORDER, D, OWN, listed, {a: f for a, f in firsts.items() if any(x < n for n, x in f)}, own_pairs=OWN)


def continuations():
    """Distinct left neighbours of each shorter expression."""
    out, level = {}, set(GRAMS[0]) | set(GRAMS[1])
    while level:
        left = defaultdict(set)
        for g in level:
            left[g[1:]].add(g[0])
        left.pop("", None)
        for g, s in left.items():
            out[g] = max(out.get(g, 0), len(s))
        level = {g for g in left if len(g) > 1}
    return out


CONT = continuations()
LETTERS = {g for g in CONT if len(g) == 1}


def interpolated(counts, g, discount, low):
    ctx = [n for x, n in counts.items() if x[:-1] == g[:-1]]
    if not ctx:
        return low
    return (max(counts.get(g, 0) - discount, 0) + sum(min(n, discount) for n in ctx) * low) / sum(ctx)


def backoff(g):
    return interpolated(CONT, g, D, backoff(g[1:]) if len(g) > 1 else 1 / (len(LETTERS) + 1))


def probability(c, g):
    return interpolated(GRAMS[c], g, OWN, interpolated(GRAMS[0] + GRAMS[1], g, D, backoff(g[1:])))


def word(c, w):
    s = "\x02" + w + "\x03"
    return math.prod(probability(c, s[max(0, i - ORDER) : i]) for i in range(2, len(s) + 1))


def after(c, a, w):
    ctx = [n for (x, _), n in PAIRS[c].items() if x == a]
    return word(c, w) if not ctx else (max(PAIRS[c][a, w] - OWN, 0) + sum(min(n, OWN) for n in ctx) * word(c, w)) / sum(ctx)


@pytest.mark.parametrize("text", [*TOXIC, *ORDINARY, "idiots! are so-called-IDIOT words", "中文 xyz 12_3", "day idiot idiot day bad"])
def test_ratio_is_the_definition(text):
    w = toxicity.words_of(text)
    total = 0.0
    for i, x in enumerate(w):
        p = [word(c, x) if not i else after(c, w[i - 1], x) for c in (0, 1)]
        total += math.log((1 - toxicity.SHARE) + toxicity.SHARE * p[1] / p[0])
    assert model().ratio(text) == pytest.approx(total / (len(w) + toxicity.NEUTRAL), abs=1e-12)


def test_probabilities_sum_to_one():
    m = toxicity.Smoothed(GRAMS, D, OWN)
    contexts = {g[:-1] for g in GRAMS[0] | GRAMS[1]} | {"\x02q", "zzz"}
    for ctx in contexts:
        for c in (0, 1):
            p = [m.prob(c, ctx + x) for x in [*LETTERS, "中"]]  # one stands for all characters never seen
            assert min(p) > 0 and math.fsum(p) == pytest.approx(1)
    firsts = {a for a, _ in PAIRS[0] | PAIRS[1]}
    words = {b for _, b in PAIRS[0] | PAIRS[1]}
    for a in firsts:
        for c in (0, 1):
            rest = 1 - math.fsum(word(c, w) for w in words)
            n = sum(k for (x, _), k in PAIRS[c].items() if x == a)
            share = sum(min(k, OWN) for (x, _), k in PAIRS[c].items() if x == a) / n if n else 1
            assert math.fsum(after(c, a, w) for w in words) + share * rest == pytest.approx(1)


def test_signs_and_sides():
    m = model()
    assert m.word_ratio("idiot") > 0 > m.word_ratio("day")
    assert m.ratio("idiot") > 0 > m.ratio("day day")
    assert m.ratio('"idiot" (idiot) so-called-idiot') > m.ratio("idiot")
    assert m.word_ratio("中") == pytest.approx(m.word_ratio("文"))
    assert m.ratio("") == m.ratio(None) == m.ratio(" \n") == 0


def test_scorer_is_the_model():
    m = toxicity.KneserNey.load(model().dump())
    texts = [*TOXIC, *ORDINARY, "idiots! are so-called-IDIOT words", "中文 xyz 12_3 😀😀", "", None, " ", "day idiot idiot day bad " * 50, "x" * 5000, "\x02bad\x03"]
    got = toxicity.Scorer(m).ratios(texts)
    assert got.tolist() == pytest.approx([m.ratio(t) for t in texts], abs=1e-12)
    assert toxicity.Scorer(m).ratios([]).tolist() == [] and toxicity.Scorer(toxicity.KneserNey(4, {}, {})).ratios(["a b"]).tolist() == [0.0]


def test_counting_gives_back_what_a_worker_kept():
    """A worker that packed before holds a tokenizer and its pieces, which counting must not keep beside its own."""
    worker_cache("words path")["encoder"] = "pieces"
    batch = pa.RecordBatch.from_arrays([pa.array([*TOXIC, *ORDINARY]), pa.array([1] * 3 + [0] * 5, pa.int32())], names=["text", "toxic"])
    got = [r for b in toxicity._counts(iter([batch]), ORDER) for r in b.to_pylist()]
    assert "encoder" not in worker_cache("words path")
    for c in (0, 1):
        assert {r["gram"]: r["n"] for r in got if r["toxic"] == c and r["first"] is None} == GRAMS[c]
        assert {(r["first"], r["gram"]): r["n"] for r in got if r["toxic"] == c and r["first"] is not None} == PAIRS[c]


def test_scorer_keeps_no_second_table():
    """Ratios by expression are kept by hash alone."""
    scorer = toxicity.Scorer(model())
    assert len(scorer.seen[0]) == len(model().seen) and not scorer.model.seen and not scorer.model.after


def test_training_starts_no_workers_of_a_list(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('plain words of text ', id % 7, if(id % 2 = 0, ' awful', ' kind')) as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(1 - id % 2 as int) as toxic")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: pytest.fail("the sample went through a list, whose Python workers stay beside the models'"))
    trained = toxicity.train(docs, labels)
    held = [math.copysign(1, r) for r in toxicity.Scorer(toxicity.KneserNey.load(trained.model)).ratios(["plain words awful", "plain words kind"])]
    assert held == [1, -1]


def test_counting_and_scoring_give_back_freed_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1), raising=False)
    list(toxicity._counts(iter([pa.record_batch([["a b", "c"], pa.array([0, 1], pa.int32())], names=["text", "toxic"])]), 3))
    assert calls
    del calls[:]
    toxicity._scorer(SimpleNamespace(value=toxicity.KneserNey(3, {}, {}).dump()), "a mark of its own")
    assert calls
