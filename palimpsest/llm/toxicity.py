"""Toxicity by class-conditional Kneser-Ney models of words, spelled out, and of the expressions they make."""

from __future__ import annotations

import marshal
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, release, sliced, worker_cache

#: Longest spelling expression in characters, absolute discount, and the bounds on learning rows.
ORDER, DISCOUNT, MAX_TOXIC, ORDINARY_EACH = 8, 0.75, 350, 10
#: Discount of a class's own counts: what is rarer in it is left to the shared counts.
CLASS_DISCOUNT = 1.5
#: The same of pairs of words, which a few copies of a text repeat together.
PAIR_DISCOUNT = 10.0
#: Share of a toxic text's words that its toxic model speaks for, and words of neutral text added to each length.
SHARE, NEUTRAL = 0.003, 20.0
#: Texts scored together.
TEXTS = 1000
START, END = "\x02", "\x03"
MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words: runs of letters, of digits and of other marks, so that quotes and hyphens hide no word.
WORD = re.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spelled(word: str, order: int) -> list[str]:
    """A word's expressions: each character, and the end, after the up to ``order - 1`` characters before it."""
    s = START + word + END
    return [s[max(0, i - order) : i] for i in range(2, len(s) + 1)]


def expressions(words: Counter, order: int) -> Counter:
    """Counts of all words' spelling expressions."""
    out: Counter = Counter()
    for w, c in words.items():
        for g in spelled(w, order):
            out[g] += c
    return out


@dataclass
class KneserNey:
    """Log-likelihood ratios (toxic over ordinary) of expressions, and the score's calibration.

    seen: of a spelling expression's last character after the rest of it; after:
    of any other character after that context.  pairs: of a word after another;
    follows: of any other word after that one, beside the word's own spelling.
    What is in neither has ratio 0, as both classes back off to the same shared counts.
    """

    order: int
    seen: dict[str, float]
    after: dict[str, float]
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    follows: dict[str, float] = field(default_factory=dict)
    share: float = SHARE

    def dump(self) -> bytes:
        return marshal.dumps((self.order, self.seen, self.after, self.pairs, self.follows, self.share))

    @classmethod
    def load(cls, data: bytes) -> KneserNey:
        return cls(*marshal.loads(data))

    def word_ratio(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary) by its spelling, all of it."""
        seen, after, total = self.seen, self.after, 0.0
        for g in spelled(word, self.order):
            r = seen.get(g)
            total += after.get(g[:-1], 0.0) if r is None else r
        return total

    def ratio(self, text: str | None) -> float:
        """Length-normalised log-likelihood of a whole text as toxic less that as ordinary; 0 without words.

        A toxic text is ordinary but for a share of its words, so a word's
        likelihood in it is that mixture of both models.
        """
        words = words_of(text)
        if not words:
            return 0.0
        kept = {w: self.word_ratio(w) for w in set(words)}
        x = np.fromiter(map(kept.__getitem__, words), float, len(words))
        if self.pairs or self.follows:
            follows, pairs = self.follows, self.pairs
            x[1:] += np.fromiter((follows.get(w, 0.0) for w in words[:-1]), float, len(words) - 1)
            for i, p in enumerate(zip(words, words[1:], strict=False), 1):
                if p in pairs:
                    x[i] = pairs[p]
        return float(np.log1p(self.share * np.expm1(np.minimum(x, 500.0))).sum()) / (len(words) + NEUTRAL)


@dataclass
class Trained:
    """A model as bytes, which workers load, and the score's calibration."""

    model: bytes
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (ratios - self.shift), -60.0, 60.0)))


class Scorer:
    """:meth:`KneserNey.ratio` of many texts at once: a batch's distinct words are spelled together.

    Expressions are looked up by a 64-bit hash of their characters.
    """

    def __init__(self, model: KneserNey):
        self.seen, self.after = self._table(model.seen), self._table(model.after)
        self.model = replace(model, seen={}, after={})  # the tables stand for both

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(32)) * FINISH
        return h ^ h >> np.uint64(29)

    @staticmethod
    def _added(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        return (h + char + np.uint64(1)) * MULTIPLIER

    def _table(self, ratios: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and the ratios by them."""
        lengths = np.fromiter(map(len, ratios), np.int64, len(ratios))
        chars = np.frombuffer("".join(ratios).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        h = np.zeros(len(lengths), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(int(lengths.max(initial=0))):
                on = lengths > j
                h[on] = self._added(h[on], chars[(ends - lengths)[on] + j])
            h = self._mixed(h)
        o = np.argsort(h)
        return h[o], np.fromiter(ratios.values(), float, len(ratios))[o]

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of each hash (0 if there is none), and whether there is one."""
        keys, values = table
        if not len(keys):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        i = np.searchsorted(keys, h)
        i[i == len(keys)] = 0
        there = keys[i] == h
        return np.where(there, values[i], 0.0), there

    def words(self, words: list[str]) -> np.ndarray:
        """:meth:`KneserNey.word_ratio` of each word."""
        order = self.model.order
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        chars = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = np.zeros(len(chars), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(order - 1, 0, -1):
                at = np.flatnonzero(place >= j)
                h[at] = self._added(h[at], chars[at - j])
            on = np.flatnonzero(place > 0)
            r, there = self._found(self.seen, self._mixed(self._added(h[on], chars[on])))
            miss = np.flatnonzero(~there)
            r[miss] = self._found(self.after, self._mixed(h[on[miss]]))[0]
        return np.bincount(word[on], r, minlength=len(words))

    def ratios(self, texts: list[str | None]) -> np.ndarray:
        """:meth:`KneserNey.ratio` of each text."""
        m = self.model
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        if not counts.sum():
            return np.zeros(len(lists))
        numbered = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
        vocabulary, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        x = self.words(vocabulary)[code]
        text = np.repeat(np.arange(len(lists)), counts)
        if m.pairs or m.follows:
            follows = np.fromiter((m.follows.get(w, 0.0) for w in vocabulary), float, len(vocabulary))
            same = np.flatnonzero(text[1:] == text[:-1]) + 1
            x[same] += follows[code[same - 1]]
            number = {w: i for i, w in enumerate(vocabulary)}
            known = [(number[a] * len(vocabulary) + number[b], r) for (a, b), r in m.pairs.items() if a in number and b in number]
            if known:
                keys, values = (np.array(v) for v in zip(*sorted(known), strict=True))
                key = code[same - 1].astype(np.int64) * len(vocabulary) + code[same]
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[i] == key
                x[same[there]] = values[i[there]]
        sums = np.bincount(text, np.log1p(m.share * np.expm1(np.minimum(x, 500.0))), minlength=len(lists))
        return np.where(counts > 0, sums / (counts + NEUTRAL), 0.0)


class Smoothed:
    """Interpolated Kneser-Ney models of two classes' spelling expressions, with shared backoff.

    Counts of one class back off to those of both together, and these to shorter
    expressions with continuation counts (distinct left neighbours) over both,
    down to all characters alike and one that stands for those never seen.  A class's own
    discount is larger, so what is rare in it says what all texts say.
    """

    def __init__(self, counts: tuple[Counter, Counter], discount: float = DISCOUNT, own: float = CLASS_DISCOUNT):
        self.discount, self.own, self.counts = discount, own, counts
        self.every = Counter(counts[0])
        self.every.update(counts[1])
        level, self.merged = set(self.every), {}
        while level:  # continuation counts of ever shorter expressions
            conts: dict[str, int] = defaultdict(int)
            for g in level:
                conts[intern(g[1:])] += 1
            conts.pop("", None)
            for g, c in conts.items():
                self.merged[g] = max(self.merged.get(g, 0), c)
            level = {g for g in conts if len(g) > 1}
        self.total, self.kinds = self._sums(self.merged)
        self.whole, self.sorts = self._sums(self.every)
        self.floor = 1.0 / (self.kinds.get("", 0) + 1)
        self.n, self.freed = ({}, {}), ({}, {})
        for c in (0, 1):
            for g, k in counts[c].items():
                ctx = intern(g[:-1])
                self.n[c][ctx] = self.n[c].get(ctx, 0) + k
                self.freed[c][ctx] = self.freed[c].get(ctx, 0.0) + min(k, own)
        self.memo: dict[str, float] = {}

    @staticmethod
    def _sums(counts: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        total, kinds = {}, {}
        for g, c in counts.items():
            ctx = intern(g[:-1])
            total[ctx] = total.get(ctx, 0) + c
            kinds[ctx] = kinds.get(ctx, 0) + 1
        return total, kinds

    def backoff(self, g: str) -> float:
        """P(last character | the rest) by continuation counts."""
        p = self.memo.get(g)
        if p is None:
            ctx = g[:-1]
            low = self.backoff(intern(g[1:])) if len(g) > 1 else self.floor
            t = self.total.get(ctx, 0)
            p = self.memo[g] = low if not t else (max(self.merged.get(g, 0) - self.discount, 0.0) + self.discount * self.kinds[ctx] * low) / t
        return p

    def shared(self, g: str) -> float:
        """P(last character | the rest) by both classes' counts."""
        t = self.whole.get(g[:-1], 0)
        low = self.backoff(intern(g[1:]))
        return low if not t else (max(self.every.get(g, 0) - self.discount, 0.0) + self.discount * self.sorts[g[:-1]] * low) / t

    def weight(self, c: int, ctx: str) -> float:
        """The share that class ``c`` leaves to the shared model after ``ctx``."""
        return self.freed[c][ctx] / self.n[c][ctx] if ctx in self.n[c] else 1.0

    def prob(self, c: int, g: str, low: float | None = None) -> float:
        """P(last character | the rest, class c)."""
        low = self.shared(g) if low is None else low
        t = self.n[c].get(g[:-1], 0)
        return low if not t else max(self.counts[c].get(g, 0) - self.own, 0.0) / t + self.weight(c, g[:-1]) * low

    def word(self, c: int, word: str, order: int) -> float:
        """P(word | class c) by its spelling."""
        return math.prod(self.prob(c, g) for g in spelled(word, order))


#: Of a pair of words: counts by class; of a first word: counts and discounted counts by class.
Pairs = dict[tuple[str, str], tuple[int, int]]
Firsts = dict[str, tuple[tuple[int, float], tuple[int, float]]]


def fit_counts(toxic: Counter, ordinary: Counter, order: int = ORDER, discount: float = DISCOUNT, own: float = CLASS_DISCOUNT, pairs: Pairs | None = None, firsts: Firsts | None = None, own_pairs: float = PAIR_DISCOUNT, share: float = SHARE) -> KneserNey:
    """The model from both classes' counts of spelling expressions, and of words that follow each other.

    pairs has (ordinary, toxic) counts of those above ``own_pairs`` in some class,
    firsts of their first words (n, freed) by class.  A pair with no more than the
    discount in both classes has its count freed whole, so it need not be listed.
    """
    m = Smoothed((ordinary, toxic), discount, own)
    seen, after = {}, {}
    for g in m.every:
        low = m.shared(g)
        r = math.log(m.prob(1, g, low) / m.prob(0, g, low))
        seen[g] = r
    for ctx in m.whole:
        r = math.log(m.weight(1, ctx) / m.weight(0, ctx)) if m.weight(1, ctx) and m.weight(0, ctx) else 0.0
        if r:
            after[ctx] = r
    # A seen expression with the ratio of its context's others need not be kept.
    for g in [g for g, r in seen.items() if r == after.get(g[:-1], 0.0)]:
        del seen[g]
    pairs, firsts = pairs or {}, firsts or {}
    left = {a: tuple(freed / n if n else 1.0 for n, freed in f) for a, f in firsts.items()}
    ratios = {}
    for (a, b), c in pairs.items():
        p = [max(c[k] - own_pairs, 0.0) / firsts[a][k][0] + left[a][k] * m.word(k, b, order) if firsts[a][k][0] else m.word(k, b, order) for k in (0, 1)]
        ratios[a, b] = math.log(p[1] / p[0])
    follows = {a: math.log(w[1] / w[0]) for a, w in left.items()}
    return KneserNey(order, seen, after, ratios, {a: r for a, r in follows.items() if r}, share)


def calibrate(ratios: np.ndarray, labels: np.ndarray, cut: float = 0.7) -> tuple[float, float]:
    """(slope, shift) so that ``cut`` is passed where both classes, weighing the same, err least."""
    if not len(ratios) or labels.min() == labels.max():
        return 1.0, 0.0
    order = np.argsort(ratios, kind="stable")
    r, y = ratios[order], labels[order]
    pos, neg = y.sum(), (1 - y).sum()
    # Error of rejecting everything from place i on, each class weighing the same.
    err = np.concatenate([[0], np.cumsum(y)]) / pos + (neg - np.concatenate([[0], np.cumsum(1 - y)])) / neg
    err[1:-1][r[1:] == r[:-1]] = np.inf  # equal ratios stand on one side
    best = np.flatnonzero(err <= err.min() + 1e-12)
    i = int(best[len(best) // 2])
    edge = r[0] - 1e-6 if i == 0 else r[-1] + 1e-6 if i == len(r) else (r[i - 1] + r[i]) / 2
    spread = max(1e-6, float(np.median(r[y == 1]) - np.median(r[y == 0])))
    return 8.0 / spread, float(edge - math.log(cut / (1 - cut)) * spread / 8.0)


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts by class of each batch's spelling expressions (first is null) and pairs of words, of rows (text, toxic)."""
    worker_cache("toxicity counts")  # a worker that packed before holds a tokenizer, its pieces and freed memory
    for b in sliced(batches):
        words, pairs = (Counter(), Counter()), (Counter(), Counter())
        for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(t)
            words[c].update(set(w))
            pairs[c].update(set(zip(w, w[1:], strict=False)))
        for c in (0, 1):
            grams = expressions(words[c], order)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array([c] * len(grams), pa.int32()), pa.array(list(grams.values()), pa.int64())], names=["first", "gram", "toxic", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs[c]], pa.string()), pa.array([z for _, z in pairs[c]], pa.string()), pa.array([c] * len(pairs[c]), pa.int32()), pa.array(list(pairs[c].values()), pa.int64())], names=["first", "gram", "toxic", "n"])
    give_back()  # this worker idles while another fits


def sample_table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """(doc_id, toxic) of the collected rows, through Arrow: a list would be dealt out by a second set of Python workers beside those of the models."""
    columns = [pa.array([int(x[c]) for x in rows], kind) for c, kind in (("doc_id", pa.int64()), ("toxic", pa.int32()))]
    return spark.createDataFrame(pa.table(columns, names=["doc_id", "toxic"]))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, order: int = ORDER, cut: float = 0.7) -> Trained:
    """Fit on a bounded sample of labelled rows with crc32(doc_id as text) mod 3 other than 1.

    At most ``max_toxic`` toxic rows and ORDINARY_EACH times as many ordinary ones
    are read, those of least hash, whole texts; a word, and a pair of words, counts
    once a text.  A fifth of them calibrates the score and the rest is counted.  A
    doc_id that is labelled both ways counts as toxic.  Without rows of both
    classes the model knows nothing and every score is 0.5.
    """
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.where("crc32(cast(doc_id as string)) % 3 != 1").withColumn("order", F.xxhash64("doc_id"))
    toxic = own.where("toxic = 1").orderBy("order", "doc_id").limit(max_toxic).collect()
    ordinary = own.where("toxic = 0").orderBy("order", "doc_id").limit(ORDINARY_EACH * len(toxic)).collect()
    spark = docs.sparkSession
    chosen = F.broadcast(sample_table(spark, toxic + ordinary))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").withColumn("held", F.expr("pmod(xxhash64(doc_id, 7), 5) = 0"))

    counted = sample.where("not held").select("text", "toxic").mapInArrow(lambda it: _counts(it, order), "first string, gram string, toxic int, n long")
    # Written, as spelling, pairs and their first words are read apart.
    counted = materialize(counted.groupBy("first", "gram").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]), "toxicity")
    spelling = counted.select(F.when(F.col("first").isNull(), 0).otherwise(1).alias("kind"), "first", "gram", "n0", "n1", F.lit(0.0).alias("f0"), F.lit(0.0).alias("f1")).where(f"first is null or greatest(n0, n1) > {PAIR_DISCOUNT}")
    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)] + [F.sum(F.least(F.col(f"n{c}"), F.lit(PAIR_DISCOUNT))).alias(f"f{c}") for c in (0, 1)]
    firsts = counted.where("first is not null").groupBy("first").agg(*sums).where("f0 < n0 or f1 < n1").select(F.lit(2).alias("kind"), "first", F.lit(None).cast("string").alias("gram"), "n0", "n1", "f0", "f1")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity fit")
        counts, pairs, starts = (Counter(), Counter()), {}, {}
        for b in batches:
            for kind, first, gram, n0, n1, f0, f1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    for c, n in ((counts[0], n0), (counts[1], n1)):
                        if n:
                            c[gram] = n
                elif kind == 1:
                    pairs[first, gram] = (n0, n1)
                else:
                    starts[first] = ((n0, f0), (n1, f1))
        model = fit_counts(counts[1], counts[0], order, pairs=pairs, firsts=starts) if counts[0] and counts[1] else KneserNey(order, {}, {})
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], names=["model"])

    # One task of bounded input: the sample's distinct expressions.
    made = spelling.unionByName(firsts).repartition(1).mapInArrow(fit, "model binary").first()
    release(counted)
    trained = Trained(bytes(made.model) if made else KneserNey(order, {}, {}).dump())
    sent, mark = spark.sparkContext.broadcast(trained.model), uuid.uuid4().hex
    held = sample.where("held").select("text", "toxic").mapInArrow(lambda it: _ratios(it, sent, mark), "toxic int, ratio double").toArrow()
    sent.destroy()
    trained.slope, trained.shift = calibrate(held["ratio"].to_numpy(), held["toxic"].to_numpy().astype(float), cut)
    return trained


def _scorer(sent, mark: str) -> Scorer:
    """This worker's scorer of a broadcast model."""
    cache = worker_cache(f"toxicity {mark}")
    if "scorer" not in cache:
        cache["scorer"] = Scorer(KneserNey.load(sent.value))
        give_back()  # the model's own tables, of which the scorer keeps hashes
    return cache["scorer"]


def _ratios(batches: Iterator[pa.RecordBatch], sent, mark: str) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(sent, mark)
    for b in sliced(batches, TEXTS):
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scorer.ratios(b.column(0).to_pylist()))], names=["toxic", "ratio"])


def score_texts(docs: DataFrame, trained: Trained, cut: float = 0.7) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) renamed c0, c1, ..., with score double and predicted int."""
    sent, mark = docs.sparkSession.sparkContext.broadcast(trained.model), uuid.uuid4().hex
    calibration = Trained(b"", trained.slope, trained.shift)
    named = [f"c{i}" for i in range(len(docs.columns))]
    i = docs.columns.index("text")
    fields = ", ".join(f"`{n}` {t.dataType.simpleString()}" for n, t in zip(named, docs.schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent, mark)
        for b in sliced(batches, TEXTS):
            scores = calibration.scores(scorer.ratios(b.column(i).cast(pa.string()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=[*named, "score", "predicted"])
            give_back()

    return docs.toDF(*named).mapInArrow(run, f"{fields}, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, order: int = ORDER, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A text's two log-likelihoods are sums over all its words, each by its whole
    spelling and by the word before it, and their difference is divided by the
    number of words (and some neutral ones), so long and short texts compare.  A null or empty
    text has ratio 0, the ratio of a text that says nothing.  Rows
    without a doc_id are scored and not held out; repeated rows are scored each;
    an empty table gives no rows.  Only doc_id and text are read, and labels
    only to learn.
    """
    model = train(docs, labels, max_toxic, order, cut)
    out = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, cut)
    held = F.coalesce(F.expr("crc32(cast(c0 as string)) % 3 = 1"), F.lit(False))
    return out.select(F.col("c0").alias("doc_id"), held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, all columns."""
    out = score_texts(docs, train(docs, labels, max_toxic, cut=cut), cut)
    return out.where("predicted = 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
