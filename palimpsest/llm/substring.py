"""Repeated passages of words, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sliced, worker_cache

#: Words of a window and of an expression; suffixes of one subtree; places of one expression beyond which it is lengthened.
WINDOW, EXPRESSION = 20, 6
SUBTREE, GROUP = 20_000, 50_000
#: Suffixes gathered before their trees are built, and segments held back to find repeats in one task.
BUNDLE, HELD = 100_000, 50_000
#: Texts tokenized together.
TEXTS = 200
MULTIPLIER, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a batch of texts, one after the other, as numbers that are equal where the words are."""

    def __init__(self, texts: pa.Array):
        trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
        cut = pc.ascii_split_whitespace(trimmed)
        numbered = cut.flatten().dictionary_encode()
        self.names = numbered.dictionary
        self.code = numbered.indices.to_numpy(zero_copy_only=False)
        counts = np.diff(cut.offsets.to_numpy())
        counts[pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0] = 0
        if len(self.code) != counts.sum():  # an empty text is cut into one empty word
            self.code = self.code[pc.binary_length(cut.flatten()).to_numpy(zero_copy_only=False) > 0]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.text = np.repeat(np.arange(len(counts)), counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; distinct ones are hashed once."""
        known = np.fromiter(map(xxhash.xxh64_intdigest, self.names.cast(pa.binary()).to_pylist()), np.uint64, len(self.names))
        return known[self.code]

    def windows(self, window: int) -> np.ndarray:
        """Whether a window that stays in its text starts at each word."""
        n = len(self.code)
        ok = np.zeros(n, bool)
        if n >= window:
            ok[: n - window + 1] = self.text[window - 1 :] == self.text[: n - window + 1]
        return ok

    def bytes(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one space, and where each starts (one more at the end)."""
        flat = self.names.take(pa.array(self.code))
        at = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        whole = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pc.binary_join(whole, " ")[0].as_buffer().to_pybytes() if len(flat) else b"", at


def expressions(sym: np.ndarray, words: int) -> np.ndarray:
    """Hash of the ``words`` words from each place on; shorter by ``words - 1`` than ``sym``."""
    n = max(0, len(sym) - words + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            h = h * MULTIPLIER + sym[j : n + j]
        h ^= h >> np.uint64(32)
        h *= FINISH
        h ^= h >> np.uint64(29)
    return h


def leaders(h: np.ndarray, n: int, width: int) -> np.ndarray:
    """Place of the least of ``width`` hashes from each of the first ``n`` places on, the leftmost of equals.

    The minima of 1, 2, 4, ... places make those of twice as many.
    """
    low, at, step = h, np.arange(len(h)), 1
    while step < width:
        by = min(step, width - step)
        other = low[by:] < low[:-by]
        at = np.where(other, at[by:], at[:-by])
        low = np.where(other, low[by:], low[:-by])
        step += by
    return at[:n]


def segments_of(words: Words, window: int, expression: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, place, key, hashes): the maximal runs of windows with one leading expression.

    first and end are the run's windows, place its expression's first word and
    key that expression's hash.  A window's leading expression is the least by
    hash of those it holds, so equal windows lead to equal keys, at equal distance.
    """
    sym, ok = words.hashes(), words.windows(window)
    if not ok.any():
        none = np.empty(0, np.int64)
        return none, none, none, none, sym
    h = expressions(sym, expression)
    n = len(sym) - window + 1
    lead = leaders(h, n, window - expression + 1)
    start = np.flatnonzero(ok[:n])
    lead = lead[start]
    new = np.r_[True, (lead[1:] != lead[:-1]) | (start[1:] != start[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(start)] - 1
    return start[at], start[last] + 1, lead[at], h[lead[at]].view(np.int64), sym


def subtrees(suffixes: np.ndarray, limit: int = SUBTREE) -> Iterator[np.ndarray]:
    """Groups of suffixes (rows of symbols) made of whole prefixes, none above ``limit`` unless all its suffixes are equal.

    Prefixes have variable lengths: one that too many suffixes share is split by
    one symbol more, and neighbouring small ones go together.
    """
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= limit or depth == suffixes.shape[1]:
            yield rows
            continue
        o = rows[np.argsort(suffixes[rows, depth], kind="stable")]
        ends = np.r_[np.flatnonzero(np.diff(suffixes[o, depth])) + 1, len(o)]
        at = 0
        while at < len(o):
            i = int(np.searchsorted(ends, at + limit, "right")) - 1
            end = int(ends[i]) if i >= 0 else 0
            if end > at:
                yield o[at:end]
            else:  # one prefix above the limit
                end = int(ends[i + 1])
                todo.append((o[at:end], depth + 1))
            at = end


def tree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree as its leaves in order and the length of each leaf's common prefix with the one before it.

    The lengths tell the internal nodes: the leaves under a node of depth d are
    neighbours whose common prefixes are at least d long.
    """
    lines = np.ascontiguousarray(suffixes, suffixes.dtype.newbyteorder(">"))
    o = np.argsort(lines.view(f"S{lines.shape[1] * lines.itemsize}").ravel(), kind="stable")
    s = suffixes[o]
    differs = s[1:] != s[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), s.shape[1])
    return o, np.r_[0, common] if len(o) else common


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf the number of the topmost node at least ``depth`` deep above it."""
    return np.cumsum(common < depth)


def later(suffixes: np.ndarray, doc: np.ndarray, place: np.ndarray, limit: int = SUBTREE) -> np.ndarray:
    """Which suffixes start after the first (doc, place) under their deep node."""
    out = np.zeros(len(suffixes), bool)
    for rows in subtrees(suffixes, limit):
        if len(rows) < 2:
            continue
        o, common = tree(suffixes[rows])
        node = deep_nodes(common, suffixes.shape[1])
        shared = np.r_[node[1:] == node[:-1], False]
        shared[1:] |= shared[:-1].copy()
        leaf, node = rows[o[shared]], node[shared]
        by = np.lexsort((place[leaf], doc[leaf], node))
        leaf, node = leaf[by], node[by]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, int)
        low = leaf[np.repeat(first, np.diff(np.r_[first, len(leaf)]))]
        out[leaf] = (doc[leaf] != doc[low]) | (place[leaf] != place[low])
    return out


RANGES = "doc_id long, tie long, first int, last int"
PLACES = "key long, doc_id long, tie long, place int"
SEGMENTS = "key long, seg string, doc_id long, tie long, first int, last int"


def _batch(fields: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types, strict=True)], names=list(names))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text); tie is the text's hash, so rows with one doc_id and tie have one text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, expression: int = EXPRESSION, group: int = GROUP, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, tie, first, last): word ranges whose windows all start earlier too; tie is the text's hash.

    1. Every window, a suffix cut at ``window`` words, is named by its leading
       expression.  The places of these expressions are written once; their
       histogram is summed before the shuffle, and only expressions
       that occur twice can lie in a repeat.
    2. Neighbouring windows with one leading expression form a segment of whole
       words.  Each task keeps the first of equal segments and reports the
       others; the rest is dealt by expression, so equal windows meet.  An
       expression with more than ``group`` places is lengthened to the whole
       window, so no frequent one gathers in one task.
    3. A task numbers the words of its segments, so symbols are equal where words
       are and nothing rests on hashes, splits the suffixes by
       variable-length prefixes into groups of at most ``subtree`` and builds each
       group's tree; under its nodes of depth ``window`` all leaves but the first are
       later occurrences.  Neighbouring ones make a maximal repeat's range.
    """
    texts = _texts(docs)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring")
        for b in sliced(batches, TEXTS):
            words = Words(b.column(2))
            _, _, place, key, _ = segments_of(words, window, expression)
            row = words.text[place]
            yield _batch(PLACES, [key, b.column(0).to_numpy(zero_copy_only=False)[row], b.column(1).to_numpy(zero_copy_only=False)[row], (place - words.first[row]).astype(np.int32)])

    found = materialize(texts.where("doc_id is not null").mapInArrow(places, PLACES), "substring")
    often = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "substring")
    place = F.when(F.col("n") > group, -1 - F.col("place")).otherwise(F.col("place"))
    # Rows of one doc_id and tie have one text, so a set of places is no longer than a text.
    per_doc = materialize(found.join(often, "key").groupBy("doc_id", "tie").agg(F.collect_set(place).alias("places")), "substring")
    release(found)
    release(often)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring")
        held: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            rows.clear()
            return _batch(SEGMENTS, [columns[0], pa.array(columns[1], pa.binary()).cast(pa.string()), *columns[2:]])

        for b in sliced(batches, TEXTS):
            words = Words(b.column(2))
            first, end, place, key, sym = segments_of(words, window, expression)
            given = b.column(3)
            base = np.repeat(words.first[:-1], np.diff(given.offsets.to_numpy()))
            at = given.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            mark = np.zeros(len(words.code), np.int8)
            mark[base + np.where(at < 0, -1 - at, at)] = np.where(at < 0, 2, 1)
            one, longer = mark[place] == 1, mark[place] == 2
            first, end, key, alone = first[one], end[one], key[one], [np.arange(a, z) for a, z in zip(first[longer].tolist(), end[longer].tolist(), strict=True)]
            if alone:  # windows of a lengthened expression, each by all its words
                alone = np.concatenate(alone)
                whole = expressions(sym, window).view(np.int64)[alone]
                first, end, key = np.r_[first, alone], np.r_[end, alone + 1], np.r_[key, whole]
            if not len(first):
                continue
            data, start = words.bytes()
            row = words.text[first]
            docs_, ties = b.column(0).to_numpy(zero_copy_only=False)[row], b.column(1).to_numpy(zero_copy_only=False)[row]
            own = words.first[row]
            for k, x, y, doc, tie, a, z in zip(key.tolist(), start[first].tolist(), (start[end + window - 1] - 1).tolist(), docs_.tolist(), ties.tolist(), (first - own).tolist(), (end + window - 1 - own).tolist(), strict=True):
                name = (k, data[x:y])
                was = held.get(name)
                if was is None:
                    held[name] = (doc, a, tie, z)
                elif (doc, a) < was[:2]:
                    held[name] = (doc, a, tie, z)
                    rows.append((was[0] * 1_000_003 + was[1] & 0x7FFFFFFFFFFFFFFF, None, was[0], was[2], was[1], was[3]))
                elif (doc, a) > was[:2]:
                    rows.append((doc * 1_000_003 + a & 0x7FFFFFFFFFFFFFFF, None, doc, tie, a, z))
                elif tie != was[2]:  # rows that share a doc_id: neither is earlier
                    rows.append((k, name[1], doc, tie, a, z))
            if len(held) > HELD:
                rows.extend((k, s, d, t, a, z) for (k, s), (d, a, t, z) in held.items())
                held.clear()
            if len(rows) > HELD:
                yield out()
        rows.extend((k, s, d, t, a, z) for (k, s), (d, a, t, z) in held.items())
        yield out()

    sent = texts.join(per_doc, ["doc_id", "tie"]).select("doc_id", "tie", "text", "places").mapInArrow(segments, SEGMENTS)
    dealt = sent.repartition("key").sortWithinPartitions("key")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring")
        bundle: list[pa.RecordBatch] = []
        size, last_key = 0, None

        def build() -> pa.RecordBatch:
            whole = pa.Table.from_batches(bundle).combine_chunks()
            cut = pc.split_pattern(whole["seg"].chunk(0), " ")
            code = cut.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
            offsets = cut.offsets.to_numpy().astype(np.int64)
            counts = np.diff(offsets) - window + 1
            seg = np.repeat(np.arange(len(counts)), counts)
            step = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
            suffixes = np.lib.stride_tricks.sliding_window_view(code, window)[offsets[seg] + step]
            doc, tie, first = (whole[c].to_numpy() for c in ("doc_id", "tie", "first"))
            over = np.flatnonzero(later(suffixes, doc[seg], first[seg] + step, subtree))
            new = np.r_[True, (np.diff(over) != 1) | (np.diff(seg[over]) != 0)][: len(over)]
            a = np.flatnonzero(new)
            z = np.r_[a[1:], len(over)] - 1
            s, begin, stop = seg[over[a]], step[over[a]], step[over[z[: len(a)]]]
            return _batch(RANGES, [doc[s], tie[s], (first[s] + begin).astype(np.int32), (first[s] + stop + window).astype(np.int32)])

        for b in batches:
            gone = b.filter(pc.is_null(b.column(1)))
            if gone.num_rows:
                yield gone.select([2, 3, 4, 5])
            b = b.filter(pc.is_valid(b.column(1)))
            keys = b.column(0).to_numpy()
            windows = np.cumsum(b.column(5).to_numpy() - b.column(4).to_numpy() - window + 1)
            edges = np.flatnonzero(np.r_[len(keys) > 0 and last_key is not None and keys[0] != last_key, keys[1:] != keys[:-1]][: len(keys)])
            at, done = 0, 0
            for e in edges.tolist():  # trees end where a key ends
                held_now = size + (int(windows[e - 1]) if e else 0) - done
                if held_now > BUNDLE:
                    if e > at:
                        bundle.append(b.slice(at, e - at))
                    if bundle:
                        yield build()
                    bundle, size, at, done = [], 0, e, int(windows[e - 1]) if e else 0
            if at < b.num_rows:
                bundle.append(b.slice(at))
                size += int(windows[-1]) - done
                last_key = keys[-1]
        if bundle:
            yield build()

    return dealt.mapInArrow(trees, RANGES)


def _apply(text: bytes | None, ranges: list[dict] | None) -> tuple[list[bytes], np.ndarray | None]:
    """Words, and which of them stay (None: all)."""
    words = (text or b"").split()
    if not ranges:
        return words, None
    keep = np.ones(len(words), bool)
    for r in ranges:
        keep[r["first"] : r["last"]] = False
    return words, keep


def with_ranges(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, text, ranges) of every row; ranges is null where nothing goes."""
    found = repeated_ranges(docs, window, **how).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    return _texts(docs).join(materialize(found, "substring"), ["doc_id", "tie"], "left").select("doc_id", "text", "ranges")


def _kept(docs: DataFrame, window: int, name: str, of, how: dict) -> DataFrame:
    """(doc_id, n_words, n_removed, ``name``) where ``of`` makes the last of the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring")
        for b in sliced(batches):
            n, gone, out = [], [], []
            for text, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, keep = _apply(text, ranges)
                n.append(len(words))
                gone.append(0 if keep is None else len(words) - int(keep.sum()))
                out.append(of(b" ".join(words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return with_ranges(docs, window, **how).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the text that stays, its words joined by one space."""
    return _kept(docs, window, "kept", bytes.decode, how)


def substring_dedup(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``.

    A word goes if some window of ``window`` words over it also starts earlier: in
    a smaller doc_id, or before it in its own document.  All windows are
    those of the input.  Texts of fewer words, null and empty ones stay; a row
    without doc_id has no place in the order: it keeps its words and
    precedes none; rows that share a doc_id and a place are not earlier than one
    another; an empty table gives no rows; only doc_id and text are read.
    """
    return _kept(docs, window, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest(), how)
