"""Held-out test items found in training text.

The normalised word n-grams of the items become a broadcast hash set. Training
text is scanned as windows of word hashes, whole Arrow batches at once; a
window that is in the set proposes an item and an alignment, and the aligned
words are compared one by one. An item leaks if fifteen of its words stand in
a row, or if nearly all of its passage does, a few words replaced.

Words are compared without case, marks, punctuation, spacing and hyphenation
and with look-alike characters folded: hyphens and apostrophes within a word
are dropped, also where a hyphen and a line break divide it.

Scripts without spaces have one word per character there, which counts as a
half (Chinese, Japanese) or a quarter (Thai) of a word of a run.

Defined results: null and empty texts contain nothing; repeated items and
documents give one row each; an item shorter than fifteen words leaks only if
it is a passage that stands there whole, down to a passage of one word.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import codepoints as cp

#: Words of an item in a row that make a leak, and of a window of the hash set.
RUN, SEED = 15, 4
#: Share of a passage's words that must stand there if some were replaced (one in six), with room for the ends.
WHOLE = 0.8
#: A window that is in more items than this proposes none, unless a run or a passage with words replaced could be left without any.
COMMON_SEED = 20
#: Proposals worked on at once.
PROPOSALS = 1 << 22
#: Alignments that differ by so many words may be parts of one copy.
DRIFT = 12
#: Items and characters of items indexed at a time; more are scanned in further passes, so the broadcast stays bounded.
ITEMS_PER_PASS, CHARS_PER_PASS = 20_000, 1 << 25
#: Words that a character of a script without spaces stands for.
CJK_WORD, THAI_WORD = 0.5, 0.25
BATCH_CHARS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(0xC2B2AE3D27D4EB4F)
# Ligatures that stand for several letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss"}


@functools.cache
def _char_table() -> tuple[np.ndarray, np.ndarray]:
    """0 other, 1 part of a word, 2 nothing, 3 hyphen, 4 apostrophe, 5 space, 6 line break; and the letters folded."""
    kinds = cp.class_table()
    out = np.zeros(cp.LIMIT + 1, np.uint8)
    out[(kinds & (cp.LETTER | cp.DIGIT)) > 0] = 1
    out[(kinds & (cp.HIDDEN | cp.MARK)) > 0] = 2
    out[[0x2D, 0x2010, 0x2011, 0xFF0D]] = 3
    out[[0x27, 0x2019, 0x2018, 0xFF07, 0x02BC]] = 4
    out[(kinds & cp.SPACE) > 0] = 5
    out[[10, 13, 0x2028]] = 6
    return out, cp.fold_table().astype(np.uint64)


@functools.cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(64, _M, np.uint64))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first and last character and weight of every normalised word."""
    texts = [t or "" for t in texts]
    for a, b in LIGATURES.items():
        texts = [t.replace(a, b) if a in t else t for t in texts]
    codes, starts = cp.join_codes(texts)
    codes = cp.clip(codes)
    table, fold = _char_table()
    what = table[codes]
    what[starts[1:] - 1] = 0
    keep = np.flatnonzero(what != 2)
    what, codes = what[keep], codes[keep]
    n = len(codes)
    word = what == 1
    # Hyphens and apostrophes between letters vanish; so do a hyphen and the line break after it.
    joint = np.flatnonzero((what == 3) | (what == 4))
    joint = joint[(joint > 0) & (joint < n - 1)]
    joint = joint[word[joint - 1]]
    broken = what[joint] == 3
    after = joint + 1
    gap = (what == 5) | (what == 6)
    solid = np.append(np.flatnonzero(~gap), n - 1)
    beyond = np.minimum(solid[np.searchsorted(solid[:-1], after)], n - 1)
    breaks = np.concatenate([[0], np.cumsum(what == 6)])
    over_break = broken & (breaks[beyond] > breaks[after])
    beyond = np.where(over_break, beyond, after)
    follows = word[beyond]
    joint, beyond = joint[follows], beyond[follows]
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, joint, 1)
    np.add.at(depth, beyond, -1)
    drop = np.cumsum(depth[:-1]) > 0
    left = np.flatnonzero(~drop)
    word, codes, keep = word[left], codes[left], keep[left]
    kinds = cp.class_table()[codes]
    alone = word & ((kinds & (cp.CJK | cp.THAI)) > 0)
    inside = word & ~alone
    head = np.flatnonzero(alone | inside & ~np.concatenate([[False], inside[:-1]]))
    at = np.flatnonzero(word)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.float64)
    owner = np.searchsorted(head, at, "right") - 1
    place = np.minimum(at - head[owner], 63)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    h = np.add.reduceat((fold[codes[at]] + np.uint64(1)) * _powers()[place], first)
    last = at[np.concatenate([first[1:], [len(at)]]) - 1]
    doc = np.searchsorted(starts, keep[head], "right") - 1
    weight = np.where(alone[head], np.where((kinds[head] & cp.CJK) > 0, CJK_WORD, THAI_WORD), 1.0)
    return h, doc, keep[head] - starts[doc], keep[last] + 1 - starts[doc], weight


def windows(h: np.ndarray, size: int = SEED) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (h[k : k + n] >> np.uint64(7))) * _S + h[k : k + n]
    return out


class Index:
    """The items' words and the hash set of their windows."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        """``items`` has (item, part, text); the part 'passage' may also leak as a whole with words replaced."""
        self.item = [i for i, _, _ in items]
        self.whole = [part == "passage" for _, part, _ in items]
        self.words: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, text) in enumerate(items):
            h, _, _, _, weight = words([text])
            self.words.append(h)
            self.weights.append(np.concatenate([[0.0], np.cumsum(weight)]))
            if self.whole[k] and 0 < len(h) < SEED:
                self.short[len(h)][int(windows(h, len(h))[0])].append(k)
            for p, w in enumerate(windows(h).tolist()):
                postings[w].append((k, p))
        owners = {w: len({self.item[k] for k, _ in at}) for w, at in postings.items()}
        keep = {w for w, n in owners.items() if n <= COMMON_SEED}
        sound: list[bool] = []
        for k, h in enumerate(self.words):
            seeds = windows(h).tolist()
            need = RUN - SEED + 1
            for p in range(max(1, len(seeds) - need + 1)):
                run = seeds[p : p + need]
                if run and not any(w in keep for w in run):
                    keep.update(run)
            # Each word replaced takes at most SEED windows away: one must be left.
            if self.whole[k] and sum(w in keep for w in seeds) <= SEED * self._replaced(len(h)):
                keep.update(seeds)
        for h in self.words:
            sound.append(all(w in keep for w in windows(h).tolist()))
        # Hits that a leak has at least; where common windows are left out, one.
        least = [min(RUN - SEED + 1, self._replaced(len(h)) - SEED + 1 if self.whole[k] else RUN) if sound[k] else 1 for k, h in enumerate(self.words)]
        self.least = np.maximum(np.array(least, np.int64), 1)
        hashes = sorted(keep)
        self.hashes = np.array(hashes, np.uint64)
        self.offset = np.cumsum([0, *(len(postings[w]) for w in hashes)])
        flat = [x for w in hashes for x in postings[w]]
        self.part = np.array([k for k, _ in flat], np.int64)
        self.place = np.array([p for _, p in flat], np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _replaced(n: int) -> int:
        """Words of a passage of ``n`` that may be replaced."""
        return int((1 - WHOLE) * n + 1e-9)

    def _whole_short(self, h: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, float, int, int]]]:
        """Passages of fewer words than a window, where they stand whole."""
        for size, table in self.short.items():
            w = windows(h, size)
            keys = np.array(sorted(table), np.uint64)
            spot = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            for at in np.flatnonzero((keys[spot] == w) & (doc[: len(w)] == doc[size - 1 :])).tolist():
                for k in table[int(w[at])]:
                    yield (int(doc[at]), self.item[k]), (size, 1.0, int(begin[at]), int(end[at + size - 1]))

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, float, int, int]]:
        """(text, item, longest run, share of the part, span start, span end) of each leak."""
        h, doc, begin, end, _ = words(texts)
        best: dict[tuple[int, int], tuple[int, float, int, int]] = {}
        for at, row in self._whole_short(h, doc, begin, end):
            if at not in best or row > best[at]:
                best[at] = row
        w = windows(h)
        if len(w) and len(self.hashes):
            at = np.flatnonzero(self.bits[(w >> np.uint64(44)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.hashes, w[at]), len(self.hashes) - 1)
            hit = (self.hashes[spot] == w[at]) & (doc[at] == doc[at + SEED - 1])
            at, spot = at[hit], spot[hit]
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            # Texts by turns, so that windows common to many items cannot make too many proposals at once.
            per_text = np.bincount(doc[at], self.offset[spot + 1] - self.offset[spot], len(texts)).astype(np.int64)
            for a, b in cp.slices(per_text, PROPOSALS):
                lo, hi = np.searchsorted(doc[at], [a, b])
                self._verify(h, doc, begin, end, first, at[lo:hi], spot[lo:hi], best)
        return [(d, item, *row) for (d, item), row in best.items()]

    def _verify(self, h: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, at: np.ndarray, spot: np.ndarray, best: dict) -> None:
        """Puts the leaks among the proposals of these hits into ``best``."""
        if not len(at):
            return
        count = self.offset[spot + 1] - self.offset[spot]
        which = np.repeat(self.offset[spot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos = np.repeat(at, count)
        part, shift = self.part[which], pos - self.place[which]
        _, pair, hits = np.unique(doc[pos] * len(self.words) + part, return_inverse=True, return_counts=True)
        enough = hits[pair] >= self.least[part]
        pos, part, shift = pos[enough], part[enough], shift[enough]
        if not len(pos):
            return
        key = np.unique(np.stack([doc[pos], part, shift], 1), axis=0)
        head = np.flatnonzero(np.concatenate([[True], (key[1:, :2] != key[:-1, :2]).any(1), [True]]))
        for a, b in zip(head[:-1].tolist(), head[1:].tolist()):
            d, k = int(key[a, 0]), int(key[a, 1])
            mine, weight = self.words[k], self.weights[k]
            lo, hi = int(first[d]), int(first[d + 1])
            longest, span = 0.0, None
            covered: list[tuple[int, np.ndarray]] = []
            for shift_now in key[a:b, 2].tolist():
                i0, i1 = max(0, lo - shift_now), min(len(mine), hi - shift_now)
                same = np.zeros(len(mine), bool)
                same[i0:i1] = mine[i0:i1] == h[shift_now + i0 : shift_now + i1]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                if len(edge):
                    runs = weight[edge[1::2]] - weight[edge[::2]]
                    r = int(runs.argmax())
                    if runs[r] > longest:
                        longest, span = float(runs[r]), (shift_now + int(edge[2 * r]), shift_now + int(edge[2 * r + 1]) - 1)
                covered.append((shift_now, same))
            share, whole_span = 0.0, None
            if self.whole[k] and len(mine) >= SEED:
                for n, (s0, _) in enumerate(covered):
                    union = np.zeros(len(mine), bool)
                    for s1, same in covered[n:]:
                        if s1 - s0 <= DRIFT:
                            # Short chance matches beside the alignment do not count.
                            union |= same if s1 == s0 else _long_runs(same, SEED)
                    got = float(union.mean())
                    if got > share:
                        p = np.flatnonzero(union)
                        share, whole_span = got, (max(lo, s0 + int(p[0])), min(hi - 1, s0 + int(p[-1])))
            if longest >= RUN or share >= WHOLE:
                if longest < RUN or share >= WHOLE and whole_span:
                    span = whole_span
                item = self.item[k]
                row = (int(longest), share, int(begin[span[0]]), int(end[span[1]]))
                if row > best.get((d, item), (0, 0.0, 0, 0)):
                    best[d, item] = row


def _long_runs(same: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros(len(same), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            out[a:b] = True
    return out


_INDEXES: dict[str, Index] = {}


def _index(shared, slot: str) -> Index:
    """The index of one pass, built once in each worker."""
    if slot not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[slot] = Index(shared.value)
    return _INDEXES[slot]


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", parts: tuple[str, ...] = ("passage", "question")) -> DataFrame:
    """One row per document and leaked item: ``longest_run``, ``share`` and the span of characters.

    Narrow over the documents: the items alone are broadcast, in passes of
    ITEMS_PER_PASS. Nothing of the corpus is shuffled.
    """
    spark = df.sparkSession
    distinct = items.select(item_col, *parts).distinct()
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.concat_ws("", *parts))), F.lit(0)).alias("chars")).first()
    passes = max(math.ceil(size["n"] / ITEMS_PER_PASS), math.ceil(size["chars"] / CHARS_PER_PASS))
    source = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    id_type, item_type = source.dtypes[0][1], distinct.dtypes[0][1]
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, longest_run int, share double, span_start int, span_end int"
    out = spark.createDataFrame([], schema)
    for k in range(passes):
        rows = distinct.where(F.pmod(F.xxhash64(item_col, *parts), F.lit(passes)) == k).collect()
        listed = [(r[0], part, r[part]) for r in rows for part in parts if r[part]]
        shared = spark.sparkContext.broadcast(listed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, slot=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(shared, slot)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = []
                for a, b in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
                    found += [(d + a, *rest) for d, *rest in index.scan(texts[a:b])]
                if found:
                    d, item, run_len, share, s0, s1 = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(item), pa.array(run_len, pa.int32()), pa.array(share, pa.float64()), pa.array(s0, pa.int32()), pa.array(s1, pa.int32())], names=[id_col, item_col, "longest_run", "share", "span_start", "span_end"])

        part = source.mapInArrow(run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def remove_leaks(df: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with leaked spans cut out of their text, all other columns as they are.

    The spans of one document are as many as items leaked into it, a bounded
    list; documents without leaks pass through the outer join unchanged.
    """
    spans = leaks.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias("__spans"))
    joined = df.join(spans, F.col(id_col) == F.col("__id"), "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.struct(
            F.when(s["span_start"] > acc["at"], F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, s["span_start"] - acc["at"]))).otherwise(acc["text"]).alias("text"),
            F.greatest(acc["at"], s["span_end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col)))),
    )
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut)).drop("__id", "__spans")
