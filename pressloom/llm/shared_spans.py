"""Long word-for-word spans shared between records, by FM-indexes over shards (problem 2).

A word is shared if it lies in a run of `run` words that also occurs in a record with another id.

Shards by content: the key of a run is the least hash of its `gram`-word pieces (its minimizer), so equal runs always have the same
key, and neighbouring runs mostly share one. A record is cut into segments, stretches of consecutive runs with one key, and a segment
only goes to the shard of its key. All runs that could match meet there, and the work grows with the text, not with its square.

Before that, keys held by a single record are dropped (they can't match). Of equal segments two stay, those of the least and of the
greatest id: what any two records share, these show, so a passage copied into a third of all records is indexed twice, and streamed once.
A key with very many different segments is split: each of its runs becomes a unit of its own, keyed by all its words, again with two
copies at most; the index decides on these units as on all others.

In each shard the units are joined into one text over a dense word alphabet. Its index is the Burrows-Wheeler transform as a wavelet
matrix of packed bits with rank counts, and one more bit for each suffix, set where its record is another one than that of the suffix
before: an interval of suffixes spans two records if such a bit lies inside. Suffix array and owners are dropped once the bits are set.
The different units of all records are then streamed through the index: backward search from each word, in lockstep, gives the matching
statistic of each position, the length of the longest stretch ending there that two records hold. Stretches of at least `run` words are
reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm import flat
from pressloom.session import settle


@dataclass(frozen=True)
class Spec:
    """run: words of the shortest span; gram: words of a minimizer; shard_words: words in a shard;
    hot: segments of one key beyond which it is split into single runs. Only run changes the result."""

    run: int = 20
    gram: int = 8
    shard_words: int = 400_000
    hot: int = 20_000
    longest: int = 64


SEGMENT = "key long, id long, at int, runs int, s1 long, s2 long"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in a row, and the index of the first word of each text."""
    b, off = flat.raw(texts)
    start, end, first = flat.words_between(b, off)
    return flat.span_hash(b + np.uint64(1), start, end), first


def cut(w: np.ndarray, first: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(text, at, runs, key) of each segment; at and text are indexes of words and texts."""
    n, L, m = len(w), spec.run, spec.gram
    if n < L:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    i = np.arange(n - m + 1)
    g = flat.span_hash(w, i, i + m)
    k = n - L + 1
    key = g[:k].copy()
    for j in range(1, L - m + 1):
        np.minimum(key, g[j : j + k], out=key)
    text = np.searchsorted(first, np.arange(k), "right") - 1
    ok = np.arange(k) + L <= first[text + 1]
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]] & ok
    head = np.flatnonzero(new)
    if not len(head):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    # segments of more than `longest` runs (a repeated phrase) are cut on
    idx = np.flatnonzero(ok)
    since = idx - head[np.searchsorted(head, idx, "right") - 1]
    head = idx[since % spec.longest == 0]
    runs = np.bincount(np.searchsorted(head, idx, "right") - 1, minlength=len(head))
    return text[head], head, runs, key[head]


def _segments(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, texts in flat.text_pieces(batch.column(1)):
                w, first = word_hashes(texts)
                text, at, runs, key = cut(w, first, spec)
                s1, s2 = (flat.span_hash(w, at, at + runs + spec.run - 1, x) for x in (flat.BASE, flat.BASE2))
                cols = [key.view(np.int64), ids[a + text], (at - first[text]).astype(np.int32), runs.astype(np.int32), s1.view(np.int64), s2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "at", "runs", "s1", "s2"])

    return run


def _units(spec: Spec):
    """From texts with the segments to take out of them: the words of each segment, or of each of its runs where the key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        L = spec.run
        for batch in batches:
            take = batch.column(1)
            n = take.value_lengths().to_numpy(zero_copy_only=False)
            flatrows = take.flatten()
            part = {f: flatrows.field(f).to_numpy(zero_copy_only=False) for f in ("at", "runs", "s1", "s2", "key", "lo", "hi", "hot")}
            ends = np.cumsum(n)
            for a, z, texts in flat.text_pieces(batch.column(0)):
                w, first = word_hashes(texts)
                s, e = (ends[a] - n[a]), ends[z - 1]
                p = {f: v[s:e] for f, v in part.items()}
                if not len(p["at"]):
                    continue
                where = first[np.repeat(np.arange(z - a), n[a:z])] + p["at"]
                limit = first[np.repeat(np.arange(z - a), n[a:z]) + 1]
                real = where + p["runs"] + L - 1 <= limit
                real[real] = flat.span_hash(w, where[real], (where + p["runs"] + L - 1)[real]).view(np.int64) == p["s1"][real]
                whole, split = np.flatnonzero(real & (p["hot"] == 0)), np.flatnonzero(real & (p["hot"] == 1))
                r = np.repeat(split, p["runs"][split])
                off = np.arange(len(r)) - np.repeat(np.cumsum(p["runs"][split]) - p["runs"][split], p["runs"][split])
                begin = np.r_[where[whole], where[r] + off]
                size = np.r_[p["runs"][whole] + L - 1, np.full(len(r), L)]
                if not len(begin):
                    continue
                src = np.r_[whole, r]
                hot = np.r_[np.zeros(len(whole), bool), np.ones(len(r), bool)]
                u1 = np.where(hot, flat.span_hash(w, begin, begin + size).view(np.int64), p["s1"][src])
                u2 = np.where(hot, flat.span_hash(w, begin, begin + size, flat.BASE2).view(np.int64), p["s2"][src])
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
                words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(w[pos].view(np.int64)))
                cols = [pa.array(c) for c in (np.where(hot, u1, p["key"][src]), u1, u2, p["lo"][src], p["hi"][src], p["s1"][src], p["s2"][src], np.r_[np.zeros(len(whole), np.int32), off.astype(np.int32)], hot.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, words], UNIT_NAMES)

    return run


UNIT = "key long, u1 long, u2 long, lo long, hi long, s1 long, s2 long, off int, hot int, words array<long>"
UNIT_NAMES = [x.split()[0] for x in UNIT.split(", ")]


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bit: np.ndarray) -> None:
        self.packed = np.packbits(np.r_[bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.packed).astype(np.int32))].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.packed[word] & low)


class FMIndex:
    """Backward search over a wavelet matrix of the Burrows-Wheeler transform, and whether the suffixes of an interval have several owners.

    text holds symbols from 1 on, with 0 after each unit; owner is a number for each place. Suffixes are sorted by their first `depth`
    symbols, so intervals of patterns shorter than that are exact.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int) -> None:
        n = len(text)
        rank, k, classes = text.astype(np.int64), 1, 0
        ends = np.flatnonzero(text == 0)
        last = np.repeat(ends, np.diff(np.r_[-1, ends])) if len(ends) else np.zeros(0, np.int64)
        last = np.r_[last, np.full(n - len(last), n)]
        while k < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            # what lies beyond the end of a unit doesn't count
            after[np.arange(n) + k > last] = 0
            seen, finer = np.unique(rank * (max(n, int(rank.max(initial=0))) + 2) + after, return_inverse=True)
            if k > 1 and len(seen) == classes:
                break
            rank, classes, k = finer, len(seen), 2 * k
        sa = np.argsort(rank, kind="stable")
        sigma = int(text.max(initial=0)) + 1
        self.count = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        own = owner[sa]
        self.change = Bits(np.r_[False, own[1:] != own[:-1]] if n else np.zeros(0, bool))
        self.levels: list[tuple[Bits, int]] = []
        cur = text[sa - 1]
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.levels.append((Bits(bit), int(n - bit.sum())))
            cur = np.r_[cur[bit == 0], cur[bit == 1]]
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bits, zeros), level in zip(self.levels, range(self.bits - 1, -1, -1)):
            r = bits.rank(i)
            i = np.where((c >> level) & 1, zeros + r, i - r)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c + pattern from the intervals of pattern."""
        base = self.count[c] - self.start[c]
        return base + self._walk(c, lo), base + self._walk(c, hi)

    def several(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the suffixes of each interval belong to more than one owner."""
        return (hi - lo > 1) & (self.change.rank(hi) > self.change.rank(np.minimum(lo + 1, hi)))


def matching(fm: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place end, the length of the longest text[x:end + 1], x >= begin, that several owners hold."""
    out = np.zeros(len(end), np.int64)
    live = np.arange(len(end))
    c = text[end]
    a, b = fm.count[c], fm.count[c + 1]
    length = 0
    while len(live):
        good = fm.several(a, b)
        live, a, b = live[good], a[good], b[good]
        length += 1
        out[live] = length
        more = end[live] - length >= begin[live]
        live, a, b = live[more], a[more], b[more]
        if len(live):
            a, b = fm.extend(text[end[live] - length], a, b)
    return out


def shared_stretches(words: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, end) of the stretches of at least `run` words that occur under two ids.

    words: those of all units in a row; each unit is held by the ids lo and hi, which may be one.
    """
    m = len(size)
    _, dense = np.unique(words, return_inverse=True)
    first = np.cumsum(size) - size
    # the index holds a unit once for each of its two ids
    twice = np.flatnonzero(lo < hi)
    unit = np.r_[np.arange(m), twice]
    n = size[unit]
    begin = np.cumsum(n + 1) - n - 1
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.zeros(int(n.sum()) + len(unit), np.int64)
    text[np.repeat(begin, n) + place] = dense[np.repeat(first[unit], n) + place] + 1
    owner = np.repeat(np.unique(np.r_[lo, hi[twice]], return_inverse=True)[1], n + 1)
    fm = FMIndex(text, owner, int(size.max(initial=1)) + 1)
    # units shared as a whole show from their last word; of the others, all words at which a stretch of that length can end
    last = begin[:m] + size - 1
    all_ = np.flatnonzero(matching(fm, text, begin[:m], last) == size)
    rest = np.setdiff1d(np.arange(m), all_, assume_unique=True)
    per = (size - run + 1)[rest]
    which = np.repeat(rest, per)
    end = begin[which] + run - 1 + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    ms = matching(fm, text, begin[which], end)
    long = np.flatnonzero(ms >= run)
    # those that go on to the right are part of the next
    goes_on = np.zeros(len(ms), bool)
    goes_on[:-1] = (which[1:] == which[:-1]) & (ms[1:] == ms[:-1] + 1)
    keep = long[~goes_on[long]]
    u = which[keep]
    z = end[keep] - begin[u] + 1
    return np.r_[all_, u], np.r_[np.zeros(len(all_), np.int64), z - ms[keep]], np.r_[size[all_], z]


def _search(run: int):
    def go(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        lists = t.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        u, a, z = shared_stretches(lists.flatten().to_numpy(), size, col("lo"), col("hi"), run)
        return pa.table({"u1": col("u1")[u], "u2": col("u2")[u], "a": a.astype(np.int32), "z": z.astype(np.int32)})

    return go


def spans_of(df: DataFrame, id_col: str, text_col: str, spec: Spec = Spec()) -> DataFrame:
    """id, start_word, end_word: each longest unbroken stretch of shared words.

    Repeated rows count once; null and short texts share nothing; a null id is left out; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    parts = settle(docs.mapInArrow(_segments(spec), SEGMENT), "segments")
    keys = parts.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("key")
    held = parts.join(keys, "key", "left_semi")
    once = held.groupBy("s1", "s2", "key", "runs").agg(F.min(F.struct("id", "at")).alias("r"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    once = settle(once.select("s1", "s2", "key", "runs", "r.id", "r.at", "lo", "hi"), "collapsed")
    hot = once.groupBy("key").count().filter(F.col("count") > spec.hot).select("key", F.lit(1).alias("hot"))
    todo = once.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    todo = todo.groupBy("id").agg(F.collect_list(F.struct("at", "runs", "s1", "s2", "key", "lo", "hi", "hot")).alias("take"))
    units = docs.join(todo, "id").select("text", "take").mapInArrow(_units(spec), UNIT)
    units = settle(units, "units")
    # equal runs of split keys, and segments met again in repeated rows, become one unit
    one = units.groupBy("key", "u1", "u2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("words").alias("words"))
    total = once.agg(F.sum(F.col("runs") + spec.run - 1)).first()[0] or 0
    shards = max(1, -(-total // spec.shard_words))
    found = one.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_search(spec.run), "u1 long, u2 long, a int, z int")
    links = units.select("u1", "u2", "s1", "s2", "off").distinct()
    shared = found.join(links, ["u1", "u2"]).select("s1", "s2", (F.col("a") + F.col("off")).alias("a"), (F.col("z") + F.col("off")).alias("z"))
    lies = held.select("id", "at", "s1", "s2").join(shared, ["s1", "s2"])
    lies = lies.select("id", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("z")).alias("e"))
    by = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = lies.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("isle", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy("id", "isle").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select("id", "start_word", "end_word")


def shares_of(df: DataFrame, id_col: str, text_col: str, spec: Spec = Spec()) -> DataFrame:
    """One row per id: words, spans, shared_words, shared_share (0 for an empty text)."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \n]"), lambda x: x != ""))
    all_ids = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(words).alias("words"))
    got = spans_of(df, id_col, text_col, spec).groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.col("end_word") - F.col("start_word")).alias("shared_words"))
    out = all_ids.join(got, "id", "left").na.fill(0, ["spans", "shared_words"])
    return out.withColumn("shared_share", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).otherwise(F.lit(0.0)))
