"""Percentiles per group from randomized compactor hierarchies (problem 3).

A sketch keeps levels of values; a value on level h stands for 2**h rows. A full level is sorted and every other value, from a random
first or second one, moves up. Sketches of different partitions, days or parts of the log merge level by level.

Each compaction of level h shifts any rank by 0 or by plus or minus 2**h with equal odds, so `var`, the sum of 4**h over all compactions,
bounds the variance of a rank, and `worst`, the sum of 2**h, bounds its error outright. A rank is off by more than
min(worst, sqrt(2 ln(2/delta) var)) with a probability of at most delta.

The q-th percentile is the least value that at least q % of the values do not exceed. Null values are left out; null group keys are a
group; a group without values gives no row. Order, ties and repeated values need no care. The random bits come from the seed and the
group, so a task that runs again gives the same sketch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    """k: values on the top level; shrink: ratio of the next lower level's capacity; delta: the odds of a wider error;
    fan: parts a group is built in before they are merged."""

    k: int = 800
    shrink: float = 2 / 3
    least: int = 8
    delta: float = 1e-9
    fan: int = 32
    seed: int = 7


STATE = ["sk_n", "sk_worst", "sk_var", "sk_low", "sk_high", "sk_sizes", "sk_held"]


class Sketch:
    __slots__ = ("high", "levels", "low", "n", "rng", "spec", "var", "worst")

    def __init__(self, spec: Spec, key: tuple = ()) -> None:
        self.spec, self.n, self.worst, self.var = spec, 0, 0, 0.0
        self.low, self.high, self.levels = None, None, [np.zeros(0)]
        self.rng = np.random.default_rng([spec.seed, zlib.crc32(repr(key).encode())])

    def _capacity(self, h: int) -> int:
        return max(self.spec.least, math.ceil(self.spec.k * self.spec.shrink ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self._edge(values.min(), values.max())
        self.levels[0] = np.concatenate([self.levels[0].astype(values.dtype), values])
        self._compress()

    def merge(self, n: int, worst: int, var: float, low, high, levels: Sequence[np.ndarray]) -> None:
        self.n, self.worst, self.var = self.n + n, self.worst + worst, self.var + var
        self._edge(low, high)
        while len(self.levels) < len(levels):
            self.levels.append(np.zeros(0))
        for h, x in enumerate(levels):
            self.levels[h] = np.concatenate([self.levels[h].astype(x.dtype), x])
        self._compress()

    def _edge(self, low, high) -> None:
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)

    def _compress(self) -> None:
        while sum(map(len, self.levels)) > sum(map(self._capacity, range(len(self.levels)))):
            h = next(h for h, x in enumerate(self.levels) if len(x) > self._capacity(h))
            if h + 1 == len(self.levels):
                self.levels.append(np.zeros(0, self.levels[h].dtype))
            x = np.sort(self.levels[h])
            even = len(x) & ~1
            up = x[:even][int(self.rng.integers(2)) :: 2]
            self.levels[h] = x[even:]
            self.levels[h + 1] = np.concatenate([self.levels[h + 1].astype(x.dtype), up])
            self.worst += 1 << h
            self.var += 4.0**h

    def state(self) -> tuple:
        return self.n, self.worst, self.var, self.low, self.high, [len(x) for x in self.levels], np.concatenate(self.levels)


def bound(n: int, worst: int, var: float, delta: float) -> float:
    """The rank error not exceeded but with probability delta."""
    return min(float(worst), math.sqrt(2 * math.log(2 / delta) * var), float(n))


def quantiles(sizes: Sequence[int], held: np.ndarray, n: int, low, high, err: float, qs: Sequence[float]) -> list[tuple]:
    """(estimate, least, greatest) of each q: the true value is >= least and <= greatest unless the error bound fails."""
    weight = np.repeat(1 << np.arange(len(sizes), dtype=np.int64), sizes)
    order = np.argsort(held, kind="stable")
    v, w = held[order], np.cumsum(weight[order])
    out = []
    for q in qs:
        r = max(1, math.ceil(round(q * n, 6)))
        at = min(int(np.searchsorted(w, r, "left")), len(v) - 1)
        under = int(np.searchsorted(w, r - err, "left")) - 1
        over = int(np.searchsorted(w, r + err, "left"))
        out.append((v[at], v[under] if under >= 0 else low, v[over] if over < len(v) else high))
    return out


def _runs(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Starts of the stretches of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for i in range(keys):
        code = pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _emit(rows: list[tuple], schema: pa.Schema, keys: int) -> pa.RecordBatch:
    cols = [pa.array([r[0][i] for r in rows], schema.field(i).type) for i in range(keys)]
    st = [r[1] for r in rows]
    cols += [pa.array([s[j] for s in st], schema.field(keys + j).type) for j in range(6)]
    off = np.r_[0, np.cumsum([len(s[6]) for s in st])].astype(np.int32)
    vt = schema.field("sk_held").type.value_type
    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([s[6] for s in st])).cast(vt)))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    fix = lambda t: pa.list_(t.value_type) if pa.types.is_list(t) else t
    return pa.schema([pa.field(f.name, fix(f.type)) for f in s])


def _stream(spec: Spec, keys: int, schema: T.StructType, merging: bool):
    """Over rows sorted by key: one open sketch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        key, open_, done, held = None, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _runs(batch, keys)
            ends = np.r_[cut[1:], batch.num_rows]
            if merging:
                part = {c: batch.column(keys + j) for j, c in enumerate(STATE)}
                num = {c: part[c].to_numpy(zero_copy_only=False) for c in STATE[:5]}
                lens = part["sk_sizes"].to_pylist()
                flat = part["sk_held"].flatten().to_numpy(zero_copy_only=False)
                off = np.r_[0, np.cumsum(part["sk_held"].value_lengths().to_numpy(zero_copy_only=False))]
            else:
                values = batch.column(keys).to_numpy(zero_copy_only=False)
            heads = [tuple(c) for c in zip(*[batch.column(i).take(pa.array(cut)).to_pylist() for i in range(keys)])] if keys else [()]
            for now, s, e in zip(heads, cut, ends):
                if open_ is None or now != key:
                    if open_ is not None:
                        done.append((key, open_.state()))
                        held += len(done[-1][1][6])
                    key, open_ = now, Sketch(spec, now)
                if merging:
                    for i in range(s, e):
                        lev = np.split(flat[off[i] : off[i + 1]], np.cumsum(lens[i])[:-1])
                        open_.merge(*(int(num[c][i]) for c in STATE[:2]), float(num["sk_var"][i]), num["sk_low"][i], num["sk_high"][i], lev)
                else:
                    open_.add(values[s:e])
            if held > 1_000_000 or len(done) > 5000:
                yield _emit(done, arrow, keys)
                done, held = [], 0
        if open_ is not None:
            done.append((key, open_.state()))
        if done:
            yield _emit(done, arrow, keys)

    return run


def sketch(df: DataFrame, keys: Sequence[str], value: str, spec: Spec = Spec(), row_id: str | None = None) -> DataFrame:
    """keys and the state of one sketch per group. With row_id, rows that repeat an id (full copies) count once.

    One shuffle by group and salt brings copies of a row together, spreads a hot group over `fan` parts and sorts them, so each task
    reads one group after the other; only sketches travel from there on.
    """
    kind = df.schema[value].dataType
    vt = T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
    base = df.select(*keys, F.col(value).cast(vt).alias("__v"), (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("__id")).filter("__v IS NOT NULL")
    if vt == T.DoubleType():
        base = base.filter(~F.isnan("__v"))
    base = base.withColumn("__s", F.pmod(F.xxhash64("__id"), F.lit(spec.fan)).cast("int"))
    base = base.repartition(*keys, "__s")
    if row_id:
        base = base.distinct()
    rows = base.sortWithinPartitions(*keys, "__s").select(*keys, "__s", "__v")
    state = list(zip(STATE, (T.LongType(), T.LongType(), T.DoubleType(), vt, vt, T.ArrayType(T.IntegerType()), T.ArrayType(vt))))
    keyed = [T.StructField(k, df.schema[k].dataType) for k in keys]
    out = T.StructType([*keyed, T.StructField("__s", T.IntegerType()), *[T.StructField(a, b) for a, b in state]])
    parts = rows.mapInArrow(_stream(spec, len(keys) + 1, out, False), out)
    return merge(parts.drop("__s"), keys, spec)


def merge(sketches: DataFrame, keys: Sequence[str], spec: Spec = Spec()) -> DataFrame:
    """The sketches of one or several frames, unioned by the caller, added up per keys."""
    out = T.StructType([*[sketches.schema[k] for k in keys], *[sketches.schema[c] for c in STATE]])
    src = sketches.select(*keys, *STATE)
    src = src.repartition(*keys) if keys else src.coalesce(1)
    # by size first: the merged sketch doesn't depend on the order in which parts arrive
    return src.sortWithinPartitions(*keys, F.desc("sk_n"), "sk_low", "sk_high", F.hash("sk_held")).mapInArrow(_stream(spec, len(keys), out, True), out)


def answers(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float], spec: Spec = Spec()) -> DataFrame:
    """keys, n (n_ if a key has that name), rank_error (share of n) and, per q, pQ, pQ_least and pQ_greatest."""
    count = "n_" if "n" in keys else "n"
    vt = sketches.schema["sk_low"].dataType
    names = [f"p{100 * q:g}".replace(".", "_") for q in qs]
    cols = [c for x in names for c in (x, f"{x}_least", f"{x}_greatest")]
    res = T.StructType([T.StructField("rank_error", T.DoubleType()), *[T.StructField(c, vt) for c in cols]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, k = [], len(keys)
            n, worst, var, low, high = (b.column(k + j).to_numpy(zero_copy_only=False) for j in range(5))
            sizes, held = b.column(k + 5).to_pylist(), b.column(k + 6)
            for i in range(b.num_rows):
                err = bound(int(n[i]), int(worst[i]), float(var[i]), spec.delta)
                got = quantiles(sizes[i], held[i].values.to_numpy(zero_copy_only=False), int(n[i]), low[i], high[i], err, qs)
                rows.append((err / n[i], *[x for g in got for x in g]))
            cols_ = [b.column(i) for i in range(k + 1)] + [pa.array([r[j] for r in rows]) for j in range(len(res))]
            yield pa.RecordBatch.from_arrays(cols_, [*keys, count, *res.names])

    out = T.StructType([*[sketches.schema[k] for k in keys], T.StructField(count, T.LongType()), *res.fields])
    return sketches.select(*keys, *STATE).mapInArrow(run, out)


def exact(df: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """keys, side and `exact`: the true percentile of each group and side of brackets (keys, side, least, greatest, n, q), by counting.

    Only rows of these groups up to the upper end of a bracket go on; copies of a row count once. Those below a bracket are only counted,
    those inside are counted by value before they meet in their group. A group whose bracket doesn't hold the percentile gives no row.
    """
    b = brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "side", "least", "greatest", F.ceil(F.round(F.col("n") * F.col("q"), 6)).alias("need"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.col(row_id).alias("__id"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    held = rows.join(b, [*same, F.col("__v") <= F.col("greatest")]).select(*keys, "side", "need", "__id", F.greatest("__v", "least").alias("v")).distinct()
    # values below the bracket have become its lower end, of which only the count matters
    counted = held.groupBy(*keys, "side", "need", "v").agg(F.count("*").alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "side").orderBy("v")))
    return upto.filter("upto >= need").groupBy(*keys, "side").agg(F.min("v").alias("exact"))


def wide_groups(df: DataFrame, keys: Sequence[str], value: str, row_id: str, low: float, high: float, times: int, spec: Spec = Spec()) -> DataFrame:
    """keys of the groups whose high percentile is at least `times` the low one.

    The sketch decides wherever its brackets allow; only groups whose brackets straddle the limit are counted exactly.
    """
    from pressloom.session import settle

    a, b = (f"p{100 * q:g}".replace(".", "_") for q in (low, high))
    ans = settle(answers(sketch(df, keys, value, spec, row_id), keys, (low, high), spec), "percentiles")
    sure: Column = F.col(f"{b}_least") >= times * F.col(f"{a}_greatest")
    never: Column = F.col(f"{b}_greatest") < times * F.col(f"{a}_least")
    yes, open_ = ans.filter(sure).select(*keys), ans.filter(~sure & ~never)
    side = lambda name, x, q: open_.select(*keys, F.lit(name).alias("side"), F.col(f"{x}_least").alias("least"), F.col(f"{x}_greatest").alias("greatest"), "n", F.lit(q).alias("q"))
    got = exact(df, side("low", a, low).unionByName(side("high", b, high)), keys, value, row_id)
    both = got.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == x, F.col("exact"))).alias(f"__{x}") for x in ("low", "high")])
    return yes.unionByName(both.filter(F.col("__high") >= times * F.col("__low")).select(*keys))
