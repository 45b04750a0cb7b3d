"""Containers of fixed capacity filled with documents by patterns of lengths (problem 6).

The plan is made on the histogram of lengths alone, which has at most `capacity` entries whatever the number of documents:

1. Patterns of few lengths that fill a container exactly are enumerated.
2. Non-negative least squares fits how often each pattern is used, so that together they use up the histogram.
3. The counts are rounded to whole containers that the histogram can supply.
4. Lengths left over are packed longest first, each container taking the longest length that still fits; a container found is
   repeated as often as the histogram allows.

Every document gets its rank among the documents of its length, without a single task per length, and the plan turns length and
rank into a container by arithmetic. A document larger than a container is cut: full containers first, the rest is packed as an item.

Documents of 0 tokens are spread over the containers. Null ids are left out. An empty table needs no container.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.sizes import running


@dataclass(frozen=True)
class Spec:
    """rounds: steps of the fit."""

    rounds: int = 300
    salts: int = 64


@dataclass
class Plan:
    """Slots sorted by (length, start): ranks [start, next start) of a length go to container base + (rank - start) // times."""

    containers: int = 0
    length: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)


def enumerate_patterns(present: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), both with three columns: all patterns of present lengths whose sum is the capacity; length 0 means none.

    Singles, pairs, triples and repeats of one length filled up by another: at most capacity**2 / 12 triples (5.6 million for 8192,
    160 MB), whatever the number of documents.
    """
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    ls, ts = [], []

    def put(a, b, c, i, j, k):
        ls.append(np.column_stack([a, b, c]).astype(np.int32))
        ts.append(np.column_stack([i, j, k]).astype(np.int16 if capacity < 1 << 15 else np.int32))

    one = lambda x: np.ones(len(x), np.int64)
    for i in range(1, capacity // max(1, int(present.min(initial=capacity))) + 1):
        a = present[present * i <= capacity]
        rest = capacity - a * i
        a, rest = a[has[rest] & (rest != a) | (rest == 0)], rest[has[rest] & (rest != a) | (rest == 0)]
        put(a, rest, 0 * a, i * one(a), 1 * (rest > 0), 0 * a)
    for a in present.tolist():
        b = present[np.searchsorted(present, a, "right") :]
        b = b[: np.searchsorted(b, (capacity - a + 1) // 2)]
        c = capacity - a - b
        ok = has[c]
        b, c = b[ok], c[ok]
        put(np.full(len(b), a), b, c, one(b), one(b), one(b))
    return np.concatenate(ls), np.concatenate(ts)


def fit(lengths: np.ndarray, times: np.ndarray, histogram: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimizes the squared distance of the used lengths from the histogram, by multiplicative steps."""
    n = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    blocks = [slice(i, i + (1 << 18)) for i in range(0, len(lengths), 1 << 18)]
    x = np.full(len(lengths), h.sum() / max(1.0, float(times.sum(dtype=np.int64))))

    def up(r: np.ndarray, at: slice) -> np.ndarray:
        return (times[at] * r[lengths[at]]).sum(1)

    goal = np.concatenate([up(h, at) for at in blocks]) if blocks else x
    for _ in range(rounds):
        used = np.zeros(n)
        for at in blocks:
            used += np.bincount(lengths[at].ravel(), (times[at] * x[at, None]).ravel(), n)
        used[0] = 0
        for at in blocks:
            x[at] *= goal[at] / np.maximum(up(used, at), 1e-12)
    return x


def make_plan(histogram: np.ndarray, capacity: int, spec: Spec = Spec()) -> Plan:
    """histogram[l]: items of length l, 1 <= l <= capacity."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros(len(left), np.int64)
    plan = Plan()

    def use(parts: dict[int, int], repeat: int) -> None:
        for length, m in parts.items():
            plan.length.append(length)
            plan.start.append(int(taken[length]))
            plan.times.append(m)
            plan.base.append(plan.containers)
            taken[length] += m * repeat
            left[length] -= m * repeat
        plan.containers += repeat

    present = np.flatnonzero(left)
    if len(present):
        lengths, times = enumerate_patterns(present, capacity)
        if len(lengths):
            x = fit(lengths, times, left, spec.rounds)
            for i in np.argsort(-x, kind="stable"):
                want = int(np.floor(x[i] + 0.5))
                if not want:
                    break
                parts = {int(a): int(m) for a, m in zip(lengths[i], times[i]) if m}
                can = min(want, *(int(left[a]) // m for a, m in parts.items()))
                if can:
                    use(parts, can)
    # longest first; below[l] leads to the longest length <= l that is left
    below = np.arange(capacity + 1)

    def longest(most: int) -> int:
        root = most
        while root and not left_now[root]:
            root = below[root - 1] if below[root] == root else below[root]
        while most > root:
            most, below[most] = (below[most] if below[most] != most else most - 1), root
        return int(root)

    left_now = left
    while top := longest(capacity):
        parts, room = {}, capacity
        length = top
        while length:
            m = min(int(left[length]) - parts.get(length, 0), room // length)
            if m:
                parts[length] = parts.get(length, 0) + m
                room -= m * length
            length = longest(min(room, length - 1)) if room and length > 1 else 0
        use(parts, min(int(left[a]) // m for a, m in parts.items()))
    return plan


def _place(plans: dict[str, tuple[np.ndarray, ...]]):
    """Rows (pack, len, rank, ...) to the same with their container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            pack = np.asarray(b.column(names.index("pack_name")).to_pylist(), object)
            length, rank = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("len", "rank"))
            where = np.zeros(b.num_rows, np.int64)
            for name, (containers, first, start, times, base) in plans.items():
                mine = pack == name
                ln, rk = length[mine], rank[mine]
                # within a length, the last slot whose start is not beyond the rank
                lo, hi = first[ln], first[ln + 1] - 1
                while (lo < hi).any():
                    mid = (lo + hi + 1) >> 1
                    ok = start[np.minimum(mid, max(0, len(start) - 1))] <= rk
                    lo, hi = np.where(ok & (lo < hi), mid, lo), np.where(~ok & (lo < hi), mid - 1, hi)
                full = ln > 0
                at = np.minimum(lo, max(0, len(start) - 1))
                where[mine] = np.where(full, base[at] + (rk - start[at]) // times[at], rk % max(1, containers)) if len(start) else rk % max(1, containers)
            yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in ("pack_name", "doc_id", "piece", "start_token", "len")] + [pa.array(where)], ["pack_name", "doc_id", "piece", "start_token", "tokens", "container"])

    return run


def pack(docs: DataFrame, packs: dict[str, int], spec: Spec = Spec()) -> DataFrame:
    """docs: doc_id, n. One row per document or piece and pack: pack_name, container, doc_id, piece, start_token, tokens."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).cast("long").alias("n"))
    schema = "pack_name string, doc_id long, piece int, start_token long, tokens long, container long"
    if not packs:
        return spark.createDataFrame([], schema)
    kinds = F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(c).cast("long").alias("cap")) for k, c in packs.items()])
    sized = docs.withColumn("p", F.explode(kinds)).select("doc_id", "n", "p.*")
    sized = sized.withColumn("full", F.when(F.col("n") > F.col("cap"), F.floor(F.col("n") / F.col("cap"))).otherwise(0).cast("long"))
    sized = sized.withColumn("len", F.col("n") - F.col("full") * F.col("cap"))
    items = sized.filter("len > 0 OR n = 0").withColumn("one", F.lit(1))
    # at most one row per pack and length up to its capacity
    counts = items.groupBy("pack_name", "len").count().collect()
    plans, after = {}, {}
    for name, cap in packs.items():
        h = np.zeros(cap + 1, np.int64)
        for r in counts:
            if r["pack_name"] == name:
                h[r["len"]] = r["count"]
        plan = make_plan(h, cap, spec)
        order = np.lexsort((plan.start, plan.length))
        a = [np.asarray(x, np.int64)[order] for x in (plan.length, plan.start, plan.times, plan.base)]
        plans[name] = (plan.containers, np.searchsorted(a[0], np.arange(cap + 2)), a[1], a[2], a[3])
        after[name] = plan.containers
    ranked = running(items, ["pack_name", "len"], "len", "doc_id", "one", "rank", spec.salts)
    ranked = ranked.select("pack_name", "doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("cap")).alias("start_token"), "len", F.col("rank").cast("long").alias("rank"))
    placed = ranked.mapInArrow(_place(plans), schema)
    big = running(sized.filter("full > 0").withColumn("band", F.pmod(F.xxhash64("doc_id"), F.lit(1024))), ["pack_name"], "band", "doc_id", "full", "before", spec.salts)
    first = F.create_map(*[x for k, v in after.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("pack_name")]
    cut = big.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    cut = cut.select("pack_name", "doc_id", F.col("i").cast("int").alias("piece"), (F.col("i") * F.col("cap")).alias("start_token"), F.col("cap").alias("tokens"), (first + F.col("before") + F.col("i")).alias("container"))
    return placed.unionByName(cut)


def fill(packed: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Per pack: containers, documents, pieces, tokens, capacity used, containers that no packing could save, the fullest container."""
    each = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    cap = F.create_map(*[x for k, v in packs.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("pack_name")]
    out = each.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.withColumn("capacity_tokens", cap).withColumn("least_containers", F.ceil(F.col("tokens") / cap)).withColumn("filled", F.col("tokens") / (F.col("containers") * cap))

