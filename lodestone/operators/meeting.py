"""What both sides of a pair have, or one of them lacks, for given pairs of entities.

Facts `(id, key, ...)` are dealt into parts by their key and every pair visits each part once. A task holds the facts of one part
as codes, takes the side of a pair that has fewer of them and looks these up in the other side. So no pair is ever expanded
into rows that travel; what leaves a task are results, or only the first of each pair and their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.common import cut, top_n, union_all

#: Facts of a part, about, and of a part of a small input, which is dealt over the cores.
PART, LEAST = 500_000, 20_000
#: Facts looked up at once.
CHUNK = 250_000
#: Kinds of rows that a task gets, in this order.
LEFT, RIGHT, BOTH, PAIRS = range(4)


class _Side:
    """The facts of one side of a part, sorted by id and key."""

    def __init__(self, batches: list[pa.RecordBatch], names: pa.Array, keys: pa.Array, fields: str):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = {c: table.column(c).combine_chunks() for c in ("id", "key", fields)}
        of = lambda c, among: pc.index_in(column[c], value_set=among).to_numpy(zero_copy_only=False).astype(np.int64)
        code = of("id", names) * len(keys) + of("key", keys)
        order = np.argsort(code, kind="stable")
        self.code, self.key, self.n_keys = code[order], column["key"].take(pa.array(order)), len(keys)
        self.fields = [f.take(pa.array(order)) for f in column[fields].flatten()]
        self.starts = np.searchsorted(self.code, np.arange(len(names) + 1, dtype=np.int64) * max(1, len(keys)))
        self.repeated = bool((self.code[1:] == self.code[:-1]).any())

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, 0, self.starts[ids + 1] - self.starts[ids])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run each place belongs to, and the places of all runs."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _looked_up(small: _Side, large: _Side, ids: np.ndarray, others: np.ndarray, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, place in the small side and place in the large side of what both have; `without`: of what the large side lacks."""
    run, at = _spread(small.starts[ids], small.sizes(ids))
    code = np.where(others[run] < 0, -1, others[run] * large.n_keys + small.code[at] % max(1, small.n_keys))
    low = np.searchsorted(large.code, code)
    there = np.zeros(len(code), bool) if not len(large.code) else (low < len(large.code)) & (large.code[np.minimum(low, len(large.code) - 1)] == code)
    if without:
        return run[~there], at[~there], at[~there]
    run, at, low = run[there], at[there], low[there]
    if large.repeated:
        more, place = _spread(low, np.searchsorted(large.code, code[there], "right") - low)
        run, at, low = run[more], at[more], place
    return run, at, low


def _prober(names: list[str], without: bool, unlike: tuple[int, int] | None, keep: int | None, weight: int | None):
    def results(a: pa.Array, b: pa.Array, sides: tuple[_Side, _Side], ids: np.ndarray, others: np.ndarray, pair: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        if unlike is not None:
            differ = pc.not_equal(sides[0].fields[unlike[0]].take(pa.array(left)), sides[1].fields[unlike[1]].take(pa.array(right)))
            ok = pc.fill_null(differ, False).to_numpy(zero_copy_only=False)
            pair, left, right = pair[ok], left[ok], right[ok]
        found = []
        if keep is not None and len(pair):
            keys = sides[0].key.take(pa.array(left)).dictionary_encode()
            place = pc.rank(keys.dictionary, tiebreaker="dense").to_numpy()[keys.indices.to_numpy()]
            heavy = np.zeros(len(left)) if weight is None else sides[0].fields[weight].take(pa.array(left)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            order = np.lexsort((place, -np.nan_to_num(heavy, nan=-np.inf), pair))
            pair, left, right = pair[order], left[order], right[order]
            first = np.searchsorted(pair, pair)
            nth = np.arange(len(pair)) - first
            total = np.searchsorted(pair, pair, "right") - first
            ok = nth < keep
            found = [pa.array(np.where(nth == 0, total, 0)[ok].astype(np.int64))]
            pair, left, right = pair[ok], left[ok], right[ok]
        if not len(pair):
            return None
        at, l, r = pa.array(pair), pa.array(left), pa.array(right)
        columns = [a.take(at), b.take(at), sides[0].key.take(l), *(f.take(l) for f in sides[0].fields)]
        columns += [] if without else [f.take(r) for f in sides[1].fields]
        return pa.RecordBatch.from_arrays(columns + found, names=names)

    def look(pairs: pa.RecordBatch, known: pa.Array, sides: tuple[_Side, _Side]) -> Iterator[pa.RecordBatch]:
        a, b = pairs.column("id"), pairs.column("other")
        ids, others = (pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        n, m = sides[0].sizes(ids), sides[1].sizes(others)
        ways = [(0, np.flatnonzero(n > 0))] if without else [(0, np.flatnonzero((n > 0) & (n <= m))), (1, np.flatnonzero((m > 0) & (n > m)))]
        for way, chosen in ways:
            ends = np.cumsum((n, m)[way][chosen])
            bounds = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK, (ends[-1] if len(ends) else 0) + CHUNK, CHUNK)) + 1])).clip(max=len(chosen))
            for first, last in zip(bounds, bounds[1:], strict=False):
                if first == last:
                    continue
                some = chosen[first:last]
                mine, theirs = (ids[some], others[some]) if way == 0 else (others[some], ids[some])
                run, at, place = _looked_up(sides[way], sides[1 - way], mine, theirs, without)
                left, right = (at, place) if way == 0 else (place, at)
                if (out := results(a, b, sides, ids, others, some[run], left, right)) is not None:
                    yield out

    def index_of(facts: tuple[list, list], same: bool) -> tuple[pa.Array, tuple[_Side, _Side]]:
        both = pa.Table.from_batches([*facts[0], *([] if same else facts[1])])
        known, keys = (pc.unique(both.column(c).combine_chunks()) for c in ("id", "key"))
        left = _Side(facts[0], known, keys, "l")
        return known, (left, left if same else _Side(facts[1], known, keys, "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, facts, same, index = None, ([], []), False, None
        for batch in batches:
            part, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "tag"))
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(tag) != 0)) + 1
            for first, last in zip([0, *edges], [*edges, len(part)], strict=True):
                piece = batch.slice(first, last - first)
                if part[first] != held:
                    held, facts, same, index = part[first], ([], []), False, None
                if tag[first] < PAIRS:
                    facts[int(tag[first] == RIGHT)].append(piece)
                    same = tag[first] == BOTH
                elif facts[0]:
                    if index is None:
                        index = index_of((facts[0], facts[1] or [batch.slice(0, 0)]), same)
                        facts[0][1:], facts[1][:] = [], []
                    yield from look(piece, *index)

    return run


def probe(pairs: DataFrame, left: DataFrame, right: DataFrame | None, key: str, without: bool = False, unlike: str | None = None,
          keep: int | None = None, weight: str | None = None) -> DataFrame:
    """`(a, b, <key>, <c>_a..., <c>_b...)`: facts of `left(id, <key>, ...)` at `a` whose key `right(id, <key>, ...)` has at `b`, with the
    fields of both; `right` is `left` if it is None. Pairs count once.

    `without`: facts of `left` at `a` whose key `b` lacks, with fields of `left` alone. `unlike`: a field in which both must differ.
    `keep`: of a pair, only the first so many of each part, by the number `weight` of `left` downwards and by key; `found` has
    the number of all of them, at the first one, and 0 at others, so its sum is what the pair has in all.
    """
    same = right is None
    right = left if same else right
    rest = [[f for f in df.schema.fields if f.name not in ("id", key)] for df in (left, right)]
    dummy = StructField("_", LongType())
    spark = pairs.sparkSession
    known = [df.where(F.col("id").isNotNull() & (F.lit(True) if without and df is left else F.col(key).isNotNull())) for df in (left, right)]
    n = known[0].count() + (0 if same else known[1].count())
    parts = max(math.ceil(n / PART), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST)), 1)

    def held(df: DataFrame, tag: int, sides: str) -> DataFrame:
        kinds = [StructType(x or [dummy]) for x in rest]
        own = [F.struct(*[F.col(f.name) for f in x]) if x else F.struct(F.lit(0).cast("long").alias("_")) for x in rest]
        l, r = (own[i].cast(kinds[i]) if name in sides else F.lit(None).cast(kinds[i]) for i, name in enumerate("lr"))
        return df.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.lit(tag).alias("tag"), F.col("id").cast("string").alias("id"),
                         F.lit(None).cast("string").alias("other"), F.col(key).alias("key"), l.alias("l"), r.alias("r"))

    visits = pairs.select("a", "b").distinct().where("a is not null and b is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(PAIRS).alias("tag"), F.col("a").alias("id"), F.col("b").alias("other"))
    if same:
        rows = held(known[0], BOTH, "lr")
    else:
        rows = held(known[0], LEFT, "l").unionByName(held(known[1], RIGHT, "r"))
    rows = rows.unionByName(visits, allowMissingColumns=True).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tag")
    names = [StructField("a", pairs.schema["a"].dataType), StructField("b", pairs.schema["b"].dataType), StructField(key, left.schema[key].dataType)]
    names += [StructField(f"{f.name}_a", f.dataType) for f in rest[0] or [dummy]]
    names += [] if without else [StructField(f"{f.name}_b", f.dataType) for f in rest[1] or [dummy]]
    names += [] if keep is None else [StructField("found", LongType())]
    place = lambda x, name: next(i for i, f in enumerate(x) if f.name == name)
    run = _prober([f.name for f in names], without, None if unlike is None else (place(rest[0], unlike), place(rest[1], unlike)), keep,
                  None if weight is None else place(rest[0], weight))
    return rows.mapInArrow(run, StructType(names)).drop("__a", "__b")


def counts(pairs: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """`(a, b, n)`: how many facts both sides of a pair have; pairs without any are absent."""
    return probe(pairs, facts.select("id", key), None, key, keep=1).groupBy("a", "b").agg(F.sum("found").alias("n"))


def first_apart(pairs: DataFrame, lists: DataFrame, right: DataFrame, key: str, order: list, n: int, head: int = 32) -> DataFrame:
    """`(a, b, <key>, <c>_a..., pos)`: the first `n` facts of `lists` at `a`, in the order of its columns, whose key `right` lacks at `b`.

    Heads of the lists are looked up first; pairs whose head is not enough go on with one sixteen times as long.
    """
    ends, found, head = ["a", "b"], [], max(head, n)
    left = pairs.select(*ends).distinct()
    sizes = lists.groupBy("id").agg(F.count("*").alias("n"))
    while True:
        heads = cut(top_n(lists, "id", order, head, "place"), "heads")
        rows = cut(top_n(probe(left, heads, right, key, without=True), ends, ["place_a"], n, "pos"), "apart")
        more = left.join(sizes.where(F.col("n") > head).select(F.col("id").alias("a")), "a", "left_semi")
        full = rows.groupBy(*ends).agg(F.count("*").alias("got")).where(F.col("got") >= n)
        left = cut(more.join(full, ends, "left_anti"), "short")
        if left.isEmpty():
            return union_all([*found, rows])
        found.append(rows.join(left, ends, "left_anti"))
        lists = lists.join(left.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        right = right.join(left.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        head *= 16
