"""Top-k similarity join: weighted sums of several measures at once, exact, without pairing up the holders of hub items.

Every measure here is, or lies below, an inner product of unit vectors, so the weighted sum of a pair is bounded by what the
common part of both bags can still add. That gives one bound over all measures:

* Items with at most `hub` holders are light. Their self join costs `hub` rows per row of input. It yields, for every pair that shares
  a light item, what the pair has for certain (a lower bound) and what it could reach with its hub items (an upper bound).
* The k-th best lower bound of an entity is its floor. Only pairs that can reach the floor of one end are of interest.
* Pairs that share hub items alone can only reach a floor where the hubs make up much of both bags. Entities are laid in
  blocks of about `block` by that share; two blocks meet only if their shares can reach the lower of their floors. A meeting is a
  matrix product inside a task, tile by tile, which hands on the best rows of each entity that reach its floor and never its pairs.
  Blocks meet themselves first, which raises the floors for all other meetings.
* What is left of the pairs with light items looks up its hub items by a join.

`bags(kind, entity, item, w)` with kinds `cosine`, `jaccard`, `ochiai`; weights of zero or less do not count.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut, top_n, union_all

#: Holders above which an item is a hub.
HUB = 128
#: Entities of a block, about. A block travels once for every block that it meets, so few large ones cost the least shuffle.
BLOCK = 8192
#: Hub items of all entities of a block, about; what bounds a task's memory where bags are large.
ITEMS = 4 << 20
#: Blocks of a grade, if its entities fill so many of `LEAST` each, so that a small input keeps several tasks busy.
SPREAD, LEAST = 8, 256
#: Entities packed into one row of a block.
PACK = 2048
#: Entities of the left block scored at once.
TILE = 256
#: Hub items multiplied at once.
SLICE = 1024
#: Pairs handed on at once.
CHUNK = 100_000
#: Grades of the share of hubs by which blocks are laid.
GRADES = 16
SLACK = 1e-8


def _sizes(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per entity and kind: mass `m`, items `n`, hub items `h`, and the part `r` of the unit vector that hubs make up."""
    aggs = []
    for k in weights:
        of = F.col("kind") == k
        hub = of & F.col("hid").isNotNull()
        w2 = F.col("w") * F.col("w")
        aggs += [F.sum(F.when(of, w2).otherwise(0.0)).alias(f"m_{k}"), F.count(F.when(of, 1)).alias(f"n_{k}"),
                 F.count(F.when(hub, 1)).alias(f"h_{k}"), F.sum(F.when(hub, w2).otherwise(0.0)).alias(f"hm_{k}")]
    out = rows.groupBy("entity").agg(*aggs)
    for k in weights:
        part = F.try_divide(F.col(f"hm_{k}"), F.col(f"m_{k}")) if k == "cosine" else F.try_divide(F.col(f"h_{k}"), F.col(f"n_{k}"))
        out = out.withColumn(f"r_{k}", F.coalesce(F.sqrt(part), F.lit(0.0))).drop(f"hm_{k}")
    return out


def _measure(kind: str, dot: Column, a: dict, b: dict) -> Column:
    """Score of a kind from a dot product or a number of common items; 0 where a side has nothing."""
    if kind == "cosine":
        out = F.least(F.lit(1.0), F.try_divide(dot, F.sqrt(a["m"] * b["m"])))
    elif kind == "jaccard":
        out = F.try_divide(dot, a["n"] + b["n"] - dot)
    else:
        out = F.try_divide(dot, F.sqrt((a["n"] * b["n"]).cast("double")))
    return F.when(dot > 0, F.coalesce(out, F.lit(0.0))).otherwise(0.0)


def _fields(kind: str, end: str) -> dict[str, Column]:
    return {f: F.col(f"{f}_{kind}_{end}") for f in "mnhr"}


def _with_sizes(pairs: DataFrame, sizes: DataFrame, kinds: list[str]) -> DataFrame:
    for end in "ab":
        fields = [F.col(f"{f}_{k}").alias(f"{f}_{k}_{end}") for k in kinds for f in "mnhr"]
        pairs = pairs.join(sizes.select(F.col("entity").alias(end), *fields), end)
    return pairs


def _total(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + w * parts[k]
    return out


def light_pairs(rows: DataFrame, sizes: DataFrame, weights: dict[str, float], exclude: DataFrame | None) -> DataFrame:
    """Pairs (a < b) that share a light item: what they share per kind `d_<kind>`, lower and upper bound of their score."""
    # at most `hub` holders in a list, so the rows travel once and the pairs are formed where they lie
    held = rows.where("hid IS NULL").groupBy("kind", "item").agg(F.sort_array(F.collect_list(F.struct("entity", "w"))).alias("held")).where(F.size("held") > 1)
    left = held.select("kind", "held", F.posexplode("held").alias("at", "x"))
    found = left.select("kind", "x", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("y"))
    found = found.select("kind", F.col("x.entity").alias("a"), F.col("x.w").alias("wa"), F.col("y.entity").alias("b"), F.col("y.w").alias("wb"))
    shared = [F.sum(F.when(F.col("kind") == k, F.col("wa") * F.col("wb") if k == "cosine" else F.lit(1.0)).otherwise(0.0)).alias(f"d_{k}") for k in weights]
    pairs = found.where("a < b").groupBy("a", "b").agg(*shared)
    if exclude is not None:
        pairs = pairs.join(exclude, ["a", "b"], "left_anti")
    pairs = _with_sizes(pairs, sizes, list(weights))
    low, high = {}, {}
    for k in weights:
        a, b = _fields(k, "a"), _fields(k, "b")
        more = F.sqrt(a["m"] * b["m"]) * a["r"] * b["r"] if k == "cosine" else F.least(a["h"], b["h"])
        low[k] = _measure(k, F.col(f"d_{k}"), a, b)
        high[k] = _measure(k, F.col(f"d_{k}") + more, a, b)
    return pairs.select("a", "b", *(f"d_{k}" for k in weights), _total(low, weights).alias("low"), _total(high, weights).alias("high"))


def _floors(scored: DataFrame, groups: DataFrame, limits: dict) -> DataFrame:
    """`(entity, floor)`: the score below which a pair is of no use to the entity, from `scored(a, b, low)` lower bounds."""
    both = scored.select(F.col("a").alias("x"), F.col("b").alias("y"), "low").union(scored.select("b", "a", "low"))
    both = both.join(groups.toDF("x", "gx"), "x").join(groups.toDF("y", "gy"), "y")

    def kth(df: DataFrame, k: int, name: str) -> DataFrame:
        best = top_n(df, "x", [F.col("low").desc(), "y"], k)
        return best.groupBy("x").agg(F.when(F.count("*") >= k, F.min("low")).alias(name))

    best = kth(both, limits["k"], "best")
    cross = kth(both.where("gx <> gy"), limits["cross_k"], "cross")
    own = F.greatest(F.lit(limits["min_score"]), "best")
    other = F.greatest(F.lit(limits["cross_score"]), "cross")
    return best.join(cross, "x", "full").select(F.col("x").alias("entity"), F.least(own, other).alias("floor"))


def _blocks(sizes: DataFrame, weights: dict[str, float], block: int) -> DataFrame:
    """`(entity, block, grade)` of the entities with hub items, blocks of about `block` entities of one grade."""
    reach = F.least(F.lit(1.0), _total({k: F.col(f"r_{k}") for k in weights}, weights))
    items = sum(F.col(f"h_{k}") for k in weights)
    graded = sizes.select("entity", F.floor(reach * GRADES).cast("int").alias("grade"), reach.alias("reach"), items.alias("items")).where("reach > 0")
    parts = graded.groupBy("grade").agg(F.greatest(
        F.ceil(F.count("*") / block), F.ceil(F.sum("items") / ITEMS), F.least(F.lit(SPREAD), F.ceil(F.count("*") / LEAST))).cast("int").alias("parts"))
    return graded.join(parts, "grade").select("entity", "grade", (F.col("grade").cast("long") * (1 << 32) + F.pmod(F.xxhash64("entity"), F.col("parts"))).alias("block"))


def _meetings(blocks: DataFrame, sizes: DataFrame, floors: DataFrame | None, floor: float, weights: dict[str, float]) -> DataFrame:
    """`(i, j)` with i <= j: blocks whose hub items alone can lift a pair to the lower floor of the two."""
    held = blocks.join(sizes, "entity")
    held = held.withColumn("floor", F.lit(floor)) if floors is None else held.join(floors, "entity", "left").fillna(floor, ["floor"])
    tops = cut(held.groupBy("grade", "block").agg(F.min("floor").alias("floor"), *(F.max(f"r_{k}").alias(f"r_{k}") for k in weights)), "blocks")
    grades = tops.groupBy("grade").agg(F.min("floor").alias("floor"), *(F.max(f"r_{k}").alias(f"r_{k}") for k in weights))

    def meet(df: DataFrame, names: list[str]) -> Column:
        return _total({k: F.col(f"x.r_{k}") * F.col(f"y.r_{k}") for k in weights}, weights) >= F.least("x.floor", "y.floor") - SLACK

    # the few grades meet first, then the blocks of the grades that do
    numbers = F.explode(F.sequence(F.lit(0), F.lit(GRADES))).alias("other")
    pairs = grades.alias("x").select("*", numbers).join(grades.alias("y"), F.col("other") == F.col("y.grade")).where(meet(grades, []))
    pairs = pairs.select(F.col("x.grade").alias("gi"), F.col("y.grade").alias("gj"))
    x = tops.alias("x").join(pairs, F.col("x.grade") == F.col("gi"))
    met = x.join(tops.alias("y"), F.col("gj") == F.col("y.grade")).where(F.col("x.block") <= F.col("y.block")).where(meet(tops, []))
    return met.select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def _best(score: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Marks the `k` greatest of every row that reach the row's `least`; ties go to the earlier column."""
    n = score.shape[1]
    enough = score >= least[:, None]
    if n <= k:
        return enough
    kth = np.partition(score, n - k, axis=1)[:, n - k, None]
    over, tie = score > kth, score == kth
    room = k - over.sum(axis=1)
    many = np.flatnonzero(tie.sum(axis=1) > room)
    tie[many] &= np.cumsum(tie[many], axis=1) <= room[many, None]
    return (over | tie) & enough


def _packer(kinds: list[str]):
    """Packs the entities of a block, in order, into few compressed rows: numbers of hub items by a dictionary, weights once per item."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("entity")
        pieces = []
        for first in range(0, len(frame), PACK):
            part = frame.iloc[first : first + PACK]
            held = {name: part[name].to_numpy(str) for name in ("entity", "grp")} | {f"{f}_{kind}": part[f"{f}_{kind}"].to_numpy(float) for kind in kinds for f in "mn"}
            for n, kind in enumerate(kinds):
                lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in part[f"items_{n}"]]
                lengths = np.array([len(x) for x in lists], np.int64)
                rows = np.repeat(np.arange(len(part)), lengths)
                ids, number = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True)
                order = np.lexsort((number, rows))
                number = number[order]
                held |= {f"lengths_{n}": lengths, f"ids_{n}": ids, f"numbers_{n}": number.astype(np.uint16 if len(ids) < 1 << 16 else np.int64)}
                if kind == "cosine":
                    ws = np.concatenate([np.zeros(0), *(np.asarray(x, float) for x in part[f"ws_{n}"] if x is not None)])[order]
                    of_item = np.zeros(len(ids))
                    of_item[number] = ws
                    held[f"ws_{n}" if (of_item[number] == ws).all() else f"each_{n}"] = of_item if (of_item[number] == ws).all() else ws
            out = io.BytesIO()
            np.savez_compressed(out, **held)
            pieces.append(out.getvalue())
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])] * len(pieces), "number": range(len(pieces)), "piece": pieces})

    return pack


def _unpacked(pieces: pd.DataFrame, kinds: list[str]) -> tuple[pd.DataFrame, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The entities of a block in order and, per kind, row, hub item and weight of all their hub items."""
    frames, items = [], [[] for _ in kinds]
    first = 0
    for piece in pieces.sort_values("number")["piece"]:
        with np.load(io.BytesIO(piece), allow_pickle=False) as held:
            frames.append(pd.DataFrame({name: held[name].astype(object) if name in ("entity", "grp") else held[name]
                                        for name in ("entity", "grp", *(f"{f}_{kind}" for kind in kinds for f in "mn"))}))
            for n in range(len(kinds)):
                lengths, number = held[f"lengths_{n}"], held[f"numbers_{n}"]
                ws = held[f"ws_{n}"][number] if f"ws_{n}" in held else held[f"each_{n}"] if f"each_{n}" in held else np.ones(len(number))
                items[n].append((np.repeat(np.arange(first, first + len(lengths), dtype=np.int32), lengths), held[f"ids_{n}"][number], ws))
        first += len(frames[-1])
    return pd.concat(frames, ignore_index=True), [tuple(np.concatenate(x) for x in zip(*of, strict=True)) for of in items]


class _Common:
    """The common hub items of two blocks in one kind, and their dot products for a tile of the left block."""

    def __init__(self, left: tuple, right: tuple, n: int):
        sides = (left, right)
        both = np.intersect1d(sides[0][1], sides[1][1])
        placed = []
        for rows, ids, values in sides:
            place = np.searchsorted(both, ids).astype(np.int32)
            here = place < len(both)
            here[here] = both[place[here]] == ids[here]
            placed.append((rows[here], place[here], values[here]))
        self.n, self.size, self.left = n, len(both), placed[0]
        order = np.argsort(placed[1][1], kind="stable")
        self.right = tuple(x[order] for x in placed[1])
        self.cuts = np.searchsorted(self.right[1], np.arange(0, self.size + SLICE, SLICE))
        self.whole = None

    def _dense(self, part: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole
        lo, hi = self.cuts[part], self.cuts[part + 1]
        matrix = np.zeros((self.n, min(SLICE, self.size - part * SLICE)))
        matrix[self.right[0][lo:hi], self.right[1][lo:hi] - part * SLICE] = self.right[2][lo:hi]
        if self.size <= SLICE:
            self.whole = matrix
        return matrix

    def dots(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, self.n))
        lo, hi = np.searchsorted(self.left[0], (first, last))
        rows, place, values = (x[lo:hi] for x in self.left)
        for part in range(-(-self.size // SLICE)):
            here = (place >= part * SLICE) & (place < (part + 1) * SLICE)
            if here.any():
                right = self._dense(part)
                matrix = np.zeros((last - first, right.shape[1]))
                matrix[rows[here] - first, place[here] - part * SLICE] = values[here]
                out += matrix @ right.T
        return out


def _multiplier(kinds: list[str], weights: dict[str, float], limits: dict | None, floor: float):
    """Scores two blocks against each other, a tile of the left one at a time."""

    def ranked(found: dict[str, np.ndarray], k: int, cross_k: int) -> dict[str, np.ndarray]:
        """The best of every column among its best of the tiles."""
        order = np.lexsort((found["at"], -found["score"], found["to"]))
        found = {name: x[order] for name, x in found.items()}
        keep = np.zeros(len(order), bool)
        for among, n in ((np.arange(len(order)), k), (np.flatnonzero(found["cross"]), cross_k)):
            column = found["to"][among]
            keep[among[np.arange(len(among)) - np.searchsorted(column, column) < n]] = True
        return {name: x[keep] for name, x in found.items()}

    def meet(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = key
        frames = list(batches)
        pieces = pd.concat([f.loc[f["piece"].notna(), ["block", "number", "piece"]] for f in frames])
        floor_of = pd.concat([f.loc[f["entity"].notna(), ["entity", "floor"]] for f in frames]).drop_duplicates("entity").set_index("entity")["floor"]
        given = pd.concat([f.loc[f["a"].notna(), ["a", "b", "gone", *(f"d_{kind}" for kind in kinds)]] for f in frames])
        del frames
        left, items_a = _unpacked(pieces[pieces["block"] == i], kinds)
        right, items_b = (left, items_a) if i == j else _unpacked(pieces[pieces["block"] == j], kinds)
        names_a, names_b = left["entity"].to_numpy(object), right["entity"].to_numpy(object)
        # both orders within one block, the fitting one between two
        pairs = []
        for x, y in (("a", "b"), ("b", "a")):
            at, to = pd.Index(names_a).get_indexer(given[x]), pd.Index(names_b).get_indexer(given[y])
            ok = (at >= 0) & (to >= 0)
            pairs.append([at[ok], to[ok], given["gone"].to_numpy(bool)[ok], *(given[f"d_{kind}"].to_numpy(float)[ok] for kind in kinds)])
        pairs = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        order = np.argsort(pairs[0], kind="stable")
        given_at, given_to, given_gone, *given_dots = (x[order] for x in pairs)
        common = [_Common(items_a[n], items_b[n], len(right)) for n in range(len(kinds))]
        sizes = [tuple((side[f"m_{kind}"].to_numpy(float), side[f"n_{kind}"].to_numpy(float)) for side in (left, right)) for kind in kinds]
        groups = [side["grp"].to_numpy(object) for side in (left, right)]
        floors = [floor_of.reindex(names).fillna(floor).to_numpy(float) for names in (names_a, names_b)]
        del given, left, right, items_a, items_b, pieces, pairs

        def out(found: dict[str, np.ndarray]) -> pd.DataFrame:
            low, high = names_a[found["at"]], names_b[found["to"]]
            swap = low > high
            return pd.DataFrame({"a": np.where(swap, high, low), "b": np.where(swap, low, high)} | {f"s_{kind}": found[f"s_{kind}"] for kind in kinds})

        by_row, by_column = [], []
        for first in range(0, len(names_a), TILE):
            last = min(first + TILE, len(names_a))
            lo, hi = np.searchsorted(given_at, (first, last))
            at, to = given_at[lo:hi] - first, given_to[lo:hi]
            score, parts = np.zeros((last - first, len(names_b))), []
            with np.errstate(divide="ignore", invalid="ignore"):
                for n, kind in enumerate(kinds):
                    dots = common[n].dots(first, last)
                    dots[at, to] += given_dots[n][lo:hi]
                    (ma, na), (mb, nb) = sizes[n]
                    if kind == "cosine":
                        s = np.minimum(1.0, dots / np.sqrt(np.outer(ma[first:last], mb)))
                    elif kind == "jaccard":
                        s = dots / (np.add.outer(na[first:last], nb) - dots)
                    else:
                        s = dots / np.sqrt(np.outer(na[first:last], nb))
                    s[dots <= 0] = 0.0
                    parts.append(s)
                    score += weights[kind] * s
            score = np.round(score, 9)
            score[at[given_gone[lo:hi]], to[given_gone[lo:hi]]] = -1.0
            if i == j:
                score[np.arange(last - first), np.arange(first, last)] = -1.0

            def picked(keep: np.ndarray) -> dict[str, np.ndarray]:
                row, column = np.nonzero(keep)
                found = {"at": row + first, "to": column, "score": score[row, column]} | {f"s_{kind}": parts[n][row, column] for n, kind in enumerate(kinds)}
                return found if limits is None else found | {"cross": cross[row, column]}

            if limits is None:
                keep = score >= floor - SLACK if floor > 0 else (score >= 0) & (sum(parts) > 0)
                if i == j:
                    keep &= np.arange(len(names_b)) > np.arange(first, last)[:, None]
                found = picked(keep)
                for start in range(0, len(found["at"]), CHUNK):
                    yield out({name: x[start : start + CHUNK] for name, x in found.items()})
                continue
            cross = np.not_equal.outer(groups[0][first:last], groups[1]).astype(bool)
            keep, keep_columns = np.zeros(score.shape, bool), np.zeros(score.shape, bool)
            for among, k, least in ((score, limits["k"], limits["min_score"]), (np.where(cross, score, -1.0), limits["cross_k"], limits["cross_score"])):
                keep |= _best(among, k, np.maximum(floors[0][first:last], least) - SLACK)
                if i != j:
                    keep_columns |= _best(np.ascontiguousarray(among.T), k, np.maximum(floors[1], least) - SLACK).T
            by_row.append(picked(keep))
            by_column.append(picked(keep_columns))
        if limits is None:
            return
        join = lambda found: {name: np.concatenate([x[name] for x in found]) for name in found[0]}
        if by_row:
            rows, columns = join(by_row), ranked(join(by_column), limits["k"], limits["cross_k"])
            found = join([rows, columns])
            at, to = found["at"], found["to"]
            if i == j:
                at, to = np.minimum(at, to), np.maximum(at, to)
            _, once = np.unique(at * len(names_b) + to, return_index=True)
            for start in range(0, len(once), CHUNK):
                yield out({name: x[once[start : start + CHUNK]] for name, x in found.items()})

    # Spark tells the kind of function by these
    meet.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return meet


def similar(
    bags: DataFrame, weights: dict[str, float], floor: float, exclude: DataFrame | None = None, groups: DataFrame | None = None,
    k: int | None = None, cross_k: int = 3, min_score: float = 0.15, hub: int = HUB, block: int = BLOCK, counts: dict | None = None,
) -> DataFrame:
    """`(a, b, s_<kind>..., score)` with a < b, scores rounded to nine digits.

    Without `k`: every pair whose weighted sum reaches `floor`, with a floor of 0 every pair that shares anything. With `k` and `groups(id, grp)`: all pairs among the best `k` of one end
    from `min_score` on, or among its best `cross_k` of another group from `floor` on (ties to the smaller id), besides
    pairs that are not. `exclude(a, b)` with a < b: pairs that do not count. Entities that share nothing never pair; null
    entities and items are left out. `counts`, if given, receives how many pairs were scored and how many blocks met.
    """
    kinds = list(weights)
    if sum(weights.values()) > 1 + SLACK or floor < 0 or floor == 0 and k is not None:
        raise ValueError("weights add up to one at most, and the floor is positive, or 0 without k")
    limits = None if k is None else {"k": k, "cross_k": cross_k, "min_score": min_score, "cross_score": floor}
    bags = bags.where("w > 0 AND entity IS NOT NULL AND item IS NOT NULL")
    hubs = bags.groupBy("kind", "item").agg(F.count("*").alias("f")).where(F.col("f") > hub)
    hubs = cut(hubs.select("kind", "item", F.monotonically_increasing_id().alias("hid")), "hubs")
    rows = cut(bags.join(hubs, ["kind", "item"], "left").select("kind", "entity", "item", "w", "hid"), "rows")
    sizes = cut(_sizes(rows, weights), "sizes")
    light = cut(light_pairs(rows, sizes, weights, exclude), "light")
    names = None if groups is None else groups.select("id", "grp")
    floors = None if limits is None else cut(_floors(light, names, limits), "floors")
    found, met = [], None
    if not hubs.isEmpty():
        blocks = cut(_blocks(sizes, weights, block), "laid")
        bare = rows.where("hid IS NOT NULL").groupBy("entity").agg(*(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("hid", "w"))).alias(f"h{n}") for n, kind in enumerate(kinds)))
        entities = bare.join(blocks, "entity").join(sizes, "entity")
        entities = entities.withColumn("grp", F.lit("")) if names is None else entities.join(names.withColumnRenamed("id", "entity"), "entity", "left")
        entities = entities.select("entity", "block", F.coalesce("grp", F.lit("")).alias("grp"), *(F.col(f"h{n}.hid").alias(f"items_{n}") for n in range(len(kinds))),
            *(F.col(f"h{n}.w").alias(f"ws_{n}") for n, kind in enumerate(kinds) if kind == "cosine"), *(f"{f}_{kind}" for kind in kinds for f in "mn"))
        packed = cut(entities.groupBy("block").applyInPandas(_packer(kinds), "block long, number int, piece binary"), "packed")
        place = blocks.select(F.col("entity").alias("a"), F.col("block").alias("ba")), blocks.select(F.col("entity").alias("b"), F.col("block").alias("bb"))
        known = light.select("a", "b", *(f"d_{kind}" for kind in kinds), F.lit(False).alias("gone"))
        if exclude is not None:
            known = known.unionByName(exclude.select("a", "b", *(F.lit(0.0).alias(f"d_{kind}") for kind in kinds), F.lit(True).alias("gone")))
        known = cut(known.join(place[0], "a").join(place[1], "b").select("a", "b", *(f"d_{kind}" for kind in kinds), "gone",
            F.least("ba", "bb").alias("i"), F.greatest("ba", "bb").alias("j")), "known")
        schema = "a string, b string, " + ", ".join(f"s_{kind} double" for kind in kinds)
        run = _multiplier(kinds, weights, limits, floor)

        def multiplied(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
            ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
            sent = ends.join(packed, "block")
            if floors is not None:
                least = ends.join(blocks.join(floors.where("floor IS NOT NULL"), "entity").select("block", "entity", "floor"), "block")
                sent = sent.unionByName(least, allowMissingColumns=True)
            own = known.join(pairs, ["i", "j"], "left_semi")
            sent = sent if floors is not None else sent.withColumn("entity", F.lit(None).cast("string")).withColumn("floor", F.lit(None).cast("double"))
            out = sent.unionByName(own, allowMissingColumns=True).groupBy("i", "j").applyInPandas(run, schema)
            # without limits the result may be all pairs, and is read once
            return out if limits is None else cut(out, "met")

        pairs = cut(_meetings(blocks, sizes, floors, floor, weights), "meetings")
        met = pairs.where("i = j")
        found.append(multiplied(met, floors))
        rest = pairs.where("i < j")
        if limits is not None:
            raised = _floors(union_all([light.select("a", "b", "low"), found[0].select("a", "b", _total({kind: F.col(f"s_{kind}") for kind in kinds}, weights).alias("low"))])
                             .groupBy("a", "b").agg(F.max("low").alias("low")), names, limits)
            floors = cut(raised, "raised")
            rest = _meetings(blocks, sizes, floors, floor, weights).where("i < j")
        rest = cut(rest, "meetings")
        found.append(multiplied(rest, floors))
        met = met.unionByName(rest)
    found.append(_looked_up(light, rows, sizes, floors, floor, weights, blocks if met is not None else None, met))
    if counts is not None:
        counts["light"] = light.count()
        counts["scored"] = found[-1].count()
        counts["blocks"] = 0 if met is None else met.count()
    out, total = union_all(found), _total({kind: F.col(f"s_{kind}") for kind in kinds}, weights)
    return out.withColumn("score", F.round(total, 9)).where(F.col("score") >= floor if floor > 0 else total > 0)


def _looked_up(light: DataFrame, rows: DataFrame, sizes: DataFrame, floors: DataFrame | None, floor: float, weights: dict[str, float], blocks: DataFrame | None, met: DataFrame | None) -> DataFrame:
    """Scores of the pairs with light items that no meeting of blocks has scored and that can reach a floor."""
    kinds = list(weights)
    left = light.where(F.col("high") >= floor - SLACK)
    if floors is not None:
        for end in "ab":
            left = left.join(floors.toDF(end, f"floor_{end}"), end, "left")
        left = left.where(F.col("high") >= F.least(F.coalesce("floor_a", F.lit(floor)), F.coalesce("floor_b", F.lit(floor))) - SLACK)
    dots = [F.col(f"d_{k}") for k in kinds]
    if met is not None:
        for end in "ab":
            left = left.join(blocks.select(F.col("entity").alias(end), F.col("block").alias(f"b{end}")), end, "left")
        left = left.withColumn("i", F.least("ba", "bb")).withColumn("j", F.greatest("ba", "bb"))
        alone = left.where("ba IS NULL OR bb IS NULL")
        left = cut(left.where("ba IS NOT NULL AND bb IS NOT NULL").join(met, ["i", "j"], "left_anti").select("a", "b", *dots), "left")
        hubs = rows.where("hid IS NOT NULL")
        side = lambda end: hubs.select(F.col("entity").alias(end), "hid", "kind", F.col("w").alias(f"w{end}"))
        more = left.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "hid", "kind"]).groupBy("a", "b").agg(*(
            F.sum(F.when(F.col("kind") == k, F.col("wa") * F.col("wb") if k == "cosine" else F.lit(1.0)).otherwise(0.0)).alias(f"d_{k}") for k in kinds))
        left = union_all([alone.select("a", "b", *dots), left, more]).groupBy("a", "b").agg(*(F.sum(d).alias(f"d_{k}") for k, d in zip(kinds, dots, strict=True)))
    sized = _with_sizes(left, sizes, kinds)
    return sized.select("a", "b", *(_measure(k, F.col(f"d_{k}"), _fields(k, "a"), _fields(k, "b")).alias(f"s_{k}") for k in kinds))
