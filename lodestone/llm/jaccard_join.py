"""Near-duplicate documents by a size-aware heavy-light join on sets of word shingles.

A document is the set of its four-word shingles; two link when the sets' Jaccard similarity reaches 0.85. Equal sets are one
class. Small sets are found through subsets: of the tokens at the head of a set, in an order from rare to frequent, all pairs
are enumerated, since similar sets share at least two of them. Large sets are found through inverted lists of single head
tokens; their order is by frequency within a fifth of the token space (frequencies of the rest are never counted) and by hash
after it. The boundary between small and large is the size at which the expected cost is least.

A token that one set alone holds can't be shared, so most documents have no head token left. Lists are scanned in two steps. First
each member is compared with one leader, the first member of the list that shares most lists with it. Then members that are
still in different components are compared with each other. Pairs inside a component need no test: they add no link
between components. So a group of thousands of near copies costs about a comparison each.

Candidates first meet as parity bitmaps of about a bit a token: every token flips one bit, so two bitmaps can't differ in more bits than
the sets differ in tokens. Pairs that differ in too many are out, exactly; only sets of the pairs left are built again and shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.common import cut
from lodestone.llm.base import LOWER, chunks, mix, row_ids, small_side, table, text_or_empty, texts_of, word_hashes
from lodestone.llm.graph import components

WIDTH, PERCENT = 4, 85
#: Sets up to this size keep all their tokens, so the boundary may lie anywhere below; larger ones keep the tokens of the counted region.
WHOLE = 64
#: Share of the token space, in 256ths, whose frequencies are counted.
REGION = 51
GROUP_BYTES = 4 << 20
#: Members of a leader to which one copy of its set travels.
LED = 1000
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = WIDTH):
    """Per text, its distinct shingles as sorted 64-bit numbers; a shorter text is one shingle, one without words none."""
    at = 0
    while at < len(texts):
        total, end = len(texts[at]), at + 1
        while end < len(texts) and total + len(texts[end]) <= GROUP_BYTES:
            total += len(texts[end])
            end += 1
        row, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for rows, starts_at, glued in chunks(texts[at:end]):
            starts, _, found = word_hashes(LOWER[np.frombuffer(glued, np.uint8)])
            row.append(rows[np.searchsorted(starts_at, starts, side="right") - 1])
            hashed.append(found)
        row, hashed = np.concatenate(row), np.concatenate(hashed)
        bounds = np.searchsorted(row, np.arange(end - at + 1))
        n = len(hashed) - width + 1
        rolled = np.zeros(max(0, n), np.uint64)
        for j in range(width if n > 0 else 0):
            rolled += hashed[j : j + n] * _FACTORS[j]
        rolled = mix(rolled)
        for i in range(end - at):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(hashed[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)
        at = end


def head(n: int, percent: int = PERCENT) -> int:
    """How many tokens two similar sets may leave before they share one, for a set of n tokens."""
    return n - -(-percent * n // 100)


def _signature(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s ^ f).sum(dtype=np.uint64).view(np.int64)) for f in _FACTORS[6:8])


def parities(s: np.ndarray) -> bytes:
    """A bitmap in which every token of a set flips one bit: as many bits as the next power of two above the set's size, 64 at least.

    The upper half laid over the lower one (by exclusive or) is the bitmap of half the length.
    """
    size = 1 << max(6, int(len(s) - 1).bit_length())
    flips = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ: at most as many as tokens that one set alone holds."""
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * max(len(x), len(y))
    if len(x) < len(y):
        a, b = b, a
    while bits > 8 * min(len(x), len(y)):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def most_differing(n: int, m: int, percent: int = PERCENT) -> int:
    """How many tokens may stand in only one of two similar sets of n and m tokens."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _sets(width: int, percent: int):
    def run(batches_of):
        start = 0
        for batch in batches_of:
            m = batch.num_rows
            sizes, region, first, second, tokens, bits = [], [], [], [], [], []
            for s in shingle_sets(texts_of(batch, "text"), width):
                known = int(np.searchsorted(s, np.uint64(REGION << 56)))
                a, b = _signature(s)
                sizes.append(len(s))
                region.append(known)
                first.append(a)
                second.append(b)
                bits.append(parities(s))
                tokens.append((s if len(s) <= WHOLE else s[: max(known, head(len(s), percent) + 1)]).view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
            yield pa.record_batch(
                {
                    "rid": pa.array(row_ids(start, m), pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "th": batch.column("th"),
                    "n": pa.array(sizes, pa.int64()),
                    "region": pa.array(region, pa.int64()),
                    "s1": pa.array(first, pa.int64()),
                    "s2": pa.array(second, pa.int64()),
                    "bits": pa.array(bits, pa.binary()),
                    "tokens": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64())),
                }
            )
            start += m

    return run


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Size from which sets go through inverted lists: the one of least cost in rows handled.

    A small set costs all its tokens and the pairs of its head. A large one costs the tokens of the counted region, and if chance leaves so
    few tokens there that it can't be ruled out, its text again and its set on both ways of a comparison.
    """

    def small(n: int) -> float:
        k = head(n, percent) + 2
        return n + k * (k - 1) / 2

    def large(n: int) -> float:
        share = REGION / 256
        z = (head(n, percent) + 1 - n * share) / math.sqrt(max(1e-9, n * share * (1 - share)))
        return n * share + (0.5 * math.erfc(-z / math.sqrt(2))) * 4 * n

    top = WHOLE * percent // 100
    costs = {x: sum(c * (small(n) if 100 * n < 100 * x else 0) + c * (large(n) if n >= x else 0) + c * (small(n) if x <= n and percent * n < 100 * x else 0) for n, c in sizes.items()) for x in range(1, top + 1)}
    return min(costs, key=lambda x: (costs[x], x))


def _near(percent: int):
    def run(batches_of):
        for batch in batches_of:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            keep = pa.array([differing(x[i], y[i]) <= most_differing(n[i], m[i], percent) for i in range(len(n))], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches_of):
        for batch in batches_of:
            left, right, good = batch.column("sa"), batch.column("sb"), []
            for i in range(batch.num_rows):
                # views of the batch, not copies
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _full_sets(width: int):
    def run(batches_of):
        for batch in batches_of:
            first, second, sets = [], [], []
            for s in shingle_sets(texts_of(batch, "text"), width):
                a, b = _signature(s)
                first.append(a)
                second.append(b)
                sets.append(s.tobytes())
            yield pa.record_batch([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sets, pa.binary())], names=["s1", "s2", "items"])

    return run


def lists_of(reps: DataFrame, x: int, percent: int = PERCENT) -> DataFrame:
    """(key, rid, n, front): the inverted lists of large sets and the pair lists of small ones.

    Two similar sets meet in a list in which the smaller one is at its front.

    Tokens are shuffled by as many leading bits as keep chance meetings below one in 256; equal tokens always meet.
    """
    tokens = reps.agg(F.sum(F.size("tokens"))).first()[0] or 0
    bits = min(62, max(32, math.ceil(math.log2(tokens + 1)) + 8))
    least_small = F.col("n") * percent < 100 * x
    large = reps.filter(F.col("n") >= x).select("rid", "n", "region", F.lit(0).alias("small"), F.explode("tokens").alias("t"))
    # tokens are sorted as unsigned numbers; those below the region's end come first
    inside = F.shiftrightunsigned("t", 56) < REGION
    large = large.filter(inside | (F.col("n") > WHOLE))
    # a set of WHOLE tokens or fewer keeps all of them; of those outside the region only the head counts
    spare = reps.filter((F.col("n") >= x) & (F.col("n") <= WHOLE)).select(
        "rid", "n", "region", F.lit(0).alias("small"), F.explode(F.expr(f"slice(tokens, int(region) + 1, int(greatest(0L, n - int(ceil({percent} * n / 100.0D)) + 1 - region)))")).alias("t")
    )
    small = reps.filter(least_small).select("rid", "n", F.col("n").alias("region"), F.lit(1).alias("small"), F.explode("tokens").alias("t"))
    postings = large.unionByName(spare).unionByName(small).withColumn("key", F.shiftrightunsigned("t", 64 - bits) * 2 + F.col("small"))
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = postings.select("rid", "n", "region", "small", "key").join(counts, "key")
    counted = (F.col("small") == 1) | (F.shiftrightunsigned("key", bits + 1 - 8) < REGION)
    mine = Window.partitionBy("rid", "small")
    room = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("long") + 1 + F.col("small")
    ranked = shared.withColumn("known", counted).withColumn("place", F.row_number().over(mine.orderBy(F.col("known").desc(), "df", "key"))).withColumn("held", F.count(F.when(F.col("known"), 1)).over(mine))
    # with a partner that is no smaller a set shares a token of an even shorter head
    front = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)).cast("long") + 1 + F.col("small")
    lone = F.col("region") - F.col("held")
    counts_from = F.col("place") + lone
    heads = ranked.withColumn("at", F.when(F.col("known"), counts_from).otherwise(0)).filter(F.col("at") <= room)
    # outside the region the order is by hash alone, after all tokens of the region
    heads = heads.withColumn("front", F.when(F.col("known"), F.col("at") <= front).otherwise(F.col("region") < front))
    heads = cut(heads.select("rid", "n", "small", "key", "front"), "heads")
    single = heads.filter("small = 0").select("key", "rid", "n", "front")
    grouped = heads.filter("small = 1").groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("key", "front"))).alias("keys"))
    both = "flatten(transform(keys, (a, i) -> transform(slice(keys, i + 2, size(keys)), b -> struct(xxhash64(a.key, b.key) AS key, a.front AND b.front AS front))))"
    pairs = grouped.select("rid", "n", F.explode(F.expr(both)).alias("p")).select("p.key", "rid", "n", "p.front")
    return single.unionByName(pairs)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links lead to.

    Null texts and texts without words have no shingles, link with nothing and are components of their own. Shingles are compared by
    64-bit hashes, sets of equal rows by 128-bit signatures. Rows with a null id take part; such an id never names a component
    unless it has no other. Repeated rows are in one class. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = cut(rows.mapInArrow(_sets(width, percent), f"rid long, doc_id {kind}, th long, n long, region long, s1 long, s2 long, bits binary, tokens array<long>"), "sets")
    classes = cut(sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    copies = cut(sets.select("rid", "n", "s1", "s2").join(classes.filter("rows > 1"), ["n", "s1", "s2"]).filter("rid <> rep").select("rid"), "copies")
    reps = sets.filter("n > 0").join(small_side(copies), "rid", "left_anti")
    sizes = {r["n"]: r["c"] for r in classes.filter(F.col("n") <= WHOLE).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    lists = cut(lists_of(reps, boundary(sizes, percent), percent), "lists")
    alike = lambda n, m: (F.least(n, m) * 100 >= F.greatest(n, m) * percent)

    leaders = lists.groupBy("key").agg(F.min(F.struct("rid", "n")).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("key", "first")
    led = lists.join(leaders, "key").filter((F.col("rid") != F.col("first.rid")) & alike(F.col("n"), F.col("first.n")))
    best = led.groupBy("rid", F.col("first.rid").alias("b")).agg(F.count(F.lit(1)).alias("c")).groupBy("rid").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("best"))
    pairs = cut(best.select(F.col("rid").alias("a"), (-F.col("best.b")).alias("b")), "pairs")
    links = cut(_linked(rows, sets, pairs, width, percent), "links")
    joined = components(links)

    # what is left: members of one list that the first links leave in different components
    labelled = cut(lists.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("front").alias("any")).filter("lo < hi AND any").select("key")
    rest = labelled.join(mixed, "key", "left_semi")
    other = rest.select("key", F.col("rid").alias("b"), F.col("n").alias("m"), F.col("component").alias("there"))
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("rid") < F.col("b")))
    across = rest.filter("front").join(other, "key").filter(ordered & (F.col("component") != F.col("there")) & alike(F.col("n"), F.col("m")))
    more = across.select(F.col("rid").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    late = cut(_linked(rows, sets, more, width, percent), "links")
    if not late.isEmpty():
        joined = components(links.unionByName(late))

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select("n", "s1", "s2", "component_id")
    return sets.select("doc_id", "n", "s1", "s2").join(by_class, ["n", "s1", "s2"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _sets_of(rows: DataFrame, sets: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(rid, items): whole sets of the members of lists, from a second look at their texts alone."""
    wanted = cut(sets.join(members, "rid", "left_semi").select("rid", "th", "s1", "s2"), "wanted")
    texts = rows.select("th", "text").join(small_side(cut(wanted.select("th").distinct(), "texts")), "th", "left_semi")
    found = texts.select("text").mapInArrow(_full_sets(width), "s1 long, s2 long, items binary")
    return found.join(wanted, ["s1", "s2"]).groupBy("rid").agg(F.first("items").alias("items"))


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule them out."""
    with_a = pairs.join(sets.select(F.col("rid").alias("a"), "n", F.col("bits").alias("x")), "a")
    both = with_a.join(sets.select(F.col("rid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return both.mapInArrow(_near(percent), "a long, b long")


def _linked(rows: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    A set b goes to its partners once for about LED of them, and then to each by the partner's id, which spreads a hot b over the tasks.
    """
    left = cut(plausible(pairs, sets, percent), "plausible")
    ends = cut(left.select(F.col("a").alias("rid")).unionByName(left.select(F.col("b").alias("rid"))).distinct(), "members")
    full = cut(_sets_of(rows, sets, ends, width), "full")
    held = left.groupBy("b").agg(F.count(F.lit(1)).alias("held"))
    parted = left.join(held, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("held") / LED)).alias("part"))
    copies = parted.select("b", "part").distinct().join(full.withColumnsRenamed({"rid": "b", "items": "sb"}), "b")
    both = parted.join(copies, ["b", "part"]).join(full.withColumnsRenamed({"rid": "a", "items": "sa"}), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = w.doc_id
"""
