"""How far the sources of a language differ in their terms, with the terms found by iceberg prefix refinement.

A language keeps the terms of at least `least_docs` of its documents. They are found level by level: byte prefixes of
4, 8, 16, ... bytes are counted by distinct documents, prefixes below the threshold are thrown out, and only longer
prefixes of the ones that stay are looked at, until every kept prefix is a complete term. A rare long term thus drops
out at a short prefix and is never shuffled whole.

A task sees whole documents, so it counts the distinct documents of a prefix by itself and the sum over tasks is exact.
Those counts, and the occurrences by source, are written once in one pass over the texts, in parts of bounded size, dealt by
level; a level is read only to meet the prefixes that the level before left over.

Shares and divergences are whole numbers (parts of a thousand million), so results do not depend on the order of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.llm.base import segments, small_side, table

#: Every byte that is no letter A-Z, a-z and no part of a character beyond ASCII becomes a space, A-Z lower case.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of the shortest prefixes; every level doubles it.
FIRST = 4
#: Entries a task holds before it hands its counts on.
HELD = 1_000_000
#: Bytes of prefixes that may be sent to every task; beyond, prefixes are joined by a shuffle.
SENT = 32 << 20
#: Parts in a whole: shares are counted in these.
WHOLE = 1_000_000_000

_SCHEMA = pa.schema([("level", pa.int32()), ("lang", pa.string()), ("term", pa.binary()), ("done", pa.bool_()), ("n", pa.int64()), ("groups", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_COLUMNS = "level int, lang string, term binary, done boolean, n long, groups array<long>, counts array<long>"


class _Tally:
    """Counts of a task: documents by (level, complete or not, language) and prefix, occurrences by (language, group) and term."""

    def __init__(self, first: int):
        self.first, self.size = first, 0
        self.docs: dict[tuple[int, bool, str], Counter] = {}
        self.uses: dict[str, dict[int, Counter]] = {}

    def add(self, lang: str, group: int, text: bytes) -> None:
        own = self.uses.setdefault(lang, {}).setdefault(group, Counter())
        before = len(own)
        longer, level, width = set(), 0, self.first
        for part in segments(text):
            found = part.translate(TERMS).split()
            own.update(found)
            longer.update(found)
        self.size += len(own) - before
        while longer:
            level += 1
            terms, longer = longer, {t for t in longer if len(t) > width}
            for done, keys in ((True, terms - longer), (False, {t[:width] for t in longer})):
                if keys:
                    held = self.docs.setdefault((level, done, lang), Counter())
                    before = len(held)
                    held.update(keys)
                    self.size += len(held) - before
            width *= 2

    def drain(self) -> Iterator[pa.RecordBatch]:
        # by term: group, count, group, count, ...
        by_term: dict[str, dict[bytes, list[int]]] = {}
        for lang, groups in self.uses.items():
            held = by_term.setdefault(lang, {})
            for group, counts in groups.items():
                for term, n in counts.items():
                    if term in held:
                        held[term] += (group, n)
                    else:
                        held[term] = [group, n]
            groups.clear()
        for (level, done, lang), counts in self.docs.items():
            terms, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for at in range(0, len(terms), 1 << 15):
                part = terms[at : at + (1 << 15)]
                uses = [by_term[lang][t] for t in part] if done else []
                ends = np.zeros(len(part) + 1, np.int32)
                if done:
                    np.cumsum(np.fromiter(map(len, uses), np.int32, len(uses)) // 2, out=ends[1:])
                flat = np.fromiter(chain.from_iterable(uses), np.int64, 2 * int(ends[-1])).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(flat[:, i]))) for i in range(2)]
                same = pa.array(np.zeros(len(part), np.int32))
                columns = [pa.array(np.full(len(part), level, np.int32)), pa.DictionaryArray.from_arrays(same, pa.array([lang])).cast(pa.string()), pa.array(part, pa.binary()),
                           pa.array(np.full(len(part), done)), pa.array(n[at : at + (1 << 15)]), *lists]
                yield pa.record_batch(columns, schema=_SCHEMA)
        self.docs, self.uses, self.size = {}, {}, 0


def _counter(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(first)
        for batch in batches:
            langs, groups, texts = (batch.column(i) for i in range(3))
            for lang, group, text in zip(langs.to_pylist(), groups.to_pylist(), texts.cast(pa.large_binary()).to_pylist(), strict=True):
                tally.add(lang, group, text)
                if tally.size > HELD:
                    yield from tally.drain()
        yield from tally.drain()

    return run


def counted_prefixes(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """Partial counts of every task over `rows(lang, gid, text)`, written to the shared folder: `(level, lang, term, done, n, groups, counts)`.

    Level k counts documents by prefix of `first * 2^(k-1)` bytes, `done` where the prefix is a complete term, which then carries
    its occurrences by group. Prefixes that are not done count documents with a longer term.
    """
    return cut(rows.select("lang", "gid", "text").mapInArrow(_counter(first), _COLUMNS), "prefixes")


def iceberg_terms(counted: DataFrame, least_docs: int, first: int = FIRST) -> DataFrame:
    """`(lang, term, docs)`: the terms of at least `least_docs` documents of their language, by prefix refinement."""
    level, width, kept, alive = 1, first, [], None
    deepest = counted.agg(F.max("level")).first()[0] or 0
    while level <= deepest:
        rows = counted.filter(F.col("level") == level)
        if alive is not None:
            rows = rows.withColumn("head", F.substring("term", 1, width // 2)).join(small_side(alive, SENT // (width // 2 + 32)), ["lang", "head"], "left_semi")
        found = rows.groupBy("lang", "term", "done").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least_docs)
        found = cut(found, f"level{level}")
        kept.append(found.filter("done").select("lang", "term", "docs"))
        alive = found.filter("NOT done").select("lang", F.col("term").alias("head"))
        if alive.isEmpty():
            break
        level, width = level + 1, width * 2
    out = kept[0] if kept else counted.select("lang", "term", F.col("n").alias("docs")).filter("false")
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + terms)), exact beyond 64 bits."""
    wide = (count.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(WHOLE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + terms.cast("decimal(20,0)")
    return _div(wide, below) + F.lit(1).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _grouped(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct (lang, source) with a 64-bit number each, and the rows with theirs. Numbers are hashes; should two groups
    meet in one, another seed is taken."""
    pairs = cut(plain.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        gid = F.xxhash64(F.lit(seed), "lang", "source").alias("gid")
        if pairs.groupBy(gid).count().where("count > 1").isEmpty():
            return pairs.select("lang", "source", gid), plain.select("lang", gid, "text")
        seed += 1


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_terms: int = 200, first: int = FIRST
) -> DataFrame:
    """`(lang, source, part, item, value, rank)` for every (lang, source) that occurs.

    A language keeps the terms (runs of letters A-Z, lower-cased, and characters beyond ASCII) of at least `least_docs` of
    its rows. A group's share of a kept term is p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of kept terms, V
    the kept terms; two shares differ by floor((p - q)^2 / q). Part `pair`: item is each other source of the language, value
    the sum over all kept terms (0 if V = 0), every rank. Part `term`: item is a kept term that the group has and that is more
    frequent there than in the language, the `top_terms` greatest values. Ties are ranked by item in UTF-8 order.

    Null texts, languages and sources count as empty strings. A repeated row is one more document. Long texts are read
    whole. An empty table gives an empty result; a language with one source has no pairs; other columns are ignored.
    """
    names = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    groups, rows = _grouped(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in names)))
    counted = counted_prefixes(rows, first)
    kept = cut(iceberg_terms(counted, least_docs, first).withColumn("tid", F.monotonically_increasing_id()), "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    # from here on terms and groups are numbers
    uses = counted.filter("done").join(kept.select("lang", "term", "tid"), ["lang", "term"]).select("tid", F.inline(F.arrays_zip("groups", "counts")))
    uses = cut(uses.groupBy("tid", F.col("groups").alias("gid")).agg(F.sum("counts").alias("c")), "uses")
    held = uses.groupBy("gid").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("terms"))
    totals = groups.join(held, "gid", "left").join(sizes, "lang", "left")
    totals = totals.select("gid", "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "terms", "v")))
    # the share of a kept term that a group lacks; without kept terms there is no share
    totals = cut(totals.withColumn("base", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v")))), "totals")
    shares = uses.join(small_side(totals.select("gid", "n", "v", "base")), "gid")
    shares = cut(shares.select("tid", "gid", "c", _share(F.col("c"), F.col("n"), F.col("v")).alias("p"), "base"), "shares")
    return _pairs(shares, totals).unionByName(_terms(shares, kept, totals, top_terms))


def _pairs(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Divergence of a group from each other source of its language.

    The sum over all kept terms falls into terms that both have (one join on the term), terms that one has (its shares, few
    different numbers, against the other's base), less what both parts count twice, and terms that neither has.
    """
    left = shares.select("tid", F.col("gid").alias("ga"), F.col("p").alias("pa"), F.col("base").alias("ba"))
    right = shares.select("tid", F.col("gid").alias("gb"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    p, q, bp, bq = (F.col(c) for c in ("pa", "pb", "ba", "bb"))
    both = left.join(right, "tid").filter("ga < gb").groupBy("ga", "gb").agg(
        F.sum(_divergence(p, q) - _divergence(p, bq) - _divergence(bp, q)).alias("forth"),
        F.sum(_divergence(q, p) - _divergence(q, bp) - _divergence(bq, p)).alias("back"),
        F.count(F.lit(1)).alias("shared"),
    )
    both = both.select(F.explode(F.array(
        F.struct(F.col("ga").alias("gid"), F.col("gb").alias("other"), F.col("forth").alias("d"), "shared"),
        F.struct(F.col("gb").alias("gid"), F.col("ga").alias("other"), F.col("back").alias("d"), "shared"))).alias("x")).select("x.*")
    # equal shares of a group are one row with a count
    steps = cut(shares.groupBy("gid", "p").agg(F.count(F.lit(1)).alias("k")), "steps")
    own = totals.select("lang", "gid", "source", "terms", "v", "base")
    far = totals.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("terms").alias("others"), F.col("base").alias("other_base"))
    pairs = cut(own.join(far, "lang").filter("gid <> other"), "pairs")
    keys = ["gid", "other"]
    mine = steps.join(pairs, "gid").groupBy(*keys).agg(F.sum(_divergence(F.col("p"), F.col("other_base")) * F.col("k")).alias("mine"))
    theirs = steps.withColumnRenamed("gid", "other").join(pairs, "other").groupBy(*keys).agg(F.sum(_divergence(F.col("base"), F.col("p")) * F.col("k")).alias("theirs"))
    joined = pairs.join(both, keys, "left").join(mine, keys, "left").join(theirs, keys, "left").na.fill(0, ["d", "shared", "mine", "theirs"])
    neither = F.col("v") - F.col("terms") - F.col("others") + F.col("shared")
    rest = F.coalesce(neither * _divergence(F.col("base"), F.col("other_base")), F.lit(0))
    valued = joined.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("d") + F.col("mine") + F.col("theirs") + rest).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.withColumn("rank", rank)


def _terms(shares: DataFrame, kept: DataFrame, totals: DataFrame, top_terms: int) -> DataFrame:
    """The terms in which a group exceeds its language most."""
    whole = totals.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    usual = shares.groupBy("tid").agg(F.sum("c").alias("c")).join(kept, "tid").join(small_side(whole), "lang")
    usual = usual.select("tid", F.col("term").cast("string").alias("item"), _share(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    above = shares.join(usual, "tid").filter("p > q").select("gid", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return best.join(small_side(totals.select("gid", "lang", "source")), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0)::HUGEINT + v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // ((SELECT sum(n) FROM n WHERE n.lang = c.lang)::HUGEINT + (SELECT v FROM v WHERE v.lang = c.lang)) AS q FROM c GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - l.q) * (p.p - l.q) // l.q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.c > 0 AND p.p > l.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) r WHERE part = 'pair' OR rank <= 200
"""
