"""Periodic runs of words by internal pattern matching: dyadic blocks, wavelet-tree range successor, progressions.

A run is a maximal stretch of words with smallest period q and at least three periods (and `least` words). The texts of a
batch are laid end to end, words of different texts never being equal, and sorted by prefix doubling: after k rounds a
position carries the name of its factor of 2^k words, which is also the place where the suffixes that begin with this factor start
in the suffix array.

A run of period q holds a block of B words (a power of two, B <= q < 2B, the least block 8) at a multiple of B together with
its copy q words on. So every such block asks for its occurrences in the neighbouring window: range successor
queries over a wavelet tree of the positions in suffix order, restricted to the block's stretch of the array. One or two
occurrences give their distances as candidates. Three or more within B starts form a progression, whose difference p is
the block's own period; a longer period that carries the block along then carries along an end of the stretch of period p
too, so the distances between the ends of the two stretches are the candidates. Candidates are extended both ways with the
names of the factors; of one stretch the smallest period stays.

NumPy on Arrow batches; a text is never divided, so memory grows with the longest text (some 40 bytes a word and round).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.base import mix, segments, table, text_or_empty, texts_of, word_hashes

#: Words of the smallest block, as a power of two.
LEAST_ROUND = 3
#: Bytes of text sorted together; a longer text is sorted alone.
TOGETHER = 1 << 20


class WaveletTree:
    """Order statistics on ranges of an array of whole numbers below 2^bits, as one bit vector a level."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(self.size + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, self.size - int(before[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range [lo, hi) are less than x."""
        whole, found = hi - lo, np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            lo1, hi1 = before[lo], before[hi]
            up = (x >> bit & 1).astype(bool)
            found += np.where(up, (hi - lo) - (hi1 - lo1), 0)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return np.where(x >> self.bits > 0, whole, found)

    def ranked(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            lo1, hi1 = before[lo], before[hi]
            low = (hi - lo) - (hi1 - lo1)
            up = k >= low
            k = np.where(up, k - low, k)
            value = np.where(up, value | 1 << bit, value)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return value


class Factors:
    """Names of all factors of 2^k items, for every k up to the longest repeat, and the suffix array.

    `codes` ends in a code that occurs once, so no factor that repeats reaches over the end. The name of a factor is the
    first slot of the suffixes that begin with it.
    """

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int64)
        key, slots, positions, names = codes[self.order], np.arange(n), self.order, np.zeros(n, np.int64)
        self.names: list[np.ndarray] = []
        #: Slots whose factor of 2^LEAST_ROUND items occurs again.
        self.repeated = np.zeros(0, np.int64)
        reach = 1
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            starts = np.flatnonzero(new)
            names = names.copy()
            names[positions] = slots[starts[np.cumsum(new) - 1]]
            again = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
            slots, positions = slots[again], positions[again]
            if not len(slots):
                break
            self.names.append(names.astype(np.int32))
            if len(self.names) == LEAST_ROUND + 1:
                self.repeated = slots
            key = names[positions] * n + names[positions + reach]
            by_key = np.argsort(key)
            key, positions = key[by_key], positions[by_key]
            self.order[slots] = positions
            reach *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items agree from a and b on (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            length += (self.names[k][a + length] == self.names[k][b + length]).astype(np.int64) << k
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items agree before a and b (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            at = a - length - (1 << k)
            same = (at >= 0) & (self.names[k][at] == self.names[k][b - length - (1 << k)])
            length += same.astype(np.int64) << k
        return length

    def stretch(self, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch with period d around a and a + d."""
        return a - self.backward(a, a + d), a + d + self.forward(a, a + d)


def runs_of(codes: np.ndarray, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs of a sequence of codes, by start and period.

    A run has three periods at least, and `least` items (24 at least).
    """
    # a code that no other item has closes the sequence
    factors = Factors(np.append(np.unique(codes, return_inverse=True)[1] + 1, 0))
    none = np.zeros(0, np.int64)
    if not len(factors.repeated):
        return none, none, none
    places = np.sort(factors.order[factors.repeated])
    tree = WaveletTree(np.searchsorted(places, factors.order[factors.repeated]))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(LEAST_ROUND, len(factors.names)):
        block = 1 << k
        names = factors.names[k]
        sizes = np.bincount(names[places], minlength=factors.n)
        starts = places[places % block == 0]
        starts = starts[sizes[names[starts]] > 1]
        if not len(starts):
            continue
        lo = np.searchsorted(factors.repeated, names[starts])
        hi = lo + sizes[names[starts]]
        for near, far in ((1, block), (block, 2 * block)) if k == LEAST_ROUND else ((block, 2 * block),):
            found.extend(_candidates(factors, tree, places, starts, lo, hi, near, far))
    start, end, period = (np.concatenate([f[i] for f in found]) if found else none for i in range(3))
    fits = end - start >= np.maximum(max(least, 24), 3 * period)
    start, end, period = start[fits], end[fits], period[fits]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # of one stretch the smallest period stays
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _candidates(factors: Factors, tree: WaveletTree, places: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: int, far: int) -> Iterator[tuple]:
    """Stretches (start, end, period) from occurrences of the blocks at `starts`, `near` to `far` - 1 items after them."""
    before = tree.below(lo, hi, np.searchsorted(places, starts + near))
    ahead = []
    for more in range(3):
        there = before + more < hi - lo
        place = places[tree.ranked(lo, hi, np.minimum(before + more, hi - lo - 1))]
        ahead.append(np.where(there & (place < starts + far), place - starts, 0))
    one, two, three = ahead
    tries = [(starts, one), (np.where(three == 0, starts, 0), np.where(three == 0, two, 0))]
    many = three > 0
    if many.any():
        at, step, first = starts[many], (two - one)[many], one[many]
        left, right = factors.stretch(at, step)
        left2, right2 = factors.stretch(at + first, step)
        tries += [(at, left2 - left), (at, right2 - right)]
    for at, d in tries:
        good = (d >= near) & (d < far)
        if good.any():
            a, q = at[good], d[good]
            start, end = factors.stretch(a, q)
            yield start, end, q


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text."""
    return np.concatenate([word_hashes(np.frombuffer(part, np.uint8))[2] for part in segments(text)])


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats."""
    keep, at = [], 0
    for start, end in sorted((s + q, e) for s, e, q in runs):
        if start > at:
            keep.extend(words[at:start])
        at = max(at, end)
    return b" ".join(keep + words[at:])


def _sorted_together(texts: list[bytes], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, period) of every text."""
    hashed = [_words(t) for t in texts]
    ends = np.cumsum([len(h) for h in hashed])
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(h) for h in hashed])
    codes = mix(np.concatenate(hashed) + owner * np.uint64(0x9E3779B97F4A7C15)) if texts else np.zeros(0, np.uint64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in runs_of(codes, least)), strict=True):
        i = int(np.searchsorted(ends, s, side="right"))
        base = int(ends[i - 1]) if i else 0
        out[i].append((s - base, e - base, q))
    return out


def _runner(schema: pa.Schema, least: int):
    def part(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        split = [t.split() for t in texts]
        wanted = [i for i, w in enumerate(split) if len(w) >= least]
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, own in zip(wanted, _sorted_together([texts[i] for i in wanted], least), strict=True):
            runs[i] = own
        listed = [[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in runs]
        collapsed = [_collapsed(w, r) for w, r in zip(split, runs, strict=True)]
        columns = [ids, pa.array([len(w) for w in split], pa.int64()), pa.array(listed, schema.field(2).type), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch, "text")
            at = size = 0
            for i, text in enumerate(texts):
                if size and size + len(text) > TOGETHER:
                    yield part(ids[at:i], texts[at:i])
                    at, size = i, 0
                size += len(text)
            if texts:
                yield part(ids[at:], texts[at:])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24) -> DataFrame:
    """One row per row of `docs`: id, n_words, runs (array of start, length, period by start, then period), collapsed.

    Words are runs without ASCII white space, told apart by 64-bit hashes; words differ in case. A run is a maximal stretch
    of words with smallest period q, three periods and `least` words long at least (24 is the smallest `least`). `collapsed`
    holds the words, joined by one space, without those that a run contains after its first period. Null, empty and blank
    texts have no words, no runs and an empty `collapsed`. Repeated rows and null ids keep their rows; an empty table gives
    an empty result; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = plain.schema["id"].dataType
    columns = f"id {kind.simpleString()}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    schema = to_arrow_schema(StructType.fromDDL(columns))
    return plain.mapInArrow(_runner(schema, least), columns).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first (runs come by start, then period)."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def _planter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rest, text in zip(batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True):
            words = text.split() if rest % 10 == 0 else []
            if words:
                n, g = len(words), rest // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
            out.append(text)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def planted(docs: DataFrame) -> DataFrame:
    """`(doc_id, text)`: every tenth text, by the hash of its id, is periodic from some word on; see the query's contract."""
    plain = docs.select("doc_id", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), text_or_empty().alias("text"))
    return plain.mapInArrow(_planter, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Runs are islands of equal words at one distance; positions meet on twelve-word factors, since a run repeats five of them at least.
OP11_SQL = r"""
WITH c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))),
    lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295) AS h,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS r FROM c),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) ELSE w END AS w FROM a),
e AS (SELECT doc_id, unnest(range(n - 11)) AS i, unnest(list_transform(range(n - 11), lambda i: hash(w[i + 1 : i + 12]))) AS f FROM d WHERE n >= 24),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 12 + q - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, (length::DECIMAL(38,0) * 1000000000000 // period, -start, -period)) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, list({'s': start + period, 'e': start + length}) AS drops FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(d.w[i + 1], ' ' ORDER BY i) AS kept FROM (SELECT d.doc_id, d.w, unnest(range(n)) AS i FROM d) d LEFT JOIN t ON t.doc_id = d.doc_id
  WHERE t.doc_id IS NULL OR len(list_filter(t.drops, lambda x: i >= x.s AND i < x.e)) = 0 GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
