"""Helpers shared by the corpus operators: table access, byte buffers and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; longer texts are cut at white space.
SEGMENT = 1 << 20
#: The ASCII white space of the contracts: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + (SEGMENT >> 2))
        pair = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = pair
    return _powers[0][:n], _powers[1][:n]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words (maximal runs without ASCII white space) of a byte array."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    edge = np.diff(np.concatenate(([False], ~SPACE[buf], [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_codes[buf] * power, out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(hashed + (ends - starts).astype(np.uint64))


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Parts of at most `size` bytes, cut before white space; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\n", at + 1, at + size))
        if cut <= at:
            after = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
            if not after:
                break
            cut = min(after)
        yield text[at:cut]
        at = cut
    yield text[at:]


def chunks(texts: list[bytes], size: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts glued with a line end after each, in chunks of about `size` bytes.

    Yields row numbers, the offset at which each part begins, and the bytes. A long text is spread over several chunks.
    """
    rows, parts, total = [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text, size) if len(text) > size else (text,):
            if total and total + len(part) > size:
                yield _glued(rows, parts)
                rows, parts, total = [], [], 0
            rows.append(i)
            parts.append(part)
            total += len(part) + 1
    if parts:
        yield _glued(rows, parts)


def _glued(rows: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    lengths = np.array([len(p) + 1 for p in parts])
    return np.array(rows), np.cumsum(lengths) - lengths, b"\n".join(parts) + b"\n"


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def row_ids(start: int, n: int) -> np.ndarray:
    """Ids of rows that are unique over all tasks of a stage."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 33) + np.arange(start, start + n, dtype=np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several (keys, counts) with their summed counts, in order of the keys."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


class Tally:
    """Counts of 64-bit keys in a task; partial counts are merged whenever they have doubled."""

    def __init__(self, limit: int = 4_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit, self.most = 0, limit, limit

    def add(self, keys: np.ndarray) -> None:
        part = counted(keys)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self.parts = [merged(self.parts)]
            self.size = len(self.parts[0][0])
            self.most = 2 * self.size + self.limit

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.parts)


def batches(schema: pa.Schema, columns: list[np.ndarray], size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Arrays as record batches of bounded size."""
    for at in range(0, len(columns[0]), size):
        yield pa.record_batch([pa.array(c[at : at + size], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of few narrow rows, marked for broadcast after they were counted; beyond `most` rows the join is left to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
