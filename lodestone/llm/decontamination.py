"""Benchmark passages in documents by latent semantic retrieval.

The vocabulary is that of the benchmark, weighted by inverse document frequencies over all documents; other words weigh as its median
word and have no direction of their own. Every document is covered by half-overlapping windows of 16 and of 48 words. The cosine
with a benchmark item can't exceed the root of the share of a window's squared weight that lies in the vocabulary, so windows below
the bound are passed over exactly. The windows left and the items make the TF-IDF matrix whose leading right singular vectors a
randomised SVD finds in two distributed passes. Items weigh as much as all windows together, each of them, so every item has its
direction in the space and the windows fill the other dimensions. Windows near an item in that space are candidates. The longest
common subsequence of the item with the words around a candidate then decides, together with the item's answer. Large benchmarks
are taken in blocks of items, each with a space of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut, union_all
from lodestone.llm.base import LOWER, chunks, row_ids, table, text_or_empty, texts_of, word_hashes

SIZES = (16, 48)
#: Items of a block, dimensions of the space besides theirs, and columns of the range finder to spare.
BLOCK, EXTRA, SPARE = 256, 32, 16
#: Least cosine of a candidate; shares of an item's words in order that decide alone, or with the item's answer. Wherever a passage of 15
#: to 60 words lies, some window has a cosine of 0.71 with it if all its words weigh alike; the rest is room for uneven weights and changes.
COSINE, ALONE, WITH_ANSWER = 0.55, 0.8, 0.5
#: The benchmark is the small side: its texts together may hold so many bytes.
MOST_BYTES = 32 << 20
GROUP_BYTES = 2 << 20


@dataclass
class Benchmark:
    """Items as word numbers of their vocabulary, and the sorted hashes of the words."""

    ids: list
    items: list[np.ndarray]
    hashes: np.ndarray


def read_benchmark(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """All items that have words. The table's size is checked before it is gathered."""
    rows = benchmark.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > MOST_BYTES:
        raise ValueError(f"the benchmark holds {held} bytes; split it into tables of at most {MOST_BYTES}")
    found = sorted({(r["id"], bytes(r["text"])) for r in rows.collect()}, key=lambda x: (x[0] is None, x[0], x[1]))
    hashed = [word_hashes(LOWER[np.frombuffer(t, np.uint8)])[2] for _, t in found]
    hashes = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    kept = [(i, np.searchsorted(hashes, h)) for (i, _), h in zip(found, hashed, strict=True) if len(h)]
    return Benchmark([i for i, _ in kept], [h for _, h in kept], hashes)


def words_of(texts: list[bytes], hashes: np.ndarray):
    """Groups of texts: number of the first, words per text, and each word's number in the vocabulary (-1: not in it)."""
    at = 0
    while at < len(texts):
        total, end = len(texts[at]), at + 1
        while end < len(texts) and total + len(texts[end]) <= GROUP_BYTES:
            total += len(texts[end])
            end += 1
        counts, terms = np.zeros(end - at, np.int64), []
        for rows, starts_at, glued in chunks(texts[at:end]):
            starts, _, found = word_hashes(LOWER[np.frombuffer(glued, np.uint8)])
            counts += np.bincount(rows[np.searchsorted(starts_at, starts, side="right") - 1], minlength=end - at)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            terms.append(np.where(hashes[place] == found, place, -1))
        yield at, counts, np.concatenate(terms) if terms else np.zeros(0, np.int64)
        at = end


def _frequencies(hashes):
    """Numbers of texts that hold each word of the vocabulary."""

    def run(batches_of):
        known = hashes.value
        total = np.zeros(len(known), np.int64)
        for batch in batches_of:
            for _, counts, terms in words_of(texts_of(batch, "text"), known):
                row = np.repeat(np.arange(len(counts)), counts)
                inside = terms >= 0
                total += np.bincount(np.unique(row[inside] * len(known) + terms[inside]) % len(known), minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    return run


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last + 1 word of half-overlapping windows over texts that lie one after another."""
    step = size // 2
    each = np.where(counts > 0, np.maximum(1, -(-(counts - step) // step)), 0)
    row = np.repeat(np.arange(len(counts)), each)
    number = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    base = (np.cumsum(counts) - counts)[row]
    return row, base + number * step, base + np.minimum(counts[row], number * step + size)


def promising(counts, terms, weights, other, size, least):
    """Windows whose cosine with some item can reach `least`: row, first, last + 1, and norm. Every occurrence of a word counts."""
    squares = np.concatenate(([0.0], np.cumsum(np.where(terms >= 0, weights[terms], 0.0) ** 2)))
    outside = np.concatenate(([0], np.cumsum(terms < 0)))
    row, first, last = windows(counts, size)
    inner = squares[last] - squares[first]
    outer = (outside[last] - outside[first]) * other**2
    keep = (inner > 0) & (inner >= least**2 * (inner + outer))
    return row[keep], first[keep], last[keep], np.sqrt(inner + outer)[keep]


def inside(terms: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's words of windows, one window after another, and their number in each."""
    lengths = last - first
    owner = np.repeat(np.arange(len(first)), lengths)
    held = terms[np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + first[owner]]
    known = held >= 0
    return held[known], np.bincount(owner[known], minlength=len(first))


def _passages(model):
    def run(batches_of):
        hashes, weights, other, least = model.value
        for batch in batches_of:
            for _, counts, terms in words_of(texts_of(batch, "text"), hashes):
                _, first, last, _ = promising(counts, terms, weights, other, SIZES[-1], least)
                held, lengths = inside(terms, first, last)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(held, pa.int32()))], names=["terms"])

    return run


def rows_times(terms: np.ndarray, lengths: np.ndarray, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The TF-IDF rows, given as term lists, times a matrix."""
    if not len(terms):
        return np.zeros((len(lengths), right.shape[1]), right.dtype)
    product = right[terms] * weights[terms, None]
    out = np.add.reduceat(product, np.minimum(np.cumsum(lengths) - lengths, len(terms) - 1), axis=0)
    out[lengths == 0] = 0
    return out


def _gram(model):
    """Partial A^T (A X) over a task's rows of A, one output row per term."""

    def run(batches_of):
        weights, right = model.value
        total = np.zeros(right.shape, np.float64)
        for batch in batches_of:
            column = batch.column("terms")
            for at in range(0, batch.num_rows, 2000):
                part = column.slice(at, 2000)
                lengths = np.diff(part.offsets.to_numpy())
                terms = part.flatten().to_numpy()
                if not len(terms):
                    continue
                scale = np.sqrt(batch.column("share").slice(at, 2000).to_numpy())
                left = rows_times(terms, lengths, weights, right) * (scale**2)[:, None]
                owner = np.repeat(np.arange(len(lengths)), lengths)
                order = np.argsort(terms, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(terms[order]) > 0)))
                total[terms[order][first]] += np.add.reduceat(left[owner[order]] * weights[terms[order], None], first, axis=0)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["term", "values"])

    return run


def latent_space(passages: DataFrame, weights: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the weighted rows (terms, share) by a randomised range finder and one projection.

    Two passes over the rows; each task adds up its part of A^T A X, the parts are added by term.
    """
    spark, d = passages.sparkSession, len(weights)
    width = min(d, rank + SPARE)  # as many columns as the space gets, and some to spare
    fields = [F.sum(F.col("values")[j]).alias(f"c{j}") for j in range(width)]

    def gram(right: np.ndarray) -> np.ndarray:
        model = spark.sparkContext.broadcast((weights.astype(np.float32), right.astype(np.float32)))
        parts = passages.mapInArrow(_gram(model), "term int, values array<double>").groupBy("term").agg(*fields).toArrow()
        out = np.zeros((d, width))
        out[parts["term"].to_numpy()] = np.stack([parts[f"c{j}"].to_numpy() for j in range(width)], axis=1) if parts.num_rows else 0
        return out

    base, _ = np.linalg.qr(gram(np.random.default_rng(5).standard_normal((d, width))))
    values, vectors = np.linalg.eigh(base.T @ gram(base))
    return (base @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        match = row & places.get(w, 0)
        row = (row + match) | (row - match)
        row &= full
    return len(item) - row.bit_count()


def closest(item: np.ndarray, text: np.ndarray, least: int) -> int:
    """Most words of the item that some stretch of the text, half as long again as the item, holds in order; 0 if fewer than `least`.

    Neither the words that both hold nor the subsequence over the whole text can be fewer, so most texts need one look.
    """
    n = len(item)
    if int(np.isin(item, text).sum()) < least or common_words(item, text) < least:
        return 0
    size, step = n + n // 2, max(1, n // 4)
    best = max(common_words(item, text[at : at + size]) for at in range(0, max(1, len(text) - size + step), step))
    return best if best >= least else 0


def answer_of(item: np.ndarray) -> np.ndarray:
    """The last fifth of an item's words, three at least: what a question leads to."""
    return item[-max(3, len(item) // 5) :]


def _holds(text: np.ndarray, words: np.ndarray) -> bool:
    n, k = len(text), len(words)
    return n >= k and bool(np.logical_and.reduce([text[j : n - k + 1 + j] == words[j] for j in range(k)]).any())


def _search(model):
    def run(batches_of):
        hashes, weights, other, space, latent, norms, items, least, alone, with_answer = model.value
        start = 0
        for batch in batches_of:
            texts = texts_of(batch, "text")
            rids = row_ids(start, len(texts))
            start += len(texts)
            found: dict[tuple[int, int], tuple] = {}
            for at, counts, terms in words_of(texts, hashes):
                begin = np.cumsum(counts) - counts
                for size in SIZES:
                    row, first, last, norm = promising(counts, terms, weights, other, size, least)
                    for part in range(0, len(row), 4000):
                        a, b = first[part : part + 4000], last[part : part + 4000]
                        z = rows_times(*inside(terms, a, b), weights, space)
                        cosine = (z @ latent.T) / (norm[part : part + 4000, None] * norms[None, :])
                        pairs = np.argwhere(cosine >= least)
                        for w, i in pairs[np.argsort(-cosine[pairs[:, 0], pairs[:, 1]], kind="stable")].tolist():
                            r, n = row[part + w], len(items[i])
                            key = (at + int(r), i)
                            if key in found and found[key][0] == n:
                                continue
                            lo, hi = max(begin[r], a[w] - n), min(begin[r] + counts[r], b[w] + n)
                            best = closest(items[i], terms[lo:hi], int(np.ceil(with_answer * n)))
                            if best < with_answer * n:
                                continue
                            told = _holds(terms[lo:hi], answer_of(items[i]))
                            if best >= alone * n or told:
                                value = (best, n, float(cosine[w, i]), told, int(lo - begin[r]), int(hi - begin[r]))
                                if key not in found or value[:1] > found[key][:1]:
                                    found[key] = value
            keys = sorted(found)
            yield pa.record_batch(
                {
                    "rid": pa.array([rids[k[0]] for k in keys], pa.int64()),
                    "doc_id": batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                    "item": pa.array([k[1] for k in keys], pa.int32()),
                    "common": pa.array([found[k][0] for k in keys], pa.int64()),
                    "item_words": pa.array([found[k][1] for k in keys], pa.int64()),
                    "cosine": pa.array([min(1.0, found[k][2]) for k in keys], pa.float64()),
                    "answer_found": pa.array([found[k][3] for k in keys], pa.bool_()),
                    "start_word": pa.array([found[k][4] for k in keys], pa.int64()),
                    "end_word": pa.array([found[k][5] for k in keys], pa.int64()),
                }
            )

    return run


RESULT = "doc_id {0}, item_id {1}, common long, item_words long, cosine double, answer_found boolean, start_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", extra: int = EXTRA, cosine: float = COSINE, alone: float = ALONE, with_answer: float = WITH_ANSWER) -> DataFrame:
    """A row per document and benchmark item that it leaks: id, item_id, common (words of the item in order), item_words, cosine,
    answer_found, and the words between which the passage lies.

    Documents without a leak have no row; so have null and empty texts. A benchmark that is empty, or whose items are null or blank,
    gives an empty result. Items of equal id and text count once; repeated documents are reported again. Lower case A-Z; other columns
    are ignored. Three scans of the texts a block of items; only the block and the latent space of its vocabulary go to every task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    bench = read_benchmark(benchmark, item_col)
    if not bench.items:
        return spark.createDataFrame([], RESULT.format(*kinds)).withColumnRenamed("doc_id", id_col)
    n_docs = rows.count()
    found = [_leaks(rows, bench, at, n_docs, extra, (cosine, alone, with_answer)) for at in range(0, len(bench.items), BLOCK)]
    names = spark.createDataFrame([(i, x) for i, x in enumerate(bench.ids)], f"item int, item_id {kinds[1]}")
    return union_all(found).join(names, "item").select(F.col("doc_id").alias(id_col), "item_id", "common", "item_words", "cosine", "answer_found", "start_word", "end_word")


def _leaks(rows: DataFrame, bench: Benchmark, begin: int, n_docs: int, extra: int, limits: tuple[float, float, float]) -> DataFrame:
    """The leaks of a block of items, which are numbered from `begin`."""
    spark = rows.sparkSession
    words = [bench.hashes[x] for x in bench.items[begin : begin + BLOCK]]
    hashes = np.unique(np.concatenate(words))
    items = [np.searchsorted(hashes, x) for x in words]
    seen = rows.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(hashes)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(hashes))
    df[seen["term"].to_numpy()] = seen["n"].to_numpy()
    weights = np.log((n_docs + 1) / (df + 1)) + 0.1
    other = float(np.median(weights))
    lengths, flat = np.array([len(x) for x in items]), np.concatenate(items)
    norms = np.sqrt(np.add.reduceat(weights[flat] ** 2, np.cumsum(lengths) - lengths))
    model = spark.sparkContext.broadcast((hashes, weights, other, limits[0]))
    passages = cut(rows.select("text").mapInArrow(_passages(model), "terms array<int>"), "passages")
    held = passages.agg(F.sum(F.size("terms"))).first()[0] or 0
    own = spark.createDataFrame([(x.tolist(), float(max(1.0, held * other**2 / n**2))) for x, n in zip(items, norms, strict=True)], "terms array<int>, share double")
    space = latent_space(passages.withColumn("share", F.lit(1.0)).unionByName(own), weights, len(items) + extra)
    latent = rows_times(flat, lengths, weights, space)
    search = spark.sparkContext.broadcast((hashes, weights, other, space, latent, norms, items, *limits))
    hits = rows.mapInArrow(_search(search), f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, item int, common long, item_words long, cosine double, answer_found boolean, start_word long, end_word long")
    return hits.withColumn("item", F.col("item") + F.lit(begin))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
