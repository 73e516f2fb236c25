"""Language-model scores by prediction by partial matching over bytes, beside a word-unigram base.

Training texts are counted as byte grams of six (a symbol after its five-byte context); the trie of all shorter
contexts follows by dropping the oldest byte. A node is a symbol in a context. PPM method C gives a context of n
occurrences and q different symbols the escape q / (n + q). Symbols of the longer context are excluded after an escape:
the shorter context's distribution is divided by what it leaves to other symbols. A text ends in byte 0xFF, which UTF-8
never uses, and begins after five of them, so the probabilities of all texts add up to one.

Every node and context of the training bytes is kept, as written tables. Those that make up 1 / `frequent_nodes` of all training
bytes or more go to every task. The grams of a text that this part lacks are joined with the tables: most are nodes of the
longest context; what no training text holds is taken once per distinct gram through the shorter contexts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.llm.base import LOWER, SEGMENT, Tally, batches, chunks, mix, remainder, row_ids, table, text_or_empty, texts_of, word_hashes

ORDER = 5
END = b"\xff"
#: Nodes of the trie, per order, and words whose values every task holds at most; both follow from thresholds on counts, the rest is joined.
NODES = 1 << 20
WORDS = 1 << 18
#: Bytes of text whose scores leave a task together.
GROUP_BYTES = 8 << 20
_MASKS = [np.uint64((1 << (8 * k)) - 1) for k in range(ORDER + 2)]


class Lookup:
    """Numbers by 64-bit key in open addressing; keys are not 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = keys[left[take]], values[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 if absent) and whether it is there."""
        at = self.slot(keys)
        held = self.keys[at]
        hit = held == keys
        out = np.where(hit, self.values[at], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]], hit[left[same]] = self.values[at[left[same]]], True
            left = left[~same & (held != 0)]
        return out, hit


def windows(texts: list[bytes], size: int = SEGMENT):
    """Codes of the six bytes that end at each scored byte, with the row of each; a chunk holds about `size` bytes."""
    rows, parts, total = [], [], 0
    for i, text in enumerate(texts):
        whole = END * ORDER + text + END
        for at in range(0, len(text) + 1, size):
            parts.append(whole[at : at + size + ORDER])
            rows.append(i)
            total += len(parts[-1])
            if total > size:
                yield _codes_of(rows, parts)
                rows, parts, total = [], [], 0
    if parts:
        yield _codes_of(rows, parts)


def _codes_of(rows, parts):
    buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    two = (buf[:-1] << np.uint64(8)) | buf[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    six = (four[:-2] << np.uint64(16)) | two[4:]
    lengths = np.array([len(p) for p in parts])
    scored = np.ones(len(buf), bool)
    first = np.cumsum(lengths) - lengths
    for j in range(ORDER):
        scored[first + j] = False
    return np.repeat(rows, lengths - ORDER), six[scored[ORDER:]]


COUNTS = pa.schema([("word", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])


def _count(batches_of):
    """Counts of a task's training texts: byte grams, and words by hash."""
    grams, words = Tally(), Tally()
    for batch in batches_of:
        texts = texts_of(batch, "text")
        for _, codes in windows(texts):
            grams.add(codes)
        for _, _, glued in chunks(texts):
            words.add(word_hashes(LOWER[np.frombuffer(glued, np.uint8)])[2])
    for word, tally in ((False, grams), (True, words)):
        keys, n = tally.result()
        yield from batches(COUNTS, [np.full(len(keys), word), keys.view(np.int64), n])


def code_length(codes: np.ndarray, model: Lookup) -> np.ndarray:
    """log10 probability of each code's last byte after the bytes before it."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    for k in range(ORDER, -1, -1):
        now = codes[left] & _MASKS[k + 1]
        value, hit = model.find(now | np.uint64((k + 1) << 56))
        out[left] += value
        left, now = left[~hit], now[~hit]
        if not len(left):
            return out
        out[left] += model.find((now >> np.uint64(8)) | np.uint64((k + 17) << 56))[0]
    out[left] -= np.log10(256)
    return out


SCORED = "rid long, doc_id {0}, held_out boolean, n_tokens long, n_known long, known double, score double, light array<long>, times array<int>, grams array<long>, gram_times array<int>"


def _lists(row: np.ndarray, keys: np.ndarray, m: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Per row, its distinct keys and how often it has each."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])))) if len(row) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=m)))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(keys[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(row))), pa.int32()))


def _groups(texts: list[bytes]):
    """Bounds of runs of texts of about GROUP_BYTES."""
    at = 0
    while at < len(texts):
        total, end = len(texts[at]), at + 1
        while end < len(texts) and total + len(texts[end]) <= GROUP_BYTES:
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def _score(model, frequent, whole):
    """Per text: tokens, the frequent ones' part of the base and of the model's score, and the other words and grams with their counts.

    `whole`: the model holds every node, so that a gram it lacks is in no training text.
    """

    def run(batches_of):
        ppm, heavy, start = model.value, frequent.value, 0
        for batch in batches_of:
            held = texts_of(batch, "text")
            for begin, end in _groups(held):
                texts = held[begin:end]
                m = len(texts)
                tokens, n_known, known, score = np.ones(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
                rare = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                grams = list(rare)
                for rows, codes in windows(texts):
                    if whole:
                        score += np.bincount(rows, code_length(codes, ppm), m)
                        continue
                    value, hit = ppm.find(codes | np.uint64((ORDER + 1) << 56))
                    score += np.bincount(rows, value, m)
                    grams.append((rows[~hit], codes[~hit]))
                for rows, at, glued in chunks(texts):
                    starts, _, hashed = word_hashes(LOWER[np.frombuffer(glued, np.uint8)])
                    row = rows[np.searchsorted(at, starts, side="right") - 1]
                    value, hit = heavy.find(hashed)
                    tokens += np.bincount(row, minlength=m)
                    n_known += np.bincount(row[hit], minlength=m)
                    known += np.bincount(row[hit], value[hit], m)
                    rare.append((row[~hit], hashed[~hit]))
                light, times = _lists(*(np.concatenate(x) for x in zip(*rare, strict=True)), m)
                other, gram_times = _lists(*(np.concatenate(x) for x in zip(*grams, strict=True)), m)
                yield pa.record_batch(
                    {
                        "rid": pa.array(row_ids(start, m), pa.int64()),
                        "doc_id": batch.column("doc_id").slice(begin, m),
                        "held_out": batch.column("held_out").slice(begin, m),
                        "n_tokens": pa.array(tokens),
                        "n_known": pa.array(n_known),
                        "known": pa.array(known),
                        "score": pa.array(score),
                        "light": light,
                        "times": times,
                        "grams": other,
                        "gram_times": gram_times,
                    }
                )
                start += m

    return run


def train_counts(rows: DataFrame) -> DataFrame:
    """Counts of grams and words over all rows with a binary `text`: word, key, n."""
    summed = rows.select("text").mapInArrow(_count, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))
    return cut(summed, "counts")


def trie(grams: DataFrame, least: int = 1) -> DataFrame:
    """(key, value, n) from counts of six-byte grams (key, n): log10 probabilities of symbols and log10 weights of escapes.

    Keys are codes tagged with the order: k + 1 for the nodes of contexts of k bytes, k + 17 for these contexts. Nodes and contexts
    of fewer than `least` occurrences are left to the escapes.
    """
    by_level = grams.select("n", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("level"), "key").select("n", F.expr("(key & (shiftleft(1L, 8 * (level + 1)) - 1)) | shiftleft(level + 1L, 56)").alias("key"))
    levels = cut(by_level.groupBy("key").agg(F.sum("n").alias("n")), "levels")
    code = F.expr("key & (shiftleft(1L, 56) - 1)")
    context = F.shiftrightunsigned(code, 8).bitwiseOR(F.shiftleft(F.shiftrightunsigned("key", 56) + F.lit(16), 56))
    # a context has 256 symbols at most
    of = Window.partitionBy("context")
    nodes = levels.withColumn("context", context).withColumn("total", F.sum("n").over(of)).withColumn("q", F.count(F.lit(1)).over(of))
    nodes = cut(nodes.filter(F.col("n") >= least).select("key", "context", "n", "total", "q"), "nodes")
    contexts = levels.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("q")).filter(F.col("total") >= least) if least > 1 else None
    p = F.col("n") / (F.col("total") + F.col("q"))
    # after an escape the shorter context gives its symbols; those of this context are excluded
    shorter = F.expr("(key & (shiftleft(1L, int(8 * (shiftrightunsigned(key, 56) - 1))) - 1)) | shiftleft(shiftrightunsigned(key, 56) - 1, 56)")
    lower = nodes.filter(F.shiftrightunsigned("key", 56) <= ORDER).select(F.col("key").alias("lower"), p.alias("below"))
    under = nodes.select("context", "total", p.alias("p"), shorter.alias("lower")).join(lower, "lower", "left")
    sums = under.groupBy("context").agg(F.max("total").alias("n"), F.sum("p").alias("given"), F.sum(F.coalesce("below", F.lit(1 / 256))).alias("below"))
    if contexts is not None:
        sums = contexts.join(sums, "context", "left").select("context", F.col("total").alias("n"), F.coalesce("given", F.lit(0.0)).alias("given"), F.coalesce("below", F.lit(0.0)).alias("below"))
    escape = F.log10(F.greatest(1 - F.col("given"), F.lit(1e-12)) / F.greatest(1 - F.col("below"), F.lit(1e-12)))
    values = nodes.select("key", F.log10(p).cast("float").alias("value"), "n").unionByName(sums.select(F.col("context").alias("key"), escape.cast("float").alias("value"), "n"))
    return cut(values, "trie")


def _joined_score(scored: DataFrame, values: DataFrame) -> DataFrame:
    """(rid, joined): the log10 probabilities of the grams that were not scored in the tasks."""
    pending = scored.select("rid", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("rid", F.col("g.grams").alias("code"), F.col("g.gram_times").alias("times"))
    longest = values.filter(F.shiftrightunsigned("key", 56) == ORDER + 1).select(F.col("key").bitwiseAND(F.lit((1 << 56) - 1)).alias("code"), "value")
    first = pending.join(longest, "code", "left")
    hits = first.filter("value IS NOT NULL").groupBy("rid").agg(F.sum(F.col("times") * F.col("value").cast("double")).alias("joined"))
    missed = cut(pending.join(longest, "code", "left_anti"), "missed")
    # the shorter nodes and all contexts of each distinct gram
    node = F.expr(f"transform(sequence(0, {ORDER - 1}), k -> (code & (shiftleft(1L, 8 * (k + 1)) - 1)) | shiftleft(k + 1L, 56))")
    context = F.expr(f"transform(sequence(0, {ORDER}), k -> shiftrightunsigned(code & (shiftleft(1L, 8 * (k + 1)) - 1), 8) | shiftleft(k + 17L, 56))")
    keys = missed.select("code").distinct().select("code", F.explode(F.concat(node, context)).alias("key"))
    tag = F.shiftrightunsigned("key", 56).cast("int")
    found = keys.join(values.select("key", "value"), "key").select("code", tag.alias("tag"), F.col("value").cast("double").alias("value"))
    best = F.max(F.when(F.col("tag") <= ORDER, F.struct("tag", "value")))
    by_code = found.groupBy("code").agg(best.alias("best"), *[F.max(F.when(F.col("tag") == k + 17, F.col("value"))).alias(f"e{k}") for k in range(ORDER + 1)])
    depth = F.coalesce(F.col("best.tag"), F.lit(0))
    total = F.coalesce(F.col("best.value"), F.lit(-float(np.log10(256))))
    for k in range(ORDER + 1):
        total += F.when(depth <= k, F.coalesce(F.col(f"e{k}"), F.lit(0.0))).otherwise(0.0)
    late = missed.join(by_code.select("code", total.alias("value")), "code", "left").groupBy("rid").agg(F.sum(F.col("times") * F.coalesce("value", F.lit(-float(np.log10(256))))).alias("joined"))
    return hits.unionByName(late).groupBy("rid").agg(F.sum("joined").alias("joined"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", nodes: int | None = None, frequent_words: int = WORDS, frequent_nodes: int = NODES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    `docs` has the id, text and a boolean held_out; rows not held out are learned from. A null text counts as empty: it
    has the end token only. Repeated rows are learned from and scored as often as they occur. Without training rows the
    model is uniform over 256 bytes and every base term is 0. Words are told apart by 64-bit hashes. All nodes of the trie
    are used; a caller may set `nodes` to leave those rarer than 1 / `nodes` of the training bytes to the escapes. Counts of words that
    make up 1 / `frequent_words` of the training tokens or more (at most `frequent_words` of them) go to every task; all others
    are joined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty().cast("binary").alias("text"), "held_out")
    counts = train_counts(rows.filter("NOT held_out"))
    grams, words = counts.filter("NOT word").select("key", "n"), counts.filter("word").select("key", "n")
    n_docs = rows.filter("NOT held_out").count()
    facts = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (facts["n"] or 0) + n_docs, facts["v"] + (n_docs > 0)
    least = max(1, -(-total // frequent_words))
    heavy = words.filter(F.col("n") >= least).toArrow()
    n_bytes = grams.agg(F.sum("n")).first()[0] or 0
    rarest = max(1, -(-n_bytes // nodes)) if nodes else 1
    sent = max(rarest, -(-n_bytes // frequent_nodes))
    values = trie(grams, rarest)
    top = values.filter(F.col("n") >= sent).select("key", "value").toArrow()
    model = spark.sparkContext.broadcast(Lookup(top["key"].to_numpy().view(np.uint64), top["value"].to_numpy()))
    frequent = spark.sparkContext.broadcast(Lookup(heavy["key"].to_numpy().view(np.uint64), np.log10(heavy["n"].to_numpy() + 0.5)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = cut(rows.mapInArrow(_score(model, frequent, sent <= rarest), SCORED.format(kind)), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("light", "times")).alias("w")).select("rid", F.col("w.light").alias("key"), F.col("w.times").alias("times"))
    found = (
        rare.join(words.filter(F.col("n") < least), "key")
        .groupBy("rid")
        .agg(F.sum("times").alias("rare_known"), F.sum(F.expr("times * log10(n + 0.5D)")).alias("rare_sum"))
    )
    end = int(n_docs > 0)
    joined = scored.drop("light", "times", "grams", "gram_times").join(found, "rid", "left")
    joined = joined.join(_joined_score(scored, values), "rid", "left") if sent > rarest else joined.withColumn("joined", F.lit(0.0))
    n_known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(end)
    logs = F.col("known") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(float(np.log10(n_docs + 0.5))) + (F.col("n_tokens") - F.lit(1) - (n_known - F.lit(end))) * F.lit(float(np.log10(0.5)))
    return joined.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        n_known.cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        (F.col("score") + F.coalesce("joined", F.lit(0.0))).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").withColumn("held_out", remainder(5) == 1))
