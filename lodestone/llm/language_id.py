"""Language identification with error-correcting output codes.

Every language has a codeword of signs. One binary classifier per bit, naive Bayes over byte bigrams (exact) and byte
trigrams (hashed), tells the languages of sign +1 from those of sign -1. A text's scaled margins are decoded by the
codeword with the least loss, each bit weighted by how often it was right for that language on the training rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.llm.base import chunks, remainder, row_ids, table, text_or_empty, texts_of

PAIRS, TRIPLES = 1 << 16, 1 << 17
FEATURES = PAIRS + TRIPLES
#: A text whose best language scores less is ambiguous.
AMBIGUOUS = 0.5


def grams(buf: np.ndarray) -> np.ndarray:
    """Feature numbers of the bigram and of the trigram that begin at each byte but the last two, in two rows."""
    b = buf.astype(np.uint32)
    pair = (b[:-2] << np.uint32(8)) | b[1:-1]
    triple = (((pair << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 17)
    return np.stack((pair, triple + np.uint32(PAIRS)))


def codebook(n: int) -> np.ndarray:
    """Signs, languages by bits. Up to six languages take every split in two, more take rows of a Hadamard matrix."""
    if n <= 6:
        rest = [set(c) for k in range(1, n) for c in combinations(range(1, n), k)]
        return np.array([[-1 if i in s else 1 for s in rest] for i in range(n)], dtype=np.int8).reshape(n, len(rest))
    signs = np.ones((1, 1), np.int8)
    while len(signs) < 2 * n:
        signs = np.block([[signs, signs], [signs, -signs]])
    code = signs[1 : n + 1, 1:]
    return code[:, np.abs(code.sum(axis=0)) < n]


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-ratio of each feature for each bit; languages weigh alike whatever their number of texts."""
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    out = np.empty((counts.shape[1], code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        out[:, j] = np.log(share[code[:, j] > 0].mean(axis=0)) - np.log(share[code[:, j] < 0].mean(axis=0))
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _count(batches_of):
    """Feature counts of a task's labelled texts, by language."""
    held: dict[str, np.ndarray] = {}
    for batch in batches_of:
        langs, texts = batch.column("lang").to_pylist(), texts_of(batch, "text")
        for lang in dict.fromkeys(langs):
            mine = [t.lower() for t, x in zip(texts, langs, strict=True) if x == lang]
            into = held.setdefault(lang, np.zeros(FEATURES, np.int64))
            for _, _, glued in chunks(mine):
                if len(glued) > 2:
                    for row in grams(np.frombuffer(glued, np.uint8)):
                        into += np.bincount(row, minlength=FEATURES)
    for lang, into in held.items():
        at = np.flatnonzero(into)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at, pa.int32()), "n": pa.array(into[at], pa.int64())})


def _margins(weights):
    """Mean log-ratio per feature and bit of every text."""

    def run(batches_of):
        w, start = weights.value, 0
        bits = w.shape[1]
        for batch in batches_of:
            texts = texts_of(batch, "text")
            sums, n = np.zeros((len(texts), bits)), np.zeros(len(texts))
            for rows, at, glued in chunks([t.lower() for t in texts]):
                buf = np.frombuffer(glued, np.uint8)
                if len(buf) < 3 or not bits:
                    continue
                codes = grams(buf)
                at = np.minimum(at, codes.shape[1] - 1)
                lengths = np.diff(np.append(at, codes.shape[1]))
                for j in range(bits):
                    column = w[:, j]
                    both = column[codes[0]] + column[codes[1]]
                    np.add.at(sums[:, j], rows, np.add.reduceat(both, at, dtype=np.float64) * (lengths > 0))
                np.add.at(n, rows, lengths)
            means = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
            yield pa.record_batch(
                {
                    "rid": pa.array(row_ids(start, len(texts)), pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang": batch.column("lang"),
                    "letters": pa.array([has_letter(t) for t in texts], pa.bool_()),
                    "margins": pa.array(list(means), pa.list_(pa.float32())),
                }
            )
            start += len(texts)

    return run


def decode(margins: np.ndarray, code: np.ndarray, scale: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Share of each language: softmax of the negative weighted logistic losses against its codeword."""
    z = np.clip(3.0 * margins / scale, -30, 30)
    loss = np.stack([(trust[c] * np.logaddexp(0, -z * code[c])).sum(axis=1) for c in range(len(code))], axis=1)
    loss -= loss.min(axis=1, keepdims=True)
    share = np.exp(-4.0 * loss)
    return share / share.sum(axis=1, keepdims=True)


def predict_language(docs: DataFrame, train: str = "NOT held_out", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (0 to 1), second, ambiguous.

    `docs` has the id, text, lang and a boolean held_out; rows that satisfy `train` and have a language are learned
    from, all of them. A text that is null or has no letter is `und` with score 0, as is every text when no language
    was labelled. With one label all other texts get it. Ties go to the label that sorts first. The model has
    a fixed number of features and one count vector per label, so what the driver gathers does not grow with the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty().cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), "held_out")
    labelled = rows.filter(f"({train}) AND lang IS NOT NULL").select("text", "lang")
    counted = labelled.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts = np.zeros((len(langs), FEATURES))
    counts[np.searchsorted(langs, counted["lang"]) if langs else [], counted["feature"]] = counted["n"]
    code = codebook(len(langs))
    weights = spark.sparkContext.broadcast(bit_weights(counts, code) if langs else np.zeros((FEATURES, 0), np.float32))
    seen = cut(
        rows.mapInArrow(_margins(weights), f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, letters boolean, margins array<float>"),
        "margins",
    )
    # how large margins are, and how often each bit is right for each language, on the training rows
    bits = seen.filter(f"({train}) AND lang IS NOT NULL AND letters").select("lang", F.posexplode("margins").alias("bit", "m"))
    facts = bits.groupBy("lang", "bit").agg(F.avg(F.abs("m")).alias("size"), F.avg((F.col("m") > 0).cast("double")).alias("up"), F.avg((F.col("m") < 0).cast("double")).alias("down")).toPandas()
    scale, trust = np.ones(code.shape[1]), np.full(code.shape, 1.0 / max(1, code.shape[1]))
    if len(facts) and code.shape[1]:
        scale = np.maximum(facts.groupby("bit")["size"].mean().reindex(range(code.shape[1]), fill_value=1.0).to_numpy(), 1e-6)
        right = np.full(code.shape, 0.5)
        for f in facts.itertuples():
            c = langs.index(f.lang)
            right[c, f.bit] = f.up if code[c, f.bit] > 0 else f.down
        trust = np.maximum(right, 1e-3)
        trust = trust / trust.sum(axis=1, keepdims=True)

    def label(frames):
        for frame in frames:
            n, best, top, second = len(frame), np.zeros(len(frame), int), np.zeros(len(frame)), [None] * len(frame)
            if n and langs:
                share = decode(np.array(frame["margins"].tolist(), dtype=float).reshape(n, -1), code, scale, trust)
                best, top = share.argmax(axis=1), share.max(axis=1)
                if len(langs) > 1:
                    share[np.arange(n), best] = -1
                    second = [langs[i] for i in share.argmax(axis=1)]
            known = frame["letters"].to_numpy(bool) & bool(langs)
            frame["lang_pred"] = [langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            frame["score"] = np.where(known, top, 0.0)
            frame["second"] = pd.Series([s if k else None for s, k in zip(second, known, strict=True)], dtype=object, index=frame.index)
            frame["ambiguous"] = known & (top < AMBIGUOUS)
            yield frame[["doc_id", "held_out", "lang_pred", "score", "second", "ambiguous"]]

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = seen.select("doc_id", "held_out", "margins", "letters").mapInPandas(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double, second string, ambiguous boolean")
    return out.withColumnRenamed("doc_id", id_col)


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", remainder(4) == 2)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return predict_language(with_fold(table(spark, sf_dir, "documents")))
