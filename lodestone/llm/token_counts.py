"""Token counts under a unigram vocabulary: a Viterbi pass that carries the best score and the number of pieces only.

An Aho-Corasick automaton yields every vocabulary piece that ends at a position; no lattice is kept and no path is traced
back. Ties follow the public unigram tokenizer: positions are taken from left to right, a later start replaces
an earlier one only if its score is greater, so of equal scores the longest last piece wins. A letter that is no piece
costs ten less than the worst piece and is spelled in byte pieces, or joins its unknown neighbours if there are none.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import chunks, table, text_or_empty, texts_of, word_hashes

WORD_START = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words a task remembers; an older memory is dropped as a whole.
REMEMBERED = 1 << 20


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces with their scores, and whether every byte is a piece, from a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    bytes_held = sum(model.is_byte(i) for i in ids)
    plain = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return plain, bytes_held == 256


def automaton(pieces: list[tuple[str, float]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for piece, score in pieces:
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found


class Counter:
    """Numbers of pieces of words; `pieces` must not be empty."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_held: bool):
        self.matches = automaton(pieces).iter
        self.bytes_held = bytes_held
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, text: str) -> int:
        """Pieces of a text that already has its word starts."""
        n = len(text)
        best, number = [0.0] * (n + 1), [0] * (n + 1)
        lone, fused = [True] * (n + 1), [False] * (n + 1)
        known_to = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.matches(text):
            ends[end + 1].append(piece)
            if piece[0] == 1:
                known_to[end + 1] = True
        for end in range(1, n + 1):
            top = None
            # from the earliest start on; the automaton gives the longest piece first
            for size, score in ends[end]:
                value = best[end - size] + score
                if top is None or value > top:
                    top, number[end], lone[end] = value, number[end - size] + 1, False
            if not known_to[end]:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, lone[end] = value, True
                    if self.bytes_held:
                        number[end] = number[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
                    else:
                        number[end] = number[end - 1] + (0 if end > 1 and fused[end - 1] else 1)
            fused[end] = lone[end]
            best[end] = top
        return number[n]

    def of(self, glued: bytes, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Pieces of each word of a byte string, words counted once each."""
        distinct, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        out = np.zeros(len(distinct), np.int64)
        if known.any():
            out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        for i in new.tolist():
            w = first[i]
            out[i] = self.count(WORD_START + glued[starts[w] : ends[w]].decode("utf-8", "replace"))
        if len(new):
            if len(self.hashes) + len(new) > REMEMBERED:
                self.hashes, self.counts = distinct, out
            else:
                keys = np.concatenate((self.hashes, distinct[new]))
                order = np.argsort(keys)
                self.hashes, self.counts = keys[order], np.concatenate((self.counts, out[new]))[order]
        return out[back]


def _counts(vocabulary):
    def run(batches_of):
        counter = Counter(*vocabulary.value)
        for batch in batches_of:
            texts = texts_of(batch, "text")
            tokens, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for rows, at, glued in chunks(texts):
                starts, ends, hashed = word_hashes(np.frombuffer(glued, np.uint8))
                row = rows[np.searchsorted(at, starts, side="right") - 1]
                words += np.bincount(row, minlength=len(texts))
                tokens += np.bincount(row, counter.of(glued, starts, ends, hashed), len(texts)).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens and n_words of the whole text.

    Words are runs without ASCII white space; each gets the word start in front and is cut into pieces by itself, as no piece
    of the vocabulary has a word start inside. Null and blank texts have no tokens. One scan, no shuffle; repeated rows
    are counted again, an empty table gives an empty result, other columns are ignored. A word of any length is one pass.
    """
    pieces, bytes_held = load_pieces(path)
    usable = [(p, s) for p, s in pieces if WORD_START not in p[1:]]
    vocabulary = docs.sparkSession.sparkContext.broadcast((usable, bytes_held))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counts(vocabulary), f"doc_id {kind}, n_tokens long, n_words long").withColumnRenamed("doc_id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
