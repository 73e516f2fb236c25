"""Byte-pair encoding by speculation: longest matches are proposed, every adjacent pair is tested, failures are merged exactly.

A sequence of tokens is the encoding of a word if no merge ever crosses one of its boundaries. For a boundary this depends on
the two tokens beside it alone: on the symbols that stand left and right of it while the two tokens are built, each from
the merge that makes it until the merge that takes it up. All boundaries of a batch of words are tested at once, one
step along those two chains at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import table, text_or_empty

#: Characters of a text that are taken at once, cut before white space, and encoded words a task remembers.
PART, REMEMBERED = 1 << 19, 800_000
LAST = np.int64(1) << 40
#: A rank after all others, and the letter that marks the end of a word for the matcher.
NONE, MARK = (1 << 60, -1), "\x01"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the tasks need of a tokenizer file with word ends; arrays are by token id."""

    strings: list[str]
    left: np.ndarray
    right: np.ndarray
    born: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    pattern: str
    special: dict[str, int]
    ids: dict[str, int] = field(repr=False)
    merges: dict[tuple[int, int], tuple[int, int]] = field(repr=False)


def load(path: str) -> Vocabulary:
    """Read a tokenizer file: BPE with the word end `</w>`, byte-level letters, lower case, NFC.

    The rank of a merge is its place in the list; `born` is the rank that makes a token (-1 for single letters).
    """
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    model, letters = raw["model"], byte_letters()
    if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["dropout"]:
        raise ValueError("the file does not hold a BPE model with word ends")
    ids, n = model["vocab"], max(model["vocab"].values()) + 1
    ids_of = {a: int(b) for a, b in ids.items()}
    added = {x["content"]: x["id"] for x in raw["added_tokens"]}
    strings = [""] * max(n, *(i + 1 for i in added.values()))
    for a, b in [*ids.items(), *added.items()]:
        strings[b] = a
    left, right, born = (np.full(len(strings), -1, np.int64) for _ in range(3))
    keys, made, merges = [], [], {}
    for rank, (a, b) in enumerate(tuple(x.split(" ")) if isinstance(x, str) else x for x in model["merges"]):
        whole = ids_of[a + b]
        keys.append(ids_of[a] << 32 | ids_of[b])
        made.append(whole)
        merges.setdefault((ids_of[a], ids_of[b]), (rank, whole))
        if born[whole] < 0:
            left[whole], right[whole], born[whole] = ids_of[a], ids_of[b], rank
    keys = np.array(keys, np.int64)
    order = np.argsort(keys, kind="stable")
    pattern = next(x["pattern"]["Regex"] for x in raw["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    missing = [x for b in letters for x in (b, b + "</w>") if x not in ids_of]
    if missing:
        raise ValueError(f"the vocabulary lacks single letters: {missing[:4]}")
    return Vocabulary(strings, left, right, born, keys[order], order.astype(np.int64), np.array(made)[order], pattern, added, ids_of, merges)


def crossing(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a merge crosses the boundary between each token of `a` and the token of `b` after it."""
    a, b = a.copy(), b.copy()
    a_taken, b_taken = np.full(len(a), LAST), np.full(len(a), LAST)
    out, live = np.zeros(len(a), bool), np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        rank = np.where(v.pairs[at] == key, v.ranks[at], LAST)
        # of equal merges the leftmost goes first: the one inside the left token before ours, ours before the right token's
        bad = (rank < a_taken[live]) & (rank <= b_taken[live]) & (rank < LAST)
        out[live[bad]] = True
        live = live[~bad]
        x, y = a[live], b[live]
        # step back to before the later of the two merges
        back_a = (v.born[x] > v.born[y]) | ((v.born[x] == v.born[y]) & (v.born[x] >= 0))
        back_b = ~back_a & (v.born[y] >= 0)
        i, j = live[back_a], live[back_b]
        a_taken[i], a[i] = v.born[a[i]], v.right[a[i]]
        b_taken[j], b[j] = v.born[b[j]], v.left[b[j]]
        live = live[back_a | back_b]
    return out


def matcher(v: Vocabulary) -> ahocorasick.Automaton:
    """All tokens by their letters; a token that ends a word carries a mark after them."""
    found = ahocorasick.Automaton()
    for token, i in v.ids.items():
        found.add_word(token[: -len("</w>")] + MARK if token.endswith("</w>") else token, i)
    found.make_automaton()
    return found


def merge(v: Vocabulary, word: str) -> list[int]:
    """Exact encoding: always the merge of least rank, leftmost first. Long words keep their merges in a heap."""
    tokens = [v.ids[c] for c in word[:-1]] + [v.ids[word[-1] + "</w>"]]
    if len(tokens) > 40:
        return _merge_long(v, tokens)
    table = v.merges
    ranks = [table.get(pair, NONE) for pair in zip(tokens, tokens[1:])]
    while ranks:
        best = min(ranks)
        if best is NONE:
            break
        i = ranks.index(best)
        tokens[i : i + 2] = [best[1]]
        del ranks[i]
        if i:
            ranks[i - 1] = table.get((tokens[i - 1], best[1]), NONE)
        if i < len(ranks):
            ranks[i] = table.get((best[1], tokens[i + 1]), NONE)
    return tokens


def _merge_long(v: Vocabulary, tokens: list[int]) -> list[int]:
    table = v.merges
    after, before = [*range(1, len(tokens)), -1], list(range(-1, len(tokens) - 1))
    heap = [(*table[x, y], i, x, y) for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if (x, y) in table]
    heap = [(r, i, x, y, m) for r, m, i, x, y in heap]
    heapq.heapify(heap)
    while heap:
        _, i, x, y, m = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != x or j < 0 or tokens[j] != y:
            continue
        tokens[i], tokens[j], after[i] = m, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (pair := (tokens[k], tokens[after[k]])) in table:
                r, made = table[pair]
                heapq.heappush(heap, (r, k, *pair, made))
    return [t for t in tokens if t >= 0]


class Encoder:
    """Encodes and decodes the words of a task; words it has met are remembered, up to a number."""

    def __init__(self, v: Vocabulary):
        self.v, self.letters = v, str.maketrans({b: c for b, c in enumerate(byte_letters())})
        # a token that is not its own encoding never appears in one: it is crossed inside
        inner = v.born >= 0
        self.unreachable = np.zeros(len(v.born), bool)
        for i in np.flatnonzero(inner)[np.argsort(v.born[inner])]:
            self.unreachable[i] = self.unreachable[v.left[i]] or self.unreachable[v.right[i]]
        self.unreachable[inner] |= self._crossed_below(np.flatnonzero(inner))
        self.words, self.matcher = regex.compile(v.pattern), matcher(v)
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.known: dict[str, tuple[bytes, str, int]] = {}
        self.speculated = self.failed = 0

    def _crossed_below(self, tokens: np.ndarray) -> np.ndarray:
        """Whether another merge crosses the last join of each token before that join is made."""
        v = self.v
        a, b, own = v.left[tokens].copy(), v.right[tokens].copy(), v.born[tokens]
        a_taken, b_taken, out, live = own.copy(), own.copy(), np.zeros(len(tokens), bool), np.arange(len(tokens))
        first = np.ones(len(tokens), bool)
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
            rank = np.where(v.pairs[at] == key, v.ranks[at], LAST)
            bad = (rank < a_taken[live]) & (rank <= b_taken[live]) & ~(first[live] & (rank == own[live]))
            out[live[bad]] = True
            first[live] = False
            live = live[~bad]
            x, y = a[live], b[live]
            back_a = (v.born[x] > v.born[y]) | ((v.born[x] == v.born[y]) & (v.born[x] >= 0))
            back_b = ~back_a & (v.born[y] >= 0)
            i, j = live[back_a], live[back_b]
            a_taken[i], a[i] = v.born[a[i]], v.right[a[i]]
            b_taken[j], b[j] = v.born[b[j]], v.left[b[j]]
            live = live[back_a | back_b]
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word (in byte letters)."""
        propose = self.matcher.iter_long
        proposed, wrong = [], np.zeros(len(words), bool)
        for i, word in enumerate(words):
            at, tokens = -1, []
            for at, token in propose(word + MARK):
                tokens.append(token)
            wrong[i] = at != len(word)  # the end mark stands alone: a token without it took the last letter
            proposed.append(tokens)
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        wrong[owner[inside[crossing(self.v, flat[inside], flat[inside + 1])]]] = True
        wrong[owner[self.unreachable[flat]]] = True
        self.speculated += len(words)
        self.failed += int(wrong.sum())
        return [merge(self.v, w) if bad else p for w, p, bad in zip(words, proposed, wrong, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Remember ids as bytes, decoded text and number of tokens of words, with no words twice."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        in_letters = [w.encode().decode("latin-1").translate(self.letters) for w in new]
        strings = self.v.strings
        for word, tokens in zip(new, self.encode(in_letters), strict=True):
            self.known[word] = (struct.pack(f"<{len(tokens)}I", *tokens), " ".join([strings[t] for t in tokens]), len(tokens))

    def parts(self, text: str):
        """Word lists of a text, and special tokens between them."""
        at = 0
        for hit in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[at : hit.start()])
            yield self.v.special[hit.group()]
            at = hit.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str):
        at = 0
        while at < len(text):
            end = at + PART
            if end < len(text):
                space = regex.compile(r"[ \n\t]").search(text, end)
                end = space.start() if space else len(text)
            part = unicodedata.normalize("NFC", text[at:end])
            # lower case letter by letter, so without the final form of sigma
            yield self.words.findall(part.replace("Σ", "σ").lower())
            at = end

    def digests(self, texts: list[str]):
        """Number of tokens, SHA-256 of the ids and of the decoded text of each text; new words are learned a group of texts at a time."""
        group, total = [], 0
        for text in texts:
            if len(text) > PART:
                yield from self._group(group)
                group, total = [], 0
                yield self._digest(self.parts(text))
                continue
            group.append(list(self.parts(text)))
            total += len(text)
            if total > 2 * PART:
                yield from self._group(group)
                group, total = [], 0
        yield from self._group(group)

    def _group(self, group: list[list]):
        self.learn(set().union(*(p for parts in group for p in parts if not isinstance(p, int))))
        for parts in group:
            yield self._digest(parts)

    def _digest(self, parts) -> tuple[int, str, str]:
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for part in parts:
            if isinstance(part, int):
                found = [(np.array([part], "<u4").tobytes(), self.v.strings[part], 1)]
            elif part:
                try:
                    found = [self.known[w] for w in part]
                except KeyError:
                    self.learn(set(part))
                    found = [self.known[w] for w in part]
            else:
                continue
            ids.update(b"".join([f[0] for f in found]))
            decoded.update(((" " if n else "") + " ".join([f[1] for f in found])).encode())
            n += sum([f[2] for f in found])
        return n, ids.hexdigest(), decoded.hexdigest()

    def ids_of(self, text: str) -> np.ndarray:
        """The ids of a text."""
        found = [b""]
        for part in self.parts(text):
            if isinstance(part, int):
                found.append(np.array([part], "<u4").tobytes())
                continue
            self.learn(set(part))
            found += [self.known[w][0] for w in part]
        return np.frombuffer(b"".join(found), "<u4")

    def ids_and_text(self, text: str) -> tuple[list[int], str]:
        """The ids of a text and its decoded form."""
        ids = self.ids_of(text).tolist()
        return ids, decode(self.v, ids)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The tokens with one space between: the file names no decoder."""
    return " ".join([v.strings[i] for i in ids])


def _encoded(vocabulary, with_ids: bool):
    def run(batches_of):
        encoder = Encoder(vocabulary.value)
        for batch in batches_of:
            at = 0
            while at < batch.num_rows:
                # as many rows as hold some megabytes of text, so long texts do not add up
                part = batch.slice(at, 1)
                size = part.column("text")[0].as_py().__len__()
                end = at + 1
                while end < batch.num_rows and size < 4 * PART:
                    size += len(batch.column("text")[end].as_py())
                    end += 1
                part = batch.slice(at, end - at)
                texts = part.column("text").to_pylist()
                columns = [part.column("doc_id"), *(pa.array(x) for x in zip(*encoder.digests(texts), strict=True))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([encoder.ids_of(t) for t in texts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)
                at = end

    return run


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if wanted.

    Null texts count as empty: no tokens, digests of nothing. A scan without a shuffle; rows are independent, so ties, repeated rows and
    an empty table need no rule. Texts are taken in parts, a word of any length as a whole. Strings of special tokens in a text are
    these tokens. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty().alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_encoded(vocabulary, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("doc_id", id_col)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())
