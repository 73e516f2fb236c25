"""Language-model scores, language ID, token counts and BPE against slow versions and the public libraries."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, language_id, lm_scoring, token_counts
from lodestone.llm.base import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow_scores(rows, nodes=lm_scoring.NODES):
    """(id -> n_tokens, n_known, base, score) from dictionaries, and the number of training tokens."""
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows}
    train = [t or "" for i, t in rows if not held[i]]
    count = Counter(w for t in train for w in [*words(t), None])
    total, v = sum(count.values()), len(count)
    order = lm_scoring.ORDER
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        b = b"\xff" * order + t.encode() + b"\xff"
        for p in range(order, len(b)):
            for k in range(order + 1):
                grams[k][b[p - k : p + 1]] += 1
    least = max(1, -(-sum(grams[0].values()) // nodes))
    children = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for g, n in grams[k].items():
            children[k].setdefault(g[:-1], {})[g[-1]] = n

    def p(context, symbol, k):
        if k < 0:
            return 1 / 256
        seen = children[k].get(context, {})
        n, q = sum(seen.values()), len(seen)
        if n < least:
            return p(context[1:], symbol, k - 1)
        kept = {s: c for s, c in seen.items() if c >= least}
        if symbol in kept:
            return kept[symbol] / (n + q)
        left = 1 - sum(p(context[1:], s, k - 1) for s in kept)
        return max(1 - sum(kept.values()) / (n + q), 1e-12) / max(left, 1e-12) * p(context[1:], symbol, k - 1)

    out = {}
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens)
        b = b"\xff" * order + (t or "").encode() + b"\xff"
        out[i] = (len(tokens), sum(count[w] > 0 for w in tokens), base, sum(math.log10(p(b[x - order : x], b[x], order)) for x in range(order, len(b))))
    return out, total


@pytest.mark.parametrize("nodes", [lm_scoring.NODES, 200])
def test_lm_scores_equal_slow_version(spark, docs, nodes):
    small = docs.select("doc_id", F.col("text").substr(1, 300).alias("text")).filter("doc_id < 40").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "日本 \x00 ÿ")], "doc_id long, text string"))
    rows = [tuple(r) for r in small.collect()]
    want, total = slow_scores(rows, nodes)
    for frequent in (4, lm_scoring.WORDS):
        for r in lm_scoring.lm_scores(small.withColumn("held_out", remainder(5) == 1), nodes=nodes, frequent_words=frequent).collect():
            n, known, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-4)


@pytest.mark.parametrize("sent", [1, 50, 5000])
def test_lm_scores_keep_rare_nodes(spark, docs, sent):
    # whatever part of the trie is sent to the tasks, every node counts
    small = docs.select("doc_id", F.col("text").substr(1, 300).alias("text")).filter("doc_id < 40").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "日本 \x00 ÿ")], "doc_id long, text string"))
    want, _ = slow_scores([tuple(r) for r in small.collect()], 1 << 40)
    found = lm_scoring.lm_scores(small.withColumn("held_out", remainder(5) == 1), frequent_nodes=sent).collect()
    assert len(found) == len(want)
    for r in found:
        assert r.score == pytest.approx(want[r.doc_id][3], rel=1e-4)


def test_lm_odd_rows(odd, none):
    frame = odd.withColumn("held_out", F.lit(False))
    assert lm_scoring.lm_scores(frame).count() == odd.count()
    assert lm_scoring.lm_scores(none.withColumn("held_out", F.lit(True))).count() == 0
    untrained = lm_scoring.lm_scores(odd.withColumn("held_out", F.lit(True)).filter("doc_id < 5")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert {r.doc_id: r.score for r in untrained}[3] == pytest.approx(-2 * math.log10(256))


def test_language_held_out_accuracy(docs):
    found = language_id.predict_language(language_id.with_fold(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(odd, none):
    found = {r.doc_id: r for r in language_id.predict_language(odd.withColumn("held_out", F.lit(False))).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[9].lang_pred == "und" and found[9].score == 0
    assert found[3].lang_pred in ("de", "en")
    assert language_id.predict_language(none.withColumn("held_out", F.lit(False))).count() == 0
    unlabelled = language_id.predict_language(odd.withColumn("held_out", F.lit(True)))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    single = language_id.predict_language(odd.filter("lang = 'en'").withColumn("held_out", F.lit(False)))
    assert {r.lang_pred for r in single.filter("doc_id = 7").collect()} == {"en"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20])
def test_codewords_lie_apart(n):
    code = language_id.codebook(n)
    least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
    assert least >= (1 if n == 2 else 2) and (n <= 3 or 2 * least >= code.shape[1] - 1)


def _library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _random_texts(letters, n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_bpe_equals_library(docs):
    path = bpe.vocabulary_path()
    library, encoder = _library(path), bpe.Encoder(bpe.load(path))
    texts = [r.text for r in docs.limit(60).collect()]
    texts += ["", " \n", "<|endoftext|>Hi<|startoftext|>", "ΣΑΣ İ ǅ", "a" * 3000, "ab" * 700, "it's I'LL 'd'", "é x\x85y\x1cz ​", "👍🏽 日本 ½ Ⅷ"]
    for text in texts + _random_texts("abcdefgh'!?.éñß 0123日Σ"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.ids_and_text(text) == (ids, library.decode(ids, skip_special_tokens=False))
    assert 0 < encoder.failed < encoder.speculated


def test_bpe_digests_and_odd_rows(odd, none):
    path = bpe.vocabulary_path()
    library = _library(path)
    for r in bpe.token_digests(odd, path, with_ids=True).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(none, path).count() == 0


def test_unigram_counts_equal_library(docs):
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers
    from tokenizers.models import Unigram

    pieces, held = token_counts.load_pieces(token_counts.vocabulary_path())
    usable = [x for x in pieces if token_counts.WORD_START not in x[0][1:]]
    counter = token_counts.Counter(usable, held)
    library = Tokenizer(Unigram([("<unk>", 0.0), *usable, *((f"<0x{i:02X}>", 0.0) for i in range(256))], unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Replace(Regex(r"[\x20\x09-\x0D]+"), " ")
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
    for text in [r.text for r in docs.limit(40).collect()] + _random_texts("abcdefgh'!?.éñß 0123日Σ😀"):
        assert sum(counter.count("▁" + w) for w in WORD.findall(text)) == len(library.encode(text, add_special_tokens=False).ids)


def test_unigram_ties_and_unknowns():
    # of equal scores the longest last piece wins, so three pieces a|b|c lose to a|bc
    counter = token_counts.Counter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0)], False)
    assert counter.count("abc") == 2
    # neighbours that are unknown are one piece without byte pieces, and spelled in bytes with them
    assert counter.count("a日本b") == 3
    assert token_counts.Counter([("a", -1.0)], True).count("a日") == 4


def test_unigram_odd_rows(odd, none):
    path = token_counts.vocabulary_path()
    found = {r.doc_id: r for r in token_counts.token_counts(odd, path).collect()}
    assert found[0].n_tokens == found[1].n_tokens == found[2].n_tokens == 0 and found[6].n_words == 120000
    assert token_counts.token_counts(none, path).count() == 0
