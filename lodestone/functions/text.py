"""Text expressions: normal forms, tokens, sentences, snippets, readability."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import values as V

MARK = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row; an expression named inside a lambda would run per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm_text(c) -> Column:
    """Lower case, possessive before a blank removed, every run of other characters than a-z and 0-9 one blank."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    low = F.replace(F.replace(low, F.lit("'s "), F.lit(" ")), F.lit("’s "), F.lit(" "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Diacritics and every other non-ASCII character removed (no built-in function decomposes characters)."""
    def fold(v: str) -> str:
        return v if v.isascii() else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")

    return s.fillna("").map(fold)


def curie(c) -> Column:
    """Last path step of an address, its first underscore turned into a colon."""
    return F.regexp_replace(F.substring_index(_c(c), "/", -1), "^([^_]*)_", "$1:")


def xref_norm(c) -> Column:
    """One spelling for two prefixes that occur in two."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(c)), "^Orphanet:", "ORPHA:"), "^MSH:", "MESH:")


def tokenize(c) -> Column:
    """Lower-case alphanumeric tokens, duplicates kept."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), 0)


def content_tokens(c) -> Column:
    """Distinct tokens that are no stop words and longer than two characters, or numbers."""
    found = F.array_distinct(F.regexp_extract_all(
        F.lower(_c(c)), F.lit("[a-z0-9][a-z0-9\\-\\.α-ω]*[a-z0-9α-ω]|[a-z0-9]"), 0))
    stop = F.array(*[F.lit(w) for w in V.CONTENT_STOP])
    return F.filter(found, lambda w: (~F.array_contains(stop, w) & (F.length(w) > 2)) | w.rlike("^[0-9]+$"))


def query_tokens(c) -> Column:
    """Distinct tokens of at least two characters without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9][a-z0-9\\-]+"), 0))
    return F.array_except(found, F.array(*[F.lit(w) for w in V.SNIPPET_STOP]))


LIST_ITEM = r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+"
SENTENCE_END = r"""([.!?]["')\]]*(?:\s*\[\d{1,2}\])*)(?=\s|$)"""


def answer_pieces(c) -> Column:
    """Array of `(line, is_list, sep, unit)`: lines, those that are no list items cut further at sentence ends.

    A sentence end takes closing marks and citation markers that follow with it. Joining `sep` and `unit` of all pieces
    gives the text back; an empty line is a piece with an empty unit.
    """
    def cut_line(line: Column, i: Column) -> Column:
        is_list = line.rlike(LIST_ITEM)
        pieces = F.when(is_list, F.array(line)).otherwise(F.transform(
            F.split(F.regexp_replace(line, SENTENCE_END, "$1" + MARK), MARK), lambda p: F.trim(p)))
        full = F.filter(pieces, lambda p: F.trim(p) != "")
        full = F.when(F.size(full) == 0, F.array(F.lit(""))).otherwise(full)
        start = F.when(i == 0, "").otherwise("\n")
        return F.transform(full, lambda p, j: F.struct((i + 1).cast("int").alias("line"), is_list.alias("is_list"),
                                                       F.when(j == 0, start).otherwise(" ").alias("sep"), p.alias("unit")))

    return F.flatten(F.transform(F.split(_c(c), "\n"), cut_line))


def split_units(c) -> Column:
    """Array of `(line, is_list, unit)` without empty lines."""
    return F.transform(F.filter(answer_pieces(c), lambda p: p["unit"] != ""),
                       lambda p: F.struct(p["line"].alias("line"), p["is_list"].alias("is_list"), p["unit"].alias("unit")))


def word_count(c) -> Column:
    return F.size(F.filter(F.split(F.trim(_c(c)), r"\s+"), lambda w: w != ""))


def sentences(c) -> Column:
    """Sentences of a body: split after an end mark and blanks where a capital or a bracket follows."""
    return F.filter(F.transform(F.split(_c(c), r"(?<=[.!?])\s+(?=[A-Z(])"), lambda s: F.trim(s)), lambda s: s != "")


def best_snippet(body, question, max_chars: int = 320, short: int = 160) -> Column:
    """The sentence that shares most tokens with the question (the first on a tie), with the next one when it is
    short, cut at a blank near `max_chars`."""
    def pick(sents: Column, q: Column) -> Column:
        ranked = F.transform(sents, lambda s, i: F.struct(
            F.size(F.array_intersect(q, query_tokens(s))).alias("n"), (-i).alias("at")))
        return let(-F.array_max(ranked)["at"], lambda at: F.struct(F.get(sents, at).alias("first"), F.get(sents, at + 1).alias("after")))

    chosen = let(sentences(body), lambda sents: let(query_tokens(question), lambda q: pick(sents, q)))
    return let(chosen, lambda c: _cut_snippet(c["first"], c["after"], max_chars, short))


def _cut_snippet(first: Column, after: Column, max_chars: int, short: int) -> Column:
    snip = F.when((F.length(first) < short) & after.isNotNull(), F.concat(first, F.lit(" "), after)).otherwise(first)
    head = F.substring(snip, 1, max_chars)
    cut = F.when(head.contains(" "), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(snip) > max_chars, F.concat(cut, F.lit(" ..."))).otherwise(F.coalesce(snip, F.lit("")))


def sentence_count(c) -> Column:
    lines = F.filter(F.transform(F.split(_c(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(lines, F.lit(0), lambda acc, x: acc + 1 + F.regexp_count(x, F.lit(r"[.!?]\s+")))


def syllables(word: Column) -> Column:
    """Vowel groups, a silent final e not counted; a word has one at least."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & ~w.endswith("le") & ~w.endswith("ee") & (groups > 1)
    return F.when(w == "", 0).otherwise(F.greatest(groups - F.when(silent, 1).otherwise(0), F.lit(1)))


def readability_grade(c) -> Column:
    """Flesch-Kincaid grade, citation markers left out; 0 for a text without words."""
    text = F.regexp_replace(_c(c), r"\[e?\d+\]", "")
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'-]*"), 0)
    n, sents = F.size(words), sentence_count(text)
    syl = F.aggregate(words, F.lit(0), lambda acc, w: acc + syllables(w))
    return F.when((n > 0) & (sents > 0), 0.39 * n / sents + 11.8 * syl / n - 15.59).otherwise(F.lit(0.0))


def usable_terms(names) -> Column:
    """Names fit for a text search: blanks collapsed, lower case, a trailing "(disease)" removed, six characters or more."""
    clean = F.transform(_c(names), lambda n: F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(n)), r"\s+", " "), r"\s*\((?:disease|disorder)\)$", ""))
    return F.array_distinct(F.filter(clean, lambda n: F.length(n) >= 6))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined with a blank."""
    def grams(t: Column) -> Column:
        last = F.size(t) - (n - 1)
        return F.when(last >= 1, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        ).otherwise(F.array().cast("array<string>"))

    return tokens if n == 1 else let(tokens, grams)
