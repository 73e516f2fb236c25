"""Names of a dictionary in texts, by tries that are spread over partitions.

Names are dealt by the word they begin with, several parts where many begin alike. A text goes only to the parts that hold one of
its words as a first word, in portions of bounded size, and every task walks the trie of its part over its texts. No
n-gram is ever a row: what is shuffled are texts per part, and what comes back are the names found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut

#: Names in a trie and texts in a task, about.
NAMES, TEXTS = 50_000, 5_000
#: Letters by which one-word names are dealt if words may go on after the name.
STEM = 6


class Trie:
    """Nested dictionaries of words; a node that ends a name holds it under None."""

    def __init__(self, names: list[str], prefix: bool):
        self.root: dict = {}
        self.prefix = prefix
        for name in names:
            node = self.root
            for word in name.split(" "):
                node = node.setdefault(word, {})
            node[None] = name

    def found(self, words: list[str]) -> Iterator[str]:
        """The distinct names in a list of words. With `prefix`, a name's last word may be the beginning of a word."""
        seen = set()
        for start in range(len(words)):
            node = self.root
            for word in words[start:]:
                if self.prefix:
                    for n in range(1, len(word)):
                        ends = node.get(word[:n])
                        if ends is not None and None in ends:
                            seen.add(ends[None])
                node = node.get(word)
                if node is None:
                    break
                if None in node:
                    seen.add(node[None])
        return iter(seen)


def find_names(texts: DataFrame, names: DataFrame, key: str = "doc_id", prefix: bool = False, per_part: int = NAMES, per_task: int = TEXTS) -> DataFrame:
    """`(<key>, phrase)`: every name that occurs in a text at word borders, once per key.

    `texts(<key>, norm)` and `names(phrase)` are normalised, words apart by one blank. With `prefix`, the last word of a name
    may go on in the text, and names have `STEM` characters at least. Null and empty texts and names never match;
    of rows with one key the names are put together; a text of any length is read whole.
    """
    phrase = F.col("phrase")
    first = F.substring_index(phrase, " ", 1)
    known = names.select("phrase").where(F.length("phrase") >= (STEM if prefix else 1)).distinct()
    if prefix:
        # a one-word name can begin within a longer word, so it is dealt by its first letters
        alone = ~phrase.contains(" ")
        first = F.when(alone, F.concat(F.lit("\n"), F.substring(phrase, 1, STEM))).otherwise(first)
    known = cut(known.withColumn("first", first), "names")
    sizes = known.groupBy("first").agg(F.ceil(F.count("*") / per_part).cast("int").alias("subs"))
    n = known.count()
    parts = max(1, math.ceil(n / per_part))
    sizes = sizes.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts)))
    sub = F.pmod(F.xxhash64("phrase"), F.col("subs")).cast("int")
    dealt = known.join(sizes, "first").select("part", F.when(F.col("subs") > 1, F.struct("first", sub.alias("sub"))).alias("hot"), "phrase")
    texts = cut(texts.select(key, "norm").where("norm <> ''").withColumn("row", F.monotonically_increasing_id()), "texts")
    words = F.split("norm", " ")
    if prefix:
        stems = F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.lit("\n"), F.substring(w, 1, STEM)))
        words = F.concat(words, stems)
    asked = texts.select("row", F.explode(F.array_distinct(words)).alias("first")).join(sizes, "first")
    hot = F.when(F.col("subs") > 1, F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda s: F.struct("first", s.alias("sub"))))
    plain = F.array(F.lit(None).cast("struct<first:string,sub:int>"))
    asked = asked.select("row", "part", F.explode(F.coalesce(hot, plain)).alias("hot")).distinct()
    asked = cut(asked, "asked")
    needed = asked.groupBy("part", "hot").agg(F.ceil(F.count("*") / per_task).cast("int").alias("portions"))
    needed = cut(needed.withColumn("where", F.xxhash64("part", "hot.first", "hot.sub")), "needed")
    same = lambda a, b: (a["part"] == b["part"]) & a["hot"].eqNullSafe(b["hot"])
    sent = asked.alias("a").join(needed.alias("n"), same(asked, needed)).select("row", "where", F.pmod(F.xxhash64("row"), F.col("portions")).cast("int").alias("portion"))
    sent = sent.join(texts, "row").select("where", "portion", key, "norm")
    held = dealt.join(needed, same(dealt, needed)).select(
        (F.col("where") + 0).alias("where"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), "phrase")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: left[key][:0], "phrase": pd.Series([], dtype=object)})
        trie = Trie(right["phrase"].tolist(), prefix)
        hits = [(i, name) for i, text in enumerate(left["norm"]) for name in trie.found(text.split(" "))]
        at = np.array([i for i, _ in hits], int)
        return pd.DataFrame({key: left[key].iloc[at].reset_index(drop=True), "phrase": pd.Series([name for _, name in hits], dtype=object)})

    kind = texts.schema[key].dataType.simpleString()
    found = sent.groupBy("where", "portion").cogroup(held.groupBy("where", "portion")).applyInPandas(walk, f"{key} {kind}, phrase string")
    return found.distinct()
