"""Exact duplicates through an extendible-hash index kept in shared files.

DataFrame functions only. The index holds one page row per document (id, 64-bit key, SHA-256, length), never the
text. A directory of key prefixes is doubled until no bucket holds more distinct keys than its capacity; a task owns
a range of keys. Keys that several rows share are chains: their texts are grouped by their bytes, so texts that meet
under one key by chance stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(entries: DataFrame, capacity: int, deepest: int = 60) -> tuple[DataFrame, int]:
    """Directory of an extendible hash: prefix at the global depth -> bucket (its smallest prefix, depth).

    Doubling goes on while a bucket holds more than `capacity` distinct keys. A bucket takes the smallest depth at
    which it fits, so sparse prefixes share one.
    """
    total = entries.count()
    depth = max(1, math.ceil(math.log2(max(1, total / capacity))))
    while True:
        prefix = F.shiftrightunsigned("key", 64 - depth)
        held = cut(entries.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("keys")), "directory")
        most = held.agg(F.max("keys")).first()[0] or 0
        if most <= capacity or depth >= deepest:
            break
        depth += 1
    levels = held.select("prefix", "keys", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("local")).withColumn(
        "owner", F.expr(f"shiftright(prefix, {depth} - local)")
    )
    fits = levels.groupBy("local", "owner").agg(F.sum("keys").alias("held")).filter((F.col("held") <= capacity) | (F.col("local") == depth))
    leaves = levels.join(fits, ["local", "owner"]).groupBy("prefix").agg(F.min(F.struct("local", "owner")).alias("leaf"))
    return leaves.select("prefix", F.expr(f"shiftleft(leaf.owner, {depth} - leaf.local)").alias("bucket"), F.col("leaf.local").alias("depth")), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, key_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, after normalisation; the smallest id of a group stays. Null texts count as
    empty texts. Rows with a null id are grouped too and stay only if their group has no id; of repeated rows with
    one id and one text a single row is kept. An empty table gives an empty result; other columns are ignored.
    `key_bits` below 64 weakens the key on purpose, to exercise long chains.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    key = F.xxhash64("body")
    if key_bits < 64:
        key = F.shiftleft(key, 64 - key_bits)
    pages = cut(rows.select("id", key.alias("key"), F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), F.octet_length("body").alias("bytes")), "pages")
    entries = cut(pages.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "entries")
    index, depth = directory(entries, capacity)
    # the owner of a bucket holds a range of keys; keys of one row need no chain
    owned = entries.filter("n > 1").withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(index, "prefix").select("key", "bucket")
    owned = cut(owned.repartition("bucket").sortWithinPartitions("bucket", "key"), "chains")
    # equal bytes fall together before the shuffle, so a text that fills a third of the table costs a row per task
    links = rows.withColumn("key", key).join(owned, "key").groupBy("bucket", "key", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chains = cut(links.select("key", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "keep_id", "group_size"), "links")
    # repeated rows are told apart by id before the join, so that no step after it needs a chain in one task
    same = Window.partitionBy("id", "key", "sha").orderBy("bytes")
    found = pages.withColumn("copy", F.row_number().over(same)).join(chains, ["key", "sha"], "left")
    kept = (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
