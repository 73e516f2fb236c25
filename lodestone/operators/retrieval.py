"""Hybrid retrieval over a text corpus for many queries at once, with gates, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut, top_n, union_all
from lodestone.functions import text as X
from lodestone.functions.rules import any_case
from lodestone.operators import textindex as T
from lodestone.operators import vectors as V
from lodestone.operators.dictionary import find_names

# fixed value: rank constant of the fusion
RRF_K = 60


def build_postings(docs: DataFrame) -> DataFrame:
    """`(doc_id, term, tf, dl)` of `docs(doc_id, text)`, each text tokenised once."""
    return T.exploded(T.token_counts(docs))


def term_weights(postings: DataFrame, n_docs: Column) -> DataFrame:
    """`(term, df, idf)`: Okapi inverse document frequency; a negative one is replaced by a quarter of the mean."""
    return T.idf_of(postings.groupBy("term").agg(F.count("*").alias("df")), n_docs)


def bm25_topk(queries: DataFrame, index: T.TextIndex, k: int = 50, counts: dict | None = None) -> DataFrame:
    """`(query_id, doc_id, score, rank)` of `queries(query_id, text)` against an index, see `textindex.search`."""
    return T.search(queries, index, k, counts=counts)


def scoped_topk(queries: DataFrame, index: T.TextIndex, scope: DataFrame, k: int = 50, counts: dict | None = None) -> DataFrame:
    """As `bm25_topk`, restricted to each query's scope before the cut."""
    return T.search(queries, index, k, scope, counts)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_n(scores, "query_id", [F.col("score").desc(), "doc_id"], k, "rank")


def dense_topk(queries: DataFrame, vectors: DataFrame | V.VectorIndex, k: int = 50, block: int = V.BLOCK, counts: dict | None = None) -> DataFrame:
    """`(query_id, doc_id, score, rank)`: exact inner product of `queries(query_id, vec)` with `vectors(doc_id, vec)` or an index of them."""
    index = vectors if isinstance(vectors, V.VectorIndex) else V.build_vectors(vectors, block)
    return V.nearest(queries, index, k, counts)


def centroid(vectors: DataFrame, key: str | None = None) -> DataFrame:
    """Unit-length mean vector, of all rows or per key."""
    by = [key] if key else []
    mean = vectors.select(*by, F.posexplode("vec").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    arr = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x * x))
    return arr.withColumn("n", norm).select(*by, F.transform("m", lambda x: x / F.col("n")).alias("vec"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def centroid_similarity(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """`(query_id, similarity)` to the normalised mean of the corpus."""
    placed = queries.select("query_id", "vec").withColumn("middle", centroid(vectors).scalar())
    return placed.select("query_id", dot("vec", "middle").alias("similarity"))


def entity_scope(ids: DataFrame, family: DataFrame, mentions: DataFrame, docs: DataFrame, names: DataFrame, min_docs: int = 3,
                 max_depth: int = 4, headings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of each entity, and the way they were found: `(id, doc_id)` and `(id, method, n_docs)`.

    Mentions of the entity and its subtypes down to `max_depth`; with fewer than `min_docs` of them, also documents whose title
    or one of whose controlled terms holds a name; still fewer, whose text does. Entities that stay below `min_docs` search
    everything and have no rows. `mentions(doc_id, entity)`, `docs(doc_id, title, text)`, `names(id, name)`, `headings(doc_id, term)`.
    """
    want = ids.select("id").distinct()
    near = family.where(F.col("dist") <= max_depth).join(want, "id", "left_semi").select("id", F.col("member").alias("entity"))
    graph = near.join(mentions, "entity").select("id", "doc_id").distinct()
    size = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    few = want.join(size(graph, "n"), "id", "left").where(F.coalesce("n", F.lit(0)) < min_docs).select("id")
    terms = names.join(few, "id", "left_semi").groupBy("id").agg(F.collect_set("name").alias("names")).select(
        "id", F.explode(X.usable_terms("names")).alias("name")).select("id", X.norm_text("name").alias("phrase")).where("phrase <> ''").distinct()

    def found(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        return find_names(texts, wanted, prefix=True).join(wanted, "phrase").select("id", "doc_id").distinct()

    titles = docs.select("doc_id", X.norm_text("title").alias("norm"))
    if headings is not None:
        titles = titles.unionByName(headings.select("doc_id", X.norm_text("term").alias("norm")))
    in_title = cut(found(titles, terms), "titles")
    short = few.join(size(in_title, "n"), "id", "left").where(F.coalesce("n", F.lit(0)) < min_docs).select("id")
    in_text = found(docs.select("doc_id", X.norm_text("text").alias("norm")), terms.join(short, "id", "left_semi"))
    rows = union_all([graph.withColumn("by", F.lit(0)), in_title.withColumn("by", F.lit(1)), in_text.withColumn("by", F.lit(2))])
    rows = rows.groupBy("id", "doc_id").agg(F.min("by").alias("by"))
    facts = want.join(rows.groupBy("id").agg(F.count("*").alias("n_docs"), F.max("by").alias("last")), "id", "left").fillna(0, ["n_docs"])
    method = F.when(F.col("n_docs") < min_docs, "all").when(F.col("last") == 0, "graph mentions").when(F.col("last") == 1, "keyword (title/terms)").otherwise("keyword (title/terms/text)")
    facts = facts.select("id", method.alias("method"), "n_docs")
    return rows.join(facts.where("method <> 'all'"), "id", "left_semi").select("id", "doc_id"), facts


def rrf_fuse(rankings: DataFrame, k: int = RRF_K, n: int = 15) -> DataFrame:
    """`(query_id, doc_id, fused, rank)` of `rankings(query_id, doc_id, rank)` from several lists: the sum of 1 / (k + rank)."""
    fused = rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("fused"))
    return top_n(fused, "query_id", [F.col("fused").desc(), "doc_id"], n, "rank")


def rerank(hits: DataFrame, score: str, fallback: str, n: int = 5) -> DataFrame:
    """Candidates in the order of a supplied score, the dense one where it is missing; the best `n`."""
    scored = hits.withColumn("final", F.coalesce(score, fallback, F.lit(0.0)))
    return top_n(scored.drop("rank"), "query_id", [F.col("final").desc(), "doc_id"], n, "rank")


def expand_query(queries: DataFrame) -> DataFrame:
    """`(query_id, text, label)`: the label in brackets after the text, unless the text has all its words."""
    lacking = F.size(F.array_except(X.query_tokens("label"), X.query_tokens("text"))) > 0
    return queries.withColumn("expanded", F.when(lacking, F.concat("text", F.lit(" ("), "label", F.lit(")"))).otherwise(F.col("text")))


def topic_gate(queries: DataFrame, lexicon: list[str], seeds: DataFrame, vectors: DataFrame, max_seed: float = 0.53,
               max_centroid: float = 0.55) -> DataFrame:
    """`(query_id, allowed, reason, seed_similarity, centroid_similarity)` of `queries(query_id, text, vec)`.

    Fewer than three characters are refused, a word beginning with a lexicon entry is admitted; else refused only when both
    the best similarity to a seed question and the similarity to the corpus centre are low. `seeds(doc_id, vec)`.
    """
    near = dense_topk(queries.select("query_id", "vec"), seeds, 1).select("query_id", F.col("score").alias("seed_similarity"))
    middle = centroid_similarity(queries, vectors).select("query_id", F.round("similarity", 9).alias("centroid_similarity"))
    pattern = any_case("\\b(?:" + "|".join(sorted(lexicon, key=lambda w: (-len(w), w))) + ")")
    rows = queries.join(near, "query_id").join(middle, "query_id")
    short = F.length(F.trim("text")) < 3
    low = (F.col("seed_similarity") < max_seed) & (F.col("centroid_similarity") < max_centroid)
    reason = F.when(short, "empty").when(F.col("text").rlike(pattern), "lexicon").when(low, "off_topic").otherwise("plausible")
    return rows.select("query_id", reason.alias("reason"), "seed_similarity", "centroid_similarity").withColumn(
        "allowed", F.col("reason").isin("lexicon", "plausible"))


def grounding_gate(hits: DataFrame, floor: float, margin: float, min_hits: int = 1) -> DataFrame:
    """Hits of answerable queries that support an answer: a query is answerable with `min_hits` hits at the floor, then hits
    down to the lower of the floor and the best score minus the margin stay."""
    facts = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= floor).alias("n_floor"))
    ok = facts.where(F.col("n_floor") >= min_hits)
    return hits.join(ok, "query_id").where(F.col("score") >= F.least(F.lit(floor), F.col("best") - margin)).drop("best", "n_floor")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """`(class, n, hit_at_k, precision_at_k, mrr)` per query class and over all, for queries with a relevant document.

    `hits(query_id, doc_id, rank)`, `relevant(query_id, doc_id)`, `classes(query_id, class)`.
    """
    marked = hits.join(relevant.distinct().withColumn("ok", F.lit(1)), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("n_top"))
    rows = relevant.select("query_id").distinct().join(classes, "query_id").join(marked, "query_id", "left")
    hit = F.when(F.col("n_top") > 0, 1.0).otherwise(0.0)
    measures = [F.count("*").alias("n"), F.avg(hit).alias("hit_at_k"), F.avg(F.coalesce("n_top", F.lit(0)) / k).alias("precision_at_k"),
                F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")]
    return rows.groupBy("class").agg(*measures).unionByName(rows.agg(*measures).withColumn("class", F.lit("all")))


def calibrate_floor(scores: DataFrame, min_rate: float = 1.0, margin: float = 0.5, parts: int | None = None) -> DataFrame:
    """`(floor, floor_at)`: the highest floor that keeps `min_rate` of the positives, midway to the next lower score and at
    least `margin` below the lowest positive kept. `scores(positive, score)`.

    The lowest kept positive is found by its position: scores are dealt into ranges of about equal size, whatever their scale,
    the counts of the ranges say in which one the position falls, and only that one is numbered.
    """
    pos = scores.where("positive").groupBy("score").agg(F.count("*").alias("n"))
    dealt = pos.repartitionByRange(*([parts] if parts else []), "score").withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    total = scores.select(F.count_if("positive")).scalar()
    drop = F.floor(total * (1 - min_rate) + 1e-9)
    # one row per range
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    ends = sizes.withColumn("upto", F.sum("m").over(Window.orderBy("part"))).select("part", (F.col("upto") - F.col("m")).alias("before"), "upto")
    here = ends.where((F.col("before") <= drop) & (F.col("upto") > drop))
    placed = dealt.join(here, "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("score")))
    floor_at = placed.where(F.col("upto") > drop).select(F.min("score")).scalar()
    facts = scores.groupBy().agg(F.max(F.when(F.col("score") < floor_at, F.col("score"))).alias("lower"), F.first(F.lit(1)).alias("one"))
    facts = facts.withColumn("floor_at", floor_at)
    lower = F.coalesce("lower", F.col("floor_at") - 1.0)
    return facts.select("floor_at", F.least((F.col("floor_at") + lower) / 2, F.col("floor_at") - margin).alias("floor"))


def refusal_accuracy(rows: DataFrame, floor: float) -> DataFrame:
    """Share of right answer-or-refuse decisions at a floor, and how many off-topic queries the topic gate refused.

    `rows(kind, topic_allowed, top_score)` with kind answerable, unanswerable or off_topic.
    """
    refused = ~F.col("topic_allowed") | (F.col("top_score") < floor)
    right = F.when(F.col("kind") == "answerable", ~refused).otherwise(refused)
    off = F.col("kind") == "off_topic"
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.count_if(off & ~F.col("topic_allowed")).alias("off_topic_refused"),
                    F.count_if(off).alias("off_topic"), F.min(F.when(~off, F.col("top_score"))).alias("in_domain_min"), F.max(F.when(off, F.col("top_score"))).alias("off_topic_max"))


def label_by_title(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """`(query_id, doc_id)`: documents whose title matches every pattern of a query. `queries(query_id, pattern)`.

    A stated set of queries against all documents: every distinct pattern is tested on every distinct title, in a join by condition,
    and matches then meet the queries by pattern and the documents by title.
    """
    wanted = queries.select("query_id", "pattern").distinct()
    titles = docs.select("title").distinct()
    hits = titles.join(wanted.select("pattern").distinct(), F.expr("title rlike concat('(?i)', pattern)"))
    found = hits.join(docs.select("doc_id", "title"), "title").select("doc_id", "pattern")
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    got = found.join(wanted, "pattern").groupBy("query_id", "doc_id").agg(F.count("*").alias("got"))
    return got.join(need, "query_id").where("got = need").select("query_id", "doc_id")
