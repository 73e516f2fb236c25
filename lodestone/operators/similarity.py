"""Similarity of entities by shared attributes.

Pairs are never formed from every pair of holders of an item; `topk` has the join over several measures. Between two tables
`similar_candidates` keeps, per entity, only the rarest part of its items that a pair above the wanted score must share (prefix
filtering), so hub items drop out of the join exactly; `score_pairs` then looks up the rest for the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import min_row, ordered_list, top_n, union_all
from lodestone.operators.topk import similar

SLACK = 1e-9


def information_content(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """`(term, n_entities, ic)`: -ln of the share of annotated entities that carry the term or a descendant of it.

    `annotations(entity, term)` without negated rows, over all entities.
    """
    # rows of an entity lie together from here on, so its terms need no further shuffle
    ann = annotations.select("entity", "term").repartition("entity").distinct()
    total = annotations.select(F.countDistinct("entity")).scalar()
    up = closure.select(F.col("id").alias("term"), "ancestor")
    counts = (
        ann.join(up, "term", "left").select("entity", F.coalesce("ancestor", "term").alias("term"))
        .distinct().groupBy("term").agg(F.count("*").alias("n_entities"))
    )
    return counts.select("term", "n_entities", F.log(total / F.col("n_entities")).alias("ic"))


def similarity_candidates(entities: DataFrame, closure: DataFrame, roots: DataFrame, max_desc: int | None = None) -> DataFrame:
    """Entities that are no roots and, if `max_desc` is given, have at most so many descendants."""
    inner = entities.select("id").join(roots.select("id"), "id", "left_anti")
    if max_desc is None:
        return inner
    broad = (
        closure.where("dist > 0").groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n"))
        .where(F.col("n") > max_desc).select("id")
    )
    return inner.join(broad, "id", "left_anti")


def rollup_profile(bags: DataFrame, closure: DataFrame, mode: str = "union") -> DataFrame:
    """`(entity, item, edge_id, via)`: the items of an entity and of its subtypes.

    `bags(entity, item, edge_id)`. The supporting edge is the entity's own one where it exists, then the one of the
    first subtype in id order. `own_or_subtypes` falls back on subtypes only for entities without own items.
    """
    members = closure.select(F.col("ancestor").alias("entity"), F.col("id").alias("via"), "dist")
    if mode == "own_or_subtypes":
        # members are chosen first, so own items and those of subtypes are read and dealt in one pass
        own = bags.select("entity").distinct()
        members = union_all([members.where("dist = 0"), members.where("dist > 0").join(own, "entity", "left_anti")])
    elif mode != "union":
        raise ValueError(mode)
    rows = members.join(bags.withColumnRenamed("entity", "via"), "via")
    best = rows.groupBy("entity", "item").agg(
        min_row([(F.col("dist") > 0).cast("int").alias("o"), "via", "edge_id"]).alias("b"))
    return best.select("entity", "item", "b.edge_id", "b.via")


def propagate_terms(profile: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """`(entity, term, ic, via_term, edge_id)`: every ancestor of a profile term with its most specific support.

    `profile(entity, term, edge_id)`; equal supports are settled by term id.
    """
    weight = ic.select("term", "ic")
    up = closure.select(F.col("id").alias("term"), "ancestor")
    rows = profile.join(weight, "term", "left").fillna(0.0, ["ic"]).join(up, "term")
    best = rows.groupBy("entity", "ancestor").agg(min_row([(-F.col("ic")).alias("w"), "term", "edge_id"]).alias("b"))
    return (
        best.select("entity", F.col("ancestor").alias("term"), F.col("b.term").alias("via_term"), "b.edge_id")
        .join(weight, "term", "left").fillna(0.0, ["ic"])
    )


def _members_items(bags: DataFrame, closure: DataFrame) -> DataFrame:
    """`(entity, item)` of entities and their subtypes, rows of an entity in one place; what many subtypes give one entity is united before it travels."""
    members = closure.select(F.col("ancestor").alias("entity"), F.col("id").alias("via"), "dist")
    rows = members.join(bags.select(F.col("entity").alias("via"), "item"), "via")
    own, lower = (rows.where(c).select("entity", "item") for c in ("dist = 0", "dist > 0"))
    return own.unionByName(lower.distinct()).repartition("entity")


def term_sets(bags: DataFrame, scope: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """`(entity, term, ic)` as `propagate_terms` of `rollup_profile` gives them, without the supports, which scores do not read."""
    up = closure.select(F.col("id").alias("item"), F.col("ancestor").alias("term"))
    terms = _members_items(bags, scope).join(up, "item").select("entity", "term").distinct()
    return terms.join(ic.select("term", "ic"), "term", "left").fillna(0.0, ["ic"])


def item_sets(bags: DataFrame, scope: DataFrame) -> DataFrame:
    """`(entity, item)` as `rollup_profile` gives them, without the supports."""
    return _members_items(bags, scope).distinct()


def weighted_bags(terms: DataFrame, pathways: DataFrame, papers: DataFrame) -> DataFrame:
    """The three attribute sets as one long table `(kind, entity, item, w)`, the kind naming the measure used on it.

    `terms(entity, term, ic)`, `pathways(entity, item)`, `papers(entity, item)`, each row once.
    """
    return union_all([
        tagged(terms.select("entity", F.col("term").alias("item"), F.col("ic").alias("w")), "cosine"),
        *(tagged(rows.select("entity", "item", F.lit(1.0).alias("w")), kind) for rows, kind in ((pathways, "jaccard"), (papers, "ochiai")))])


def tagged(bags: DataFrame, kind: str) -> DataFrame:
    return bags.select(F.lit(kind).alias("kind"), "entity", "item", "w")


def unit_bags(bags: DataFrame) -> DataFrame:
    return bags.select("entity", "item").distinct().withColumn("w", F.lit(1.0))


def _share(min_score: float) -> Column:
    """Part of a bag's mass that a pair reaching `min_score` cannot do without."""
    return F.when(F.col("kind") == "jaccard", min_score).otherwise(min_score * min_score) - SLACK


def item_grades(bags: DataFrame) -> DataFrame:
    return bags.groupBy("kind", "item").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("grade"))


def _graded(bags: DataFrame, min_score: float, grades: DataFrame | None = None) -> DataFrame:
    """Rows of `bags(kind, entity, item, w)` with the bag size `n` and a flag `kept`.

    Not kept are the commonest items of an entity as long as their mass (sum of squared weights) stays below the share that
    a pair needs. Items are graded by the power of two of their frequency, the same grade for every entity, so an entity
    needs a running sum over at most 64 grades and never over its items.
    """
    graded = bags.where("w > 0").join(item_grades(bags) if grades is None else grades, ["kind", "item"])
    mass = graded.groupBy("kind", "entity", "grade").agg(F.sum(F.col("w") * F.col("w")).alias("m"), F.count("*").alias("c"))
    whole = Window.partitionBy("kind", "entity")
    kept = mass.select(
        "kind", "entity", "grade", F.sum("m").over(whole.orderBy(F.col("grade").desc())).alias("run"),
        F.sum("m").over(whole).alias("m"), F.sum("c").over(whole).alias("n"))
    kept = kept.withColumn("kept", F.col("run") >= F.col("m") * _share(min_score)).drop("run")
    return graded.join(kept, ["kind", "entity", "grade"]).select("kind", "entity", "item", "w", "m", "n", "kept")


def _rare_part(bags: DataFrame, min_score: float, grades: DataFrame | None = None) -> DataFrame:
    return _graded(bags, min_score, grades).where("kept").select("kind", "entity", "item", "n")


def similar_candidates(bags: DataFrame, min_score: float, right: DataFrame | None = None) -> DataFrame:
    """`(a, b)` with a < b: a superset of the pairs that reach `min_score` in one kind; no such pair is missed. With
    `right`, pairs of an entity of `bags` with one of `right` instead.

    `bags(kind, entity, item, w)`. For `cosine` and `ochiai` the dropped part of
    one side is shorter than `min_score` times its norm, for `jaccard` smaller than `min_score` times its size: a pair
    that shares nothing in the kept parts stays below the score.
    """
    if not 0 < min_score <= 1:
        raise ValueError("candidates need a positive score")
    if right is None:
        rare = _rare_part(bags, min_score)
        sides, order = (rare, rare), F.col("a") < F.col("b")
    else:
        grades = item_grades(bags.unionByName(right))
        sides = tuple(_rare_part(x, min_score, grades) for x in (bags, right))
        order = F.lit(True)
    left = sides[0].select("kind", "item", F.col("entity").alias("a"), F.col("n").alias("na"))
    other = sides[1].select("kind", "item", F.col("entity").alias("b"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * _share(min_score)
    return (
        left.join(other, ["kind", "item"]).where(order).where((F.col("kind") == "cosine") | fits)
        .select("a", "b").distinct()
    )


def score_pairs(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """`(a, b, kind, score, common)` of given pairs; a kind in which a pair shares nothing is absent.

    The smaller bag of a pair is expanded and probed against the other, so a huge bag is never expanded for a pair
    with a small one.
    """
    size = bags.groupBy("kind", "entity").agg(F.sum(F.col("w") * F.col("w")).alias("m"), F.count("*").alias("n")).where("m > 0")
    sized = (
        pairs.select("a", "b").distinct()
        .join(size.toDF("kind", "a", "ma", "na"), "a").join(size.toDF("kind", "b", "mb", "nb"), ["b", "kind"])
    )
    small = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    rows = sized.withColumn("small", small).withColumn("entity", large).join(
        bags.select("kind", F.col("entity").alias("small"), "item", F.col("w").alias("ws")), ["kind", "small"])
    over = (
        rows.join(bags, ["kind", "entity", "item"]).groupBy("a", "b", "kind", "ma", "na", "mb", "nb")
        .agg(F.sum(F.col("ws") * F.col("w")).alias("dot"), F.count("*").alias("common"))
    )
    return over.select("a", "b", "kind", _score().alias("score"), "common")


def _score() -> Column:
    return (
        F.when(F.col("kind") == "cosine", F.col("dot") / F.sqrt(F.col("ma") * F.col("mb")))
        .when(F.col("kind") == "jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
        .otherwise(F.col("common") / F.sqrt((F.col("na") * F.col("nb")).cast("double")))
    )


def single(bags: DataFrame, kind: str, min_score: float) -> DataFrame:
    found = similar(tagged(bags, kind), {kind: 1.0}, min_score)
    return found.where(F.col(f"s_{kind}") >= min_score).select("a", "b", F.col(f"s_{kind}").alias("score"))


def weighted_cosine_pairs(propagated: DataFrame, min_score: float = 0.0) -> DataFrame:
    """`(a, b, score)`: cosine of propagated term sets, each term weighing its information content; every pair that shares a term with any."""
    return single(propagated.select("entity", F.col("term").alias("item"), F.col("ic").alias("w")), "cosine", min_score)


def jaccard_pairs(bags: DataFrame, min_score: float) -> DataFrame:
    """`(a, b, score)`: Jaccard of item sets."""
    return single(unit_bags(bags), "jaccard", min_score)


def ochiai_pairs(bags: DataFrame, min_score: float) -> DataFrame:
    """`(a, b, score)`: common items over the geometric mean of both sizes."""
    return single(unit_bags(bags), "ochiai", min_score)


def _related(closure: DataFrame) -> DataFrame:
    """Pairs of an entity and its ancestor, the smaller id first."""
    return closure.where("dist > 0").select(F.least("id", "ancestor").alias("a"), F.greatest("id", "ancestor").alias("b")).distinct()


def _named(found: DataFrame) -> DataFrame:
    return found.select("a", "b", F.col("s_cosine").alias("s_term"), F.col("s_jaccard").alias("s_path"), F.col("s_ochiai").alias("s_lit"), "score")


WEIGHTS = {"cosine": 0.5, "jaccard": 0.3, "ochiai": 0.2}


def combine_scores(bags: DataFrame, closure: DataFrame, floor: float, weights: dict[str, float] | None = None) -> DataFrame:
    """`(a, b, s_term, s_path, s_lit, score)` of every pair whose weighted sum reaches `floor`.

    Pairs of an entity with its own ancestor are left out.
    """
    return _named(similar(bags, weights or WEIGHTS, floor, _related(closure)))


def best_pairs(bags: DataFrame, closure: DataFrame, groups: DataFrame, k: int = 10, min_score: float = 0.15, cross_k: int = 3,
               factor: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """What `top_pairs` picks from all combined scores, without forming all pairs: floors rise with the k-th best score."""
    found = similar(bags, weights or WEIGHTS, factor * min_score, _related(closure), groups, k, cross_k, min_score)
    return top_pairs(_named(found), groups, k, min_score, cross_k, factor)


def top_pairs(scores: DataFrame, groups: DataFrame, k: int = 10, min_score: float = 0.15, cross_k: int = 3,
              factor: float = 0.75) -> DataFrame:
    """Undirected pairs that are among the best `k` of one endpoint, or among its best `cross_k` of another group down
    to `factor` times the minimum. Ties go to the smaller id. `groups(id, grp)`.
    """
    both = scores.withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    both = both.unionByName(scores.withColumnRenamed("b", "x").withColumnRenamed("a", "y"))
    both = both.join(groups.select(F.col("id").alias("x"), F.col("grp").alias("gx")), "x").join(
        groups.select(F.col("id").alias("y"), F.col("grp").alias("gy")), "y")
    order = [F.col("score").desc(), F.col("y")]
    best = top_n(both.where(F.col("score") >= min_score), "x", order, k)
    cross = top_n(both.where((F.col("score") >= factor * min_score) & (F.col("gx") != F.col("gy"))), "x", order, cross_k)
    kept = best.unionByName(cross).withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    measures = [c for c in scores.columns if c not in ("a", "b")]
    return kept.select("a", "b", *measures, (F.col("gx") != F.col("gy")).alias("cross_group"),
                       (F.col("score") < min_score).alias("below_threshold")).dropDuplicates(["a", "b"])


def shared_of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, key: str = "item") -> DataFrame:
    """Rows of `pairs(a, b)` with every shared item and the fields of both sides suffixed `_a` and `_b`.

    The smaller bag of a pair is expanded and looked up in the other, so a huge bag is never expanded for a pair with a small one.
    """
    right = left if right is None else right

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select(F.col("entity").alias(end), F.col(key), *[
            F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in ("entity", key)])

    def size(df: DataFrame, end: str) -> DataFrame:
        return df.groupBy(F.col("entity").alias(end)).agg(F.count("*").alias(f"n{end}"))

    sized = pairs.select("a", "b").distinct().join(size(left, "a"), "a").join(size(right, "b"), "b")
    from_a = sized.where("na <= nb").select("a", "b").join(side(left, "a"), "a").join(side(right, "b"), ["b", key])
    from_b = sized.where("na > nb").select("a", "b").join(side(right, "b"), "b").join(side(left, "a"), ["a", key])
    return from_a.unionByName(from_b)


def shared_terms(pairs: DataFrame, propagated: DataFrame, closure: DataFrame, min_ic: float = 1.0, n: int = 12) -> DataFrame:
    """`(a, b, term, ic, via_a, via_b, edge_a, edge_b, rank)`: shared terms, most specific first, without a term that is an
    ancestor of an earlier one. An ancestor of a dropped term is also an ancestor of a kept one, so one anti join
    against earlier shared descendants gives the same result as a greedy pass.
    """
    shared = shared_of_pairs(pairs, propagated.where(F.col("ic") >= min_ic), key="term").withColumn("ic", F.col("ic_a"))
    up = closure.where("dist > 0").select(F.col("id").alias("term"), "ancestor")
    first = shared.select("a", "b", "term", "ic").join(up, "term").groupBy("a", "b", F.col("ancestor").alias("term")).agg(
        min_row([(-F.col("ic")).alias("w"), F.col("term").alias("t")]).alias("f"))
    earlier = (F.col("f.w") < -F.col("ic")) | ((F.col("f.w") == -F.col("ic")) & (F.col("f.t") < F.col("term")))
    kept = shared.join(first, ["a", "b", "term"], "left").where(F.col("f").isNull() | ~earlier)
    return top_n(kept, ["a", "b"], [F.col("ic").desc(), "term"], n, "rank").select(
        "a", "b", "term", "ic", F.col("via_term_a").alias("via_a"), F.col("via_term_b").alias("via_b"),
        F.col("edge_id_a").alias("edge_a"), F.col("edge_id_b").alias("edge_b"), "rank")


def shared_items(pairs: DataFrame, bags: DataFrame, n: int | None = None) -> DataFrame:
    """`(a, b, item, rank, ...)`: shared items of pairs in id order, at most `n` per pair when given."""
    rows = shared_of_pairs(pairs, bags)
    return rows if n is None else top_n(rows, ["a", "b"], ["item"], n, "rank")


def co_mentions(pairs: DataFrame, mentions: DataFrame, n: int = 10) -> DataFrame:
    """`(a, b, n_papers, sample)`: number of common papers and the `n` with the highest number, as a bar-joined text.

    `mentions(entity, item, num)`.
    """
    common = shared_of_pairs(pairs, mentions)
    count = common.groupBy("a", "b").agg(F.count("*").alias("n_papers"))
    sample = ordered_list(common, ["a", "b"], [F.col("num_a").desc(), "item"], F.col("item"), n, "sample")
    return count.join(sample, ["a", "b"]).select("a", "b", "n_papers", F.array_join("sample", "|").alias("sample"))


def similarity_edges(top: DataFrame, as_of: str, min_score: float = 0.15) -> DataFrame:
    """One undirected inferred edge per pair, with its components and flags."""
    source = F.lit("Similarity (IC-weighted cosine + pathway Jaccard + co-mention)")
    return top.select(
        F.sha2(F.concat_ws("|", F.lit("similar_to"), "a", "b", F.lit("sim-v1")), 256).alias("edge_id"),
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("similar_to").alias("rel"), source.alias("source"),
        F.lit("sim-v1").alias("source_id"), F.lit(as_of).alias("date"), F.col("score").alias("confidence"),
        F.lit("inferred").alias("evidence_type"), "s_term", "s_path", "s_lit", "cross_group",
        (F.col("score") < min_score).alias("below_threshold"))

