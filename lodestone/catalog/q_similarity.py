"""Closure and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog.registry import query
from lodestone.operators import closure as C
from lodestone.operators import similarity as S


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


@query("transitive_closure", "SELECT id, ancestor, dist FROM x_clo UNION ALL SELECT id, ancestor, dist FROM x_tclo")
def _(t):
    return B.entity_closure(t).unionByName(B.term_closure(t))


@query("transitive_closure_depth_capped", "SELECT id, ancestor, dist FROM x_clo WHERE dist <= 2")
def _(t):
    return C.with_self(C.transitive_closure(t("v_hier"), max_depth=2), t("v_entity"))


@query("information_content", "SELECT term, n_entities, round(ic, 6) AS ic FROM x_ic")
def _(t):
    return S.information_content(t("v_ph"), B.term_closure(t)).select("term", "n_entities", r6("ic"))


@query("similarity_candidates", "SELECT id FROM x_cand")
def _(t):
    return S.similarity_candidates(t("v_entity"), B.entity_closure(t), t("v_root"))


@query("rollup_profile_union", "SELECT entity, term, edge_id, via FROM x_profile")
def _(t):
    return S.rollup_profile(B.term_bags(t), B.scope_closure(t)).withColumnRenamed("item", "term")


@query("rollup_profile_own_or_subtypes", """SELECT entity, term, edge_id, via FROM x_lookup_profile""")
def _(t):
    return S.rollup_profile(B.term_bags(t), B.entity_closure(t), "own_or_subtypes").withColumnRenamed("item", "term")


@query("propagate_terms", "SELECT entity, term, round(ic, 6) AS ic, via_term, edge_id FROM x_prop")
def _(t):
    return S.propagate_terms(B.profile(t), B.term_closure(t), B.ic(t)).select("entity", "term", r6("ic"), "via_term", "edge_id")


@query("weighted_cosine_pairs", "SELECT a, b, round(score, 6) AS score FROM x_cos")
def _(t):
    return S.weighted_cosine_pairs(B.propagated(t)).select("a", "b", r6("score"))


@query("jaccard_pairs", "SELECT a, b, round(score, 6) AS score FROM x_jac WHERE score >= 0.12")
def _(t):
    return S.jaccard_pairs(B.pathways_of(t), 0.12).select("a", "b", r6("score"))


@query("ochiai_pairs", "SELECT a, b, round(score, 6) AS score FROM x_och WHERE score >= 0.05")
def _(t):
    return S.ochiai_pairs(B.papers_of(t), 0.05).select("a", "b", r6("score"))


SCORED = "a, b, round(s_term, 6) AS s_term, round(s_path, 6) AS s_path, round(s_lit, 6) AS s_lit, round(score, 6) AS score"


def scored(df, *more):
    return df.select("a", "b", r6("s_term"), r6("s_path"), r6("s_lit"), r6("score"), *more)


@query("combine_scores", f"SELECT {SCORED} FROM x_scores")
def _(t):
    return scored(B.scores(t))


@query("similarity_top_pairs", f"SELECT {SCORED}, cross_group, below_threshold FROM x_top")
def _(t):
    return scored(B.best(t), "cross_group", "below_threshold")


@query("shared_terms", """
WITH s AS (SELECT t.a, t.b, p.term, p.ic, p.via_term AS via_a, q.via_term AS via_b, p.edge_id AS edge_a, q.edge_id AS edge_b
  FROM x_top t JOIN x_prop p ON p.entity = t.a JOIN x_prop q ON q.entity = t.b AND q.term = p.term WHERE p.ic >= 1.0),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s d JOIN x_tclo c ON c.id = d.term AND c.dist > 0
  WHERE d.a = s.a AND d.b = s.b AND c.ancestor = s.term AND (d.ic > s.ic OR (d.ic = s.ic AND d.term < s.term))))
SELECT a, b, term, round(ic, 6) AS ic, via_a, via_b, edge_a, edge_b, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ic DESC, term) AS rank FROM k) u WHERE rank <= 12""")
def _(t):
    out = S.shared_terms(B.top(t), B.propagated(t), B.term_closure(t))
    return out.withColumn("ic", F.round("ic", 6))


@query("shared_items", """
SELECT a, b, item, gene_a, gene_b, edge_a, edge_b, rank FROM (
  SELECT t.a, t.b, p.item, p.gene AS gene_a, q.gene AS gene_b, p.edge_id AS edge_a, q.edge_id AS edge_b,
    row_number() OVER (PARTITION BY t.a, t.b ORDER BY p.item) AS rank
  FROM x_top t JOIN x_paths p ON p.entity = t.a JOIN x_paths q ON q.entity = t.b AND q.item = p.item) u WHERE rank <= 12""")
def _(t):
    return S.shared_items(B.top(t), B.pathways_of(t), 12).select(
        "a", "b", "item", "gene_a", "gene_b", F.col("edge_id_a").alias("edge_a"), F.col("edge_id_b").alias("edge_b"), "rank")


@query("co_mentions", """
SELECT a, b, count(*) AS n_papers, string_agg(item, '|' ORDER BY num DESC) FILTER (WHERE rn <= 10) AS sample FROM (
  SELECT t.a, t.b, p.item, num, row_number() OVER (PARTITION BY t.a, t.b ORDER BY num DESC, p.item) AS rn
  FROM x_top t JOIN x_papers p ON p.entity = t.a JOIN x_papers q ON q.entity = t.b AND q.item = p.item
  JOIN v_paper ON v_paper.id = p.item) u GROUP BY a, b""")
def _(t):
    men = B.papers_of(t).join(t("v_paper").select(F.col("id").alias("item"), "num"), "item")
    return S.co_mentions(B.top(t), men)


@query("similarity_edges", """
SELECT sha256('similar_to|' || a || '|' || b || '|sim-v1') AS edge_id, a AS src, b AS dst, round(score, 3) AS confidence,
  round(s_term, 4) AS s_term, round(s_path, 4) AS s_path, round(s_lit, 4) AS s_lit, cross_group, below_threshold,
  'inferred' AS evidence_type FROM x_top""")
def _(t):
    return S.similarity_edges(B.top(t), "2001-01-01").select(
        "edge_id", "src", "dst", F.round("confidence", 3).alias("confidence"), F.round("s_term", 4).alias("s_term"),
        F.round("s_path", 4).alias("s_path"), F.round("s_lit", 4).alias("s_lit"), "cross_group", "below_threshold", "evidence_type")
