"""Derived tables that several queries read; each is written once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog.registry import Tables, view
from lodestone.operators import closure as C
from lodestone.operators import similarity as S

MIN_SCORE, FACTOR, TOP_K, INFORMATIVE = 0.15, 0.75, 10, 2.2


def entity_closure(t: Tables) -> DataFrame:
    return t.built("entity_closure", lambda: C.with_self(C.transitive_closure(t("v_hier")), t("v_entity")))


def term_closure(t: Tables) -> DataFrame:
    return t.built("term_closure", lambda: C.with_self(C.transitive_closure(t("v_term_edge")), t("v_term")))


def ic(t: Tables) -> DataFrame:
    return t.built("ic", lambda: S.information_content(t("v_ann_raw").where("qualifier = ''"), term_closure(t)))


def term_bags(t: Tables) -> DataFrame:
    return t("v_ph").select("entity", F.col("term").alias("item"),
                            F.concat_ws("|", F.lit("ph"), "entity", "term").alias("edge_id"))


def gene_bags(t: Tables) -> DataFrame:
    return t("v_gd").select("entity", F.col("gene").alias("item"),
                            F.concat_ws("|", F.lit("gd"), "gene", "entity").alias("edge_id"))


def scope_closure(t: Tables) -> DataFrame:
    """Closure rows whose ancestor is a similarity candidate."""
    return t.built("scope_closure", lambda: entity_closure(t).join(
        S.similarity_candidates(t("v_entity"), entity_closure(t), t("v_root")).select(F.col("id").alias("ancestor")), "ancestor"))


def profile(t: Tables) -> DataFrame:
    """Term profile of candidates, subtypes united."""
    return t.built("profile", lambda: S.rollup_profile(term_bags(t), scope_closure(t)).withColumnRenamed("item", "term"))


def propagated(t: Tables) -> DataFrame:
    return t.built("propagated", lambda: S.propagate_terms(profile(t), term_closure(t), ic(t)))


def genes_of(t: Tables) -> DataFrame:
    return t.built("genes_of", lambda: S.rollup_profile(gene_bags(t), scope_closure(t)))


def pathways_of(t: Tables) -> DataFrame:
    """One row per entity and pathway, with the first gene in id order that reaches it."""
    return t.built("pathways_of", lambda: genes_of(t).withColumnRenamed("item", "gene").join(
        t("v_pw_raw").select("gene", "pathway"), "gene").groupBy("entity", F.col("pathway").alias("item")).agg(
            F.min(F.struct("gene", "edge_id")).alias("g")).select("entity", "item", F.col("g.gene").alias("gene"), "g.edge_id"))


def papers_of(t: Tables) -> DataFrame:
    """Papers that mention the entity or a subtype."""
    return t.built("papers_of", lambda: scope_closure(t).select(F.col("ancestor").alias("entity"), "id").join(
        t("v_men").select(F.col("entity").alias("id"), F.col("paper").alias("item")), "id").select("entity", "item").distinct())


def term_weights(t: Tables) -> DataFrame:
    """`(entity, term, ic)` of `propagated`, from the annotations themselves."""
    bags = t("v_ann_raw").where("qualifier = ''").select("entity", F.col("term").alias("item"))
    return t.built("term_weights", lambda: S.term_sets(bags, scope_closure(t), term_closure(t), ic(t)))


def pathway_sets(t: Tables) -> DataFrame:
    """`(entity, item)` of `pathways_of`: a gene is replaced by its pathways before rows meet at their entity."""
    bags = t("v_gd_raw").select("entity", "gene").join(t("v_pw_raw").select("gene", F.col("pathway").alias("item")), "gene")
    return t.built("pathway_sets", lambda: S.item_sets(bags.select("entity", "item").distinct(), scope_closure(t)))


def parts(t: Tables) -> DataFrame:
    return S.weighted_bags(term_weights(t), pathway_sets(t), papers_of(t))


def scores(t: Tables) -> DataFrame:
    return S.combine_scores(parts(t), entity_closure(t), FACTOR * MIN_SCORE)


def best(t: Tables) -> DataFrame:
    return S.best_pairs(parts(t), entity_closure(t), t("v_entity"), TOP_K, MIN_SCORE, 3, FACTOR)


def top(t: Tables) -> DataFrame:
    return t.built("top_pairs", lambda: best(t))


def family(t: Tables) -> DataFrame:
    """`(id, member, dist)`: every entity with itself and its subtypes."""
    return entity_closure(t).select(F.col("ancestor").alias("id"), F.col("id").alias("member"), "dist")


# The same tables as SQL
view("x_clo0", """SELECT child AS id, parent AS ancestor, 1 AS dist FROM v_hier
UNION SELECT x_clo0.id, h.parent, x_clo0.dist + 1 FROM x_clo0 JOIN v_hier h ON x_clo0.ancestor = h.child""")
view("x_clo", """SELECT id, ancestor, min(dist) AS dist FROM x_clo0 GROUP BY id, ancestor
UNION ALL SELECT id, id, 0 FROM v_entity""")
view("x_tclo0", """SELECT child AS id, parent AS ancestor, 1 AS dist FROM v_term_edge
UNION SELECT x_tclo0.id, h.parent, x_tclo0.dist + 1 FROM x_tclo0 JOIN v_term_edge h ON x_tclo0.ancestor = h.child""")
view("x_tclo", """SELECT id, ancestor, min(dist) AS dist FROM x_tclo0 GROUP BY id, ancestor
UNION ALL SELECT id, id, 0 FROM v_term""")
view("x_ic", """SELECT ancestor AS term, count(DISTINCT entity) AS n_entities,
  ln((SELECT count(DISTINCT entity) FROM v_ph) / count(DISTINCT entity)) AS ic
FROM v_ph JOIN x_tclo ON term = id GROUP BY ancestor""")
view("x_cand", """SELECT id FROM v_entity WHERE id NOT IN (SELECT id FROM v_root)""")
view("x_scope", "SELECT id, ancestor, dist FROM x_clo WHERE ancestor IN (SELECT id FROM x_cand)")
view("x_profile", """SELECT entity, term, edge_id, via FROM (
  SELECT c.ancestor AS entity, p.term, 'ph|' || p.entity || '|' || p.term AS edge_id, p.entity AS via,
    row_number() OVER (PARTITION BY c.ancestor, p.term ORDER BY CASE WHEN dist > 0 THEN 1 ELSE 0 END, p.entity) AS rn
  FROM x_scope c JOIN v_ph p ON c.id = p.entity) u WHERE rn = 1""")
view("x_prop", """SELECT entity, u.term, coalesce(i.ic, 0.0) AS ic, via_term, edge_id FROM (
  SELECT p.entity, c.ancestor AS term, p.term AS via_term, p.edge_id,
    row_number() OVER (PARTITION BY p.entity, c.ancestor ORDER BY -coalesce(x_ic.ic, 0.0), p.term) AS rn
  FROM x_profile p JOIN x_tclo c ON p.term = c.id LEFT JOIN x_ic ON x_ic.term = p.term) u
  LEFT JOIN x_ic i ON i.term = u.term WHERE rn = 1""")
view("x_genes", """SELECT entity, item, edge_id, via FROM (
  SELECT c.ancestor AS entity, p.gene AS item, 'gd|' || p.gene || '|' || p.entity AS edge_id, p.entity AS via,
    row_number() OVER (PARTITION BY c.ancestor, p.gene ORDER BY CASE WHEN dist > 0 THEN 1 ELSE 0 END, p.entity) AS rn
  FROM x_scope c JOIN v_gd p ON c.id = p.entity) u WHERE rn = 1""")
view("x_paths", """SELECT entity, pathway AS item, min(gene) AS gene, arg_min(edge_id, gene) AS edge_id
FROM x_genes JOIN v_pw_raw ON x_genes.item = gene GROUP BY entity, pathway""")
view("x_papers", "SELECT DISTINCT c.ancestor AS entity, m.paper AS item FROM x_scope c JOIN v_men m ON c.id = m.entity")
view("x_cos", """SELECT a, b, dot / sqrt(na.m * nb.m) AS score FROM (
  SELECT p.entity AS a, q.entity AS b, sum(p.ic * q.ic) AS dot FROM x_prop p JOIN x_prop q ON p.term = q.term AND p.entity < q.entity GROUP BY 1, 2) o
  JOIN (SELECT entity, sum(ic * ic) AS m FROM x_prop GROUP BY entity) na ON na.entity = a
  JOIN (SELECT entity, sum(ic * ic) AS m FROM x_prop GROUP BY entity) nb ON nb.entity = b WHERE dot > 0""")
view("x_jac", """SELECT a, b, co / (na.n + nb.n - co) AS score FROM (
  SELECT p.entity AS a, q.entity AS b, count(*) AS co FROM x_paths p JOIN x_paths q ON p.item = q.item AND p.entity < q.entity GROUP BY 1, 2) o
  JOIN (SELECT entity, count(*) AS n FROM x_paths GROUP BY entity) na ON na.entity = a
  JOIN (SELECT entity, count(*) AS n FROM x_paths GROUP BY entity) nb ON nb.entity = b""")
view("x_och", """SELECT a, b, co / sqrt(CAST(na.n * nb.n AS DOUBLE)) AS score, co FROM (
  SELECT p.entity AS a, q.entity AS b, count(*) AS co FROM x_papers p JOIN x_papers q ON p.item = q.item AND p.entity < q.entity GROUP BY 1, 2) o
  JOIN (SELECT entity, count(*) AS n FROM x_papers GROUP BY entity) na ON na.entity = a
  JOIN (SELECT entity, count(*) AS n FROM x_papers GROUP BY entity) nb ON nb.entity = b""")
view("x_scores", """SELECT a, b, s_term, s_path, s_lit, round(0.5 * s_term + 0.3 * s_path + 0.2 * s_lit, 9) AS score FROM (
  SELECT a, b, coalesce(max(t), 0.0) AS s_term, coalesce(max(p), 0.0) AS s_path, coalesce(max(l), 0.0) AS s_lit FROM (
    SELECT a, b, score AS t, NULL AS p, NULL AS l FROM x_cos UNION ALL SELECT a, b, NULL, score, NULL FROM x_jac
    UNION ALL SELECT a, b, NULL, NULL, score FROM x_och) u GROUP BY a, b) v
WHERE round(0.5 * s_term + 0.3 * s_path + 0.2 * s_lit, 9) >= 0.75 * 0.15
  AND NOT EXISTS (SELECT 1 FROM x_clo c WHERE (c.id = a AND c.ancestor = b) OR (c.id = b AND c.ancestor = a))""")
view("x_both", """SELECT s.*, gx.grp AS gx, gy.grp AS gy FROM (
  SELECT a AS x, b AS y, s_term, s_path, s_lit, score FROM x_scores UNION ALL SELECT b, a, s_term, s_path, s_lit, score FROM x_scores) s
  JOIN v_entity gx ON gx.id = x JOIN v_entity gy ON gy.id = y""")
view("x_top", """SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, s_term, s_path, s_lit, score, gx <> gy AS cross_group, score < 0.15 AS below_threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS rn FROM x_both WHERE score >= 0.15
  UNION ALL SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) + 7 AS rn FROM x_both WHERE score >= 0.75 * 0.15 AND gx <> gy) u
WHERE rn <= 10""")
view("x_fam", "SELECT ancestor AS id, id AS member, dist FROM x_clo")
view("x_lookup_profile", """SELECT entity, term, edge_id, via FROM (
  SELECT c.ancestor AS entity, p.term, 'ph|' || p.entity || '|' || p.term AS edge_id, p.entity AS via,
    row_number() OVER (PARTITION BY c.ancestor, p.term ORDER BY CASE WHEN dist > 0 THEN 1 ELSE 0 END, p.entity) AS rn
  FROM x_clo c JOIN v_ph p ON c.id = p.entity
  WHERE dist = 0 OR c.ancestor NOT IN (SELECT entity FROM v_ph)) u WHERE rn = 1""")
