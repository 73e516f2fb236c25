"""Plans for every similar pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog import q_evidence as Q
from lodestone.catalog import q_lookup as K
from lodestone.catalog.q_functions import inn
from lodestone.catalog.registry import query, view
from lodestone.common import union_all
from lodestone.functions import rules as R
from lodestone.operators import closure as C
from lodestone.operators import lookup as L
from lodestone.operators import similarity as S
from lodestone.plans import pairs as P

THR = B.INFORMATIVE
LOW = 0.3  # inner terms of the bound hierarchy are common, so ancestors count from a lower value on


def pairs(t):
    return B.top(t).select("a", "b")


def propagated(t):
    return t.built("lookup_propagated", lambda: S.propagate_terms(
        K.terms(t).select(F.col("id").alias("entity"), "term", F.col("via").alias("edge_id")), B.term_closure(t), B.ic(t)).select(
        F.col("entity").alias("id"), "term", "ic", "via_term", F.col("edge_id").alias("via")))


def reached(t):
    return t.built("reached", lambda: P.reached_pathways(K.genes(t), t("v_pw_raw")))


def via_papers(t):
    return t.built("via_papers", lambda: L.over_family(K.ids(t), B.family(t), t("v_men").select("entity", "paper"), "paper").select("id", "paper", "via"))


ROUTE_MAKERS = {
    "shared_gene": lambda t: P.routes_shared_gene(pairs(t), K.genes(t)),
    "shared_pathway": lambda t: P.routes_shared_pathway(pairs(t), reached(t), t("v_pathway")),
    "shared_term": lambda t: P.routes_shared_term(pairs(t), K.terms(t), THR),
    "shared_ancestor": lambda t: P.routes_shared_ancestor(pairs(t), K.terms(t), propagated(t), B.term_closure(t), LOW),
    "co_mention": lambda t: P.routes_co_mention(pairs(t), via_papers(t), t("v_paper")),
}


def routes(t):
    """All routes, not written: they are many times the tables at rest."""
    return union_all([make(t) for make in ROUTE_MAKERS.values()])


def few_routes(t):
    return t.built("few_routes", lambda: union_all([ROUTE_MAKERS[kind](t) for kind in ("shared_term", "shared_ancestor", "co_mention")]))


def heads(t):
    return t.built("route_heads", lambda: P.route_heads(pairs(t), K.genes(t), reached(t), t("v_pathway"), few_routes(t)))


COLS = "a, b, kind, item, CAST(round(strength, 6) AS DOUBLE) AS strength, CAST(round(n, 6) AS DOUBLE) AS n, left_item, left_via, right_item, right_via"
view("x_lterm", f"SELECT entity AS id, l.term, via, ic FROM x_lookup_profile l JOIN x_ic ON x_ic.term = l.term")
view("x_lprop", """SELECT id, u.term, coalesce(i.ic, 0.0) AS ic, via_term, via FROM (SELECT p.id, c.ancestor AS term, p.term AS via_term, p.via,
  row_number() OVER (PARTITION BY p.id, c.ancestor ORDER BY -p.ic, p.term) AS rn FROM x_lterm p JOIN x_tclo c ON p.term = c.id) u LEFT JOIN x_ic i ON i.term = u.term WHERE rn = 1""")
view("x_r_gene", """SELECT t.a, t.b, 'shared_gene' AS kind, p.gene AS item, 0.95 * least(p.confidence, 1.0) AS strength, 1 AS n, p.gene AS left_item, p.via AS left_via, p.gene AS right_item, q.via AS right_via
FROM x_top t JOIN x_eg p ON p.id = t.a JOIN x_eg q ON q.id = t.b AND q.gene = p.gene""")
view("x_reach", "SELECT id, pathway, gene, via FROM (SELECT g.id, w.pathway, g.gene, g.via, row_number() OVER (PARTITION BY g.id, w.pathway ORDER BY g.gene, g.via) AS rn FROM x_eg g JOIN v_pw_raw w ON w.gene = g.gene) u WHERE rn = 1")
view("x_r_path", """SELECT t.a, t.b, 'shared_pathway' AS kind, p.pathway AS item, CASE WHEN n_genes <= 50 THEN 0.85 WHEN n_genes <= 150 THEN 0.7 ELSE 0.55 END AS strength, n_genes AS n,
  p.gene AS left_item, p.via AS left_via, q.gene AS right_item, q.via AS right_via FROM x_top t JOIN x_reach p ON p.id = t.a JOIN x_reach q ON q.id = t.b AND q.pathway = p.pathway AND q.gene <> p.gene JOIN v_pathway w ON w.id = p.pathway""")
view("x_direct", f"""SELECT t.a, t.b, p.term, p.ic, p.via AS via_a, q.via AS via_b FROM x_top t JOIN x_lterm p ON p.id = t.a JOIN x_lterm q ON q.id = t.b AND q.term = p.term WHERE p.ic >= {THR}""")
view("x_direct_low", f"""SELECT t.a, t.b, p.term, p.ic FROM x_top t JOIN x_lterm p ON p.id = t.a JOIN x_lterm q ON q.id = t.b AND q.term = p.term WHERE p.ic >= {LOW}""")
view("x_r_term", """SELECT a, b, 'shared_phenotype' AS kind, term AS item, least(0.9, 0.5 + ic / 20) AS strength, ic AS n, term AS left_item, via_a AS left_via, term AS right_item, via_b AS right_via
FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ic DESC, term) AS rn FROM x_direct) u WHERE rn <= 5""")
view("x_fresh", f"""SELECT t.a, t.b, p.term, p.ic, p.via_term AS ta, p.via AS va, q.via_term AS tb, q.via AS vb FROM x_top t JOIN x_lprop p ON p.id = t.a JOIN x_lprop q ON q.id = t.b AND q.term = p.term
WHERE p.ic >= {LOW} AND NOT EXISTS (SELECT 1 FROM x_direct_low d WHERE d.a = t.a AND d.b = t.b AND d.term = p.term)""")
view("x_r_fam", """SELECT u.a, u.b, 'shared_phenotype_family' AS kind, term AS item, least(0.8, 0.4 + ic / 20) AS strength, ic AS n, ta AS left_item, va AS left_via, tb AS right_item, vb AS right_via FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ic DESC, term) AS rn FROM x_fresh f
  WHERE NOT EXISTS (SELECT 1 FROM x_direct_low d JOIN x_tclo c ON c.id = d.term AND c.dist > 0 WHERE d.a = f.a AND d.b = f.b AND c.ancestor = f.term)
    AND NOT EXISTS (SELECT 1 FROM x_fresh d JOIN x_tclo c ON c.id = d.term AND c.dist > 0 WHERE d.a = f.a AND d.b = f.b AND c.ancestor = f.term AND (d.ic > f.ic OR (d.ic = f.ic AND d.term < f.term)))) u
LEFT JOIN (SELECT a, b, count(*) AS nd FROM x_direct_low GROUP BY a, b) d ON d.a = u.a AND d.b = u.b WHERE rn <= CASE WHEN coalesce(nd, 0) < 3 THEN 3 ELSE 2 END""")
view("x_vpaper", "SELECT id, paper, entity AS via FROM (SELECT f.id, m.paper, m.entity, row_number() OVER (PARTITION BY f.id, m.paper ORDER BY f.dist, m.entity) AS rn FROM x_fam f JOIN v_men m ON m.entity = f.member) u WHERE rn = 1")
view("x_r_co", """SELECT a, b, 'co_mention' AS kind, paper AS item, least(0.75, 0.3 + 0.03 * cnt) AS strength, cnt AS n, paper AS left_item, va AS left_via, paper AS right_item, vb AS right_via FROM (
  SELECT t.a, t.b, p.paper, p.via AS va, q.via AS vb, count(*) OVER (PARTITION BY t.a, t.b) AS cnt, row_number() OVER (PARTITION BY t.a, t.b ORDER BY y.year DESC, p.paper DESC, p.via DESC, q.via DESC) AS rn
  FROM x_top t JOIN x_vpaper p ON p.id = t.a JOIN x_vpaper q ON q.id = t.b AND q.paper = p.paper JOIN v_paper y ON y.id = p.paper) u WHERE rn = 1""")
view("x_route", " UNION ALL ".join(f"SELECT a, b, kind, item, CAST(strength AS DOUBLE) AS strength, CAST(n AS DOUBLE) AS n, left_item, left_via, right_item, right_via FROM x_r_{k}" for k in ("gene", "path", "term", "fam", "co")))


def rounded(df):
    return df.withColumn("strength", F.round("strength", 6)).withColumn("n", F.round("n", 6))


for _name, _view in (("shared_gene", "gene"), ("shared_pathway", "path"), ("shared_term", "term"), ("shared_ancestor", "fam"), ("co_mention", "co")):
    query(f"routes_{_name}", f"SELECT {COLS} FROM x_r_{_view}")(lambda t, make=ROUTE_MAKERS[_name]: rounded(make(t)))

view("x_walk", """SELECT id AS start, id AS node, 0 AS len, CAST('' AS VARCHAR) AS path FROM v_term
UNION ALL SELECT w.start, e.parent, w.len + 1, w.path || '/' || e.child || '>' || e.parent FROM x_walk w JOIN v_term_edge e ON e.child = w.node""")


@query("ancestor_paths", """SELECT id, ancestor, path FROM (SELECT start AS id, node AS ancestor, path, row_number() OVER (PARTITION BY start, node ORDER BY len, path) AS rn FROM x_walk) u WHERE rn = 1""")
def _(t):
    steps = t("v_term_edge").withColumn("edge_id", F.concat("child", F.lit(">"), "parent"))
    out = C.ancestor_paths(B.term_closure(t).select("id", "ancestor"), steps, B.term_closure(t))
    return out.select("id", "ancestor", F.when(F.size("path") > 0, F.concat(F.lit("/"), F.array_join("path", "/"))).otherwise("").alias("path"))


KIND = "CASE kind WHEN 'shared_gene' THEN 0 WHEN 'shared_pathway' THEN 1 WHEN 'shared_phenotype' THEN 2 WHEN 'shared_phenotype_family' THEN 3 ELSE 4 END"
ORDER = f"strength DESC, {KIND}, n DESC, item"
view("x_best", f"SELECT a, b, kind, item FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE WHEN kind = 'co_mention' THEN 1 ELSE 0 END, {ORDER}) AS rn FROM x_route) u WHERE rn = 1")
view("x_support", """SELECT t.a, t.b, coalesce(mechanism, FALSE) AS mechanism, coalesce(n_kinds, 0) AS n_kinds, CAST(coalesce(co_papers, 0) AS BIGINT) AS co_papers, coalesce(n_routes, 0) AS n_routes, b.kind AS primary_kind, b.item AS primary_item,
  coalesce(strong, FALSE) OR coalesce(co_papers, 0) >= 3 AS supported FROM x_top t LEFT JOIN (
  SELECT a, b, bool_or(kind <> 'co_mention') AS strong, bool_or(kind IN ('shared_gene', 'shared_pathway')) AS mechanism,
    count(DISTINCT CASE WHEN kind IN ('shared_gene', 'shared_pathway') THEN 1 WHEN kind = 'co_mention' THEN 3 ELSE 2 END) AS n_kinds, max(CASE WHEN kind = 'co_mention' THEN n END) AS co_papers, count(*) AS n_routes
  FROM x_route GROUP BY a, b) f ON f.a = t.a AND f.b = t.b LEFT JOIN x_best b ON b.a = t.a AND b.b = t.b""")


def support(t):
    return t.built("support", lambda: P.decide_support(pairs(t), heads(t)))


@query("decide_support", "SELECT a, b, mechanism, n_kinds, co_papers, n_routes, primary_kind, primary_item, supported FROM x_support")
def _(t):
    return P.decide_support(pairs(t), heads(t))


SR = K.SRANK
view("x_asset", f"""WITH oa AS (SELECT t.a, t.b, e.trial FROM x_top t JOIN x_et e ON e.id = t.a), ob AS (SELECT t.a, t.b, e.trial FROM x_top t JOIN x_et e ON e.id = t.b),
k AS (SELECT id AS trial, kind, status, {SR} AS sr, n_conditions > 10 AS broad FROM v_trial_kind), m AS (SELECT id AS trial, m FROM x_modal WHERE m NOT IN {inn(P.GENERAL_MODALITIES)}),
o AS (SELECT e.id AS b, m, min(e.trial) AS paired FROM x_et e JOIN m ON m.trial = e.trial GROUP BY e.id, m),
p1 AS (SELECT oa.a, oa.b, 1 AS part, row_number() OVER (PARTITION BY oa.a, oa.b ORDER BY broad, sr, oa.trial) AS pos, oa.trial, 'both' AS side, kind, status, CAST(NULL AS VARCHAR) AS paired_with FROM oa JOIN ob ON ob.a = oa.a AND ob.b = oa.b AND ob.trial = oa.trial JOIN k ON k.trial = oa.trial),
onl AS (SELECT oa.*, 'a' AS side FROM oa ANTI JOIN ob ON ob.a = oa.a AND ob.b = oa.b AND ob.trial = oa.trial UNION ALL SELECT ob.*, 'b' FROM ob ANTI JOIN oa ON ob.a = oa.a AND ob.b = oa.b AND ob.trial = oa.trial),
p2 AS (SELECT n.a, n.b, 2 AS part, row_number() OVER (PARTITION BY n.a, n.b ORDER BY side, sr, n.trial) AS pos, n.trial, side, kind, status, CAST(NULL AS VARCHAR) AS paired_with FROM onl n JOIN k ON k.trial = n.trial WHERE kind IN ('registry', 'natural_history')),
s AS (SELECT n.a, n.b, n.trial, kind, status, sr, arg_min(o.paired, m.m) AS paired FROM onl n JOIN k ON k.trial = n.trial JOIN m ON m.trial = n.trial JOIN o ON o.b = n.b AND o.m = m.m WHERE side = 'a' AND kind NOT IN ('registry', 'natural_history') GROUP BY n.a, n.b, n.trial, kind, status, sr),
p3 AS (SELECT a, b, 3 AS part, row_number() OVER (PARTITION BY a, b ORDER BY sr, trial) AS pos, trial, 'a' AS side, kind, status, paired AS paired_with FROM s)
SELECT * FROM p1 WHERE pos <= 8 UNION ALL SELECT * FROM p2 WHERE pos <= 4 UNION ALL SELECT * FROM p3 WHERE pos <= 3""")


def modalities(t):
    return t("v_trial").select(F.col("id").alias("trial"), F.explode(R.modality_tags(F.concat_ws(" ", "title", "intervention"))).alias("modality"))


def assets(t):
    return t.built("assets", lambda: P.shared_assets(pairs(t), K.trials(t), t("v_trial_kind"), modalities(t)))


@query("shared_assets", "SELECT a, b, part, pos, trial, side, kind, status, paired_with FROM x_asset")
def _(t):
    return P.shared_assets(pairs(t), K.trials(t), t("v_trial_kind"), modalities(t))


view("x_speople", """SELECT * FROM (SELECT t.a, t.b, p.person, p.n_papers AS n_papers_a, q.n_papers AS n_papers_b, homonym_risk, affiliation,
  row_number() OVER (PARTITION BY t.a, t.b ORDER BY homonym_risk, least(p.n_papers, q.n_papers) DESC, p.n_papers + q.n_papers DESC, p.person) AS pos
  FROM x_top t JOIN x_er p ON p.id = t.a AND p.n_papers >= 2 JOIN x_er q ON q.id = t.b AND q.n_papers >= 2 AND q.person = p.person JOIN v_person h ON h.id = p.person) u WHERE pos <= 10""")


def people(t):
    return t.built("shared_people", lambda: P.shared_people(pairs(t), K.people(t), t("v_person")))


@query("shared_people", "SELECT a, b, person, n_papers_a, n_papers_b, homonym_risk, affiliation, pos FROM x_speople")
def _(t):
    return P.shared_people(pairs(t), K.people(t), t("v_person"))


view("x_sorg", """SELECT * FROM (SELECT a, b, org, serves_both, on_a, url <> '' AS has_url, row_number() OVER (PARTITION BY a, b ORDER BY url <> '' DESC, serves_both DESC, label, org) AS pos FROM (
  SELECT a, b, org, count(*) = 2 AS serves_both, min(side) = 'a' AS on_a FROM (SELECT t.a, t.b, o.org, 'a' AS side FROM x_top t JOIN x_eo o ON o.id = t.a UNION ALL SELECT t.a, t.b, o.org, 'b' FROM x_top t JOIN x_eo o ON o.id = t.b) u GROUP BY a, b, org) v
  JOIN v_org ON v_org.id = org) w WHERE pos <= 12""")


def orgs(t):
    return t.built("shared_orgs", lambda: P.shared_organizations(pairs(t), K.orgs(t), t("v_org")))


@query("shared_organizations", "SELECT a, b, org, serves_both, on_a, has_url, pos FROM x_sorg")
def _(t):
    return P.shared_organizations(pairs(t), K.orgs(t), t("v_org"))


view("x_side", "SELECT a, b, 'a' AS side, a AS id, b AS other FROM x_top UNION ALL SELECT a, b, 'b', b, a FROM x_top")
view("x_diff", f"""SELECT a, b, side, 'phenotype' AS kind, term AS item, pos FROM (SELECT s.*, l.term, row_number() OVER (PARTITION BY a, b, side ORDER BY l.ic DESC, l.term) AS pos FROM x_side s JOIN x_lterm l ON l.id = s.id AND ic >= {THR}
  ANTI JOIN x_lprop q ON q.id = s.other AND q.term = l.term) u WHERE pos <= 4
UNION ALL SELECT a, b, side, 'gene', gene, pos FROM (SELECT s.*, g.gene, row_number() OVER (PARTITION BY a, b, side ORDER BY g.gene) AS pos FROM x_side s JOIN x_eg g ON g.id = s.id ANTI JOIN x_eg h ON h.id = s.other AND h.gene = g.gene) u WHERE pos <= 3""")


def diffs(t):
    return t.built("diffs", lambda: P.differences(pairs(t), K.terms(t), propagated(t), K.genes(t), THR))


@query("differences", "SELECT a, b, side, kind, item, pos FROM x_diff")
def _(t):
    return P.differences(pairs(t), K.terms(t), propagated(t), K.genes(t), THR)


view("x_tev", """SELECT id, kind, item, weight, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, kind DESC, item) AS pos FROM (
  SELECT id, 'gene' AS kind, gene AS item, CAST(2.0 AS DOUBLE) AS weight FROM x_eg UNION ALL SELECT id, 'term', term, ic / 10 FROM x_lterm
  UNION ALL SELECT id, 'study', min(trial), CAST(0.0 AS DOUBLE) FROM x_et WHERE id NOT IN (SELECT id FROM x_eg UNION SELECT id FROM x_lterm) GROUP BY id
  UNION ALL SELECT id, 'paper', min(paper), CAST(0.0 AS DOUBLE) FROM x_ep WHERE id NOT IN (SELECT id FROM x_eg UNION SELECT id FROM x_lterm) GROUP BY id) u) v WHERE pos <= 3""")


def evidence(t):
    return P.top_evidence(K.ids(t), K.genes(t), K.terms(t), K.trials(t), K.papers(t))


@query("top_evidence", "SELECT id, kind, item, round(weight, 6) AS weight, pos FROM x_tev")
def _(t):
    return evidence(t).withColumn("weight", F.round("weight", 6))


def cnt(view_name: str, end: str) -> str:
    return f"coalesce((SELECT count(*) FROM {view_name} z WHERE z.id = s.{end}), 0)"


view("x_gap", f"""SELECT *, array_to_string(list_filter([CASE WHEN terms_a = 0 OR terms_b = 0 THEN 'no_annotations' WHEN informative_shared = 0 THEN CASE WHEN broad_shared > 0 THEN 'broad_terms_only' ELSE 'no_common_term' END END,
  CASE WHEN genes_a = 0 OR genes_b = 0 THEN 'no_gene' WHEN genes_shared = 0 AND pathways_shared = 0 THEN 'no_common_mechanism' END, CASE WHEN co_papers < 3 THEN 'few_common_papers' END,
  CASE WHEN people_shared = 0 THEN 'no_common_people' END], lambda x: x IS NOT NULL), '|') AS missing,
  CASE WHEN hint IS NOT NULL THEN 'Is the shared broad symptom ''' || hint || ''' caused by the same process?' ELSE 'Is there any overlap that is not yet published?' END AS next_question FROM (
  SELECT s.a, s.b, co_papers, {cnt('x_lterm', 'a')} AS terms_a, {cnt('x_lterm', 'b')} AS terms_b, {cnt('x_eg', 'a')} AS genes_a, {cnt('x_eg', 'b')} AS genes_b, {cnt('x_ep', 'a')} AS papers_a, {cnt('x_ep', 'b')} AS papers_b,
    {cnt('x_et', 'a')} AS trials_a, {cnt('x_et', 'b')} AS trials_b,
    (SELECT count(*) FROM x_lprop p JOIN x_lprop q ON q.term = p.term WHERE p.id = s.a AND q.id = s.b AND p.ic >= {THR}) AS informative_shared,
    (SELECT count(*) FROM x_lprop p JOIN x_lprop q ON q.term = p.term WHERE p.id = s.a AND q.id = s.b AND p.ic >= 1 AND p.ic < {THR}) AS broad_shared,
    (SELECT arg_min(p.term, (-p.ic, p.term)) FROM x_lprop p JOIN x_lprop q ON q.term = p.term WHERE p.id = s.a AND q.id = s.b AND p.ic >= 1 AND p.ic < {THR}) AS hint,
    (SELECT count(*) FROM x_eg p JOIN x_eg q ON q.gene = p.gene WHERE p.id = s.a AND q.id = s.b) AS genes_shared,
    (SELECT count(*) FROM x_route r WHERE r.a = s.a AND r.b = s.b AND r.kind = 'shared_pathway') AS pathways_shared,
    (SELECT count(*) FROM x_asset r WHERE r.a = s.a AND r.b = s.b AND r.side = 'both') AS trials_shared, (SELECT count(*) FROM x_speople r WHERE r.a = s.a AND r.b = s.b) AS people_shared,
    (SELECT count(*) FROM x_sorg r WHERE r.a = s.a AND r.b = s.b AND r.serves_both) AS orgs_shared FROM x_gap_pairs s) u""")
# every similar pair is reported as if unsupported, so that each field of the report is exercised
view("x_gap_pairs", "SELECT a, b, co_papers FROM x_support")


def gaps(t, only_unsupported=True):
    base = support(t) if only_unsupported else support(t).withColumn("supported", F.lit(False))
    return P.gap_report(base, K.terms(t), K.genes(t), K.papers(t), K.trials(t), propagated(t), heads(t), people(t), assets(t), orgs(t), THR)


GAP = "a, b, co_papers, terms_a, terms_b, genes_a, genes_b, papers_a, papers_b, trials_a, trials_b, informative_shared, broad_shared, genes_shared, pathways_shared, trials_shared, people_shared, orgs_shared, hint, missing, next_question"


@query("gap_report", f"SELECT {GAP} FROM x_gap")
def _(t):
    return gaps(t, only_unsupported=False)


view("x_sgrant", """SELECT a, b, grant_id, active, pos FROM (SELECT t.a, t.b, p.grant_id, p.active, row_number() OVER (PARTITION BY t.a, t.b ORDER BY p.active DESC, p.fy_last DESC, p.grant_id) AS pos
  FROM x_top t JOIN x_gr p ON p.id = t.a JOIN x_gr q ON q.id = t.b AND q.grant_id = p.grant_id WHERE least(p.confidence, q.confidence) >= 0.7) u WHERE pos <= 6""")
view("x_led", "SELECT g.id, person, count(*) AS n FROM x_gr g JOIN v_lead l ON l.grant_id = g.grant_id GROUP BY g.id, person")
view("x_slead", """SELECT a, b, person, n_a, n_b, pos FROM (SELECT t.a, t.b, p.person, p.n AS n_a, q.n AS n_b, row_number() OVER (PARTITION BY t.a, t.b ORDER BY p.person) AS pos
  FROM x_top t JOIN x_led p ON p.id = t.a JOIN x_led q ON q.id = t.b AND q.person = p.person) u WHERE pos <= 6""")
view("x_fcount", "SELECT t.a, t.b, p.n_grants AS n_a, p.n_active AS active_a, q.n_grants AS n_b, q.n_active AS active_b, p.gap AS gap_a, q.gap AS gap_b FROM x_top t JOIN x_funding p ON p.id = t.a JOIN x_funding q ON q.id = t.b")


def funding(t):
    return (t.built("shared_grants", lambda: P.shared_grants(pairs(t), K.grants(t))), t.built("shared_leads", lambda: P.shared_leads(pairs(t), K.grants(t), t("v_lead"))),
            counted_funds(t))


def counted_funds(t):
    return t.built("funding_counts", lambda: P.funding_counts(pairs(t), K.grants(t)))


@query("shared_grants", "SELECT a, b, grant_id, active, pos FROM x_sgrant")
def _(t):
    return P.shared_grants(pairs(t), K.grants(t))


@query("shared_leads", "SELECT a, b, person, n_a, n_b, pos FROM x_slead")
def _(t):
    return P.shared_leads(pairs(t), K.grants(t), t("v_lead"))


@query("funding_overlap", "SELECT a, b, n_a, active_a, n_b, active_b, gap_a, gap_b FROM x_fcount")
def _(t):
    return P.funding_counts(pairs(t), K.grants(t))


view("x_step", f"""
WITH y AS (SELECT a, b FROM x_support WHERE supported), ob AS (SELECT a, b, arg_min(org, pos) AS org FROM x_sorg WHERE serves_both GROUP BY a, b),
ap AS (SELECT a, b, arg_min(org, pos) FILTER (WHERE on_a) AS oa, arg_min(org, pos) FILTER (WHERE NOT on_a) AS ob FROM x_sorg s WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.a = s.a AND ob.b = s.b) GROUP BY a, b),
az AS (SELECT a, b, trial, row_number() OVER (PARTITION BY a, b ORDER BY part, pos) AS ap FROM x_asset),
rt AS (SELECT a, b, item, kind LIKE 'shared_phenotype%' AS term, row_number() OVER (PARTITION BY a, b, kind LIKE 'shared_phenotype%' ORDER BY {ORDER}) AS rn FROM x_route WHERE kind <> 'co_mention'),
bg AS (SELECT id, grant_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fy_last DESC, amount DESC, grant_id) AS rn FROM x_gr WHERE active) u WHERE rn = 1),
r AS (SELECT a, b, 1 AS pos, 'joint_call' AS kind, org AS ref FROM ob UNION ALL SELECT a, b, 1, 'introduce', oa || '|' || ob FROM ap WHERE oa IS NOT NULL AND ob IS NOT NULL
  UNION ALL SELECT a, b, 2, 'ask_person', person FROM x_speople WHERE pos = 1 UNION ALL SELECT a, b, ap + 2, 'use_asset', trial FROM az WHERE ap <= 2
  UNION ALL SELECT a, b, 5, 'common_outcome', item FROM rt WHERE term AND rn = 1 UNION ALL SELECT a, b, 6, 'shared_mechanism', item FROM rt WHERE NOT term AND rn = 1
  UNION ALL SELECT a, b, 7, 'shared_grant', grant_id FROM x_sgrant WHERE pos = 1 UNION ALL SELECT a, b, 7, 'shared_lead', person FROM x_slead l WHERE pos = 1 AND NOT EXISTS (SELECT 1 FROM x_sgrant g WHERE g.a = l.a AND g.b = l.b)
  UNION ALL SELECT t.a, t.b, 8, 'active_grant', coalesce(p.grant_id, q.grant_id) FROM x_top t LEFT JOIN bg p ON p.id = t.a LEFT JOIN bg q ON q.id = t.b WHERE coalesce(p.grant_id, q.grant_id) IS NOT NULL)
SELECT r.a, r.b, CAST(pos AS INT) AS pos, kind, ref FROM r JOIN y ON y.a = r.a AND y.b = r.b UNION ALL SELECT o.a, o.b, 1, 'open_question', org FROM x_sorg o JOIN x_support s ON s.a = o.a AND s.b = o.b AND NOT supported WHERE pos = 1""")


def steps(t):
    return t.built("steps", lambda: P.next_steps(support(t), heads(t), assets(t), people(t), orgs(t), *funding(t), K.grants(t)))


@query("next_steps", "SELECT a, b, pos, kind, ref FROM x_step")
def _(t):
    return P.next_steps(support(t), heads(t), assets(t), people(t), orgs(t), *funding(t), K.grants(t))


view("x_pedge", """WITH f AS (SELECT r.* FROM x_route r JOIN x_support s ON s.a = r.a AND s.b = r.b AND s.primary_kind = r.kind AND s.primary_item = r.item AND supported)
SELECT a, b, left_item AS src, left_via AS dst FROM f WHERE kind IN ('shared_gene', 'co_mention', 'shared_pathway') UNION SELECT a, b, right_item, right_via FROM f WHERE kind IN ('shared_gene', 'co_mention', 'shared_pathway')
UNION SELECT a, b, left_item, item FROM f WHERE kind = 'shared_pathway' UNION SELECT a, b, right_item, item FROM f WHERE kind = 'shared_pathway'
UNION SELECT a, b, left_via, left_item FROM f WHERE kind LIKE 'shared_phenotype%' UNION SELECT a, b, right_via, right_item FROM f WHERE kind LIKE 'shared_phenotype%'""")
view("x_path", """SELECT p.a, p.b, count(*) AS n_path, count(*) FILTER (WHERE stance = 'mixed') AS n_mixed, count(*) FILTER (WHERE stance IN ('weak', 'unsupported')) AS n_weak, CAST(sum(n_contra) AS BIGINT) AS n_contra
FROM x_pedge p JOIN x_edge e ON e.src = p.src AND e.dst = p.dst JOIN x_assess s ON s.edge_id = e.edge_id GROUP BY p.a, p.b""")
view("x_ready", """SELECT a, b, n_kinds, n_path, n_mixed, n_weak, n_contra, CASE WHEN NOT supported THEN 'none' WHEN mechanism AND n_kinds >= 2 AND n_mixed = 0 AND n_contra = 0 AND n_weak = 0 THEN 'strong'
  WHEN (mechanism OR n_kinds >= 2) AND n_mixed = 0 AND n_weak <= 1 THEN 'moderate' WHEN n_contra > 0 OR n_mixed >= 2 OR (NOT mechanism AND n_kinds = 1 AND co_papers = 0) THEN 'weak' WHEN mechanism THEN 'moderate' ELSE 'weak' END AS level FROM (
  SELECT s.*, coalesce(n_path, 0) AS n_path, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_weak, 0) AS n_weak, coalesce(n_contra, 0) AS n_contra FROM x_support s LEFT JOIN x_path p ON p.a = s.a AND p.b = s.b) u""")


def primary(t):
    """Ends of the edges the primary route of each pair rests on."""
    return t.built("primary_ends", lambda: P.primary_route_edges(heads(t), support(t)))


def primary_edges(t):
    """Edges of primary routes, found by their ends."""
    wanted = primary(t).select("src", "dst").distinct()
    return t.built("primary_edges", lambda: Q.all_given(t).join(wanted, ["src", "dst"], "left_semi"))


def primary_assessed(t):
    return t.built("primary_assessed", lambda: Q.assess_some(t, primary_edges(t)))


def path(t):
    return t.built("path", lambda: P.path_facts(primary_edges(t), primary(t), primary_assessed(t)))


@query("readiness", "SELECT a, b, level, n_kinds, n_path, n_mixed, n_weak, n_contra FROM x_ready")
def _(t):
    return P.readiness(support(t), path(t))


REASONS = [("mechanism", "mechanism", "1"), ("NOT mechanism", "no_mechanism", "1"), ("TRUE", "kinds_of_evidence", "n_kinds"), ("co_papers >= 3", "common_papers", "co_papers"), ("co_papers = 0", "no_common_paper", "1"),
           ("n_mixed > 0", "mixed_edges", "n_mixed"), ("n_contra > 0", "counter_evidence", "n_contra"), ("n_weak > 0", "weak_edges", "n_weak"), ("below_threshold", "below_threshold", "1"),
           ("n_stopped > 0", "stopped_assets", "n_stopped"), ("n_assets > 0 AND n_stopped = 0", "assets", "n_assets")]
view("x_rfact", """SELECT s.a, s.b, supported, mechanism, s.n_kinds, co_papers, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_weak, 0) AS n_weak, coalesce(n_contra, 0) AS n_contra, t.below_threshold, coalesce(n_assets, 0) AS n_assets, coalesce(n_stopped, 0) AS n_stopped
FROM x_support s LEFT JOIN x_path p ON p.a = s.a AND p.b = s.b LEFT JOIN x_top t ON t.a = s.a AND t.b = s.b
LEFT JOIN (SELECT a, b, count(*) AS n_assets, count(*) FILTER (WHERE status IN ('TERMINATED', 'WITHDRAWN', 'SUSPENDED')) AS n_stopped FROM x_asset GROUP BY a, b) c ON c.a = s.a AND c.b = s.b""")


@query("readiness_reasons", "SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY o) - 1 AS INT) AS pos, reason, CAST(n AS BIGINT) AS n FROM (SELECT a, b, 0 AS o, 'no_rule_met' AS reason, 1 AS n FROM x_rfact WHERE NOT supported"
       + "".join(f" UNION ALL SELECT a, b, {i}, '{name}', {n} FROM x_rfact WHERE supported AND ({when})" for i, (when, name, n) in enumerate(REASONS, 1)) + ") u")
def _(t):
    return P.readiness_reasons(support(t), path(t), B.top(t), assets(t))


view("x_caveat", """SELECT a, b, 1 AS pos, 'no_active_grant_a' AS kind, '' AS ref FROM x_fcount WHERE gap_a UNION ALL SELECT a, b, 2, 'no_active_grant_b', '' FROM x_fcount WHERE gap_b
UNION ALL SELECT a, b, 3, 'counter_evidence', CAST(n_contra AS VARCHAR) FROM x_path WHERE n_contra > 0
UNION ALL SELECT a, b, CAST(ap + 3 AS INT), 'stopped_asset', trial FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY part, pos) AS ap FROM x_asset WHERE status IN ('TERMINATED', 'WITHDRAWN', 'SUSPENDED')) u WHERE ap <= 2
UNION ALL SELECT a, b, 6, 'below_threshold', '' FROM x_top WHERE below_threshold UNION ALL SELECT a, b, 7, 'no_mechanism', '' FROM x_support WHERE supported AND NOT mechanism UNION ALL SELECT a, b, 8, 'no_common_paper', '' FROM x_support WHERE supported AND co_papers = 0""")


def notes(t):
    return t.built("notes", lambda: P.caveats(support(t), path(t), counted_funds(t), assets(t), B.top(t)))


@query("caveats", "SELECT a, b, pos, kind, ref FROM x_caveat")
def _(t):
    return P.caveats(support(t), path(t), counted_funds(t), assets(t), B.top(t))


def wanted(t):
    """Every similar pair, every entity without a neighbour, and every root with itself."""
    alone = K.ids(t).withColumnRenamed("id", "a").join(K.nearest(t).select(F.col("id").alias("a")), "a", "left_anti").withColumn("b", F.lit(None).cast("string"))
    same = t("v_root").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return pairs(t).unionByName(alone).unionByName(same)


def ls(order: str, value: str, source: str, n: int) -> str:
    return f"(SELECT a, b, string_agg({value}, '|' ORDER BY p) AS l FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY {order}) AS p FROM {source}) z WHERE p <= {n} GROUP BY a, b)"


LISTS = {"routes": ls(ORDER, "kind || ':' || item", "x_route", 8), "assets": ls("part, pos", "trial", "x_asset", 15), "people": ls("pos", "person", "x_speople", 10), "orgs": ls("pos", "org", "x_sorg", 12),
         "differences": ls("kind, side, pos", "side || ':' || kind || ':' || item", "x_diff", 14), "next_steps": ls("pos, kind", "kind || ':' || ref", "x_step", 8), "caveats": ls("pos", "kind || ':' || ref", "x_caveat", 8)}


@query("pair_plan", """SELECT w.a, w.b, ga.label AS label_a, gb.label AS label_b, CASE WHEN w.b IS NULL THEN 'no_neighbour' WHEN w.a = w.b THEN 'same_entity' ELSE 'compared' END AS status,
  coalesce(ga.grp <> gb.grp, FALSE) AS cross_group, coalesce(s.supported, FALSE) AS supported, s.mechanism, s.co_papers, s.primary_kind, s.primary_item, coalesce(r.level, 'none') AS level, f.gap_a, f.gap_b, g.missing, g.next_question, """
       + ", ".join(f"coalesce(l_{k}.l, '') AS {k}" for k in LISTS) + """
FROM (SELECT a, b FROM x_top UNION ALL SELECT id, NULL FROM v_entity WHERE id NOT IN (SELECT id FROM x_nb) UNION ALL SELECT id, id FROM v_root) w JOIN v_entity ga ON ga.id = w.a LEFT JOIN v_entity gb ON gb.id = w.b
LEFT JOIN x_support s ON s.a = w.a AND s.b = w.b LEFT JOIN x_ready r ON r.a = w.a AND r.b = w.b LEFT JOIN x_fcount f ON f.a = w.a AND f.b = w.b
LEFT JOIN (SELECT g.* FROM x_gap g JOIN x_support s ON s.a = g.a AND s.b = g.b AND NOT supported) g ON g.a = w.a AND g.b = w.b """
       + " ".join(f"LEFT JOIN {q} l_{k} ON l_{k}.a = w.a AND l_{k}.b = w.b" for k, q in LISTS.items()))
def _(t):
    out = P.pair_plan(wanted(t), t("v_entity"), support(t), P.readiness(support(t), path(t)), heads(t), assets(t), people(t), orgs(t), diffs(t), counted_funds(t), steps(t), notes(t), gaps(t))
    flat = lambda name, *fields: F.coalesce(F.array_join(F.transform(name, lambda s: F.concat_ws(":", *[s[f] for f in fields])), "|"), F.lit("")).alias(name)
    plain = lambda name: F.coalesce(F.array_join(name, "|"), F.lit("")).alias(name)
    return out.select("a", "b", "label_a", "label_b", "status", "cross_group", "supported", "mechanism", "co_papers", "primary_kind", "primary_item", "level", "gap_a", "gap_b", "missing", "next_question",
                      flat("routes", "kind", "item"), plain("assets"), plain("people"), plain("orgs"), flat("differences", "side", "kind", "item"), flat("next_steps", "kind", "ref"), flat("caveats", "kind", "ref"))


@query("fact_rows")
def _(t):
    return P.fact_rows(support(t), B.top(t), heads(t), notes(t), diffs(t), gaps(t), orgs(t), people(t), assets(t), evidence(t), t("v_entity").select("id", "label"))


@query("card_facts")
def _(t):
    return P.card_facts(K.card(t))
