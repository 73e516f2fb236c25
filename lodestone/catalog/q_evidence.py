"""Evidence flags and assessment over every edge of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog import q_lookup as K
from lodestone.catalog.q_functions import RECENCY, STOP_W, URL_SQL, inn
from lodestone.catalog.registry import query, view
from lodestone.common import union_all
from lodestone.functions import rules as R
from lodestone.functions import values as V
from lodestone.operators import evidence as E
from lodestone.operators import similarity as S

AS_OF = 2010
FIELDS = "edge_id, kind, CAST(weight AS DOUBLE) AS weight, ref_id"


def similar(t):
    return t.built("similar", lambda: S.similarity_edges(B.top(t), "2001-01-01").withColumn("a", F.col("src")).withColumn("b", F.col("dst")))


def edges(t):
    return t.built("all_edges", lambda: t("v_edge").unionByName(similar(t).select(*t("v_edge").columns)))


def all_given(t):
    """All edges, not written."""
    return t("v_edge").unionByName(similar(t).select(*t("v_edge").columns))


def given(t):
    """Edges without the similarity edges, not written: a rule on one relation reads the sources of that relation only."""
    return t("v_edge")


def rated(t):
    return t.built("rated", lambda: E.rated_papers(t("v_paper")))


view("x_simedge", """SELECT sha256('similar_to|' || a || '|' || b || '|sim-v1') AS edge_id, a, b, score, s_term, s_path, s_lit, below_threshold FROM x_top""")
view("x_edge", """SELECT edge_id, src, dst, rel, source, source_id, date, confidence, evidence_type FROM v_edge UNION ALL
SELECT edge_id, a, b, 'similar_to', 'Similarity (IC-weighted cosine + pathway Jaccard + co-mention)', 'sim-v1', '2001-01-01', score, 'inferred' FROM x_simedge""")
view("x_rated", f"""SELECT id AS paper, kind, CASE kind WHEN 'retracted_paper' THEN 1.0 WHEN 'negative_title' THEN 0.5 WHEN 'comment_paper' THEN 0.2 ELSE 0.15 END::DOUBLE AS weight, year, title FROM (
  SELECT p.id, year, title, CASE WHEN pub_type IN {inn(V.RETRACTED_TYPES)} THEN 'retracted_paper' WHEN neg_where = 'title' THEN 'negative_title'
    WHEN pub_type IN {inn(V.COMMENT_TYPES)} THEN 'comment_paper' WHEN neg_where = 'abstract' THEN 'negative_abstract' END AS kind FROM v_paper p JOIN x_neg n ON n.id = p.id) u WHERE kind IS NOT NULL""")


def capped(links: str, cap: int) -> str:
    return f"""SELECT edge_id, kind, weight, paper AS ref_id FROM (SELECT l.edge_id, r.kind, r.weight, r.paper,
  row_number() OVER (PARTITION BY l.edge_id ORDER BY r.weight DESC, r.year, r.paper) AS rn FROM (SELECT DISTINCT edge_id, paper FROM {links}) l JOIN x_rated r ON r.paper = l.paper) u WHERE rn <= {cap}"""


FLAGS: dict = {}


def flag(name: str, sql: str):
    """Register a flag query and keep it for the union of all flags."""
    view(f"x_f_{name}", sql)

    def wrap(fn):
        FLAGS[name] = fn
        return query(f"flag_{name}", f"SELECT {FIELDS} FROM x_f_{name}")(fn)

    return wrap


@flag("stopped_study", f"""SELECT e.edge_id, 'trial_stopped' AS kind, w AS weight, t.id AS ref_id FROM x_edge e JOIN (SELECT id, {STOP_W} AS w FROM v_trial) t
ON t.id = CASE WHEN rel IN ('studies', 'cites') THEN src WHEN rel IN ('investigates', 'runs') THEN dst END WHERE w IS NOT NULL""")
def _(t):
    return E.flag_stopped_study(given(t), t("v_trial"))


@flag("cited_papers", capped("(SELECT edge_id, dst AS paper FROM x_edge WHERE rel = 'cites')", 1))
def _(t):
    return E.flag_cited_papers(given(t), rated(t))


view("x_iv", "SELECT DISTINCT id AS trial, unnest(regexp_extract_all(lower(intervention), '[a-z][a-z\\-]{5,}')) AS word FROM (SELECT id, title || ' ' || intervention AS intervention FROM v_trial) u")


@flag("intervention_papers", f"""SELECT edge_id, kind, weight, paper AS ref_id FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY weight DESC, year, paper) AS rn FROM (
  SELECT DISTINCT e.edge_id, r.paper, r.kind, r.weight, r.year FROM x_edge e JOIN x_iv w ON w.trial = e.src AND word NOT IN {inn(E.GENERIC_INTERVENTION)}
  JOIN x_ep p ON p.id = e.dst JOIN x_rated r ON r.paper = p.paper AND contains(lower(r.title), w.word) WHERE e.rel = 'studies') u) v WHERE rn <= 3""")
def _(t):
    text = t("v_trial").select(F.col("id").alias("trial"), F.concat_ws(" ", "title", "intervention").alias("text"))
    return E.flag_intervention_papers(given(t), text, K.papers(t), rated(t))


@flag("source_conflict", """WITH f AS (SELECT gene, entity, bool_or(causal) AS c, bool_or(NOT causal AND upper(atype) <> 'UNKNOWN') AS o, bool_or(status = 'Not yet assessed') AS n,
  bool_or(source = 'HPO') AS h, bool_or(source = 'Orphanet') AS r FROM x_assoc GROUP BY gene, entity), j AS (SELECT edge_id, f.* FROM x_edge JOIN f ON src = gene AND dst = entity WHERE rel IN ('causes', 'associated_with'))
SELECT edge_id, 'conflicting_status' AS kind, 0.6 AS weight, '' AS ref_id FROM j WHERE c AND o UNION ALL SELECT edge_id, 'not_assessed', 0.5, '' FROM j WHERE n UNION ALL SELECT edge_id, 'single_source', 0.1, '' FROM j WHERE h <> r""")
def _(t):
    return E.flag_source_conflict(given(t), t("v_gd_raw"))


@flag("excluded_pair", """SELECT s.edge_id, 'excluded_phenotype' AS kind, 0.5 AS weight, x.entity || '|' || x.term AS ref_id FROM (SELECT edge_id, a AS x, b AS y FROM x_simedge UNION ALL SELECT edge_id, b, a FROM x_simedge) s
JOIN v_excluded x ON x.entity = s.x JOIN x_lookup_profile p ON p.entity = s.y AND p.term = x.term""")
def _(t):
    return E.flag_excluded_pair(similar(t), t("v_excluded"), K.terms(t))


@flag("excluded_self", """SELECT e.edge_id, 'excluded_phenotype' AS kind, 0.5 AS weight, src || '|' || dst AS ref_id FROM x_edge e JOIN v_excluded x ON x.entity = src AND x.term = dst WHERE rel = 'has_phenotype'""")
def _(t):
    return E.flag_excluded_self(given(t), t("v_excluded"))


view("x_simpaper", "SELECT edge_id, p.paper FROM x_simedge s JOIN x_ep p ON p.id = s.a JOIN x_ep q ON q.id = s.b AND q.paper = p.paper")


@flag("no_cooccurrence", "SELECT edge_id, 'absence' AS kind, CAST(0.3 AS DOUBLE) AS weight, '' AS ref_id FROM x_simedge WHERE edge_id NOT IN (SELECT edge_id FROM x_simpaper) UNION ALL " + capped("x_simpaper", 3))
def _(t):
    return E.flag_no_cooccurrence(similar(t), K.papers(t), rated(t))


@flag("below_threshold", "SELECT edge_id, 'below_threshold' AS kind, 0.3 AS weight, '' AS ref_id FROM x_simedge WHERE below_threshold")
def _(t):
    return E.flag_below_threshold(similar(t))


@flag("single_mention", """SELECT e.edge_id, 'single_mention' AS kind, 0.2 AS weight, '' AS ref_id FROM x_edge e JOIN v_men m ON m.paper = src AND m.entity = dst WHERE rel = 'mentions' AND e.source NOT LIKE '%MeSH%' AND n <= 1
UNION ALL SELECT e.edge_id, 'retracted_paper', 1.0, src FROM x_edge e JOIN x_rated r ON r.paper = src AND kind = 'retracted_paper' WHERE rel = 'mentions'""")
def _(t):
    return E.flag_single_mention(given(t), t("v_men"), rated(t))


@flag("author_identity", "SELECT edge_id, 'author_identity' AS kind, 0.2 AS weight, '' AS ref_id FROM x_edge JOIN v_person p ON p.id = src AND orcid = '' WHERE rel = 'authored'")
def _(t):
    return E.flag_author_identity(given(t), t("v_person"))


@flag("grant_match", """WITH j AS (SELECT edge_id, field, active FROM x_edge JOIN v_fund f ON f.grant_id = src AND f.entity = dst JOIN v_grant g ON g.id = src WHERE rel = 'funds')
SELECT edge_id, 'terms_only' AS kind, 0.3 AS weight, '' AS ref_id FROM j WHERE field = 'terms' UNION ALL SELECT edge_id, 'symbol_only', 0.3, '' FROM j WHERE field = 'gene symbol' UNION ALL SELECT edge_id, 'inactive', 0.1, '' FROM j WHERE NOT active""")
def _(t):
    return E.flag_grant_match(given(t), t("v_fund"), t("v_grant"))


@flag("lead_identity", "SELECT edge_id, 'lead_identity' AS kind, 0.25 AS weight, '' AS ref_id FROM x_edge JOIN v_lead l ON l.person = src AND l.grant_id = dst AND identity_match LIKE '%existing researcher%' WHERE rel = 'leads'")
def _(t):
    return E.flag_lead_identity(given(t), t("v_lead"))


@flag("low_review", "SELECT edge_id, 'low_review' AS kind, 0.2 AS weight, '' AS ref_id FROM x_edge JOIN (SELECT DISTINCT id FROM v_var WHERE stars <= 1) v ON v.id = src WHERE rel IN ('variant_of', 'pathogenic_for')")
def _(t):
    return E.flag_low_review(given(t), t("v_var"))


@flag("gene_reference_papers", capped("(SELECT edge_id, paper FROM x_edge JOIN v_gd_raw g ON g.gene = src AND g.entity = dst AND paper <> '' WHERE rel IN ('causes', 'associated_with'))", 2))
def _(t):
    return E.flag_gene_reference_papers(given(t), t("v_gd_raw"), rated(t))


view("x_flags", " UNION ALL ".join(f"SELECT edge_id, kind, CAST(weight AS DOUBLE) AS weight, ref_id FROM x_f_{n}" for n in FLAGS))


def all_flags(t):
    return t.built("flags", lambda: union_all([fn(t) for name, fn in FLAGS.items() if t.rels is None or name == "below_threshold" or t.rels & ABOUT[name]]))


#: Relations that a rule is about.
ABOUT = {"stopped_study": {"studies", "cites", "investigates", "runs"}, "cited_papers": {"cites"}, "intervention_papers": {"studies"}, "source_conflict": {"causes", "associated_with"},
         "excluded_pair": {"similar_to"}, "excluded_self": {"has_phenotype"}, "no_cooccurrence": {"similar_to"}, "below_threshold": {"similar_to"}, "single_mention": {"mentions"},
         "author_identity": {"authored"}, "grant_match": {"funds"}, "lead_identity": {"leads"}, "low_review": {"variant_of", "pathogenic_for"}, "gene_reference_papers": {"causes", "associated_with"}}


class Part:
    """The tables of `t` with some of its edges only, which are read several times; `rels` are the relations among them."""

    def __init__(self, t, edges):
        self.t, self.rels = t, {r.rel for r in edges.select("rel").distinct().collect()}
        self._own = {"all_edges": edges, "similar": similar(t).join(edges.select("edge_id"), "edge_id", "left_semi")}

    def __call__(self, name):
        return self._own["all_edges"].where("rel <> 'similar_to'") if name == "v_edge" else self.t(name)

    def built(self, name, make):
        if name in ("flags", "references") and name not in self._own:
            self._own[name] = make()
        return self._own[name] if name in self._own else self.t.built(name, make)


def assess_some(t, edges):
    """The assessment of some edges, as it is among all of them."""
    return assess(Part(t, edges))


FAM = " + ".join(f"CASE WHEN contains(lower(source), '{f.lower()}') THEN 1 ELSE 0 END" for f in V.SOURCE_FAMILIES)
view("x_nsrc", f"""SELECT e.edge_id, CAST(greatest(1, CASE WHEN rel = 'similar_to' THEN CASE WHEN s_term > 0 THEN 1 ELSE 0 END + CASE WHEN s_path > 0 THEN 1 ELSE 0 END + CASE WHEN s_lit > 0 THEN 1 ELSE 0 END
  WHEN rel IN ('causes', 'associated_with') THEN {FAM} + coalesce(g.has_paper, 0) WHEN rel = 'studies' THEN 1 + CASE WHEN src IN (SELECT trial FROM v_cite) THEN 1 ELSE 0 END
  WHEN rel = 'has_phenotype' THEN 1 + coalesce(p.has_paper, 0) WHEN rel = 'funds' THEN 1 ELSE {FAM} END) AS INT) AS n_sources
FROM x_edge e LEFT JOIN x_simedge s ON s.edge_id = e.edge_id LEFT JOIN (SELECT gene, entity, has_paper FROM v_gd) g ON g.gene = src AND g.entity = dst AND rel IN ('causes', 'associated_with')
LEFT JOIN (SELECT entity, term, has_paper FROM v_ph) p ON p.entity = src AND p.term = dst AND rel = 'has_phenotype'""")


def sources(t, written=True):
    gp = t("v_gd").where("has_paper = 1").select(F.col("gene").alias("src"), F.col("entity").alias("dst"))
    tp = t("v_ph").where("has_paper = 1").select(F.col("entity").alias("src"), F.col("term").alias("dst"))
    return E.independent_sources(edges(t) if written else all_given(t), similar(t), gp, tp, t("v_cite").select("trial"))


@query("independent_sources", "SELECT edge_id, n_sources FROM x_nsrc")
def _(t):
    return sources(t, written=False)


view("x_ref", """SELECT edge_id, source_id AS paper FROM x_edge WHERE source_id LIKE 'PMID:%' UNION SELECT edge_id, paper FROM x_edge JOIN v_gd_raw g ON g.gene = src AND g.entity = dst AND paper <> '' WHERE rel IN ('causes', 'associated_with')
UNION SELECT edge_id, reference FROM x_edge JOIN v_ann_raw a ON a.entity = src AND a.term = dst AND qualifier = '' AND a.reference LIKE 'PMID:%' WHERE rel = 'has_phenotype'
UNION SELECT edge_id, paper FROM (SELECT edge_id, s.paper, row_number() OVER (PARTITION BY edge_id ORDER BY num DESC, s.paper) AS rn FROM x_simpaper s JOIN v_paper p ON p.id = s.paper) u WHERE rn <= 10""")


def references(t):
    """Papers behind edges: source ids and detail lists, spelled out as rows."""
    def similar_papers():
        sample = S.co_mentions(B.top(t), K.papers(t).withColumnRenamed("id", "entity").withColumnRenamed("paper", "item").join(
            t("v_paper").select(F.col("id").alias("item"), "num"), "item"))
        return similar(t).join(sample, ["a", "b"]).select("edge_id", F.explode(F.split("sample", r"\|")).alias("paper"))

    def make():
        e = edges(t)
        gd = e.where(F.col("rel").isin("causes", "associated_with")).join(
            t("v_gd_raw").select(F.col("gene").alias("src"), F.col("entity").alias("dst"), F.col("paper").alias("ref")), ["src", "dst"])
        ph = e.where("rel = 'has_phenotype'").join(t("v_ann_raw").where("qualifier = ''").select(
            F.col("entity").alias("src"), F.col("term").alias("dst"), F.col("reference").alias("ref")), ["src", "dst"])
        listed = gd.select("edge_id", "source_id", "ref").unionByName(ph.select("edge_id", "source_id", "ref")).unionByName(
            e.select("edge_id", "source_id", F.lit("").alias("ref")))
        own = listed.select("edge_id", F.explode(R.evidence_pmids("source_id", F.array("ref"))).alias("paper"))
        return (own if t.rels is not None and "similar_to" not in t.rels else own.unionByName(similar_papers())).distinct()

    return t.built("references", make)


@query("evidence_pmids", "SELECT edge_id, paper FROM x_ref")
def _(t):
    return references(t)


view("x_assess", f"""SELECT *, CASE WHEN supporting = 0 THEN 'unsupported' WHEN contra >= 0.6 THEN 'mixed' WHEN overall < 0.5 OR (evidence_type = 'inferred' AND n_sources < 2) OR caveat >= 0.5 THEN 'weak' ELSE 'supported' END AS stance FROM (
  SELECT *, round(greatest(0.0, least(1.0, confidence * recency + bonus - penalty)), 9) AS overall,
    CASE WHEN confidence <= 0 THEN 0 WHEN rel IN ('mentions', 'authored') THEN greatest(1, n_papers) ELSE n_papers + n_sources END AS supporting FROM (
    SELECT e.edge_id, rel, evidence_type, confidence, n_sources, {RECENCY.format('date')} AS recency, CASE WHEN n_sources <= 1 THEN 0.0 WHEN n_sources = 2 THEN 0.05 ELSE 0.08 END AS bonus,
      least(0.4, 0.25 * coalesce(contra, 0.0) + 0.05 * coalesce(caveat, 0.0)) AS penalty, coalesce(contra, 0.0) AS contra, coalesce(caveat, 0.0) AS caveat, coalesce(n_contra, 0) AS n_contra, coalesce(n_caveats, 0) AS n_caveats, coalesce(n_papers, 0) AS n_papers
    FROM x_edge e LEFT JOIN (SELECT edge_id, round(sum(CASE WHEN weight >= 0.45 THEN weight ELSE 0.0 END), 9) AS contra, round(sum(CASE WHEN weight < 0.45 THEN weight ELSE 0.0 END), 9) AS caveat,
      count(*) FILTER (WHERE weight >= 0.45) AS n_contra, count(*) FILTER (WHERE weight < 0.45) AS n_caveats FROM x_flags GROUP BY edge_id) f ON f.edge_id = e.edge_id
    JOIN x_nsrc n ON n.edge_id = e.edge_id LEFT JOIN (SELECT edge_id, count(*) AS n_papers FROM x_ref GROUP BY edge_id) r ON r.edge_id = e.edge_id) u) v""")


def assess(t):
    support = references(t).groupBy("edge_id").agg(F.count("*").alias("n_papers"))
    return E.assess_edges(edges(t), all_flags(t), sources(t), support, AS_OF)


def assessed(t):
    return t.built("assessed", lambda: assess(t))


@query("assess_edges", """SELECT edge_id, rel, evidence_type, round(confidence, 6) AS confidence, n_sources, CAST(round(recency, 6) AS DOUBLE) AS recency, CAST(bonus AS DOUBLE) AS bonus, CAST(round(penalty, 6) AS DOUBLE) AS penalty,
  round(overall, 6) AS overall, CAST(supporting AS BIGINT) AS supporting, n_contra, n_caveats, stance FROM x_assess""")
def _(t):
    out = assess(t)
    for c in ("confidence", "recency", "penalty", "overall"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("assessment_summary", """SELECT rel, count(*) FILTER (WHERE stance = 'supported') AS supported, count(*) FILTER (WHERE stance = 'mixed') AS mixed, count(*) FILTER (WHERE stance = 'weak') AS weak,
  count(*) FILTER (WHERE stance = 'unsupported') AS unsupported FROM x_assess GROUP BY rel""")
def _(t):
    return E.assessment_summary(assessed(t))


@query("edge_report", f"""SELECT e.edge_id, e.src, e.dst, e.rel, s.label AS src_label, d.label AS dst_label, s.type AS src_type, d.type AS dst_type, {URL_SQL.replace('source_id', 'e.source_id')} AS url,
  round(CASE WHEN e.evidence_type <> 'curated' THEN overall ELSE e.confidence END, 6) AS shown_confidence, round(overall, 6) AS overall, n_sources, CAST(supporting AS BIGINT) AS supporting, n_contra, n_caveats, stance, coalesce(papers, '') AS papers
FROM x_edge e LEFT JOIN v_node s ON s.id = e.src LEFT JOIN v_node d ON d.id = e.dst JOIN x_assess a ON a.edge_id = e.edge_id
LEFT JOIN (SELECT edge_id, string_agg(paper, '|' ORDER BY paper) AS papers FROM (SELECT edge_id, paper, row_number() OVER (PARTITION BY edge_id ORDER BY paper) AS rn FROM x_ref) u WHERE rn <= 20 GROUP BY edge_id) r ON r.edge_id = e.edge_id""")
def _(t):
    out = E.edge_report(edges(t), assessed(t), t.built("nodes", lambda: t("v_node")), references(t))
    return out.withColumn("papers", F.array_join("papers", "|")).withColumn("shown_confidence", F.round("shown_confidence", 6)).withColumn("overall", F.round("overall", 6))
