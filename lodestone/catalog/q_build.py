"""Resolution and graph construction over the bound source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog.q_functions import case_sql, inn, norm_sql
from lodestone.catalog.registry import query, view
from lodestone.functions import values as V
from lodestone.operators import build as G
from lodestone.operators import closure as C
from lodestone.operators import people as P
from lodestone.operators import resolve as R
from lodestone.operators import rollups as U
from lodestone.operators import similarity as S

r6 = lambda c: F.round(c, 6).alias(c)

# --- hierarchy -------------------------------------------------------------------------------------------------------
view("x_near", """SELECT id, parent AS node FROM v_entity JOIN v_hier ON child = id WHERE id NOT LIKE 'N:%'
UNION SELECT x_near.id, parent FROM x_near JOIN v_hier ON child = node WHERE node LIKE 'N:%'""")


@query("nearest_in_set", "SELECT id, node AS ancestor FROM x_near WHERE node NOT LIKE 'N:%'")
def _(t):
    return C.nearest_in_set(t("v_hier"), t("v_entity").where("id not like 'N:%'"))


@query("assign_groups", """
WITH m AS (SELECT c.id, string_agg(DISTINCT r.label, '|' ORDER BY r.label) AS grp FROM x_tclo c JOIN v_term r ON r.id = c.ancestor
  WHERE (r.id LIKE 'B:%' OR r.id LIKE 'Y:%') GROUP BY c.id)
SELECT a.id, coalesce(grp, 'bridge') AS grp, a.id IN (SELECT id FROM x_tclo WHERE ancestor = 'T:ROOT') AS is_bridge
FROM (SELECT id FROM m UNION SELECT 'T:ROOT') a LEFT JOIN m ON m.id = a.id WHERE a.id NOT LIKE '%/PROMO'""")
def _(t):
    roots = t("v_term").where("id like 'B:%' or id like 'Y:%'").select(F.col("id").alias("root"), F.col("label").alias("name"))
    bridge = t("v_term").where("id = 'T:ROOT'").select(F.col("id").alias("root"))
    return C.assign_groups(B.term_closure(t), roots, bridge, t("v_term").where("id like '%/PROMO'"))


# --- cross references, symbols, dictionaries ---------------------------------------------------------------------------
view("v_xterm", """SELECT entity AS id, CASE WHEN xref LIKE 'ORPHA%' THEN ' Orphanet' || substr(xref, 6) ELSE xref END AS xref,
  entity IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal < -900) AS deprecated FROM v_gd_raw
UNION ALL SELECT 'N:' || n_nationkey, 'ICD:' || n_name, n_regionkey < 0 FROM nation""")
view("v_in_set", "SELECT 'S:' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0")
view("x_xref", """SELECT DISTINCT regexp_replace(trim(xref), '^Orphanet:', 'ORPHA:') AS xref, id, id IN (SELECT id FROM v_in_set) AS in_set
FROM v_xterm WHERE NOT deprecated AND split_part(regexp_replace(trim(xref), '^Orphanet:', 'ORPHA:'), ':', 1) IN ('OMIM', 'ORPHA', 'MESH', 'DOID', 'UMLS', 'GARD')""")


@query("build_xref_map", "SELECT xref, id, in_set FROM x_xref")
def _(t):
    return R.build_xref_map(t("v_xterm"), t("v_in_set"))


@query("resolve_xref", """SELECT g.gene, g.xref, x.id AS resolved, count(*) AS n FROM v_gd_raw g JOIN x_xref x ON g.xref = x.xref AND x.in_set GROUP BY ALL""")
def _(t):
    xmap = R.build_xref_map(t("v_xterm"), t("v_in_set"))
    return R.resolve_xref(t("v_gd_raw").select("gene", "xref"), xmap).groupBy("gene", "xref", "resolved").agg(F.count("*").alias("n"))


@query("remap_alt_ids", """SELECT entity, coalesce(a.new_id, term) AS term, count(*) AS n FROM v_ann_raw
LEFT JOIN (SELECT id AS alt_id, replace(id, '/ECONOMY', '/STANDARD') AS new_id FROM v_leaf WHERE p_type = 'ECONOMY') a ON a.alt_id = term GROUP BY ALL""")
def _(t):
    alt = t("v_leaf").where("p_type = 'ECONOMY'").select(
        F.col("id").alias("alt_id"), F.replace("id", F.lit("/ECONOMY"), F.lit("/STANDARD")).alias("id"))
    return R.remap_alt_ids(t("v_ann_raw").select("entity", "term"), alt, "term").groupBy("entity", "term").agg(F.count("*").alias("n"))


view("v_sym_named", "SELECT p_name AS symbol, 'NCBIGene:' || p_partkey AS id, p_partkey AS pos FROM part WHERE p_name NOT LIKE 'red%'")
view("v_sym_listed", """SELECT p_name AS symbol, p_name || ' protein ' || p_partkey AS name,
  CASE WHEN p_name LIKE '%gear' THEN NULL ELSE 'HGNC:' || p_name END AS alt_id, p_brand AS synonym, p_partkey AS pos FROM part WHERE p_size <= 30""")


@query("resolve_genes", """
WITH ids AS (SELECT symbol, arg_max(id, pos) AS id, min(pos) AS pos FROM v_sym_named GROUP BY symbol),
ex AS (SELECT symbol, arg_min(alt_id, pos) AS alt_id, min(pos) AS lpos FROM v_sym_listed GROUP BY symbol),
a AS (SELECT coalesce(ids.symbol, ex.symbol) AS symbol, coalesce(id, alt_id) AS id, id IS NULL AS late, coalesce(pos, lpos) AS pos
  FROM ex FULL JOIN ids ON ids.symbol = ex.symbol WHERE coalesce(id, alt_id) IS NOT NULL),
f AS (SELECT id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late, pos, symbol) AS rn FROM a) u WHERE rn = 1),
d AS (SELECT a.id, l.name, l.synonym, l.pos FROM v_sym_listed l JOIN a ON a.symbol = l.symbol)
SELECT f.id, f.symbol, coalesce((SELECT arg_max(name, pos) FROM d WHERE d.id = f.id), '') AS name,
  coalesce((SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM (SELECT id, name AS s FROM d UNION SELECT id, synonym FROM d) y WHERE y.id = f.id AND s <> '' AND s <> f.symbol), '') AS synonyms
FROM f""")
def _(t):
    return R.resolve_genes(t("v_sym_named"), t("v_sym_listed")).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("collapse_parents", """SELECT v_term.id, label, coalesce(p, '') AS parents FROM v_term LEFT JOIN
(SELECT child, string_agg(parent, '|' ORDER BY parent) AS p FROM v_term_edge WHERE child LIKE 'L:%' GROUP BY child) u ON child = v_term.id""")
def _(t):
    return R.collapse_parents(t("v_term"), t("v_term_edge"), "L:").withColumn("parents", F.array_join("parents", "|"))


view("v_cur", "SELECT paper, 'MESH:' || substr(entity, 3) AS xref, major FROM v_men_raw WHERE system = 'MeSH'")
view("v_ext", """SELECT paper, CAST(min(n) AS VARCHAR(9)) || entity AS mention, 'MESH:' || substr(entity, 3) AS xref, s_name AS name, n
FROM v_men_raw JOIN supplier ON entity = 'S:' || s_suppkey WHERE system = 'PubTator' GROUP BY paper, entity, s_name, n""")
view("v_mesh", "SELECT 'MESH:' || s_suppkey AS xref, 'S:' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 2000")
view("v_names", "SELECT s_name AS text, 'S:' || s_suppkey AS entity FROM supplier WHERE s_acctbal < 6000 UNION ALL SELECT n_name, 'N:' || n_nationkey FROM nation")
view("x_exact_names", f"""SELECT norm, entity FROM (SELECT DISTINCT {norm_sql('text')} AS norm, entity FROM v_names) u WHERE length(norm) >= 4
  AND norm IN (SELECT norm FROM (SELECT DISTINCT {norm_sql('text')} AS norm, entity FROM v_names) w GROUP BY norm HAVING count(*) <= 2)""")
view("x_merged", f"""SELECT paper, entity, CASE WHEN bool_or(c) AND bool_or(e) THEN 'MeSH+PubTator' WHEN bool_or(c) THEN 'MeSH' ELSE 'PubTator' END AS source,
  bool_or(major) AS major, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT paper, entity, TRUE AS c, FALSE AS e, major, 0 AS n FROM v_cur JOIN v_mesh ON v_cur.xref = v_mesh.xref
  UNION ALL SELECT paper, entity, FALSE, TRUE, FALSE, n FROM (
    SELECT paper, mention, entity, n FROM v_ext JOIN v_mesh ON v_ext.xref = v_mesh.xref
    UNION SELECT paper, mention, entity, n FROM v_ext JOIN x_exact_names ON norm = {norm_sql('name')}) u) v GROUP BY paper, entity""")


def merged(t):
    return R.merge_mentions(t("v_cur"), t("v_ext"), t("v_mesh"), R.exact_names(t("v_names")))


@query("merge_mentions", "SELECT paper, entity, source, major, n FROM x_merged")
def _(t):
    return merged(t)


@query("merge_gene_mentions", """SELECT paper, 'NCBIGene:' || num AS gene, min(name) AS name, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT paper, unnest(string_split(ids, ';')) AS num, name, n FROM v_gmen_raw) u WHERE regexp_full_match(num, '[0-9]+') GROUP BY ALL""")
def _(t):
    return R.merge_gene_mentions(t("v_gmen_raw"))


view("v_syn_parts", """SELECT label AS text, id AS node_id, 'Disease' AS type, TRUE AS is_primary FROM v_entity
UNION ALL SELECT grp, id, 'Disease', FALSE FROM v_entity UNION ALL SELECT label, id, 'Phenotype', TRUE FROM v_term
UNION ALL SELECT name, id, 'Gene', TRUE FROM v_gene UNION ALL SELECT label, id, 'Gene', FALSE FROM v_gene UNION ALL SELECT name, id, 'Gene', FALSE FROM v_gene
UNION ALL SELECT label, id, 'Pathway', TRUE FROM v_pathway""")
view("x_synonym", """SELECT text, node_id, type, is_primary FROM (
SELECT *, row_number() OVER (PARTITION BY text, node_id ORDER BY is_primary DESC, type DESC) AS rn FROM v_syn_parts WHERE length(text) > 1) u WHERE rn = 1""")


@query("build_synonyms", "SELECT text, node_id, type, is_primary FROM x_synonym")
def _(t):
    return R.build_synonyms([t("v_syn_parts")])


@query("term_name_dictionary", f"""SELECT norm, ui FROM (SELECT norm, ui, row_number() OVER (PARTITION BY norm ORDER BY prio, ui) AS rn FROM (
SELECT {norm_sql("label")} AS norm, id AS ui, 0 AS prio FROM v_gene WHERE name LIKE 'red%' UNION ALL SELECT {norm_sql("name")}, 'P' || paper, 1 FROM v_gmen_raw
UNION ALL SELECT {norm_sql("name")}, id, 1 FROM v_gene) u WHERE norm <> '') v WHERE rn = 1""")
def _(t):
    curated = t("v_gene").where("name like 'red%'").select(F.col("label").alias("term"), F.col("id").alias("ui"))
    found = t("v_gmen_raw").select("name", F.concat(F.lit("P"), "paper").alias("ui")).unionByName(t("v_gene").select("name", F.col("id").alias("ui")))
    return R.term_name_dictionary(curated, found)


# --- edges -----------------------------------------------------------------------------------------------------------
@query("gene_disease_edges", """
WITH p AS (SELECT gene, entity, string_agg(paper, ';' ORDER BY paper) AS papers FROM (SELECT *, row_number() OVER (PARTITION BY gene, entity ORDER BY paper) AS rn
  FROM (SELECT DISTINCT gene, entity, paper FROM v_gd_raw WHERE paper <> '') u) v WHERE rn <= 20 GROUP BY gene, entity)
SELECT a.gene AS src, a.entity AS dst, CASE WHEN bool_or(causal) THEN 'causes' ELSE 'associated_with' END AS rel, string_agg(DISTINCT source, ' + ' ORDER BY source) AS source,
  min(xref) AS source_id, CAST(round(least(1.0, max(conf) + CASE WHEN count(DISTINCT source) > 1 THEN 0.05 ELSE 0.0 END), 6) AS DOUBLE) AS confidence,
  string_agg(DISTINCT atype, '|' ORDER BY atype) AS types, coalesce(string_agg(DISTINCT nullif(status, ''), '|' ORDER BY nullif(status, '')), '') AS statuses,
  coalesce(max(papers), '') AS papers
FROM x_assoc a LEFT JOIN p ON p.gene = a.gene AND p.entity = a.entity GROUP BY a.gene, a.entity""")
def _(t):
    return G.gene_disease_edges(t("v_gd_raw")).withColumn("confidence", F.round("confidence", 6))


FREQ = f"""coalesce({case_sql(V.FREQUENCY_TERMS, 'frequency')}, CASE WHEN TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 2) AS DOUBLE) > 0
    THEN TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 1) AS DOUBLE) / TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 2) AS DOUBLE) END,
  TRY_CAST(regexp_extract(frequency, '^([\\d.]+)%', 1) AS DOUBLE) / 100)"""


@query("annotation_edges", f"""
WITH r AS (SELECT entity, term, string_agg(reference, ';' ORDER BY reference) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY entity, term ORDER BY reference) AS rn
  FROM (SELECT DISTINCT entity, term, reference FROM v_ann_raw WHERE qualifier <> 'NOT') u) v WHERE rn <= 15 GROUP BY entity, term)
SELECT a.entity, a.term, CAST(max({case_sql(V.EVIDENCE_CONFIDENCE, 'evidence', '0.7')}) AS DOUBLE) AS confidence, round(max({FREQ}), 6) AS frequency_value,
  string_agg(DISTINCT onset, '|' ORDER BY onset) AS onset, string_agg(DISTINCT evidence, '|' ORDER BY evidence) AS evidence,
  max(regexp_extract(biocuration, '\\[(\\d{{4}}-\\d{{2}}-\\d{{2}})\\]', 1)) AS date,
  coalesce(min(CASE WHEN reference LIKE 'PMID:%' THEN reference END), min(reference)) AS source_id, max(refs) AS refs
FROM v_ann_raw a JOIN r ON r.entity = a.entity AND r.term = a.term WHERE qualifier <> 'NOT' GROUP BY a.entity, a.term""")
def _(t):
    return G.annotation_edges(t("v_ann_raw")).withColumn("frequency_value", F.round("frequency_value", 6))


@query("exclusion_annotations", """SELECT entity, term, reference, pos FROM (SELECT entity, term, reference, row_number() OVER (PARTITION BY entity ORDER BY term, reference) AS pos
FROM v_ann_raw WHERE qualifier = 'NOT') u WHERE pos <= 30""")
def _(t):
    return G.exclusion_annotations(t("v_ann_raw"))


view("x_subgraph", """SELECT c.ancestor AS term, count(DISTINCT entity) AS n_entities FROM v_ph JOIN x_tclo c ON c.id = term
WHERE c.ancestor IN (SELECT id FROM x_tclo WHERE ancestor = 'Y:PROMO') GROUP BY c.ancestor""")


@query("term_subgraph", """SELECT term AS child, '' AS parent, n_entities FROM x_subgraph UNION ALL
SELECT child, parent, 0 FROM v_term_edge WHERE child IN (SELECT term FROM x_subgraph) AND parent IN (SELECT term FROM x_subgraph)""")
def _(t):
    nodes, inner = G.term_subgraph(t("v_ph"), B.term_closure(t), "Y:PROMO", t("v_term_edge"))
    return nodes.select(F.col("term").alias("child"), F.lit("").alias("parent"), "n_entities").unionByName(
        inner.withColumn("n_entities", F.lit(0).cast("long")))


@query("pathway_edges", """SELECT gene, pathway, CAST(CASE WHEN evidence = 'TAS' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, evidence, n_genes AS pathway_genes
FROM v_pw_raw JOIN v_pathway ON id = pathway WHERE gene IN (SELECT gene FROM v_gd)""")
def _(t):
    return G.pathway_edges(t("v_pw_raw"), t("v_gd").select(F.col("gene").alias("id")).distinct())


@query("mention_edges", """SELECT paper, entity, source, major, n, CAST(round(CASE WHEN source = 'MeSH+PubTator' THEN CASE WHEN major THEN 0.95 ELSE 0.9 END
WHEN source = 'MeSH' THEN CASE WHEN major THEN 0.9 ELSE 0.8 END ELSE least(0.85, 0.5 + 0.1 * n) END, 6) AS DOUBLE) AS confidence FROM x_merged""")
def _(t):
    return G.mention_edges(merged(t)).withColumn("confidence", F.round("confidence", 6))


@query("supported_items", """SELECT id FROM (SELECT gene AS id FROM (SELECT paper, 'G:' || unnest(string_split(ids, ';')) AS gene FROM v_gmen_raw) u
GROUP BY gene HAVING count(DISTINCT paper) >= 3) v WHERE id IN (SELECT id FROM v_gene) UNION SELECT gene FROM v_gd WHERE rel = 'causes'""")
def _(t):
    men = t("v_gmen_raw").select("paper", F.explode(F.split("ids", ";")).alias("i")).select("paper", F.concat(F.lit("G:"), "i").alias("item"))
    return G.supported_items(men, t("v_gene"), t("v_gd").where("rel = 'causes'").select(F.col("gene").alias("id")))


view("v_node_parts", """SELECT 1 AS step, id, 'Disease' AS type, label, grp, 'bridge' AS attr, CASE WHEN grp = 'bridge' THEN 'yes' ELSE 'no' END AS value FROM v_entity
UNION ALL SELECT 2, entity, 'Disease', '', '', 'excluded', max(term) FROM v_excluded GROUP BY entity
UNION ALL SELECT 3, gene, 'Gene', min(entity), '', 'source', 'disease gene' FROM v_gd GROUP BY gene
UNION ALL SELECT 4, id, 'Gene', label, '', 'source', CASE WHEN name LIKE 'red%' THEN 'mentions' ELSE NULL END FROM v_gene
UNION ALL SELECT 5, id, 'Gene', label, 'x', 'name', name FROM v_gene""")


@query("upsert_nodes", """
WITH c AS (SELECT id, type, label, grp FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS rn FROM v_node_parts) u WHERE rn = 1),
a AS (SELECT id, string_agg(attr || '=' || value, '|' ORDER BY attr) AS attrs FROM (SELECT *, row_number() OVER (PARTITION BY id, attr ORDER BY step DESC) AS rn FROM v_node_parts WHERE value IS NOT NULL) u WHERE rn = 1 GROUP BY id)
SELECT c.id, type, label, grp, coalesce(attrs, '') AS attrs FROM c LEFT JOIN a ON a.id = c.id""")
def _(t):
    return G.upsert_nodes(t("v_node_parts"))


@query("propagate_groups", """SELECT gene, string_agg(DISTINCT grp, '|' ORDER BY grp) AS grp FROM v_gd JOIN v_entity ON v_entity.id = entity GROUP BY gene""")
def _(t):
    return G.propagate_groups(t("v_gd"), t("v_entity"), "gene", "entity")


view("v_loose_edge", "SELECT v_edge_raw.* FROM v_edge_raw")
view("v_some_node", "SELECT * FROM v_node WHERE NOT (type = 'Paper' AND label LIKE 'Case report%')")


@query("finalize_edges", """SELECT sha256(rel || '|' || src || '|' || dst || '|' || source_id) AS edge_id, rel, src, dst FROM v_loose_edge
WHERE src IN (SELECT id FROM v_some_node) AND dst IN (SELECT id FROM v_some_node)""")
def _(t):
    return G.finalize_edges(t("v_loose_edge"), t("v_some_node")).select("edge_id", "rel", "src", "dst")


@query("graph_counts", """
SELECT 'type' AS what, type AS key1, '' AS key2, count(*) AS n, CAST(NULL AS DOUBLE) AS share FROM v_node GROUP BY type
UNION ALL SELECT 'group', grp, type, count(*), NULL FROM v_node WHERE grp <> '' GROUP BY grp, type
UNION ALL SELECT 'rel', rel, evidence_type, count(*), NULL FROM v_edge_raw GROUP BY rel, evidence_type
UNION ALL SELECT 'evidence', evidence_type, '', count(*), round(count(*) / (SELECT count(*) FROM v_edge_raw), 6) FROM v_edge_raw GROUP BY evidence_type""")
def _(t):
    return G.graph_counts(t("v_node"), t("v_edge_raw")).withColumn("share", F.round("share", 6))


# --- people ------------------------------------------------------------------------------------------------------------
view("x_auth0", """SELECT r.pmid, r.pos, k.ln, k.ini, r.last, r.fore, k.fn, c.country, r.affiliation, r.year, regexp_replace(r.orcid, '^https?://orcid.org/', '') AS orcid
FROM v_author_row r JOIN x_author_key k ON k.pmid = r.pmid AND k.pos = r.pos JOIN x_country c ON c.affiliation = r.affiliation WHERE k.ln <> '' AND k.ini <> ''""")
view("x_auth_ids", """SELECT ln, ini, orcid, arg_min(fn, pmid) AS fn_id, arg_min(country, pmid) FILTER (WHERE country <> '') AS country_id
FROM x_auth0 WHERE orcid <> '' GROUP BY ln, ini, orcid""")
view("x_auth_sole", "SELECT ln, ini, min(orcid) AS sole, min(fn_id) AS fn_id, min(country_id) AS country_id FROM x_auth_ids GROUP BY ln, ini HAVING count(*) = 1")
view("x_auth_seen", "SELECT ln, ini, country, count(*) AS n FROM x_auth0 WHERE orcid = '' AND country <> '' GROUP BY ln, ini, country")
view("x_auth_top", "SELECT ln, ini, country AS top FROM (SELECT *, row_number() OVER (PARTITION BY ln, ini ORDER BY n DESC, country) AS rn FROM x_auth_seen) u WHERE rn = 1")
view("x_auth1", """SELECT a.*, CASE WHEN a.orcid <> '' THEN a.orcid WHEN sole IS NOT NULL AND (a.country = '' OR coalesce(country_id, a.country) = a.country)
    AND (a.fn = '' OR a.fn = s.fn_id OR coalesce(s.fn_id, '') = '') THEN sole ELSE '' END AS pid,
  CASE WHEN coalesce(n, 0) >= 2 THEN a.country ELSE coalesce(top, '') END AS place
FROM x_auth0 a LEFT JOIN x_auth_sole s ON s.ln = a.ln AND s.ini = a.ini LEFT JOIN x_auth_top t ON t.ln = a.ln AND t.ini = a.ini
LEFT JOIN x_auth_seen e ON e.ln = a.ln AND e.ini = a.ini AND e.country = a.country""")
view("x_auth", """SELECT a.*, pid = '' AND coalesce(nf, 0) >= 2 AND fn = '' AS risk, 'AUTH:' || CASE WHEN pid <> '' THEN pid ELSE a.ln || '|' || a.ini || '|' || a.place ||
  CASE WHEN coalesce(nf, 0) < 2 THEN '' WHEN fn <> '' THEN '|' || fn ELSE '|?' END END AS person
FROM x_auth1 a LEFT JOIN (SELECT ln, ini, place, count(DISTINCT fn) AS nf FROM x_auth1 WHERE pid = '' AND fn <> '' GROUP BY ln, ini, place) f
  ON f.ln = a.ln AND f.ini = a.ini AND f.place = a.place""")
view("x_people", """SELECT person AS id, count(DISTINCT pmid) AS n_papers, max(pid) AS orcid, bool_or(risk) AS homonym_risk, arg_min(last, (pmid, pos)) AS last,
  coalesce(arg_max(affiliation, (year, pmid, affiliation)) FILTER (WHERE affiliation <> ''), '') AS affiliation, min(ln) AS ln, min(ini) AS ini
FROM x_auth GROUP BY person HAVING count(DISTINCT pmid) >= 2""")
view("x_fore", """SELECT person, fore FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY fn <> '' DESC, n DESC, length(fore) DESC, fore DESC) AS rn FROM (
SELECT person, fore, fn, count(*) AS n FROM x_auth GROUP BY person, fore, fn) u) v WHERE rn = 1""")
view("x_land", """SELECT person, country FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, country) AS rn FROM (
SELECT person, country, count(*) AS n FROM x_auth WHERE country <> '' GROUP BY person, country) u) v WHERE rn = 1""")


def authors(t):
    return t.built("authors", lambda: P.disambiguate_authors(t("v_author_row")))


@query("disambiguate_authors", "SELECT pmid, pos, ln, ini, fn, country, pid AS orcid, person AS key, risk AS homonym_risk FROM x_auth")
def _(t):
    return P.disambiguate_authors(t("v_author_row")).select("pmid", "pos", "ln", "ini", "fn", "country", "orcid", "key", "homonym_risk")


@query("author_nodes", """SELECT p.id, trim(f.fore || ' ' || p.last) AS label, n_papers, orcid, homonym_risk, affiliation, coalesce(l.country, '') AS country,
CASE WHEN orcid <> '' THEN 'orcid' WHEN homonym_risk THEN 'name+initial+country (initials only; homonyms likely)' ELSE 'name+initial+country' END AS method
FROM x_people p JOIN x_fore f ON f.person = p.id LEFT JOIN x_land l ON l.person = p.id""")
def _(t):
    return P.author_nodes(authors(t))


@query("author_edges", """SELECT DISTINCT person AS src, 'PMID:' || pmid AS dst, year, CAST(CASE WHEN p.orcid <> '' THEN 0.95 WHEN p.homonym_risk THEN 0.5 ELSE 0.75 END AS DOUBLE) AS confidence
FROM x_auth JOIN x_people p ON p.id = person""")
def _(t):
    return P.author_edges(authors(t), P.author_nodes(authors(t)))


view("v_official", """SELECT 'NCT' || o_orderkey AS trial, 1 AS pos,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'Clinical Monitor' WHEN o_orderpriority = '3-MEDIUM' THEN 'T. ' ELSE 'Takashi ' END ||
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Mueller' WHEN 'BUILDING' THEN 'Nunez' WHEN 'AUTOMOBILE' THEN 'Smith' WHEN 'FURNITURE' THEN 'Tanaka' ELSE 'Kobayashi' END ||
  substr(r_name, 1, 2) || ', MD' AS name, 'Univ ' || c_mktsegment || CASE WHEN o_orderstatus = 'F' THEN ' ' || n_name ELSE ' elsewhere' END AS affiliation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderkey IN (SELECT v_trial.num FROM v_trial)""")
IW = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 3 AND w NOT IN " + inn(V.GENERIC_INSTITUTION_WORDS) + "))"
view("x_pword", f"""SELECT ln, ini, id AS cand, unnest(list_distinct(string_split({norm_sql('affiliation')}, ' '))) AS word FROM x_people""")
view("x_pname", """SELECT ln, ini, count(*) AS n_cand, min(p.id) AS only_one, min(coalesce(l.country, '')) AS only_country FROM x_people p LEFT JOIN x_land l ON l.person = p.id GROUP BY ln, ini""")
view("x_off", f"""SELECT *, lower(regexp_replace(w[-1], '[^A-Za-z]', '', 'g')) AS ln, lower(substr(w[1], 1, 1)) AS ini FROM (
SELECT *, trim(split_part(name, ',', 1)) AS raw, list_filter(regexp_split_to_array(replace(trim(split_part(name, ',', 1)), '.', ' '), '\\s+'), lambda w: w <> '') AS w FROM v_official) u
WHERE len(w) >= 2 AND NOT regexp_matches(raw, '{V.BAD_OFFICIAL}', 'i')""")


def people(t):
    return t.built("people", lambda: P.author_nodes(authors(t)).join(
        authors(t).groupBy(F.col("key").alias("id")).agg(F.min("ln").alias("ln"), F.min("ini").alias("ini")), "id"))


@query("match_officials", f"""
WITH h AS (SELECT trial, pos, count(DISTINCT cand) AS n_hit, min(cand) AS hit FROM (SELECT trial, pos, ln, ini, unnest({IW.format(norm_sql('affiliation'))}) AS word FROM x_off) o
  JOIN x_pword p ON p.ln = o.ln AND p.ini = o.ini AND p.word = o.word GROUP BY trial, pos)
SELECT o.trial, o.pos, CASE WHEN n_hit = 1 THEN hit WHEN n_cand = 1 THEN only_one ELSE 'AUTH:ct|' || o.ln || '|' || o.ini || '|' || replace({norm_sql('affiliation')}, ' ', '-') END AS person,
  CASE WHEN n_hit = 1 THEN 'name + affiliation' WHEN n_cand = 1 THEN 'name' ELSE 'new' END AS how,
  CAST(CASE WHEN n_hit = 1 THEN 0.85 WHEN n_cand = 1 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence
FROM x_off o LEFT JOIN h ON h.trial = o.trial AND h.pos = o.pos LEFT JOIN x_pname n ON n.ln = o.ln AND n.ini = o.ini""")
def _(t):
    return P.match_officials(t("v_official"), people(t))


view("v_pi", """SELECT 'GRANT:C' || c_custkey AS grant_id, 'pi' || c_custkey AS profile, CASE WHEN c_acctbal > 8000 THEN 'Takashi ' WHEN c_acctbal > 4000 THEN 'T ' ELSE 'Zoe ' END ||
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Mueller' WHEN 'BUILDING' THEN 'Nunez' WHEN 'AUTOMOBILE' THEN 'Smith' WHEN 'FURNITURE' THEN '' ELSE 'Kobayashi' END ||
  substr(r_name, 1, 2) || ' Jr' AS name, CASE WHEN c_acctbal > 6000 THEN 'University of ' || c_mktsegment ELSE n_name END AS affiliation
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("x_pi", f"""SELECT *, CASE WHEN len(w) >= 2 THEN lower(regexp_replace(w[-1], '[^A-Za-z]', '', 'g')) END AS ln, CASE WHEN len(w) >= 2 THEN lower(substr(w[1], 1, 1)) END AS ini FROM (
SELECT *, list_filter(regexp_split_to_array(replace(name, '.', ' '), '[\\s,]+'), lambda w: w <> '' AND lower(w) NOT IN {inn(V.NAME_SUFFIXES)}) AS w FROM v_pi) u""")


@query("match_principal_investigators", f"""
WITH h AS (SELECT grant_id, profile, count(DISTINCT cand) AS n_hit, min(cand) AS hit FROM (SELECT grant_id, profile, ln, ini, unnest({IW.format(norm_sql('affiliation'))}) AS word FROM x_pi) o
  JOIN x_pword p ON p.ln = o.ln AND p.ini = o.ini AND p.word = o.word GROUP BY grant_id, profile)
SELECT o.grant_id, o.profile, CASE WHEN n_hit = 1 THEN hit WHEN n_cand = 1 AND only_country IN ('usa', '') THEN only_one ELSE 'AUTH:nih|' || o.profile END AS person,
  CASE WHEN n_hit = 1 THEN 'name + affiliation match to existing researcher' WHEN n_cand = 1 AND only_country IN ('usa', '') THEN 'name match to existing researcher' ELSE 'profile id' END AS how,
  CAST(CASE WHEN n_hit = 1 THEN 0.8 WHEN n_cand = 1 AND only_country IN ('usa', '') THEN 0.6 ELSE 0.95 END AS DOUBLE) AS confidence
FROM x_pi o LEFT JOIN h ON h.grant_id = o.grant_id AND h.profile = o.profile LEFT JOIN x_pname n ON n.ln = o.ln AND n.ini = o.ini""")
def _(t):
    return P.match_principal_investigators(t("v_pi"), people(t))


# --- roll-ups ------------------------------------------------------------------------------------------------------------
@query("rollup_projects", """
SELECT core, count(*) AS n_rows, arg_max(project_num, (fy, project_num)) AS latest, min(fy) AS fy_first, max(fy) AS fy_last, count(DISTINCT fy) AS n_years,
  round(sum(amount), 2) AS amount, round(sum(CASE WHEN fy = 1998 THEN amount END), 2) AS amount_1998, min(start_date) AS start_date, max(end_date) AS end_date,
  (max(end_date) <> '' AND max(end_date) >= '2001-01-01') OR bool_or(active AND fy >= 2000) AS active FROM v_project_raw GROUP BY core""")
def _(t):
    out = U.rollup_projects(t("v_project_raw"), "2001-01-01", 2000)
    return out.withColumn("amount", F.round("amount", 2)).withColumn("amount_1998", F.round(F.try_element_at("amount_by_fy", F.lit(1998)), 2)).drop("amount_by_fy")


@query("variant_class_counts", """SELECT gene, count(*) FILTER (WHERE cls = 'pathogenic') AS pathogenic, count(*) FILTER (WHERE cls = 'vus') AS vus,
count(*) FILTER (WHERE cls = 'benign') AS benign, count(*) FILTER (WHERE cls = 'conflicting') AS conflicting, count(*) AS total
FROM (SELECT gene, variation, arg_min(cls, significance) AS cls FROM x_variant GROUP BY gene, variation) u GROUP BY gene""")
def _(t):
    return U.variant_class_counts(t("v_variant_raw"))


view("x_var_one", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene, variation ORDER BY significance, review, submitters, condition_ids) AS r1 FROM x_variant) u WHERE r1 = 1""")
view("x_var_top", """SELECT * FROM (SELECT gene, variation, stars, CAST(submitters AS DOUBLE) AS nsub, condition_ids,
  row_number() OVER (PARTITION BY gene ORDER BY stars DESC, CAST(submitters AS DOUBLE) DESC, variation) AS rank
  FROM x_var_one WHERE cls = 'pathogenic' AND stars >= 1) u WHERE rank <= 3""")


@query("top_variants", "SELECT gene, variation, stars, nsub, rank FROM x_var_top")
def _(t):
    return U.top_variants(t("v_variant_raw"), 3).select("gene", "variation", "stars", "nsub", "rank")


view("v_omim_map", "SELECT DISTINCT 'OMIM:' || l_orderkey AS xref, 'S:' || l_suppkey AS entity FROM lineitem UNION SELECT 'ORPHA:' || s_suppkey, 'S:' || s_suppkey FROM supplier WHERE s_acctbal > 5000")


@query("variant_edges", """
WITH k AS (SELECT variation, stars, trim(unnest(regexp_split_to_array(condition_ids, '[|;,]'))) AS tok FROM x_var_top),
h AS (SELECT variation, stars, substr(tok, 13) AS entity FROM k WHERE tok LIKE 'MONDO:MONDO:%' UNION
  SELECT variation, stars, entity FROM k JOIN v_omim_map ON xref = CASE WHEN tok LIKE 'OMIM:%' THEN tok WHEN tok LIKE 'Orphanet:%' THEN 'ORPHA:' || substr(tok, 10) END)
SELECT DISTINCT 'VAR:' || variation AS src, gene AS dst, 'variant_of' AS rel, CAST(CASE stars WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 ELSE 0.95 END AS DOUBLE) AS confidence FROM x_var_top
UNION SELECT 'VAR:' || variation, entity, 'pathogenic_for', CASE stars WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 ELSE 0.95 END FROM h WHERE entity IN (SELECT id FROM v_in_set)""")
def _(t):
    return U.variant_edges(U.top_variants(t("v_variant_raw"), 3), t("v_omim_map"), t("v_in_set"))


view("v_epi", """SELECT 'ORPHA:' || p_partkey AS code, CASE WHEN p_size < 20 THEN NULL ELSE '1-9 / ' || p_size END AS prevalence, p_brand AS onset, p_type AS inheritance, p_size, p_name FROM part""")
view("v_epi_map", "SELECT DISTINCT 'ORPHA:' || l_partkey AS xref, 'S:' || l_suppkey AS entity FROM lineitem")


@query("attach_epidemiology", """
SELECT entity, code, prevalence, onset, inheritance FROM (SELECT entity, code, prevalence, CASE WHEN p_size < 30 THEN onset ELSE '' END AS onset,
  CASE WHEN p_name LIKE 'red%' THEN inheritance ELSE '' END AS inheritance, row_number() OVER (PARTITION BY entity ORDER BY code) AS rn
  FROM v_epi JOIN v_epi_map ON code = xref WHERE prevalence IS NOT NULL OR p_size < 10 OR p_name LIKE 'red%') u WHERE rn = 1""")
def _(t):
    none = F.array().cast("array<string>")
    rec = t("v_epi").select("code", "prevalence", F.when(F.col("p_size") < 30, F.array("onset")).otherwise(none).alias("onset"),
                            F.when(F.col("p_name").startswith("red"), F.array("inheritance")).otherwise(none).alias("inheritance"), "p_size")
    rec = rec.withColumn("onset", F.when((F.col("p_size") >= 10) & (F.col("p_size") < 20) & (F.size("inheritance") == 0), none).otherwise(F.col("onset")))
    return U.attach_epidemiology(rec.drop("p_size"), t("v_epi_map"))
