"""Graph views over the given tables.

Each view is SQL that Spark and DuckDB both read. The views play the part of landed source records (names ending in
`_raw`) and of the property graph at rest (`v_node`, `v_edge` and one table per relation).
"""

from __future__ import annotations

from lodestone.catalog.registry import view

# --- hierarchy of entities: supplier -> nation -> region -> one root -----------------------------------------------
view("v_entity", """
SELECT 'S:' || s_suppkey AS id, s_name AS label, r_name AS grp FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'N:' || n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'R:' || r_regionkey, r_name, r_name FROM region
UNION ALL SELECT 'E:ROOT' AS id, 'All entities' AS label, 'bridge' AS grp FROM (SELECT min(r_regionkey) AS k FROM region) one
""")
view("v_hier", """
SELECT 'S:' || s_suppkey AS child, 'N:' || s_nationkey AS parent FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
UNION ALL SELECT 'R:' || r_regionkey, 'E:ROOT' FROM region
""")
view("v_root", """SELECT id FROM v_entity WHERE id = 'E:ROOT' OR id IN (SELECT parent FROM v_hier WHERE child LIKE 'N:%')""")

# --- term DAG: leaf brand|type with two parents ----------------------------------------------------------------------
view("v_leaf", "SELECT DISTINCT 'L:' || p_brand || '/' || p_type || '/' || p_size AS id, p_brand, p_type, p_size FROM part")
view("v_term", """
SELECT id, p_type || ' of ' || p_brand || ' in size ' || p_size AS label FROM v_leaf
UNION ALL SELECT DISTINCT 'B:' || p_brand, p_brand FROM part
UNION ALL SELECT DISTINCT 'Y:' || p_type, p_type FROM part
UNION ALL SELECT DISTINCT 'T:ROOT', 'All terms' FROM part
""")
view("v_term_edge", """
SELECT id AS child, 'B:' || p_brand AS parent FROM v_leaf
UNION ALL SELECT id, 'Y:' || p_type FROM v_leaf
UNION ALL SELECT DISTINCT 'B:' || p_brand, 'T:ROOT' FROM part
UNION ALL SELECT DISTINCT 'Y:' || p_type, 'T:ROOT' FROM part
""")

# --- annotations of entities with terms, some negated ----------------------------------------------------------------
view("v_ann_raw", """
SELECT 'S:' || l_suppkey AS entity, 'L:' || p_brand || '/' || p_type || '/' || p_size AS term,
  CASE WHEN l_returnflag = 'A' THEN 'NOT' ELSE '' END AS qualifier,
  CASE WHEN l_linenumber <= 4 THEN 'PMID:' || l_orderkey ELSE 'OMIM:' || l_orderkey END AS reference,
  CASE WHEN l_linestatus = 'O' THEN 'PCS' WHEN l_returnflag = 'R' THEN 'TAS' ELSE 'IEA' END AS evidence,
  CASE WHEN l_linenumber <= 2 THEN l_linenumber || '/7'
       WHEN l_linenumber <= 4 THEN CAST(round(l_discount * 100) AS INT) || '%'
       WHEN l_linenumber = 5 THEN 'HP:0040282' ELSE '' END AS frequency,
  l_returnflag AS onset,
  'curator[' || substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) || ']' AS biocuration
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
view("v_ph", """
SELECT entity, term, min(reference) AS reference, max(CASE WHEN reference LIKE 'PMID:%' THEN 1 ELSE 0 END) AS has_paper,
  max(CASE evidence WHEN 'PCS' THEN 0.95 WHEN 'TAS' THEN 0.85 ELSE 0.7 END) AS confidence,
  max(substr(biocuration, 9, 10)) AS date
FROM v_ann_raw WHERE qualifier = '' GROUP BY entity, term
""")
view("v_excluded", "SELECT entity, term, min(reference) AS reference FROM v_ann_raw WHERE qualifier = 'NOT' GROUP BY entity, term")

# --- genes (parts), two disagreeing sources, pathways ----------------------------------------------------------------
view("v_gene", "SELECT 'G:' || p_partkey AS id, p_name || ' ' || p_partkey AS label, p_name AS name FROM part")
view("v_gd_raw", """
SELECT 'G:' || l_partkey AS gene, 'S:' || l_suppkey AS entity,
  CASE WHEN l_linestatus = 'O' THEN 'HPO' ELSE 'Orphanet' END AS source,
  CASE WHEN l_linestatus = 'O' THEN
         CASE l_returnflag WHEN 'N' THEN 'MENDELIAN' WHEN 'R' THEN 'POLYGENIC' ELSE 'UNKNOWN' END
       ELSE CASE l_returnflag WHEN 'N' THEN 'Disease-causing germline' WHEN 'R' THEN 'Major susceptibility factor'
            ELSE 'Candidate gene tested' END END AS atype,
  CASE WHEN l_linestatus = 'O' THEN '' WHEN l_linenumber <= 5 THEN 'Assessed' ELSE 'Not yet assessed' END AS status,
  CASE WHEN l_linestatus = 'O' THEN 'OMIM:' || l_orderkey ELSE 'ORPHA:' || l_orderkey END AS xref,
  CASE WHEN l_linestatus = 'O' THEN '' ELSE 'PMID:' || l_orderkey END AS paper
FROM lineitem
""")
view("v_gd", """
SELECT gene, entity,
  CASE WHEN max(CASE WHEN atype LIKE 'Disease-causing%' OR atype LIKE 'Major susceptibility%' OR atype = 'MENDELIAN'
       THEN 1 ELSE 0 END) = 1 THEN 'causes' ELSE 'associated_with' END AS rel,
  CASE WHEN min(source) = max(source) THEN min(source) ELSE 'HPO + Orphanet' END AS source, min(xref) AS source_id,
  least(1.0, max(CASE WHEN source = 'HPO' THEN CASE atype WHEN 'MENDELIAN' THEN 0.9 WHEN 'POLYGENIC' THEN 0.5 ELSE 0.75 END
      ELSE CASE WHEN status = 'Assessed' THEN 0.95 ELSE 0.7 END - CASE WHEN atype = 'Candidate gene tested' THEN 0.25 ELSE 0.0 END
      END) + CASE WHEN min(source) = max(source) THEN 0.0 ELSE 0.05 END) AS confidence,
  max(CASE WHEN paper <> '' THEN 1 ELSE 0 END) AS has_paper
FROM v_gd_raw GROUP BY gene, entity
""")
view("v_pw_raw", """
SELECT 'G:' || p_partkey AS gene, 'P:' || p_size || '/' || p_type AS pathway,
  CASE WHEN p_retailprice > 1000 THEN 'TAS' ELSE 'IEA' END AS evidence FROM part
""")
view("v_pathway", """SELECT pathway AS id, 'Pathway ' || substr(pathway, 3) AS label, count(DISTINCT gene) AS n_genes
FROM v_pw_raw GROUP BY pathway""")

# --- papers (orders), mentions, authors (customers) ------------------------------------------------------------------
view("v_paper", """
SELECT 'PMID:' || o_orderkey AS id, o_orderkey AS num, CAST(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 4) AS INT) AS year,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Gene therapy in a mouse model of segment '
    WHEN '2-HIGH' THEN 'Enzyme replacement therapy without clinical benefit in segment '
    WHEN '3-MEDIUM' THEN 'Natural history of segment ' WHEN '5-LOW' THEN 'Stem cell transplant in segment '
    ELSE 'Case report on segment ' END || c_mktsegment || ' at site ' || c_name AS title,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'The drug did not improve survival of ' || c_name
    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'Dosing was futile' ELSE 'We report on ' || c_name END AS abstract,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Retracted Publication'
    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'Comment' ELSE 'Journal Article' END AS pub_type
FROM orders JOIN customer ON o_custkey = c_custkey
""")
view("v_men_raw", """
SELECT 'PMID:' || l_orderkey AS paper, 'S:' || l_suppkey AS entity,
  CASE WHEN l_linestatus = 'O' THEN 'MeSH' ELSE 'PubTator' END AS system,
  (l_linestatus = 'O' AND l_discount >= 0.05) AS major, CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_linenumber END AS n
FROM lineitem WHERE l_returnflag = 'R'
""")
view("v_men", """
SELECT paper, entity, CASE WHEN min(system) = max(system) THEN min(system) ELSE 'MeSH+PubTator' END AS source,
  max(CASE WHEN major THEN 1 ELSE 0 END) AS major, CAST(sum(n) AS BIGINT) AS n,
  CASE WHEN min(system) <> max(system) THEN CASE WHEN max(CASE WHEN major THEN 1 ELSE 0 END) = 1 THEN 0.95 ELSE 0.9 END
       WHEN min(system) = 'MeSH' THEN CASE WHEN max(CASE WHEN major THEN 1 ELSE 0 END) = 1 THEN 0.9 ELSE 0.8 END
       ELSE least(0.85, 0.5 + 0.1 * CAST(sum(n) AS DOUBLE)) END AS confidence
FROM v_men_raw GROUP BY paper, entity
""")
view("v_gmen_raw", """
SELECT 'PMID:' || l_orderkey AS paper, l_partkey || ';' || l_suppkey AS ids, 'span ' || l_linenumber AS name,
  l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N'
""")
view("v_person", """
SELECT 'A:' || c_custkey AS id, c_name AS label, n_name AS country, c_mktsegment || ' institute of ' || n_name AS affiliation,
  CASE WHEN c_acctbal > 3000 THEN 'orcid-' || c_custkey ELSE '' END AS orcid, c_acctbal < 0 AS homonym_risk
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
view("v_auth", "SELECT 'A:' || o_custkey AS person, 'PMID:' || o_orderkey AS paper FROM orders")
# author rows for identity resolution: family name by nation and segment, forename by price band
view("v_author_row", """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS pmid, 1 AS pos,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Müller' WHEN 'BUILDING' THEN 'Núñez' WHEN 'AUTOMOBILE' THEN 'Smith'
    WHEN 'FURNITURE' THEN 'O''Neil' ELSE 'Kobayashi' END || substr(r_name, 1, 2) AS last,
  CASE WHEN o_orderstatus = 'P' THEN 'T' WHEN o_totalprice > 200000 THEN 'Takashi' ELSE 'Teruyuki K' END AS fore,
  'T' AS initials,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Dept, Univ ' || c_mktsegment || ', ' || n_name || ', ' ||
    CASE WHEN n_regionkey = 0 THEN 'U.S.A.' WHEN n_regionkey = 1 THEN 'España' ELSE 'Japan 123' END END AS affiliation,
  CASE WHEN o_orderpriority = '1-URGENT' AND c_acctbal > 9000 AND n_regionkey <= 1
    THEN 'https://orcid.org/0000-' || n_regionkey ELSE '' END AS orcid,
  CAST(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 4) AS INT) AS year
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
""")

# --- trials (orders with accepted returns), officials, sponsors, organisations ---------------------------------------
view("v_study", """
SELECT DISTINCT 'NCT' || l_orderkey AS trial, 'S:' || l_suppkey AS entity FROM lineitem
WHERE l_returnflag = 'A'
""")
view("v_trial", """
SELECT 'NCT' || o_orderkey AS id, o_orderkey AS num, o_custkey AS cust,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Gene therapy study ' WHEN '2-HIGH' THEN 'Patient registry ' WHEN '3-MEDIUM' THEN 'Natural history study '
    WHEN '4-NOT SPECIFIED' THEN 'Enzyme replacement study ' ELSE 'Bone marrow transplant study ' END || o_orderkey AS title,
  CASE WHEN o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'O') THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
  CASE WHEN o_orderstatus = 'F' THEN 'COHORT' ELSE 'OTHER' END AS model, o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AS registry_flag,
  CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' WHEN 'P' THEN 'TERMINATED' ELSE 'COMPLETED' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'Lack of efficacy at interim analysis'
    WHEN o_orderpriority = '2-HIGH' THEN 'Study completed early' WHEN o_orderpriority = '3-MEDIUM' THEN 'Slow recruitment'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Objectives were met, no safety issue' ELSE '' END AS why_stopped,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'lentiviral vector' WHEN '4-NOT SPECIFIED' THEN 'agalsidase alfa'
    WHEN '5-LOW' THEN 'transplantation regimen' ELSE 'placebo' END AS intervention,
  substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS start, nc.n_conditions
FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_conditions FROM lineitem GROUP BY l_orderkey) nc
  ON o_orderkey = nc.l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
""")
view("v_trial_kind", """
SELECT v_trial.*, CASE WHEN registry_flag OR title LIKE '%registry%' THEN 'registry'
  WHEN lower(title) LIKE '%natural history%' OR (study_type = 'OBSERVATIONAL' AND model = 'COHORT') THEN 'natural_history'
  WHEN study_type = 'OBSERVATIONAL' THEN 'observational' ELSE 'trial' END AS kind FROM v_trial
""")
view("v_cite", "SELECT v_trial.id AS trial, v_paper.id AS paper FROM v_trial JOIN v_paper ON v_trial.num = v_paper.num")
view("v_inv", "SELECT 'A:' || cust AS person, id AS trial FROM v_trial")
view("v_org", """
SELECT 'ORG:' || c_mktsegment || '/' || c_nationkey AS id, c_mktsegment || ' Foundation ' || c_nationkey AS label,
  CASE WHEN c_mktsegment < 'G' THEN 'https://' || lower(c_mktsegment) || '.example.org/' || c_nationkey ELSE '' END AS url,
  c_nationkey AS nk, c_mktsegment AS seg
FROM customer GROUP BY c_mktsegment, c_nationkey
""")
view("v_runs", """SELECT v_org.id AS org, v_trial.id AS trial FROM v_trial JOIN customer ON cust = c_custkey
  JOIN v_org ON nk = c_nationkey AND seg = c_mktsegment""")
view("v_serves", "SELECT id AS org, 'N:' || nk AS entity FROM v_org WHERE url <> ''")

# --- grants: one core project per customer, one row per year ----------------------------------------------------------
view("v_project_raw", """
SELECT 'C' || o_custkey AS core, 'P' || o_custkey || '-' || o_orderkey AS project_num,
  CAST(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 4) AS INT) AS fy, o_totalprice AS amount,
  substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS start_date,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 8) || '28' END AS end_date,
  o_orderstatus = 'O' AS active, o_orderpriority AS priority, o_orderkey AS okey, o_custkey AS ckey FROM orders
""")
view("v_grant", """
SELECT 'GRANT:' || core AS id, 'Project ' || core AS title, min(fy) AS fy_first, max(fy) AS fy_last,
  round(sum(amount), 2) AS amount, max(end_date) >= '2001-01-01' AS active, min(ckey) AS ckey
FROM v_project_raw GROUP BY core
""")
view("v_fund_raw", """
SELECT 'GRANT:C' || o_custkey AS grant_id, 'S:' || l_suppkey AS entity,
  CASE WHEN l_linenumber <= 2 THEN 'title' WHEN l_linenumber <= 4 THEN 'abstract' WHEN l_linenumber <= 6 THEN 'terms' ELSE 'gene symbol' END AS field
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
view("v_fund", """
SELECT grant_id, entity, max(CASE field WHEN 'title' THEN 0.9 WHEN 'abstract' THEN 0.7 ELSE 0.6 END) AS confidence,
  CASE max(CASE field WHEN 'title' THEN 4 WHEN 'abstract' THEN 3 WHEN 'terms' THEN 2 ELSE 1 END)
    WHEN 4 THEN 'title' WHEN 3 THEN 'abstract' WHEN 2 THEN 'terms' ELSE 'gene symbol' END AS field
FROM v_fund_raw GROUP BY grant_id, entity
""")
view("v_lead", """
SELECT 'A:' || ckey AS person, id AS grant_id,
  CASE WHEN c_acctbal > 5000 THEN 'name + affiliation match to existing researcher' ELSE 'PI profile id' END AS identity_match,
  CASE WHEN c_acctbal > 5000 THEN 0.8 ELSE 0.95 END AS confidence FROM v_grant JOIN customer ON ckey = c_custkey
""")

# --- variants ---------------------------------------------------------------------------------------------------------
view("v_variant_raw", """
SELECT 'G:' || l_partkey AS gene, CAST(l_orderkey AS VARCHAR(20)) || '-' || l_linenumber AS variation,
  CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'Pathogenic' ELSE 'Likely pathogenic' END
    WHEN 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'Benign' ELSE 'Conflicting classifications' END
    ELSE CASE WHEN l_linestatus = 'O' THEN 'Uncertain significance' ELSE 'not provided' END END AS significance,
  CASE WHEN l_linenumber = 1 THEN 'practice guideline' WHEN l_linenumber = 2 THEN 'reviewed by expert panel'
    WHEN l_linenumber <= 4 THEN 'criteria provided, multiple submitters, no conflicts'
    WHEN l_linenumber <= 6 THEN 'criteria provided, single submitter' ELSE 'no assertion criteria provided' END AS review,
  CAST(l_quantity AS VARCHAR(10)) AS submitters,
  'MONDO:MONDO:S:' || l_suppkey || '|OMIM:' || l_orderkey || ',Orphanet:' || l_suppkey AS condition_ids
FROM lineitem
""")
view("v_var", """
SELECT gene, variation, 'VAR:' || gene || ':' || variation AS id, entity, stars, nsub FROM (
    SELECT 'G:' || l_partkey AS gene, CAST(l_orderkey AS VARCHAR(20)) || '-' || l_linenumber AS variation, min('S:' || l_suppkey) AS entity,
      max(CASE WHEN l_linenumber = 1 THEN 4 WHEN l_linenumber = 2 THEN 3 WHEN l_linenumber <= 4 THEN 2 ELSE 1 END) AS stars,
      max(l_quantity) AS nsub
    FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 6 GROUP BY 1, 2) r
""")

# --- nodes and edges --------------------------------------------------------------------------------------------------
view("v_node", """
SELECT id, 'Disease' AS type, label, grp FROM v_entity
UNION ALL SELECT id, 'Phenotype', label, '' FROM v_term
UNION ALL SELECT id, 'Gene', label, '' FROM v_gene
UNION ALL SELECT id, 'Pathway', label, '' FROM v_pathway
UNION ALL SELECT id, 'Paper', title, '' FROM v_paper
UNION ALL SELECT id, 'Researcher', label, '' FROM v_person
UNION ALL SELECT id, 'Trial', title, '' FROM v_trial
UNION ALL SELECT id, 'PatientOrg', label, '' FROM v_org
UNION ALL SELECT id, 'Grant', title, '' FROM v_grant
UNION ALL SELECT id, 'Variant', id, '' FROM v_var
""")
view("v_edge_raw", """
SELECT child AS src, parent AS dst, 'subclass_of' AS rel, 'MONDO' AS source, child AS source_id, '2000-01-01' AS date, CAST(1.0 AS DOUBLE) AS confidence, 'curated' AS evidence_type FROM v_hier
UNION ALL SELECT child, parent, 'subclass_of', 'HPO', child, '2000-01-01', CAST(1.0 AS DOUBLE), 'curated' FROM v_term_edge
UNION ALL SELECT gene, entity, rel, source, source_id, '1999-06-01', CAST(confidence AS DOUBLE), 'curated' FROM v_gd
UNION ALL SELECT entity, term, 'has_phenotype', 'HPO annotation', reference, date, CAST(confidence AS DOUBLE), 'curated' FROM v_ph
UNION ALL SELECT gene, pathway, 'in_pathway', 'Reactome', pathway, '2000-01-01', CASE WHEN evidence = 'TAS' THEN 0.9 ELSE 0.7 END, 'curated' FROM v_pw_raw
UNION ALL SELECT m.paper, m.entity, 'mentions', m.source, m.paper, CAST(p.year AS VARCHAR(10)), CAST(m.confidence AS DOUBLE), 'extracted' FROM v_men m JOIN v_paper p ON m.paper = p.id
UNION ALL SELECT a.person, a.paper, 'authored', 'PubMed author list', a.paper, CAST(p.year AS VARCHAR(10)),
  CASE WHEN h.orcid <> '' THEN 0.95 WHEN h.homonym_risk THEN 0.5 ELSE 0.75 END, 'extracted' FROM v_auth a JOIN v_paper p ON a.paper = p.id JOIN v_person h ON a.person = h.id
UNION ALL SELECT s.trial, s.entity, 'studies', 'ClinicalTrials.gov', s.trial, t.start, 0.9, 'curated' FROM v_study s JOIN v_trial t ON s.trial = t.id
UNION ALL SELECT c.trial, c.paper, 'cites', 'ClinicalTrials.gov references', c.trial, t.start, 0.9, 'curated' FROM v_cite c JOIN v_trial t ON c.trial = t.id
UNION ALL SELECT i.person, i.trial, 'investigates', 'ClinicalTrials.gov officials', i.trial, t.start, 0.85, 'curated' FROM v_inv i JOIN v_trial t ON i.trial = t.id
UNION ALL SELECT r.org, r.trial, 'runs', 'ClinicalTrials.gov', r.trial, t.start, 0.9, 'curated' FROM v_runs r JOIN v_trial t ON r.trial = t.id
UNION ALL SELECT org, entity, 'serves', 'Curated patient-organisation seed', org, '2000-01-01', 0.9, 'curated' FROM v_serves
UNION ALL SELECT f.grant_id, f.entity, 'funds', 'NIH RePORTER', f.grant_id, CAST(g.fy_last AS VARCHAR(10)), CAST(f.confidence AS DOUBLE), 'extracted' FROM v_fund f JOIN v_grant g ON f.grant_id = g.id
UNION ALL SELECT l.person, l.grant_id, 'leads', 'NIH RePORTER', l.grant_id, '2000', CAST(l.confidence AS DOUBLE), 'curated' FROM v_lead l
UNION ALL SELECT id, gene, 'variant_of', 'ClinVar', variation, '2000-01-01', CASE stars WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 ELSE 0.95 END, 'curated' FROM v_var
UNION ALL SELECT id, entity, 'pathogenic_for', 'ClinVar', variation, '2000-01-01', CASE stars WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 ELSE 0.95 END, 'curated' FROM v_var
""")
view("v_edge", "SELECT HASH256(rel || '|' || src || '|' || dst || '|' || source_id) AS edge_id, src, dst, rel, source, source_id, date, CAST(confidence AS DOUBLE) AS confidence, evidence_type FROM v_edge_raw")
