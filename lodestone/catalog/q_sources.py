"""Readers over files that Spark writes from the given tables, landing, and tables at rest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog.registry import query, view
from lodestone.common import shared_dir
from lodestone.operators import similarity as M
from lodestone.sources import files as S
from lodestone.streaming import landing as L


#: Records of one XML file; a file is read by one task as a whole.
XML_RECORDS = 100_000


def folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


view("v_slice", "SELECT CAST(num AS VARCHAR(20)) AS pmid, CASE WHEN year = 1999 THEN '' ELSE title || '.' END AS title, CASE WHEN year >= 1999 AND pub_type = 'Comment' THEN '' ELSE abstract END AS abstract, year, id FROM v_paper")


@query("load_abstracts", """WITH s AS (SELECT pmid, 'north' AS sl, 0 AS o, title, abstract, year FROM v_slice WHERE year <= 1999 UNION ALL SELECT pmid, 'south', 1, title, abstract || ' again', year FROM v_slice WHERE year >= 1998),
k AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY o, title, abstract, year) AS rn FROM s WHERE trim(title) <> '' OR trim(abstract) <> '')
SELECT k.pmid, trim(title) AS title, CASE WHEN trim(abstract) = '' THEN trim(title) WHEN trim(title) = '' THEN trim(abstract) ELSE regexp_replace(trim(title), '\\.+$', '') || '. ' || trim(abstract) END AS text, year, g.groups, trim(abstract) <> '' AS has_abstract
FROM k JOIN (SELECT pmid, string_agg(sl, '|' ORDER BY sl) AS groups FROM k GROUP BY pmid) g ON g.pmid = k.pmid WHERE rn = 1""")
def _(t):
    root = folder(t, "abstracts")
    rows = t("v_slice").select("pmid", "title", "abstract", "year")
    rows.where("year <= 1999").write.json(f"{root}/north")
    rows.where("year >= 1998").withColumn("abstract", F.concat("abstract", F.lit(" again"))).write.json(f"{root}/south")
    return S.load_abstracts(t.spark, root, ["north", "south"]).withColumn("groups", F.array_join("groups", "|"))


@query("load_entity_annotations", """WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE WHEN l_returnflag = 'R' THEN 'Gene' ELSE 'Disease' END AS type, CAST(l_suppkey AS VARCHAR) AS id, p_name AS txt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'),
x AS (SELECT pmid, type, id, string_agg(txt, '|' ORDER BY txt) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY pmid, type, id ORDER BY txt) AS rn FROM (SELECT DISTINCT * FROM r) u) v WHERE rn <= 5 GROUP BY pmid, type, id)
SELECT r.pmid, r.type, r.id, count(*) AS n, max(txt) AS name, min(texts) AS texts FROM r JOIN x ON x.pmid = r.pmid AND x.type = r.type AND x.id = r.id GROUP BY r.pmid, r.type, r.id""")
def _(t):
    path = folder(t, "annotations")
    kind = F.when(F.col("l_returnflag") == "R", "Gene").when(F.col("l_returnflag") == "A", "Disease").otherwise("Species")
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    infons = F.struct(kind.alias("type"), F.col("l_suppkey").cast("string").alias("identifier"), F.lit(None).cast("string").alias("name"))
    docs = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("p_name").alias("text"), infons.alias("infons"))).alias("annotations"))
    lines = docs.select(F.to_json(F.struct(F.concat_ws("|", "l_orderkey", F.lit("x")).alias("id"), F.array(F.struct("annotations")).alias("passages"))).alias("value"))
    lines.union(t("region").select(F.concat(F.lit("{broken "), "r_name"))).write.text(path)
    return S.load_entity_annotations(t.spark, path, ["Gene", "Disease"]).withColumn("texts", F.array_join("texts", "|"))


@query("flatten_trials", """SELECT id AS nct, title, status, start, why_stopped, study_type, registry_flag AS patient_registry, model AS observational_model, intervention, n_conditions AS enrollment,
  'T-' || num AS acronym, 'Eligible for ' || title AS eligibility, '18 Years' AS min_age, CASE WHEN status = 'RECRUITING' THEN '65 Years' END AS max_age, CASE WHEN status = 'RECRUITING' THEN 'a|b' ELSE 'a' END AS groups, CASE WHEN status = 'RECRUITING' THEN 'q1|q2' ELSE 'q1' END AS queries FROM v_trial""")
def _(t):
    path = folder(t, "studies")
    w = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    c = F.col
    sect = w(identificationModule=w(nctId=c("id"), briefTitle=c("title"), acronym=F.concat(F.lit("T-"), "num")),
             eligibilityModule=w(eligibilityCriteria=F.concat(F.lit("Eligible for "), "title"), minimumAge=F.lit("18 Years"), maximumAge=F.when(c("status") == "RECRUITING", "65 Years")),
             statusModule=w(overallStatus=c("status"), whyStopped=c("why_stopped"), startDateStruct=w(date=c("start"))),
             designModule=w(studyType=c("study_type"), patientRegistry=c("registry_flag"), designInfo=w(observationalModel=c("model")), enrollmentInfo=w(count=c("n_conditions"))),
             armsInterventionsModule=w(interventions=F.array(w(type=F.lit("DRUG"), name=c("intervention")))))
    seen = lambda group, query: w(group=F.lit(group), query=F.lit(query))
    found = F.explode(F.when(c("status") == "RECRUITING", F.array(seen("a", "q1"), seen("b", "q2"))).otherwise(F.array(seen("a", "q1"))))
    t("v_trial").select(sect.alias("protocolSection"), "status").select("protocolSection", found.alias("by")).select("protocolSection", "by.*").write.json(path)
    out = S.flatten_trials(t.spark.read.schema(S.STUDY).json(path))
    return out.select("nct", "title", "status", "start", "why_stopped", "study_type", "patient_registry", "observational_model", c("interventions")[0]["name"].alias("intervention"),
                      "enrollment", "acronym", "eligibility", "min_age", "max_age", F.array_join("groups", "|").alias("groups"), F.array_join("queries", "|").alias("queries"))


LONG = "' and its consequences' || repeat(' in detail', 100)"


@query("flatten_grants", f"""SELECT project_num, fy, core, title, abstract, round(amount, 2) AS amount, terms, start, active, queries, pis, org, city, state, country, ic, url, appl_id FROM (
  SELECT project_num, fy, core, 'Order ' || priority AS title, 'An abstract of ' || core || {LONG} AS abstract, amount, 'alpha|' || priority AS terms, start_date AS start, active,
    CASE WHEN priority = '1-URGENT' THEN 'p1|p2' ELSE 'p1' END AS queries, ckey || ':PI ' || ckey || ':true|' || (1000000000 + okey) || ':Second ' || okey || ':false' AS pis, 'Institute ' || ckey AS org, 'Town' AS city, 'MD' AS state, 'USA' AS country,
    'NX' AS ic, 'https://example.org/' || project_num AS url, okey AS appl_id FROM v_project_raw) u""")
def _(t):
    people = F.transform("pis", lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"], x["contact"].cast("string")))
    return projects(t).select(
        "project_num", "fy", "core", "title", "abstract", F.round("amount", 2).alias("amount"), F.array_join("terms", "|").alias("terms"), "start", "active", F.array_join("queries", "|").alias("queries"),
        F.array_join(people, "|").alias("pis"), "org", "city", "state", "country", "ic", "url", "appl_id")


def projects(t):
    path = folder(t, "projects")
    w = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    lead = w(profile_id=F.col("ckey"), full_name=F.concat(F.lit("PI "), "ckey"), is_contact_pi=F.lit(True))
    other = w(profile_id=F.lit(1000000000) + F.col("okey"), full_name=F.concat(F.lit("Second "), "okey"), is_contact_pi=F.lit(None).cast("boolean"))
    rows = t("v_project_raw").select(
        "project_num", F.col("core").alias("core_project_num"), F.col("fy").alias("fiscal_year"), F.concat(F.lit("Order "), "priority").alias("project_title"),
        F.concat(F.lit(" An abstract \n of  "), "core", F.expr(LONG)).alias("abstract_text"), F.col("amount").alias("award_amount"), F.concat(F.lit("<alpha><"), "priority", F.lit(">")).alias("terms"),
        F.concat("start_date", F.lit("T00:00:00")).alias("project_start_date"), F.col("active").alias("is_active"), F.array(lead, other).alias("principal_investigators"),
        w(org_name=F.concat(F.lit("Institute "), "ckey"), org_city=F.lit("Town"), org_state=F.lit("MD"), org_country=F.lit("USA")).alias("organization"),
        w(abbreviation=F.lit("NX"), name=F.lit("Institute X")).alias("agency_ic_admin"), F.concat(F.lit("https://example.org/"), "project_num").alias("project_detail_url"), F.col("okey").alias("appl_id"), F.lit("p1").alias("query"))
    again = rows.where(F.col("project_title").endswith("1-URGENT")).withColumn("query", F.lit("p2"))
    rows.unionByName(again).write.json(path)
    return S.flatten_grants(t.spark.read.schema(S.PROJECT).json(path))


@query("grant_leads", """SELECT DISTINCT 'GRANT:' || core AS grant_id, CAST(ckey AS VARCHAR) AS profile, 'PI ' || ckey AS name, 'Institute ' || ckey AS affiliation FROM v_project_raw
UNION SELECT DISTINCT 'GRANT:' || core, CAST(1000000000 + okey AS VARCHAR), 'Second ' || okey, 'Institute ' || ckey FROM v_project_raw""")
def _(t):
    return S.grant_leads(projects(t))


@query("scan_variants", """SELECT substr(gene, 3) AS "GeneID", variation AS "VariationID", significance AS "ClinicalSignificance", count(*) AS n FROM v_variant_raw
WHERE gene IN (SELECT gene FROM v_gd WHERE rel = 'causes') AND review <> 'practice guideline' GROUP BY ALL""")
def _(t):
    path = folder(t, "variants")
    rows = t("v_variant_raw").select(F.expr("substr(gene, 3)").alias("GeneID"), F.col("variation").alias("VariationID"), F.col("significance").alias("ClinicalSignificance"),
                                     F.when(F.col("review") == "practice guideline", "GRCh37").otherwise("GRCh38").alias("Assembly"))
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    genes = t("v_gd").where("rel = 'causes'").select(F.expr("substr(gene, 3)").alias("gene"))
    return S.scan_variants(t.spark, path, rows.columns, genes).groupBy("GeneID", "VariationID", "ClinicalSignificance").agg(F.count("*").alias("n"))


@query("read_annotation_tsv", "SELECT entity, term, qualifier, frequency, count(*) AS n FROM v_ann_raw GROUP BY entity, term, qualifier, frequency")
def _(t):
    path = folder(t, "annotation")
    rows = t("v_ann_raw").select("entity", "term", "qualifier", "frequency")
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return S.read_annotation_tsv(t.spark, path, rows.columns).groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("load_verified_seed", """SELECT id AS org, 'N:' || nk AS entity, url, '2001-02-03' AS date FROM v_org WHERE url <> '' AND nk < 20""")
def _(t):
    path = folder(t, "seed")
    t("v_org").select("id", F.concat("label", F.lit(" (group)")).alias("name"), "url", F.concat(F.lit("N:"), "nk", F.lit("; X:1")).alias("disease_ids"),
                      F.lit("site, checked 2001-02-03").alias("source"), F.when(F.col("url") != "", "True").otherwise("false").alias("verified")).write.option("header", True).csv(path)
    members = t("nation").where("n_nationkey < 20").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"))
    return S.load_verified_seed(t.spark, path, members)[0].drop("note")


@query("read_article_xml", """SELECT CAST(num AS VARCHAR) AS pmid, title, 'AIM: ' || abstract || chr(10) || 'END: done' AS abstract, year, pub_type, 'A' || year AS author, year >= 1998 AS major FROM v_paper""")
def _(t):
    path = folder(t, "articles")
    w = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    c = F.col
    art = w(Journal=w(JournalIssue=w(PubDate=w(MedlineDate=F.concat(c("year").cast("string"), F.lit(" Jan-Feb"))))), ArticleTitle=c("title"),
            Abstract=w(AbstractText=F.array(w(_VALUE=c("abstract"), _Label=F.lit("AIM")), w(_VALUE=F.lit("done"), _Label=F.lit("END")))),
            AuthorList=w(Author=F.array(w(LastName=F.concat(F.lit("A"), c("year").cast("string")), ForeName=F.lit("F")))), PublicationTypeList=w(PublicationType=F.array(c("pub_type"))))
    mesh = w(MeshHeading=F.array(w(DescriptorName=w(_VALUE=F.lit("term"), _UI=F.lit("D1"), _MajorTopicYN=F.when(c("year") >= 1998, "Y").otherwise("N")))))
    t("v_paper").select(w(PMID=c("num").cast("string"), Article=art, MeshHeadingList=mesh).alias("MedlineCitation")).write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").option("maxRecordsPerFile", XML_RECORDS).save(path)
    out = S.read_article_xml(t.spark, path)
    return out.select("pmid", "title", "abstract", "year", c("pub_types")[0].alias("pub_type"), c("authors")[0]["last"].alias("author"), c("mesh")[0]["major"].alias("major"))


@query("read_disorder_xml", """SELECT 'ORPHA:' || substr(entity, 3) AS code, gene AS symbol, atype, status, CASE WHEN paper <> '' THEN substr(paper, 6) ELSE '' END AS pmids, count(*) AS n FROM v_gd_raw GROUP BY ALL""")
def _(t):
    path = folder(t, "disorders")
    w = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    c = F.col
    source = F.when(c("paper") != "", F.concat(F.expr("substr(paper, 6)"), F.lit("[PMID]_note"))).otherwise("")
    one = w(SourceOfValidation=source, Gene=w(Symbol=c("gene")), DisorderGeneAssociationType=w(Name=c("atype")), DisorderGeneAssociationStatus=w(Name=c("status")))
    t("v_gd_raw").select(F.expr("substr(entity, 3)").alias("OrphaCode"), w(DisorderGeneAssociation=F.array(one)).alias("DisorderGeneAssociationList")).write.format("xml").option(
        "rowTag", "Disorder").option("rootTag", "DisorderList").option("maxRecordsPerFile", XML_RECORDS).save(path)
    return S.read_disorder_xml(t.spark, path)[0].withColumn("pmids", F.array_join("pmids", "|")).groupBy("code", "symbol", "atype", "status", "pmids").agg(F.count("*").alias("n"))


@query("write_graph_tables", "SELECT rel, count(*) AS n, count(DISTINCT src) AS n_src FROM v_edge_raw GROUP BY rel")
def _(t):
    path = folder(t, "graph")
    S.write_graph_tables(t("v_edge_raw").where("rel = 'serves'"), path)
    S.write_graph_tables(t("v_edge_raw"), path)
    return S.read_graph_tables(t.spark, path).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))


@query("replace_relation", """SELECT rel, count(*) AS n, round(sum(confidence), 3) AS total FROM (SELECT rel, confidence FROM v_edge_raw UNION ALL SELECT 'similar_to', score FROM x_top) e GROUP BY rel""")
def _(t):
    """A former generation of similar pairs gives way to the present one, the other relations stay as they are."""
    path = folder(t, "graph")
    columns = ["src", "dst", "rel", "source", "source_id", "date", "confidence", "evidence_type"]
    similar = M.similarity_edges(B.top(t), "2001-01-01").select(*columns)
    S.write_graph_tables(t("v_edge_raw").select(*columns).unionByName(similar.where("confidence > 0.3")), path)
    S.write_graph_tables(similar, path, replace=True)
    S.remove_old_generations(t.spark, path, keep=1)
    return S.read_graph_tables(t.spark, path).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("total"))


@query("source_manifest", """SELECT 'orders' AS source, count(*) AS records, substr(CAST(max(o_orderdate) AS VARCHAR), 1, 10) AS latest FROM orders UNION ALL SELECT 'lineitem', count(*), substr(CAST(max(l_shipdate) AS VARCHAR), 1, 10) FROM lineitem
UNION ALL SELECT 'part', count(*), '2001-01-01' FROM part UNION ALL SELECT 'documents', count(*), '2001-01-01' FROM documents""")
def _(t):
    out = S.source_manifest({"orders": (t("orders"), "o_orderdate"), "lineitem": (t("lineitem"), "l_shipdate"), "part": (t("part"), None), "documents": (t("documents"), None)}, "2001-01-01")
    return out.withColumn("latest", F.substring("latest", 1, 10))


@query("corpus_fingerprint")
def _(t):
    return S.corpus_fingerprint(t("documents"))


EVENT = "user_id long, event_type string, batch int, event_id long, value double"


@query("ingest_batches", """SELECT user_id, event_type, batch, event_id, value FROM (SELECT user_id, event_type, day(ts) AS batch, event_id, value,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY day(ts), event_id) AS rn FROM events) u WHERE rn = 1""")
def _(t):
    root = folder(t, "landing")
    rows = t("events").select("user_id", "event_type", F.dayofmonth("ts").alias("batch"), "event_id", "value")
    rows.where("batch >= 10").write.json(f"{root}/in/first")
    args = (f"{root}/in/*", f"{root}/out", f"{root}/seen", EVENT, ["user_id", "event_type"], "batch", "event_id")
    L.ingest_batches(t.spark, *args)
    rows.where("batch < 10").write.json(f"{root}/in/second")
    L.ingest_batches(t.spark, *args)
    return L.read_landed(t.spark, f"{root}/out", EVENT, ["user_id", "event_type"], "batch", "event_id")
