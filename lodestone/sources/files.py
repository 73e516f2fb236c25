"""Readers of the landed source files, and the writer of the graph tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.common import top_n, union_all
from lodestone.functions import text as X

# --- ontologies ---------------------------------------------------------------------------------------------------------------
OBOGRAPH = (
    "graphs array<struct<nodes:array<struct<id:string,lbl:string,type:string,meta:struct<deprecated:boolean,definition:struct<val:string>,"
    "synonyms:array<struct<pred:string,val:string>>,xrefs:array<struct<val:string>>,basicPropertyValues:array<struct<pred:string,val:string>>>>>,"
    "edges:array<struct<sub:string,pred:string,obj:string>>>>")


def read_obograph(spark: SparkSession, path: str, prefix: str, classes_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Terms and `is_a` edges of a graph document, of one id prefix, without deprecated terms.

    `(id, label, definition, synonyms, exact_synonyms, xrefs, alt_ids)` and `(child, parent)`. The document is one JSON value, so
    one task parses it; the rows are spread over the cluster right after.
    """
    graph = spark.read.schema(OBOGRAPH).json(path, multiLine=True).select(F.col("graphs")[0].alias("g"))
    nodes = graph.select(F.explode("g.nodes").alias("n")).select("n.*").where(F.col("id").startswith(prefix))
    nodes = nodes.where(~F.coalesce("meta.deprecated", F.lit(False)))
    if classes_only:
        nodes = nodes.where("type = 'CLASS'")
    empty = F.array().cast("array<string>")
    syn = F.coalesce("meta.synonyms", F.array().cast("array<struct<pred:string,val:string>>"))
    values = lambda arr: F.array_sort(F.array_distinct(F.transform(arr, lambda s: s["val"])))
    alt = F.filter(F.coalesce("meta.basicPropertyValues", F.array().cast("array<struct<pred:string,val:string>>")), lambda b: b["pred"].endswith("hasAlternativeId"))
    terms = nodes.select(
        X.curie("id").alias("id"), F.coalesce("lbl", X.curie("id")).alias("label"), F.coalesce("meta.definition.val", F.lit("")).alias("definition"),
        values(syn).alias("synonyms"), values(F.filter(syn, lambda s: s["pred"] == "hasExactSynonym")).alias("exact_synonyms"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("meta.xrefs", lambda x: X.xref_norm(x["val"])))), empty).alias("xrefs"),
        F.transform(alt, lambda b: b["val"]).alias("alt_ids"))
    edges = graph.select(F.explode("g.edges").alias("e")).select("e.*").where(
        (F.col("pred") == "is_a") & F.col("sub").startswith(prefix) & F.col("obj").startswith(prefix))
    return terms, edges.select(X.curie("sub").alias("child"), X.curie("obj").alias("parent")).distinct()


# --- tables -------------------------------------------------------------------------------------------------------------------
def read_annotation_tsv(spark: SparkSession, path: str, columns: list[str], header: bool = True, comment: str | None = "#") -> DataFrame:
    """Tab-separated rows, every column text, an empty field an empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("enforceSchema", True).option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path).na.fill("")


def scan_variants(spark: SparkSession, path: str, columns: list[str], genes: DataFrame, assembly: str = "GRCh38", partitions: int | None = None) -> DataFrame:
    """Rows of wanted genes and one assembly. A gzip file is read by one task, so rows are spread out before further work;
    the assembly is tested while reading."""
    rows = read_annotation_tsv(spark, path, columns, comment=None).where(F.col("Assembly") == assembly)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.join(genes.select(F.col("gene").alias("GeneID")).distinct(), "GeneID", "left_semi")


def load_verified_seed(spark: SparkSession, path: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified organisations: `(org, entity, url, note, date)` for ids of the set, and lookup keys `(norm, org)` by their name with
    and without the part in brackets."""
    rows = spark.read.csv(path, header=True, schema="id string, name string, url string, disease_ids string, source string, verified string").where(F.lower("verified") == "true")
    date = F.regexp_extract("source", r"\d{4}-\d{2}-\d{2}", 0)
    served = rows.select(F.col("id").alias("org"), F.explode(F.split("disease_ids", ";")).alias("e"), "url", F.col("source").alias("note"), date.alias("date")).select(
        "org", F.trim("e").alias("entity"), "url", "note", "date").join(members.select(F.col("id").alias("entity")), "entity", "left_semi")
    names = rows.select(F.explode(F.array("name", F.regexp_replace("name", r"\(.*?\)", ""))).alias("n"), F.col("id").alias("org"))
    return served, names.groupBy(X.norm_text("n").alias("norm")).agg(F.max("org").alias("org"))


# --- XML ----------------------------------------------------------------------------------------------------------------------
NAMED = "struct<Name:string>"
DISORDER = (
    f"OrphaCode string, Name string, DisorderGeneAssociationList struct<DisorderGeneAssociation:array<struct<SourceOfValidation:string,Gene:struct<Symbol:string,Name:string>,"
    f"DisorderGeneAssociationType:{NAMED},DisorderGeneAssociationStatus:{NAMED}>>>, PrevalenceList struct<Prevalence:array<struct<PrevalenceType:{NAMED},PrevalenceQualification:{NAMED},"
    f"PrevalenceClass:{NAMED},PrevalenceGeographic:{NAMED},PrevalenceValidationStatus:{NAMED},ValMoy:string,Source:string>>>, AverageAgeOfOnsetList struct<AverageAgeOfOnset:array<{NAMED}>>,"
    f"TypeOfInheritanceList struct<TypeOfInheritance:array<{NAMED}>>")


def read_disorder_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gene associations, prevalence records, and onset and inheritance lists of disorder records."""
    rows = spark.read.format("xml").option("rowTag", "Disorder").schema(DISORDER).load(path).withColumn("code", F.concat(F.lit("ORPHA:"), "OrphaCode"))
    assoc = rows.select("code", F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a")).select(
        "code", F.col("a.Gene.Symbol").alias("symbol"), F.coalesce("a.DisorderGeneAssociationType.Name", F.lit("")).alias("atype"),
        F.coalesce("a.DisorderGeneAssociationStatus.Name", F.lit("")).alias("status"),
        F.regexp_extract_all(F.coalesce("a.SourceOfValidation", F.lit("")), F.lit(r"(\d+)\[PMID\]"), 1).alias("pmids"))
    prev = rows.select("code", F.posexplode("PrevalenceList.Prevalence").alias("pos", "p")).select(
        "code", "pos", F.col("p.PrevalenceType.Name").alias("type"), F.col("p.PrevalenceQualification.Name").alias("qualification"), F.col("p.PrevalenceClass.Name").alias("class"),
        F.col("p.PrevalenceGeographic.Name").alias("geographic"), F.col("p.PrevalenceValidationStatus.Name").alias("validation"), F.col("p.ValMoy").alias("val_moy"))
    empty = F.array().cast("array<string>")
    lists = rows.select("code", F.coalesce(F.col("AverageAgeOfOnsetList.AverageAgeOfOnset.Name"), empty).alias("onset"),
                        F.coalesce(F.col("TypeOfInheritanceList.TypeOfInheritance.Name"), empty).alias("inheritance"))
    return assoc, prev, lists.where((F.size("onset") > 0) | (F.size("inheritance") > 0))


TEXTED = "struct<_VALUE:string,_Label:string,_NlmCategory:string>"
ARTICLE = (
    f"MedlineCitation struct<PMID:string,Article:struct<Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ArticleTitle:string,"
    f"Abstract:struct<AbstractText:array<{TEXTED}>>,AuthorList:struct<Author:array<struct<LastName:string,CollectiveName:string,ForeName:string,Initials:string,"
    f"AffiliationInfo:array<struct<Affiliation:string>>,Identifier:array<struct<_VALUE:string,_Source:string>>>>>,PublicationTypeList:struct<PublicationType:array<string>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string,_MajorTopicYN:string>>>>,KeywordList:struct<Keyword:array<string>>,"
    f"ChemicalList:struct<Chemical:array<struct<NameOfSubstance:string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>")


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles: id, title, abstract joined from its sections, journal, year, authors, terms, keywords, types, substances."""
    a = "MedlineCitation.Article"
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path)
    empty = F.array().cast("array<string>")
    label = lambda s: F.when(F.coalesce(s["_Label"], F.lit("")) != "", s["_Label"]).otherwise(F.coalesce(s["_NlmCategory"], F.lit("")))
    section = lambda s: F.concat(F.when(label(s) != "", F.concat(label(s), F.lit(": "))).otherwise(""), F.coalesce(s["_VALUE"], F.lit("")))
    year = F.coalesce(f"{a}.Journal.JournalIssue.PubDate.Year", F.substring(F.col(f"{a}.Journal.JournalIssue.PubDate.MedlineDate"), 1, 4))
    orcid = lambda p: F.coalesce(F.get(F.transform(F.filter(p["Identifier"], lambda i: i["_Source"] == "ORCID"), lambda i: i["_VALUE"]), F.lit(0)), F.lit(""))
    author = lambda p: F.struct(
        F.coalesce(p["LastName"], p["CollectiveName"], F.lit("")).alias("last"), F.coalesce(p["ForeName"], F.lit("")).alias("fore"),
        F.coalesce(p["Initials"], F.lit("")).alias("initials"), F.coalesce(p["AffiliationInfo"]["Affiliation"], empty).alias("affiliations"), orcid(p).alias("orcid"))
    mesh = lambda m: F.struct(m["DescriptorName"]["_VALUE"].alias("term"), m["DescriptorName"]["_UI"].alias("ui"), (m["DescriptorName"]["_MajorTopicYN"] == "Y").alias("major"))
    doi = F.get(F.transform(F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi"), lambda i: i["_VALUE"]), F.lit(0))
    return rows.select(
        F.trim("MedlineCitation.PMID").alias("pmid"), F.coalesce(f"{a}.ArticleTitle", F.lit("")).alias("title"),
        F.coalesce(F.array_join(F.transform(f"{a}.Abstract.AbstractText", section), "\n"), F.lit("")).alias("abstract"),
        F.col(f"{a}.Journal.Title").alias("journal"), year.try_cast("int").alias("year"), F.coalesce(doi, F.lit("")).alias("doi"),
        F.transform(f"{a}.AuthorList.Author", author).alias("authors"), F.transform("MedlineCitation.MeshHeadingList.MeshHeading", mesh).alias("mesh"),
        F.coalesce(F.col("MedlineCitation.KeywordList.Keyword"), empty).alias("keywords"), F.coalesce(F.col(f"{a}.PublicationTypeList.PublicationType"), empty).alias("pub_types"),
        F.coalesce(F.col("MedlineCitation.ChemicalList.Chemical.NameOfSubstance"), empty).alias("chemicals"))


# --- JSON lines ---------------------------------------------------------------------------------------------------------------
ABSTRACT = ("pmid string, title string, abstract string, year int, journal string, doi string")


def load_abstracts(spark: SparkSession, root: str, slices: list[str]) -> DataFrame:
    """`(pmid, title, text, year, groups, has_abstract)`: one row per paper of the slices, read from `root/slice/`.

    A paper of several slices keeps the record of the first and lists all; one with neither title nor abstract is dropped. The
    slice comes from the folder the record lies in.
    """
    rows = spark.read.schema(ABSTRACT).json([f"{root}/{s}" for s in slices])
    order = F.create_map(*[F.lit(x) for i, s in enumerate(slices) for x in (s, i)])
    rows = rows.withColumn("slice", F.element_at(F.split(F.input_file_name(), "/"), -2)).withColumn("pmid", F.trim("pmid")).where("pmid <> ''")
    rows = rows.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).withColumn("abstract", F.trim(F.coalesce("abstract", F.lit(""))))
    rows = rows.where("title <> '' or abstract <> ''").withColumn("o", order[F.col("slice")])
    one = rows.groupBy("pmid").agg(F.min(F.struct("o", "title", "abstract", "year")).alias("r"), F.array_sort(F.collect_set("slice")).alias("groups"))
    text = F.when(F.col("r.abstract") == "", F.col("r.title")).when(F.col("r.title") == "", F.col("r.abstract")).otherwise(
        F.concat(F.rtrim(F.regexp_replace("r.title", r"\.+$", "")), F.lit(". "), "r.abstract"))
    return one.select("pmid", F.col("r.title").alias("title"), text.alias("text"), F.col("r.year").alias("year"), "groups", (F.col("r.abstract") != "").alias("has_abstract"))


ANNOTATED = ("id string, passages array<struct<annotations:array<struct<text:string,infons:struct<type:string,identifier:string,name:string>>>>>")


def load_entity_annotations(spark: SparkSession, path: str, kinds: list[str], max_texts: int = 5) -> DataFrame:
    """`(pmid, type, id, name, n, texts)`: mentions per paper and entity with up to `max_texts` wordings in order. Malformed lines
    are skipped, as are other kinds and mentions without an id."""
    docs = spark.read.schema(ANNOTATED).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    rows = docs.select(F.substring_index("id", "|", 1).alias("pmid"), F.explode("passages").alias("p")).select("pmid", F.explode("p.annotations").alias("a"))
    rows = rows.select("pmid", F.col("a.infons.type").alias("type"), F.col("a.infons.identifier").alias("id"), F.col("a.text").alias("text"),
                       F.coalesce("a.infons.name", "a.text").alias("name"))
    rows = rows.where(F.col("type").isin(kinds)).where("id is not null and id <> '' and id <> '-'")
    count = rows.groupBy("pmid", "type", "id").agg(F.count("*").alias("n"), F.max("name").alias("name"))
    texts = top_n(rows.select("pmid", "type", "id", "text").distinct(), ["pmid", "type", "id"], ["text"], max_texts)
    texts = texts.groupBy("pmid", "type", "id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return count.join(texts, ["pmid", "type", "id"])


STUDY = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string,acronym:string>,eligibilityModule:struct<eligibilityCriteria:string,minimumAge:string,maximumAge:string>,statusModule:struct<overallStatus:string,whyStopped:string,"
    "startDateStruct:struct<date:string>,completionDateStruct:struct<date:string>,lastUpdatePostDateStruct:struct<date:string>>,designModule:struct<studyType:string,phases:array<string>,"
    "patientRegistry:boolean,designInfo:struct<observationalModel:string>,enrollmentInfo:struct<count:int>>,conditionsModule:struct<conditions:array<string>,keywords:array<string>>,"
    "armsInterventionsModule:struct<interventions:array<struct<type:string,name:string>>>,descriptionModule:struct<briefSummary:string>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string,class:string>,"
    "collaborators:array<struct<name:string,class:string>>>,contactsLocationsModule:struct<overallOfficials:array<struct<name:string,affiliation:string,role:string>>,locations:array<struct<country:string>>>,"
    "referencesModule:struct<references:array<struct<pmid:string>>>>, derivedSection struct<conditionBrowseModule:struct<meshes:array<struct<term:string>>>>, hasResults boolean, `group` string, query string")


def flatten_trials(raw: DataFrame) -> DataFrame:
    """Nested study records to one flat row per study; the groups and queries that found it are united."""
    p = "protocolSection"
    empty = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), empty)
    flat = raw.select(
        F.col(f"{p}.identificationModule.nctId").alias("nct"), F.col(f"{p}.identificationModule.briefTitle").alias("title"), F.col(f"{p}.identificationModule.officialTitle").alias("official_title"),
        F.col(f"{p}.identificationModule.acronym").alias("acronym"), F.coalesce(f"{p}.eligibilityModule.eligibilityCriteria", F.lit("")).alias("eligibility"),
        F.col(f"{p}.eligibilityModule.minimumAge").alias("min_age"), F.col(f"{p}.eligibilityModule.maximumAge").alias("max_age"),
        F.col(f"{p}.statusModule.overallStatus").alias("status"), F.col(f"{p}.statusModule.startDateStruct.date").alias("start"), F.col(f"{p}.statusModule.completionDateStruct.date").alias("completion"),
        F.col(f"{p}.statusModule.lastUpdatePostDateStruct.date").alias("last_update"), F.col(f"{p}.statusModule.whyStopped").alias("why_stopped"), F.coalesce("hasResults", F.lit(False)).alias("has_results"),
        F.col(f"{p}.designModule.studyType").alias("study_type"), arr(f"{p}.designModule.phases").alias("phases"), F.coalesce(f"{p}.designModule.patientRegistry", F.lit(False)).alias("patient_registry"),
        F.col(f"{p}.designModule.designInfo.observationalModel").alias("observational_model"), F.col(f"{p}.designModule.enrollmentInfo.count").alias("enrollment"),
        arr(f"{p}.conditionsModule.conditions").alias("conditions"), arr(f"{p}.conditionsModule.keywords").alias("keywords"),
        F.col(f"{p}.armsInterventionsModule.interventions").alias("interventions"), F.coalesce(f"{p}.descriptionModule.briefSummary", F.lit("")).alias("summary"),
        F.col(f"{p}.sponsorCollaboratorsModule.leadSponsor").alias("lead_sponsor"), F.col(f"{p}.sponsorCollaboratorsModule.collaborators").alias("collaborators"),
        F.col(f"{p}.contactsLocationsModule.overallOfficials").alias("officials"),
        F.coalesce(F.array_sort(F.array_distinct(F.filter(F.col(f"{p}.contactsLocationsModule.locations.country"), lambda x: x.isNotNull()))), empty).alias("countries"),
        arr("derivedSection.conditionBrowseModule.meshes.term").alias("mesh_conditions"),
        F.coalesce(F.filter(F.col(f"{p}.referencesModule.references.pmid"), lambda x: x.isNotNull()), empty).alias("references"), "group", "query")
    facts = [c for c in flat.columns if c not in ("nct", "group", "query")]
    return flat.groupBy("nct").agg(F.min_by(F.struct(*facts), F.struct("group", "query")).alias("f"), F.array_sort(F.collect_set("group")).alias("groups"),
                                   F.array_sort(F.collect_set("query")).alias("queries")).select("nct", "f.*", "groups", "queries")


PROJECT = ("project_num string, core_project_num string, fiscal_year int, project_title string, abstract_text string, award_amount double, terms string, project_start_date string,"
           "project_end_date string, is_active boolean, project_detail_url string, activity_code string, appl_id long, organization struct<org_name:string,org_city:string,org_state:string,org_country:string>,"
           "agency_ic_admin struct<abbreviation:string,name:string>, principal_investigators array<struct<profile_id:long,full_name:string,is_contact_pi:boolean>>, query string")


def flatten_grants(raw: DataFrame, max_chars: int | None = None, max_terms: int | None = None) -> DataFrame:
    """One row per project and year: abstract with single blanks, concept terms, investigators `pis(id, name, contact)`, place, institute,
    all queries listed. Abstract and terms are whole unless limits are given."""
    terms = F.filter(F.split(F.regexp_replace(F.coalesce("terms", F.lit("")), "^[<>]+|[<>]+$", ""), "><"), lambda t: t != "")
    abstract = F.trim(F.regexp_replace(F.coalesce("abstract_text", F.lit("")), r"\s+", " "))
    people = F.coalesce("principal_investigators", F.array().cast("array<struct<profile_id:bigint,full_name:string,is_contact_pi:boolean>>"))
    pis = F.transform(people, lambda x: F.struct(x["profile_id"].alias("id"), x["full_name"].alias("name"), F.coalesce(x["is_contact_pi"], F.lit(False)).alias("contact")))
    flat = raw.select(
        "project_num", F.col("core_project_num").alias("core"), F.col("fiscal_year").alias("fy"), F.col("project_title").alias("title"),
        (abstract if max_chars is None else F.substring(abstract, 1, max_chars)).alias("abstract"), F.col("award_amount").alias("amount"),
        (terms if max_terms is None else F.slice(terms, 1, max_terms)).alias("terms"), F.substring(F.coalesce("project_start_date", F.lit("")), 1, 10).alias("start"),
        F.substring(F.coalesce("project_end_date", F.lit("")), 1, 10).alias("end"), F.coalesce("is_active", F.lit(False)).alias("active"), pis.alias("pis"),
        *(F.col(f"organization.org_{c}").alias(n) for c, n in (("name", "org"), ("city", "city"), ("state", "state"), ("country", "country"))),
        F.col("agency_ic_admin.abbreviation").alias("ic"), F.col("agency_ic_admin.name").alias("ic_name"), F.col("project_detail_url").alias("url"),
        F.col("activity_code").alias("activity"), "appl_id", "query")
    facts = [c for c in flat.columns if c not in ("project_num", "fy", "query")]
    return flat.groupBy("project_num", "fy").agg(F.min_by(F.struct(*facts), F.struct("query", "title")).alias("f"), F.array_sort(F.collect_set("query")).alias("queries")).select(
        "project_num", "fy", "f.*", "queries")


def grant_leads(grants: DataFrame) -> DataFrame:
    """`(grant_id, profile, name, affiliation)`: the investigators of each core project once, under the name and organisation of their
    latest year, from rows as `flatten_grants` gives them. Rows without core, investigator or profile are left out."""
    rows = grants.where("core IS NOT NULL").select("core", "fy", "project_num", "org", F.explode("pis").alias("p")).where("p.id IS NOT NULL")
    latest = rows.groupBy("core", F.col("p.id").alias("id")).agg(F.max_by(F.struct("p.name", "org"), F.struct("fy", "project_num")).alias("l"))
    return latest.select(F.concat(F.lit("GRANT:"), "core").alias("grant_id"), F.col("id").cast("string").alias("profile"), "l.name", F.coalesce("l.org", F.lit("")).alias("affiliation"))


# fixed values: characters that Spark escapes in the name of a partition's folder, besides control characters
ESCAPED = "\"#%'*/:=?\\{}[]^\x7f"


def _folder(by: str, value: str, gen: str) -> str:
    return f"{by}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value) + f"/gen={gen}"


# --- tables at rest -----------------------------------------------------------------------------------------------------------
def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The newest version number and its generation per relation; few rows, one per relation."""
    try:
        rows = spark.read.schema("rel string, gen string, version long").parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.agg(F.max("version")).first()[0]
    return newest or 0, {r.rel: r.gen for r in rows.where(F.col("version") == F.lit(newest)).where("rel IS NOT NULL").collect()}


def write_graph_tables(df: DataFrame, path: str, by: str = "rel", replace: bool = False) -> int:
    """Write new generations of the relations in `df` and point to them in one step; returns the new version number.

    Files lie in `data/<by>=.../gen=...`, and the manifest of a version, written last and as one file, names one generation per
    relation. A reader therefore sees one version throughout, whatever is being written. With `replace`, relations that `df`
    lacks stay as they are, else they are no longer part of the table. A second writer that ends at the same version number
    fails. Rows without a relation are left out. Parts are of even size whatever the size of a relation. Old files stay until `remove_old_generations`.
    """
    spark = df.sparkSession
    number, known = _manifest(spark, path)
    gen = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
    df = df.where(F.col(by).isNotNull())
    df.withColumn("gen", F.lit(gen)).hint("rebalance", by).write.mode("append").partitionBy(by, "gen").parquet(f"{path}/data")
    # the names of the folders tell which relations were written; `df` is computed once
    written = spark.read.schema(f"`{by}` string, gen string").option("basePath", f"{path}/data").parquet(f"{path}/data").where(F.col("gen") == gen)
    held = {r.rel: r.gen for r in written.select(F.col(by).alias("rel"), "gen").distinct().collect()}
    mapping = {**(known if replace else {}), **held}
    rows = spark.createDataFrame(list(mapping.items()) or [(None, None)], "rel string, gen string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={number + 1}")
    return number + 1


def read_graph_tables(spark: SparkSession, path: str, by: str = "rel", version: int | None = None) -> DataFrame:
    """The newest version, or a given one; a filter on `by` only reads the relations it names."""
    if version is None:
        mapping = _manifest(spark, path)[1]
    else:
        rows = spark.read.schema("rel string, gen string").parquet(f"{path}/manifest/version={version}")
        mapping = {r.rel: r.gen for r in rows.where("rel IS NOT NULL").collect()}
    if not mapping:
        return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").drop("gen").limit(0)
    parts = [f"{path}/data/{_folder(by, rel, gen)}" for rel, gen in sorted(mapping.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*parts).drop("gen")


def remove_old_generations(spark: SparkSession, path: str, by: str = "rel", keep: int = 2) -> int:
    """Empty the generations that none of the newest `keep` versions names; returns how many. Readers of older versions must have ended."""
    rows = spark.read.schema("rel string, gen string, version long").parquet(f"{path}/manifest").where("rel IS NOT NULL")
    newest = rows.agg(F.max("version")).first()[0] or 0
    old = rows.groupBy("rel", "gen").agg(F.max("version").alias("last")).where(F.col("last") <= newest - keep)
    gone = [(r.rel, r.gen) for r in old.collect()]
    for rel, gen in gone:
        at = f"{path}/data/{_folder(by, rel, gen)}"
        spark.read.parquet(at).limit(0).write.mode("overwrite").parquet(at + "/")
    return len(gone)


def source_manifest(tables: dict[str, tuple[DataFrame, str | None]], retrieved: str) -> DataFrame:
    """`(source, records, latest)`: records per source and its latest date, the retrieval date where it has none."""
    return union_all([df.agg(F.count("*").alias("records"), (F.max(F.col(date).cast("string")) if date else F.lit(None).cast("string")).alias("d")).select(
        F.lit(name).alias("source"), "records", F.coalesce("d", F.lit(retrieved)).alias("latest")) for name, (df, date) in tables.items()])


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """`(n_docs, fingerprint)` over ids and text lengths, whatever the order of rows."""
    h = F.xxhash64("doc_id", F.length("text"))
    return docs.agg(F.count("*").alias("n_docs"), F.bit_xor(h).alias("fingerprint"))
