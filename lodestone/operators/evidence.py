"""Evidence assessment of edges.

Every rule gives flags `(edge_id, kind, weight, ref_id)`. Flags from `COUNTS` on are counter-evidence, the others caveats.
Edges are `(edge_id, src, dst, rel, source, source_id, date, confidence, evidence_type)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import ordered_list, top_n, union_all
from lodestone.functions import rules as R
from lodestone.functions import values as V
from lodestone.operators.similarity import shared_of_pairs

COUNTS = 0.45
# fixed values: intervention words that say nothing about the treatment
GENERIC_INTERVENTION = ["placebo", "treatment", "therapy", "standard", "disease", "patients", "control", "observation", "transplant"]


def flags(rows: DataFrame, kind, weight, ref) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return rows.select("edge_id", lit(kind).alias("kind"), lit(weight).cast("double").alias("weight"), ref.alias("ref_id"))


def flag_stopped_study(edges: DataFrame, trials: DataFrame) -> DataFrame:
    """Edges of a stopped study: its conditions and citations, its people and organisations. `trials(id, status, why_stopped)`."""
    trial = F.when(F.col("rel").isin("studies", "cites"), F.col("src")).when(F.col("rel").isin("investigates", "runs"), F.col("dst"))
    edges = edges.where(F.col("rel").isin("studies", "cites", "investigates", "runs"))
    stopped = trials.select(F.col("id").alias("trial"), R.stop_weight("status", "why_stopped").alias("w")).where("w is not null")
    return flags(edges.withColumn("trial", trial).join(stopped, "trial"), "trial_stopped", F.col("w"), F.col("trial"))


def rated_papers(papers: DataFrame) -> DataFrame:
    """`(paper, kind, weight, year, title)` of papers that speak against a claim; the first rule that holds counts:
    retracted, negative title, comment, negative abstract. `papers(id, title, abstract, pub_type, year)`."""
    neg = R.negative_signal("title", "abstract")["where"]
    kind = (
        F.when(F.col("pub_type").isin(V.RETRACTED_TYPES), "retracted_paper").when(neg == "title", "negative_title")
        .when(F.col("pub_type").isin(V.COMMENT_TYPES), "comment_paper").when(neg == "abstract", "negative_abstract")
    )
    weight = R.lookup({"retracted_paper": 1.0, "negative_title": 0.5, "comment_paper": 0.2, "negative_abstract": 0.15}, F.col("kind"))
    return papers.withColumn("kind", kind).where("kind is not null").select(
        F.col("id").alias("paper"), "kind", weight.alias("weight"), "year", "title")


def flag_papers(links: DataFrame, rated: DataFrame, cap: int) -> DataFrame:
    """Flags of the rated papers among `links(edge_id, paper)`, at most `cap` per edge: heaviest, then oldest."""
    rows = links.select("edge_id", "paper").distinct().join(rated, "paper")
    return flags(top_n(rows, "edge_id", [F.col("weight").desc(), "year", "paper"], cap), F.col("kind"), F.col("weight"), F.col("paper"))


def flag_intervention_papers(edges: DataFrame, interventions: DataFrame, papers: DataFrame, rated: DataFrame, cap: int = 3) -> DataFrame:
    """For study edges: rated papers on the disease whose title holds a word of one of the study's interventions.

    `interventions(trial, text)`, `papers(id, paper)` by disease. Words have six letters or more and are found inside
    longer words too. The best `cap` papers per disease and word are enough for the best `cap` per edge, so studies and
    papers of a much-studied disease never meet pairwise.
    """
    pattern = F.lit("[a-z][a-z\\-]{5,}")
    words = interventions.select("trial", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), pattern, 0))).alias("word"))
    words = words.where(~F.col("word").isin(GENERIC_INTERVENTION)).distinct()
    asked = edges.where("rel = 'studies'").select("edge_id", F.col("src").alias("trial"), F.col("dst").alias("id")).join(words, "trial")
    runs = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z\\-]+"), 0), lambda r: F.length(r) >= 6)

    def inside(r):
        n = F.length(r)
        return F.flatten(F.transform(F.sequence(F.lit(1), n - 5), lambda i: F.transform(
            F.sequence(F.lit(6), n - i + 1), lambda k: F.substr(r, i, k))))

    titles = rated.select("paper", F.explode(F.array_distinct(F.flatten(F.transform(runs, inside)))).alias("word"))
    titles = titles.join(words.select("word").distinct(), "word", "left_semi")
    by_word = papers.select("id", "paper").join(titles, "paper").join(rated, "paper")
    by_word = top_n(by_word, ["id", "word"], [F.col("weight").desc(), "year", "paper"], cap)
    rows = asked.join(by_word, ["id", "word"]).select("edge_id", "paper", "kind", "weight", "year").distinct()
    return flags(top_n(rows, "edge_id", [F.col("weight").desc(), "year", "paper"], cap), F.col("kind"), F.col("weight"), F.col("paper"))


def flag_source_conflict(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Gene-disease edges: causal next to other labels 0.6, not yet assessed 0.5, listed by one source only 0.1.

    `records(gene, entity, source, atype, status)`.
    """
    facts = records.groupBy(F.col("gene").alias("src"), F.col("entity").alias("dst")).agg(
        F.bool_or(R.is_causal("atype")).alias("causal"), F.bool_or(~R.is_causal("atype") & (F.upper("atype") != "UNKNOWN")).alias("other"),
        F.bool_or(F.col("status") == "Not yet assessed").alias("open"),
        F.bool_or(F.col("source") == "HPO").alias("hpo"), F.bool_or(F.col("source") == "Orphanet").alias("orpha"))
    rows = edges.where(F.col("rel").isin("causes", "associated_with")).join(facts, ["src", "dst"])
    none = F.lit("")
    return union_all([
        flags(rows.where("causal and other"), "conflicting_status", 0.6, none), flags(rows.where("open"), "not_assessed", 0.5, none),
        flags(rows.where("hpo <> orpha"), "single_source", 0.1, none)])


def flag_excluded_pair(similar: DataFrame, exclusions: DataFrame, profile: DataFrame) -> DataFrame:
    """Similarity edges: a term recorded as absent on one side is present on the other. `similar(edge_id, a, b)`,
    `exclusions(entity, term)`, `profile(id, term)`."""
    both = similar.select("edge_id", F.col("a").alias("entity"), F.col("b").alias("id")).union(similar.select("edge_id", "b", "a"))
    rows = both.join(exclusions.select("entity", "term").distinct(), "entity").join(profile.select("id", "term"), ["id", "term"])
    return flags(rows, "excluded_phenotype", 0.5, F.concat_ws("|", "entity", "term"))


def flag_excluded_self(edges: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Annotation edges contradicted by a record of absence of the same entity."""
    out = exclusions.select(F.col("entity").alias("src"), F.col("term").alias("dst")).distinct()
    rows = edges.where("rel = 'has_phenotype'").join(out, ["src", "dst"])
    return flags(rows, "excluded_phenotype", 0.5, F.concat_ws("|", "src", "dst"))


def flag_no_cooccurrence(similar: DataFrame, papers: DataFrame, rated: DataFrame, cap: int = 3) -> DataFrame:
    """Similarity edges without a paper on both 0.3, else the rated papers on both. `papers(id, paper)`."""
    ends = similar.select("edge_id", "a", "b")
    bags = papers.select(F.col("id").alias("entity"), "paper")
    some = shared_of_pairs(ends, bags, key="paper").select("a", "b").distinct()
    none = ends.join(some, ["a", "b"], "left_anti")
    # only rated papers can become flags; the long edge ids come last
    both = shared_of_pairs(ends, bags.join(rated.select("paper"), "paper", "left_semi"), key="paper").select("a", "b", "paper").distinct().join(rated.drop("title"), "paper")
    best = top_n(both, ["a", "b"], [F.col("weight").desc(), "year", "paper"], cap)
    return flags(none, "absence", 0.3, F.lit("")).unionByName(flags(ends.join(best, ["a", "b"]), F.col("kind"), F.col("weight"), F.col("paper")))


def flag_below_threshold(similar: DataFrame) -> DataFrame:
    return flags(similar.where("below_threshold"), "below_threshold", 0.3, F.lit(""))


def flag_single_mention(edges: DataFrame, mentions: DataFrame, rated: DataFrame) -> DataFrame:
    """Mentions found once by text mining only 0.2; a retracted paper counts on any mention. `mentions(paper, entity, n)`."""
    rows = edges.where("rel = 'mentions'").join(mentions.select(F.col("paper").alias("src"), F.col("entity").alias("dst"), "n"), ["src", "dst"])
    weak = rows.where(~F.col("source").contains("MeSH") & (F.col("n") <= 1))
    gone = rows.join(rated.where("kind = 'retracted_paper'").select(F.col("paper").alias("src")), "src", "left_semi")
    return flags(weak, "single_mention", 0.2, F.lit("")).unionByName(flags(gone, "retracted_paper", 1.0, F.col("src")))


def flag_author_identity(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Authorship of a person without a persistent id."""
    rows = edges.where("rel = 'authored'").join(people.where("orcid = ''").select(F.col("id").alias("src")), "src", "left_semi")
    return flags(rows, "author_identity", 0.2, F.lit(""))


def flag_grant_match(edges: DataFrame, funds: DataFrame, grants: DataFrame) -> DataFrame:
    """Funding by a concept term 0.3, by a symbol 0.3, by an ended project 0.1. `funds(grant_id, entity, field)`."""
    rows = edges.where("rel = 'funds'").join(
        funds.select(F.col("grant_id").alias("src"), F.col("entity").alias("dst"), "field"), ["src", "dst"]).join(
        grants.select(F.col("id").alias("src"), "active"), "src")
    kinds = F.filter(F.array(
        F.when(F.col("field") == "terms", F.struct(F.lit("terms_only").alias("kind"), F.lit(0.3).alias("weight"))),
        F.when(F.col("field") == "gene symbol", F.struct(F.lit("symbol_only").alias("kind"), F.lit(0.3).alias("weight"))),
        F.when(~F.col("active"), F.struct(F.lit("inactive").alias("kind"), F.lit(0.1).alias("weight")))), lambda x: x.isNotNull())
    return flags(rows.select("edge_id", F.explode(kinds).alias("k")), F.col("k.kind"), F.col("k.weight"), F.lit(""))


def flag_lead_identity(edges: DataFrame, leads: DataFrame) -> DataFrame:
    """Leads matched to a person by name. `leads(person, grant_id, identity_match)`."""
    named = leads.where(F.col("identity_match").contains("existing researcher")).select(F.col("person").alias("src"), F.col("grant_id").alias("dst"))
    return flags(edges.where("rel = 'leads'").join(named, ["src", "dst"], "left_semi"), "lead_identity", 0.25, F.lit(""))


def flag_low_review(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Variant edges with one star at most. `variants(id, stars)`."""
    low = variants.where("stars <= 1").select(F.col("id").alias("src"))
    return flags(edges.where(F.col("rel").isin("variant_of", "pathogenic_for")).join(low, "src", "left_semi"), "low_review", 0.2, F.lit(""))


def flag_gene_reference_papers(edges: DataFrame, references: DataFrame, rated: DataFrame, cap: int = 2) -> DataFrame:
    """Rated papers among the references of gene-disease edges. `references(gene, entity, paper)`."""
    # the references of a pair are those of each of its edges, so they are rated and cut before they meet the long edge ids
    refs = references.where("paper <> ''").select(F.col("gene").alias("src"), F.col("entity").alias("dst"), "paper")
    found = top_n(refs.join(rated.drop("title"), "paper").distinct(), ["src", "dst"], [F.col("weight").desc(), "year", "paper"], cap)
    rows = edges.where(F.col("rel").isin("causes", "associated_with")).join(found, ["src", "dst"])
    return flags(rows, F.col("kind"), F.col("weight"), F.col("paper"))


def flag_cited_papers(edges: DataFrame, rated: DataFrame) -> DataFrame:
    """A rated paper cited by a study."""
    return flag_papers(edges.where("rel = 'cites'").select("edge_id", F.col("dst").alias("paper")), rated, 1)


def independent_sources(edges: DataFrame, similar: DataFrame, gene_papers: DataFrame, term_papers: DataFrame, cites: DataFrame) -> DataFrame:
    """`(edge_id, n_sources)`: number of source families behind an edge, one at least.

    `similar(edge_id, s_term, s_path, s_lit)`: components above zero count. Gene edges gain one by papers
    (`gene_papers(src, dst)`), studies by a citation (`cites(trial)`), annotations by a paper reference
    (`term_papers(src, dst)`); these two start at one. Funding has one source. Only edges of relations that gain by something are joined.
    """
    low = F.lower("source")
    families = sum(F.when(low.contains(f.lower()), 1).otherwise(0) for f in V.SOURCE_FAMILIES)
    comp = similar.select("edge_id", sum(F.when(F.col(c) > 0, 1).otherwise(0) for c in ("s_term", "s_path", "s_lit")).alias("parts"))
    extra = gene_papers.select("src", "dst").unionByName(term_papers.select("src", "dst")).distinct().withColumn("more", F.lit(1))
    more, noted = F.coalesce("more", F.lit(0)), ["causes", "associated_with", "has_phenotype"]
    rows = edges.select("edge_id", "src", "dst", "rel", families.alias("families"))
    other = F.coalesce(~F.col("rel").isin("similar_to", "studies", *noted), F.lit(True))
    parts = [
        rows.where("rel = 'similar_to'").join(comp, "edge_id", "left").select("edge_id", F.coalesce("parts", F.lit(0)).alias("n")),
        rows.where(F.col("rel").isin(noted)).join(extra, ["src", "dst"], "left").select("edge_id", F.when(F.col("rel") == "has_phenotype", 1 + more).otherwise(F.col("families") + more).alias("n")),
        rows.where("rel = 'studies'").join(cites.select(F.col("trial").alias("src"), F.lit(1).alias("cited")).distinct(), "src", "left").select("edge_id", (1 + F.coalesce("cited", F.lit(0))).alias("n")),
        rows.where(other).select("edge_id", F.when(F.col("rel") == "funds", 1).otherwise(F.col("families")).alias("n"))]
    return union_all(parts).select("edge_id", F.greatest(F.lit(1), "n").cast("int").alias("n_sources"))


def assess_edges(edges: DataFrame, all_flags: DataFrame, sources: DataFrame, support: DataFrame, as_of_year: int) -> DataFrame:
    """Breakdown and stance of every edge.

    penalty = min(0.4, 0.25 * counter-evidence + 0.05 * caveats), bonus by independent sources 0 / 0.05 / 0.08,
    overall = confidence * recency + bonus - penalty within 0 and 1. `support(edge_id, n_papers)`.
    """
    counted = all_flags.groupBy("edge_id").agg(
        F.sum(F.when(F.col("weight") >= COUNTS, F.col("weight")).otherwise(0.0)).alias("contra"),
        F.sum(F.when(F.col("weight") < COUNTS, F.col("weight")).otherwise(0.0)).alias("caveat"),
        F.count_if(F.col("weight") >= COUNTS).alias("n_contra"), F.count_if(F.col("weight") < COUNTS).alias("n_caveats"))
    rows = edges.join(counted, "edge_id", "left").join(sources, "edge_id").join(support, "edge_id", "left").fillna(
        0, ["contra", "caveat", "n_contra", "n_caveats", "n_papers"])
    rows = rows.withColumn("contra", F.round("contra", 9)).withColumn("caveat", F.round("caveat", 9))
    rows = rows.withColumn("recency", R.recency("date", as_of_year)).withColumn(
        "penalty", F.least(F.lit(0.4), 0.25 * F.col("contra") + 0.05 * F.col("caveat"))).withColumn(
        "bonus", F.when(F.col("n_sources") <= 1, 0.0).when(F.col("n_sources") == 2, 0.05).otherwise(0.08))
    raw = F.col("confidence") * F.col("recency") + F.col("bonus") - F.col("penalty")
    rows = rows.withColumn("overall", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 9))
    own = F.col("rel").isin("mentions", "authored")
    n_support = F.when(F.col("confidence") <= 0, 0).when(own, F.greatest(F.lit(1), F.col("n_papers"))).otherwise(F.col("n_papers") + F.col("n_sources"))
    stance = (
        F.when(F.col("supporting") == 0, "unsupported").when(F.col("contra") >= 0.6, "mixed")
        .when((F.col("overall") < 0.5) | ((F.col("evidence_type") == "inferred") & (F.col("n_sources") < 2)) | (F.col("caveat") >= 0.5), "weak")
        .otherwise("supported")
    )
    return rows.withColumn("supporting", n_support.cast("long")).withColumn("stance", stance).select(
        "edge_id", "rel", "evidence_type", "confidence", "n_sources", "recency", "bonus", "penalty", "overall", "supporting", "n_contra", "n_caveats", "stance")


def assessment_summary(assessed: DataFrame) -> DataFrame:
    """Edges by relation and stance."""
    names = ["supported", "mixed", "weak", "unsupported"]
    return assessed.groupBy("rel").pivot("stance", names).count().fillna(0, names)


def edge_report(edges: DataFrame, assessed: DataFrame, nodes: DataFrame, references: DataFrame, n: int = 20) -> DataFrame:
    """Edges with the labels and types of both ends, source address, the first `n` supporting papers, and the assessment.
    Curated edges keep their own confidence, others show the recomputed one. `references(edge_id, paper)`."""
    ends = nodes.select("id", "label", "type")
    refs = ordered_list(references.distinct(), "edge_id", ["paper"], F.col("paper"), n, "papers")
    facts = assessed.drop("rel", "evidence_type", "confidence")
    return (
        edges.join(ends.toDF("src", "src_label", "src_type"), "src", "left").join(ends.toDF("dst", "dst_label", "dst_type"), "dst", "left")
        .join(facts, "edge_id").join(refs, "edge_id", "left")
        .select("edge_id", "src", "dst", "rel", "src_label", "dst_label", "src_type", "dst_type", R.source_url("source_id").alias("url"),
                F.when(F.col("evidence_type") != "curated", F.col("overall")).otherwise(F.col("confidence")).alias("shown_confidence"),
                "overall", "n_sources", "supporting", "n_contra", "n_caveats", "stance", F.coalesce("papers", F.array().cast("array<string>")).alias("papers"))
    )
