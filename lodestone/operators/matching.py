"""Names in texts: conditions to entities, phrases in free text, glossary spans, sponsors, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut, min_row, spread, top_n, union_all
from lodestone.functions import rules as R
from lodestone.functions import values as V
from lodestone.functions.text import norm_text
from lodestone.operators.dictionary import find_names


def condition_names(dictionary: DataFrame, min_len: int = 3) -> DataFrame:
    """`(norm, entity)` from `dictionary(text, entity)`, all kinds of names."""
    return dictionary.select(norm_text("text").alias("norm"), "entity").where(F.length("norm") >= min_len).distinct()


def match_conditions(conditions: DataFrame, names: DataFrame, terms: DataFrame, xref_map: DataFrame, min_contained: int = 6) -> DataFrame:
    """Best link of a study to each entity: `(study, entity, condition, how, confidence)`.

    `conditions(study, condition, controlled)`, `names(norm, entity)`, `terms(norm, ui)`, `xref_map(xref, entity)`.
    Per condition the first of: exact name (0.95), controlled term through its cross reference (0.9), longest name
    contained at word boundaries (0.75). Each distinct condition text is matched once.
    """
    texts = conditions.select("condition", "controlled").distinct().withColumn("norm", norm_text("condition"))
    exact = texts.join(names, "norm").select("condition", "controlled", "entity", F.lit("exact synonym").alias("how"), F.lit(0.95).alias("confidence"))
    rest = texts.join(exact.select("condition", "controlled").distinct(), ["condition", "controlled"], "left_anti")
    term = rest.where("controlled").join(terms, "norm").select(
        "condition", "controlled", F.concat(F.lit("MESH:"), "ui").alias("xref")).join(xref_map, "xref").select(
        "condition", "controlled", "entity", F.lit("controlled term").alias("how"), F.lit(0.9).alias("confidence"))
    rest = rest.join(term.select("condition", "controlled").distinct(), ["condition", "controlled"], "left_anti")
    usable = names.where(F.length("norm") >= min_contained).withColumnRenamed("norm", "phrase")
    found = find_names(rest.select(F.col("norm").alias("text"), "norm").distinct(), usable, "text")
    best = found.groupBy(F.col("text").alias("norm")).agg(min_row([(-F.length("phrase")).alias("l"), "phrase"]).alias("b"))
    part = rest.join(best, "norm").select("condition", "controlled", F.col("b.phrase").alias("phrase")).join(usable, "phrase").select(
        "condition", "controlled", "entity", F.concat(F.lit("contains '"), "phrase", F.lit("'")).alias("how"), F.lit(0.75).alias("confidence"))
    links = conditions.select("study", "condition", "controlled").distinct().join(union_all([exact, term, part]), ["condition", "controlled"])
    one = links.groupBy("study", "entity").agg(min_row([(-F.col("confidence")).alias("c"), "controlled", "condition", "how"]).alias("b"))
    return one.select("study", "entity", "b.condition", "b.how", (-F.col("b.c")).alias("confidence"))


def phrase_dictionary(dictionary: DataFrame, min_len: int = 6, max_targets: int | None = None) -> DataFrame:
    """`(phrase, entity)`: a name that is some entity's label stands for those entities only, else for all entities or, if given,
    the first `max_targets` in id order. `dictionary(text, entity, is_label)`."""
    rows = dictionary.select(norm_text("text").alias("phrase"), "entity", "is_label").where(F.length("phrase") >= min_len)
    rows = rows.groupBy("phrase", "entity").agg(F.bool_or("is_label").alias("is_label"))
    labelled = rows.groupBy("phrase").agg(F.bool_or("is_label").alias("any_label"))
    rows = rows.join(labelled, "phrase")
    other = rows.where("not any_label").select("phrase", "entity")
    return rows.where("is_label").select("phrase", "entity").unionByName(
        other if max_targets is None else top_n(other, "phrase", ["entity"], max_targets))


def match_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """`(doc_id, entity, phrase)`: entities named in texts; a phrase contained in a longer phrase found in the same text
    does not count. `texts(doc_id, text)`, `phrases(phrase, entity)`.

    Texts are walked by the tries of `find_names`. Which phrases hold which others is found in the dictionary once, so phrases of a
    text are not compared with each other.
    """
    known = phrases.select("phrase").distinct()
    found = cut(find_names(spread(texts.select("doc_id", "text")).select("doc_id", norm_text("text").alias("norm")), known), "found")
    inside = find_names(known.select(F.col("phrase").alias("longer"), F.col("phrase").alias("norm")), known, "longer").where("longer <> phrase")
    parts = found.withColumnRenamed("phrase", "longer").join(cut(inside, "inside"), "longer").select("doc_id", "phrase").distinct()
    kept = found.join(parts, ["doc_id", "phrase"], "left_anti")
    hits = kept.join(phrases, "phrase")
    return hits.groupBy("doc_id", "entity").agg(min_row([(-F.length("phrase")).alias("l"), "phrase"]).alias("b")).select(
        "doc_id", "entity", F.col("b.phrase").alias("phrase"))


def glossary_spans(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """`(doc_id, start, stop, match, canonical)`: glossary terms in texts, longest match first, never overlapping, any case.

    `texts(doc_id, text)`, `glossary(term, canonical)`. A text is cut into words with their offsets, word n-grams are
    joined with the glossary, and the hits of one text are read once from left to right.
    """
    terms = glossary.select(F.lower("term").alias("term"), "canonical").groupBy("term").agg(F.min("canonical").alias("canonical"))
    counts = terms.select(F.regexp_count("term", F.lit(r"[\w-]+")).alias("n")).distinct().collect()
    lengths = sorted(r.n for r in counts if r.n)
    pieces = texts.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\w-]+|[^\w-]+"), 0)).alias("i", "piece"))
    here = Window.partitionBy("doc_id").orderBy("i")
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    longest = max(lengths) if lengths else 1
    ahead = F.collect_list("piece").over(here.rowsBetween(0, 2 * longest - 2))
    spans = placed.withColumn("ahead", ahead).where(F.col("piece").rlike(r"^[\w-]")).select(
        "doc_id", "start", F.explode(F.array(*[F.when(F.size("ahead") >= 2 * n - 1, F.array_join(F.slice("ahead", 1, 2 * n - 1), "")) for n in lengths])).alias("match")
    ).where("match is not null")
    hits = spans.withColumn("term", F.lower("match")).join(terms, "term").withColumn("stop", F.col("start") + F.length("match"))
    per_text = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.length("match")).alias("neg"), "stop", "match", "canonical"))).alias("h"))
    empty = F.filter("h", lambda x: F.lit(False))
    kept = F.aggregate("h", empty, lambda acc, x: F.when(
        (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["stop"] <= x["start"]), F.array_append(acc, x)).otherwise(acc))
    return per_text.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.stop", "s.match", "s.canonical")


def sponsor_edges(sponsors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Organisation to study: a seed organisation by its normalised name, else one whose class and name pattern fit.

    `sponsors(trial, name, cls, role)`, `seeds(norm, org)`.
    """
    rows = sponsors.where("name <> ''").withColumn("norm", norm_text("name")).join(seeds, "norm", "left")
    fits = (F.col("cls") == "OTHER") & F.col("name").rlike(R.any_case(V.ORG_INCLUDE)) & ~F.col("name").rlike(R.any_case(V.ORG_EXCLUDE))
    made = F.concat(F.lit("ORG:"), F.replace("norm", F.lit(" "), F.lit("-")))
    return rows.where(F.col("org").isNotNull() | fits).select(
        F.coalesce("org", made).alias("org"), "trial", "role", "name", F.lit(0.9).alias("confidence"), F.col("org").isNotNull().alias("is_seed"))


def project_entity_edges(projects: DataFrame, phrases: DataFrame, latest: int | None = None) -> DataFrame:
    """Grant to entity by text match in its rows, or in the `latest` ones if given: title 0.9, abstract 0.7, concept term 0.6, best field wins.

    `projects(core, project_num, fy, title, abstract, terms)` with `terms` an array. A concept term must be a name as a whole.
    """
    recent = projects if latest is None else top_n(projects, "core", [F.col("fy").desc(), F.col("project_num").desc()], latest)
    long = recent.select("core", F.explode(F.array(
        F.struct(F.lit("title").alias("field"), F.lit(0.9).alias("c"), F.col("title").alias("text")),
        F.struct(F.lit("abstract").alias("field"), F.lit(0.7).alias("c"), F.col("abstract").alias("text")))).alias("f")).select("core", "f.*")
    long = long.distinct().withColumn("doc_id", F.concat_ws("|", "core", "field", F.xxhash64("text")))
    hits = match_phrases(long.select("doc_id", "text"), phrases).join(long.select("doc_id", "core", "field", "c"), "doc_id")
    whole = recent.select("core", F.explode("terms").alias("t")).select("core", norm_text("t").alias("phrase")).distinct().join(phrases, "phrase")
    rows = hits.select("core", "entity", "field", "c", "phrase").unionByName(
        whole.select("core", "entity", F.lit("terms").alias("field"), F.lit(0.6).alias("c"), "phrase"))
    best = rows.groupBy("core", "entity").agg(min_row([(-F.col("c")).alias("w"), "field", "phrase"]).alias("b"))
    return best.select("core", "entity", "b.field", "b.phrase", (-F.col("b.w")).alias("confidence"))


def symbol_fallback(unmatched: DataFrame, symbols: DataFrame, parents: DataFrame, min_len: int = 4) -> DataFrame:
    """For projects no name was found in: symbols as whole words of the title, their entities, without an entity whose
    parent is also one of the symbol's. `unmatched(core, title)`, `symbols(symbol, entity)`, `parents(child, parent)`."""
    usable = symbols.where(F.length("symbol") >= min_len).where(~F.col("symbol").isin(V.AMBIGUOUS_SYMBOLS)).distinct()
    up = parents.select(F.col("child").alias("entity"), F.col("parent"))
    covered = usable.join(up, "entity").join(usable.select("symbol", F.col("entity").alias("parent")), ["symbol", "parent"]).select("symbol", "entity")
    general = usable.join(covered.distinct(), ["symbol", "entity"], "left_anti")
    words = unmatched.select("core", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"\w+"), 0))).alias("symbol"))
    return words.join(general, "symbol").groupBy("core", "entity").agg(F.min("symbol").alias("symbol")).withColumn("confidence", F.lit(0.6))


def trial_edges(links: DataFrame, trials: DataFrame, references: DataFrame, papers: DataFrame) -> DataFrame:
    """Study to entity with the way it was matched and its status, and study to every cited paper of the corpus, for
    studies with a link at least. `links` as from `match_conditions`, `references(trial, paper)`."""
    linked = trials.join(links.select(F.col("study").alias("id")).distinct(), "id", "left_semi")
    studies = links.join(linked.select(F.col("id").alias("study"), "status", "start"), "study").select(
        F.col("study").alias("src"), F.col("entity").alias("dst"), F.lit("studies").alias("rel"), "confidence",
        F.col("start").alias("date"), F.col("how").alias("matched_by"), "status")
    cites = references.join(linked.select(F.col("id").alias("trial"), "status", "start"), "trial").join(
        papers.select(F.col("id").alias("paper")), "paper", "left_semi").select(
        F.col("trial").alias("src"), F.col("paper").alias("dst"), F.lit("cites").alias("rel"), F.lit(0.9).alias("confidence"),
        F.col("start").alias("date"), F.lit("").alias("matched_by"), "status")
    return studies.unionByName(cites).distinct()
