"""People: identity of authors, and links of officials and investigators to known people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut, min_row
from lodestone.functions import rules as R
from lodestone.functions import values as V
from lodestone.functions.text import ascii_fold, norm_text


def disambiguate_authors(authors: DataFrame) -> DataFrame:
    """Author rows with a person key.

    `authors(pmid, pos, last, fore, initials, affiliation, orcid, year)`. A persistent id wins. Otherwise, when exactly
    one persistent id occurs under the same surname and initial and neither country nor forename speaks against it, that
    id is taken. Otherwise surname, initial and country, the country being the commonest one unless the row's own occurs
    twice; where such a name covers several forenames it is split by forename, and rows with initials only go to a
    separate key marked as homonym risk.

    All facts about a name are aggregates joined back to the rows, so a very common name is never gathered in one task.
    """
    rows = authors.select(
        "pmid", "pos", "last", "fore", "affiliation", "year", R.surname_key("last").alias("ln"),
        R.initial_key("initials", "fore").alias("ini"), R.forename("fore").alias("fn"), R.country_of("affiliation").alias("country"),
        F.trim(F.regexp_replace(F.coalesce("orcid", F.lit("")), r"^https?://orcid.org/", "")).alias("orcid"),
    ).where("ln <> '' and ini <> ''").withColumn("at", F.struct("pmid", "pos"))
    # keys come from Python; written once, read by all that follows
    rows = cut(rows, "authors")
    name = ["ln", "ini"]
    ids = rows.where("orcid <> ''").groupBy(*name, "orcid").agg(
        F.min_by("fn", "at").alias("fn_id"), F.min_by(F.when(F.col("country") != "", F.col("country")), F.when(F.col("country") != "", F.col("at"))).alias("country_id"))
    sole = ids.groupBy(*name).agg(F.count("*").alias("n_ids"), F.min("orcid").alias("sole"), F.min("fn_id").alias("fn_id"),
                                  F.min("country_id").alias("country_id")).where("n_ids = 1").drop("n_ids")
    seen = rows.where("orcid = '' and country <> ''").groupBy(*name, "country").agg(F.count("*").alias("n_country"))
    top = seen.groupBy(*name).agg(min_row([(-F.col("n_country")).alias("m"), "country"]).alias("t")).select(*name, F.col("t.country").alias("top"))
    known = rows.join(sole, name, "left").join(top, name, "left").join(seen, [*name, "country"], "left")
    adopt = (
        F.col("sole").isNotNull()
        & ((F.col("country") == "") | (F.coalesce("country_id", "country") == F.col("country")))
        & ((F.col("fn") == "") | (F.col("fn") == F.col("fn_id")) | (F.coalesce("fn_id", F.lit("")) == ""))
    )
    known = known.withColumn("person_id", F.when(F.col("orcid") != "", F.col("orcid")).when(adopt, F.col("sole")).otherwise("")).withColumn(
        "place", F.when(F.col("n_country") >= 2, F.col("country")).otherwise(F.coalesce("top", F.lit(""))))
    named = known.where("person_id = ''").where("fn <> ''").groupBy(*name, "place").agg(F.countDistinct("fn").alias("n_fn"))
    keyed = known.join(named, [*name, "place"], "left").withColumn("split", (F.col("person_id") == "") & (F.coalesce("n_fn", F.lit(0)) >= 2))
    base = F.concat_ws("|", "ln", "ini", "place")
    suffix = F.when(~F.col("split"), "").when(F.col("fn") != "", F.concat(F.lit("|"), "fn")).otherwise("|?")
    key = F.concat(F.lit("AUTH:"), F.when(F.col("person_id") != "", F.col("person_id")).otherwise(F.concat(base, suffix)))
    return keyed.select("pmid", "pos", "ln", "ini", "last", "fore", "fn", "country", "affiliation", "year", F.col("person_id").alias("orcid"),
                        key.alias("key"), (F.col("split") & (F.col("fn") == "")).alias("homonym_risk"))


def author_nodes(rows: DataFrame, min_papers: int = 2) -> DataFrame:
    """People with at least `min_papers` papers: best written forename, latest affiliation, commonest country, method."""
    person = rows.groupBy("key").agg(
        F.countDistinct("pmid").alias("n_papers"), F.max("orcid").alias("orcid"), F.bool_or("homonym_risk").alias("homonym_risk"),
        F.min_by("last", F.struct("pmid", "pos")).alias("last"),
        F.max_by(F.when(F.col("affiliation") != "", F.col("affiliation")), F.when(F.col("affiliation") != "", F.struct("year", "pmid", "affiliation"))).alias("affiliation"),
    ).where(F.col("n_papers") >= min_papers)
    fores = rows.groupBy("key", "fore", "fn").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct((F.col("fn") != "").alias("w"), "n", F.length("fore").alias("l"), "fore")).alias("f"))
    lands = rows.where("country <> ''").groupBy("key", "country").agg(F.count("*").alias("n")).groupBy("key").agg(
        min_row([(-F.col("n")).alias("m"), "country"]).alias("c"))
    how = F.when(F.col("orcid") != "", "orcid").when(F.col("homonym_risk"), "name+initial+country (initials only; homonyms likely)").otherwise("name+initial+country")
    return person.join(fores, "key").join(lands, "key", "left").select(
        F.col("key").alias("id"), F.trim(F.concat_ws(" ", "f.fore", "last")).alias("label"), "n_papers", "orcid", "homonym_risk",
        F.coalesce("affiliation", F.lit("")).alias("affiliation"), F.coalesce("c.country", F.lit("")).alias("country"), how.alias("method"))


def author_edges(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Person to paper, one edge per pair, confidence by the way the person was told apart."""
    one = rows.groupBy("key", "pmid").agg(F.min("year").alias("year"))
    conf = F.when(F.col("orcid") != "", 0.95).when(F.col("homonym_risk"), 0.5).otherwise(0.75)
    return one.join(people.select(F.col("id").alias("key"), "orcid", "homonym_risk"), "key").select(
        F.col("key").alias("src"), F.concat(F.lit("PMID:"), "pmid").alias("dst"), "year", conf.alias("confidence"))


def _candidates(listed: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """Per listed person: number of people of the same surname and initial, the only one of them, and the only one of those whose
    affiliation overlaps (`hit`, null if there is none or more than one).

    People are never paired with listed ones. Of every (surname, initial, word) the least and the greatest person are kept; a listed
    person has one hit exactly when these agree over all its words. So a common name costs no more than its words.
    """
    known = people.select("ln", "ini", F.col("id").alias("cand"), F.col("affiliation").alias("cand_aff"), F.col("country").alias("cand_country"))
    names = known.groupBy("ln", "ini").agg(F.count("*").alias("n_cand"), F.min("cand").alias("only"), F.min("cand_country").alias("only_country"))
    words = known.select("ln", "ini", "cand", F.explode(F.array_distinct(F.split(norm_text(ascii_fold("cand_aff")), " "))).alias("word"))
    ends = words.groupBy("ln", "ini", "word").agg(F.min("cand").alias("least"), F.max("cand").alias("most"))
    wanted = listed.select(*keys, "ln", "ini", F.explode(R.institution_words("affiliation")).alias("word"))
    hits = wanted.join(ends, ["ln", "ini", "word"]).groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    hits = hits.where("least = most").select(*keys, F.col("least").alias("hit"))
    return listed.join(names, ["ln", "ini"], "left").join(hits, keys, "left").fillna(0, ["n_cand"])


def match_officials(officials: DataFrame, people: DataFrame) -> DataFrame:
    """Links of study officials: one person with an overlapping affiliation (0.85), else the only person of that name
    (0.7), else a new person (0.9). Role-like and one-word names are dropped.

    `officials(trial, pos, name, affiliation)`, `people(id, ln, ini, affiliation, country)`.
    """
    raw = F.trim(F.substring_index("name", ",", 1))
    words = F.filter(F.split(F.replace(ascii_fold(raw), F.lit("."), F.lit(" ")), r"\s+"), lambda w: w != "")
    rows = officials.withColumn("raw", raw).withColumn("w", words).where(F.size("w") >= 2).where(~F.col("raw").rlike(R.any_case(V.BAD_OFFICIAL)))
    rows = rows.select("trial", "pos", "raw", "affiliation", R.surname_key(F.element_at("w", -1)).alias("ln"),
                       F.lower(F.substring(F.element_at("w", 1), 1, 1)).alias("ini"))
    both = _candidates(rows, people, ["trial", "pos"])
    new = F.concat(F.lit("AUTH:ct|"), F.concat_ws("|", "ln", "ini", F.replace(norm_text("affiliation"), F.lit(" "), F.lit("-"))))
    return both.select(
        "trial", "pos", F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.col("n_cand") == 1, F.col("only")).otherwise(new).alias("person"),
        F.when(F.col("hit").isNotNull(), "name + affiliation").when(F.col("n_cand") == 1, "name").otherwise("new").alias("how"),
        F.when(F.col("hit").isNotNull(), 0.85).when(F.col("n_cand") == 1, 0.7).otherwise(0.9).alias("confidence"))


def match_principal_investigators(leads: DataFrame, people: DataFrame, home: str = "usa") -> DataFrame:
    """Links of grant leads: one person with an overlapping affiliation (0.8), else the only person of that name if the
    country fits or is unknown (0.6), else a person of its own by profile id (0.95).

    `leads(grant_id, profile, name, affiliation)`.
    """
    rows = leads.withColumn("w", R.name_tokens("name")).select(
        "grant_id", "profile", "affiliation", "w", F.when(F.size("w") >= 2, R.surname_key(F.try_element_at("w", F.lit(-1)))).alias("ln"),
        F.when(F.size("w") >= 2, F.lower(F.substring(F.try_element_at("w", F.lit(1)), 1, 1))).alias("ini"))
    both = _candidates(rows, people, ["grant_id", "profile"])
    near = (F.col("n_cand") == 1) & F.col("only_country").isin(home, "")
    return both.select(
        "grant_id", "profile",
        F.when(F.col("hit").isNotNull(), F.col("hit")).when(near, F.col("only")).otherwise(F.concat(F.lit("AUTH:nih|"), "profile")).alias("person"),
        F.when(F.col("hit").isNotNull(), "name + affiliation match to existing researcher").when(near, "name match to existing researcher")
        .otherwise("profile id").alias("how"),
        F.when(F.col("hit").isNotNull(), 0.8).when(near, 0.6).otherwise(0.95).alias("confidence"))
