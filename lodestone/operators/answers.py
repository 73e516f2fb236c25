"""Checks of answer texts against their sources and facts, as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import min_row
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.functions.rules import any_case

CITE = r"\[(\d{1,2})\]"
EDGE_CITE = r"\[(e\d+)\]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'\-.]*"


def is_factual(unit: Column) -> Column:
    """A unit that has to be cited or to state a limitation: three words or more and no lead-in."""
    return (X.word_count(unit) >= 3) & ~F.trim(unit).endswith(":")


def is_covered(unit: Column) -> Column:
    return unit.rlike(CITE) | unit.rlike(any_case(V.LIMITATION))


def attribute_sentences(answers: DataFrame, sources: DataFrame, min_overlap: float = 0.6, min_tokens: int = 4) -> DataFrame:
    """`(answer_id, pos, source, overlap)`: uncited sentences and the source that holds most of their content words.

    `answers(answer_id, text)`, `sources(answer_id, n, text)`. A sentence needs `min_tokens` content words, a source
    `min_overlap` of them; the earlier source wins a tie.
    """
    units = answers.select("answer_id", F.posexplode(X.split_units("text")).alias("pos", "u")).select("answer_id", "pos", F.col("u.unit").alias("unit"))
    open_units = units.where(is_factual(F.col("unit")) & ~is_covered(F.col("unit"))).withColumn("tokens", X.content_tokens("unit"))
    asked = open_units.where(F.size("tokens") >= min_tokens).select("answer_id", "pos", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    held = sources.select("answer_id", "n", F.explode(X.content_tokens("text")).alias("token"))
    shared = asked.join(held, ["answer_id", "token"]).groupBy("answer_id", "pos", "n", "n_tokens").agg(F.count("*").alias("hits"))
    share = shared.withColumn("overlap", F.col("hits") / F.col("n_tokens"))
    best = share.groupBy("answer_id", "pos").agg(min_row([(-F.col("overlap")).alias("o"), "n"]).alias("b"))
    return best.select("answer_id", "pos", F.col("b.n").alias("source"), (-F.col("b.o")).alias("overlap")).where(F.col("overlap") >= min_overlap)


def verify_answers(answers: DataFrame, max_uncited: float = 0.5) -> DataFrame:
    """`(answer_id, verdict, n_units, n_dropped, clean)` of `answers(answer_id, text, n_sources)`.

    An answer is refused when it is empty, carries the sentinel, cites nothing, cites a source never supplied, leaves more than
    `max_uncited` of its factual units uncited, or keeps no cited unit. `clean` is the text without uncited factual units.
    """
    pieces = X.answer_pieces("text")
    cited = F.transform(F.regexp_extract_all("text", F.lit(CITE), 1), lambda n: n.cast("int"))
    rows = answers.withColumn("pieces", pieces).withColumn("cited", cited)
    must = F.filter("pieces", lambda p: is_factual(p["unit"]))
    lost = F.filter(must, lambda p: ~is_covered(p["unit"]))
    kept = F.filter("pieces", lambda p: ~is_factual(p["unit"]) | is_covered(p["unit"]))
    clean = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda p: F.concat(p["sep"], p["unit"])), ""), "\n{3,}", "\n\n"))
    rows = rows.select("answer_id", "text", "n_sources", "cited", F.size(must).alias("n_units"), F.size(lost).alias("n_dropped"),
                       F.regexp_replace(clean, r"^\s+|\s+$", "").alias("clean"))
    verdict = (
        F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").when(F.col("text").contains(V.NOT_AVAILABLE), "sentinel")
        .when(F.size("cited") == 0, "no_citation").when(F.exists("cited", lambda n: (n < 1) | (n > F.col("n_sources"))), "out_of_range")
        .when((F.col("n_units") > 0) & (F.col("n_dropped") / F.col("n_units") > max_uncited), "too_many_uncited")
        .when(~F.col("clean").rlike(CITE), "nothing_left").otherwise("ok")
    )
    return rows.select("answer_id", verdict.alias("verdict"), "n_units", "n_dropped", "clean")


def answer_sources(hits: DataFrame, questions: DataFrame, docs: DataFrame, cited: DataFrame) -> DataFrame:
    """`(query_id, n, doc_id, score, snippet, cited)`: numbered source rows. `cited(query_id, n)`."""
    rows = hits.select("query_id", F.col("rank").alias("n"), "doc_id", "score").join(docs.select("doc_id", "text"), "doc_id").join(
        questions.select("query_id", F.col("text").alias("question")), "query_id")
    marks = cited.select("query_id", "n").distinct().withColumn("cited", F.lit(True))
    return rows.join(marks, ["query_id", "n"], "left").select(
        "query_id", "n", "doc_id", "score", X.best_snippet("text", "question").alias("snippet"), F.coalesce("cited", F.lit(False)).alias("cited"))


def prose_sentences(c) -> Column:
    """Sentences of a text line by line, section labels removed."""
    lines = F.transform(F.split(X._c(c), "\n"), lambda x: F.regexp_replace(F.trim(x), any_case(V.SECTION_LABEL), ""))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda s: F.trim(s) != "")


def audit_text(texts: DataFrame, allowed: DataFrame, support: DataFrame, max_sentences: int = 14, max_words: int = 330,
               common: list[str] | None = None) -> DataFrame:
    """Verification of texts against their facts, one row per text of `texts(doc_id, text)`.

    `allowed(doc_id, edge_id)`: ids that may be cited. `support(doc_id, text)`: the facts. Counts citations outside the allowed
    ids, uncited sentences that neither hedge nor ask, and words that need support but have none: numbers, capitalised words
    after the first of a sentence, and words of eleven letters or more.
    """
    common_words = V.COMMON_WORDS if common is None else common
    base = texts.select("doc_id", "text", prose_sentences("text").alias("sents"))
    cites = base.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EDGE_CITE), 1))).alias("edge_id"))
    bad = cites.join(allowed.select("doc_id", "edge_id").distinct(), ["doc_id", "edge_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_bad"))
    plain = F.regexp_replace("text", EDGE_CITE, "")
    words = texts.select("doc_id", F.posexplode(prose_sentences(plain)).alias("i", "s")).select(
        "doc_id", "i", F.posexplode(F.regexp_extract_all("s", F.lit(WORD), 0)).alias("j", "w0"))
    words = words.select("doc_id", "j", F.regexp_replace("w0", r"\.+$", "").alias("w")).withColumn("lw", F.lower("w"))
    is_num = F.col("w").rlike(r"^\d+(\.\d+)?%?$")
    is_name = (F.col("j") > 0) & F.col("w").rlike("^[A-Z]") & (F.length("w") > 1)
    is_long = F.length("w") >= 11
    needs = words.where(is_num | is_name | is_long).select(
        "doc_id", "w", "lw", F.when(is_num, "number").when(is_name, "name").otherwise("long").alias("kind")).distinct()
    needs = needs.where(F.when(F.col("kind") == "number", ~F.col("w").isin("0", "1", "2", "3", "4")).otherwise(~F.col("lw").isin(common_words)))
    held = support.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9][a-z0-9'\-]*"), 0))).alias("token")).distinct()
    stems = held.where(F.length("token") >= 6).select("doc_id", F.substring("token", 1, 6).alias("stem")).distinct()
    known = needs.join(held.select("doc_id", F.col("token").alias("lw")), ["doc_id", "lw"], "left_anti")
    names = known.where("kind = 'name'").withColumn("bare", F.regexp_replace("lw", "s+$", "")).join(
        held.select("doc_id", F.col("token").alias("bare")), ["doc_id", "bare"], "left_anti").select("doc_id", "w")
    long = known.where("kind = 'long'").withColumn("stem", F.substring("lw", 1, 6)).join(stems, ["doc_id", "stem"], "left_anti").select("doc_id", "w")
    nums = needs.where("kind = 'number'").withColumn("num", F.regexp_replace("w", "%$", ""))
    seen = nums.join(support.select("doc_id", F.col("text").alias("held")), "doc_id").where(F.contains("held", "num")).select("doc_id", "w")
    nums = nums.select("doc_id", "w").join(seen, ["doc_id", "w"], "left_anti")
    made_up = names.union(long).union(nums).distinct().groupBy("doc_id").agg(F.count("*").alias("n_fabricated"))
    cited = lambda s: s.rlike(EDGE_CITE)
    loose = F.filter("sents", lambda s: ~cited(s) & ~s.rlike(any_case(V.HEDGE)) & ~F.regexp_replace(s, r"\s+$", "").endswith("?"))
    factual = F.filter("sents", lambda s: X.word_count(s) >= 4)
    facts = base.select(
        "doc_id", F.size("sents").alias("n_sentences"), X.word_count("text").alias("n_words"), F.size(loose).alias("n_uncited"), F.size(factual).alias("n_factual"),
        F.size(F.filter(factual, cited)).alias("n_cited"), X.readability_grade("text").alias("grade"))
    out = facts.join(bad, "doc_id", "left").join(made_up, "doc_id", "left").fillna(0, ["n_bad", "n_fabricated"])
    share = F.when(F.col("n_factual") > 0, 100.0 * F.col("n_cited") / F.col("n_factual")).otherwise(0.0)
    ok = (
        (F.col("n_bad") == 0) & (F.col("n_sentences") >= 3) & (F.col("n_sentences") <= max_sentences) & (F.col("n_words") <= max_words)
        & (F.col("n_uncited") == 0) & (F.col("n_fabricated") == 0))
    return out.withColumn("pct_cited", share).withColumn("ok", ok)


def audit_rewrites(pairs: DataFrame, common: list[str] | None = None) -> DataFrame:
    """`(pair_id, reasons)` of `pairs(pair_id, src, out)`: why a paraphrase is no good, empty when it is fine.

    Length, tags, new terms, more than 60 % of the names dropped, less than 60 % of the wording kept, negation changed.
    """
    words = F.array(*[F.lit(w) for w in (V.COMMON_WORDS if common is None else common)])
    split = lambda c: F.transform(F.regexp_extract_all(c, F.lit(WORD), 0), lambda w: F.regexp_replace(w, r"\.+$", ""))
    low = lambda arr: F.array_distinct(F.transform(arr, lambda w: F.lower(w)))
    stem = lambda arr, n: F.array_distinct(F.transform(arr, lambda w: F.substring(w, 1, n)))
    rows = pairs.withColumn("sw", split("src")).withColumn("ow", split("out"))
    rows = rows.withColumn("sl", low("sw")).withColumn("ol", low("ow")).withColumn("common", words)
    rows = rows.withColumn("stems", stem(F.filter("sl", lambda w: F.length(w) >= 5), 5))
    flagged = F.transform("ow", lambda w, j: F.when(
        F.array_contains(F.col("sl"), F.lower(w)) | F.array_contains(F.col("sl"), F.regexp_replace(F.lower(w), "s+$", "")) | F.array_contains(F.col("common"), F.lower(w)), False)
        .otherwise(w.rlike(r"^\d+(\.\d+)?%?$") | ((j > 0) & w.rlike("^[A-Z]"))
                   | ((F.length(w) >= 9) & ~F.array_contains(F.col("stems"), F.substring(F.lower(w), 1, 5)))))
    must = F.filter("sw", lambda w, j: (j > 0) & w.rlike("^[A-Z]") & (F.length(w) > 1) & ~F.array_contains(F.col("common"), F.lower(w)))
    rows = rows.withColumn("n_new", F.size(F.filter(flagged, lambda x: x))).withColumn("must", must)
    lost = F.size(F.filter("must", lambda w: ~F.array_contains(F.col("ol"), F.lower(w))))
    src_core = stem(F.filter(F.array_except("sl", "common"), lambda w: (F.length(w) > 3) & ~w.rlike("^[0-9]")), 5)
    rows = rows.withColumn("n_lost", lost).withColumn("core", src_core).withColumn("kept", F.array_intersect(src_core, stem("ol", 5)))
    n_words = F.size(F.regexp_extract_all("out", F.lit(r"\w+"), 0))
    reasons = F.filter(F.array(
        F.when((n_words > 34) | (F.length("out") < 12), "length"), F.when(F.col("out").contains("[e"), "tags"), F.when(F.col("n_new") > 0, "new_terms"),
        F.when((F.size("must") > 0) & (F.col("n_lost") > 0.6 * F.size("must")), "dropped_names"),
        F.when((F.size("core") > 0) & (F.size("kept") / F.size("core") < 0.6), "lost_wording"),
        F.when(F.col("src").rlike(any_case(V.NEGATION)) != F.col("out").rlike(any_case(V.NEGATION)), "negation")), lambda x: x.isNotNull())
    return rows.select("pair_id", F.array_join(reasons, "|").alias("reasons"))


def audit_summary(audits: DataFrame) -> DataFrame:
    """Share of texts that pass, share with valid citations only, texts with unsupported words, median grade."""
    return audits.agg(
        F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("pass_rate"), F.avg((F.col("n_bad") == 0).cast("double")).alias("valid_rate"),
        F.count_if(F.col("n_fabricated") > 0).alias("n_unsupported"), F.percentile("grade", F.lit(0.5)).alias("median_grade"))
