"""Column expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.registry import query, view
from lodestone.functions import rules as R
from lodestone.functions import text as X
from lodestone.functions import values as V


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def inn(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(coalesce({c}, '')), '''s ', ' '), '’s ', ' '), '[^a-z0-9]+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    return f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')"


def case_sql(table: dict, c: str, other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + f" ELSE {other} END"


@query("norm_text", f"SELECT doc_id, md5({norm_sql('text')}) AS norm FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(X.norm_text("text")).alias("norm"))


@query("ascii_fold", f"SELECT doc_id, md5({fold_sql('text')}) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(X.ascii_fold("text")).alias("folded"))


@query("curie", "SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '^([^_]*)_', '\\1:') AS curie FROM pages")
def _(t):
    return t("pages").select("page_id", X.curie("url").alias("curie"))


@query("xref_norm", "SELECT xref, count(*) AS n FROM v_gd_raw GROUP BY xref")
def _(t):
    raw = t("v_gd_raw").select(F.regexp_replace("xref", "^ORPHA:", " Orphanet:").alias("x"))
    return raw.groupBy(X.xref_norm("x").alias("xref")).agg(F.count("*").alias("n"))


@query("freq_value", f"""
SELECT frequency, round(coalesce({case_sql(V.FREQUENCY_TERMS, 'frequency')},
  CASE WHEN TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 2) AS DOUBLE) > 0
    THEN TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 1) AS DOUBLE) / TRY_CAST(regexp_extract(frequency, '^(\\d+)/(\\d+)', 2) AS DOUBLE) END,
  TRY_CAST(regexp_extract(frequency, '^([\\d.]+)%', 1) AS DOUBLE) / 100), 6) AS value, count(*) AS n
FROM v_ann_raw GROUP BY frequency""")
def _(t):
    return t("v_ann_raw").groupBy("frequency").agg(F.count("*").alias("n")).select(
        "frequency", F.round(R.freq_value("frequency"), 6).alias("value"), "n")


view("x_country", f"""SELECT affiliation, CASE WHEN alias IS NOT NULL THEN alias WHEN len(w) > 0 AND w[-1] = 'usa' THEN 'usa'
  WHEN len(w) > 0 AND len(w) <= 2 AND w[1] IN {inn(V.US_STATES)} THEN 'usa'
  WHEN length(c) > 2 AND length(c) <= 20 AND len(w) <= 3 THEN c ELSE '' END AS country FROM (
  SELECT affiliation, c, {case_sql(V.COUNTRY_ALIASES, 'c')} AS alias, list_filter(regexp_split_to_array(c, ' +'), lambda x: x <> '') AS w FROM (
    SELECT affiliation, trim(regexp_replace({norm_sql(fold_sql("a[-1]"))}, '\\d+', '', 'g')) AS c FROM (
      SELECT DISTINCT affiliation, string_split(regexp_replace(regexp_replace(affiliation, '\\S+@\\S+', '', 'g'), 'electronic address.*', '', 'gi'), ',') AS a
      FROM v_author_row) u) v) z""")


@query("country_of", "SELECT affiliation, country FROM x_country")
def _(t):
    return t("v_author_row").select("affiliation").distinct().select("affiliation", R.country_of("affiliation").alias("country"))


view("x_author_key", f"""SELECT pmid, pos, regexp_replace(lower({fold_sql('last')}), '[^a-z]', '', 'g') AS ln,
  lower(substr({fold_sql("CASE WHEN initials <> '' THEN initials ELSE fore END")}, 1, 1)) AS ini,
  CASE WHEN length(f) >= 3 THEN f ELSE '' END AS fn FROM (
  SELECT *, coalesce(list_filter(regexp_split_to_array(replace(regexp_replace(lower({fold_sql('fore')}), '[^a-z\\- ]', '', 'g'), '-', ' '), ' +'), lambda x: x <> '')[1], '') AS f
  FROM v_author_row) u""")


@query("author_key", "SELECT ln, ini, fn, count(*) AS n FROM x_author_key GROUP BY ln, ini, fn")
def _(t):
    return t("v_author_row").groupBy(
        R.surname_key("last").alias("ln"), R.initial_key("initials", "fore").alias("ini"), R.forename("fore").alias("fn")
    ).agg(F.count("*").alias("n"))


NT, NA = V.NEGATIVE_TITLE, V.NEGATIVE_ABSTRACT
view("x_neg", f"""SELECT id, CASE WHEN t <> '' THEN 'title' WHEN a <> '' THEN 'abstract' END AS neg_where,
  CASE WHEN t <> '' THEN t WHEN a <> '' THEN a END AS neg_match FROM (
  SELECT id, regexp_extract(title, '{NT}', 0, 'i') AS t, regexp_extract(abstract, '{NA}', 0, 'i') AS a FROM v_paper) u""")


@query("negative_signal", f"""SELECT id, neg_where, neg_match FROM x_neg UNION ALL
SELECT 'DOC:' || doc_id, CASE WHEN m <> '' THEN 'abstract' END, CASE WHEN m <> '' THEN m END FROM (
  SELECT doc_id, regexp_extract(text, '{NA}', 0, 'i') AS m FROM documents) u""")
def _(t):
    texts = t("v_paper").select("id", "title", "abstract").unionByName(t("documents").select(
        F.concat(F.lit("DOC:"), "doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("abstract")))
    return texts.withColumn("s", R.negative_signal("title", "abstract")).select(
        "id", F.col("s.where").alias("neg_where"), F.col("s.match").alias("neg_match"))


view("x_assoc", """SELECT *, (atype LIKE 'Disease-causing%' OR atype LIKE 'Major susceptibility%' OR atype = 'MENDELIAN') AS causal,
  CASE WHEN source = 'HPO' THEN CASE atype WHEN 'MENDELIAN' THEN 0.9 WHEN 'POLYGENIC' THEN 0.5 ELSE 0.75 END
  ELSE CASE WHEN status = 'Assessed' THEN 0.95 ELSE 0.7 END - CASE WHEN atype LIKE 'Disease-causing%' OR atype LIKE 'Major susceptibility%'
    OR atype = 'MENDELIAN' THEN 0.0 ELSE 0.25 END END AS conf FROM v_gd_raw""")


@query("association_confidence", "SELECT source, atype, status, causal, CAST(round(conf, 6) AS DOUBLE) AS conf, count(*) AS n FROM x_assoc GROUP BY ALL")
def _(t):
    return t("v_gd_raw").groupBy("source", "atype", "status").agg(F.count("*").alias("n")).select(
        "source", "atype", "status", R.is_causal("atype").alias("causal"),
        F.round(R.association_confidence("source", "atype", "status"), 6).alias("conf"), "n")


view("x_variant", f"""SELECT DISTINCT gene, variation, significance, review, submitters, condition_ids,
  CASE WHEN significance IN {inn(V.PATHOGENIC)} THEN 'pathogenic' WHEN significance IN {inn(V.BENIGN)} THEN 'benign'
    WHEN significance = 'Uncertain significance' THEN 'vus' WHEN significance LIKE 'Conflicting%' THEN 'conflicting' ELSE 'other' END AS cls,
  {case_sql(V.REVIEW_STARS, 'review', '0')} AS stars FROM v_variant_raw""")


@query("significance_and_stars", """SELECT significance, review, cls, stars,
  CAST(CASE stars WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 WHEN 4 THEN 0.95 END AS DOUBLE) AS conf FROM x_variant GROUP BY ALL""")
def _(t):
    return t("v_variant_raw").select("significance", "review").distinct().select(
        "significance", "review", R.significance_class("significance").alias("cls"), R.review_stars("review").alias("stars"),
        R.star_confidence(R.review_stars("review")).alias("conf"))


@query("trial_kind", "SELECT id, kind FROM v_trial_kind")
def _(t):
    return t("v_trial").select("id", R.trial_kind("registry_flag", "title", "title", "study_type", "model").alias("kind"))


view("x_modal", "SELECT id, m FROM (" + " UNION ALL ".join(
    f"SELECT id, '{n}' AS m FROM v_trial WHERE regexp_matches(lower(title || ' ' || intervention), '{rx}')" for n, rx in V.MODALITIES.items()) + ") u")


@query("modality_tags", "SELECT v_trial.id, coalesce(tags, '') AS tags FROM v_trial LEFT JOIN (SELECT id, string_agg(m, '|' ORDER BY m) AS tags FROM x_modal GROUP BY id) m ON m.id = v_trial.id")
def _(t):
    return t("v_trial").select("id", F.array_join(R.modality_tags(F.concat_ws(" ", "title", "intervention")), "|").alias("tags"))


@query("model_system", f"""SELECT id, lower(regexp_extract(title, '{V.MODEL_SYSTEM}', 0, 'i')) AS system FROM v_paper
UNION ALL SELECT 'DOC:' || doc_id, lower(regexp_extract(text, '{V.MODEL_SYSTEM}', 0, 'i')) FROM documents""")
def _(t):
    texts = t("v_paper").select("id", "title").union(t("documents").select(F.concat(F.lit("DOC:"), "doc_id"), "text"))
    return texts.select("id", R.model_system("title").alias("system"))


STOPPED = f"upper(status) IN {inn(V.STOPPED)}"
STOP_W = (f"CASE WHEN {STOPPED} THEN CASE WHEN trim(why_stopped) <> '' AND regexp_matches(why_stopped, '{V.STOP_BENIGN}', 'i') THEN 0.1 "
          f"WHEN trim(why_stopped) <> '' AND regexp_matches(why_stopped, '{V.STOP_SAFETY}', 'i') THEN 0.7 WHEN trim(why_stopped) <> '' THEN 0.25 ELSE 0.3 END END")


@query("stop_reason", f"""SELECT status, why_stopped, CAST({STOP_W} AS DOUBLE) AS weight,
  CASE {STOP_W} WHEN 0.1 THEN 'objective met or administrative' WHEN 0.7 THEN 'efficacy/safety-related' WHEN 0.25 THEN 'operational' WHEN 0.3 THEN 'no reason given' END AS tag,
  count(*) AS n FROM v_trial GROUP BY status, why_stopped""")
def _(t):
    return t("v_trial").groupBy("status", "why_stopped").agg(F.count("*").alias("n")).select(
        "status", "why_stopped", R.stop_weight("status", "why_stopped").alias("weight"),
        R.stop_tag("status", "why_stopped").alias("tag"), "n")


RECENCY = "CASE WHEN {0} IS NULL OR NOT regexp_matches({0}, '^\\d{{4}}') THEN 1.0 ELSE greatest(0.85, 1.0 - 0.01 * greatest(0, greatest(0, 2010 - CAST(substr({0}, 1, 4) AS INT)) - 5)) END"


@query("recency", "SELECT date, CAST(round(" + RECENCY.format("date") + ", 6) AS DOUBLE) AS recency, count(*) AS n FROM v_edge_raw GROUP BY date")
def _(t):
    return t("v_edge_raw").groupBy("date").agg(F.count("*").alias("n")).select("date", F.round(R.recency("date", 2010), 6).alias("recency"), "n")


URL_SQL = "CASE " + " ".join(f"WHEN source_id LIKE '{p}%' THEN '{b}' || substr(source_id, {d + 1}) || '{a}'" for p, d, b, a in V.URL_TEMPLATES) + " ELSE '' END"


@query("source_url", f"SELECT source_id, {URL_SQL} AS url FROM (SELECT DISTINCT source_id FROM v_edge_raw UNION SELECT url FROM pages) u")
def _(t):
    ids = t("v_edge_raw").select("source_id").union(t("pages").select("url")).distinct()
    return ids.select("source_id", R.source_url("source_id").alias("url"))


@query("tokenize", "SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents) u")
def _(t):
    return t("documents").select("doc_id", X.tokenize("text").alias("k")).select(
        "doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))


CONTENT = ("list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-\\.α-ω]*[a-z0-9α-ω]|[a-z0-9]')), "
           "lambda w: (NOT list_contains(" + lst(V.CONTENT_STOP) + ", w) AND length(w) > 2) OR regexp_full_match(w, '[0-9]+'))")


@query("content_tokens", f"SELECT doc_id, len(k) AS n, md5(array_to_string(list_sort(k), ' ')) AS tokens FROM (SELECT doc_id, {CONTENT.format('text')} AS k FROM documents) u")
def _(t):
    return t("documents").select("doc_id", X.content_tokens("text").alias("k")).select(
        "doc_id", F.size("k").alias("n"), F.md5(F.array_join(F.array_sort("k"), " ")).alias("tokens"))


view("x_unit", """SELECT conv_id, turn, role, line, is_list, unit, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line, p) AS pos FROM (
  SELECT conv_id, turn, role, line, is_list, unnest(pieces) AS unit, unnest(range(len(pieces))) AS p FROM (
    SELECT conv_id, turn, role, line, is_list, list_filter(CASE WHEN is_list THEN [l] ELSE
      list_transform(string_split(regexp_replace(l, '([.!?]["'')\\]]*(?:\\s*\\[\\d{1,2}\\])*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)) END, lambda x: trim(x) <> '') AS pieces FROM (
      SELECT conv_id, turn, role, line, l, regexp_matches(l, '^\\s*(?:[-*•–]|\\d{1,2}[.)])\\s+') AS is_list FROM (
        SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS l, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM conversations) a) b) c) d""")


@query("split_units", "SELECT conv_id, turn, line, is_list, unit FROM x_unit")
def _(t):
    return t("conversations").select("conv_id", "turn", F.explode(X.split_units("text")).alias("u")).select("conv_id", "turn", "u.*")


QTOK = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-]+')), lambda w: NOT list_contains(" + lst(V.SNIPPET_STOP) + ", w))"
view("x_answer", """SELECT a.conv_id, a.turn, a.text AS body, q.text AS question FROM conversations a
JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'""")


@query("best_snippet", f"""
WITH s AS (SELECT conv_id, turn, question, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sents FROM x_answer),
r AS (SELECT conv_id, turn, sents, i, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect({QTOK.format('question')}, {QTOK.format('sents[i]')})) DESC, i) AS rn
  FROM (SELECT conv_id, turn, question, sents, unnest(range(1, len(sents) + 1)) AS i FROM s) u),
p AS (SELECT conv_id, turn, CASE WHEN length(sents[i]) < 160 AND i < len(sents) THEN sents[i] || ' ' || sents[i + 1] ELSE sents[i] END AS snip FROM r WHERE rn = 1)
SELECT conv_id, turn, CASE WHEN length(snip) > 320 THEN CASE WHEN substr(snip, 1, 320) LIKE '% %' THEN regexp_replace(substr(snip, 1, 320), '(?s) [^ ]*$', '') ELSE substr(snip, 1, 320) END || ' ...' ELSE snip END AS snippet FROM p""")
def _(t):
    turns = t("conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", X.best_snippet("text", "question").alias("snippet"))


SYL = ("CASE WHEN {w} = '' THEN 0 ELSE greatest(len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN {w} LIKE '%e' AND {w} NOT LIKE '%le' AND {w} NOT LIKE '%ee' "
       "AND len(regexp_extract_all({w}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1) END")


def grade_sql(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    words = f"regexp_extract_all({c}, '[A-Za-z][A-Za-z''-]*')"
    low = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
    sents = f"list_sum(list_transform({lines}, lambda x: 1 + len(regexp_extract_all(x, '[.!?]\\s+'))))"
    return (f"CASE WHEN len({words}) > 0 AND {sents} > 0 THEN 0.39 * len({words}) / {sents} + 11.8 * "
            f"list_sum(list_transform({words}, lambda w: {SYL.format(w=low)})) / len({words}) - 15.59 ELSE 0.0 END")


@query("readability_grade", "SELECT conv_id, turn, round(" + grade_sql("x") + ", 6) AS grade FROM (SELECT conv_id, turn, regexp_replace(text, '\\[e?\\d+\\]', '', 'g') AS x FROM conversations) u")
def _(t):
    return t("conversations").select("conv_id", "turn", F.round(X.readability_grade("text"), 6).alias("grade"))


@query("prevalence_summary", """
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 25 THEN 'Point prevalence' WHEN p_size > 10 THEN 'Annual incidence' ELSE '' END AS type,
    CASE WHEN p_retailprice > 1000 THEN '' ELSE '1-9 / ' || p_size END AS cls, CASE p_type WHEN 'PROMO' THEN 'Worldwide' WHEN 'SMALL' THEN '' ELSE p_type END AS geo,
    CASE WHEN p_name LIKE 'red%' THEN 'Validated' ELSE 'Not yet validated' END AS val, CASE WHEN p_size > 40 THEN '0.0' ELSE CAST(p_size AS VARCHAR) END AS moy FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, substr(type, 1, 1), geo ORDER BY val <> 'Validated', geo <> 'Worldwide', NOT (type LIKE '%prevalence'), cls = '', p_partkey) AS rn
  FROM p WHERE cls <> '' OR moy NOT IN ('', '0.0'))
SELECT p_brand, substr(type, 1, 1) AS t, geo, CASE WHEN cls <> '' THEN cls ELSE moy || ' (reported ' || CASE WHEN type = '' THEN 'value' ELSE type END || ')' END || ' - ' ||
  CASE WHEN type = '' THEN 'prevalence' ELSE type END || ', ' || CASE WHEN geo = '' THEN 'unspecified region' ELSE geo END ||
  CASE WHEN val = 'Validated' THEN '' ELSE ' (' || val || ')' END AS line FROM r WHERE rn = 1""")
def _(t):
    rec = t("part").select(
        "p_brand", "p_partkey", F.when(F.col("p_size") > 25, "Point prevalence").when(F.col("p_size") > 10, "Annual incidence").otherwise("").alias("type"),
        F.when(F.col("p_retailprice") > 1000, "").otherwise(F.concat(F.lit("1-9 / "), "p_size")).alias("class"),
        F.when(F.col("p_type") == "PROMO", "Worldwide").when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")).alias("geographic"),
        F.when(F.col("p_name").startswith("red"), "Validated").otherwise("Not yet validated").alias("validation"),
        F.when(F.col("p_size") > 40, "0.0").otherwise(F.col("p_size").cast("string")).alias("val_moy"))
    from lodestone.operators.rollups import best_prevalence

    return best_prevalence(rec.withColumn("t", F.substring("type", 1, 1)).withColumn("geo", F.col("geographic")),
                           ["p_brand", "t", "geo"], "p_partkey").withColumnRenamed("summary", "line")


@query("name_tokens", "SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(replace(c_name || ', PhD. ' || c_mktsegment || ' Jr', '.', ' '), '[\\s,]+'), lambda x: x <> '' AND lower(x) NOT IN "
       + inn(V.NAME_SUFFIXES) + "), '|') AS tokens FROM customer")
def _(t):
    name = F.concat("c_name", F.lit(", PhD. "), "c_mktsegment", F.lit(" Jr"))
    return t("customer").select("c_custkey", F.array_join(R.name_tokens(name), "|").alias("tokens"))


@query("affiliation_overlap", """SELECT id, list_has_any(list_filter(string_split(regexp_replace(lower(affiliation), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda w: length(w) > 3 AND w NOT IN """ + inn(V.GENERIC_INSTITUTION_WORDS) + """), string_split(lower(label || ' ' || replace(country, '_', ' ') || ' institute' || CASE WHEN homonym_risk THEN ' building' ELSE '' END), ' ')) AS overlap FROM v_person""")
def _(t):
    other = F.concat("label", F.lit(" "), F.replace("country", F.lit("_"), F.lit(" ")), F.lit(" institute"), F.when(F.col("homonym_risk"), " building").otherwise(""))
    return t("v_person").select("id", R.affiliation_overlap("affiliation", other).alias("overlap"))


TERM_SQL = "regexp_replace(regexp_replace(lower(trim(n)), '\\s+', ' ', 'g'), '\\s*\\((?:disease|disorder)\\)$', '')"


@query("usable_terms", f"""SELECT n, CASE WHEN length({TERM_SQL}) >= 6 THEN {TERM_SQL} ELSE '' END AS terms
FROM (SELECT DISTINCT p_name || CASE WHEN p_size > 25 THEN ' (disease)' ELSE '' END AS n FROM part) u""")
def _(t):
    names = t("part").select(F.concat("p_name", F.when(F.col("p_size") > 25, " (disease)").otherwise("")).alias("n")).distinct()
    return names.select("n", F.array_join(F.array_sort(X.usable_terms(F.array("n", F.concat(F.lit(" "), "n")))), "|").alias("terms"))
