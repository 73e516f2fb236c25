"""Audits of conversation texts: answers are assistant turns, their sources the earlier turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import q_retrieval as T
from lodestone.catalog.q_functions import CONTENT, SYL, grade_sql, lst  # noqa: F401
from lodestone.catalog.registry import query, view
from lodestone.functions import values as V
from lodestone.operators import answers as A

view("v_answer", """SELECT CAST(conv_id AS VARCHAR(20)) || '-' || turn AS answer_id, conv_id, turn, CAST(turn AS INT) AS n_sources,
  CASE WHEN turn = 1 THEN replace(text, '. ', ' [1]. ') WHEN turn = 3 AND length(text) > 600 THEN text || ' ANSWER_NOT_AVAILABLE' WHEN turn = 5 THEN replace(text, ',', ' [9],')
       WHEN turn = 3 THEN replace(text, '. ', ' [2]. It is not known. ') ELSE text END AS text FROM conversations WHERE role = 'assistant'""")
view("v_turn", "SELECT a.answer_id, CAST(s.turn + 1 AS INT) AS n, s.text FROM v_answer a JOIN conversations s ON s.conv_id = a.conv_id AND s.turn < a.turn")
WC = "len(list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> ''))"
view("x_piece", """SELECT answer_id, line, is_list, unit, row_number() OVER (PARTITION BY answer_id ORDER BY line, p) AS pos, CASE WHEN p = 0 THEN CASE WHEN line = 1 THEN '' ELSE chr(10) END ELSE ' ' END AS sep FROM (
  SELECT answer_id, line, is_list, unnest(CASE WHEN len(pieces) = 0 THEN [''] ELSE pieces END) AS unit, unnest(range(greatest(1, len(pieces)))) AS p FROM (
    SELECT answer_id, line, is_list, list_filter(CASE WHEN is_list THEN [l] ELSE
      list_transform(string_split(regexp_replace(l, '([.!?]["'')\\]]*(?:\\s*\\[\\d{1,2}\\])*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)) END, lambda x: trim(x) <> '') AS pieces FROM (
      SELECT answer_id, line, l, regexp_matches(l, '^\\s*(?:[-*•–]|\\d{1,2}[.)])\\s+') AS is_list FROM (
        SELECT answer_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM v_answer) a) b) c) d""")
view("x_fact_unit", f"""SELECT *, {WC.format('unit')} >= 3 AND trim(unit) NOT LIKE '%:' AS must, regexp_matches(unit, '\\[(\\d{{1,2}})\\]') OR regexp_matches(unit, '{V.LIMITATION}', 'i') AS covered FROM x_piece""")


@query("attribute_sentences", f"""WITH u AS (SELECT answer_id, rn - 1 AS pos, {CONTENT.format('unit')} AS k FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS rn FROM x_fact_unit WHERE unit <> '') z WHERE must AND NOT covered),
s AS (SELECT answer_id, n, {CONTENT.format('text')} AS k FROM v_turn),
o AS (SELECT u.answer_id, u.pos, s.n, len(list_intersect(u.k, s.k)) / len(u.k) AS overlap FROM u JOIN s ON s.answer_id = u.answer_id WHERE len(u.k) >= 4)
SELECT answer_id, CAST(pos AS INT) AS pos, n AS source, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, pos ORDER BY overlap DESC, n) AS rn FROM o) w WHERE rn = 1 AND overlap >= 0.1""")
def _(t):
    return T.r6(A.attribute_sentences(t("v_answer"), t("v_turn"), min_overlap=0.1), "overlap")


@query("verify_answers", f"""WITH c AS (SELECT answer_id, count(*) FILTER (WHERE must) AS n_units, count(*) FILTER (WHERE must AND NOT covered) AS n_dropped,
    coalesce(string_agg(sep || unit, '' ORDER BY pos) FILTER (WHERE NOT (must AND NOT covered)), '') AS j FROM x_fact_unit GROUP BY answer_id),
d AS (SELECT a.answer_id, a.text, a.n_sources, n_units, n_dropped, regexp_replace(regexp_replace(regexp_replace(trim(j), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS clean,
    list_transform(regexp_extract_all(a.text, '\\[(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INT)) AS cited FROM v_answer a JOIN c ON c.answer_id = a.answer_id)
SELECT answer_id, n_units, n_dropped, md5(clean) AS clean, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN contains(text, '{V.NOT_AVAILABLE}') THEN 'sentinel' WHEN len(cited) = 0 THEN 'no_citation'
  WHEN len(list_filter(cited, lambda x: x < 1 OR x > n_sources)) > 0 THEN 'out_of_range' WHEN n_units > 0 AND n_dropped / n_units > 0.5 THEN 'too_many_uncited'
  WHEN NOT regexp_matches(clean, '\\[(\\d{{1,2}})\\]') THEN 'nothing_left' ELSE 'ok' END AS verdict FROM d""")
def _(t):
    return A.verify_answers(t("v_answer")).withColumn("clean", F.md5("clean"))


@query("answer_sources")
def _(t):
    hits = T.bm25(t).where("rank <= 5")
    cited = hits.where("rank <= 2").select("query_id", F.col("rank").alias("n"))
    return T.r6(A.answer_sources(hits, T.questions(t), t("documents"), cited), "score")


# --- audits ---------------------------------------------------------------------------------------------------------------------
view("v_audit", """SELECT CAST(conv_id AS VARCHAR(20)) || '-' || turn AS doc_id, CASE WHEN turn = 1 THEN replace(text, '. ', ' [e1]. Maybe it could help 3 or 17 families. ')
  WHEN turn = 3 THEN replace(text, '. ', ' [e2]. ') ELSE text END AS text, conv_id, turn FROM conversations WHERE role = 'assistant'""")
view("v_allowed", "SELECT doc_id, 'e1' AS edge_id FROM v_audit UNION ALL SELECT doc_id, 'e2' FROM v_audit WHERE length(text) > 500")
view("v_support", "SELECT a.doc_id, s.text || ' 17 ' || s.turn AS text FROM v_audit a JOIN conversations s ON s.conv_id = a.conv_id AND s.turn < a.turn")
SENTS = ("list_filter(flatten(list_transform(string_split({0}, chr(10)), lambda x: string_split(regexp_replace(regexp_replace(trim(x), '" + V.SECTION_LABEL + "', '', 'i'), "
         "'([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x) <> '')")
PLAIN = "regexp_replace(text, '\\[(e\\d+)\\]', '', 'g')"
view("x_aud_w", f"""SELECT doc_id, j, regexp_replace(w0, '\\.+$', '') AS w, lower(regexp_replace(w0, '\\.+$', '')) AS lw FROM (SELECT doc_id, unnest(ws) AS w0, unnest(range(len(ws))) AS j FROM (
  SELECT doc_id, regexp_extract_all(s, '[A-Za-z0-9][A-Za-z0-9''\\-.]*') AS ws FROM (SELECT doc_id, unnest({SENTS.format(PLAIN)}) AS s FROM v_audit) a) b) c""")
view("x_aud_need", f"""SELECT DISTINCT doc_id, w, lw, CASE WHEN regexp_full_match(w, '\\d+(\\.\\d+)?%?') THEN 'number' WHEN j > 0 AND regexp_matches(w, '^[A-Z]') AND length(w) > 1 THEN 'name' ELSE 'long' END AS kind FROM x_aud_w
WHERE CASE WHEN regexp_full_match(w, '\\d+(\\.\\d+)?%?') THEN w NOT IN ('0', '1', '2', '3', '4') ELSE ((j > 0 AND regexp_matches(w, '^[A-Z]') AND length(w) > 1) OR length(w) >= 11) AND NOT list_contains({lst(V.COMMON_WORDS)}, lw) END""")
view("x_aud_tok", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*')) AS token FROM v_support")
view("x_aud_stem", "SELECT DISTINCT doc_id, substr(token, 1, 6) AS stem FROM x_aud_tok WHERE length(token) >= 6")
view("x_aud_fab", """SELECT doc_id, count(DISTINCT w) AS n_fabricated FROM x_aud_need n WHERE CASE WHEN kind = 'number' THEN NOT EXISTS (SELECT 1 FROM v_support s WHERE s.doc_id = n.doc_id AND contains(s.text, regexp_replace(n.w, '%$', '')))
  WHEN kind = 'name' THEN (doc_id, lw) NOT IN (SELECT doc_id, token FROM x_aud_tok) AND (doc_id, regexp_replace(lw, 's+$', '')) NOT IN (SELECT doc_id, token FROM x_aud_tok)
  ELSE (doc_id, lw) NOT IN (SELECT doc_id, token FROM x_aud_tok) AND (doc_id, substr(lw, 1, 6)) NOT IN (SELECT doc_id, stem FROM x_aud_stem) END GROUP BY doc_id""")
view("x_aud", f"""SELECT b.doc_id, len(sents) AS n_sentences, {WC.format('text')} AS n_words,
  len(list_filter(sents, lambda s: NOT regexp_matches(s, '\\[(e\\d+)\\]') AND NOT regexp_matches(s, '{V.HEDGE}', 'i') AND NOT regexp_matches(s, '\\?\\s*$'))) AS n_uncited,
  len(list_filter(sents, lambda s: {WC.format('s')} >= 4)) AS n_factual, len(list_filter(sents, lambda s: {WC.format('s')} >= 4 AND regexp_matches(s, '\\[(e\\d+)\\]'))) AS n_cited, grade,
  coalesce(n_bad, 0) AS n_bad, coalesce(n_fabricated, 0) AS n_fabricated FROM (SELECT doc_id, text, {SENTS.format('text')} AS sents FROM v_audit) b
JOIN (SELECT doc_id, {grade_sql('x')} AS grade FROM (SELECT doc_id, regexp_replace(text, '\\[e?\\d+\\]', '', 'g') AS x FROM v_audit) u) g ON g.doc_id = b.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT e) AS n_bad FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[(e\\d+)\\]', 1)) AS e FROM v_audit) u WHERE (doc_id, e) NOT IN (SELECT doc_id, edge_id FROM v_allowed) GROUP BY doc_id) c ON c.doc_id = b.doc_id
LEFT JOIN x_aud_fab f ON f.doc_id = b.doc_id""")
OK = "n_bad = 0 AND n_sentences >= 3 AND n_sentences <= 14 AND n_words <= 330 AND n_uncited = 0 AND n_fabricated = 0"


def audit(t):
    return A.audit_text(t("v_audit").select("doc_id", "text"), t("v_allowed"), t("v_support"))


@query("audit_text", f"""SELECT doc_id, n_sentences, n_words, n_uncited, n_factual, n_cited, round(grade, 6) AS grade, n_bad, n_fabricated, round(CASE WHEN n_factual > 0 THEN 100.0 * n_cited / n_factual ELSE 0.0 END, 6) AS pct_cited, {OK} AS ok FROM x_aud""")
def _(t):
    return T.r6(audit(t), "grade", "pct_cited")


@query("audit_summary", f"""SELECT count(*) AS n, round(avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(CASE WHEN n_bad = 0 THEN 1.0 ELSE 0.0 END), 6) AS valid_rate, count(*) FILTER (WHERE n_fabricated > 0) AS n_unsupported,
round(median(grade), 6) AS median_grade FROM x_aud""")
def _(t):
    return T.r6(A.audit_summary(audit(t)), "pass_rate", "valid_rate", "median_grade")


# a turn and the next one of its conversation, cut into sentences of equal rank, as fact and paraphrase
view("x_rw", f"""SELECT conv_id || '/' || turn || '/' || i AS pair_id, src, out FROM (SELECT a.conv_id, a.turn, unnest(range(len({SENTS.format('a.text')}))) AS i, unnest({SENTS.format('a.text')}) AS src,
  unnest(list_transform({SENTS.format('a.text')}, lambda s: replace(replace(s, ' the ', ' no '), 'on', 'ON'))) AS out FROM conversations a) u""")
LOWW = "list_distinct(list_transform({0}, lambda w: lower(w)))"
SW = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9''\\-.]*'), lambda w: regexp_replace(w, '\\.+$', ''))"


@query("audit_rewrites", f"""WITH a AS (SELECT pair_id, src, out, {SW.format('src')} AS sw, {SW.format('out')} AS ow FROM x_rw), b AS (SELECT *, {LOWW.format('sw')} AS sl, {LOWW.format('ow')} AS ol FROM a),
c AS (SELECT *, list_distinct(list_transform(list_filter(sl, lambda w: length(w) >= 5), lambda w: substr(w, 1, 5))) AS stems, list_filter(sw, lambda w, j: j > 1 AND regexp_matches(w, '^[A-Z]') AND length(w) > 1 AND NOT list_contains({lst(V.COMMON_WORDS)}, lower(w))) AS must,
  list_distinct(list_transform(list_filter(sl, lambda w: NOT list_contains({lst(V.COMMON_WORDS)}, w) AND length(w) > 3 AND NOT regexp_matches(w, '^[0-9]')), lambda w: substr(w, 1, 5))) AS core, list_distinct(list_transform(ol, lambda w: substr(w, 1, 5))) AS ostem FROM b),
d AS (SELECT *, len(list_filter(ow, lambda w, j: NOT (list_contains(sl, lower(w)) OR list_contains(sl, regexp_replace(lower(w), 's+$', '')) OR list_contains({lst(V.COMMON_WORDS)}, lower(w)))
  AND (regexp_full_match(w, '\\d+(\\.\\d+)?%?') OR (j > 1 AND regexp_matches(w, '^[A-Z]')) OR (length(w) >= 9 AND NOT list_contains(stems, substr(lower(w), 1, 5)))))) AS n_new, len(list_filter(must, lambda w: NOT list_contains(ol, lower(w)))) AS n_lost FROM c)
SELECT pair_id, array_to_string(list_filter([CASE WHEN len(regexp_extract_all(out, '\\w+')) > 34 OR length(out) < 12 THEN 'length' END, CASE WHEN contains(out, '[e') THEN 'tags' END, CASE WHEN n_new > 0 THEN 'new_terms' END,
  CASE WHEN len(must) > 0 AND n_lost > 0.6 * len(must) THEN 'dropped_names' END, CASE WHEN len(core) > 0 AND len(list_intersect(core, ostem)) / len(core) < 0.6 THEN 'lost_wording' END,
  CASE WHEN regexp_matches(src, '{V.NEGATION}', 'i') <> regexp_matches(out, '{V.NEGATION}', 'i') THEN 'negation' END], lambda x: x IS NOT NULL), '|') AS reasons FROM d""")
def _(t):
    facts = t("conversations").select("conv_id", "turn", F.posexplode(A.prose_sentences("text")).alias("i", "src"))
    pairs = facts.select(F.concat_ws("/", "conv_id", "turn", "i").alias("pair_id"), "src",
                         F.replace(F.replace("src", F.lit(" the "), F.lit(" no ")), F.lit("on"), F.lit("ON")).alias("out"))
    return A.audit_rewrites(pairs)
