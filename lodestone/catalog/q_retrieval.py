"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import built as B
from lodestone.catalog import q_lookup as K
from lodestone.catalog.q_functions import QTOK, norm_sql
from lodestone.catalog.registry import query, view
from lodestone.common import union_all
from lodestone.operators import retrieval as H
from lodestone.operators.textindex import build_index

r6 = lambda df, *names: df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])

TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
view("x_post", f"SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT doc_id, unnest(k) AS term, len(k) AS dl FROM (SELECT doc_id, {TOK} AS k FROM documents) d) u GROUP BY doc_id, term")
view("x_raw_idf", "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM x_post GROUP BY term")
view("x_tw", "SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM x_raw_idf) ELSE raw END AS idf FROM x_raw_idf")
view("x_qt", f"SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) u GROUP BY item_id, term")
view("x_bm", f"""SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len({TOK})) FROM documents)))), 9) AS score
FROM x_qt JOIN x_tw ON x_tw.term = x_qt.term JOIN x_post ON x_post.term = x_qt.term GROUP BY query_id, doc_id""")
view("x_bmk", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x_bm WHERE score > 0) u WHERE rank <= 50")


def index(t):
    return t.kept("text_index", lambda: build_index(t("documents")))


def questions(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(t):
    return t.built("bm25", lambda: H.bm25_topk(questions(t), index(t), 50))


@query("build_postings", "SELECT doc_id, term, tf, CAST(dl AS INT) AS dl FROM x_post")
def _(t):
    return H.build_postings(t("documents"))


@query("term_weights", "SELECT term, df, round(idf, 6) AS idf FROM x_tw")
def _(t):
    return r6(H.term_weights(H.build_postings(t("documents")), t("documents").select(F.count("*")).scalar()), "idf")


@query("text_index", f"""SELECT term, df, round(top, 6) AS top FROM (SELECT term, max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len({TOK})) FROM documents)))) AS top FROM x_post GROUP BY term) p
JOIN (SELECT term AS w, df FROM x_tw) q ON w = term""")
def _(t):
    """Per term its documents and the greatest impact over all blocks."""
    return r6(index(t).bounds.groupBy("term").agg(F.max("top").alias("top")).join(index(t).terms.select("term", "df"), "term"), "top")


@query("bm25_topk", "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM x_bmk")
def _(t):
    return r6(H.bm25_topk(questions(t), index(t), 50), "score")


@query("scoped_topk", f"""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT b.query_id || '/' || d.lang AS query_id, b.doc_id, b.score,
row_number() OVER (PARTITION BY b.query_id, d.lang ORDER BY b.score DESC, b.doc_id) AS rank FROM x_bm b JOIN documents d ON d.doc_id = b.doc_id WHERE b.score > 0) u WHERE rank <= 10""")
def _(t):
    langs = t("documents").select(F.col("lang").alias("scope_id"), "doc_id")
    each = t("documents").select(F.collect_set("lang")).scalar()
    asked = questions(t).select("query_id", "text", F.explode(each).alias("scope_id")).withColumn("query_id", F.concat_ws("/", "query_id", "scope_id"))
    return r6(H.scoped_topk(asked, index(t), langs, 10), "score")


# --- vectors -----------------------------------------------------------------------------------------------------------------
view("x_dense", """SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v) u) w WHERE rank <= 10""")


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def as_queries(t):
    return t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def dense(t):
    return t.built("dense", lambda: H.dense_topk(as_queries(t), vectors(t), 10))


@query("dense_topk", "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM x_dense")
def _(t):
    return r6(H.dense_topk(as_queries(t), vectors(t), 10), "score")


view("x_mean", """SELECT list(x / (SELECT sqrt(sum(x * x)) FROM x_mean0) ORDER BY i) AS m FROM x_mean0""")
view("x_mean0", "SELECT i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) u GROUP BY i")
view("x_csim", "SELECT vec_id AS query_id, list_dot_product(embedding::DOUBLE[], (SELECT m FROM x_mean)) AS similarity FROM embeddings")


@query("centroid_similarity", "SELECT query_id, round(similarity, 6) AS similarity FROM x_csim")
def _(t):
    return r6(H.centroid_similarity(as_queries(t), vectors(t)), "similarity")


view("x_lcent0", "SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) u GROUP BY label, i")
view("x_lcent", "SELECT c.label, list(x / n ORDER BY i) AS vec FROM x_lcent0 c JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM x_lcent0 GROUP BY label) m ON m.label = c.label GROUP BY c.label")
LEXICON = ["onesen", "erblest", "inenan", "schicht", "tionement"]
LEX_RX = "\\b(?:" + "|".join(sorted(LEXICON, key=lambda w: (-len(w), w))) + ")"


def seeds(t):
    return H.centroid(t("embeddings").select("label", F.col("embedding").alias("vec")), "label").withColumnRenamed("label", "doc_id")


@query("topic_gate", f"""WITH s AS (SELECT vec_id, max(round(list_dot_product(embedding::DOUBLE[], vec), 9)) AS seed FROM embeddings, x_lcent GROUP BY vec_id),
g AS (SELECT d.doc_id AS query_id, seed, round(similarity, 9) AS sim, CASE WHEN length(trim(text)) < 3 THEN 'empty' WHEN regexp_matches(text, '{LEX_RX}', 'i') THEN 'lexicon'
  WHEN seed < 0.35 AND round(similarity, 9) < 0.1 THEN 'off_topic' ELSE 'plausible' END AS reason FROM documents d JOIN s ON s.vec_id = d.doc_id JOIN x_csim c ON c.query_id = d.doc_id)
SELECT query_id, reason, round(seed, 6) AS seed_similarity, round(sim, 6) AS centroid_similarity, reason IN ('lexicon', 'plausible') AS allowed FROM g""")
def _(t):
    asked = t("documents").select(F.col("doc_id").alias("query_id"), "text").join(as_queries(t), "query_id")
    return r6(H.topic_gate(asked, LEXICON, seeds(t), vectors(t), 0.35, 0.1), "seed_similarity", "centroid_similarity")


# --- fusion, reranking, gates: queries are documents that have a vector ----------------------------------------------------------
view("x_rank2", "SELECT query_id, doc_id, rank FROM x_dense UNION ALL SELECT query_id, doc_id, rank FROM x_bmk WHERE query_id IN (SELECT query_id FROM x_dense)")
view("x_rrf", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS fused FROM x_rank2 GROUP BY query_id, doc_id) u) v WHERE rank <= 15")


def fused(t):
    lists = union_all([dense(t).select("query_id", "doc_id", "rank"),
                       bm25(t).join(dense(t).select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id", "rank")])
    return H.rrf_fuse(lists)


@query("rrf_fuse", "SELECT query_id, doc_id, CAST(round(fused, 9) AS DOUBLE) AS fused, rank FROM x_rrf")
def _(t):
    return fused(t).withColumn("fused", F.round("fused", 9))


view("x_final", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS rank FROM (SELECT f.query_id, f.doc_id, coalesce(CAST(l.quality AS DOUBLE), d.score, 0.0) AS final
FROM x_rrf f LEFT JOIN labels l ON l.doc_id = f.doc_id LEFT JOIN x_dense d ON d.query_id = f.query_id AND d.doc_id = f.doc_id) u) v WHERE rank <= 5""")


def final(t):
    scored = fused(t).join(t("labels").select("doc_id", F.col("quality").cast("double").alias("given")), "doc_id", "left").join(
        dense(t).select("query_id", "doc_id", F.col("score").alias("dense")), ["query_id", "doc_id"], "left")
    return H.rerank(scored, "given", "dense", 5)


@query("rerank", "SELECT query_id, doc_id, round(final, 6) AS final, rank FROM x_final")
def _(t):
    return r6(final(t).select("query_id", "doc_id", "final", "rank"), "final")


@query("grounding_gate", """SELECT query_id, doc_id, round(final, 6) AS score FROM (SELECT *, max(final) OVER (PARTITION BY query_id) AS best, count(*) FILTER (WHERE final >= 0.6) OVER (PARTITION BY query_id) AS n FROM x_final) u
WHERE n >= 1 AND final >= least(0.6, best - 0.3)""")
def _(t):
    hits = final(t).select("query_id", "doc_id", F.col("final").alias("score"))
    return r6(H.grounding_gate(hits, 0.6, 0.3), "score")


@query("expand_query", f"""SELECT a.conv_id, a.turn, md5(CASE WHEN len(list_filter({QTOK.format('r.text')}, lambda w: NOT list_contains({QTOK.format('a.text')}, w))) > 0 THEN a.text || ' (' || r.text || ')' ELSE a.text END) AS expanded
FROM conversations a JOIN conversations r ON a.conv_id = r.conv_id AND r.turn = 0""")
def _(t):
    first = t("conversations").where("turn = 0").select("conv_id", F.col("text").alias("label"))
    asked = t("conversations").select("conv_id", "turn", "text").join(first, "conv_id")
    return H.expand_query(asked).select("conv_id", "turn", F.md5("expanded").alias("expanded"))


# --- scope by entity -----------------------------------------------------------------------------------------------------------
view("v_few_mentions", """SELECT DISTINCT 'PMID:' || l_orderkey AS doc_id, 'S:' || l_suppkey AS entity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'""")
view("v_sdoc", "SELECT 'PMID:' || l_orderkey AS doc_id, 'Note on ' || min(s_name) AS title, 'Body naming ' || max(s_name) || ' again' AS text FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey")
view("v_sname", "SELECT 'S:' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'body naming supplier 00000' FROM supplier WHERE s_acctbal < -900")
view("v_sheading", "SELECT 'PMID:' || l_orderkey AS doc_id, 'Index of ' || n_name || CASE WHEN l_linenumber > 2 THEN 'n' ELSE ' trade' END AS term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linestatus = 'O'")
view("x_sg", "SELECT DISTINCT c.ancestor AS id, m.doc_id FROM x_clo c JOIN v_few_mentions m ON m.entity = c.id WHERE dist <= 4")
view("x_sfew", "SELECT e.id FROM v_entity e LEFT JOIN x_sg g ON g.id = e.id GROUP BY e.id HAVING count(g.doc_id) < 3")
view("x_sterm", f"SELECT DISTINCT id, {norm_sql('name')} AS phrase FROM v_sname WHERE id IN (SELECT id FROM x_sfew) AND length(name) >= 6")


def like(field: str) -> str:
    return f"(' ' || {norm_sql(field)}) LIKE ('% ' || phrase || '%')"


view("x_stitle", f"""SELECT DISTINCT id, doc_id FROM x_sterm JOIN v_sdoc ON {like('title')}
UNION SELECT id, doc_id FROM (SELECT DISTINCT id, term FROM x_sterm JOIN (SELECT DISTINCT term FROM v_sheading) h ON {like('term')}) m JOIN v_sheading USING (term)""")
view("x_sshort", "SELECT f.id FROM x_sfew f LEFT JOIN x_stitle g ON g.id = f.id GROUP BY f.id HAVING count(g.doc_id) < 3")
view("x_stext", f"SELECT DISTINCT id, doc_id FROM (SELECT * FROM x_sterm WHERE id IN (SELECT id FROM x_sshort)) s JOIN v_sdoc ON {like('text')}")
view("x_srows", "SELECT id, doc_id, min(how) AS how FROM (SELECT id, doc_id, 0 AS how FROM x_sg UNION ALL SELECT id, doc_id, 1 FROM x_stitle UNION ALL SELECT id, doc_id, 2 FROM x_stext) u GROUP BY id, doc_id")
view("x_sfacts", """SELECT e.id, CASE WHEN count(doc_id) < 3 THEN 'all' WHEN max(how) = 0 THEN 'graph mentions' WHEN max(how) = 1 THEN 'keyword (title/terms)' ELSE 'keyword (title/terms/text)' END AS method, count(doc_id) AS n_docs
FROM v_entity e LEFT JOIN x_srows r ON r.id = e.id GROUP BY e.id""")


def scope(t):
    return H.entity_scope(K.ids(t), B.family(t), t("v_few_mentions"), t("v_sdoc"), t("v_sname"), headings=t("v_sheading"))


@query("entity_scope", "SELECT id, method, n_docs FROM x_sfacts")
def _(t):
    return scope(t)[1]


@query("entity_scope_documents", "SELECT id, doc_id FROM x_srows WHERE id IN (SELECT id FROM x_sfacts WHERE method <> 'all')")
def _(t):
    return scope(t)[0]


# --- evaluation ------------------------------------------------------------------------------------------------------------------
view("x_rel", "SELECT q.vec_id AS query_id, v.vec_id AS doc_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id")
view("x_cls", "SELECT vec_id AS query_id, CASE WHEN label < 5 THEN 'precise' ELSE 'broad' END AS class FROM embeddings")
MEASURES = "count(*) AS n, round(avg(CASE WHEN top > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(coalesce(top, 0) / 5), 6) AS precision_at_k, round(avg(coalesce(1.0 / f, 0.0)), 6) AS mrr"


@query("retrieval_metrics", f"""WITH m AS (SELECT q.query_id, c.class, f, top FROM (SELECT DISTINCT query_id FROM x_rel) q JOIN x_cls c ON c.query_id = q.query_id LEFT JOIN (
  SELECT d.query_id, min(rank) AS f, count(*) FILTER (WHERE rank <= 5) AS top FROM x_dense d JOIN x_rel r ON r.query_id = d.query_id AND r.doc_id = d.doc_id GROUP BY d.query_id) h ON h.query_id = q.query_id)
SELECT class, {MEASURES} FROM m GROUP BY class UNION ALL SELECT 'all', {MEASURES} FROM m""")
def _(t):
    # relevance: same label; spelled out only for retrieved pairs and for queries that have a relevant document at all
    label = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = dense(t).join(label, "doc_id").join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    found = hits.where("label = ql and query_id <> doc_id").select("query_id", "doc_id")
    many = label.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    has_any = label.join(many, "label").select(F.col("doc_id").alias("query_id"), F.lit(None).cast("long").alias("doc_id"))
    cls = t("embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 5, "precise").otherwise("broad").alias("class"))
    return r6(H.retrieval_metrics(dense(t), found.unionByName(has_any), cls), "hit_at_k", "precision_at_k", "mrr")


view("x_cal", "SELECT quality = 1 AS positive, CAST(n_chars AS DOUBLE) / 1000 AS score FROM labels JOIN documents ON documents.doc_id = labels.doc_id")
view("x_at", "SELECT score AS at_score FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn FROM x_cal WHERE positive) u WHERE rn = 1 + CAST(floor((SELECT count(*) FROM x_cal WHERE positive) * (1 - 0.9) + 1e-9) AS BIGINT)")


@query("calibrate_floor", """SELECT round(at_score, 6) AS floor_at, round(least((at_score + coalesce((SELECT max(score) FROM x_cal WHERE score < at_score), at_score - 1.0)) / 2, at_score - 0.05), 6) AS floor FROM x_at""")
def _(t):
    scores = t("labels").join(t("documents"), "doc_id").select((F.col("quality") == 1).alias("positive"), (F.col("n_chars").cast("double") / 1000).alias("score"))
    return r6(H.calibrate_floor(scores, 0.9, 0.05), "floor", "floor_at")


@query("refusal_accuracy", """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'answerable' WHEN toxic = 1 THEN 'off_topic' ELSE 'unanswerable' END AS kind, lang <> 'de' AS ok, CAST(n_chars AS DOUBLE) / 1000 AS s
  FROM labels JOIN documents ON documents.doc_id = labels.doc_id)
SELECT count(*) AS n, round(avg(CASE WHEN CASE WHEN kind = 'answerable' THEN ok AND s >= 0.8 ELSE NOT (ok AND s >= 0.8) END THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE kind = 'off_topic' AND NOT ok) AS off_topic_refused,
  count(*) FILTER (WHERE kind = 'off_topic') AS off_topic, round(min(s) FILTER (WHERE kind <> 'off_topic'), 6) AS in_domain_min, round(max(s) FILTER (WHERE kind = 'off_topic'), 6) AS off_topic_max FROM r""")
def _(t):
    rows = t("labels").join(t("documents"), "doc_id").select(
        F.when(F.col("quality") == 1, "answerable").when(F.col("toxic") == 1, "off_topic").otherwise("unanswerable").alias("kind"),
        (F.col("lang") != "de").alias("topic_allowed"), (F.col("n_chars").cast("double") / 1000).alias("top_score"))
    return r6(H.refusal_accuracy(rows, 0.8), "accuracy", "in_domain_min", "off_topic_max")


view("v_pattern", """SELECT 'q-' || c_mktsegment AS query_id, c_mktsegment AS pattern FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'q-' || c_mktsegment, CASE WHEN c_mktsegment < 'F' THEN 'gene (therapy|transfer)' ELSE 'without (clinical )?benefit' END FROM customer GROUP BY c_mktsegment""")


@query("label_by_title", """SELECT p.query_id, v_paper.id AS doc_id FROM v_paper JOIN v_pattern p ON regexp_matches(title, pattern, 'i') GROUP BY p.query_id, v_paper.id
HAVING count(*) = (SELECT count(*) FROM v_pattern z WHERE z.query_id = p.query_id)""")
def _(t):
    return H.label_by_title(t("v_pattern"), t("v_paper").select(F.col("id").alias("doc_id"), "title"))
