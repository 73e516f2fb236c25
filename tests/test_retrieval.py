import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import answers as A
from lodestone.operators import dictionary as D
from lodestone.operators import matching as M
from lodestone.operators import retrieval as H
from lodestone.operators import textindex as T

DOCS = [(1, "common word alpha alpha"), (2, "common beta"), (3, "common gamma word"), (4, "nothing here"), (5, "")]


def okapi(query, docs):
    toks = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log((n - c + .5) / (c + .5)) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else .25 * mean for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        f = Counter(t)
        s = sum(idf.get(q, 0) * f[q] * 2.5 / (f[q] + 1.5 * (.25 + .75 * len(t) / avg)) for q in re.findall("[a-z0-9]+", query.lower()))
        if s > 0:
            out[d] = round(s, 6)
    return out


def test_bm25_repeated_terms_and_negative_idf(frame):
    docs = frame(DOCS, "doc_id long, text string")
    queries = frame([("q1", "common alpha alpha"), ("q2", "unknown"), ("q3", None)], "query_id string, text string")
    got = H.bm25_topk(queries, T.build_index(docs), 10).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == okapi("common alpha alpha", DOCS)
    assert {r.query_id for r in got} == {"q1"}


def test_scope_comes_before_the_cut(frame):
    docs = frame(DOCS, "doc_id long, text string")
    asked = frame([("q", "s", "common")], "query_id string, scope_id string, text string")
    scope = frame([("s", 3)], "scope_id string, doc_id long")
    assert [r.doc_id for r in H.scoped_topk(asked, T.build_index(docs), scope, 1).collect()] == [3]


def topics(n=1200, seed=4):
    """Texts on twelve topics, with words that all share, and empty, missing and equal ones."""
    rng = random.Random(seed)
    out = [(0, None), (1, ""), (2, "?!")]
    for i in range(3, n):
        topic = rng.randrange(12)
        words = [f"t{topic}w{int(rng.random() ** 2 * 40)}" if rng.random() < 0.7 else f"all{int(rng.random() ** 2 * 30)}" for _ in range(rng.randrange(3, 60))]
        out.append((i, " ".join(words)))
    return out + [(n + i, out[50][1].upper()) for i in range(5)]


@pytest.mark.parametrize("block", [8, 64, 5000])
def test_blocks_lose_no_document(frame, block):
    rows = topics()
    docs = frame(rows, "doc_id long, text string")
    asked = [(f"q{i}", rows[40 + 25 * i][1]) for i in range(12)] + [("few", "t3w39 t5w38"), ("none", "zzz"), ("all", "all0 all1 all0")]
    counts = {}
    index = T.build_index(docs, block)
    got = {}
    for r in H.bm25_topk(frame(asked, "query_id string, text string"), index, 10, counts).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 4)))
    for q, text in asked:
        best = sorted(okapi(text, [(i, t or "") for i, t in rows]).items(), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(got.get(q, [])) == [(n, d, round(s, 4)) for n, (d, s) in enumerate(best, 1)]
    assert counts["read"] <= counts["blocks"]
    if block == 8:
        assert counts["read"] < 0.6 * counts["blocks"]
    odd = frame([("odd", i) for i in range(1, 1200, 2)] + [("tiny", 45)], "scope_id string, doc_id long")
    scoped = [(f"{q}/{s}", s, t) for q, t in asked[:4] for s in ("odd", "tiny", "missing")]
    got = {}
    for r in H.scoped_topk(frame(scoped, "query_id string, scope_id string, text string"), index, odd, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for q, s, text in scoped:
        inside = {"odd": lambda d: d % 2 == 1 and d < 1200, "tiny": lambda d: d == 45, "missing": lambda d: False}[s]
        best = sorted(((d, v) for d, v in okapi(text, [(i, t or "") for i, t in rows]).items() if inside(d)), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(q, [])) == [(n, d) for n, (d, _) in enumerate(best, 1)]


def test_index_of_nothing(frame):
    none = frame([], "doc_id long, text string")
    assert H.bm25_topk(frame([("q", "word")], "query_id string, text string"), T.build_index(none), 3).count() == 0


def test_dense_blocks_equal_one_product(frame):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(37, 5)).round(2)
    v[3], v[7] = v[5], 0.0
    vec = frame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "doc_id long, vec array<float>")
    q = vec.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in H.dense_topk(q, vec, 4, block=8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    f = v.astype("float32").astype("float64")
    m = np.round(f[:9] @ f.T, 9)
    assert got == {i: sorted(range(37), key=lambda j: (-m[i, j], j))[:4] for i in range(9)}


@pytest.mark.parametrize("spread,share", [(0.05, 0.5), (5.0, 1.0)])
def test_blocks_around_pivots_equal_one_product(frame, spread, share):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 6))
    v = np.concatenate([m + spread * rng.normal(size=(40, 6)) for m in middles] + [np.tile(middles[3], (60, 1)), np.zeros((2, 6))]).round(3)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(9999, None)]
    vec = frame(rows, "doc_id long, vec array<double>")
    q = vec.where("doc_id % 7 = 0 OR doc_id >= 860").withColumnRenamed("doc_id", "query_id")
    counts = {}
    got = {}
    for r in H.dense_topk(q, vec, 5, block=16, counts=counts).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    m = np.round(v @ v.T, 9)
    assert {i: sorted(x) for i, x in got.items()} == {i: list(enumerate(sorted(range(len(v)), key=lambda j: (-m[i, j], j))[:5], 1)) for i in got}
    assert set(got) == {i for i in range(len(v)) if i % 7 == 0 or i >= 860}
    assert counts["read"] <= share * counts["blocks"]
    none = vec.limit(0)
    assert H.dense_topk(q, none, 5).count() == 0 and H.dense_topk(none.withColumnRenamed("doc_id", "query_id"), vec, 5).count() == 0


def test_fusion_and_gates(frame, rows):
    lists = frame([("q", "d1", 1), ("q", "d2", 2), ("q", "d2", 1), ("q", "d3", 2)], "query_id string, doc_id string, rank int")
    assert [r.doc_id for r in H.rrf_fuse(lists).orderBy("rank").collect()] == ["d2", "d1", "d3"]
    hits = frame([("a", 1, 2.0), ("a", 2, 0.5), ("a", 3, -2.0), ("b", 1, 0.2)], "query_id string, doc_id int, score double")
    assert rows(H.grounding_gate(hits, 1.0, 1.8), "query_id", "doc_id") == [("a", 1), ("a", 2)]


def test_calibration(frame):
    def plain(pos, neg, rate, margin):
        s = sorted(pos)
        drop = int(len(s) * (1 - rate) + 1e-9)
        at = s[drop]
        below = s[:drop] + [x for x in neg if x < at]
        below = [x for x in below if x < at]
        low = max(below) if below else at - 1
        return round(min((at + low) / 2, at - margin), 6)

    # scores within one integer are spread over ranges too
    rng = random.Random(3)
    near = sorted(round(rng.random(), 4) for _ in range(3000))
    small = frame([(i % 3 > 0, x) for i, x in enumerate(near)], "positive boolean, score double")
    parts = [x for i, x in enumerate(near) if i % 3], [x for i, x in enumerate(near) if i % 3 == 0]
    for rate in (1.0, 0.9, 0.333):
        assert round(H.calibrate_floor(small, rate, 0.01, 16).first().floor, 6) == plain(*parts, rate, 0.01)
    pos, neg = [3.0, 1.0, 2.0, 2.0, 5.5], [0.5, 1.5, 9.0]
    df = frame([(True, p) for p in pos] + [(False, n) for n in neg], "positive boolean, score double")
    for rate, margin in ((1.0, 0.1), (0.8, 0.1), (0.6, 0.5)):
        assert round(H.calibrate_floor(df, rate, margin).first().floor, 6) == plain(pos, neg, rate, margin)


def test_title_patterns(frame, rows):
    q = frame([("q1", "krabbe"), ("q1", "transplant"), ("q2", "krabbe")], "query_id string, pattern string")
    d = frame([(1, "Transplantation in Krabbe disease"), (2, "Krabbe")], "doc_id int, title string")
    assert rows(H.label_by_title(q, d)) == [("q1", 1), ("q2", 1), ("q2", 2)]


def test_scope_falls_back_step_by_step(frame, rows):
    ids = frame([("a",), ("b",), ("c",), ("d",)], "id string")
    fam = frame([(x, x, 0) for x in "abcd"], "id string, member string, dist int")
    men = frame([(i, "a") for i in range(3)] + [(9, "b")], "doc_id int, entity string")
    docs = frame([(i, t, x) for i, (t, x) in enumerate([("", "")] * 4 + [("Betatitis study", ""), ("On betatitises", ""), ("", "gammatosis"), ("", "gammatosis"), ("", "a gammatosis"), ("", "")])], "doc_id int, title string, text string")
    names = frame([("b", "Betatitis"), ("c", "Gammatosis (disease)"), ("d", "Nowhere")], "id string, name string")
    assert rows(H.entity_scope(ids, fam, men, docs, names)[1]) == [("a", "graph mentions", 3), ("b", "keyword (title/terms)", 3), ("c", "keyword (title/terms/text)", 3), ("d", "all", 0)]
    heads = frame([(9, "Gammatosis, other"), (0, "gammatoses")], "doc_id int, term string")
    assert rows(H.entity_scope(ids, fam, men, docs, names, headings=heads)[0], "id", "doc_id")[-4:] == [("c", 6), ("c", 7), ("c", 8), ("c", 9)]


def test_phrases_inside_longer_ones_do_not_count(frame, rows):
    dic = frame([("Krabbe disease", "k", True), ("disease variant", "v", True), ("infantile Krabbe disease", "i", True), ("shared name", "z1", False),
                 ("shared name", "z2", False), ("shared name", "z3", False), ("shared name", "z4", False), ("short", "s", True)], "text string, entity string, is_label boolean")
    docs = frame([(1, "Infantile Krabbe disease, shared name"), (2, "krabbe disease variant short"), (3, "")], "doc_id int, text string")
    got = rows(M.match_phrases(docs, M.phrase_dictionary(dic)), "doc_id", "entity")
    assert got == [(1, "i"), (1, "z1"), (1, "z2"), (1, "z3"), (1, "z4"), (2, "k"), (2, "v")]
    got = rows(M.match_phrases(docs, M.phrase_dictionary(dic, max_targets=3)), "doc_id", "entity")
    assert got == [(1, "i"), (1, "z1"), (1, "z2"), (1, "z3"), (2, "k"), (2, "v")]


def test_glossary_equals_a_left_to_right_scan(frame, rows):
    terms = [("gene therapy", "GT"), ("gene", "G"), ("therapy trial", "TT"), ("x-linked", "X")]
    text = "Gene therapy trial of a gene; x-linked genes, THERAPY TRIAL gene-based gene"
    rx = re.compile(r"(?<![\w-])(" + "|".join(re.escape(t) for t, _ in sorted(terms, key=lambda x: -len(x[0]))) + r")(?![\w-])", re.I)
    want = sorted((m.start(), m.end(), m.group(0)) for m in rx.finditer(text))
    df = frame([(1, text)], "doc_id int, text string")
    assert rows(M.glossary_spans(df, frame(terms, "term string, canonical string")), "start", "stop", "match") == want


def test_answer_verdicts(frame):
    cases = {"": "empty", "See ANSWER_NOT_AVAILABLE [1].": "sentinel", "It works well here.": "no_citation", "It works well [4].": "out_of_range",
             "It works well [1]. This is quite new. That is also new.": "too_many_uncited", "It works well [1]. It is not known why. Next comes one.": "ok"}
    df = frame([(str(i), t, 3) for i, t in enumerate(cases)], "answer_id string, text string, n_sources int")
    got = {r.answer_id: r for r in A.verify_answers(df).collect()}
    assert [got[str(i)].verdict for i in range(len(cases))] == list(cases.values())
    assert got["5"].clean == "It works well [1]. It is not known why."


def test_rewrites(frame):
    src = "Orphanet lists the gene GALC for this condition"
    df = frame([("ok", src, "Orphanet lists the gene GALC for that condition"), ("neg", src, "Orphanet lists no gene GALC for this condition"),
                ("new", src, "Orphanet lists the gene GALC for this condition in Norway")], "pair_id string, src string, out string")
    got = {r.pair_id: r.reasons for r in A.audit_rewrites(df).collect()}
    assert got == {"ok": "", "neg": "negation", "new": "new_terms"}


@pytest.mark.parametrize("prefix", [False, True])
def test_names_in_texts(frame, prefix):
    rng = random.Random(2)
    words = ["alpha", "alphabet", "alphabets", "be", "beta", "betamax", "c", "gamma", "gammas", "delta", "d"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(150)} | {"alpha be", "be be be", "gammas"}
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(80)] + [(80, None), (81, " ".join(words) * 300)]

    def holds(text, name):
        if prefix:
            return len(name) >= 6 and f" {name}" in f" {text}"
        return f" {name} " in f" {text} "

    want = {(i, n) for i, t in texts for n in names if t and holds(t, n)}
    for per_part, per_task in ((7, 10), (10_000, 10_000)):
        got = D.find_names(frame(texts, "doc_id long, norm string"), frame([(n,) for n in names] + [(None,), ("",), ("alpha be",)], "phrase string"), prefix=prefix, per_part=per_part, per_task=per_task)
        assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    none = D.find_names(frame([], "doc_id long, norm string"), frame([("alpha beta",)], "phrase string"), prefix=prefix)
    assert none.count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_queries_travel_once_a_chunk_of_blocks(spark, frame):
    from pyspark.sql import functions as F

    from lodestone.operators import vectors as V

    rng = np.random.default_rng(3)
    vec = frame([(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(600, 8)))], "doc_id long, vec array<double>")
    index = V.build_vectors(vec, block=4)
    asked = vec.where("doc_id < 50").select(F.col("doc_id").alias("query_id"), "vec", F.lit(0).alias("part"), F.lit(float("-inf")).alias("floor"),
                                            F.array().cast("array<bigint>").alias("done"))
    sent = V._reached(asked, index, 1).collect()
    assert index.blocks > 100 and sum(r.n or 0 for r in sent) == 50 * index.blocks
    assert len(sent) <= 50 * max(V.LEAST, -(-index.blocks // V.CHUNK)) + index.blocks


def test_chunks_hand_on_the_best_of_a_query_only(frame):
    rng = np.random.default_rng(4)
    docs = frame([(i, " ".join(f"w{w}" for w in rng.integers(0, 12, 9))) for i in range(400)], "doc_id long, text string")
    index = T.build_index(docs, block=8)
    asked = frame([("q", "w1", 1.0), ("q", "w2", 0.5), ("r", "w3", 1.0), ("r", "w3x", 1.0)], "query_id string, term string, weight double")
    wanted = index.placed.select("block").distinct().crossJoin(asked.select("query_id").distinct()).select("query_id", "block")
    got = T._scored(wanted, asked, index, 3).collect()
    chunks = max(T.LEAST, -(-index.placed.select("block").distinct().count() // T.CHUNK))
    assert 6 <= len(got) <= 2 * 3 * chunks
    want = {}
    for r in asked.join(index.lists, "term").collect():
        want[r.query_id, r.doc_id] = want.get((r.query_id, r.doc_id), 0.0) + r.weight * r.impact
    for query in "qr":
        best = sorted(((-round(s, 9), d) for (q, d), s in want.items() if q == query))[:3]
        assert sorted((-r.score, r.doc_id) for r in got if r.query_id == query)[:3] == best
