"""Pairs of entities against plain loops over their facts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence as E
from lodestone.operators import meeting as M
from lodestone.plans import pairs as P


def key(row):
    return tuple((x is None, x) for x in row)


def read(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


@pytest.mark.parametrize("repeated", [False, True])
def test_probe_equals_loops(frame, monkeypatch, repeated):
    for name, size in (("PART", 60), ("LEAST", 20), ("CHUNK", 7)):
        monkeypatch.setattr(M, name, size)
    r = random.Random(3)
    left = [(f"e{r.randrange(8)}", f"k{r.randrange(20):02d}", r.random(), f"g{r.randrange(3)}") for _ in range(90)]
    right = [(f"e{r.randrange(8)}", f"k{r.randrange(20):02d}", f"g{r.randrange(3)}") for _ in range(70)]
    if not repeated:
        left, right = list({x[:2]: x for x in left}.values()), list({x[:2]: x for x in right}.values())
    left, right = left + [(None, "k1", 1.0, "g1"), ("e1", None, 1.0, "g2")], right + [(None, "k1", "g1"), ("e1", None, "g2")]
    ends = [(f"e{a}", f"e{b}") for a in range(9) for b in range(9) if r.random() < 0.5]
    x, y = frame(left, "id string, k string, w double, g string"), frame(right, "id string, k string, g string")
    pairs = frame(ends * 2, "a string, b string")
    both = [(a, b, p[1], p[2], p[3], q[2]) for a, b in ends for p in left for q in right if p[0] == a and q[0] == b and p[1] == q[1] and p[1]]
    assert read(M.probe(pairs, x, y, "k"), "a", "b", "k", "w_a", "g_a", "g_b") == sorted(both, key=key) and both
    assert read(M.probe(pairs, x, y, "k", unlike="g"), "a", "b", "k", "w_a", "g_a", "g_b") == sorted((p for p in both if p[4] != p[5]), key=key)
    apart = [(a, b, p[1], p[2]) for a, b in ends for p in left if p[0] == a and not any(q[:2] == (b, p[1]) and p[1] for q in right)]
    assert read(M.probe(pairs, x, y, "k", without=True), "a", "b", "k", "w_a") == sorted(apart, key=key) and apart
    best, n = defaultdict(list), defaultdict(int)
    for row in M.probe(pairs, x, y, "k", keep=2, weight="w").collect():
        best[row.a, row.b].append((-row.w_a, row.k))
        n[row.a, row.b] += row.found
    for pair in {p[:2] for p in both}:
        want = sorted((-p[3], p[2]) for p in both if p[:2] == pair)
        assert sorted(best[pair])[:2] == want[:2] and n[pair] == len(want)
    assert sum(n.values()) == len(both)
    first = defaultdict(list)
    for row in M.first_apart(pairs, x.where("k is not null"), y, "k", ["k", "w"], 3, head=1).collect():
        first[row.a, row.b].append((row.pos, row.k, row.w_a))
    for pair in ends:
        want = sorted(p[2:] for p in apart if p[:2] == pair and p[2])[:3]
        assert sorted(first[pair]) == [(i + 1, *w) for i, w in enumerate(want)]


def test_probe_without_facts(frame):
    pairs, facts = frame([("x", "y")], "a string, b string"), frame([("x", "k")], "id string, k string")
    none = facts.where("false")
    assert M.probe(pairs, none, facts, "k").count() == 0 and M.probe(pairs, facts, none, "k").count() == 0 and M.counts(pairs, none, "k").count() == 0
    assert read(M.probe(pairs, facts, none, "k", without=True), "a", "b", "k") == [("x", "y", "k")]


def test_a_hub_is_not_expanded_for_its_pairs(frame, spark):
    """Before, each pair of the hub with a small entity became as many rows as the hub has facts."""
    facts = spark.range(20_000).select(F.lit("hub").alias("id"), F.concat(F.lit("k"), "id").alias("gene")).unionByName(
        spark.range(50).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("k"), "id").alias("gene")))
    pairs = spark.range(50).select(F.lit("hub").alias("a"), F.concat(F.lit("e"), "id").alias("b"))
    met = P.meet(pairs, facts, "gene")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 50 and "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_route_heads_stand_for_all_routes(frame, monkeypatch):
    monkeypatch.setattr(M, "LEAST", 10)
    pairs = frame([("x", "y"), ("x", "z")], "a string, b string")
    genes = frame([(e, f"g{i:02d}", e, 0.5 + i % 5 / 10) for e in "xy" for i in range(20)] + [("z", "g03", "z", 0.9)], "id string, gene string, via string, confidence double")
    reached = frame([("x", f"p{i}", "g00", "x") for i in range(12)] + [("y", f"p{i}", "g01" if i else "g00", "y") for i in range(12)], "id string, pathway string, gene string, via string")
    sizes = frame([(f"p{i}", 20 * i + 1) for i in range(12)], "id string, n_genes long")
    few = P.routes_shared_gene(pairs, genes.where("false"))
    heads = P.route_heads(pairs, genes, reached, sizes, few, 3)
    every = P.routes_shared_gene(pairs, genes).unionByName(P.routes_shared_pathway(pairs, reached, sizes))
    assert heads.count() == 3 + 3 + 1 and every.count() == 20 + 11 + 1
    assert read(P.decide_support(pairs, heads), "a", "b", "n_routes", "n_kinds", "primary_item") == read(P.decide_support(pairs, every), "a", "b", "n_routes", "n_kinds", "primary_item")
    assert read(P.top_n(heads, P.PAIR, P.route_order(), 3), *every.columns) == read(P.top_n(every, P.PAIR, P.route_order(), 3), *every.columns)


def test_ancestors_over_direct_terms_are_left_out(frame):
    pairs = frame([("x", "y")], "a string, b string")
    closure = frame([("l", "m", 1), ("l", "r", 2), ("m", "r", 1), ("n", "o", 1), ("q", "o", 1)] + [(t, t, 0) for t in "lmrnoq"], "id string, ancestor string, dist int")
    terms = frame([("x", "l", "x", 3.0), ("y", "l", "y", 3.0), ("x", "n", "x", 3.0), ("y", "q", "y", 3.0)], "id string, term string, via string, ic double")
    ic = {"l": 3.0, "m": 2.0, "r": 1.0, "n": 3.0, "q": 3.0, "o": 2.5}
    up = {"x": {"l": "l", "m": "l", "r": "l", "n": "n", "o": "n"}, "y": {"l": "l", "m": "l", "r": "l", "q": "q", "o": "q"}}
    propagated = frame([(e, t, ic[t], v, e) for e, ts in up.items() for t, v in ts.items()], "id string, term string, ic double, via_term string, via string")
    got = P.routes_shared_ancestor(pairs, terms, propagated, closure, 0.5).collect()
    assert [(r.item, r.left_item, r.right_item) for r in got] == [("o", "n", "q")]


def test_sources_join_only_edges_that_gain_by_them(frame):
    edges = frame([("e1", "g", "x", "causes", "HPO"), ("e2", "x", "t", "has_phenotype", "HPO"), ("e3", "s", "x", "studies", "ct"), ("e4", "x", "y", "similar_to", "s"), ("e5", "a", "b", None, "z"),
                   ("e6", "f", "x", "funds", "HPO + Orphanet"), ("e7", "g", "z", "causes", "HPO + Orphanet")], "edge_id string, src string, dst string, rel string, source string")
    similar = frame([("e4", 0.1, 0.0, 0.2)], "edge_id string, s_term double, s_path double, s_lit double")
    ends = frame([("g", "x"), ("x", "t")], "src string, dst string")
    out = E.independent_sources(edges, similar, ends, ends, frame([("s",)], "trial string"))
    assert dict(read(out, "edge_id", "n_sources")) == {"e1": 2, "e2": 2, "e3": 2, "e4": 2, "e5": 1, "e6": 1, "e7": 2}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_a_study_on_both_sides_counts_as_often_as_its_facts(frame):
    pairs, trials = frame([("x", "y")], "a string, b string"), frame([("x", "t"), ("y", "t"), ("x", "r"), ("x", "u"), ("y", "w")], "id string, trial string")
    facts = frame([("t", "trial", "COMPLETED", 1)] * 2 + [("r", "registry", "RECRUITING", 1), ("u", "trial", "RECRUITING", 1), ("w", "trial", "RECRUITING", 1)], "id string, kind string, status string, n_conditions int")
    got = P.shared_assets(pairs, trials, facts, frame([("u", "gene therapy"), ("w", "gene therapy")], "trial string, modality string"))
    assert read(got, "part", "pos", "trial", "side", "paired_with") == [(1, 1, "t", "both", None), (1, 2, "t", "both", None), (2, 1, "r", "a", None), (3, 1, "u", "a", "w")]
