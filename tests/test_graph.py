import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.operators import build as G
from lodestone.operators import communities as M
from lodestone.operators import evidence as E
from lodestone.operators import lookup as L
from lodestone.operators import people as P
from lodestone.sources import files as S
from lodestone.streaming import landing


def test_authors_identity_cascade(frame):
    schema = "pmid string, pos int, last string, fore string, initials string, affiliation string, orcid string, year int"
    rows = [("1", 1, "Kobayashi", "Takashi", "T", "Univ, Japan", "", 2000), ("2", 1, "Kobayashi", "Teruyuki K", "TK", "Univ, Japan", "", 2001),
            ("3", 1, "Kobayashi", "T", "T", "Univ, Japan", "", 2002), ("4", 1, "Nuñez", "Ana", "A", "X, Spain", "https://orcid.org/0-1", 2000),
            ("5", 1, "Núñez", "A", "A", "", "", 2001), ("6", 1, "Nunez", "Alberto", "A", "X, Spain", "", 2001), ("7", 1, "", "", "", "", "", 2001)]
    got = {r.pmid: (r.key, r.homonym_risk) for r in P.disambiguate_authors(frame(rows, schema)).collect()}
    assert got["1"] == ("AUTH:kobayashi|t|japan|takashi", False) and got["2"] == ("AUTH:kobayashi|t|japan|teruyuki", False)
    assert got["3"] == ("AUTH:kobayashi|t|japan|?", True)
    assert got["4"][0] == "AUTH:0-1" and got["5"][0] == "AUTH:0-1"  # no country, no forename: adopted
    assert got["6"][0] == "AUTH:nunez|a|spain" and "7" not in got


def test_dangling_edges_go_and_ids_are_stable(frame):
    edges = frame([("a", "b", "r", "s"), ("a", "zz", "r", "s")], "src string, dst string, rel string, source_id string")
    nodes = frame([("a",), ("b",)], "id string")
    first, again = (G.finalize_edges(edges, nodes).collect() for _ in range(2))
    assert [r.edge_id for r in first] == [r.edge_id for r in again] and len(first) == 1


def test_upsert_keeps_core_and_overrides_attributes(frame):
    parts = frame([(2, "n", "Y", "late", "", "x", "2"), (1, "n", "X", "first", "g", "x", "1"), (3, "n", "Z", "", "", "y", None)],
                  "step int, id string, type string, label string, grp string, attr string, value string")
    assert tuple(G.upsert_nodes(parts).first()) == ("n", "X", "first", "g", "x=2")


def ego_by_hand(seed, edges, kinds, scores, depth, limit):
    share, chosen, front = max(4, (limit - 1) // 4), [seed], [seed]
    for _ in range(depth):
        cand = {}
        for _, s, d, rel, c in edges:
            for n, o in ((s, d), (d, s)):
                if n in front and o not in chosen:
                    rank = -scores[o] if scores.get(o) is not None else -c
                    if rel == "subclass_of" and kinds[o] == "Phenotype":
                        rank += 100
                    cand[o] = min(cand.get(o, 1e9), rank)
        order = sorted(cand, key=lambda o: (L.TYPE_PRIORITY[kinds[o]], cand[o], o))
        nxt, per = [], {}
        for o in order:
            if len(chosen) < limit and per.get(kinds[o], 0) < share:
                per[kinds[o]] = per.get(kinds[o], 0) + 1
                chosen.append(o)
                nxt.append(o)
        for o in order:
            if len(chosen) < limit and o not in chosen:
                chosen.append(o)
                nxt.append(o)
        front = nxt
    return chosen


def test_ego_graph_equals_the_walk(frame):
    rng = random.Random(5)
    types = ["Disease", "Gene", "Phenotype", "Paper"]
    kinds = {f"n{i:02d}": types[i % 4] for i in range(40)}
    scores = {n: (round(rng.random() * 5, 1) if k in ("Phenotype", "Paper") else None) for n, k in kinds.items()}
    edges = [(f"e{i}", a, b, rng.choice(["causes", "subclass_of"]), round(rng.random(), 1)) for i in range(120)
             for a, b in [rng.sample(sorted(kinds), 2)]]
    e = frame(edges, "edge_id string, src string, dst string, rel string, confidence double")
    n = frame([(x, kinds[x], scores[x]) for x in kinds], "id string, type string, score double")
    seeds = ["n00", "n01", "n07"]
    nodes, inside = L.ego_graph(frame([(s,) for s in seeds], "id string"), e, n, depth=2, max_nodes=14)
    for s in seeds:
        got = [r.id for r in nodes.where(F.col("seed") == s).orderBy("pos").collect()]
        assert got == ego_by_hand(s, edges, kinds, scores, 2, 14)
        kept = set(got)
        assert {r.edge_id for r in inside.where(F.col("seed") == s).collect()} == {x[0] for x in edges if x[1] in kept and x[2] in kept}


def test_neighbours_reserve_places_for_other_groups(frame):
    edges = frame([("x", f"s{i}", 1 - i / 100) for i in range(6)] + [("x", "c1", 0.3), ("x", "c2", 0.2), ("x", "c3", 0.1), ("x", "kid", 0.9)], "a string, b string, score double")
    clo = frame([("kid", "x", 1)], "id string, ancestor string, dist int")
    groups = frame([("x", "g"), ("kid", "g")] + [(f"s{i}", "g") for i in range(6)] + [(f"c{i}", "h") for i in range(1, 4)], "id string, grp string")
    got = [r.other for r in L.neighbours(frame([("x",)], "id string"), edges, clo, groups, 5).orderBy("rank").collect()]
    assert got == ["s0", "s1", "s2", "c1", "c2"]


def test_stances(frame):
    edges = frame([("e1", "has_phenotype", "2009", 0.9, "curated"), ("e2", "has_phenotype", "2009", 0.9, "curated"), ("e3", "similar_to", "2009", 0.9, "inferred"),
                   ("e4", "funds", None, 0.0, "extracted"), ("e5", "funds", "1990", 0.9, "extracted")], "edge_id string, rel string, date string, confidence double, evidence_type string")
    flags = frame([("e2", "k", 0.6, ""), ("e5", "k", 0.3, ""), ("e5", "l", 0.25, "")], "edge_id string, kind string, weight double, ref_id string")
    src = frame([(f"e{i}", n) for i, n in ((1, 2), (2, 1), (3, 1), (4, 1), (5, 1))], "edge_id string, n_sources int")
    none = frame([], "edge_id string, n_papers long")
    got = {r.edge_id: (r.stance, round(r.overall, 4), r.n_contra) for r in E.assess_edges(edges, flags, src, none, 2010).collect()}
    assert got == {"e1": ("supported", 0.95, 0), "e2": ("mixed", 0.75, 1), "e3": ("weak", 0.9, 0), "e4": ("unsupported", 0.0, 0), "e5": ("weak", 0.7375, 0)}


def test_communities_beat_components_and_repeat(spark, frame):
    rng = random.Random(2)
    edges = []
    for base in ("a", "b", "c"):
        names = [f"{base}{i}" for i in range(7)]
        edges += [(x, y, 1.0) for i, x in enumerate(names) for y in names[i + 1:] if rng.random() < 0.8]
    edges += [("a0", "b0", 0.1), ("b1", "c1", 0.1)]
    e = frame(edges, "a string, b string, w double")
    nodes = frame([(f"{b}{i}",) for b in "abc" for i in range(7)] + [("alone",)], "id string")
    got = {r.id: r.cluster_id for r in M.communities(e, nodes).collect()}
    again = {r.id: r.cluster_id for r in M.communities(e.repartition(7), nodes.repartition(3)).collect()}
    assert got == again and got["alone"] == "" and len(got) == 22
    assert {frozenset(k for k, v in got.items() if v == c) for c in set(got.values()) - {""}} == {frozenset(f"{b}{i}" for i in range(7)) for b in "abc"}
    q = lambda m: M.modularity(e, frame(list(m.items()), "id string, community string")).first()[0]
    assert q({k: v for k, v in got.items() if v}) > q({k: "one" for k in got}) and q({k: v for k, v in got.items() if v}) > q({k: k for k in got})


def test_names_are_given_out_in_cluster_order(frame, rows):
    wish = {"C00": ["y", "x"], "C01": ["y", "x", "z"], "C02": ["x", "w"], "C100": ["w", "v"]}
    df = frame([(c, n, i) for c, ns in wish.items() for i, n in enumerate(ns)], "cluster_id string, name string, pos int")
    assert rows(M.assign_names(df)) == [("C00", "y"), ("C01", "x"), ("C02", "w"), ("C100", "v")]


def test_graph_document(spark, tmp_path, rows):
    doc = {"graphs": [{"nodes": [
        {"id": "http://x/HP_1", "lbl": "one", "type": "CLASS", "meta": {"synonyms": [{"pred": "hasExactSynonym", "val": "uno"}, {"pred": "hasRelatedSynonym", "val": "eins"}],
                                                                     "xrefs": [{"val": "MSH:D1"}], "basicPropertyValues": [{"pred": "o#hasAlternativeId", "val": "HP:9"}]}},
        {"id": "http://x/HP_2", "lbl": "two", "type": "CLASS", "meta": {"deprecated": True}}, {"id": "http://x/HP_3", "type": "CLASS"}, {"id": "http://x/ZZ_3", "type": "CLASS"}, {"id": "http://x/HP_4", "type": "PROPERTY"}],
        "edges": [{"sub": "http://x/HP_1", "pred": "is_a", "obj": "http://x/HP_3"}, {"sub": "http://x/HP_1", "pred": "part_of", "obj": "http://x/HP_4"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    terms, edges = S.read_obograph(spark, str(tmp_path / "g.json"), "http://x/HP_", classes_only=True)
    got = {r.id: r for r in terms.collect()}
    assert set(got) == {"HP:1", "HP:3"} and got["HP:1"].synonyms == ["eins", "uno"] and got["HP:1"].exact_synonyms == ["uno"]
    assert got["HP:1"].xrefs == ["MESH:D1"] and got["HP:1"].alt_ids == ["HP:9"] and got["HP:3"].label == "HP:3"
    assert rows(edges) == [("HP:1", "HP:3")]


def test_disorder_records(spark, tmp_path, rows):
    (tmp_path / "d.xml").write_text("""<J><DisorderList><Disorder><OrphaCode>58</OrphaCode><PrevalenceList><Prevalence><PrevalenceType><Name>Point prevalence</Name></PrevalenceType>
    <ValMoy>1.0</ValMoy></Prevalence><Prevalence><PrevalenceClass><Name>1-9</Name></PrevalenceClass></Prevalence></PrevalenceList><AverageAgeOfOnsetList><AverageAgeOfOnset><Name>Infancy</Name></AverageAgeOfOnset>
    </AverageAgeOfOnsetList></Disorder></DisorderList></J>""")
    assoc, prev, lists = S.read_disorder_xml(spark, str(tmp_path / "d.xml"))
    assert rows(assoc) == [] and rows(prev, "code", "pos", F.coalesce("class", F.lit("-"))) == [("ORPHA:58", 0, "-"), ("ORPHA:58", 1, "1-9")]
    assert rows(lists) == [("ORPHA:58", ["Infancy"], [])]


def test_landing_resumes_and_keeps_the_first_batch(spark, tmp_path, rows):
    spec, at = "k string, batch int, n int, v string", str(tmp_path)
    put = lambda name, data: spark.createDataFrame(data, spec).coalesce(1).write.json(f"{at}/in/{name}")
    run = lambda: landing.ingest_batches(spark, f"{at}/in/*", f"{at}/out", f"{at}/seen", spec, ["k"], "batch", "n")
    read = lambda: rows(landing.read_landed(spark, f"{at}/out", spec, ["k"], "batch", "n"), "k", "batch", "v")
    put("b5", [("x", 5, 1, "five"), ("x", 5, 0, "first of five"), ("y", 5, 1, "y5")])
    run()
    assert read() == [("x", 5, "first of five"), ("y", 5, "y5")]
    put("b2", [("x", 2, 1, "two"), ("z", 2, 1, "z2")])
    put("b7", [("y", 7, 1, "late")])
    run()
    run()
    assert read() == [("x", 2, "two"), ("y", 5, "y5"), ("z", 2, "z2")]


def test_a_batch_touches_its_own_keys_only(spark, tmp_path, rows):
    """Landing never reads the sink: what a micro-batch changes follows its own size, also for late and repeated batches."""
    spec, at = "k string, batch int, n int, v string", str(tmp_path)
    put = lambda name, data: spark.createDataFrame(data, spec).repartition(2).write.json(f"{at}/in/{name}")
    run = lambda: landing.ingest_batches(spark, f"{at}/in/*", f"{at}/out", f"{at}/seen", spec, ["k"], "batch", "n")
    first = [(f"k{i}", 5, i, None if i % 3 else "é, \"x\"") for i in range(2000)] + [("k0", 5, 9999 + i, "again") for i in range(500)] + [(None, None, 1, "no key")]
    put("a", first)
    assert sum(p["read"] for p in run()) == 2501
    put("b", first)  # the same batch again
    put("c", [("k7", 3, 1, "earlier"), ("k8", 9, 1, "later"), ("new", 9, 1, "")])
    done = run()
    assert sum(p["keys"] for p in done) == 2 and run() == []
    got = {r.k: (r.batch, r.v) for r in landing.read_landed(spark, f"{at}/out", spec, ["k"], "batch", "n").collect()}
    assert len(got) == 2002 and got["k7"] == (3, "earlier") and got["k8"] == (5, None) and got["new"] == (9, "") and got["k0"] == (5, "é, \"x\"") and got[None] == (None, "no key")


def test_generations_of_relations(spark, tmp_path, frame):
    path = str(tmp_path)
    edges = frame([("a", "b", "likes"), ("b", "c", "likes"), ("a", "c", "is a/kind of")], "src string, dst string, rel string")
    assert S.write_graph_tables(edges, path) == 1
    before = S.read_graph_tables(spark, path)
    assert S.write_graph_tables(frame([("x", "y", "likes")], "src string, dst string, rel string"), path, replace=True) == 2
    seen = lambda df: sorted((r.src, r.dst, r.rel) for r in df.collect())
    # a reader that began before the replacement sees its generation, a new one the new
    assert seen(before) == [("a", "b", "likes"), ("a", "c", "is a/kind of"), ("b", "c", "likes")]
    assert seen(S.read_graph_tables(spark, path)) == [("a", "c", "is a/kind of"), ("x", "y", "likes")]
    assert seen(S.read_graph_tables(spark, path, version=1)) == seen(before)
    # files without a manifest are no part of the table
    edges.withColumn("gen", F.lit("00000003-lost")).write.mode("append").partitionBy("rel", "gen").parquet(f"{path}/data")
    assert len(seen(S.read_graph_tables(spark, path))) == 2
    one = S.read_graph_tables(spark, path).where("rel = 'likes'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan and seen(one) == [("x", "y", "likes")]
    S.write_graph_tables(frame([("p", "q", "likes")], "src string, dst string, rel string"), path, replace=True)
    assert S.remove_old_generations(spark, path, keep=1) == 2
    assert seen(S.read_graph_tables(spark, path)) == [("a", "c", "is a/kind of"), ("p", "q", "likes")]
    S.write_graph_tables(frame([("p", "q", "new")], "src string, dst string, rel string"), path)
    assert seen(S.read_graph_tables(spark, path)) == [("p", "q", "new")]


def test_many_people_of_one_name(frame):
    """Ten thousand people of one name and a thousand officials: words decide, nobody is paired."""
    people = frame([(f"p{i:05d}", "smith", "j", f"Institute ward{i // 2:05d} of Somewhere", "usa") for i in range(10_000)] + [("lone", "stone", "a", "Elsewhere", "usa")],
                   "id string, ln string, ini string, affiliation string, country string")
    officials = frame([(f"t{i}", 0, "John Smith", f"Clinic ward{i:05d}") for i in range(1000)] + [("u", 0, "John Smith", "Clinic zz"), ("v", 0, "Ann Stone", "Nowhere")], "trial string, pos int, name string, affiliation string")
    began = time.time()
    got = {r.trial: (r.person, r.how) for r in P.match_officials(officials, people).collect()}
    assert time.time() - began < 30
    # two people share each word, so none is told apart by it
    assert all(got[f"t{i}"][1] == "new" for i in range(1000)) and got["v"] == ("lone", "name")
    single = people.where("id <> 'p00007'")
    got = {r.trial: (r.person, r.how) for r in P.match_officials(officials, single).collect()}
    assert got["t3"] == ("p00006", "name + affiliation") and got["t4"][1] == "new"


@pytest.mark.parametrize("name", ["author_identity", "lead_identity", "low_review", "stopped_study", "gene_reference_papers", "grant_match"])
def test_rules_on_one_relation_form_no_similar_pairs(spark, monkeypatch, name):
    from lodestone.catalog import q_evidence as Q
    from lodestone.catalog.registry import Tables

    monkeypatch.setattr(Q, "similar", lambda t: pytest.fail("similar pairs were formed"))
    t = Tables(spark, "/root/testdata/sf0.001")
    assert Q.FLAGS[name](t).count() > 0
    assert "all_edges" not in t._built


def test_broader_grants_read_only_the_heads_of_a_class(spark, frame, tmp_path, monkeypatch):
    """Equal to a plain pass over all grants of all broader classes, of which no class hands on more than a head."""
    rng = random.Random(4)
    kids, classes = [f"S{i}" for i in range(30)], ["N0", "N1", "R0"]
    up = [(k, c, 1) for i, k in enumerate(kids) for c in ([classes[i % 2]] if i % 3 else classes[:2])] + [(k, "R0", 2) for k in kids] + [("N0", "R0", 1), ("N1", "R0", 1)]
    grants = [(f"G{i:03d}", rng.random() < 0.5, rng.randrange(1990, 1996), float(rng.randrange(5))) for i in range(200)]
    funds = {(rng.choice(kids), g[0]) for g in grants for _ in range(4)} | {(c, g[0]) for c in classes for g in grants if rng.random() < 0.7}
    # an id that owns the whole head of its class
    order = lambda g: (not g[1], -g[2], -g[3], g[0])
    funds |= {("S1", g[0]) for g in sorted(grants, key=order)[:40]}
    want = set()
    for i in kids:
        own = {g for e, g in funds if e == i or any(a == i and c == e for c, a, _ in up)}
        over = {}
        for c, a, _ in up:
            for e, g in funds if c == i else ():
                if e == a and g not in own:
                    over[g] = min(a, over.get(g, a))
        best = sorted((g for g in grants if g[0] in over), key=order)[:8]
        want |= {(i, g[0], over[g[0]], n + 1) for n, g in enumerate(best)}
    heads = []
    monkeypatch.setattr(L, "cut", lambda df, name: heads.append((name, cut(df, name))) or heads[-1][1])
    ids = frame([(x,) for x in kids], "id string")
    own = [(i, g) for e, g in funds for i in {e} | {a for c, a, _ in up if c == e}]
    found = L.broader_grants(ids, frame(up, "id string, ancestor string, dist int"), frame(list(funds), "entity string, grant_id string"),
                             frame(grants, "id string, active boolean, fy_last int, amount double"), frame(own, "id string, grant_id string"))
    assert {(r.id, r.grant_id, r.via, r["rank"]) for r in found.select("id", "grant_id", "via", "rank").collect()} == want
    held = {name: df.count() for name, df in heads}
    most = max(sum(i == x for i, _ in own) for x in kids)
    assert held["heads"] <= len(classes) * (8 + most) and held["taken"] < sum(i in kids for i, _ in set(own))


def test_a_written_graph_is_computed_once_and_relations_keep_their_names(spark, frame, tmp_path):
    from lodestone.sources import files

    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    edges = frame([("a", "b", "01"), ("a", "c", "1"), ("b", "c", "likes"), ("b", "a", None)], "src string, dst string, rel string")
    files.write_graph_tables(edges.mapInPandas(watched, edges.schema), str(tmp_path / "graph"))
    assert seen.value == 4
    assert files._manifest(spark, str(tmp_path / "graph"))[1].keys() == {"01", "1", "likes"}


def test_xml_files_hold_a_bounded_number_of_records(spark, monkeypatch):
    from pathlib import Path

    import __spark_entry__ as entry
    from lodestone.catalog import q_sources
    from lodestone.common import shared_dir

    monkeypatch.setattr(q_sources, "XML_RECORDS", 500)
    before = set(Path(shared_dir(spark)).glob("disorders-*"))
    n = entry.queries()["read_disorder_xml"](spark, "/root/testdata/sf0.001").agg({"n": "sum"}).first()[0]
    (made,) = set(Path(shared_dir(spark)).glob("disorders-*")) - before
    sizes = [p.read_text().count("<Disorder>") for p in made.glob("part-*")]
    assert max(sizes) <= 500 and sum(sizes) == n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_best_variants_count_repeats_once(frame):
    hits = frame([("a", v, s, n) for v, s, n in [("v1", 4, 1.0), ("v1", 4, 1.0), ("v2", 4, 1.0), ("v3", 3, 9.0), ("v4", 3, 9.0), ("v4", 3, 9.0)]] + [("b", "v9", 1, 1.0)],
                 "id string, variant string, stars int, nsub double")
    got = sorted((r.id, r["rank"], r.variant) for r in L.variants_for(hits, 3).collect())
    assert got == [("a", 1, "v1"), ("a", 2, "v2"), ("a", 3, "v3"), ("b", 1, "v9")]


def test_a_large_cluster_is_dealt_over_tasks(frame):
    rows = [(f"i{i}", "big", "B") for i in range(60)] + [("j", "small", "S"), ("k", "small", "S"), ("l", "", ""), ("m", None, None), ("n", "lone", "L")]
    clusters = frame(rows, "id string, cluster_id string, cluster_label string")
    wanted = frame([(f"i{i}",) for i in range(30)] + [("j",), ("l",), ("m",), ("n",)], "id string")
    got = L.cluster_members(wanted, clusters, pairs=100)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sorted((r.id, r.other) for r in got.collect()) == sorted([(f"i{i}", f"i{j}") for i in range(30) for j in range(60) if i != j] + [("j", "k")])
    assert max(sizes) < 900 and L.cluster_members(wanted.limit(0), clusters).isEmpty()


def test_studies_have_their_place_in_their_section(frame):
    trials = frame([("x", f"t{i}") for i in range(9)] + [("y", "t3")], "id string, trial string")
    facts = [("t0", "trial", "COMPLETED", "2001-02-10", 1), ("t1", "trial", "RECRUITING", "2001-02-19", 1), ("t2", "trial", "RECRUITING", "2001-02-10", 1),
             ("t3", "trial", "RECRUITING", "2001-02-10", 11), ("t4", "registry", "TERMINATED", None, None), ("t5", None, "RECRUITING", "2000-02-10", 1),
             ("t6", "observational", None, "2001-02-10", 1), ("t7", "natural_history", "", "", 1), ("t8", "registry", "TERMINATED", "2001-02-10", 1)]
    got = {(r.id, r.trial): (r.section, r.place) for r in L.studies_for(trials, frame(facts, "id string, kind string, status string, start string, n_conditions int")).collect()}
    assert got == {("x", "t5"): ("trials", 1), ("x", "t2"): ("trials", 2), ("x", "t1"): ("trials", 3), ("x", "t0"): ("trials", 4), ("x", "t3"): ("trials", 5), ("y", "t3"): ("trials", 1),
                   ("x", "t4"): ("registries", 1), ("x", "t8"): ("registries", 2), ("x", "t6"): ("observational", 1), ("x", "t7"): ("natural_history", 1)}
