import math
import random

import pytest

from lodestone.operators import closure as C
from lodestone.operators import similarity as S
from lodestone.operators import topk as T


def random_bags(seed, n=60, items=40):
    rng = random.Random(seed)
    bags = {}
    for i in range(n):
        bag = {f"i{int(rng.random() ** 3 * items)}" for _ in range(rng.randint(1, 14))}
        if rng.random() < 0.5:
            bag.add("hub")
        bags[f"e{i:02d}"] = bag
    bags["copy1"], bags["copy2"] = set(bags["e00"]), set(bags["e00"])
    bags["lone"] = {"hub"}
    return bags


def weight(item):
    return 0.4 if item == "hub" else 1.0 + int(item[1:]) % 5


def brute(bags, measure, floor):
    names, out = sorted(bags), {}
    w = weight
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            both = bags[a] & bags[b]
            if not both:
                continue
            if measure == "cosine":
                s = sum(w(i) ** 2 for i in both) / math.sqrt(sum(w(i) ** 2 for i in bags[a]) * sum(w(i) ** 2 for i in bags[b]))
            elif measure == "jaccard":
                s = len(both) / len(bags[a] | bags[b])
            else:
                s = len(both) / math.sqrt(len(bags[a]) * len(bags[b]))
            if s >= floor:
                out[(a, b)] = round(s, 9)
    return out


@pytest.mark.parametrize("measure", ["cosine", "jaccard", "ochiai"])
@pytest.mark.parametrize("floor", [0.1, 0.45, 0.8])
def test_prefix_filter_loses_no_pair(frame, measure, floor):
    bags = random_bags(7)
    w = weight if measure == "cosine" else lambda i: 1.0
    df = frame([(measure, e, i, w(i)) for e, bag in bags.items() for i in bag], "kind string, entity string, item string, w double")
    for hub in (1, 8, 1000) if floor == 0.45 else (8,):
        found = T.similar(df, {measure: 1.0}, floor, hub=hub, block=7).where(f"s_{measure} >= {floor}")
        got = {(r.a, r.b): round(r[f"s_{measure}"], 9) for r in found.collect()}
        assert got == brute(bags, measure, floor)


@pytest.mark.parametrize("hub", [1, 8, 1000])
def test_cosine_of_all_pairs_has_no_least_score(frame, monkeypatch, hub):
    monkeypatch.setattr(T.similar, "__defaults__", tuple(hub if d == T.HUB else 7 if d == T.BLOCK else d for d in T.similar.__defaults__))
    bags = random_bags(7)
    df = frame([(e, i, weight(i)) for e, bag in bags.items() for i in bag] + [("tiny", "hub", 0.4), ("tiny", "own", 1e7), ("zero", "own", 0.0)], "entity string, term string, ic double")
    got = {(r.a, r.b): r.score for r in S.weighted_cosine_pairs(df).collect()}
    want = brute(bags, "cosine", 0.0)
    assert {p: round(s, 9) for p, s in got.items() if "tiny" not in p} == want and min(want.values()) < 0.1
    near = {p for p in got if "tiny" in p}
    assert near == {tuple(sorted((e, "tiny"))) for e, bag in bags.items() if "hub" in bag} and all(0 < got[p] < 1e-6 for p in near)


def brute_top(sets, groups, exclude, k, cross_k, floor, least):
    """Best pairs of every entity from the full table of weighted sums."""
    names, score = sorted({e for bags in sets.values() for e in bags}), {}
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            if (a, b) in exclude:
                continue
            total = 0.0
            for kind, w in S.WEIGHTS.items():
                p, q = sets[kind].get(a, set()), sets[kind].get(b, set())
                both = p & q
                if both:
                    v = weight if kind == "cosine" else lambda i: 1.0
                    total += w * {"cosine": sum(v(i) ** 2 for i in both) / math.sqrt(sum(v(i) ** 2 for i in p) * sum(v(i) ** 2 for i in q)),
                                  "jaccard": len(both) / len(p | q), "ochiai": len(both) / math.sqrt(len(p) * len(q))}[kind]
            score[a, b] = score[b, a] = round(total, 9)
    out = set()
    for a in names:
        near = sorted((-score[a, b], b) for b in names if (a, b) in score)
        out |= {(min(a, b), max(a, b)) for s, b in [x for x in near if -x[0] >= least][:k]}
        out |= {(min(a, b), max(a, b)) for s, b in [x for x in near if -x[0] >= floor and groups[a] != groups[x[1]]][:cross_k]}
    return {p: score[p] for p in out}


@pytest.mark.parametrize("hub,block", [(2, 5), (10, 16), (1000, 10)])
def test_top_pairs_equal_brute_force(frame, hub, block):
    sets = {"cosine": random_bags(1), "jaccard": random_bags(2, items=15), "ochiai": random_bags(3, n=40)}
    names = sorted(random_bags(1))
    groups = {e: f"g{i % 3}" for i, e in enumerate(names)}
    rows = [(k, e, i, weight(i) if k == "cosine" else 1.0) for k, bags in sets.items() for e, bag in bags.items() for i in bag]
    rows += [("cosine", "e01", "nothing", 0.0), ("cosine", None, "i1", 1.0), ("jaccard", "e01", None, 1.0)]
    exclude = {("copy1", "copy2"), ("e00", "e01"), ("e03", "lone")}
    found = T.similar(frame(rows, "kind string, entity string, item string, w double"), S.WEIGHTS, 0.1125, frame(sorted(exclude), "a string, b string"),
                      frame(sorted(groups.items()), "id string, grp string"), 4, 2, 0.15, hub=hub, block=block)
    assert found.groupBy("a", "b").count().where("count > 1").count() == 0
    want = brute_top(sets, groups, exclude, 4, 2, 0.1125, 0.15)
    top = S.top_pairs(found.select("a", "b", "score"), frame(sorted(groups.items()), "id string, grp string"), 4, 0.15, 2)
    assert {(r.a, r.b): round(r.score, 8) for r in top.collect()} == {p: round(s, 8) for p, s in want.items()}


def test_few_pairs_are_scored_with_a_hub_in_every_bag(frame):
    """A thousand bags share one item of little weight; besides, groups of five share what counts."""
    rows = [("cosine", f"e{i:04d}", "hub", 0.5) for i in range(1000)] + [("cosine", f"e{i:04d}", f"own{i // 5}", 3.0) for i in range(1000)]
    df, counts = frame(rows, "kind string, entity string, item string, w double"), {}
    groups = frame([(f"e{i:04d}", "g") for i in range(1000)], "id string, grp string")
    found = T.similar(df, {"cosine": 1.0}, 0.3, None, groups, 4, counts=counts)
    assert found.count() == 2000 and counts == {"light": 2000, "scored": 2000, "blocks": 0}
    # where hubs make up the bags, blocks meet, and hand on the best of each entity only
    dense = df.unionByName(frame([("jaccard", f"e{i:04d}", f"h{j}", 1.0) for i in range(1000) for j in range(i % 4)], df.schema))
    found = T.similar(dense, S.WEIGHTS, 0.1, None, groups, 4, hub=64, block=100, counts=counts)
    assert 0 < counts["blocks"] and counts["light"] == 2000 and found.count() < 60_000


def test_no_bags(frame):
    none = frame([], "kind string, entity string, item string, w double")
    assert T.similar(none, S.WEIGHTS, 0.1).count() == 0
    assert T.similar(none, S.WEIGHTS, 0.1, None, frame([], "id string, grp string"), 3).count() == 0


def test_hub_item_leaves_the_join(frame):
    bags = [("cosine", f"e{i}", "hub", 0.1) for i in range(200)] + [("cosine", f"e{i}", f"own{i}", 3.0) for i in range(200)]
    df = frame(bags, "kind string, entity string, item string, w double")
    assert S.similar_candidates(df, 0.3).count() == 0


def test_between_two_tables(frame):
    left = frame([("cosine", "q", "x", 1.0), ("cosine", "q", "y", 2.0)], "kind string, entity string, item string, w double")
    right = frame([("cosine", "d1", "y", 1.0), ("cosine", "d2", "z", 1.0)], "kind string, entity string, item string, w double")
    assert [tuple(r) for r in S.similar_candidates(left, 0.2, right).collect()] == [("q", "d1")]


def test_information_content(frame, rows):
    clo = C.transitive_closure(frame([("t1", "t0"), ("t2", "t0")], "child string, parent string"))
    ann = frame([("e1", "t1"), ("e2", "t1"), ("e3", "t2"), ("e3", "t1"), ("e4", "alone")], "entity string, term string")
    got = {t: (n, round(v, 6)) for t, n, v in rows(S.information_content(ann, clo))}
    assert got == {"t0": (3, round(math.log(4 / 3), 6)), "t1": (3, round(math.log(4 / 3), 6)), "t2": (1, round(math.log(4), 6)), "alone": (1, round(math.log(4), 6))}


def test_top_pairs_ties_threshold_and_cross_group(frame):
    scores = frame([("a", "b", .5), ("a", "c", .5), ("a", "d", .12), ("c", "d", .15), ("a", "e", .11)], "a string, b string, score double")
    groups = frame([("a", "g"), ("b", "g"), ("c", "g"), ("d", "h"), ("e", "h")], "id string, grp string")
    got = {(r.a, r.b): (r.cross_group, r.below_threshold) for r in S.top_pairs(scores, groups, 1, .15, 1, .75).collect()}
    # ties go to the smaller id; 0.15 is at the threshold; 0.12 lies between 0.75 and 1 times it; 0.11 is too low
    assert got == {("a", "b"): (False, False), ("a", "c"): (False, False), ("c", "d"): (True, False), ("a", "d"): (True, True)}


def test_shared_terms_equal_the_greedy_pass(frame):
    rng = random.Random(3)
    for trial in range(3):
        n = 14
        edges = [(f"t{i:02d}", f"t{j:02d}") for i in range(n) for j in range(i) if rng.random() < 0.25] or [("t01", "t00")]
        clo_df = C.transitive_closure(frame(edges, "child string, parent string"))
        clo = {(r.id, r.ancestor) for r in clo_df.where("dist > 0").collect()}
        ic = {f"t{i:02d}": 1.0 for i in range(n)}
        for i in range(n):  # deeper terms are at least as specific, with ties
            for c, p in edges:
                ic[c] = max(ic[c], ic[p] + rng.choice([0.0, 0.5]))
        rows = [(e, t, v, t, f"{e}-{t}") for e in ("x", "y") for t, v in ic.items() if e == "x" or t != "t03"]
        prop = frame(rows, "entity string, term string, ic double, via_term string, edge_id string")
        got = [r.term for r in S.shared_terms(frame([("x", "y")], "a string, b string"), prop, clo_df, 1.0, 5).orderBy("rank").collect()]
        chosen = []
        for t in sorted((t for t in ic if t != "t03"), key=lambda t: (-ic[t], t)):
            if not any((c, t) in clo for c in chosen) and len(chosen) < 5:
                chosen.append(t)
        assert got == chosen


def test_profile_modes(frame, rows):
    clo = C.transitive_closure(frame([("s1", "p"), ("s2", "p")], "child string, parent string"))
    bags = frame([("s2", "i", "e2"), ("s1", "i", "e1"), ("s1", "j", "e3"), ("s2", "k", "e4")], "entity string, item string, edge_id string")
    assert [r[1:] for r in rows(S.rollup_profile(bags, clo)) if r[0] == "p"] == [("i", "e1", "s1"), ("j", "e3", "s1"), ("k", "e4", "s2")]
    own = bags.union(frame([("p", "z", "e9")], "entity string, item string, edge_id string"))
    assert [r[1:] for r in rows(S.rollup_profile(own, clo, "own_or_subtypes")) if r[0] == "p"] == [("z", "e9", "p")]


def test_a_huge_bag_is_not_expanded_for_small_ones(spark, frame, rows):
    bags = frame([("huge", f"i{j}", j) for j in range(4000)] + [(f"e{i:03d}", f"i{i * 7 + j}", i) for i in range(200) for j in range(3)], "entity string, item string, num int")
    pairs = frame([(f"e{i:03d}", "huge") for i in range(100)] + [("huge", f"z{i}") for i in range(5)] + [("e001", "e002")], "a string, b string")
    pairs = pairs.unionByName(frame([("huge", f"e{i:03d}") for i in range(100, 200)], "a string, b string"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for found in [store.stageList(None, False, False, none, None)] for i in range(found.size())}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = set(stages())
        got = rows(S.shared_of_pairs(pairs, bags), "a", "b", "item", "num_a", "num_b")
        moved = sum(n for i, n in stages().items() if i not in seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = [(f"e{i:03d}", "huge", f"i{i * 7 + j}", i, i * 7 + j) for i in range(100) for j in range(3)]
    want += [("huge", f"e{i:03d}", f"i{i * 7 + j}", i * 7 + j, i) for i in range(100, 200) for j in range(3)]
    assert got == sorted(want) and moved < 100_000


def test_blocks_are_few_and_ties_go_to_the_earlier_name():
    import numpy as np

    # a block travels once for every block it meets: 60,000 entities must not lie in hundreds of blocks
    assert 60_000 / T.BLOCK <= 10
    rng = np.random.default_rng(5)
    score = rng.integers(0, 6, (40, 90)) / 10
    least = rng.integers(0, 6, 40) / 10
    got = T._best(score, 7, least)
    for row, mark, floor in zip(score, got, least, strict=True):
        best = sorted(range(len(row)), key=lambda i: (-row[i], i))[:7]
        assert set(np.flatnonzero(mark)) == {i for i in best if row[i] >= floor}


def test_packed_blocks_hold_their_hub_items_in_few_bytes():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(3000, 400, replace=False)).astype(np.int64) << 33 for _ in range(300)]
    weight = rng.random(3000)
    frame = pd.DataFrame({"entity": [f"S:{i:03}" for i in range(300)], "block": 7, "grp": "x", "items_0": lists, "ws_0": [weight[x >> 33] for x in lists],
                          "m_cosine": 1.0, "n_cosine": 400, "items_1": [None if i % 2 else x[:9] for i, x in enumerate(lists)], "m_jaccard": 9.0, "n_jaccard": 9})
    pieces = T._packer(["cosine", "jaccard"])(frame.sample(frac=1.0, random_state=3))
    assert sum(map(len, pieces["piece"])) < 3 * 300 * 400
    entities, (cosine, jaccard) = T._unpacked(pieces, ["cosine", "jaccard"])
    assert list(entities["entity"]) == list(frame["entity"]) and list(entities["n_cosine"]) == [400] * 300
    assert (cosine[1].reshape(300, 400) == np.stack(lists)).all() and (cosine[2] == weight[cosine[1] >> 33]).all()
    assert len(jaccard[0]) == 150 * 9 and (jaccard[2] == 1).all()
    frame["ws_0"] = [rng.random(400) for _ in lists]
    _, (each, _) = T._unpacked(T._packer(["cosine", "jaccard"])(frame), ["cosine", "jaccard"])
    assert (each[2] == np.concatenate(frame["ws_0"])).all()


def test_sets_for_scores_equal_the_propagated_profile_without_supports(frame, rows):
    closure = frame([("a", "a", 0), ("b", "b", 0), ("n", "n", 0), ("a", "n", 1), ("b", "n", 1)], "id string, ancestor string, dist int")
    terms = frame([("l1", "l1", 0), ("l2", "l2", 0), ("t", "t", 0), ("l1", "t", 1), ("l2", "t", 1)], "id string, ancestor string, dist int")
    bags = frame([("a", "l1", "e1"), ("a", "l1", "e2"), ("b", "l1", "e3"), ("b", "l2", "e4"), ("n", "t", "e5"), ("b", "lost", "e6")], "entity string, item string, edge_id string")
    ic = frame([("l1", 1.0), ("l2", 2.0)], "term string, ic double")
    profile = S.rollup_profile(bags, closure)
    wanted = S.propagate_terms(profile.withColumnRenamed("item", "term"), terms, ic)
    assert rows(S.term_sets(bags, closure, terms, ic), "entity", "term", "ic") == rows(wanted, "entity", "term", "ic")
    assert rows(S.item_sets(bags, closure), "entity", "item") == rows(profile, "entity", "item")


def test_own_items_and_those_of_subtypes_are_read_in_one_pass(spark, frame):
    bags = frame([(f"s{i % 40}", f"i{i}", f"e{i}") for i in range(400)] + [("n", "own", "e")], "entity string, item string, edge_id string")
    closure = frame([(f"s{i}", a, d) for i in range(40) for a, d in ((f"s{i}", 0), ("n", 1), ("root", 2))] + [("n", "n", 0), ("root", "root", 0)], "id string, ancestor string, dist int")
    got = S.rollup_profile(bags, closure, "own_or_subtypes")
    found = {(r.entity, r.item) for r in got.collect()}
    assert found == {(f"s{i % 40}", f"i{i}") for i in range(400)} | {("root", f"i{i}") for i in range(400)} | {("n", "own")}

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    inner = [n for n in nodes(got._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and str(n.joinType()) == "Inner"]
    assert len(inner) == 1
