from lodestone.operators import closure as C

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "y")]


def brute(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = {}
    for start in {n for e in edges for n in e}:
        dist, front = {start: 0}, [start]
        while front:
            nxt = []
            for n in front:
                for p in up.get(n, ()):
                    if p not in dist:
                        dist[p] = dist[n] + 1
                        nxt.append(p)
            front = nxt
        out.update({(start, k): v for k, v in dist.items()})
    return out


def test_closure_matches_breadth_first_walk(spark, frame, rows):
    got = rows(C.transitive_closure(frame(EDGES, "child string, parent string")), "id", "ancestor", "dist")
    assert got == sorted((a, b, d) for (a, b), d in brute(EDGES).items())


def test_depth_cap_and_empty_input(frame, rows):
    capped = C.transitive_closure(frame(EDGES, "child string, parent string"), max_depth=3, include_self=False)
    assert {(a, b): d for a, b, d in rows(capped, "id", "ancestor", "dist")} == {k: v for k, v in brute(EDGES).items() if 0 < v <= 3}
    assert rows(C.transitive_closure(frame([], "child string, parent string"))) == []


def test_nearest_walks_through_outsiders_only(frame, rows):
    got = rows(C.nearest_in_set(frame(EDGES, "child string, parent string"), frame([("a",), ("d",), ("g",), ("y",)], "id string")))
    assert got == [("a", "d"), ("d", "g")]


def test_groups_bridge_and_deprecated(frame, rows):
    clo = C.transitive_closure(frame(EDGES, "child string, parent string"))
    got = rows(C.assign_groups(clo, frame([("b", "north"), ("c", "south")], "root string, name string"), frame([("d",)], "root string"), frame([("c",)], "id string")))
    assert got == [("a", "north|south", True), ("b", "north", True), ("d", "bridge", True)]


def test_shortest_chain(frame, rows):
    edges = frame([("a", "b", "1"), ("b", "d", "2"), ("a", "d", "9"), ("a", "c", "0"), ("c", "d", "3")], "child string, parent string, edge_id string")
    clo = C.transitive_closure(edges)
    got = dict(((a, b), p) for a, b, p in rows(C.ancestor_paths(frame([("a", "d"), ("a", "a")], "id string, ancestor string"), edges, clo)))
    assert got == {("a", "d"): ["9"], ("a", "a"): []}
