import os
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import graph as gr
from corpuskit.sources.edges import read_edges


def _uf_components(vertices, edges):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for v in vertices:
        groups.setdefault(find(v), []).append(v)
    return {v: min(g) for g in groups.values() for v in g}


def _edges_df(spark, edges):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "eid long, src long, dst long")


# path 1-2-3, triangle 4-5-6, two triangles sharing 7 (7-8-9, 7-10-11), isolated 12
FIXTURE = [(1, 2), (2, 3), (4, 5), (5, 6), (6, 4), (7, 8), (8, 9), (9, 7), (7, 10), (10, 11), (11, 7), (3, 4)]


def test_components_fixture_and_random(spark):
    verts = spark.createDataFrame([(v,) for v in range(1, 13)], "id long")
    got = {r.vertex: r.component for r in gr.connected_components(_edges_df(spark, FIXTURE), vertices=verts).collect()}
    assert got == _uf_components(range(1, 13), FIXTURE)
    rnd = random.Random(7)
    for n, m in [(60, 40), (200, 180)]:
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        vs = sorted({x for e in edges for x in e if e[0] != e[1]})
        got = {r.vertex: r.component for r in gr.connected_components(_edges_df(spark, edges)).collect()}
        assert got == _uf_components(vs, [e for e in edges if e[0] != e[1]])


def _is_cycle(edge_list):
    deg = {}
    for _, a, b in edge_list:
        deg[a] = deg.get(a, 0) + 1
        deg[b] = deg.get(b, 0) + 1
    return all(d == 2 for d in deg.values()) and len(edge_list) == len(deg)


def test_fundamental_cycles_cactus(spark):
    e = _edges_df(spark, FIXTURE)
    cyc = gr.fundamental_cycles(e).collect()
    by = {}
    for r in cyc:
        by.setdefault(r.cycle_id, []).append((r.eid, r.src, r.dst))
    vsets = sorted(sorted({x for _, a, b in es for x in (a, b)}) for es in by.values())
    assert vsets == [[4, 5, 6], [7, 8, 9], [7, 10, 11]]
    assert all(_is_cycle(es) for es in by.values())


def test_fundamental_cycles_random_basis(spark):
    rnd = random.Random(3)
    edges = list({tuple(sorted((rnd.randrange(30), rnd.randrange(30)))) for _ in range(60)})
    edges = [x for x in edges if x[0] != x[1]]
    cyc = gr.fundamental_cycles(_edges_df(spark, edges)).collect()
    by = {}
    for r in cyc:
        by.setdefault(r.cycle_id, []).append((r.eid, r.src, r.dst))
    vs = {x for e in edges for x in e}
    n_comp = len(set(_uf_components(vs, edges).values()))
    assert len(by) == len(edges) - len(vs) + n_comp
    assert all(_is_cycle(es) for es in by.values())


def test_component_ids_and_contraction(spark):
    e = _edges_df(spark, FIXTURE)
    verts = spark.createDataFrame([(v,) for v in range(1, 13)], "vertex long")
    cyc = gr.fundamental_cycles(e)
    comp = {r.vertex: r.comp_id for r in gr.component_ids(verts, cyc).collect()}
    assert comp[4] == comp[5] == comp[6]
    assert comp[7] == comp[8] == comp[9] != comp[10]  # shared vertex joins the smaller cycle id
    assert sorted(set(comp.values())) == list(range(3 + 4))
    assert [comp[v] for v in (1, 2, 3, 12)] == [3, 4, 5, 6]
    con = {(r.vertex_from, r.vertex_to) for r in gr.contract_graph(e, gr.component_ids(verts, cyc)).collect()}
    assert (1, 2) in con and (2, 1) in con and (4, 5) not in con and (7, 10) in con and (10, 7) in con


def test_subtree_totals(spark):
    tree = [(2, 1), (3, 1), (4, 2), (5, 2), (6, 5), (8, 7)]
    df = spark.createDataFrame(tree, "child long, parent long")
    got = {r.vertex: r.descendants for r in gr.subtree_totals(df).collect()}
    assert got == {1: 5, 2: 3, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0}


def test_read_edges_reads_all_lines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "g.txt")
    with open(p, "w") as f:
        f.write("4 3\n1 2\n\n2 3\n  \n3 4\n")
    got = sorted((r.eid, r.src, r.dst) for r in read_edges(spark, p).collect())
    assert got == [(0, 1, 2), (1, 2, 3), (2, 3, 4)]


def test_vertices_with_only_self_loops_and_deep_paths_are_whole(spark):
    comp = gr.connected_components(_edges_df(spark, [(1, 2), (5, 5)]), "src", "dst")
    assert {r.vertex: r.component for r in comp.collect()} == {1: 1, 2: 1, 5: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(14)], "child long, parent long")
    assert {r.vertex: r.descendants for r in gr.subtree_totals(chain).collect()} == {i: i for i in range(15)}


def test_parent_cycles_raise(spark):
    import pytest
    with pytest.raises(ValueError):
        gr.subtree_totals(spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "child long, parent long"))


def test_component_ids_of_wide_ids(spark):
    top = 9 * 10 ** 18
    vertices = spark.createDataFrame([(-top,), (top,), (3,), (4,), (5,)], "vertex long")
    cycle = spark.createDataFrame([(7, 3, 4), (7, 4, 3)], "cycle_id long, src long, dst long")
    got = {r.vertex: (r.comp_id, r.on_cycle) for r in gr.component_ids(vertices, cycle).collect()}
    assert got == {3: (0, True), 4: (0, True), -top: (1, False), 5: (2, False), top: (3, False)}


def _totals(rows):
    below = {}
    for c, p in {r for r in rows if r[1] is not None}:
        below.setdefault(p, []).append(c)
    out = {}

    def walk(v):
        stack = [(v, False)]
        while stack:
            u, done = stack.pop()
            if done:
                out[u] = sum(out[w] + 1 for w in below.get(u, ()))
            else:
                stack.append((u, True))
                stack += [(w, False) for w in below.get(u, ())]
    for v in {*below} - {c for own in below.values() for c in own}:
        walk(v)
    return out


def _random_tree(rng, n, depth_bias):
    """Names as vertices; a hot parent, long chains, several roots, repeated rows."""
    rows = [(f"v{i}", f"v{max(0, i - 1 - int(rng.random() ** depth_bias * i))}") for i in range(1, n)]
    rows += [(f"h{i}", "v3") for i in range(n // 3)] + [("s2", "s1"), ("s3", "s2"), ("s1", None)]
    return rows + rows[:5]


def test_euler_tour_totals_equal_levels_and_brute_force(spark):
    import random
    for seed, bias in ((1, 8), (2, 1)):
        rows = _random_tree(random.Random(seed), 60, bias)
        df = spark.createDataFrame(rows, "child string, parent string")
        for levels in (0, 10**6):
            assert {r.vertex: r.descendants for r in gr.subtree_totals(df, levels=levels).collect()} == _totals(rows)


def test_a_path_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n, cuts, cut = 10_000, [], gr._cut
    monkeypatch.setattr(gr, "_cut", lambda df: cuts.append(1) or cut(df))
    df = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = gr.subtree_totals(df).agg(F.count("*").alias("n"), F.count_if(F.col("descendants") != n - 1 - F.col("vertex")).alias("wrong")).first()
    assert (got.n, got.wrong) == (n, 0) and len(cuts) < 40


@pytest.mark.parametrize("levels", [0, 8])
def test_parent_cycles_and_two_parents_raise(spark, levels):
    for rows in ([(1, 2), (2, 3), (3, 1)], [(1, 0), (2, 0), (5, 6), (6, 5)], [(1, 0), (1, 2)]):
        with pytest.raises(ValueError):
            gr.subtree_totals(spark.createDataFrame(rows, "child long, parent long"), levels=levels).collect()


def test_lifted_cycles_equal_climbed_ones(spark):
    import random
    rng = random.Random(4)
    pairs = {(i, i + 1) for i in range(1, 40)} | {tuple(sorted(rng.sample(range(1, 45), 2))) for _ in range(14)} | {(50, 51), (51, 52), (50, 52)}
    edges = spark.createDataFrame([(e, a, b) for e, (a, b) in enumerate(sorted(pairs))], "eid long, src long, dst long")
    comp = gr.connected_components(edges).checkpoint()
    rows = lambda levels: sorted(map(tuple, gr.fundamental_cycles(edges, components=comp, levels=levels).select("cycle_id", "eid", "src", "dst").collect()))
    assert rows(0) == rows(10**6)
    vertices, parts = {x for p in pairs for x in p}, comp.select("component").distinct().count()
    assert len({r[0] for r in rows(0)}) == len(pairs) - len(vertices) + parts  # one cycle per edge beyond a forest


def _smallest_forest(edges):
    """Edge ids of the spanning forest that takes edges by id."""
    top, taken = {}, set()

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for e, a, b in sorted(edges):
        if find(a) != find(b):
            top[find(a)] = find(b)
            taken.add(e)
    return taken


def test_hooked_forest_is_a_forest_with_its_depths(spark):
    rng = random.Random(11)
    rows = {(i, i + 1) for i in range(1, 30)} | {(100, 200 + i) for i in range(40)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(50)}
    ids = rng.sample(range(1000), len(rows) + 2)
    edges = [(e, a, b) for e, (a, b) in zip(ids, sorted(rows))] + [(ids[-1], 2, 1), (ids[-2], 300, 300)]  # a parallel edge, a loop
    df = spark.createDataFrame(edges, "eid long, src long, dst long")
    comp = gr.connected_components(df).checkpoint()
    forest = gr.hooked_forest(df, comp).collect()
    node = {r.vertex: r for r in forest}
    root = {r.vertex: r.component for r in comp.collect()}
    ends = {e: {a, b} for e, a, b in edges}
    assert node.keys() == root.keys() and len(node) == len(forest)
    for v, r in node.items():
        if v == root[v]:
            assert (r.depth, r.parent, r.parent_eid) == (0, None, None)
        else:
            assert ends[r.parent_eid] == {v, r.parent} and r.depth == node[r.parent].depth + 1
    assert {r.parent_eid for r in node.values()} - {None} == _smallest_forest([x for x in edges if x[1] != x[2]])
    empty = df.where("false")
    assert gr.hooked_forest(empty, gr.connected_components(empty)).count() == 0
    assert gr.bfs_forest(df, comp, most=2) is None


def test_cycles_of_a_deep_graph_take_few_rounds(spark, monkeypatch):
    n, cuts, cut, stored = 3000, [], gr._cut, gr._stored
    ring = spark.range(n).select(F.col("id").alias("eid"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = [(n, 5, 10_000), (n + 1, 10_000, 10_001), (n + 2, 10_001, 10_002), (n + 3, 10_002, 10_000)]
    edges = ring.unionByName(spark.createDataFrame(tail, "eid long, src long, dst long"))
    comp = spark.createDataFrame([(v, 0) for v in [*range(n), 10_000, 10_001, 10_002]], "vertex long, component long")
    monkeypatch.setattr(gr, "_cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(gr, "_stored", lambda df: cuts.append(1) or stored(df))
    by = {}
    for r in gr.fundamental_cycles(edges, components=comp, bfs_levels=8).collect():
        by.setdefault(r.cycle_id, []).append((r.eid, r.src, r.dst))
    assert sorted(sorted(e for e, _, _ in c) for c in by.values()) == [list(range(n)), [n + 1, n + 2, n + 3]]
    assert all(_is_cycle(c) for c in by.values()) and len(cuts) < 120


def test_edges_are_shuffled_once_and_not_by_level(spark, monkeypatch):
    # Levels and climbs worked through the stored rows once each; the plan's joins don't grow with the cycles' length.
    edges = spark.createDataFrame([(i, i, (i + 1) % 12) for i in range(12)], "eid long, src long, dst long")
    comp = spark.createDataFrame([(v, 0) for v in range(12)], "vertex long, component long").checkpoint()
    cut, wide = gr._cut, []
    monkeypatch.setattr(gr, "_cut", lambda df: wide.append(df) or cut(df))
    cyc = gr.fundamental_cycles(edges, components=comp)
    assert sorted(r.eid for r in cyc.collect()) == list(range(12))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in wide]
    assert not any("cycle_id" in p for p in plans)  # no round over the cycles' rows


def test_levels_join_kept_neighbours(spark):
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(FIXTURE)], "eid long, src long, dst long")
    sym = gr._adjacent(edges, "src", "dst", "eid")
    sym.count()
    plan = sym.groupBy("u").agg(F.min("v"))._jdf.queryExecution().executedPlan().toString()
    sym.unpersist()
    assert plan.split("InMemoryRelation")[0].count("Exchange") == 0
