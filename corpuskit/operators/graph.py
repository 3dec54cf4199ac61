"""Edge-table operators: connected components, fundamental cycles,
cycle-based component ids, contraction and subtree totals.

All are iterative DataFrame jobs (joins + aggregations per round) with the
driver only counting rows to decide convergence.  Each round's state is cut
from its lineage with a reliable ``checkpoint()`` into the session's
checkpoint directory, so a lost executor never replays earlier rounds and
plans stay small.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.ordering import with_row_index_range
from corpuskit.operators.segments import with_neighbour
from corpuskit.session import ensure_checkpoint_dir


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame) -> DataFrame:
    """Like :func:`_cut`, by a written table: its size is the files', where a checkpoint keeps
    the estimate of its plan, which self joins square in every round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _adjacent(edges: DataFrame, src: str, dst: str, *more: str) -> DataFrame:
    """Both directions ``(u, v, *more)`` of every edge that is no loop, kept in partitions by ``u``:
    every round joins or groups them where they lie.  To be unpersisted."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    turned = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
    return edges.where(F.col(src) != F.col(dst)).withColumn("_turn", F.explode(F.array(F.lit(False), F.lit(True)))) \
        .select(turned(src, dst).alias("u"), turned(dst, src).alias("v"), *more) \
        .repartition(n, "u").persist(StorageLevel.MEMORY_AND_DISK)


def _contracted(sym: DataFrame) -> DataFrame | None:
    """``(vertex, component)`` of both directions ``(u, v)`` of the edges; None without edges.

    Every part points at its smallest neighbour if that is smaller; chains of
    pointers are followed by doubling to their smallest part, which the chain
    becomes.  Only edges between different parts go on: parts at least halve in a round."""
    labels, open_ = None, sym
    while open_.limit(1).count():
        low = open_.groupBy("u").agg(F.min("v").alias("m"))
        part = _chased(low.select(F.col("u").alias("k"), F.when(F.col("m") < F.col("u"), F.col("m")).alias("to"), F.lit(0).alias("w"))).select("k", "last")
        if labels is None:
            labels = part.select(F.col("k").alias("vertex"), F.col("last").alias("component"))
        else:
            labels = _stored(labels.join(part, F.col("component") == F.col("k"), "left").select("vertex", F.coalesce("last", "component").alias("component")))
        between = open_.where(F.col("u") < F.col("v")).join(part.select(F.col("k").alias("u"), F.col("last").alias("a")), "u") \
            .join(part.select(F.col("k").alias("v"), F.col("last").alias("b")), "v").where(F.col("a") != F.col("b")).select("a", "b").distinct()
        between = _stored(between)
        open_ = between.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(between.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return labels


def _components(sym: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    labels = _contracted(sym.select("u", "v"))
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("vertex"), F.col(src).alias("component"))
    labels = loops if labels is None else labels.unionByName(loops)
    return labels.groupBy("vertex").agg(F.min("component").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         vertices: DataFrame | None = None, vertex_col: str = "id") -> DataFrame:
    """``(vertex, component)`` with the component labelled by its smallest vertex.

    Rounds of hooking and contraction (:func:`_contracted`), logarithmic in the
    number of vertices.  The edges are shuffled by one end, grouped there, and
    shuffled by the other end once a round; only those between different parts
    go on.  A vertex that only has self loops is a component; isolated vertices
    come from ``vertices``.
    """
    sym = _adjacent(edges, src, dst)
    try:
        labels = _components(sym, edges, src, dst)
    finally:
        sym.unpersist()
    if vertices is not None:
        vs = vertices.select(F.col(vertex_col).alias("vertex"))
        labels = vs.join(labels, "vertex", "left") \
            .select("vertex", F.coalesce("component", "vertex").alias("component")) \
            .unionByName(labels.join(vs, "vertex", "left_anti"))
    return labels


def bfs_forest(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst",
               eid: str = "eid", most: int | None = None) -> DataFrame | None:
    """BFS spanning forest from each component's smallest vertex:
    ``(vertex, depth, parent, parent_eid)``.  A vertex reached from several
    frontier vertices takes the smallest (parent, edge id): deterministic.
    A round per level; None if there are more than ``most`` levels below the roots."""
    sym = _adjacent(edges.withColumnRenamed(eid, "eid"), src, dst, "eid")
    try:
        return _levels(sym, components, most)
    finally:
        sym.unpersist()


def _levels(sym: DataFrame, components: DataFrame, most: int | None) -> DataFrame | None:
    roots = components.where(F.col("vertex") == F.col("component")).select(
        "vertex", F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("parent_eid"))
    # Levels are written once each; "visited" is their union (no rewrite of
    # all visited vertices per round).
    levels = [_cut(roots)]
    frontier = levels[0]
    for d in count(1):  # until a level is empty
        visited = levels[0]
        for lv in levels[1:]:
            visited = visited.unionByName(lv)
        # Aggregated before the visited ones go: a vertex is shuffled once per task, not once per edge.
        cand = sym.join(frontier.select(F.col("vertex").alias("u")), "u") \
            .groupBy("v").agg(F.min(F.struct("u", "eid")).alias("p")) \
            .join(visited.select(F.col("vertex").alias("v")), "v", "left_anti")
        nxt = cand.select(
            F.col("v").alias("vertex"), F.lit(d).cast("bigint").alias("depth"),
            F.col("p.u").alias("parent"), F.col("p.eid").alias("parent_eid"))
        nxt = _cut(nxt)
        if nxt.limit(1).count() == 0:
            break
        if most is not None and d > most:
            return None
        levels.append(nxt)
        frontier = nxt
        if len(levels) == 16:  # the plan stays bounded, however deep the forest
            levels = [_cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def _chased(state: DataFrame) -> DataFrame:
    """``(k, to, w)``: every chain of pointers ``to`` followed to its end by doubling;
    ``w`` adds up along the chain, ``last`` is the chain's last row.  A row that has
    arrived meets itself, so NULL pointers are no hot key."""
    state = _stored(state.withColumn("last", F.col("k")))
    for _ in range(state.count().bit_length() + 1):
        if state.where(F.col("to").isNotNull()).limit(1).count() == 0:
            return state
        ahead = state.select(F.col("k").alias("_k"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("last").alias("_last"))
        more = F.when(F.col("to").isNotNull(), F.col("_w")).otherwise(F.lit(0))
        state = _stored(state.join(ahead, F.coalesce("to", "k") == F.col("_k")).select(
            "k", F.col("_to").alias("to"), (F.col("w") + more).alias("w"), F.col("_last").alias("last")))
    raise ValueError("the pointers hold a cycle")


def spanning_edges(edges: DataFrame, src: str = "src", dst: str = "dst", eid: str = "eid") -> DataFrame:
    """Edges ``(src, dst, eid)`` of the spanning forest with the smallest edge ids, by
    hooking and contraction (Boruvka): every part hooks on along its smallest edge
    id, the chains of hooks are followed by pointer doubling, parts become one.
    Parts at least halve in a round, so rounds are logarithmic however deep the
    graph is.  ``eid`` is unique."""
    ends = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(eid).alias("eid"))
    open_ = _stored(ends.select("eid", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken = []
    while open_.limit(1).count():
        both = open_.select("eid", F.col("a").alias("k"), F.col("b").alias("to")).unionByName(
            open_.select("eid", F.col("b").alias("k"), F.col("a").alias("to")))
        hooks = _stored(both.groupBy("k").agg(F.min(F.struct("eid", "to")).alias("m")).select("k", "m.eid", "m.to"))
        taken.append(hooks.select("eid").distinct())
        # Ids are unique, so hooks only run in a circle where two parts take one edge: the smaller one stays.
        back = hooks.select(F.col("k").alias("to"), F.col("eid").alias("_eid"))
        to = F.when((F.col("eid") == F.col("_eid")) & (F.col("k") < F.col("to")), F.lit(None)).otherwise(F.col("to"))
        part = _chased(hooks.join(back, "to").select("k", to.alias("to"), F.lit(0).alias("w"))).select("k", "last")
        open_ = open_.join(part.withColumnRenamed("k", "a"), "a").select("eid", F.col("last").alias("a"), "b") \
            .join(part.withColumnRenamed("k", "b"), "b").select("eid", "a", F.col("last").alias("b"))
        open_ = _stored(open_.where(F.col("a") != F.col("b")))
    if not taken:
        return ends.limit(0)
    return _stored(ends.join(reduce(DataFrame.unionByName, taken).distinct(), "eid").select("src", "dst", "eid"))


def hooked_forest(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst", eid: str = "eid") -> DataFrame:
    """A spanning forest like :func:`bfs_forest`'s, without a round per level: the
    edges of :func:`spanning_edges`, hung from each component's smallest vertex.

    Every tree edge is an arc each way; the arc after u -> v leaves v to the
    neighbour that follows u there, in a circle that is cut at the root.  Ranks
    along this tour come from pointer doubling, and an edge is passed downwards
    first; depths come from doubling the parents."""
    tree = spanning_edges(edges, src, dst, eid)
    roots = components.where(F.col("vertex") == F.col("component")).select(F.col("vertex").alias("v"), F.lit(True).alias("_root"))
    arcs = tree.select(F.col("src").alias("u"), F.col("dst").alias("v"), "eid").unionByName(
        tree.select(F.col("dst").alias("u"), F.col("src").alias("v"), "eid"))
    # A vertex's neighbours in order of a hash, whose leading bits are buckets: no hub is one task.
    h = F.xxhash64("u")
    after = with_neighbour(arcs.withColumn("_h", h), ["v"], ["_h", "u"], ["u"], F.shiftright(h, 48), "_next")
    first = arcs.groupBy("v").agg(F.min_by("u", F.struct(h, "u")).alias("first"))
    onward = F.coalesce(F.col("_next.u"), F.when(F.col("_root").isNull(), F.col("first")))
    arc = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    tour = after.join(first, "v").join(roots, "v", "left")
    rank = _chased(tour.select(arc(F.col("u"), F.col("v")).alias("k"), F.when(onward.isNotNull(), arc(F.col("v"), onward)).alias("to"),
                               F.lit(1).cast("bigint").alias("w"))).select("k.u", "k.v", "w")
    ranks = tree.join(rank.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("_there")), ["src", "dst"]) \
        .join(rank.select(F.col("v").alias("src"), F.col("u").alias("dst"), F.col("w").alias("_back")), ["src", "dst"])
    down = F.col("_there") > F.col("_back")
    parents = ranks.select(F.when(down, F.col("dst")).otherwise(F.col("src")).alias("k"),
                           F.when(down, F.col("src")).otherwise(F.col("dst")).alias("to"), F.col("eid").alias("parent_eid"))
    parents = _stored(parents.unionByName(roots.select(F.col("v").alias("k"), F.lit(None).alias("to"), F.lit(None).alias("parent_eid"))))
    one = F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint")
    depths = _chased(parents.select("k", "to", one.alias("w"))).select("k", F.col("w").alias("depth"))
    return parents.join(depths, "k").select(F.col("k").alias("vertex"), "depth", F.col("to").alias("parent"), "parent_eid")


def _paths(node: DataFrame, depth: int) -> DataFrame:
    """``(vertex, path)``: ``(eid, v)`` of the vertex and its ancestors, up to the root (its ``eid`` is NULL).
    Paths double in a round, over one row per vertex; one that has arrived meets itself, so NULLs are no hot key."""
    step = F.struct(F.col("parent_eid").alias("eid"), F.col("vertex").alias("v"))
    state = _stored(node.select("vertex", F.array(step).alias("path"), F.col("parent").alias("to")))
    for _ in range(int(depth).bit_length()):
        ahead = state.select(F.col("vertex").alias("_v"), F.col("path").alias("_path"), F.col("to").alias("_to"))
        state = _stored(state.join(ahead, F.coalesce("to", "vertex") == F.col("_v")).select(
            "vertex", F.when(F.col("to").isNotNull(), F.concat("path", "_path")).otherwise(F.col("path")).alias("path"), F.col("_to").alias("to")))
    return state.select("vertex", "path")


def _climbed(nontree: DataFrame, node: DataFrame, depth: int) -> DataFrame:
    """Every cycle's edges, the closing one included: its endpoints' paths to the root
    without the steps that both take.  The edges are joined twice, however long the cycles are."""
    kinds = {f.name: f.dataType for f in node.schema.fields}
    paths = _paths(node, depth)
    steps = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(
        a["eid"].alias("eid"), a["v"].alias("src"), b["v"].alias("dst")))
    both = nontree.join(paths.select(F.col("vertex").alias("src"), F.col("path").alias("_px")), "src", "left") \
        .join(paths.select(F.col("vertex").alias("dst"), F.col("path").alias("_py")), "dst", "left")
    x, y = steps(F.col("_px")), steps(F.col("_py"))
    passed = F.when(F.col("_px").isNotNull() & F.col("_py").isNotNull(), F.concat(F.array_except(x, y), F.array_except(y, x)))
    closing = F.array(F.struct(F.col("eid").cast(kinds["parent_eid"]).alias("eid"), F.col("src").cast(kinds["vertex"]).alias("src"),
                               F.col("dst").cast(kinds["parent"]).alias("dst")))
    return both.select(F.col("eid").alias("cycle_id"), F.inline(F.concat(closing, F.coalesce(passed, F.array().cast(
        T.ArrayType(T.StructType([T.StructField("eid", kinds["parent_eid"]), T.StructField("src", kinds["vertex"]), T.StructField("dst", kinds["parent"])])))))))


def _lifted(ends: DataFrame, node: DataFrame, depth: int) -> list[DataFrame]:
    """The same edges by binary lifting.  Table k holds every vertex's 2^k-th
    ancestor, made from table k-1 by one self join.  Endpoints are brought level,
    then lifted together while their ancestors differ, largest step first; each
    lift is a path segment of 2^k edges, and segments are halved down to edges."""
    tops = [_cut(node.where(F.col("parent").isNotNull()).select(F.col("vertex").alias("v"), F.col("parent").alias("up")))]
    while 2 ** len(tops) <= depth:
        half = tops[-1]
        tops.append(_cut(half.join(half.select(F.col("v").alias("up"), F.col("up").alias("_far")), "up").select("v", F.col("_far").alias("up"))))
    deep = node.select(F.col("vertex").alias("x"), F.col("depth").alias("dx"))
    state = ends.join(deep, "x").join(deep.select(F.col("x").alias("y"), F.col("dx").alias("dy")), "y")
    # x is the deeper end.
    lower = F.col("dx") < F.col("dy")
    state = _cut(state.select("cycle_id", F.when(lower, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(lower, F.col("x")).otherwise(F.col("y")).alias("y"),
                              F.abs(F.col("dx") - F.col("dy")).alias("gap")))
    segments: list[list[DataFrame]] = [[] for _ in tops]
    up = lambda k, c: tops[k].select(F.col("v").alias(c), F.col("up").alias(f"{c}_up"))
    segment = lambda s, c: s.select("cycle_id", F.col(c).alias("v"))
    for k in range(len(tops) - 1, -1, -1):
        lifts = F.col("gap") >= 2 ** k
        s = _cut(state.join(up(k, "x"), "x", "left"))
        segments[k].append(segment(s.where(lifts), "x"))
        state = s.select("cycle_id", F.when(lifts, F.col("x_up")).otherwise(F.col("x")).alias("x"), "y",
                         F.when(lifts, F.col("gap") - 2 ** k).otherwise(F.col("gap")).alias("gap"))
    state = state.where(F.col("x") != F.col("y"))
    for k in range(len(tops) - 1, -1, -1):
        s = _cut(state.join(up(k, "x"), "x", "left").join(up(k, "y"), "y", "left"))
        lifts = F.coalesce(F.col("x_up") != F.col("y_up"), F.lit(False))
        segments[k] += [segment(s.where(lifts), c) for c in "xy"]
        state = s.select("cycle_id", *[F.when(lifts, F.col(f"{c}_up")).otherwise(F.col(c)).alias(c) for c in "xy"])
    segments[0] += [segment(state, c) for c in "xy"]  # their parent is where they meet
    long = None
    for k in range(len(tops) - 1, -1, -1):
        for own in segments[k]:
            long = own if long is None else long.unionByName(own)
        if k:
            long = _cut(long)
            long = long.unionByName(long.join(tops[k - 1], "v").select("cycle_id", F.col("up").alias("v")))
    edges = _cut(long).join(node.withColumnRenamed("vertex", "v"), "v")
    return [edges.select("cycle_id", F.col("parent_eid").alias("eid"), F.col("v").alias("src"), F.col("parent").alias("dst"))]


def fundamental_cycles(edges: DataFrame, src: str = "src", dst: str = "dst", eid: str = "eid",
                       components: DataFrame | None = None, levels: int = 12, bfs_levels: int = 64) -> DataFrame:
    """Edges of the fundamental cycle closed by every non-tree edge:
    ``(cycle_id, eid, src, dst)`` with ``cycle_id`` = the closing edge's id.

    The closing edge's endpoints climb a spanning forest until they meet; the tree
    edges they pass are the cycle's.  The forest is the BFS forest where that has at
    most ``bfs_levels`` levels; a deeper graph takes the one with the smallest edge
    ids (:func:`hooked_forest`), in rounds logarithmic in the number of vertices: as
    many cycles, a basis like the BFS forest's, but other ones.  In a forest of up to ``levels`` levels they
    meet where their paths to the root do (:func:`_climbed`); in a deeper one they
    climb by binary lifting, in rounds logarithmic in the depth (:func:`_lifted`).  Rows emitted equal the cycle lengths.  In a
    cactus graph these are exactly all its cycles.  Self loops are not cycles here.
    """
    edges = _cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(eid).alias("eid")))
    sym = _adjacent(edges, "src", "dst", "eid")
    try:
        comp = components if components is not None else _components(sym, edges, "src", "dst")
        forest = _levels(sym, comp, bfs_levels)
    finally:
        sym.unpersist()
    if forest is None:
        forest = hooked_forest(edges, comp, "src", "dst", "eid")
    tree_eids = forest.where(F.col("parent_eid").isNotNull()).select(F.col("parent_eid").alias("eid"))
    nontree = edges.where(F.col("src") != F.col("dst")).join(tree_eids, "eid", "left_anti")
    node = _cut(forest.select("vertex", "depth", "parent", "parent_eid"))
    depth = node.agg(F.max("depth")).first()[0] or 0
    if depth <= levels:
        out = _climbed(nontree, node, depth)
    else:
        ends = _cut(nontree.select(F.col("eid").alias("cycle_id"), F.col("src").alias("x"), F.col("dst").alias("y")))
        closing = nontree.select(F.col("eid").alias("cycle_id"), "eid", "src", "dst")
        out = reduce(DataFrame.unionByName, [closing, *_lifted(ends, node, depth)])
    if (src, dst) != ("src", "dst"):
        out = out.withColumnRenamed("src", src).withColumnRenamed("dst", dst)
    return out


def component_ids(vertices: DataFrame, cycle_edges: DataFrame, vertex_col: str = "vertex") -> DataFrame:
    """Dense component id per vertex: the vertices of a cycle share one id; a
    vertex on several cycles joins the smallest cycle id; every other vertex
    is its own component.  Cycles are numbered first (by cycle id), then the
    remaining vertices (by vertex id)."""
    on_cycle = cycle_edges.select("cycle_id", F.explode(F.array("src", "dst")).alias("vertex")) \
        .groupBy("vertex").agg(F.min("cycle_id").alias("cycle_id"))
    v = vertices.select(F.col(vertex_col).alias("vertex")).distinct().join(on_cycle, "vertex", "left")
    # Written: the numbering and the join below read one copy, not the cycles twice.
    v = _stored(v.select("vertex", F.col("cycle_id").isNull().alias("_free"), F.coalesce("cycle_id", "vertex").alias("_ck")))
    keys = v.select("_free", "_ck").distinct()
    dense = with_row_index_range(keys, ["_free", "_ck"], "_cid").select("_free", "_ck", (F.col("_cid") - 1).alias("comp_id"))
    return v.join(dense, ["_free", "_ck"]).select("vertex", "comp_id", (~F.col("_free")).alias("on_cycle"))


def contract_graph(edges: DataFrame, comp: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between different components, in both directions:
    ``(comp_from, comp_to, vertex_from, vertex_to)``."""
    c1 = comp.select(F.col("vertex").alias(src), F.col("comp_id").alias("cu"))
    c2 = comp.select(F.col("vertex").alias(dst), F.col("comp_id").alias("cv"))
    j = edges.select(src, dst).join(c1, src).join(c2, dst).where(F.col("cu") != F.col("cv"))
    fwd = j.select(F.col("cu").alias("comp_from"), F.col("cv").alias("comp_to"),
                   F.col(src).alias("vertex_from"), F.col(dst).alias("vertex_to"))
    rev = j.select(F.col("cv").alias("comp_from"), F.col("cu").alias("comp_to"),
                   F.col(dst).alias("vertex_from"), F.col(src).alias("vertex_to"))
    return fwd.unionByName(rev)


def subtree_totals(tree: DataFrame, child: str = "child", parent: str = "parent", levels: int = 8) -> DataFrame:
    """Per vertex, the number of descendants (sum over children of child + 1).

    A tree of up to ``levels`` levels is summed level by level (``groupBy(parent)``,
    map-side combined, so a vertex with a huge fan-out is not a hot spot); a deeper
    one over its Euler tour, in rounds logarithmic in the number of vertices
    (:func:`_tour_totals`).  Repeated rows count once; rows without a parent are
    left out.  A vertex with two parents, and vertices that no root reaches (a
    parent cycle), raise a ValueError.
    """
    t = _cut(tree.select(F.col(child).alias("c"), F.col(parent).alias("p")).where(F.col("p").isNotNull()).distinct())
    if t.groupBy("c").count().where("count > 1").limit(1).count():
        raise ValueError("a vertex has two parents")
    nodes = t.select(F.col("c").alias("v")).unionByName(t.select(F.col("p").alias("v"))).distinct()
    roots = nodes.join(t.select(F.col("c").alias("v")), "v", "left_anti")
    layers = [_cut(roots)]
    while len(layers) <= levels:
        down = _cut(t.join(layers[-1].select(F.col("v").alias("p")), "p").select(F.col("c").alias("v")))
        if down.limit(1).count() == 0:
            return _layer_totals(t, layers, nodes.count())
        layers.append(down)
    return _tour_totals(t, layers[0])


def _layer_totals(t: DataFrame, layers: list[DataFrame], n: int) -> DataFrame:
    """Totals of one layer feed their parents in the layer above."""
    if sum(layer.count() for layer in layers) < n:
        raise ValueError("the parent links hold a cycle")
    done = [layers[-1].select("v", F.lit(0).cast("bigint").alias("total"))]
    for layer in reversed(layers[:-1]):
        up = t.join(done[-1].withColumnRenamed("v", "c"), "c").groupBy(F.col("p").alias("v")).agg(F.sum(F.col("total") + 1).alias("sub"))
        done.append(_cut(layer.join(up, "v", "left").select("v", F.coalesce("sub", F.lit(0)).cast("bigint").alias("total"))))
    return reduce(DataFrame.unionByName, done).select(F.col("v").alias("vertex"), F.col("total").alias("descendants"))


def _tour_totals(t: DataFrame, roots: DataFrame) -> DataFrame:
    """Descendants from an Euler tour, ranked by pointer jumping.

    Every edge is an arc down and an arc up.  Down to c goes on to c's first child,
    or up from c; up from c goes on to c's next sibling, or up from the parent,
    or ends at a root.  An arc's rank, the number of down arcs from it to the
    tour's end, comes from doubling its pointer: each round adds what the arc at
    the pointer has gathered and takes over its pointer.  The arcs down to c and
    up from c then differ by c and its descendants.  Siblings are ordered by a
    hash, whose leading bits are buckets: no parent's children are one task.
    """
    h = F.xxhash64("c")
    sib = with_neighbour(t.withColumn("_h", h), ["p"], ["_h", "c"], ["c"], F.shiftright(h, 48), "_sib")
    first = t.groupBy(F.col("p").alias("c")).agg(F.min_by("c", F.struct(h, "c")).alias("first"))
    ends = roots.select(F.col("v").alias("p"), F.lit(True).alias("_root"))
    arcs = sib.join(first, "c", "left").join(ends, "p", "left")
    to = lambda v, d: F.struct(v.alias("v"), F.lit(d).alias("d"))
    down = F.when(F.col("first").isNotNull(), to(F.col("first"), 0)).otherwise(to(F.col("c"), 1))
    up = F.when(F.col("_sib").isNotNull(), to(F.col("_sib.c"), 0)).when(F.col("_root").isNull(), to(F.col("p"), 1))
    state = _cut(arcs.select("p", F.inline(F.array(
        F.struct(F.col("c").alias("v"), F.lit(0).alias("d"), down.alias("to"), F.lit(1).cast("bigint").alias("rank")),
        F.struct(F.col("c").alias("v"), F.lit(1).alias("d"), up.alias("to"), F.lit(0).cast("bigint").alias("rank"))))))
    for _ in range(state.count().bit_length() + 1):
        if state.where(F.col("to").isNotNull()).limit(1).count() == 0:
            break
        ahead = state.select(F.col("v").alias("_v"), F.col("d").alias("_d"), F.col("to").alias("_to"), F.col("rank").alias("_rank"))
        state = _cut(state.join(ahead, (F.col("to.v") == F.col("_v")) & (F.col("to.d") == F.col("_d")), "left").select(
            "p", "v", "d", F.col("_to").alias("to"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank")))
    else:
        raise ValueError("the parent links hold a cycle")
    own = _cut(state.groupBy("v").agg(F.first("p").alias("p"), (F.sum(F.when(F.col("d") == 0, F.col("rank")).otherwise(-F.col("rank"))) - 1).alias("total")))
    top = roots.join(own.groupBy(F.col("p").alias("v")).agg(F.sum(F.col("total") + 1).alias("total")), "v")
    return own.select("v", "total").unionByName(top).select(F.col("v").alias("vertex"), F.col("total").cast("bigint").alias("descendants"))


__all__ = ["connected_components", "bfs_forest", "spanning_edges", "hooked_forest", "fundamental_cycles", "component_ids",
           "contract_graph", "subtree_totals"]
