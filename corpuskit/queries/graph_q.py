"""Graph queries: the part-supplier graph of ``lineitem`` (parts 2p,
suppliers 2s+1) and the region -> nation -> customer/supplier tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import graph as gr
from corpuskit.operators.ordering import with_row_index
from corpuskit.queries.common import table


def supply_edges(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    return with_row_index(e, ["src", "dst"], "eid").withColumn("eid", F.col("eid") - 1)


def q_connected_components(spark, d):
    return gr.connected_components(supply_edges(spark, d), "src", "dst")


def _cycles(spark, d):
    e = supply_edges(spark, d)
    return e, gr.fundamental_cycles(e, "src", "dst", "eid")


def q_cycle_edges(spark, d):
    return _cycles(spark, d)[1]


def q_contract_graph(spark, d):
    e, cyc = _cycles(spark, d)
    verts = e.select(F.col("src").alias("vertex")).unionByName(e.select(F.col("dst").alias("vertex"))).distinct()
    comp = gr.component_ids(verts, cyc)
    return gr.contract_graph(e, comp, "src", "dst")


def q_subtree_totals(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier")
    tree = (n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("child"),
                     F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("parent"))
            .unionByName(c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("child"),
                                  F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("parent")))
            .unionByName(s.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("child"),
                                  F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("parent"))))
    return gr.subtree_totals(tree)


QUERIES = {
    "connected_components": q_connected_components,
    "cycle_edges": q_cycle_edges,
    "contract_graph": q_contract_graph,
    "subtree_totals": q_subtree_totals,
}

# Shared CTEs: the edge table (eid by (src, dst) order), components, BFS
# depths from each component's smallest vertex, parents, climbing cycles.
GRAPH_CTE = """e0 AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS eid
       FROM (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem)),
sym AS (SELECT src AS u, dst AS v, eid FROM e0 UNION ALL SELECT dst, src, eid FROM e0),
verts AS (SELECT DISTINCT u AS v FROM sym),
lp(v, comp) USING KEY (v) AS (
  SELECT v, v FROM verts
  UNION
  SELECT n.v, min(lp.comp) FROM lp JOIN sym n ON n.u = lp.v JOIN recurring.lp cur ON cur.v = n.v
  GROUP BY n.v HAVING min(lp.comp) < min(cur.comp)),
dep(v, d) USING KEY (v) AS (
  SELECT v, 0 FROM lp WHERE v = comp
  UNION
  SELECT n.v, min(dep.d + 1) FROM dep JOIN sym n ON n.u = dep.v LEFT JOIN recurring.dep cur ON cur.v = n.v
  GROUP BY n.v HAVING min(dep.d + 1) < coalesce(min(cur.d), 9223372036854775807)),
par AS (SELECT c.v, min({'u': s.u, 'eid': s.eid}) AS p FROM dep c JOIN sym s ON s.v = c.v JOIN dep pu ON pu.v = s.u
        WHERE pu.d = c.d - 1 GROUP BY c.v),
node AS (SELECT dep.v, dep.d, par.p.u AS parent, par.p.eid AS peid FROM dep LEFT JOIN par USING (v)),
nontree AS (SELECT * FROM e0 WHERE eid NOT IN (SELECT peid FROM node WHERE peid IS NOT NULL)),
climb(cycle_id, x, y, xe, xs, xd, ye, ys, yd) AS (
  SELECT eid, src, dst, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM nontree
  UNION ALL
  SELECT c.cycle_id,
         CASE WHEN a.d >= b.d THEN a.parent ELSE c.x END, CASE WHEN b.d >= a.d THEN b.parent ELSE c.y END,
         CASE WHEN a.d >= b.d THEN a.peid END, CASE WHEN a.d >= b.d THEN c.x END, CASE WHEN a.d >= b.d THEN a.parent END,
         CASE WHEN b.d >= a.d THEN b.peid END, CASE WHEN b.d >= a.d THEN c.y END, CASE WHEN b.d >= a.d THEN b.parent END
  FROM climb c JOIN node a ON a.v = c.x JOIN node b ON b.v = c.y WHERE c.x <> c.y),
cyc AS (SELECT cycle_id, xe AS eid, xs AS src, xd AS dst FROM climb WHERE xe IS NOT NULL
        UNION ALL SELECT cycle_id, ye, ys, yd FROM climb WHERE ye IS NOT NULL
        UNION ALL SELECT eid, eid, src, dst FROM nontree)"""

SQL = {
    "cycle_edges": f"WITH RECURSIVE {GRAPH_CTE} SELECT cycle_id, eid, src, dst FROM cyc",
    "contract_graph": f"""WITH RECURSIVE {GRAPH_CTE},
        vc AS (SELECT v, min(cycle_id) AS cyc FROM (SELECT cycle_id, src AS v FROM cyc UNION ALL SELECT cycle_id, dst FROM cyc)
               GROUP BY v),
        ck AS (SELECT verts.v, CASE WHEN vc.cyc IS NOT NULL THEN vc.cyc
                      ELSE verts.v - (SELECT min(v) FROM verts) + (SELECT coalesce(max(cycle_id) + 1, 0) FROM cyc) END AS ck
               FROM verts LEFT JOIN vc USING (v)),
        cid AS (SELECT v, dense_rank() OVER (ORDER BY ck) - 1 AS comp_id FROM ck)
        SELECT cu.comp_id AS comp_from, cv.comp_id AS comp_to, e.src AS vertex_from, e.dst AS vertex_to
        FROM e0 e JOIN cid cu ON cu.v = e.src JOIN cid cv ON cv.v = e.dst WHERE cu.comp_id <> cv.comp_id
        UNION ALL
        SELECT cv.comp_id, cu.comp_id, e.dst, e.src
        FROM e0 e JOIN cid cu ON cu.v = e.src JOIN cid cv ON cv.v = e.dst WHERE cu.comp_id <> cv.comp_id""",
    "connected_components": """WITH RECURSIVE e0 AS (SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem),
        e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
        verts AS (SELECT DISTINCT a AS v FROM e),
        lp(v, comp) USING KEY (v) AS (
          SELECT v, v FROM verts
          UNION
          SELECT n.b, min(lp.comp) FROM lp JOIN e n ON n.a = lp.v JOIN recurring.lp cur ON cur.v = n.b
          GROUP BY n.b HAVING min(lp.comp) < min(cur.comp))
        SELECT v AS vertex, comp AS component FROM lp""",
    "subtree_totals": """WITH nc AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
        ns AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
        nt AS (SELECT n_nationkey, n_regionkey, coalesce(nc.n, 0) + coalesce(ns.n, 0) AS t
               FROM nation LEFT JOIN nc ON nc.k = n_nationkey LEFT JOIN ns ON ns.k = n_nationkey)
        SELECT 'r:' || CAST(n_regionkey AS VARCHAR) AS vertex, CAST(sum(t + 1) AS BIGINT) AS descendants FROM nt GROUP BY n_regionkey
        UNION ALL SELECT 'n:' || CAST(n_nationkey AS VARCHAR), CAST(t AS BIGINT) FROM nt
        UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 0::BIGINT FROM customer
        UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), 0::BIGINT FROM supplier""",
}
