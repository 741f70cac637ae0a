"""Queries over masks and octrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from standmill.functions.keys import hash_order_sql
from standmill.operators import lod, masks as ops, metrics
from standmill.plans.frame_queries import CENTERS, REGIONS, _r
from standmill.operators.frames import hashed_centers
from standmill.plans.registry import query
from standmill.sources.fixtures import MASKS_SQL, POINTS_SQL, mask_points, masks, points, votes

M, P = MASKS_SQL, POINTS_SQL


@query("m1_topk_masks", M + " SELECT scene_id, mask_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, mask_id) AS k FROM masks) WHERE k <= 20")
def _(spark, sf):
    return ops.topk_masks(masks(spark, sf), 20).select("scene_id", "mask_id", "score")


@query("m2_mask_quality", M + """, q AS (SELECT scene_id, mask_id, coalesce(sum(prob) FILTER (prob > 0.01), 0) / (count(*) FILTER (prob > 0.01) + CAST(1e-6 AS DOUBLE)) AS q FROM mask_points GROUP BY 1, 2)
SELECT scene_id, mask_id, round(score * q, 7) AS score FROM masks JOIN q USING (scene_id, mask_id)""")
def _(spark, sf):
    return ops.mask_quality(mask_points(spark, sf), masks(spark, sf)).select("scene_id", "mask_id", _r("score", 7))


OVER = M + """, area AS (SELECT scene_id, mask_id, count(*) AS a FROM mask_points GROUP BY 1, 2),
 over AS (SELECT a.scene_id, a.mask_id AS mask_a, b.mask_id AS mask_b, count(*) AS inter FROM mask_points a JOIN mask_points b ON a.scene_id = b.scene_id AND a.pid = b.pid AND a.mask_id < b.mask_id GROUP BY 1, 2, 3),
 pairs AS (SELECT o.*, x.a AS area_a, y.a AS area_b, inter / (x.a + y.a - inter) AS iou FROM over o JOIN area x ON o.scene_id = x.scene_id AND mask_a = x.mask_id JOIN area y ON o.scene_id = y.scene_id AND mask_b = y.mask_id)"""


@query("j6_mask_overlap", OVER + " SELECT scene_id, mask_a, mask_b, CAST(inter AS BIGINT) AS inter, round(iou, 9) AS iou, round(inter / area_a, 9) AS in_a, round(inter / area_b, 9) AS in_b FROM pairs")
def _(spark, sf):
    o = ops.mask_overlap(mask_points(spark, sf))
    return o.select("scene_id", "mask_a", "mask_b", F.col("inter").cast("long").alias("inter"), _r("iou", 9), _r("in_a", 9), _r("in_b", 9))


@query("j6_mask_overlap_weighted", M + """, area AS (SELECT scene_id, mask_id, sum(prob) AS a FROM mask_points GROUP BY 1, 2)
SELECT a.scene_id, a.mask_id AS mask_a, b.mask_id AS mask_b, round(sum(a.prob * b.prob), 6) AS inter FROM mask_points a JOIN mask_points b ON a.scene_id = b.scene_id AND a.pid = b.pid AND a.mask_id < b.mask_id GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ops.mask_overlap(mask_points(spark, sf), weighted=True).select("scene_id", "mask_a", "mask_b", _r("inter"))


def nms_sql(factor: str, most: str) -> str:
    return M + f""", r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, mask_id) AS rank FROM masks), rp AS (SELECT p.*, rank, label FROM mask_points p JOIN r USING (scene_id, mask_id)),
 ar AS (SELECT scene_id, rank, sum(prob) AS a FROM rp GROUP BY 1, 2),
 io AS (SELECT i.scene_id, i.rank AS ri, j.rank AS rj, sum(i.prob * j.prob) AS inter FROM rp i JOIN rp j ON i.scene_id = j.scene_id AND i.pid = j.pid AND i.label = j.label AND i.rank < j.rank GROUP BY 1, 2, 3),
 pr AS (SELECT io.scene_id, ri, rj, inter / (x.a + y.a - inter + CAST(1e-6 AS DOUBLE)) AS iou FROM io JOIN ar x ON io.scene_id = x.scene_id AND ri = x.rank JOIN ar y ON io.scene_id = y.scene_id AND rj = y.rank),
 cp AS (SELECT scene_id, rj AS ri, max(iou) AS comp FROM pr GROUP BY 1, 2),
 de AS (SELECT pr.scene_id, rj AS rank, min({factor}) AS decay FROM pr LEFT JOIN cp USING (scene_id, ri) GROUP BY 1, 2)
SELECT scene_id, mask_id, round(score * least({most}, coalesce(decay, {most})), 6) AS score FROM r LEFT JOIN de USING (scene_id, rank)"""


@query("m3_matrix_nms_linear", nms_sql("(1 - iou) / (1 - coalesce(comp, 0) + CAST(1e-6 AS DOUBLE))", "CAST(1 AS DOUBLE) / (1 + CAST(1e-6 AS DOUBLE))"))
def _(spark, sf):
    return ops.matrix_nms(mask_points(spark, sf), masks(spark, sf)).select("scene_id", "mask_id", _r("score"))


@query("m3_matrix_nms_gaussian", nms_sql("exp(-2 * iou * iou) / exp(-2 * coalesce(comp, 0) * coalesce(comp, 0))", "CAST(1 AS DOUBLE)"))
def _(spark, sf):
    return ops.matrix_nms(mask_points(spark, sf), masks(spark, sf), "gaussian").select("scene_id", "mask_id", _r("score"))


@query("m4_mask_filters", M + """, h AS (SELECT m.scene_id, mask_id, count(*) FILTER (sem_pred = 0) / count(*) AS ground, min(z) AS low, count(*) AS n FROM mask_points m JOIN points p ON m.scene_id = p.scene_id AND m.pid = p.pid WHERE prob > 0.15 GROUP BY 1, 2),
 t AS (SELECT scene_id, max(z) AS top FROM points WHERE sem_pred = 0 GROUP BY 1)
SELECT scene_id, mask_id, n AS n_points FROM masks JOIN h USING (scene_id, mask_id) LEFT JOIN t USING (scene_id) WHERE score > 0 AND ground <= 0.5 AND NOT coalesce(low > top + 5, false) AND n > 10""")
def _(spark, sf):
    return ops.mask_filters(mask_points(spark, sf), masks(spark, sf), points(spark, sf)).select("scene_id", "mask_id", "n_points")


@query("m5_edge_filter", M + f""", {CENTERS}, h AS (SELECT m.scene_id, mask_id, max((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM mask_points m JOIN points p ON m.scene_id = p.scene_id AND m.pid = p.pid JOIN centers c ON c.scene_id = m.scene_id GROUP BY 1, 2)
SELECT scene_id, mask_id FROM masks JOIN h USING (scene_id, mask_id) WHERE NOT (score > 0.4 AND d > CAST(39.5 * 39.5 AS DOUBLE))""")
def _(spark, sf):
    p = points(spark, sf)
    return ops.edge_filter(mask_points(spark, sf), masks(spark, sf), p, hashed_centers(p, 5), 40.0).select("scene_id", "mask_id")


BEST = M + ", best AS (SELECT scene_id, pid, mask_id, score FROM (SELECT m.scene_id, m.pid, m.mask_id, s.score, row_number() OVER (PARTITION BY m.scene_id, pid ORDER BY score DESC, m.mask_id) AS k FROM mask_points m JOIN masks s USING (scene_id, mask_id) WHERE score > 0) WHERE k = 1)"


@query("m6_best_mask_per_point", BEST + " SELECT * FROM best")
def _(spark, sf):
    return ops.best_mask_per_point(mask_points(spark, sf), masks(spark, sf))


@query("m7_semantic_vote", REGIONS + """, v AS (SELECT scene_id, pid, CAST((sem_pred + region_id % 5 % 2) % 3 AS INTEGER) AS class, count(*) AS n FROM inreg GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, pid ORDER BY n DESC, class) AS k FROM v)
SELECT p.scene_id, p.pid, coalesce(class, -1) AS sem_vote FROM points p LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON p.scene_id = b.scene_id AND p.pid = b.pid""")
def _(spark, sf):
    return ops.semantic_vote(votes(spark, sf), points(spark, sf))


@query("m8_clean_instances", P + ", b AS (SELECT pid, scene_id, CASE WHEN sem_pred = 0 THEN -1 ELSE inst_pred END AS i FROM points), n AS (SELECT *, count(*) OVER (PARTITION BY scene_id, i) AS n FROM b) SELECT pid, CASE WHEN i >= 0 AND n >= 60 THEN i ELSE -1 END AS inst_pred FROM n")
def _(spark, sf):
    return ops.clean_instances(points(spark, sf), 60).select("pid", "inst_pred")


@query("m9_merge_masks_by_score")
def _(spark, sf):
    return ops.merge_masks_by_score(mask_points(spark, sf), masks(spark, sf), points(spark, sf))


@query("m10_merge_masks_pairwise")
def _(spark, sf):
    return ops.merge_masks_pairwise(mask_points(spark, sf), masks(spark, sf)).select("scene_id", "mask_id")


@query("m11_merge_masks_by_iou", OVER.replace("WITH rows0", "WITH RECURSIVE rows0") + """, e AS (SELECT scene_id, mask_a AS a, mask_b AS b FROM pairs WHERE iou > 0.3 UNION SELECT scene_id, mask_b, mask_a FROM pairs WHERE iou > 0.3),
 walk(scene_id, mask_id, root) AS (SELECT scene_id, mask_id, mask_id FROM masks UNION SELECT w.scene_id, e.b, w.root FROM walk w JOIN e ON w.scene_id = e.scene_id AND w.mask_id = e.a),
 roots AS (SELECT scene_id, mask_id, min(root) AS root FROM walk GROUP BY 1, 2)
SELECT scene_id, root AS mask_id, max(score) AS score, count(*) AS n_masks FROM roots JOIN masks USING (scene_id, mask_id) GROUP BY 1, 2""")
def _(spark, sf):
    return ops.merge_masks_by_iou(mask_points(spark, sf), masks(spark, sf), 0.3)[1]


@query("m13_panoptic_map", BEST + """, l AS (SELECT scene_id, mask_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY mask_id) AS INTEGER) AS id FROM best GROUP BY 1, 2 HAVING count(*) > 10)
SELECT p.scene_id, p.pid, CAST(coalesce(id, CASE WHEN sem_pred < 1 THEN sem_pred ELSE 0 END) AS INTEGER) AS panoptic FROM points p LEFT JOIN best b ON p.scene_id = b.scene_id AND p.pid = b.pid LEFT JOIN l ON l.scene_id = b.scene_id AND l.mask_id = b.mask_id""")
def _(spark, sf):
    return ops.panoptic_map(mask_points(spark, sf), masks(spark, sf), points(spark, sf))


@query("m14_relabel_instances", P + ", r AS (SELECT scene_id, inst_pred, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY inst_pred) - 1 AS INTEGER) AS d FROM (SELECT DISTINCT scene_id, inst_pred FROM points WHERE inst_pred <> -1)) SELECT pid, coalesce(d, -1) AS final_id FROM points LEFT JOIN r USING (scene_id, inst_pred)")
def _(spark, sf):
    return ops.relabel_instances(points(spark, sf)).select("pid", "final_id")


@query("m15_sparse_match", P + """, c AS (SELECT scene_id, inst_gt AS gt_id, inst_pred AS query_id, CAST(1 - count(*) / 100 AS DOUBLE) AS cost FROM points WHERE inst_pred >= 0 AND inst_gt > 0 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, gt_id ORDER BY cost) AS k FROM c),
 l AS (SELECT *, min(CASE WHEN k = 4 THEN cost END) OVER (PARTITION BY scene_id, gt_id) AS lim FROM r) SELECT scene_id, gt_id, query_id, round(cost, 6) AS cost FROM l WHERE lim IS NULL OR cost < lim""")
def _(spark, sf):
    c = points(spark, sf).filter("inst_pred >= 0 AND inst_gt > 0").groupBy("scene_id", F.col("inst_gt").alias("gt_id"), F.col("inst_pred").alias("query_id")).agg((1 - F.count("*") / 100).alias("cost"))
    return ops.sparse_match(c, 3).select("scene_id", "gt_id", "query_id", _r("cost"))


# octrees

BOUNDS = P + """, e AS (SELECT scene_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY 1), s AS (SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) AS span FROM e),
 bounds AS (SELECT scene_id, n, (x0 + x1) / 2 - span / 2 - span * CAST(0.001 AS DOUBLE) AS min_x, (y0 + y1) / 2 - span / 2 - span * CAST(0.001 AS DOUBLE) AS min_y, (z0 + z1) / 2 - span / 2 - span * CAST(0.001 AS DOUBLE) AS min_z,
  span * CAST(1.002 AS DOUBLE) AS size FROM s)"""


@query("o1_octree_bounds", BOUNDS + " SELECT scene_id, n AS n_points, round(min_x, 6) AS min_x, round(min_z, 6) AS min_z, round(size, 6) AS size, CAST(CASE WHEN n / 8 < 200 THEN 1 WHEN n / 64 < 200 THEN 2 WHEN n / 512 < 200 THEN 3 ELSE 4 END AS INTEGER) AS depth FROM bounds")
def _(spark, sf):
    return lod.octree_bounds(points(spark, sf), 200, 4).select("scene_id", "n_points", _r("min_x"), _r("min_z"), _r("size"), "depth")


def keys_sql(depth: int) -> str:
    k = lambda a: f"CAST(floor(least(greatest(({a} - min_{a}) / size, 0), CAST(0.999999 AS DOUBLE)) * {1 << depth}) AS BIGINT)"
    digit = lambda b: f"((kx >> {b} & 1) + 2 * (ky >> {b} & 1) + 4 * (kz >> {b} & 1))"
    code = " + ".join(f"{digit(depth - 1 - i)} * {8 ** (depth - 1 - i)}" for i in range(depth))
    return BOUNDS + f", kk AS (SELECT p.*, {k('x')} AS kx, {k('y')} AS ky, {k('z')} AS kz FROM points p JOIN bounds USING (scene_id)), keyed AS (SELECT *, CAST({code} AS BIGINT) AS oct_key FROM kk)"


@query("o2_octree_keys", keys_sql(5) + " SELECT pid, oct_key, 'r' || (oct_key >> 12 & 7) || (oct_key >> 9 & 7) || (oct_key >> 6 & 7) || (oct_key >> 3 & 7) || (oct_key & 7) AS node FROM keyed")
def _(spark, sf):
    p = points(spark, sf)
    return lod.octree_keys(p, lod.octree_bounds(p), 5).select("pid", "oct_key", lod.key_name(F.col("oct_key"), 5).alias("node"))


LOD = keys_sql(3) + f""", l3 AS (SELECT * FROM (SELECT scene_id, pid, oct_key AS k3, row_number() OVER (PARTITION BY scene_id, oct_key ORDER BY {hash_order_sql('pid')}, pid) AS n FROM keyed) WHERE n <= 40),
 l2 AS (SELECT * FROM (SELECT scene_id, pid, k3 >> 3 AS k2, row_number() OVER (PARTITION BY scene_id, k3 >> 3 ORDER BY {hash_order_sql('pid')}, pid) AS n FROM l3) WHERE n <= 40),
 l1 AS (SELECT * FROM (SELECT scene_id, pid, k2 >> 3 AS k1, row_number() OVER (PARTITION BY scene_id, k2 >> 3 ORDER BY {hash_order_sql('pid')}, pid) AS n FROM l2) WHERE n <= 40),
 l0 AS (SELECT * FROM (SELECT scene_id, pid, row_number() OVER (PARTITION BY scene_id ORDER BY {hash_order_sql('pid')}, pid) AS n FROM l1) WHERE n <= 40),
 samples AS (SELECT scene_id, 'r' || (k3 >> 6 & 7) || (k3 >> 3 & 7) || (k3 & 7) AS node, pid FROM l3 UNION ALL SELECT scene_id, 'r' || (k2 >> 3 & 7) || (k2 & 7), pid FROM l2 UNION ALL SELECT scene_id, 'r' || (k1 & 7), pid FROM l1 UNION ALL SELECT scene_id, 'r', pid FROM l0),
 totals AS (SELECT scene_id, substr('r' || (oct_key >> 6 & 7) || (oct_key >> 3 & 7) || (oct_key & 7), 1, n) AS node, count(*) AS total FROM keyed, (VALUES (1), (2), (3), (4)) AS t(n) GROUP BY 1, 2)"""


@query("o3_build_lod_samples", LOD + " SELECT * FROM samples")
def _(spark, sf):
    p = points(spark, sf)
    return lod.build_lod(p, lod.octree_bounds(p), 3, 40)[0]


@query("o3_build_lod_nodes", LOD + """, c AS (SELECT t.scene_id, t.node, string_agg(DISTINCT substr(u.node, length(t.node) + 1, 1), '' ORDER BY substr(u.node, length(t.node) + 1, 1)) AS children FROM totals t JOIN totals u ON u.scene_id = t.scene_id AND length(u.node) = length(t.node) + 1 AND starts_with(u.node, t.node) GROUP BY 1, 2),
 n AS (SELECT scene_id, node, count(*) AS count FROM samples GROUP BY 1, 2) SELECT scene_id, node, count, total, coalesce(children, '') AS children FROM n JOIN totals USING (scene_id, node) LEFT JOIN c USING (scene_id, node)""")
def _(spark, sf):
    p = points(spark, sf)
    return lod.build_lod(p, lod.octree_bounds(p), 3, 40)[1].withColumn("children", F.concat_ws("", F.transform("children", lambda c: c.cast("string"))))


OWN = keys_sql(4) + f""", own AS (SELECT scene_id, CASE WHEN n / 8 < 200 THEN 1 WHEN n / 64 < 200 THEN 2 WHEN n / 512 < 200 THEN 3 ELSE 4 END AS depth FROM bounds),
 named AS (SELECT scene_id, pid, substr('r' || (oct_key >> 9 & 7) || (oct_key >> 6 & 7) || (oct_key >> 3 & 7) || (oct_key & 7), 1, k) AS node FROM keyed JOIN own USING (scene_id), (VALUES (1), (2), (3), (4), (5)) AS t(k) WHERE k <= depth + 1)
 SELECT scene_id, node, pid FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, node ORDER BY {hash_order_sql('pid')}, pid) AS place FROM named) WHERE place <= 40"""


@query("o3_build_lod_own_depth", OWN)
def _(spark, sf):
    p = points(spark, sf)
    return lod.build_lod(p, lod.octree_bounds(p, 200, 4), None, 40)[0]


@query("o4_write_lod", LOD + " SELECT CAST(scene_id AS INTEGER) AS scene_id, node, count(*) AS n FROM samples GROUP BY 1, 2")
def _(spark, sf):
    from standmill.sources.storage import new_path

    p, path = points(spark, sf), new_path(spark)
    lod.write_lod(*lod.build_lod(p, lod.octree_bounds(p), 3, 40), p, path)
    return spark.read.parquet(f"{path}/points").groupBy("scene_id", "node").agg(F.count("*").alias("n"))


@query("o4_lod_binary", LOD + f""" SELECT s.scene_id, node, CAST(row_number() OVER (PARTITION BY s.scene_id, node ORDER BY {hash_order_sql('pid')}, pid) - 1 AS INTEGER) AS place, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS z,
 CAST(CASE WHEN inst_pred >= 0 THEN 255 WHEN sem_pred = 0 THEN 128 ELSE 0 END AS INTEGER) AS flag FROM samples s JOIN points p USING (scene_id, pid)""")
def _(spark, sf):
    """The points of all nodes as they are read back from their ranges of bytes."""
    from standmill.sources.storage import new_path

    p, path = points(spark, sf), new_path(spark)
    bounds = lod.octree_bounds(p)
    lod.write_lod_binary(*lod.build_lod(p, bounds, 3, 40), p, bounds, path, 20_000)
    found = lod.read_lod_binary(spark, path)
    return found.select("scene_id", "node", "place", F.round(F.col("x").cast("double"), 4).alias("x"), F.round(F.col("z").cast("double"), 4).alias("z"), F.col("flag").cast("int").alias("flag"))
