"""Queries over frames, tiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from standmill.functions.keys import hash_order_sql
from standmill.operators import frames, metrics, tiles
from standmill.plans.registry import query
from standmill.sources.fixtures import MASKS_SQL, POINTS_SQL, mask_points, masks, points

P = POINTS_SQL
H = hash_order_sql


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c), n).alias(c)


def _annotated(spark, sf):
    return points(spark, sf).withColumns({"semantic_seg": F.col("sem_gt") + 1, "tree_id": F.col("inst_gt")})


# coordinates and labels


@query("p1_normalize_coords", P + """, o AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my, min(z) AS mz FROM points GROUP BY 1)
SELECT p.scene_id, pid, round(x - mx, 9) AS x, round(y - my, 9) AS y, round(z - mz, 9) AS z FROM points p JOIN o USING (scene_id)""")
def _(spark, sf):
    return frames.normalize_coords(points(spark, sf)).select("scene_id", "pid", _r("x", 9), _r("y", 9), _r("z", 9))


@query("p1_normalize_coords_global", P + """, o AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my FROM points GROUP BY 1), g AS (SELECT min(z) AS mz FROM points)
SELECT p.scene_id, pid, round(CASE WHEN p.scene_id = 3 THEN x ELSE x - mx END, 9) AS x, round(CASE WHEN p.scene_id = 3 THEN y ELSE y - my END, 9) AS y,
  round(CASE WHEN p.scene_id = 3 THEN z ELSE z - mz END, 9) AS z FROM points p JOIN o USING (scene_id), g""")
def _(spark, sf):
    moved = frames.normalize_coords(points(spark, sf), z_ref="global", unmoved=F.col("scene_id") == 3)
    return moved.select("scene_id", "pid", _r("x", 9), _r("y", 9), _r("z", 9))


@query("p2_restore_coords", P + " SELECT pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points")
def _(spark, sf):
    return frames.restore_coords(frames.normalize_coords(points(spark, sf))).select("pid", _r("x"), _r("y"), _r("z"))


@query("p3_prepare_labels", P + " SELECT pid, sem_gt AS semantic, CASE WHEN sem_gt = 0 THEN 0 ELSE inst_gt END AS instance FROM points")
def _(spark, sf):
    return frames.prepare_labels(_annotated(spark, sf)).select("pid", "semantic", "instance")


@query("p4_drop_ignored", P + " SELECT pid, sem_gt FROM points WHERE sem_gt NOT IN (1)")
def _(spark, sf):
    return frames.drop_ignored(points(spark, sf), [1], "sem_gt").select("pid", "sem_gt")


@query("p4_mark_ignored", P + " SELECT pid, CASE WHEN sem_gt = 2 THEN -1 ELSE sem_gt END AS sem_gt, CASE WHEN sem_gt = 2 THEN -1 ELSE inst_gt END AS inst_gt FROM points")
def _(spark, sf):
    return frames.mark_ignored(points(spark, sf), 2, "sem_gt", "inst_gt").select("pid", "sem_gt", "inst_gt")


@query("p5_background_instances", P + " SELECT pid, CASE WHEN sem_gt = 0 THEN -1 ELSE inst_gt END AS inst_gt, sem_gt <> 0 AS foreground FROM points")
def _(spark, sf):
    return frames.background_instances(points(spark, sf), "sem_gt", "inst_gt").select("pid", "inst_gt", "foreground")


@query("p6_binary_classes", P + " SELECT pid, CAST(CASE WHEN sem_pred + 1 = 1 THEN 1 WHEN sem_pred + 1 IN (2, 3) THEN 2 ELSE 0 END AS INTEGER) AS b FROM points")
def _(spark, sf):
    return points(spark, sf).select("pid", frames.binary_class(F.col("sem_pred")).alias("b"))


@query("p7_range_filter", P + " SELECT pid FROM points WHERE x > 10 AND x < 50 AND y > 20 AND y < 80 AND z > 0 AND z < 12")
def _(spark, sf):
    return frames.range_filter(points(spark, sf), (10, 20, 0), (50, 80, 12)).select("pid")


@query("p8_center_crop", P + """, m AS (SELECT scene_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM points GROUP BY 1)
SELECT pid FROM points JOIN m USING (scene_id) WHERE abs(x - mx) <= 20 AND abs(y - my) <= 20""")
def _(spark, sf):
    return frames.center_crop(points(spark, sf), 20).select("pid")


CENTERS = f"""centers AS (SELECT scene_id, x AS cx, y AS cy FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {H('pid', 5)}, pid) AS k FROM points) WHERE k = 1)"""


@query("p9_cylinder_crop", P + f", {CENTERS} SELECT p.scene_id, pid FROM points p JOIN centers c USING (scene_id) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) < CAST(256 AS DOUBLE)")
def _(spark, sf):
    p = points(spark, sf)
    return frames.cylinder_crop(p, frames.hashed_centers(p, 5), 16).select("scene_id", "pid")


@query("p10_color_instances", P + """ SELECT pid, CAST(CASE WHEN inst_pred >= 0 THEN inst_pred % 26 WHEN sem_pred = 0 THEN -1 ELSE -2 END AS INTEGER) AS colour,
  CAST(CASE WHEN inst_pred >= 0 THEN 255 WHEN sem_pred = 0 THEN 128 ELSE 0 END AS INTEGER) AS flag FROM points""")
def _(spark, sf):
    return frames.color_instances(points(spark, sf)).select("pid", F.col("colour").cast("int"), F.col("flag").cast("int"))


@query("p10_color_semantic", P + " SELECT pid, CASE WHEN sem_pred IN (0, 1, 2) THEN sem_pred ELSE 3 END AS colour FROM points")
def _(spark, sf):
    return frames.color_semantic(points(spark, sf)).select("pid", "colour")


@query("p11_normalize_color", P + " SELECT pid, (x - CAST(50 AS DOUBLE)) / CAST(25 AS DOUBLE) AS x, (y - CAST(40 AS DOUBLE)) / CAST(20 AS DOUBLE) AS y FROM points")
def _(spark, sf):
    return frames.normalize_color(points(spark, sf), (50, 40), (25, 20), ("x", "y")).select("pid", "x", "y")


@query("p12_align", P + " SELECT pid, round(-y + scene_id, 6) AS x, round(x - 2, 6) AS y, round(z + CAST(0.5 AS DOUBLE), 6) AS z FROM points")
def _(spark, sf):
    p = points(spark, sf)
    d = lambda v: F.lit(float(v))
    m = F.array(d(0), d(-1), d(0), F.col("scene_id").cast("double"), d(1), d(0), d(0), d(-2), d(0), d(0), d(1), d(0.5), d(0), d(0), d(0), d(1))
    return frames.align(p, p.select("scene_id").distinct().select("scene_id", m.alias("m"))).select("pid", _r("x"), _r("y"), _r("z"))


@query("p13_random_flip", P + f" SELECT pid, CASE WHEN {H('scene_id', 3)} / CAST(2147483647 AS DOUBLE) < 0.5 THEN -y ELSE y END AS y, {H('scene_id', 3)} / CAST(2147483647 AS DOUBLE) < 0.5 AS flipped FROM points")
def _(spark, sf):
    return frames.random_flip(points(spark, sf), seed=3).select("pid", "y", "flipped")


def _u(pid: str, seed: int) -> str:
    return f"({H(pid, seed)} / CAST(2147483647 AS DOUBLE))"


@query("p14_random_rot_scale_trans", P + f""", t AS (SELECT *, ({_u('scene_id', 1)} * 2 - 1) * CAST(0.7 AS DOUBLE) AS a, {_u('scene_id', 2)} * CAST(1.2 - 0.8 AS DOUBLE) + CAST(0.8 AS DOUBLE) AS s,
  ({_u('scene_id', 3)} * 2 - 1) * CAST(0.1 AS DOUBLE) AS tx, ({_u('scene_id', 4)} * 2 - 1) * CAST(0.1 AS DOUBLE) AS ty, ({_u('scene_id', 5)} * 2 - 1) * CAST(0.1 AS DOUBLE) AS tz FROM points)
SELECT pid, round((x * cos(a) - y * sin(a)) * s + tx, 6) AS x, round((x * sin(a) + y * cos(a)) * s + ty, 6) AS y, round(z * s + tz, 6) AS z FROM t""")
def _(spark, sf):
    return frames.random_rot_scale_trans(points(spark, sf), 0.7, (0.8, 1.2), 0.1, seed=1).select("pid", _r("x"), _r("y"), _r("z"))


@query("p15_jitter", P + f""", n AS (SELECT *, sqrt(-2 * ln(1 - {_u('pid', 1)})) * cos(2 * CAST(3.141592653589793 AS DOUBLE) * {_u('pid', 2)}) * CAST(0.01 AS DOUBLE) AS nx FROM points)
SELECT pid, round(x + greatest(CAST(-0.02 AS DOUBLE), least(CAST(0.02 AS DOUBLE), nx)), 6) AS x FROM n""")
def _(spark, sf):
    return frames.jitter(points(spark, sf), 0.01, 0.02).select("pid", _r("x"))


@query("p16_elastic_distort")
def _(spark, sf):
    return frames.elastic_distort(points(spark, sf), 6.0, 0.4, seed=2).select("pid", _r("x", 4), _r("y", 4), _r("z", 4))


@query("p17_voxel_features", P + """, s AS (SELECT scene_id, min(z) AS low FROM points GROUP BY 1)
SELECT pid, round(x - (floor(x / 2) + 0.5) * 2, 6) AS fx, round(y - (floor(y / 2) + 0.5) * 2, 6) AS fy, round(z - low, 6) AS fz FROM points JOIN s USING (scene_id)""")
def _(spark, sf):
    return frames.voxel_features(points(spark, sf), "cell").select("pid", _r("fx"), _r("fy"), _r("fz"))


@query("p18_split_leftover", P + """, q AS (SELECT *, CASE WHEN pid // 3 % 6 <> 3 THEN CAST(pid // 3 % 3 AS INTEGER) ELSE sem_pred END AS sem FROM points),
 l AS (SELECT *, sem <> 0 AND inst_pred = -1 AS leftover FROM q)
SELECT pid, leftover, sem AS sem_pred, CASE WHEN leftover THEN sem_gt + 1 END AS semantic_seg, CASE WHEN leftover THEN inst_gt END AS tree_id FROM l""")
def _(spark, sf):
    """Every point, with the part it is in. The round before has no class for a sixth of them, which keep their own."""
    p = points(spark, sf)
    turn = F.floor(F.col("pid") / 3)
    previous = p.select("pid", F.when(turn % 6 != 3, turn % 3).cast("int").alias("semantic_pred"))
    again, others = frames.split_leftover(p, previous)
    both = again.withColumn("leftover", F.lit(True)).unionByName(others.withColumn("leftover", F.lit(False)), allowMissingColumns=True)
    return both.select("pid", "leftover", "sem_pred", "semantic_seg", "tree_id")


@query("p19_filter_scenes", P + ", q AS (SELECT scene_id, CASE WHEN inst_gt % 8 >= scene_id THEN inst_gt ELSE -1 END AS inst_gt FROM points) SELECT scene_id, count(*) AS n FROM q WHERE scene_id IN (SELECT scene_id FROM q GROUP BY 1 HAVING count(DISTINCT inst_gt) >= 12) GROUP BY 1")
def _(spark, sf):
    """Scenes keep the fewer instances the higher their number is."""
    return frames.filter_scenes(points(spark, sf).withColumn("inst_gt", F.when(F.col("inst_gt") % 8 >= F.col("scene_id"), F.col("inst_gt")).otherwise(-1)), 12).groupBy("scene_id").agg(F.count("*").alias("n"))


BOXES = """boxes AS (SELECT scene_id, inst_gt AS box_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz,
  max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz, CAST(1 AS INTEGER) AS label FROM points WHERE inst_gt > 0 GROUP BY 1, 2)"""


@query("p20_filter_boxes", P + f""", {BOXES}, y AS (SELECT *, CAST(box_id AS DOUBLE) AS yaw FROM boxes)
SELECT scene_id, box_id, round(yaw - floor((yaw + CAST(3.141592653589793 AS DOUBLE)) / (2 * CAST(3.141592653589793 AS DOUBLE))) * (2 * CAST(3.141592653589793 AS DOUBLE)), 6) AS yaw
FROM y WHERE cx > 10 AND cx < 80 AND cy > 10 AND cy < 80""")
def _(spark, sf):
    boxes = metrics.instance_boxes(points(spark, sf)).withColumn("yaw", F.col("box_id").cast("double"))
    return frames.filter_boxes(boxes, (10, 10, 80, 80), [1]).select("scene_id", "box_id", _r("yaw"))


# tiles

SIZE, GROW = 25.0, 2.5
TILES = P + f""", ext AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1,
    greatest(1, CAST(ceil((max(x) - min(x)) / CAST({SIZE} AS DOUBLE)) AS BIGINT)) AS nx, greatest(1, CAST(ceil((max(y) - min(y)) / CAST({SIZE} AS DOUBLE)) AS BIGINT)) AS ny FROM points GROUP BY 1),
 grid AS (SELECT scene_id, x0, y0, z0, x1, y1, i AS ix, j AS iy FROM ext, range(100) AS a(i), range(100) AS b(j) WHERE i < nx AND j < ny),
 held AS (SELECT p.*, ix, iy FROM points p JOIN grid g USING (scene_id) WHERE x >= x0 + ix * CAST({SIZE} AS DOUBLE) - CAST({GROW} AS DOUBLE) AND x <= x0 + (ix + 1) * CAST({SIZE} AS DOUBLE) + CAST({GROW} AS DOUBLE)
   AND y >= y0 + iy * CAST({SIZE} AS DOUBLE) - CAST({GROW} AS DOUBLE) AND y <= y0 + (iy + 1) * CAST({SIZE} AS DOUBLE) + CAST({GROW} AS DOUBLE)),
 cnt AS (SELECT scene_id, ix, iy, count(*) AS n_points, avg(x) AS off_x, avg(y) AS off_y FROM held GROUP BY 1, 2, 3 HAVING count(*) >= 20),
 numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ix, iy) - 1 AS INTEGER) AS tile_id FROM cnt),
 tiled AS (SELECT h.*, tile_id FROM held h JOIN numbered USING (scene_id, ix, iy))"""


def _tiled(spark, sf):
    return tiles.assign_tiles(points(spark, sf), SIZE, GROW, 20)


@query("j1_assign_tiles", TILES + " SELECT scene_id, pid, tile_id FROM tiled")
def _(spark, sf):
    return _tiled(spark, sf).select("scene_id", "pid", "tile_id")


@query("j1_tile_meta", TILES + f""" SELECT n.scene_id, tile_id, n_points, round(off_x, 9) AS off_x, round(off_y, 9) AS off_y, z0 AS off_z, round(x0 + ix * CAST({SIZE} AS DOUBLE) - CAST({GROW} AS DOUBLE), 6) AS low_x,
 round(least(x0 + (ix + 1) * CAST({SIZE} AS DOUBLE), x1), 6) AS core_high_x FROM numbered n JOIN ext e USING (scene_id)""")
def _(spark, sf):
    return tiles.tile_meta(points(spark, sf), SIZE, GROW, 20).select("scene_id", "tile_id", "n_points", _r("off_x", 9), _r("off_y", 9), "off_z", _r("low_x"), _r("core_high_x"))


PREDS = TILES + """, preds AS (SELECT scene_id, pid, tile_id, sem_pred AS semantic_pred, inst_pred AS instance_pred, CAST((pid * 31 + tile_id * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM tiled),
 tmax AS (SELECT scene_id, tile_id, max(instance_pred) AS m FROM preds GROUP BY 1, 2),
 toff AS (SELECT *, CAST(coalesce(sum(CASE WHEN m >= 0 THEN m + 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS id_offset FROM tmax),
 ranked AS (SELECT p.*, id_offset, row_number() OVER (PARTITION BY p.scene_id, pid ORDER BY score DESC, p.tile_id) AS k FROM preds p JOIN toff USING (scene_id, tile_id) WHERE score > -1),
 merged AS (SELECT p.scene_id, p.pid, coalesce(semantic_pred, -1) AS sem_pred, CAST(coalesce(CASE WHEN instance_pred >= 0 THEN instance_pred + id_offset ELSE -1 END, -1) AS BIGINT) AS inst_pred,
   coalesce(r.score, CAST(-1 AS DOUBLE)) AS score FROM points p LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON p.scene_id = r.scene_id AND p.pid = r.pid)"""


def tile_preds(spark, sf):
    score = ((F.col("pid") * 31 + F.col("tile_id") * 17) % 100).cast("double") / F.lit(100.0)
    return _tiled(spark, sf).select("scene_id", "pid", "tile_id", F.col("sem_pred").alias("semantic_pred"), F.col("inst_pred").alias("instance_pred"), score.alias("score"))


def merged(spark, sf):
    return tiles.merge_tile_predictions(tile_preds(spark, sf), points(spark, sf))


@query("j3_merge_tile_predictions", PREDS + " SELECT * FROM merged")
def _(spark, sf):
    return merged(spark, sf)


@query("w4_running_offsets", PREDS + " SELECT scene_id, tile_id, id_offset FROM toff")
def _(spark, sf):
    p = tile_preds(spark, sf).groupBy("scene_id", "tile_id").agg(F.max("instance_pred").alias("max_instance"))
    return tiles.running_offsets(p).select("scene_id", "tile_id", "id_offset")


REGIONS = P + """, ext AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, CAST(floor((max(x) - min(x)) / 4) AS BIGINT) AS lx, CAST(floor((max(y) - min(y)) / 4) AS BIGINT) AS ly FROM points GROUP BY 1),
 lattice AS (SELECT scene_id, i AS gx, j AS gy, x0 + i * CAST(4 AS DOUBLE) AS cx, y0 + j * CAST(4 AS DOUBLE) AS cy, i * (ly + 1) + j AS region_id FROM ext, range(60) AS a(i), range(60) AS b(j) WHERE i <= lx AND j <= ly),
 inreg AS (SELECT p.*, region_id FROM points p JOIN lattice USING (scene_id) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= CAST(256 AS DOUBLE))"""


@query("j2_assign_regions", REGIONS + " SELECT scene_id, region_id, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM inreg GROUP BY 1, 2")
def _(spark, sf):
    return tiles.assign_regions(points(spark, sf), 16.0).groupBy("scene_id", "region_id").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


# metrics


@query("a1_scene_extent", P + " SELECT scene_id, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z, round(max(y) - min(y), 6) AS extent_y FROM points GROUP BY 1")
def _(spark, sf):
    return tiles.scene_extent(points(spark, sf)).select("scene_id", "n_points", "min_x", "max_x", "min_z", "max_z", _r("extent_y"))


@query("a2_scene_stats", P + """ SELECT scene_id, count(*) AS n_original, count(DISTINCT inst_pred) FILTER (inst_pred >= 0) AS n_trees, count(*) FILTER (inst_pred >= 0) AS n_assigned,
  count(*) FILTER (sem_pred = 0) AS ground, count(*) FILTER (sem_pred = 1) AS wood, count(*) FILTER (sem_pred = 2) AS leaf FROM points GROUP BY 1""")
def _(spark, sf):
    return metrics.scene_stats(points(spark, sf))


def tree_sql(source: str, least: int = 10) -> str:
    return f"""trees0 AS (SELECT scene_id, inst_pred AS tree_id, count(*) AS n_points, min(z) AS z0, max(z) AS z1, greatest(max(x) - min(x), max(y) - min(y)) AS w, count(*) FILTER (sem_pred = 1) AS wood_points,
  count(*) FILTER (sem_pred = 2) AS leaf_points, CAST(sum(CAST(score AS DECIMAL(20, 9))) AS DOUBLE) / count(score) AS s, CAST(sum(CAST(x AS DECIMAL(20, 9))) AS DOUBLE) / count(x) AS mx, CAST(sum(CAST(y AS DECIMAL(20, 9))) AS DOUBLE) / count(y) AS my FROM {source} WHERE inst_pred >= 0 GROUP BY 1, 2 HAVING count(*) >= {least}),
 trees AS (SELECT scene_id, tree_id, n_points, (round_even((z1 - z0) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS height_m, (round_even((w) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS crown_width_m, CASE WHEN z1 - z0 > 0.1 THEN (round_even((w / (z1 - z0)) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) END AS crown_ratio, wood_points, leaf_points,
  CASE WHEN wood_points >= 20 AND leaf_points > 0 AND leaf_points / wood_points <= 300 THEN (round_even((leaf_points / wood_points) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) END AS leaf_wood_ratio, (round_even((s) * CAST(1000 AS DOUBLE), 0) / CAST(1000 AS DOUBLE)) AS mean_score,
  (round_even((mx) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS center_x, (round_even((my) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS center_y, (round_even((z0) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS base_z FROM trees0)"""


@query("a3_tree_metrics", P + ", " + tree_sql("points") + " SELECT * FROM trees")
def _(spark, sf):
    return metrics.tree_metrics(points(spark, sf))


@query("a4_ground_height", P + " SELECT scene_id, coalesce(quantile_cont(z, 0.5) FILTER (sem_pred = 0), min(z)) AS ground_z FROM points GROUP BY 1")
def _(spark, sf):
    return metrics.ground_height(points(spark, sf))


TOP = P + ", " + tree_sql("points") + ", top AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY height_m DESC, tree_id) AS INTEGER) AS rank FROM trees)"


@query("a5_stand_summary", TOP + """ SELECT scene_id, count(*) AS n_trees, (round_even((min(height_m)) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE)) AS height_min, (round_even((max(height_m)) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE)) AS height_max, (round_even((avg(height_m)) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE)) AS height_mean,
  (round_even((avg(leaf_wood_ratio)) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS leaf_wood_ratio_mean, string_agg(CAST(tree_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 5) AS tallest FROM top GROUP BY 1""")
def _(spark, sf):
    s = metrics.stand_summary(metrics.tree_metrics(points(spark, sf)))
    return s.withColumn("tallest", F.concat_ws(",", F.transform("tallest", lambda t: t["tree_id"].cast("string"))))


@query("w2_rank_trees", TOP + " SELECT scene_id, tree_id, height_m, rank FROM top WHERE rank <= 7")
def _(spark, sf):
    return metrics.top_trees(metrics.tree_metrics(points(spark, sf)), 7).select("scene_id", "tree_id", "height_m", "rank")


@query("a6_instance_boxes", P + f", {BOXES} SELECT scene_id, box_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, label FROM boxes")
def _(spark, sf):
    return metrics.instance_boxes(points(spark, sf)).select("scene_id", "box_id", *[_r(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz")], "label")


@query("a7_semantic_confusion", P + " SELECT sem_gt AS gt, sem_pred AS pred, count(*) AS n FROM points GROUP BY 1, 2")
def _(spark, sf):
    return metrics.semantic_confusion(points(spark, sf))


IOU = P + """, c AS (SELECT k AS class, count(*) FILTER (sem_gt = k) AS n_gt, count(*) FILTER (sem_pred = k) AS n_pred, count(*) FILTER (sem_gt = k AND sem_pred = k) AS tp FROM points, range(3) AS t(k) GROUP BY 1),
 i AS (SELECT CAST(class AS INTEGER) AS class, n_gt, n_pred, tp, tp / (n_gt + n_pred - tp + CAST(1e-8 AS DOUBLE)) AS iou FROM c)"""


@query("a7_class_iou", IOU + " SELECT class, n_gt, n_pred, tp, round(iou, 9) AS iou FROM i")
def _(spark, sf):
    return metrics.class_iou(metrics.semantic_confusion(points(spark, sf))).select("class", "n_gt", "n_pred", "tp", _r("iou", 9))


@query("a7_mean_iou", IOU + " SELECT count(*) AS n_classes, round(avg(iou), 9) AS miou FROM i WHERE n_gt > 0 AND class <> 0")
def _(spark, sf):
    return metrics.mean_iou(metrics.class_iou(metrics.semantic_confusion(points(spark, sf)))).select("n_classes", _r("miou", 9))


@query("a7_confusion_rollup", P + " SELECT coalesce(scene_id, -1) AS scene_id, coalesce(sem_gt, -1) AS sem_gt, count(*) AS n, count(*) FILTER (sem_gt = sem_pred) AS tp FROM points GROUP BY ROLLUP (scene_id, sem_gt)")
def _(spark, sf):
    return points(spark, sf).rollup("scene_id", "sem_gt").agg(F.count("*").alias("n"), F.count_if(F.col("sem_gt") == F.col("sem_pred")).alias("tp")).na.fill(-1)


@query("j5_instance_overlap", P + """, c AS (SELECT scene_id, inst_pred, inst_gt, count(*) AS inter FROM points GROUP BY 1, 2, 3)
SELECT c.scene_id, c.inst_pred, c.inst_gt, inter, n_pred, n_gt, inter / (n_pred + n_gt - inter) AS iou FROM c
 JOIN (SELECT scene_id, inst_pred, count(*) AS n_pred FROM points GROUP BY 1, 2) p USING (scene_id, inst_pred) JOIN (SELECT scene_id, inst_gt, count(*) AS n_gt FROM points GROUP BY 1, 2) g USING (scene_id, inst_gt)
WHERE inst_pred >= 0""")
def _(spark, sf):
    return metrics.instance_overlap(points(spark, sf), "inst_pred", "inst_gt").select("scene_id", "inst_pred", "inst_gt", "inter", "n_pred", "n_gt", "iou")


EVAL = P + """, kept AS (SELECT * FROM points WHERE NOT (sem_gt = 0 AND sem_pred = 0)),
 pc AS (SELECT scene_id, inst_pred, CASE sem_pred WHEN 0 THEN 1 ELSE 2 END AS b, count(*) AS n FROM kept WHERE inst_pred >= 0 GROUP BY 1, 2, 3),
 pi AS (SELECT scene_id, inst_pred FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, inst_pred ORDER BY n DESC, b) AS k FROM pc) WHERE k = 1 AND b = 2),
 gc AS (SELECT scene_id, inst_gt, CASE sem_gt WHEN 0 THEN 1 ELSE 2 END AS b, count(*) AS n FROM kept WHERE inst_gt > 0 GROUP BY 1, 2, 3),
 gi AS (SELECT scene_id, inst_gt FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, inst_gt ORDER BY n DESC, b) AS k FROM gc) WHERE k = 1 AND b = 2),
 np AS (SELECT scene_id, inst_pred, count(*) AS n_pred FROM kept JOIN pi USING (scene_id, inst_pred) GROUP BY 1, 2), ng AS (SELECT scene_id, inst_gt, count(*) AS n_gt FROM kept JOIN gi USING (scene_id, inst_gt) GROUP BY 1, 2),
 pr AS (SELECT scene_id, inst_pred, inst_gt, n / (n_pred + n_gt - n) AS iou FROM (SELECT scene_id, inst_pred, inst_gt, count(*) AS n FROM kept GROUP BY 1, 2, 3) JOIN np USING (scene_id, inst_pred) JOIN ng USING (scene_id, inst_gt)),
 bp AS (SELECT scene_id, inst_pred, coalesce(max(iou), 0) AS iou FROM np LEFT JOIN pr USING (scene_id, inst_pred) GROUP BY 1, 2),
 bg AS (SELECT scene_id, inst_gt, n_gt, coalesce(max(iou), 0) AS iou FROM ng LEFT JOIN pr USING (scene_id, inst_gt) GROUP BY 1, 2, 3),
 ev AS (SELECT s.scene_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n_gt, 0) AS n_gt, coalesce(tp_iou, 0) AS tp_iou, CASE WHEN tp IS NOT NULL THEN cov END AS cov, CASE WHEN tp IS NOT NULL THEN wcov END AS wcov
  FROM (SELECT DISTINCT scene_id FROM kept) s
  LEFT JOIN (SELECT scene_id, count(*) FILTER (iou >= 0.5) AS tp, count(*) FILTER (iou < 0.5) AS fp, coalesce(sum(iou) FILTER (iou >= 0.5), 0) AS tp_iou FROM bp GROUP BY 1) USING (scene_id)
  LEFT JOIN (SELECT scene_id, count(*) AS n_gt, avg(iou) AS cov, sum(iou * n_gt) / sum(n_gt) AS wcov FROM bg GROUP BY 1) USING (scene_id))"""


@query("a8_eval_instances", EVAL + " SELECT scene_id, tp, fp, n_gt, round(tp_iou, 9) AS tp_iou, round(cov, 9) AS cov, round(wcov, 9) AS wcov FROM ev")
def _(spark, sf):
    return metrics.eval_instances(points(spark, sf)).select("scene_id", "tp", "fp", "n_gt", _r("tp_iou", 9), _r("cov", 9), _r("wcov", 9))


@query("a9_aggregate_eval", EVAL + """, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(n_gt) AS n_gt, sum(tp_iou) AS tp_iou, avg(cov) AS mucov, avg(wcov) AS mwcov FROM ev),
 m AS (SELECT tp / (tp + fp + CAST(1e-8 AS DOUBLE)) AS p, tp / (n_gt + CAST(1e-8 AS DOUBLE)) AS r, tp_iou / (tp + CAST(1e-8 AS DOUBLE)) AS sq, mucov, mwcov FROM t), f AS (SELECT *, 2 * p * r / (p + r + CAST(1e-8 AS DOUBLE)) AS rq FROM m)
SELECT (round_even((p) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS precision, (round_even((r) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS recall, (round_even((rq) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS rq, (round_even((sq) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS sq, (round_even((sq * rq) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS pq, (round_even((mucov) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS mucov, (round_even((mwcov) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)) AS mwcov FROM f""")
def _(spark, sf):
    return metrics.aggregate_eval(metrics.eval_instances(points(spark, sf)))


@query("a10_encode_gt_ids", P + """, c AS (SELECT scene_id, inst_gt, min(sem_gt) AS class FROM points GROUP BY 1, 2)
SELECT pid, CASE WHEN class IN (1, 2) THEN class * 1000 + inst_gt ELSE 0 END AS gt_code FROM points JOIN c USING (scene_id, inst_gt)""")
def _(spark, sf):
    return metrics.encode_gt_ids(points(spark, sf)).select("pid", "gt_code")


@query("a11_average_precision")
def _(spark, sf):
    truth = points(spark, sf).select("scene_id", "pid", F.col("inst_gt").alias("gt_id"), F.lit(0).alias("label"))
    found = metrics.average_precision(masks(spark, sf), mask_points(spark, sf).drop("prob"), truth, min_region=10)
    return metrics.summarize_ap(found).select("label", *[_r(c) for c in ("ap", "ap50", "ap25", "precision50", "recall50")])


@query("a12_mask_pair_scores", MASKS_SQL + """, t AS (SELECT scene_id, pid, inst_gt AS gt_id, CAST(0.8 AS DOUBLE) AS ratio FROM points WHERE inst_gt > 0), pm AS (SELECT scene_id, mask_id, pid, (prob + CAST(0.5 AS DOUBLE)) / 2 AS prob FROM mask_points),
 mine AS (SELECT scene_id, mask_id, count(*) FILTER (prob >= 0.5) AS n_pred, sum(prob) AS mass, sum(-ln(greatest(1 - prob, CAST(1e-6 AS DOUBLE)))) AS off, count(*) AS n FROM pm GROUP BY 1, 2),
 theirs AS (SELECT scene_id, gt_id, count(*) AS n_gt FROM t GROUP BY 1, 2),
 j AS (SELECT scene_id, mask_id, gt_id, count(*) FILTER (prob >= 0.5) AS inter, sum(prob) AS soft, sum(-ln(greatest(prob, CAST(1e-6 AS DOUBLE))) + ln(greatest(1 - prob, CAST(1e-6 AS DOUBLE)))) AS gain, max(ratio) AS ratio FROM pm JOIN t USING (scene_id, pid) GROUP BY 1, 2, 3)
SELECT scene_id, mask_id, gt_id, round(inter / (n_pred + n_gt - inter + CAST(1e-6 AS DOUBLE)), 6) AS iou, round(inter / (n_pred + n_gt / ratio - inter + CAST(1e-6 AS DOUBLE)), 6) AS iou_whole,
 round(1 - (2 * soft + 1) / (mass + n_gt + 1), 6) AS dice, round(("off" + gain) / n, 6) AS bce FROM j JOIN mine USING (scene_id, mask_id) JOIN theirs USING (scene_id, gt_id)""")
def _(spark, sf):
    truth = points(spark, sf).filter("inst_gt > 0").select("scene_id", "pid", F.col("inst_gt").alias("gt_id"), F.lit(0.8).alias("ratio"))
    soft = mask_points(spark, sf).withColumn("prob", (F.col("prob") + 0.5) / 2)
    return metrics.mask_pair_scores(soft, truth).select("scene_id", "mask_id", "gt_id", *[_r(c) for c in ("iou", "iou_whole", "dice", "bce")])
