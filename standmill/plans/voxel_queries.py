"""Queries over voxels, samplers and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from standmill.functions import keys
from standmill.functions.keys import hash_order_sql
from standmill.operators import frames, labels, metrics, voxels
from standmill.plans.frame_queries import BOXES, CENTERS, _r
from standmill.plans.registry import query
from standmill.sources.fixtures import POINTS_SQL, points, table

P = POINTS_SQL
H = hash_order_sql
K = ("vx", "vy", "vz")


def vox(size: str = "2") -> str:
    return ", ".join(f"CAST(floor({a} / CAST({size} AS DOUBLE)) AS BIGINT) AS v{a}" for a in "xyz")


V = P + f", pv AS (SELECT *, {vox()} FROM points)"


@query("w1_dense_ids", P + """, r AS (SELECT scene_id, inst_pred, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY inst_pred) - 1 AS INTEGER) AS d FROM (SELECT DISTINCT scene_id, inst_pred FROM points WHERE inst_pred <> -1))
SELECT pid, coalesce(d, -1) AS dense_id FROM points LEFT JOIN r USING (scene_id, inst_pred)""")
def _(spark, sf):
    return voxels.dense_ids(points(spark, sf), "scene_id", "inst_pred").select("pid", "dense_id")


@query("v1_voxel_mean", V + " SELECT scene_id, vx, vy, vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, min(pid) AS pid, count(*) AS n_points FROM pv GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return voxels.voxel_mean(points(spark, sf), 2.0).select("scene_id", *K, _r("x", 9), _r("y", 9), _r("z", 9), "pid", "n_points")


@query("v1_voxel_inverse", V + " SELECT scene_id, pid, min(pid) OVER (PARTITION BY scene_id, vx, vy, vz) AS voxel_pid FROM pv")
def _(spark, sf):
    return voxels.voxel_inverse(points(spark, sf), 2.0)


@query("v2_voxelize", V + """, s AS (SELECT scene_id, min(z) AS low, min(vx) AS ax, min(vy) AS ay, min(vz) AS az FROM pv GROUP BY 1)
SELECT scene_id, vx - ax AS vx, vy - ay AS vy, vz - az AS vz, CAST(0 AS DOUBLE) AS fx, round(avg(z - low), 9) AS fz, count(*) AS n_points FROM pv JOIN s USING (scene_id) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return voxels.voxelize(points(spark, sf), 2.0, "height").select("scene_id", *K, "fx", _r("fz", 9), "n_points")


@query("v2_sparse_shape", V + " SELECT scene_id, greatest(max(vx) - min(vx) + 1, 30) AS nx, greatest(max(vy) - min(vy) + 1, 30) AS ny, greatest(max(vz) - min(vz) + 1, 30) AS nz FROM pv GROUP BY 1")
def _(spark, sf):
    return voxels.sparse_shape(voxels.voxelize(points(spark, sf), 2.0, "height"), 30)


@query("v3_voxel_first", V + " SELECT pid, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY pid) AS k FROM pv) WHERE k = 1")
def _(spark, sf):
    return voxels.voxel_first(points(spark, sf), 2.0).select("pid", "x", "y", "z")


@query("v4_voxel_random", V + f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY {H('pid', 9)}, pid) AS k FROM pv) WHERE k = 1)
SELECT pid, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY inst_gt) - 1 AS INTEGER) AS dense_id FROM f""")
def _(spark, sf):
    return voxels.dense_ids(voxels.voxel_random(points(spark, sf), 2.0, 9), "scene_id", "inst_gt").select("pid", "dense_id")


@query("v5_voxel_to_budget")
def _(spark, sf):
    p = points(spark, sf)
    return voxels.voxel_to_budget(p, p.count() // 3, 0.5).select("scene_id", "pid")


@query("v6_voxel_majority_instance", V + """, b AS (SELECT *, CASE WHEN sem_gt = 0 THEN -1 ELSE inst_gt END AS i FROM pv), c AS (SELECT scene_id, vx, vy, vz, i, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5)
SELECT scene_id, vx, vy, vz, i AS inst_gt FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY n DESC, CASE WHEN i = -1 THEN 1e9 ELSE i END) AS k FROM c) WHERE k = 1""")
def _(spark, sf):
    return voxels.voxel_majority_instance(frames.background_instances(points(spark, sf), "sem_gt", "inst_gt"), 2.0)


@query("v7_voxel_majority_class", V + """, c AS (SELECT scene_id, vx, vy, vz, sem_gt, count(*) AS n FROM pv GROUP BY 1, 2, 3, 4, 5)
SELECT scene_id, vx, vy, vz, sem_gt FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY n DESC, sem_gt) AS k FROM c) WHERE k = 1""")
def _(spark, sf):
    return voxels.voxel_majority_class(points(spark, sf), 2.0)


@query("v8_voxel_instance_masks", V + """, c AS (SELECT scene_id, vx, vy, vz, inst_pred, count(*) AS n, sum(count(*)) OVER (PARTITION BY scene_id, vx, vy, vz) AS t FROM pv GROUP BY 1, 2, 3, 4, 5)
SELECT scene_id, vx, vy, vz, inst_pred FROM c WHERE n / t > 0.5 AND inst_pred <> -1""")
def _(spark, sf):
    return voxels.voxel_instance_masks(points(spark, sf), 2.0, "inst_pred")


@query("v9_voxel_foreground", V + " SELECT scene_id, vx, vy, vz, CAST(count(*) FILTER (sem_gt > 0) / count(*) > 0.5 AS INTEGER) AS foreground FROM pv GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return voxels.voxel_foreground(points(spark, sf), 2.0)


OFFS = f""", {BOXES}, off AS (SELECT p.*, coalesce(cx - x, 0) AS offx, coalesce(cy - y, 0) AS offy, coalesce(cz - z, 0) AS offz FROM points p LEFT JOIN boxes b ON p.scene_id = b.scene_id AND p.inst_gt = b.box_id)"""


@query("v10_voxel_vote_offsets", P + OFFS + f""", ov AS (SELECT *, {vox()} FROM off), m AS (SELECT scene_id, vx, vy, vz, inst_gt, count(*) AS n, avg(offx) AS offx, avg(offz) AS offz FROM ov GROUP BY 1, 2, 3, 4, 5)
SELECT scene_id, vx, vy, vz, inst_gt, round(offx, 9) AS offx, round(offz, 9) AS offz FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY n DESC, inst_gt) AS k FROM m) WHERE k = 1""")
def _(spark, sf):
    p = points(spark, sf)
    return voxels.voxel_vote_offsets(labels.vote_offsets(p, p), 2.0).select("scene_id", *K, "inst_gt", _r("offx", 9), _r("offz", 9))


SUPER = P + ", sp AS (SELECT *, CAST(floor(x / CAST(2 AS DOUBLE)) AS BIGINT) * 1000 + CAST(floor(y / CAST(2 AS DOUBLE)) AS BIGINT) AS sp FROM points)"


def _super(spark, sf):
    cell = F.floor(F.col("x") / 2.0).cast("long") * 1000 + F.floor(F.col("y") / 2.0).cast("long")
    return points(spark, sf).withColumn("sp", cell)


@query("v11_superpoint_instances", SUPER + """, c AS (SELECT scene_id, sp, inst_gt, count(*) AS n, sum(count(*)) OVER (PARTITION BY scene_id, sp) AS t FROM sp GROUP BY 1, 2, 3),
 f AS (SELECT scene_id, inst_gt, arg_min(sem_gt, pid) AS label FROM points GROUP BY 1, 2) SELECT scene_id, sp, inst_gt, label - 1 AS label FROM c JOIN f USING (scene_id, inst_gt) WHERE n / t > 0.5 AND label <> 0""")
def _(spark, sf):
    return voxels.superpoint_labels(_super(spark, sf), "sp", 3)[0].select("scene_id", "sp", "inst_gt", "label")


@query("v11_superpoint_classes", SUPER + """, c AS (SELECT scene_id, sp, sem_gt, count(*) AS n, sum(count(*)) OVER (PARTITION BY scene_id, sp) AS t FROM sp GROUP BY 1, 2, 3)
SELECT scene_id, sp, CAST(coalesce(max(CASE WHEN n / t > 0.5 THEN sem_gt END), 3) AS INTEGER) AS sem_gt FROM c GROUP BY 1, 2""")
def _(spark, sf):
    return voxels.superpoint_labels(_super(spark, sf), "sp", 3)[1]


@query("v12_sample_points", P + f" SELECT pid FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN sqrt(x * x + y * y + z * z) > 110 THEN 0 ELSE 1 END, {H('pid', 4)}, pid) AS k FROM points) WHERE k <= 300")
def _(spark, sf):
    return voxels.sample_points(points(spark, sf), 300, 4, 110.0).select("pid")


@query("v12_sample_with_replacement", P + f""", n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY pid) - 1 AS pos, count(*) OVER (PARTITION BY scene_id) AS m FROM points),
 d AS (SELECT DISTINCT scene_id, m, CAST(i AS INTEGER) AS draw, {H('(i + scene_id * 1000003)', 6)} % m AS pos FROM n, range(200) AS t(i)) SELECT d.scene_id, draw, pid FROM d JOIN n USING (scene_id, pos)""")
def _(spark, sf):
    return voxels.sample_with_replacement(points(spark, sf), 200, 6).select("scene_id", "draw", "pid")


@query("v13_sample_patches", P + f""", r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {H('pid', 8)}, pid) AS attempt FROM points), t AS (SELECT scene_id, attempt, x AS cx, y AS cy FROM r WHERE attempt <= 10),
 i AS (SELECT p.*, attempt, cx, cy FROM points p JOIN t USING (scene_id) WHERE abs(x - cx) <= 5 AND abs(y - cy) <= 5),
 g AS (SELECT scene_id, attempt, count(*) AS m FROM i GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (inst_gt > 0) >= 0.3 * count(*)),
 f AS (SELECT scene_id, min(attempt) AS attempt, arg_min(m, attempt) AS m FROM g GROUP BY 1),
 c AS (SELECT i.*, m, row_number() OVER (PARTITION BY i.scene_id ORDER BY {H('pid', 9)}, pid) - 1 AS pos FROM i JOIN f USING (scene_id, attempt))
SELECT scene_id, CAST(draw AS INTEGER) AS draw, pid, round(x - cx, 6) AS x FROM c, range(128) AS d(draw) WHERE pos < 128 AND draw % least(m, 128) = pos""")
def _(spark, sf):
    return voxels.sample_patches(points(spark, sf), 10.0, 128, 8, annotated=0.3).select("scene_id", F.col("draw").cast("int"), "pid", _r("x"))


@query("v13_sample_patches_occupied", P + f""", r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {H('pid', 8)}, pid) AS attempt FROM points), e AS (SELECT scene_id, max(x) AS hx, max(y) AS hy, max(z) AS hz, min(z) AS lz FROM points GROUP BY 1),
 t AS (SELECT scene_id, attempt, x AS cx, y AS cy, hx, hy, hz, lz FROM r JOIN e USING (scene_id) WHERE attempt <= 10),
 i AS (SELECT p.*, attempt, cx, cy, hx, hy, hz, (ceil((x - (cx - 25)) / 50 * 31) * 31 + ceil((y - (cy - 25)) / 50 * 31)) * 62 + ceil((z - lz) / (hz - lz) * 62) AS cell,
  greatest(abs(x - cx), abs(y - cy)) AS gap FROM points p JOIN t USING (scene_id) WHERE abs(x - cx) <= 25.5 AND abs(y - cy) <= 25.5),
 g AS (SELECT scene_id, attempt, count(*) AS m FROM i GROUP BY 1, 2 HAVING count(DISTINCT cell) FILTER (gap <= CAST(25.01 AS DOUBLE)) / (31 * 31 * 62) >= CAST(0.002 AS DOUBLE) AND count(*) FILTER (inst_gt > 0) >= CAST(0.5 AS DOUBLE) * count(*)),
 f AS (SELECT scene_id, min(attempt) AS attempt, arg_min(m, attempt) AS m FROM g GROUP BY 1),
 c AS (SELECT i.*, m, row_number() OVER (PARTITION BY i.scene_id ORDER BY {H('pid', 9)}, pid) - 1 AS pos FROM i JOIN f USING (scene_id, attempt))
SELECT scene_id, CAST(draw AS INTEGER) AS draw, pid, round(x - cx, 6) AS x, round(x / hx, 6) AS nx, round(z / hz, 6) AS nz FROM c, range(1200) AS d(draw) WHERE pos < 1200 AND draw % least(m, 1200) = pos""")
def _(spark, sf):
    found = voxels.sample_patches(points(spark, sf), 50.0, 1200, 8, least_points=None, annotated=0.5, occupied=0.002, enlarge=0.5, features=True)
    return found.select("scene_id", F.col("draw").cast("int"), "pid", _r("x"), _r("nx"), _r("nz"))


@query("v14_voxel_sampler_sweeps", V.replace("2 AS DOUBLE", "8 AS DOUBLE") + """, s AS (SELECT *, pid % 4 = 0 AS current FROM pv), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, current, vx, vy, vz ORDER BY pid) AS k FROM s),
 f AS (SELECT scene_id, current, vx, vy, vz, row_number() OVER (PARTITION BY scene_id, current ORDER BY min(pid)) - 1 AS slot, count(*) OVER (PARTITION BY scene_id, current) AS nv FROM s GROUP BY 1, 2, 3, 4, 5),
 w AS (SELECT f.*, CAST(i AS INTEGER) AS slot2 FROM f, range(150) AS t(i) WHERE slot < 150 AND (i = slot OR (slot = 0 AND i >= nv)))
SELECT scene_id, current, pid, slot2 AS slot FROM k JOIN w USING (scene_id, current, vx, vy, vz) WHERE k <= 3""")
def _(spark, sf):
    p = points(spark, sf).withColumn("time", (F.col("pid") % 4).cast("int"))
    return voxels.voxel_sampler_sweeps(p, 8.0, 3, 150).select("scene_id", "current", "pid", F.col("slot").cast("int"))


@query("v15_query_grid", P + f""", s AS (SELECT scene_id, greatest(pow(greatest((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 1) / least(100, count(*)), CAST(1 AS DOUBLE) / 3), CAST(0.5 AS DOUBLE)) AS cell FROM points GROUP BY 1),
 f AS (SELECT scene_id, floor(x / cell) AS a, floor(y / cell) AS b, floor(z / cell) AS c, min(pid) AS pid FROM points JOIN s USING (scene_id) GROUP BY 1, 2, 3, 4)
SELECT pid FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {H('pid', 0)}, pid) AS k FROM f) WHERE k <= 100""")
def _(spark, sf):
    return voxels.select_queries(points(spark, sf), "grid", 100).select("pid")


@query("v16_query_adaptive")
def _(spark, sf):
    return voxels.select_queries(points(spark, sf), "adaptive", 100).select("scene_id", "pid")


def _embedded(spark, sf):
    """Embeddings as voxels of scenes: the label as instance, a height from the id."""
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 4).cast("int").alias("scene_id"), F.col("vec_id").alias("pid"), "embedding", F.col("label").alias("instance"), (F.col("vec_id") % 17).cast("double").alias("z"))


@query("v16_query_adaptive_emb")
def _(spark, sf):
    return voxels.select_queries(_embedded(spark, sf), "adaptive_emb", 30, size=64).select("scene_id", "pid")


@query("u2_select_queries", P + " SELECT DISTINCT scene_id, mode FROM points, (VALUES ('adaptive'), ('fps'), ('grid')) AS m(mode)")
def _(spark, sf):
    """Every method gives at most what it is asked for, all of them points of the scene, in each scene."""
    p = points(spark, sf)
    found = None
    for mode, n in (("grid", 300), ("adaptive", 60), ("fps", 20)):
        rows = voxels.select_queries(voxels.select_queries(p, "grid", 300) if mode == "fps" else p, mode, n).select("scene_id", "pid")
        good = rows.join(p.select("scene_id", "pid"), ["scene_id", "pid"]).groupBy("scene_id").agg(F.count("*").alias("n")).filter(F.col("n").between(1, n))
        one = good.select("scene_id", F.lit(mode).alias("mode"))
        found = one if found is None else found.unionByName(one)
    return found


@query("v17_query_fps")
def _(spark, sf):
    reduced = voxels.select_queries(points(spark, sf), "grid", 400)
    return voxels.select_queries(reduced, "fps", 50).select("scene_id", "pid", "rank")


@query("v18_shuffle_points", P + f" SELECT pid, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY {H('pid', 2)}, pid) - 1 AS INTEGER) AS place FROM points")
def _(spark, sf):
    return voxels.shuffle_points(points(spark, sf), 2).select("pid", F.col("place").cast("int"))


@query("v19_polar_mix", P + """, m AS (SELECT *, atan2(y - 50, x - 50) AS w, x - 50 AS u, y - 50 AS v FROM points), h AS (SELECT *, w - 2 * CAST(3.141592653589793 AS DOUBLE) * floor(w / (2 * CAST(3.141592653589793 AS DOUBLE))) AS yaw FROM m)
SELECT pid, round(u, 4) AS x, round(v, 4) AS y FROM h WHERE (scene_id % 2 = 0 AND yaw >= CAST(3.141592653589793 AS DOUBLE)) OR (scene_id % 2 = 1 AND yaw < CAST(3.141592653589793 AS DOUBLE))
UNION ALL SELECT pid, round(u * cos(t) - v * sin(t), 4) AS x, round(u * sin(t) + v * cos(t), 4) AS y FROM h, (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS a(t) WHERE scene_id % 2 = 1 AND sem_gt IN (1)""")
def _(spark, sf):
    p = points(spark, sf).withColumns({"x": F.col("x") - 50, "y": F.col("y") - 50})
    mixed = voxels.polar_mix(p.filter("scene_id % 2 = 0"), p.filter("scene_id % 2 = 1"), 0.0, (1,), (0.0, 1.0))
    return mixed.select("pid", _r("x", 4), _r("y", 4))


@query("v20_laser_mix", P + """, h AS (SELECT *, least(greatest(degrees(atan2(z, sqrt(x * x + y * y))), CAST(0 AS DOUBLE)), CAST(30 AS DOUBLE)) AS pitch FROM points), b AS (SELECT *, least(CAST(floor(pitch / CAST(7.5 AS DOUBLE)) AS BIGINT), 3) AS band FROM h)
SELECT pid FROM b WHERE (scene_id % 2 = 0 AND band % 2 = 0) OR (scene_id % 2 = 1 AND band % 2 = 1)""")
def _(spark, sf):
    p = points(spark, sf)
    return voxels.laser_mix(p.filter("scene_id % 2 = 0"), p.filter("scene_id % 2 = 1"), 4, 0.0, 30.0).select("pid")


# labels

CROP = P + f", {CENTERS}, crop AS (SELECT p.* FROM points p JOIN centers c USING (scene_id) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) < CAST(1600 AS DOUBLE))"


def _crop(spark, sf):
    p = points(spark, sf)
    return p, frames.cylinder_crop(p, frames.hashed_centers(p, 5), 40).select(*p.columns)


@query("a17_instance_labels", P + """, r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY inst_pred) - 1 AS INTEGER) AS dense_id FROM points WHERE inst_pred <> -1)
SELECT scene_id, dense_id, arg_min(sem_pred, pid) AS label, count(*) AS n_points FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return labels.instance_labels(points(spark, sf), "inst_pred", "sem_pred")


@query("a18_vote_offsets", CROP + f""", {BOXES} SELECT pid, round(coalesce(b.cx - x, 0), 6) AS offx, round(coalesce(b.cy - y, 0), 6) AS offy, round(coalesce(b.cz - z, 0), 6) AS offz
FROM crop p LEFT JOIN boxes b ON p.scene_id = b.scene_id AND p.inst_gt = b.box_id""")
def _(spark, sf):
    p, crop = _crop(spark, sf)
    return labels.vote_offsets(p, crop).select("pid", _r("offx"), _r("offy"), _r("offz"))


RATIO = CROP + """, ratio AS (SELECT scene_id, inst_gt, seen / whole AS ratio FROM (SELECT scene_id, inst_gt, count(*) AS seen FROM crop WHERE inst_gt > 0 GROUP BY 1, 2) JOIN (SELECT scene_id, inst_gt, count(*) AS whole FROM points WHERE inst_gt > 0 GROUP BY 1, 2) USING (scene_id, inst_gt))"""


@query("a19_visible_ratio", RATIO + " SELECT * FROM ratio")
def _(spark, sf):
    return labels.visible_ratio(*_crop(spark, sf))


@query("a20_keep_whole_instances", RATIO + " SELECT pid FROM crop c LEFT JOIN ratio r USING (scene_id, inst_gt) WHERE c.inst_gt <= 0 OR ratio = 1")
def _(spark, sf):
    return labels.keep_whole_instances(*_crop(spark, sf)).select("pid")


@query("a13_offset_quality", P + OFFS + """ SELECT scene_id, round(avg(abs(offx + 1 - offx) + abs(offy - offy) + abs(offz * 2 - offz)), 6) AS l1,
 round(avg(-((offx + 1) * offx + offy * offy + offz * 2 * offz) / (sqrt((offx + 1) * (offx + 1) + offy * offy + offz * 2 * offz * 2) * sqrt(offx * offx + offy * offy + offz * offz) + CAST(1e-8 AS DOUBLE))), 6) AS direction FROM off GROUP BY 1""")
def _(spark, sf):
    p = points(spark, sf)
    o = labels.vote_offsets(p, p).withColumns({"px": F.col("offx") + 1, "py": F.col("offy"), "pz": F.col("offz") * 2})
    return labels.offset_quality(o).select("scene_id", _r("l1"), _r("direction"))


#: All components of the given embeddings.
COMPONENTS = 64
EMB = "WITH e AS (SELECT CAST(vec_id % 4 AS INTEGER) AS scene_id, vec_id AS pid, label AS instance, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, COMPONENTS + 1)) + " FROM embeddings), m AS (SELECT scene_id, instance, count(*) AS n, " + ", ".join(f"avg(e{i}) AS m{i}" for i in range(1, COMPONENTS + 1)) + " FROM e GROUP BY 1, 2)"
L1 = " + ".join(f"abs(e{i} - m{i})" for i in range(1, COMPONENTS + 1))
L2 = " + ".join(f"abs(a.m{i} - b.m{i})" for i in range(1, COMPONENTS + 1))


@query("a14_embedding_cluster_stats", EMB + f""", v AS (SELECT scene_id, instance, avg(greatest({L1} - 0.5, 0) * greatest({L1} - 0.5, 0)) AS v FROM e JOIN m USING (scene_id, instance) GROUP BY 1, 2), v2 AS (SELECT scene_id, avg(v) AS variance FROM v GROUP BY 1),
 d AS (SELECT a.scene_id, avg(greatest(3 - ({L2}), 0) * greatest(3 - ({L2}), 0)) AS distance FROM m a JOIN m b ON a.scene_id = b.scene_id AND a.instance <> b.instance GROUP BY 1),
 r AS (SELECT scene_id, avg({' + '.join(f'abs(m{i})' for i in range(1, COMPONENTS + 1))}) * 0.001 AS regular FROM m GROUP BY 1)
SELECT scene_id, round(variance, 6) AS variance, round(coalesce(distance, 0), 6) AS distance, round(regular, 6) AS regular FROM v2 LEFT JOIN d USING (scene_id) JOIN r USING (scene_id)""")
def _(spark, sf):
    return labels.embedding_cluster_stats(_embedded(spark, sf), COMPONENTS).select("scene_id", _r("variance"), _r("distance"), _r("regular"))


@query("a15_embedding_mean_cov", EMB + ", c AS (SELECT scene_id, instance, count(*) AS n, avg(e1) AS m1, coalesce(covar_samp(e1, e2), 0) AS c12, coalesce(covar_samp(e3, e3), 0) AS c33 FROM e GROUP BY 1, 2) SELECT scene_id, instance, n, round(m1, 6) AS m1, round(c12, 6) AS c12, round(c33, 6) AS c33 FROM c")
def _(spark, sf):
    s = labels.embedding_mean_cov(_embedded(spark, sf), 5)
    return s.select("scene_id", "instance", "n", *[F.round(F.element_at(c, k), 6).alias(n) for n, c, k in (("m1", "mean", 1), ("c12", "cov", 2), ("c33", "cov", 13))])


@query("a16_embedding_distance", EMB + f""", s AS (SELECT scene_id, instance, pid, exp(-sqrt({' + '.join(f'(e{i} - m{i}) * (e{i} - m{i})' for i in range(1, COMPONENTS + 1))})) AS s FROM e JOIN m USING (scene_id, instance)),
 w AS (SELECT *, min(s) OVER (PARTITION BY scene_id, instance) AS lo, max(s) OVER (PARTITION BY scene_id, instance) AS hi FROM s) SELECT pid, round(CASE WHEN hi = lo THEN 1 ELSE (s - lo) / (hi - lo) END, 6) AS score FROM w""")
def _(spark, sf):
    return labels.embedding_distance(_embedded(spark, sf), COMPONENTS).select("pid", _r("score"))


@query("a16_mahalanobis_distance")
def _(spark, sf):
    return labels.embedding_distance(_embedded(spark, sf), 5, "mahalanobis").select("pid", _r("score", 4))


# joins on place


@query("j4_nearest_label", P + """, q AS (SELECT scene_id, pid, x, y, z FROM points), r AS (SELECT scene_id, pid AS ref, x AS rx, y AS ry, z AS rz, sem_pred FROM points WHERE pid IN (SELECT min(pid) FROM points GROUP BY scene_id, floor(x / 8), floor(y / 8), floor(z / 8))),
 d AS (SELECT scene_id, pid, ref, sem_pred, row_number() OVER (PARTITION BY scene_id, pid ORDER BY (x - rx) * (x - rx) + (y - ry) * (y - ry) + (z - rz) * (z - rz), ref) AS k FROM q JOIN r USING (scene_id)) SELECT scene_id, pid, ref, sem_pred FROM d WHERE k = 1""")
def _(spark, sf):
    """All points against the first point of each coarse voxel."""
    p = points(spark, sf)
    return labels.nearest_label(p, voxels.voxel_first(p, 8.0), "sem_pred", 8.0)


@query("j4_inverse_labels", V + ", m AS (SELECT scene_id, vx, vy, vz, min(pid) AS rep FROM pv GROUP BY 1, 2, 3, 4) SELECT pid, rep FROM pv JOIN m USING (scene_id, vx, vy, vz)")
def _(spark, sf):
    p = voxels.with_voxel(points(spark, sf), 2.0)
    return labels.inverse_labels(p, voxels.voxel_mean(points(spark, sf), 2.0).select("scene_id", *K, F.col("pid").alias("rep")), "rep", ["scene_id", *K]).select("pid", "rep")


@query("j7_points_in_boxes", P + f", {BOXES} SELECT p.scene_id, pid, box_id FROM points p JOIN boxes b USING (scene_id) WHERE x >= cx - dx / 2 AND x <= cx + dx / 2 AND y >= cy - dy / 2 AND y <= cy + dy / 2 AND z >= cz - dz / 2 AND z <= cz + dz / 2")
def _(spark, sf):
    return labels.points_in_boxes(points(spark, sf), metrics.instance_boxes(points(spark, sf)))


def _inside(grow: float) -> str:
    g = f"CAST({grow} AS DOUBLE)"
    return " AND ".join(f"{a} >= c{a} - (d{a} / 2 + {g}) AND {a} <= c{a} + (d{a} / 2 + {g})" for a in "xyz")


@query("j7_background_near_boxes", P + f""", {BOXES}, n AS (SELECT p.scene_id, pid, bool_or({_inside(0)}) AS inside FROM points p JOIN boxes b USING (scene_id) WHERE {_inside(1.5)} GROUP BY 1, 2)
SELECT pid FROM points p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scene_id = p.scene_id AND n.pid = p.pid AND NOT inside)""")
def _(spark, sf):
    p = points(spark, sf)
    return labels.background_near_boxes(p, metrics.instance_boxes(p), 1.5).select("pid")


@query("j8_remove_points_in_boxes", P + f", {BOXES} SELECT pid FROM points p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.scene_id = p.scene_id AND {_inside(0)})")
def _(spark, sf):
    p = points(spark, sf)
    return labels.remove_points_in_boxes(p, metrics.instance_boxes(p)).select("pid")


@query("j10_match_one_to_many", V + """, c AS (SELECT scene_id, vx, vy, vz, inst_gt, count(*) AS n, sum(count(*)) OVER (PARTITION BY scene_id, vx, vy, vz) AS t FROM pv GROUP BY 1, 2, 3, 4, 5), k AS (SELECT * FROM c WHERE n / t > 0.5 AND inst_gt <> -1)
SELECT pid, coalesce(k.inst_gt, -1) AS gt_id FROM pv LEFT JOIN k USING (scene_id, vx, vy, vz)""")
def _(spark, sf):
    p = points(spark, sf)
    queries = voxels.with_voxel(p, 2.0)
    return labels.match_one_to_many(queries.drop("inst_gt"), voxels.voxel_instance_masks(p, 2.0), ["scene_id", *K]).select("pid", "gt_id")


# keys


def _spread_sql(v: str) -> str:
    return " | ".join(f"((({v}) >> {b} & 1) << {2 * b})" for b in range(16))


@query("f5_morton2d", P + f", g AS (SELECT pid, CAST(floor(x + 10) AS BIGINT) AS a, CAST(floor(y + 10) AS BIGINT) AS b FROM points) SELECT pid, ({_spread_sql('a')}) | (({_spread_sql('b')}) << 1) AS code FROM g")
def _(spark, sf):
    return points(spark, sf).select("pid", keys.morton2d(F.floor(F.col("x") + 10), F.floor(F.col("y") + 10)).alias("code"))


@query("f6_voxel_hash_ravel", V + ", s AS (SELECT scene_id, min(vx) AS ax, min(vy) AS ay, min(vz) AS az, max(vy) - min(vy) + 1 AS ny, max(vz) - min(vz) + 1 AS nz FROM pv GROUP BY 1) SELECT pid, ((vx - ax) * ny + vy - ay) * nz + vz - az AS code FROM pv JOIN s USING (scene_id)")
def _(spark, sf):
    p = voxels.with_voxel(points(spark, sf), 2.0)
    s = p.groupBy("scene_id").agg(*[F.min(k).alias(f"a{k}") for k in K], *[(F.max(k) - F.min(k) + 1).alias(f"n{k}") for k in K])
    d = [F.col(k) - F.col(f"a{k}") for k in K]
    return p.join(s, "scene_id").select("pid", keys.ravel(*d, F.col("nvy"), F.col("nvz")).alias("code"))


def _fnv_sql() -> str:
    h = "CAST(2166136261 AS HUGEINT)"
    for v in K:
        h = f"(xor({h}, (CAST({v} AS HUGEINT) + 18446744073709551616) % 18446744073709551616) * 16777619 % 18446744073709551616)"
    return h


@query("f6_voxel_hash_fnv", V + f" SELECT pid, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS code FROM (SELECT pid, {_fnv_sql()} AS h FROM pv)")
def _(spark, sf):
    return voxels.with_voxel(points(spark, sf), 2.0).select("pid", keys.fnv(*[F.col(k) for k in K]).alias("code"))
