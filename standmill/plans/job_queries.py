"""Queries over files, status reports, prompts and predictors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from standmill.functions import text
from standmill.operators import metrics, predict
from standmill.plans.frame_queries import PREDS, TILES, TOP, SIZE, GROW, _r, merged, tile_preds, tree_sql
from standmill.plans.registry import query
from standmill.sources import files
from standmill.sources.fixtures import POINTS_SQL, STATUS_SQL, points, status_events, status_of, table
from standmill.sources.storage import new_path, written
from standmill.streaming import status as st, tile_merge
from standmill.operators import tiles

P, S = POINTS_SQL, STATUS_SQL


# files

PLY_SQL = P + " SELECT CAST(x AS FLOAT) AS x, CAST(z AS FLOAT) AS z, sem_pred AS semantic_pred, inst_pred AS instance_pred, CAST(score AS FLOAT) AS score FROM points"


def _predictions(spark, sf):
    return points(spark, sf).withColumnsRenamed({"sem_pred": "semantic_pred", "inst_pred": "instance_pred"})


@query("s1_read_ply", PLY_SQL)
def _(spark, sf):
    path = new_path(spark)
    files.write_ply(_predictions(spark, sf), path, 4).collect()
    return files.read_ply(spark, path, ("x", "z", "semantic_pred", "instance_pred", "score")).drop("file", "row")


@query("s1_read_ply_ascii", P + " SELECT pid % 4 AS part, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, sem_pred AS semantic FROM points")
def _(spark, sf):
    """Lines in a text file behind a header; the text sink writes them, so this also reads what Spark's text writer makes."""
    p = points(spark, sf)
    root = new_path(spark)
    parts = []
    for k in range(4):
        own = p.filter(F.col("pid") % 4 == k).select(F.concat_ws(" ", F.col("x").cast("float"), F.col("y").cast("float"), F.col("z").cast("float"), F.col("sem_pred")).alias("value"), F.col("pid").alias("at"))
        head = ["ply", "format ascii 1.0", f"element vertex {own.count()}", "property float x", "property float y", "property float z", "property int semantic", "end_header"]
        lines = spark.createDataFrame([(h, k2 - 100) for k2, h in enumerate(head)], "value string, at long").unionByName(own)
        lines.coalesce(1).sortWithinPartitions("at").select("value").write.option("lineSep", "\n").text(f"{root}/{k}")
        parts.append(_renamed(f"{root}/{k}"))
    found = [files.read_ply(spark, f).withColumn("part", F.lit(k).cast("long")) for k, f in enumerate(parts)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("part", "x", "y", "z", "semantic")


def _renamed(folder: str) -> str:
    """The one part in a folder, under a name that ends in .ply."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(folder)
    part = next(i.path for i in system.get_file_info(fs.FileSelector(place)) if i.base_name.startswith("part-"))
    system.move(part, f"{place}/points.ply")
    return f"{folder}/points.ply"


@query("s2_write_ply", P + " SELECT count(*) AS n_points, sum(CAST(inst_pred AS BIGINT)) AS sum_instance, sum(CAST(sem_pred AS BIGINT)) AS sum_semantic, round(sum(CAST(CAST(z AS FLOAT) AS DOUBLE)), 3) AS sum_z FROM points")
def _(spark, sf):
    """Sums of what stands in the written files."""
    path = new_path(spark)
    files.write_ply(_predictions(spark, sf), path, 4).collect()
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("instance_pred", "sum_instance"), ("semantic_pred", "sum_semantic"))]
    return files.read_ply(spark, path).agg(F.count("*").alias("n_points"), *sums, F.round(F.sum(F.col("z").cast("double")), 3).alias("sum_z"))


@query("s3_read_scene_bins", P + " SELECT 'scene_' || scene_id AS name, row_number() OVER (PARTITION BY scene_id ORDER BY pid) - 1 AS \"row\", CAST(x AS FLOAT) AS x, CAST(inst_gt AS BIGINT) AS instance, CAST(sem_gt AS BIGINT) AS semantic FROM points")
def _(spark, sf):
    p = points(spark, sf).select(F.concat(F.lit("scene_"), F.col("scene_id")).alias("name"), "pid", "x", "y", "z", F.col("inst_gt").alias("instance"), F.col("sem_gt").alias("semantic"))
    root = new_path(spark)
    scenes = spark.createDataFrame(files.write_scene_bins(p, root).collect(), "name string, n_points long")
    return files.read_scene_bins(spark, root, scenes).select("name", "row", "x", "instance", "semantic")


@query("s4_write_scene_parquet", P + " SELECT scene_id, count(*) AS n FROM points GROUP BY 1")
def _(spark, sf):
    path = new_path(spark)
    p = points(spark, sf)
    files.write_scene_parquet(p.filter("scene_id < 5"), path)
    files.write_scene_parquet(p, path)  # only the scenes that are not there yet
    return spark.read.parquet(path).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("s5_select_split", P + " SELECT DISTINCT 'SITE_plot_' || scene_id || '_annotated_' || CASE scene_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS name FROM points WHERE scene_id % 3 = 2")
def _(spark, sf):
    names = _names(spark, sf)
    path = new_path(spark)
    names.filter("name LIKE '%_test'").select(F.concat(F.lit("  "), F.col("name"), F.lit(" \n")).alias("value")).write.text(path)
    return files.select_split(names, files.read_split(spark, path)).select("name")


def _names(spark, sf):
    split = F.when(F.col("scene_id") % 3 == 0, "train").when(F.col("scene_id") % 3 == 1, "val").otherwise("test")
    return points(spark, sf).select("scene_id").distinct().select("scene_id", F.concat(F.lit("SITE_plot_"), F.col("scene_id"), F.lit("_annotated_"), split).alias("name"))


@query("s6_dataset_inventory", """SELECT '/data/' || source || '/' || doc_id || '.' || kind AS path, doc_id || '.' || kind AS name, n_chars AS size, kind AS type FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'las' WHEN 1 THEN 'laz' WHEN 2 THEN 'ply' ELSE 'txt' END AS kind FROM documents) WHERE kind <> 'txt' AND source <> 'src3'""")
def _(spark, sf):
    kind = F.when(F.col("doc_id") % 4 == 0, "las").when(F.col("doc_id") % 4 == 1, "laz").when(F.col("doc_id") % 4 == 2, "ply").otherwise("txt")
    listing = table(spark, sf, "documents").select(F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit("."), kind).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    return files.inventory(listing.unionByName(listing), ("src3",)).select("path", "name", "size", "type")


@query("s6_dataset_inventory_files", P + " SELECT CAST(pid % 4 AS INTEGER) AS part, 'part-00000.ply' AS name, 'ply' AS type, count(*) AS n_points FROM points GROUP BY 1")
def _(spark, sf):
    """Real files, those in a folder of results left out, with the points that are in them."""
    p, root = _predictions(spark, sf), new_path(spark)
    for part in range(4):
        own = p.filter(F.col("pid") % 4 == part)
        for folder in (f"{root}/{part}", f"{root}/output/{part}"):
            files.write_ply(own, folder, 1).collect()
    part = lambda c: F.regexp_extract(c, r"/(\d)/[^/]*$", 1).cast("int")
    found = files.dataset_inventory(spark, [root]).select(part("path").alias("part"), "name", "type")
    read = files.read_ply(spark, root, ("x",)).filter(~F.col("file").contains("/output/"))
    return found.join(read.groupBy(part("file").alias("part")).agg(F.count("*").alias("n_points")), "part")


@query("s7_tree_point_store", P + """ SELECT scene_id, inst_pred AS tree_id, count(*) AS n_points, CAST(coalesce(sum(count(*)) OVER (PARTITION BY scene_id ORDER BY inst_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM points WHERE inst_pred >= 0 GROUP BY 1, 2""")
def _(spark, sf):
    return files.tree_point_store(points(spark, sf))[1]


@query("s7_read_tree", P + " SELECT pid, CAST(x AS FLOAT) AS x, greatest(0, least(2, sem_pred)) AS class FROM points WHERE scene_id = 2 AND inst_pred = 7")
def _(spark, sf):
    path = new_path(spark)
    files.write_tree_store(points(spark, sf), path)
    return files.read_tree(spark, path, 2, 7).select("pid", "x", "class")


@query("s8_report_json", P + ", " + tree_sql("points") + """, t AS (SELECT scene_id, count(*) AS n_trees_listed FROM trees GROUP BY 1) SELECT scene_id, count(*) AS n_original, count(DISTINCT inst_pred) FILTER (inst_pred >= 0) AS n_trees, any_value(n_trees_listed) AS n_listed FROM points JOIN t USING (scene_id) GROUP BY 1""")
def _(spark, sf):
    p = points(spark, sf)
    path = new_path(spark)
    files.write_report_json(metrics.scene_stats(p), metrics.tree_metrics(p), path)
    r = spark.read.json(path)
    return r.select(F.col("scene_id").cast("int"), "n_original", "n_trees", F.size("trees").cast("long").alias("n_listed"))


# status, batch


def _plain(df, *columns: str):
    """Times without a zone, as the events table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


LATEST = S + """ SELECT task_id, arg_max(step, event_id) AS step, arg_max(progress, event_id) FILTER (progress IS NOT NULL) AS progress, count(*) AS n_reports,
  CASE WHEN arg_max(step, event_id) IN ('completed', 'failed') THEN arg_max(step, event_id) ELSE 'processing' END AS status FROM status GROUP BY 1"""


@query("t1_latest_status", LATEST)
def _(spark, sf):
    return st.latest_status(status_events(spark, sf)).select("task_id", "step", "progress", "n_reports", "status")


DURATIONS = S + """, b AS (SELECT *, lag(step) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS before FROM status), c AS (SELECT * FROM b WHERE before IS NULL OR before <> step)
SELECT task_id, event_id, step, ts AS started, round_even((epoch_us(lead(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id)) / CAST(1000000 AS DOUBLE) - epoch_us(ts) / CAST(1000000 AS DOUBLE)) * 10, 0) / 10 AS seconds FROM c"""


@query("w3_step_durations", DURATIONS)
def _(spark, sf):
    return _plain(st.step_durations(status_events(spark, sf)), "started")


@query("t3_pending_requests", S + " SELECT c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT task_id FROM status WHERE step IN ('completed', 'failed'))")
def _(spark, sf):
    return st.pending_requests(table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id")), status_events(spark, sf))


@query("t4_run_timeouts", S + """, r AS (SELECT task_id, min(ts) FILTER (step IN ('reading', 'inferring')) AS started, min(ts) FILTER (step IN ('completed', 'failed')) AS ended FROM status GROUP BY 1), n AS (SELECT max(ts) AS now FROM status),
 s AS (SELECT task_id, started, round_even((epoch_us(CASE WHEN ended >= started THEN ended ELSE now END) / CAST(1000000 AS DOUBLE) - epoch_us(started) / CAST(1000000 AS DOUBLE)) * 10, 0) / 10 AS ran_s FROM r, n WHERE started IS NOT NULL)
SELECT task_id, started, ran_s FROM s WHERE ran_s > 72000""")
def _(spark, sf):
    s = status_events(spark, sf)
    return _plain(st.run_timeouts(s, 72000, F.lit(s.agg(F.max("ts")).first()[0])), "started")


@query("t5_telemetry_windows", S + " SELECT step, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM status GROUP BY 1, 2")
def _(spark, sf):
    return st.telemetry_windows(status_events(spark, sf), size="1 day").select("step", F.col("window_start").cast("timestamp_ntz"), "n", _r("mean_value"), "max_value")


@query("t5_telemetry_sliding", S + " SELECT step, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS window_start, count(*) AS n, max(value) AS max_value FROM status, (VALUES (0), (1)) AS t(k) GROUP BY 1, 2")
def _(spark, sf):
    return st.telemetry_windows(status_events(spark, sf), "sliding", "24 hours", "12 hours").select("step", F.col("window_start").cast("timestamp_ntz"), "n", "max_value")


@query("t5_telemetry_sessions", S + """, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY step ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM status), i AS (SELECT *, sum(new) OVER (PARTITION BY step ORDER BY ts, event_id) AS s FROM g)
SELECT step, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM i GROUP BY step, s""")
def _(spark, sf):
    return _plain(st.telemetry_windows(status_events(spark, sf), "session", "2 hours").select("step", "window_start", "window_end", "n"), "window_start", "window_end")


@query("t7_progress_pct", TILES + " SELECT t.scene_id, CAST(20 + floor(65 * count(DISTINCT CASE WHEN tile_id < 7 THEN tile_id END) / count(DISTINCT tile_id)) AS INTEGER) AS progress FROM tiled t GROUP BY 1")
def _(spark, sf):
    t = tiles.assign_tiles(points(spark, sf), SIZE, GROW, 20).select("scene_id", "tile_id").distinct()
    return st.progress_pct(t.filter("tile_id < 7"), t.groupBy("scene_id").agg(F.count("*").alias("n_tiles")))


# status, streams: each reads the table as a stream until it is through, and gives what the sink holds


def _stream(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _sunk(spark, made, mode: str):
    """Runs a streaming frame over all that is there, into a table of the shared folder."""
    path, seen = new_path(spark), new_path(spark)

    def keep(batch, number: int) -> None:
        batch.write.parquet(f"{path}/{number:09d}")

    made.writeStream.outputMode(mode).option("checkpointLocation", seen).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(made.schema).parquet(path)


@query("t1_latest_status_stream", LATEST)
def _(spark, sf):
    made = st.latest_status(status_of(_stream(spark, sf, "events")))
    return _sunk(spark, made, "complete").groupBy("task_id").agg(F.max_by(F.struct("step", "progress", "n_reports", "status"), "n_reports").alias("s")).select("task_id", "s.*")


@query("t2_step_timer", f"SELECT * FROM ({DURATIONS}) WHERE seconds IS NOT NULL")
def _(spark, sf):
    return _plain(_sunk(spark, st.step_timer(status_of(_stream(spark, sf, "events"))), "append"), "started")


@query("t3_pending_requests_stream", S + " SELECT c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT task_id FROM status WHERE step IN ('completed', 'failed'))")
def _(spark, sf):
    asked = _stream(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    return st.latest_pending(_sunk(spark, st.pending_requests_stream(asked, status_of(_stream(spark, sf, "events"))), "append"))


@query("t7_progress_stream", TILES + " SELECT t.scene_id, CAST(20 + floor(65 * count(DISTINCT CASE WHEN tile_id < 7 THEN tile_id END) / count(DISTINCT tile_id)) AS INTEGER) AS progress FROM tiled t GROUP BY 1")
def _(spark, sf):
    """Tiles come in as files, two at a time; a scene's highest progress is its last one."""
    path = new_path(spark)
    t = written(tiles.assign_tiles(points(spark, sf), SIZE, GROW, 20).select("scene_id", "tile_id").distinct())
    t.filter("tile_id < 7").repartition(4, "tile_id").write.parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)
    made = st.progress_pct(stream, t.groupBy("scene_id").agg(F.count("*").alias("n_tiles")))
    return _sunk(spark, made, "complete").groupBy("scene_id").agg(F.max("progress").alias("progress"))


@query("t4_run_timeouts_stream", S + """, r AS (SELECT task_id, min(ts) FILTER (step IN ('reading', 'inferring')) AS started, min(ts) FILTER (step IN ('completed', 'failed')) AS ended FROM status GROUP BY 1), n AS (SELECT epoch_ms(max(ts)) - 3600000 AS w FROM status)
SELECT task_id, started FROM r, n WHERE started IS NOT NULL AND NOT coalesce(ended >= started AND epoch_us(ended) - epoch_us(started) <= 72000000000, false) AND w > epoch_ms(started) + 72000000""")
def _(spark, sf):
    stream = status_of(_stream(spark, sf, "events")).withWatermark("ts", "1 hour")
    return _plain(_sunk(spark, st.run_timeouts_stream(stream), "append"), "started")


@query("t5_telemetry_stream", S + ", m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM status) SELECT step, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM status GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT w FROM m)")
def _(spark, sf):
    made = st.telemetry_windows(status_of(_stream(spark, sf, "events")), size="1 day", late="1 day")
    return _plain(_sunk(spark, made, "append").select("step", "window_start", "n"), "window_start")


BEST_TILE = TILES + """, preds AS (SELECT scene_id, pid, tile_id, sem_pred AS semantic_pred, inst_pred AS instance_pred, CAST((pid * 31 + tile_id * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM tiled)
SELECT scene_id, pid, tile_id, semantic_pred, instance_pred, score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, pid ORDER BY score DESC, tile_id) AS k FROM preds) WHERE k = 1"""


def _merged_stream(spark, sf, expected):
    """A store of tile merges after a stream of tiles, two files a batch."""
    path = new_path(spark)
    preds = tile_preds(spark, sf)
    preds.repartition(4, "tile_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    n_rows = preds.groupBy("scene_id").agg(F.count("*").alias("n_rows")) if expected else None
    store = tile_merge.TileMerge(spark, f"{path}/store", points(spark, sf), n_rows)
    tile_merge.merge_tiles_streaming(stream, store, f"{path}/seen").awaitTermination()
    return store


@query("t6_merge_tiles_streaming", BEST_TILE)
def _(spark, sf):
    return _merged_stream(spark, sf, False).winners()


@query("t6_merge_tiles_upsert", PREDS + " SELECT * FROM merged")
def _(spark, sf):
    """The rows of j3_merge_tile_predictions, scene by scene as its last tile comes in."""
    return _merged_stream(spark, sf, True).result()


# text


@query("f1_tree_prompts", P + ", " + tree_sql("points") + " SELECT scene_id, tree_id, n_points, height_m, leaf_wood_ratio FROM trees")
def _(spark, sf):
    made = text.tree_prompts(metrics.tree_metrics(points(spark, sf)))
    body = F.regexp_extract("user", r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "tree_id int, n_points bigint, height_m double, leaf_wood_ratio double")
    return made.select("scene_id", parsed.alias("p")).select("scene_id", "p.*")


@query("f2_scene_prompts", TOP + """, scenes AS (SELECT scene_id FROM points UNION SELECT CAST(n_nationkey AS INTEGER) FROM nation)
SELECT scene_id, count(top.scene_id) AS n_trees FROM scenes LEFT JOIN top USING (scene_id) GROUP BY 1""")
def _(spark, sf):
    """A request for every scene with points, by all its trees, and for the planned scenes (one a nation), most of which have no trees."""
    p = points(spark, sf)
    scenes = p.select("scene_id").union(table(spark, sf, "nation").select(F.col("n_nationkey").cast("int")))
    made = text.scene_prompts(scenes, metrics.stand_summary(metrics.tree_metrics(p)), "zh")
    n = F.regexp_extract("user", r'"n_trees" : (\d+)', 1)
    return made.select("scene_id", F.when(F.col("user") == text.NO_TREES, 0).otherwise(F.when(n != "", n.cast("long"))).cast("long").alias("n_trees"))


@query("f3_parse_status", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS progress FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    good = F.concat(F.lit('{"step":"x","progress":'), F.get_json_object("props", "$.k"), F.lit("}"))
    raw = F.when(F.col("event_id") % 5 == 0, F.lit('{"step":')).otherwise(good)
    return e.select("event_id", text.parse_status(F.base64(F.encode(raw, "utf-8")), encoded=True)["progress"].alias("progress"))


@query("f3_parse_listing", """SELECT CAST(doc_id AS VARCHAR) AS id, '/d/' || source || '/f.las' AS path, CASE WHEN doc_id % 3 = 0 THEN 7 WHEN doc_id % 3 = 1 THEN n_chars ELSE -1 END AS size, doc_id % 2 = 1 AS has_result, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'f.las' END AS name FROM documents""")
def _(spark, sf):
    c = F.col
    size = F.when(c("doc_id") % 3 == 1, c("n_chars").cast("string")).otherwise("?")
    meta = F.when(c("doc_id") % 3 == 0, F.lit('{"name":"other","size":7}')).otherwise(F.lit(""))
    line = F.concat(c("doc_id"), F.lit("|/d/"), "source", F.lit("/f.las|"), size, F.lit("|"), (c("doc_id") % 2), F.lit("|"), meta)
    return text.parse_listing(table(spark, sf, "documents").select(line.alias("value"))).na.fill(-1, ["size"])


@query("f4_scene_attributes", P + " SELECT DISTINCT scene_id, 'SITE' AS site, CAST(scene_id AS VARCHAR) AS plot, CASE scene_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM points")
def _(spark, sf):
    return _names(spark, sf).select("scene_id", *text.scene_attributes(F.col("name")))


@query("j9_result_index", S + """, l AS (SELECT task_id, arg_max(step, event_id) AS step FROM status GROUP BY 1), s AS (SELECT task_id, CASE WHEN step IN ('completed', 'failed') THEN step ELSE 'processing' END AS status FROM l),
 r AS (SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_custkey % 3 = 0 AS has_result, c_custkey % 5 = 0 AS has_viewer FROM customer),
 j AS (SELECT coalesce(r.task_id, s.task_id) AS task_id, name, coalesce(has_result, false) AS has_result, coalesce(has_viewer, false) AS has_viewer, status FROM r FULL JOIN s ON r.task_id = s.task_id)
SELECT task_id, coalesce(name, 'dataset_' || d.p_partkey) AS name, has_result, has_viewer, coalesce(status, 'completed') AS status FROM j LEFT JOIN part d ON d.p_partkey = task_id
WHERE (has_result OR has_viewer OR status IN ('completed', 'failed')) AND coalesce(status, 'completed') <> 'processing'""")
def _(spark, sf):
    c = F.col("c_custkey")
    results = table(spark, sf, "customer").select(c.alias("task_id"), F.when(c % 2 == 0, F.col("c_name")).alias("name"), (c % 3 == 0).alias("has_result"), (c % 5 == 0).alias("has_viewer"))
    datasets = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("dataset_"), "p_partkey").alias("name"))
    return files.result_index(datasets, results, st.latest_status(status_events(spark, sf)))


# a user's predictor


def height_bands(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A test predictor: ground below half a metre, else trees on a 10 m grid; fails on tiles of very few points."""
    if len(xyz) < 30:
        raise ValueError("too few points")
    ground = xyz[:, 2] < 0.5
    tree = np.floor(xyz[:, 0] / 10).astype(int) * 20 + np.floor(xyz[:, 1] / 10).astype(int) + 50
    return np.where(ground, 0, 1), np.where(ground, -1, tree), np.where(ground, 0.25, 0.75)


@query("u1_segment", TILES + """, ok AS (SELECT scene_id, tile_id FROM tiled GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT scene_id, tile_id, pid, CAST(CASE WHEN z < 0.5 THEN 0 ELSE 1 END AS INTEGER) AS semantic_pred, CAST(CASE WHEN z < 0.5 THEN -1 ELSE floor(x / 10) * 20 + floor(y / 10) + 50 END AS INTEGER) AS instance_pred, CASE WHEN z < 0.5 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS score FROM tiled JOIN ok USING (scene_id, tile_id)""")
def _(spark, sf):
    return predict.segment(tiles.assign_tiles(points(spark, sf), SIZE, GROW, 20), height_bands)[0]


@query("u1_failed_tiles", TILES + " SELECT scene_id, tile_id, 'ValueError: too few points' AS error FROM tiled GROUP BY 1, 2 HAVING count(*) < 30")
def _(spark, sf):
    return predict.segment(tiles.assign_tiles(points(spark, sf), SIZE, GROW, 20), height_bands)[1]


@query("u1_needs_tiles", P + " SELECT scene_id, count(*) AS n_points, count(*) > 5730 AS tiled FROM points GROUP BY 1")
def _(spark, sf):
    return predict.needs_tiles(points(spark, sf), 5730)


CAP = 150


def _quarter_sql(levels: int) -> str:
    """Tiles of more than CAP rows in quarters, level by level, with the overlap kept; ``done`` has the tiles that stay."""
    g, out = f"CAST({GROW} AS DOUBLE)", TILES + """, base AS (SELECT h.scene_id, pid, x, y, ix, iy, '' AS path, e.x0 + ix * CAST({0} AS DOUBLE) AS lx, e.y0 + iy * CAST({0} AS DOUBLE) AS ly FROM held h JOIN numbered n USING (scene_id, ix, iy) JOIN ext e USING (scene_id)),
 l0 AS (SELECT *, count(*) OVER (PARTITION BY scene_id, ix, iy) AS n FROM base)""".format(SIZE)
    for k in range(1, levels + 1):
        half = f"CAST({SIZE / 2**k} AS DOUBLE)"
        sides = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(a, b)"
        inside = f"x >= lx + a * {half} - {g} AND x <= lx + (a + 1) * {half} + {g} AND y >= ly + b * {half} - {g} AND y <= ly + (b + 1) * {half} + {g}"
        out += f""", q{k} AS (SELECT scene_id, pid, x, y, ix, iy, path || (2 * a + b) AS path, lx + a * {half} AS lx, ly + b * {half} AS ly FROM l{k - 1}, {sides} WHERE n > {CAP} AND {inside}),
 l{k} AS (SELECT *, count(*) OVER (PARTITION BY scene_id, ix, iy, path) AS n FROM q{k})"""
    every = " UNION ALL ".join(f"SELECT scene_id, pid, ix, iy, path, n FROM l{k}" + (f" WHERE n <= {CAP}" if k < levels else "") for k in range(levels + 1))
    return out + f", done AS ({every})"


LEVELS = 2


@query("u1_adaptive_tiles", _quarter_sql(LEVELS) + f" SELECT scene_id, ix, iy, path, count(*) AS n_points, ceil(count(*) / {CAP}) AS n_parts FROM done GROUP BY 1, 2, 3, 4".replace("ceil(", "CAST(ceil(").replace(") AS n_parts", ") AS BIGINT) AS n_parts"))
def _(spark, sf):
    made = predict.adaptive_tiles(points(spark, sf), SIZE, GROW, CAP, 20, levels=LEVELS)
    return made.groupBy("scene_id", "ix", "iy", "path").agg(F.count("*").alias("n_points"), F.countDistinct("part").alias("n_parts"))


def low_and_high(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A test predictor whose answer for a point doesn't depend on its tile."""
    if len(xyz) > CAP:
        raise ValueError("too many points")
    ground = xyz[:, 2] < 0.5
    return np.where(ground, 0, 1), np.where(ground, -1, np.floor(xyz[:, 2]).astype(int)), np.where(ground, 0.25, 0.75)


@query("u1_segment_adaptive", _quarter_sql(LEVELS) + " SELECT scene_id, pid, min(CAST(CASE WHEN z < 0.5 THEN 0 ELSE 1 END AS INTEGER)) AS semantic_pred, min(CASE WHEN z < 0.5 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END) AS score, count(*) AS n_tiles FROM done JOIN points USING (scene_id, pid) GROUP BY 1, 2")
def _(spark, sf):
    """Every point that a tile of the fixed grid has is predicted in each tile that holds it, none of more than CAP points."""
    found, failed = predict.segment_scenes(points(spark, sf), low_and_high, SIZE, GROW, CAP, 20, levels=LEVELS)
    assert failed.isEmpty()
    return found.groupBy("scene_id", "pid").agg(F.min("semantic_pred").alias("semantic_pred"), F.min("score").alias("score"), F.count("*").alias("n_tiles"))


@query("flagship_tree_heights", TILES.replace("HAVING count(*) >= 20", "HAVING count(*) >= 20") + """, preds AS (SELECT scene_id, pid, tile_id, sem_pred AS semantic_pred, inst_pred AS instance_pred, CAST((pid * 31 + tile_id * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM tiled),
 tmax AS (SELECT scene_id, tile_id, max(instance_pred) AS m FROM preds GROUP BY 1, 2),
 toff AS (SELECT *, CAST(coalesce(sum(CASE WHEN m >= 0 THEN m + 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS id_offset FROM tmax),
 ranked AS (SELECT p.*, id_offset, row_number() OVER (PARTITION BY p.scene_id, pid ORDER BY score DESC, p.tile_id) AS k FROM preds p JOIN toff USING (scene_id, tile_id)),
 won AS (SELECT p.scene_id, p.pid, x, y, z, semantic_pred AS sem_pred, CASE WHEN instance_pred >= 0 THEN instance_pred + id_offset ELSE -1 END AS inst_pred, r.score FROM ranked r JOIN points p ON p.scene_id = r.scene_id AND p.pid = r.pid WHERE k = 1), """ + tree_sql("won") + " SELECT scene_id, tree_id, n_points, height_m, wood_points, leaf_points, base_z FROM trees")
def _(spark, sf):
    measured = merged(spark, sf).join(points(spark, sf).select("scene_id", "pid", "x", "y", "z"), ["scene_id", "pid"])
    return metrics.tree_metrics(measured).select("scene_id", "tree_id", "n_points", "height_m", "wood_points", "leaf_points", "base_z")
