"""Point-cloud tables derived from the driver's tables, with the same derivation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (order, line), with what the points are made of."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"))
    d = d.agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("long").alias("q"))
    return d.withColumns({"tree": F.floor(F.col("ok") / 8) % 24, "sem_gt": (F.col("pk") + F.col("ln")) % 3})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, scene_id, x, y, z (metres), sem_gt, inst_gt, sem_pred, inst_pred and score."""
    c = F.col
    d = _rows(spark, sf_dir).withColumn("sem_pred", F.when((c("pk") + c("sk")) % 10 == 0, (c("sem_gt") + 1) % 3).otherwise(c("sem_gt")))
    x = (c("tree") * 2711) % 10000 + (c("pk") * 7) % 401 - 200
    y = (c("tree") * 4409) % 10000 + (c("pk") * 11 + c("sk") * 3) % 401 - 200
    z = F.when(c("sem_gt") == 0, (c("q") % 5) * 10).otherwise(c("q") * 50 + 20)
    inst = (
        F.when(c("sem_pred") == 0, -1)
        .when(c("pk") % 13 == 0, (c("tree") + 1) % 24)
        .when((c("tree") % 6 == 5) & (c("pk") % 2 == 0), 100 + c("tree"))
        .otherwise(c("tree"))
    )
    metres = lambda cm: cm.cast("double") / F.lit(100.0)
    return d.select(
        (c("ok") * 8 + c("ln")).alias("pid"),
        (c("ok") % 8).cast("int").alias("scene_id"),
        metres(x).alias("x"), metres(y).alias("y"), metres(z).alias("z"),
        c("sem_gt").cast("int"), F.when(c("sem_gt") == 0, 0).otherwise(c("tree")).cast("int").alias("inst_gt"),
        c("sem_pred").cast("int"), inst.cast("int").alias("inst_pred"),
        ((1 + (c("tree") * 37 + c("pk") % 5) % 97).cast("double") / F.lit(98.0)).alias("score"),
    )


#: Begins every query of the oracle: ``points`` as above.
POINTS_SQL = """WITH rows0 AS (
  SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY 1, 2
), rows1 AS (SELECT *, (ok // 8) % 24 AS tree, (pk + ln) % 3 AS sem_gt FROM rows0
), rows2 AS (SELECT *, CASE WHEN (pk + sk) % 10 = 0 THEN (sem_gt + 1) % 3 ELSE sem_gt END AS sem_pred FROM rows1
), points AS (
  SELECT ok * 8 + ln AS pid, CAST(ok % 8 AS INTEGER) AS scene_id,
    CAST((tree * 2711) % 10000 + (pk * 7) % 401 - 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS x,
    CAST((tree * 4409) % 10000 + (pk * 11 + sk * 3) % 401 - 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS y,
    CAST(CASE WHEN sem_gt = 0 THEN (q % 5) * 10 ELSE q * 50 + 20 END AS DOUBLE) / CAST(100 AS DOUBLE) AS z,
    CAST(sem_gt AS INTEGER) AS sem_gt, CAST(CASE WHEN sem_gt = 0 THEN 0 ELSE tree END AS INTEGER) AS inst_gt, CAST(sem_pred AS INTEGER) AS sem_pred,
    CAST(CASE WHEN sem_pred = 0 THEN -1 WHEN pk % 13 = 0 THEN (tree + 1) % 24 WHEN tree % 6 = 5 AND pk % 2 = 0 THEN 100 + tree ELSE tree END AS INTEGER) AS inst_pred,
    CAST(1 + (tree * 37 + pk % 5) % 97 AS DOUBLE) / CAST(98 AS DOUBLE) AS score
  FROM rows2
)"""


def mask_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, mask_id, pid and prob of overlapping masks: whole trees, two thirds of them, and quarters of neighbouring trees."""
    c = F.col
    p = points(spark, sf_dir).join(_rows(spark, sf_dir).select((c("ok") * 8 + c("ln")).alias("pid"), "pk", "tree"), "pid")
    prob = (F.col("pid") * 7 % 100).cast("double") / F.lit(100.0)
    masks = F.array(
        F.when(c("inst_pred") >= 0, c("inst_pred")),
        F.when((c("inst_pred") >= 0) & (c("pk") % 3 != 0), c("inst_pred") + 1000),
        F.when(c("pk") % 4 == 0, c("tree") + 2000),
        F.when(c("pk") % 4 == 0, (c("tree") + 23) % 24 + 2000),
    )
    return p.select("scene_id", F.explode(masks).alias("mask_id"), "pid", prob.alias("prob")).filter("mask_id IS NOT NULL").select("scene_id", F.col("mask_id").cast("int"), "pid", "prob")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, mask_id, label and score of every mask."""
    found = mask_points(spark, sf_dir).select("scene_id", "mask_id").distinct()
    return found.select("scene_id", "mask_id", F.lit(0).alias("label"), (((F.col("mask_id") * 37) % 89 + 1).cast("double") / F.lit(90.0)).alias("score"))


MASKS_SQL = POINTS_SQL + """, mask_points AS (
  SELECT scene_id, CAST(mask_id AS INTEGER) AS mask_id, pid, CAST(pid * 7 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS prob FROM (
    SELECT p.*, unnest([
      CASE WHEN inst_pred >= 0 THEN inst_pred END, CASE WHEN inst_pred >= 0 AND pk % 3 <> 0 THEN inst_pred + 1000 END,
      CASE WHEN pk % 4 = 0 THEN tree + 2000 END, CASE WHEN pk % 4 = 0 THEN (tree + 23) % 24 + 2000 END]) AS mask_id
    FROM points p JOIN rows2 r ON p.pid = r.ok * 8 + r.ln
  ) WHERE mask_id IS NOT NULL
), masks AS (
  SELECT DISTINCT scene_id, mask_id, 0 AS label, CAST((mask_id * 37) % 89 + 1 AS DOUBLE) / CAST(90 AS DOUBLE) AS score FROM mask_points
)"""


def votes(spark: SparkSession, sf_dir: str, radius: float = 16.0) -> DataFrame:
    """pid, region_id and class: what the regions that hold a point say of it."""
    from standmill.operators.tiles import assign_regions

    held = assign_regions(points(spark, sf_dir), radius)
    return held.select("scene_id", "pid", "region_id", ((F.col("sem_pred") + F.col("region_id") % 5 % 2) % 3).cast("int").alias("class"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, ts, step, progress and value of a stream of job reports."""
    e = table(spark, sf_dir, "events")
    return status_of(e)


def status_of(events: DataFrame) -> DataFrame:
    """Job reports from event rows, batch or stream."""
    kind = F.col("event_type")
    step = F.when(kind == "signup", "queued").when(kind == "view", "reading").when(kind == "click", "inferring").when(kind == "purchase", "completed").otherwise("failed")
    return events.select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), step.alias("step"), F.get_json_object("props", "$.k").cast("int").alias("progress"), "value")


STATUS_SQL = """WITH status AS (
  SELECT user_id AS task_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'reading' WHEN 'click' THEN 'inferring' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS step,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS progress, value
  FROM events
)"""
