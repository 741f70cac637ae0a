"""Tiles with overlap, sliding cylinders, and the merge of predictions made per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.functions.keys import floor_long


def scene_extent(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Count, bounds and extents of each scene."""
    aggregates = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    found = points.groupBy(by).agg(F.count("*").alias("n_points"), *aggregates)
    return found.withColumns({f"extent_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"})


def _steps(low: Column, high: Column) -> Column:
    """All whole numbers from low to high; none if high is lower."""
    return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))


def tile_rows(points: DataFrame, tile_size: float, overlap: float, by: str = "scene_id") -> DataFrame:
    """Every point in every tile whose rectangle, grown by the overlap, holds it: points with ix and iy.

    The tiles that can hold a point follow from its place by arithmetic and are checked exactly: no range join."""
    size, grown = F.lit(float(tile_size)), F.lit(float(overlap))
    extent = scene_extent(points, by).select(by, *[F.col(f"min_{a}") for a in "xy"], *[F.greatest(F.lit(1), F.ceil(F.col(f"extent_{a}") / size)).cast("long").alias(f"n{a}") for a in "xy"])
    out = points.join(extent, by)
    for a in "xy":
        low = F.greatest(F.lit(0), floor_long((F.col(a) - grown - F.col(f"min_{a}")) / size) - 1).cast("long")
        high = F.least(F.col(f"n{a}") - 1, floor_long((F.col(a) + grown - F.col(f"min_{a}")) / size) + 1).cast("long")
        out = out.withColumn(f"i{a}", _steps(low, high))
        edge = F.col(f"min_{a}") + F.col(f"i{a}") * size
        next_edge = F.col(f"min_{a}") + (F.col(f"i{a}") + 1) * size
        out = out.filter((F.col(a) >= edge - grown) & (F.col(a) <= next_edge + grown))
    return out.drop("min_x", "min_y", "nx", "ny")


def number_tiles(counts: DataFrame, min_points: int = 100, by: str = "scene_id") -> DataFrame:
    """Drops tiles of few points and numbers the others from 0 in the order of ix, iy."""
    order = Window.partitionBy(by).orderBy("ix", "iy")  # tiles of one scene: a small table
    return counts.filter(F.col("n_points") >= min_points).withColumn("tile_id", (F.row_number().over(order) - 1).cast("int"))


def assign_tiles(points: DataFrame, tile_size: float, overlap: float, min_points: int = 100, by: str = "scene_id") -> DataFrame:
    """points with tile_id, once for each tile that holds them."""
    rows = tile_rows(points, tile_size, overlap, by)
    tiles = number_tiles(rows.groupBy(by, "ix", "iy").agg(F.count("*").alias("n_points")), min_points, by)
    return rows.join(tiles.select(by, "ix", "iy", "tile_id"), [by, "ix", "iy"]).drop("ix", "iy")


def tile_meta(points: DataFrame, tile_size: float, overlap: float, min_points: int = 100, by: str = "scene_id") -> DataFrame:
    """Each tile's number of points, grown bounds, core bounds (no farther than the scene) and coordinate offsets."""
    size, grown = F.lit(float(tile_size)), F.lit(float(overlap))
    counts = tile_rows(points, tile_size, overlap, by).groupBy(by, "ix", "iy").agg(F.count("*").alias("n_points"), F.avg("x").alias("off_x"), F.avg("y").alias("off_y"))
    extent = scene_extent(points, by).select(by, "min_x", "min_y", "max_x", "max_y", F.col("min_z").alias("off_z"))
    out = number_tiles(counts, min_points, by).join(extent, by)
    for a in "xy":
        low = F.col(f"min_{a}") + F.col(f"i{a}") * size
        high = F.col(f"min_{a}") + (F.col(f"i{a}") + 1) * size
        out = out.withColumns({f"low_{a}": low - grown, f"high_{a}": high + grown, f"core_low_{a}": low, f"core_high_{a}": F.least(high, F.col(f"max_{a}"))})
    return out.drop("min_x", "min_y", "max_x", "max_y", "ix", "iy")


def running_offsets(tiles: DataFrame, by: str = "scene_id") -> DataFrame:
    """The instance id offset of each tile (by, tile_id, max_instance): the sum of max + 1 over earlier tiles with instances."""
    width = F.when(F.col("max_instance") >= 0, F.col("max_instance") + 1).otherwise(0)
    before = Window.partitionBy(by).orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("id_offset", F.coalesce(F.sum(width).over(before), F.lit(0)).cast("long"))


def merge_tile_predictions(preds: DataFrame, points: DataFrame, by: str = "scene_id") -> DataFrame:
    """One prediction for every point of points (by, pid): that of the tile with the highest score above -1, of the
    earlier tile on a tie; instance ids get their tile's offset. Points without one have -1 everywhere.

    preds: by, pid, tile_id, semantic_pred, instance_pred, score."""
    tiles = running_offsets(preds.groupBy(by, "tile_id").agg(F.max("instance_pred").alias("max_instance")), by)
    moved = preds.join(tiles.select(by, "tile_id", "id_offset"), [by, "tile_id"])
    instance = F.when(F.col("instance_pred") >= 0, F.col("instance_pred") + F.col("id_offset")).otherwise(-1).cast("long")
    best = F.max_by(F.struct(F.col("semantic_pred").alias("sem_pred"), instance.alias("inst_pred"), "score"), F.struct(F.col("score"), -F.col("tile_id")))
    winner = moved.filter(F.col("score") > -1).groupBy(by, "pid").agg(best.alias("w")).select(by, "pid", "w.*")
    joined = points.select(by, "pid").join(winner, [by, "pid"], "left")
    return joined.select(by, "pid", *[F.coalesce(F.col(c), F.lit(-1)).cast(t).alias(c) for c, t in (("sem_pred", "int"), ("inst_pred", "long"), ("score", "double"))])


def assign_regions(points: DataFrame, radius: float, step: float | None = None, by: str = "scene_id") -> DataFrame:
    """points with region_id, gx, gy, cx, cy: every cylinder of a lattice of centres that holds them.

    Centres start at the scene's lower corner, step by a quarter of the radius, and end at the upper edge at the latest."""
    step = float(step or radius / 4)
    reach = int(radius / step) + 1
    extent = scene_extent(points, by).select(by, "min_x", "min_y", *[floor_long(F.col(f"extent_{a}") / F.lit(step)).alias(f"last_{a}") for a in "xy"])
    out = points.join(extent, by)
    for a in "xy":
        near = floor_long((F.col(a) - F.col(f"min_{a}")) / F.lit(step))
        out = out.withColumn(f"g{a}", _steps(F.greatest(F.lit(0), near - reach).cast("long"), F.least(F.col(f"last_{a}"), near + reach + 1).cast("long")))
        out = out.withColumn(f"c{a}", F.col(f"min_{a}") + F.col(f"g{a}") * F.lit(step))
    square = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    number = F.col("gx") * (F.col("last_y") + 1) + F.col("gy")
    return out.filter(square <= F.lit(float(radius) * float(radius))).withColumn("region_id", number).drop("min_x", "min_y", "last_x", "last_y")
