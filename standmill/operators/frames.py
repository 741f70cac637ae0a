"""Projections, filters and coordinate frames of point tables (scene_id, pid, x, y, z, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standmill.functions.keys import floor_long, hash_order, uniform
from standmill.sources.storage import written

#: Colours of the viewer.
GROUND_COLOUR, GREY = (139, 115, 85), (80, 80, 80)
N_COLOURS = 26
#: Cells of noise (27 numbers each) that are broadcast.
FEW_CELLS = 50_000


def scene_offsets(points: DataFrame, by: str = "scene_id", z_ref: str = "scene", unmoved: Column | None = None) -> DataFrame:
    """The offsets of each scene or tile: mean x, mean y, and the lowest z of the scene ('scene') or of all ('global')."""
    own = points.groupBy(by).agg(F.avg("x").alias("off_x"), F.avg("y").alias("off_y"), F.min("z").alias("off_z"))
    if z_ref == "global":
        own = own.drop("off_z").crossJoin(points.agg(F.min("z").alias("off_z")))  # one row
    if unmoved is not None:
        own = own.select(by, *[F.when(unmoved, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("off_x", "off_y", "off_z")])
    return own


def normalize_coords(points: DataFrame, by: str = "scene_id", z_ref: str = "scene", unmoved: Column | None = None) -> DataFrame:
    """x, y and z relative to the offsets, which are kept as columns."""
    moved = points.join(scene_offsets(points, by, z_ref, unmoved), by)
    return moved.withColumns({a: F.col(a) - F.col(f"off_{a}") for a in "xyz"})


def restore_coords(points: DataFrame) -> DataFrame:
    return points.withColumns({a: F.col(a) + F.col(f"off_{a}") for a in "xyz"}).drop("off_x", "off_y", "off_z")


def prepare_labels(points: DataFrame, semantic: str = "semantic_seg", tree: str = "tree_id") -> DataFrame:
    """Classes from 0, and 0 as the instance of ground points."""
    label = F.col(semantic) - 1
    return points.withColumns({"semantic": label, "instance": F.when(label == 0, 0).otherwise(F.col(tree))})


def drop_ignored(points: DataFrame, class_ids: Sequence[int], semantic: str = "semantic") -> DataFrame:
    return points.filter(~F.col(semantic).isin(*class_ids))


def mark_ignored(points: DataFrame, num_classes: int, semantic: str = "semantic", instance: str = "instance") -> DataFrame:
    """-1 for both labels where the class is the one after the last."""
    ignored = F.col(semantic) == num_classes
    return points.withColumns({instance: F.when(ignored, -1).otherwise(F.col(instance)), semantic: F.when(ignored, -1).otherwise(F.col(semantic))})


def background_instances(points: DataFrame, semantic: str = "semantic", instance: str = "instance") -> DataFrame:
    ground = F.col(semantic) == 0
    return points.withColumns({instance: F.when(ground, -1).otherwise(F.col(instance)), "foreground": ~ground})


def binary_class(semantic: Column, stuff: Sequence[int] = (1,), thing: Sequence[int] = (2, 3)) -> Column:
    """1 for stuff, 2 for things, 0 for anything else, of a class counted from 0 (-1: none)."""
    shifted = semantic + 1
    return F.when(shifted.isin(*stuff), 1).when(shifted.isin(*thing), 2).otherwise(0)


def range_filter(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points strictly inside a box."""
    inside = F.lit(True)
    for a, lo, hi in zip("xyz", low, high):
        inside = inside & (F.col(a) > lo) & (F.col(a) < hi)
    return points.filter(inside)


def center_crop(points: DataFrame, half: float, by: str = "scene_id") -> DataFrame:
    """The square of a half width around the middle of each scene's extent, edges included."""
    middle = points.groupBy(by).agg(*[((F.min(a) + F.max(a)) / 2).alias(f"mid_{a}") for a in "xy"])
    near = (F.abs(F.col("x") - F.col("mid_x")) <= half) & (F.abs(F.col("y") - F.col("mid_y")) <= half)
    return points.join(middle, by).filter(near).drop("mid_x", "mid_y")


def hashed_centers(points: DataFrame, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """One point of each scene, by the lowest hash: cx, cy."""
    first = F.min_by(F.struct(F.col("x").alias("cx"), F.col("y").alias("cy")), F.struct(hash_order(F.col("pid"), seed), F.col("pid")))
    return points.groupBy(by).agg(first.alias("c")).select(by, "c.cx", "c.cy")


def cylinder_crop(points: DataFrame, centers: DataFrame, radius: float, closed: bool = False, by: str = "scene_id") -> DataFrame:
    """Points nearer than the radius to a centre (by, cx, cy) of their scene, at the radius too if closed.

    Centres meet the points of their own and the neighbouring grid cells only."""
    cell = lambda c: floor_long(c / F.lit(float(radius)))
    around = F.array([F.lit(k).cast("long") for k in (-1, 0, 1)])
    spread = centers.select("*", cell(F.col("cx")).alias("ix"), cell(F.col("cy")).alias("iy"))
    spread = spread.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"ix": F.col("ix") + F.col("dx"), "iy": F.col("iy") + F.col("dy")}).drop("dx", "dy")
    near = points.withColumns({"ix": cell(F.col("x")), "iy": cell(F.col("y"))}).join(spread, [by, "ix", "iy"])
    square = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    limit = F.lit(float(radius) * float(radius))
    return near.filter(square <= limit if closed else square < limit).drop("ix", "iy")


def color_instances(points: DataFrame, instance: str = "inst_pred", semantic: str = "sem_pred") -> DataFrame:
    """Colour number and flag: the instance's colour and 255, ground's (-1) and 128, or grey (-2) and 0."""
    tree, ground = F.col(instance) >= 0, F.col(semantic) == 0
    return points.withColumns(
        {"colour": F.when(tree, F.pmod(F.col(instance), F.lit(N_COLOURS))).when(ground, -1).otherwise(-2), "flag": F.when(tree, 255).when(ground, 128).otherwise(0)}
    )


def palette_rgb(colour: Column) -> Column:
    """r, g, b (SMALLINT) of a colour number; the palette steps round the colour wheel by the golden angle."""
    hue = (colour * 137) % 360
    part = lambda shift: F.round(127.5 * (1 + F.cos(F.radians(hue - F.lit(shift)))), 0)
    pick = lambda k, shift: F.when(colour == -1, GROUND_COLOUR[k]).when(colour == -2, GREY[k]).otherwise(part(shift)).cast("smallint")
    return F.struct(pick(0, 0).alias("r"), pick(1, 120).alias("g"), pick(2, 240).alias("b"))


def color_semantic(points: DataFrame, semantic: str = "sem_pred") -> DataFrame:
    """The class as colour number: 0 ground, 1 wood, 2 leaf, 3 anything else."""
    return points.withColumn("colour", F.when(F.col(semantic).isin(0, 1, 2), F.col(semantic)).otherwise(3))


def normalize_color(points: DataFrame, mean: Sequence[float], std: Sequence[float], columns: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    return points.withColumns({c: (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, mean, std)})


def align(points: DataFrame, transforms: DataFrame, by: str = "scene_id") -> DataFrame:
    """Rotates and shifts each scene by its matrix (by, m: array of 16, row by row).

    A matrix that is no rotation about the vertical axis with a shift raises an error."""
    m = lambda r, c: F.element_at("m", 4 * r + c + 1)
    near = lambda a, b: F.abs(a - b) < 1e-6
    flat = near(m(2, 2), F.lit(1.0)) & near(m(0, 2), F.lit(0.0)) & near(m(1, 2), F.lit(0.0)) & near(m(2, 0), F.lit(0.0)) & near(m(2, 1), F.lit(0.0))
    ok = flat & near(m(0, 0) * m(1, 1) - m(0, 1) * m(1, 0), F.lit(1.0)) & near(m(0, 0) * m(0, 0) + m(0, 1) * m(0, 1), F.lit(1.0))
    checked = transforms.withColumn("m", F.when(ok, F.col("m")).otherwise(F.raise_error(F.lit("not a rotation about the vertical axis")).cast("array<double>")))
    joined = points.join(F.broadcast(checked.select(by, "m")), by)  # a row for each scene of a user's small table
    rows = {a: m(r, 0) * F.col("x") + m(r, 1) * F.col("y") + m(r, 2) * F.col("z") + m(r, 3) for r, a in enumerate("xyz")}
    return joined.withColumns(rows).drop("m")


def random_flip(points: DataFrame, probability: float = 0.5, axis: str = "y", seed: int = 0, by: str = "scene_id") -> DataFrame:
    """Negates an axis of a scene's points and offset vectors, by a coin for each scene."""
    coin = uniform(F.col(by), seed) < probability
    names = [c for c in (axis, f"off{axis}") if c in points.columns]
    return points.withColumns({c: F.when(coin, -F.col(c)).otherwise(F.col(c)) for c in names} | {"flipped": coin})


def random_rot_scale_trans(points: DataFrame, angle: float, scale: tuple[float, float], shift: float, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """Turns each scene by an angle in [-angle, angle], scales it, and shifts it by up to shift along each axis.

    Offset vectors (offx, offy, offz), where there are any, are turned and scaled but not shifted."""
    key = F.col(by)
    turn = (uniform(key, seed) * 2 - 1) * F.lit(float(angle))
    size = uniform(key, seed + 1) * F.lit(float(scale[1] - scale[0])) + F.lit(float(scale[0]))
    move = {a: (uniform(key, seed + 2 + k) * 2 - 1) * F.lit(float(shift)) for k, a in enumerate("xyz")}

    def turned(x: str, y: str, z: str) -> list[Column]:
        return [(F.col(x) * F.cos(turn) - F.col(y) * F.sin(turn)) * size, (F.col(x) * F.sin(turn) + F.col(y) * F.cos(turn)) * size, F.col(z) * size]

    out = {a: v + move[a] for a, v in zip("xyz", turned("x", "y", "z"))}
    if "offx" in points.columns:
        out |= dict(zip(("offx", "offy", "offz"), turned("offx", "offy", "offz")))
    return points.withColumns(out)


def jitter(points: DataFrame, std: float = 0.01, clip: float = 0.05, seed: int = 0) -> DataFrame:
    """Adds clipped gaussian noise to every axis (Box-Muller on hashes of the point's id)."""

    def noise(k: int) -> Column:
        u, v = uniform(F.col("pid"), seed + 2 * k + 1), uniform(F.col("pid"), seed + 2 * k + 2)
        return F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(3.141592653589793) * v) * F.lit(float(std))))

    return points.withColumns({a: F.col(a) + noise(k) for k, a in enumerate("xyz")})


def elastic_distort(points: DataFrame, gran: float, mag: float, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """Shifts points by smooth noise: gaussian noise on a grid of step gran, blurred twice by three-cell means along each
    axis, interpolated linearly between the eight nodes around a point, times mag. Only nodes near points are made.

    A cell's eight nodes are one row, and every point meets that of its cell once: by a broadcast if the cells are few."""
    index = {f"_i{a}": floor_long(F.col(a) / F.lit(float(gran))) for a in "xyz"}
    cell = [by, *index]
    placed = points.withColumns(index)
    steps = lambda lo, hi: F.explode(F.array([F.lit(k).cast("long") for k in range(lo, hi + 1)]))
    cells = nodes = placed.select(*cell).distinct()
    for a in "xyz":  # corners, and as far as two blurs reach
        nodes = nodes.withColumn("d", steps(-2, 3)).withColumn(f"_i{a}", F.col(f"_i{a}") + F.col("d")).drop("d").distinct()
    key = F.pmod(F.xxhash64(*cell), F.lit(1 << 40))
    gauss = lambda k: F.sqrt(-2 * F.log(1 - uniform(key, seed + 2 * k + 1))) * F.cos(2 * F.lit(3.141592653589793) * uniform(key, seed + 2 * k + 2))
    noise = nodes.select(*cell, *[gauss(k).alias(f"n{a}") for k, a in enumerate("xyz")])
    for _ in range(2):
        for a in "xyz":
            spread = noise.withColumn("d", steps(-1, 1)).withColumn(f"_i{a}", F.col(f"_i{a}") + F.col("d"))
            noise = spread.groupBy(*cell).agg(*[(F.sum(f"n{b}") / 3).alias(f"n{b}") for b in "xyz"])
    corners = cells.withColumns({f"c{a}": F.col(f"_i{a}") for a in "xyz"})
    for a in "xyz":
        corners = corners.withColumn(f"d{a}", steps(0, 1)).withColumn(f"_i{a}", F.col(f"_i{a}") + F.col(f"d{a}"))
    own = F.col("dx") * 4 + F.col("dy") * 2 + F.col("dz")
    of = corners.join(noise, cell).groupBy(by, "cx", "cy", "cz").agg(*[F.max(F.when(own == k, F.col(f"n{a}"))).alias(f"_{a}{k}") for a in "xyz" for k in range(8)])
    made = written(of.withColumnsRenamed({f"c{a}": f"_i{a}" for a in "xyz"}))
    if made.count() <= FEW_CELLS:
        made = F.broadcast(made)
    fraction = {a: F.col(a) / F.lit(float(gran)) - F.col(f"_i{a}") for a in "xyz"}

    def shift(a: str) -> Column:
        weights = [[fraction[b] if k >> at & 1 else 1 - fraction[b] for b, at in (("x", 2), ("y", 1), ("z", 0))] for k in range(8)]
        return sum((x * y * z * F.col(f"_{a}{k}") for k, (x, y, z) in enumerate(weights)), F.lit(0.0))

    return placed.join(made, cell).select(*[(F.col(c) + shift(c) * F.lit(float(mag))).alias(c) if c in ("x", "y", "z") else F.col(f"`{c}`") for c in points.columns])


def voxel_features(points: DataFrame, mode: str, cell: float = 2.0, by: str = "scene_id") -> DataFrame:
    """Features fx, fy, fz of a point: 'centred' coordinates, 'height' above the scene's lowest point alone, or the place
    in a fixed grid 'cell' with the height."""
    if mode not in ("centred", "height", "cell"):
        raise ValueError(f"unknown mode {mode}")
    scene = points.groupBy(by).agg(*[F.avg(a).alias(f"mean_{a}") for a in "xyz"], F.min("z").alias("low"))
    height = F.col("z") - F.col("low")
    middle = lambda a: (F.floor(F.col(a) / cell) + F.lit(0.5)) * F.lit(float(cell))
    made = {
        "centred": [F.col(a) - F.col(f"mean_{a}") for a in "xyz"],
        "height": [F.lit(0.0), F.lit(0.0), height],
        "cell": [F.col("x") - middle("x"), F.col("y") - middle("y"), height],
    }[mode]
    return points.join(scene, by).withColumns(dict(zip(("fx", "fy", "fz"), made))).drop("mean_x", "mean_y", "mean_z", "low")


def split_leftover(points: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The points that no tree has got, as the next round's input, and the others.

    previous: pid and semantic_pred of the round before, which override the current class where present."""
    merged = points
    if previous is not None:
        older = previous.select("pid", F.col("semantic_pred").alias("older"))
        merged = points.join(older, "pid", "left").withColumn("sem_pred", F.coalesce("older", "sem_pred")).drop("older")
    left = F.coalesce((F.col("sem_pred") != 0) & (F.col("inst_pred") == -1), F.lit(False))  # a point without a class is among the others
    again = merged.filter(left).withColumns({"semantic_seg": F.col("sem_gt") + 1, "tree_id": F.col("inst_gt")})
    return again, merged.filter(~left)


def round_number(name: Column) -> Column:
    """The round in a file name that ends in _<round>.ply; null without."""
    found = F.regexp_extract(name, r"_(\d+)\.ply$", 1)
    return F.when(found != "", found.cast("int"))


def filter_scenes(points: DataFrame, min_instances: int = 2, by: str = "scene_id", instance: str = "inst_gt") -> DataFrame:
    """Drops scenes with fewer distinct instances."""
    kept = points.groupBy(by).agg(F.countDistinct(instance).alias("n")).filter(F.col("n") >= min_instances)
    return points.join(kept, by, "left_semi")


def filter_boxes(boxes: DataFrame, bev_range: Sequence[float], classes: Sequence[int]) -> DataFrame:
    """Boxes (cx, cy, yaw, label, ...) whose centre is strictly inside (x0, y0, x1, y1), of some classes; yaw in [-pi, pi)."""
    x0, y0, x1, y1 = map(float, bev_range)
    inside = (F.col("cx") > x0) & (F.col("cx") < x1) & (F.col("cy") > y0) & (F.col("cy") < y1)
    two, pi = F.lit(2 * 3.141592653589793), F.lit(3.141592653589793)
    turned = F.col("yaw") - F.floor((F.col("yaw") + pi) / two) * two
    return boxes.filter(inside & F.col("label").isin(*classes)).withColumn("yaw", turned)
