"""Voxel reductions, voxel labels and samplers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.functions.keys import floor_long, hash_order, morton2d, voxel
from standmill.sources.storage import written
from standmill.operators.frames import voxel_features
from standmill.operators.places import BUCKET_BITS, RANK_LIMIT, lowest_hashes, placed

KEY = ("vx", "vy", "vz")


def dense_ids(df: DataFrame, by: str, id_col: str, keep: int = -1, name: str = "dense_id") -> DataFrame:
    """Ids from 0 without gaps in ascending order per scene; the kept value stays. Only the distinct ids are ranked."""
    order = Window.partitionBy(by).orderBy(id_col)
    ranks = df.filter(F.col(id_col) != keep).select(by, id_col).distinct().withColumn(name, (F.dense_rank().over(order) - 1).cast("int"))
    return df.join(ranks, [by, id_col], "left").withColumn(name, F.coalesce(name, F.lit(keep)))


def with_voxel(points: DataFrame, size: float) -> DataFrame:
    return points.select("*", *voxel(size))


def voxel_mean(points: DataFrame, size: float, by: str = "scene_id") -> DataFrame:
    """A row for each occupied voxel: mean place, lowest pid as its representative, count."""
    return with_voxel(points, size).groupBy(by, *KEY).agg(*[F.avg(a).alias(a) for a in "xyz"], F.min("pid").alias("pid"), F.count("*").alias("n_points"))


def voxel_inverse(points: DataFrame, size: float, by: str = "scene_id") -> DataFrame:
    """pid of every point and of its voxel's representative."""
    placed = with_voxel(points, size).select(by, "pid", *KEY)
    return placed.join(placed.groupBy(by, *KEY).agg(F.min("pid").alias("voxel_pid")), [by, *KEY]).select(by, "pid", "voxel_pid")


def voxelize(points: DataFrame, size: float, mode: str = "centred", by: str = "scene_id") -> DataFrame:
    """Voxel indices from the scene's lowest one, with the mean features of their points."""
    placed = with_voxel(voxel_features(points, mode, by=by), size)
    low = placed.groupBy(by).agg(*[F.min(k).alias(f"low_{k}") for k in KEY])
    return placed.join(low, by).withColumns({k: F.col(k) - F.col(f"low_{k}") for k in KEY}).groupBy(by, *KEY).agg(*[F.avg(f"f{a}").alias(f"f{a}") for a in "xyz"], F.count("*").alias("n_points"))


def sparse_shape(voxels: DataFrame, least: int = 128, by: str = "scene_id") -> DataFrame:
    """The grid's extent: the largest index + 1, at least so many."""
    return voxels.groupBy(by).agg(*[F.greatest(F.max(k) + 1, F.lit(least)).alias(f"n{k[1]}") for k in KEY])


def voxel_pick(points: DataFrame, size: float, order: Column, by: str = "scene_id") -> DataFrame:
    """The point of each voxel that comes first in an order."""
    row = F.struct(*[F.col(c) for c in points.columns])
    return with_voxel(points, size).groupBy(by, *[F.col(k) for k in KEY]).agg(F.min_by(row, order).alias("p")).select("p.*")


def voxel_first(points: DataFrame, size: float, by: str = "scene_id") -> DataFrame:
    return voxel_pick(points, size, F.col("pid"), by)


def voxel_random(points: DataFrame, size: float, seed: int = 0, by: str = "scene_id") -> DataFrame:
    return voxel_pick(points, size, F.struct(hash_order(F.col("pid"), seed), F.col("pid")), by)


def voxel_to_budget(points: DataFrame, max_points: int, v0: float, steps: int = 15, by: str = "scene_id", seed: int = 0) -> DataFrame:
    """The finest voxel reduction that keeps at most max_points in all, by bisection between v0 and 100 v0.

    Everything if that is within the budget already; if even the coarsest is not, the points that hash lowest."""
    if points.count() <= max_points:
        return points
    place = points.select(by, "x", "y", "z")
    low, high, best = v0, 100 * v0, None
    for _ in range(steps):
        middle = (low + high) / 2
        if place.select(by, *voxel(middle)).distinct().count() <= max_points:
            best, high = middle, middle
        else:
            low = middle
    if best is None:
        return points.orderBy(hash_order(F.col("pid"), seed), "pid").limit(max_points)
    return voxel_first(points, best, by)


def _majority(points: DataFrame, size: float, label: str, rank: Column, by: str) -> DataFrame:
    counted = with_voxel(points, size).groupBy(by, *KEY, label).agg(F.count("*").alias("n"))
    return counted.groupBy(by, *KEY).agg(F.max_by(label, F.struct(F.col("n"), -rank)).alias(label))


def voxel_majority_instance(points: DataFrame, size: float, instance: str = "inst_gt", by: str = "scene_id") -> DataFrame:
    """The most frequent instance of each voxel; background (-1) counts and comes last on ties, else the smaller id wins."""
    rank = F.when(F.col(instance) == -1, F.lit(2147483647)).otherwise(F.col(instance))
    return _majority(points, size, instance, rank, by)


def voxel_majority_class(points: DataFrame, size: float, semantic: str = "sem_gt", by: str = "scene_id") -> DataFrame:
    return _majority(points, size, semantic, F.col(semantic), by)


def voxel_instance_masks(points: DataFrame, size: float, instance: str = "inst_gt", share: float = 0.5, by: str = "scene_id") -> DataFrame:
    """Voxels and instances (not background, -1) that hold more than a share of their points."""
    counted = with_voxel(points, size).groupBy(by, *KEY, instance).agg(F.count("*").alias("n"))
    total = counted.groupBy(by, *KEY).agg(F.sum("n").alias("total"))
    return counted.join(total, [by, *KEY]).filter((F.col("n") / F.col("total") > share) & (F.col(instance) != -1)).select(by, *KEY, instance)


def voxel_foreground(points: DataFrame, size: float, semantic: str = "sem_gt", by: str = "scene_id") -> DataFrame:
    return with_voxel(points, size).groupBy(by, *KEY).agg((F.count_if(F.col(semantic) > 0) / F.count("*") > 0.5).cast("int").alias("foreground"))


def voxel_vote_offsets(points: DataFrame, size: float, instance: str = "inst_gt", by: str = "scene_id") -> DataFrame:
    """The mean offset (offx, offy, offz) of each voxel's most frequent instance."""
    main = voxel_majority_instance(points, size, instance, by)
    means = with_voxel(points, size).groupBy(by, *KEY, instance).agg(*[F.avg(f"off{a}").alias(f"off{a}") for a in "xyz"])
    return means.join(main, [by, *KEY, instance])


def superpoint_labels(points: DataFrame, key: str, num_classes: int, stuff: tuple[int, ...] = (0,), merge_things: bool = False, by: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Instance masks (key, instance, label) and classes (key, semantic) of superpoints.

    An instance or class takes a superpoint of which it has more than half; without such a class it is the one after the
    last. Instances of stuff are left out; labels are class numbers without the stuff classes, 0 if things are merged."""
    total = points.groupBy(by, key).agg(F.count("*").alias("total"))

    def half(label: str) -> DataFrame:
        counted = points.groupBy(by, key, label).agg(F.count("*").alias("n"))
        return counted.join(total, [by, key]).filter(F.col("n") / F.col("total") > 0.5).select(by, key, label)

    first = points.groupBy(by, "inst_gt").agg(F.min_by("sem_gt", "pid").alias("label")).filter(~F.col("label").isin(*stuff))
    label = F.lit(0) if merge_things else F.col("label") - len(stuff)
    instances = half("inst_gt").join(first, [by, "inst_gt"]).withColumn("label", label.cast("int"))
    classes = total.select(by, key).join(half("sem_gt"), [by, key], "left").select(by, key, F.coalesce("sem_gt", F.lit(num_classes)).alias("sem_gt"))
    return instances, classes


def sample_points(points: DataFrame, n: int, seed: int = 0, far_range: float | None = None, by: str = "scene_id") -> DataFrame:
    """At most n points of each scene, those that hash lowest; with far_range points farther out come first.

    No scene is sorted whole: see lowest_hashes."""
    far = None if far_range is None else F.when(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) > far_range, 0).otherwise(1)
    return lowest_hashes(points, [by], n, seed, far)


def sample_with_replacement(points: DataFrame, n: int, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """n draws (column draw) of each scene's points, the same point any number of times."""
    numbered = placed(points, [by], F.shiftright(F.col("pid").cast("long"), 16), [F.col("pid")], name="at")
    drawn = points.groupBy(by).agg(F.count("*").alias("m")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = drawn.withColumn("at", F.pmod(hash_order(F.col("draw") + F.col(by) * 1000003, seed), F.col("m")))
    return drawn.select(by, "draw", "at").join(numbered, [by, "at"]).drop("at")


def shuffle_points(points: DataFrame, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """A place (from 0) for every point in a random order of its scene."""
    order = hash_order(F.col("pid"), seed)
    return placed(points, [by], F.shiftright(order, BUCKET_BITS), [order, F.col("pid")]).withColumn("place", F.col("place").cast("int"))


#: The cells of a patch along x, y and z, and the share of them that must hold points.
PATCH_CELLS = (31, 31, 62)
OCCUPIED = 0.02
#: Points so far outside a patch still count for its cells.
PATCH_EDGE = 0.01


def sample_patches(
    points: DataFrame, block: float, n: int, seed: int = 0, tries: int = 10, least_points: int | None = 10, annotated: float = 0.7, by: str = "scene_id",
    occupied: float = OCCUPIED, enlarge: float = 0.0, features: bool = False,
) -> DataFrame:
    """A square column of points around a random one of each scene, cut or filled up to n points (column draw).

    The first of the tried centres is taken whose column has enough points, and enough of them annotated (inst_gt > 0).
    Without least_points, enough of the column's 31 x 31 x 62 cells must hold a point instead: each is a bit of a map that
    tasks build for themselves, so no points are shuffled to count cells. enlarge widens the column by so much on each side,
    but not the cells. features adds nx, ny, nz: the place before centring over the scene's largest x, y and z (0 if that is 0).
    Scenes without a centre that is good enough give no rows."""
    order = Window.partitionBy(by).orderBy(hash_order(F.col("pid"), seed), "pid")
    tried = points.withColumn("attempt", F.row_number().over(order)).filter(F.col("attempt") <= tries).select(by, "attempt", F.col("x").alias("cx"), F.col("y").alias("cy"))
    extent = points.groupBy(by).agg(*[F.max(a).alias(f"hi_{a}") for a in "xyz"], F.min("z").alias("lo_z"))
    tried = tried.join(extent, by)
    half, reach = block / 2, block / 2 + enlarge
    cell = lambda c: floor_long(c / F.lit(float(2 * reach)))
    around = F.array([F.lit(k).cast("long") for k in (-1, 0, 1)])
    spread = tried.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    spread = spread.withColumns({"ix": cell(F.col("cx")) + F.col("dx"), "iy": cell(F.col("cy")) + F.col("dy")}).drop("dx", "dy")
    inside = points.withColumns({"ix": cell(F.col("x")), "iy": cell(F.col("y"))}).join(spread, [by, "ix", "iy"]).filter((F.abs(F.col("x") - F.col("cx")) <= reach) & (F.abs(F.col("y") - F.col("cy")) <= reach))
    totals = [F.count("*").alias("m"), F.count_if(F.col("inst_gt") > 0).alias("labelled")]
    if least_points is None:
        along = lambda a, low, span, k: F.ceil((F.col(a) - low) / span * F.lit(float(k)))
        (nx, ny, nz), height = PATCH_CELLS, F.col("hi_z") - F.col("lo_z")
        column = [along(a, F.col(f"c{a}") - half, F.lit(float(block)), k) for a, k in (("x", nx), ("y", ny))]
        level = F.when(height > 0, along("z", F.col("lo_z"), height, nz)).otherwise(0)
        near = F.greatest(F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy"))) <= half + PATCH_EDGE
        numbered = inside.withColumn("cell", F.when(near, (column[0] * ny + column[1]) * nz + level))
        bits = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("cell"))).alias("cells")
        parts = numbered.groupBy(by, "attempt", F.bitmap_bucket_number("cell").alias("part")).agg(*totals, bits)
        seen = parts.groupBy(by, "attempt").agg(*[F.sum(c).alias(c) for c in ("m", "labelled", "cells")])
        enough = F.col("cells") / F.lit(float(nx * ny * nz)) >= F.lit(float(occupied))
    else:
        seen, enough = inside.groupBy(by, "attempt").agg(*totals), F.col("m") >= least_points
    good = seen.filter(enough & (F.col("labelled") >= annotated * F.col("m")))
    first = good.groupBy(by).agg(F.min("attempt").alias("attempt"), F.min_by("m", "attempt").alias("m"))
    chosen = inside.join(first, [by, "attempt"])
    if n > RANK_LIMIT:  # only these are ranked in one task
        chosen = lowest_hashes(chosen, [by], n, seed + 1)
    rank = Window.partitionBy(by).orderBy(hash_order(F.col("pid"), seed + 1), "pid")
    chosen = chosen.withColumn("at", F.row_number().over(rank) - 1).filter(F.col("at") < n)
    copies = F.sequence(F.col("at"), F.lit(n - 1), F.least(F.col("m"), F.lit(n)).cast("int"))
    share = {f"n{a}": F.when(F.col(f"hi_{a}") == 0, 0.0).otherwise(F.col(a) / F.col(f"hi_{a}")) for a in "xyz"} if features else {}
    centred = chosen.withColumn("draw", F.explode(copies)).withColumns(share | {"x": F.col("x") - F.col("cx"), "y": F.col("y") - F.col("cy")})
    return centred.select(by, "draw", "pid", "x", "y", "z", "sem_gt", "inst_gt", *share)


def voxel_sampler_sweeps(points: DataFrame, size: float, per_voxel: int, max_voxels: int, by: str = "scene_id") -> DataFrame:
    """Current (time = 0) and older sweeps sampled apart: at most per_voxel points in a voxel, at most max_voxels voxels (in
    the order of their first points); missing voxels are filled up with the first one. Column slot numbers the voxels."""
    swept = with_voxel(points, size).withColumn("current", F.col("time") == 0)
    group = [by, "current"]
    rank = Window.partitionBy(*group, *KEY).orderBy("pid")
    kept = swept.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= per_voxel)
    first = swept.groupBy(*group, *KEY).agg(F.min("pid").alias("first"))
    span = first.groupBy(*group).agg(F.min("first").alias("_low"), F.max("first").alias("_high"))
    along = F.floor((F.col("first") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * 1024)
    numbered = placed(first.join(span, group), group, along, [F.col("first")], max_voxels, "slot").drop("_low", "_high")
    count = numbered.groupBy(*group).agg(F.count("*").alias("n_voxels"))
    filled = numbered.join(count, group).withColumn("slot", F.explode(F.when(F.col("slot") == 0, F.concat(F.array(F.lit(0)), F.when(F.col("n_voxels") < max_voxels, F.sequence(F.col("n_voxels").cast("int"), F.lit(max_voxels - 1))).otherwise(F.array().cast("array<int>")))).otherwise(F.array("slot"))))
    return kept.join(filled.select(*group, *KEY, "slot"), [*group, *KEY]).drop(*KEY, "k")


def query_grid(points: DataFrame, n: int, min_grid: float = 0.5, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """At most n points of each scene, the first of each cell of a grid that makes about n cells; a hash cuts the rest."""
    volume = F.lit(1.0)
    for a in "xyz":
        volume = volume * (F.max(a) - F.min(a))
    cells = points.groupBy(by).agg(F.greatest(F.pow(F.greatest(volume, F.lit(1.0)) / F.least(F.lit(n), F.count("*")), F.lit(1.0 / 3)), F.lit(float(min_grid))).alias("cell"))
    placed = points.join(cells, by).withColumns({k: floor_long(F.col(k[1]) / F.col("cell")) for k in KEY})
    first = placed.groupBy(by, *KEY).agg(F.min_by(F.struct(*points.columns), "pid").alias("p")).select("p.*")
    return sample_points(first, n, seed, by=by)


def query_adaptive(points: DataFrame, n: int, axes: tuple[str, str] = ("x", "y"), top: str = "z", min_grid: float = 0.4, pool: int = 3, by: str = "scene_id") -> DataFrame:
    """At most n points of each scene: the highest of each cell of a fine grid, thinned evenly along a Z-order curve."""
    u, v = axes
    span = (F.max(u) - F.min(u)) * (F.max(v) - F.min(v))
    cells = points.groupBy(by).agg(F.greatest(F.sqrt(span / F.least(F.lit(pool * n), F.count("*"))), F.lit(float(min_grid))).alias("cell"), F.min(u).alias("low_u"), F.min(v).alias("low_v"), F.least(F.lit(n), F.count("*")).alias("wanted"))
    placed = points.join(cells, by).withColumns({"gu": floor_long((F.col(u) - F.col("low_u")) / F.col("cell")), "gv": floor_long((F.col(v) - F.col("low_v")) / F.col("cell"))})
    best = placed.groupBy(by, "gu", "gv").agg(F.max_by(F.struct(*points.columns), F.struct(F.col(top), -F.col("pid"))).alias("p"), F.first("wanted").alias("wanted"))
    size = Window.partitionBy(by)
    ranked = best.withColumn("at", F.row_number().over(size.orderBy(morton2d(F.col("gu"), F.col("gv")), "p.pid")) - 1).withColumn("m", F.count("*").over(size))
    slot = floor_long(F.col("at") * F.col("wanted") / F.col("m"))  # the first of each of n even stretches stays
    before = floor_long((F.col("at") - 1) * F.col("wanted") / F.col("m"))
    return ranked.filter((F.col("m") <= F.col("wanted")) | (F.col("at") == 0) | (slot != before)).select("p.*")


def principal_axes(embeddings: DataFrame, column: str = "embedding", size: int = 5) -> DataFrame:
    """u and v: the coordinates of the first components of each vector along their two principal axes.

    Tasks multiply their centred vectors batch by batch; Spark adds up the products (size squared numbers), and the
    eigenvectors of that small matrix are found on the driver. A missing component counts as the mean."""
    part = [F.element_at(column, i + 1).cast("double") for i in range(size)]
    moments = embeddings.agg(F.count("*").alias("n"), *[F.avg(p).alias(f"m{i}") for i, p in enumerate(part)]).first()
    if not moments["n"]:
        return embeddings.withColumns({"u": F.lit(0.0), "v": F.lit(0.0)})
    means = np.array([moments[f"m{i}"] or 0.0 for i in range(size)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = np.stack([np.asarray(c.fill_null(m), dtype=np.float64) for c, m in zip(batch.columns, means.tolist())], axis=1) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["k", "v"])

    summed = embeddings.select(*[p.alias(f"p{i}") for i, p in enumerate(part)]).mapInArrow(products, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    cov = np.zeros(size * size)
    for r in summed.collect():
        cov[r.k] = r.v
    cov = cov.reshape(size, size) / moments["n"]
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), [0, 1]])  # a sign that does not depend on the solver
    along = lambda k: sum(((part[i] - F.lit(moments[f"m{i}"])) * F.lit(float(vectors[i, k])) for i in range(size)), F.lit(0.0))
    return embeddings.withColumns({"u": along(0), "v": along(1)})


#: Rows of a group that one task may look at; cells along an axis of a larger one, and points of a cell that stand for it.
FPS_ROWS, FPS_CELLS, FPS_FRONT = 20_000, 8, 4


def query_fps(points: DataFrame, n: int, features: tuple[str, ...] = ("x", "y", "z"), by: str = "scene_id") -> DataFrame:
    """n points of each group by farthest point sampling from the first one (lowest pid; ties: lowest pid); column rank gives the order.

    A group of at most FPS_ROWS points is sampled in one task. A larger one goes through rounds: Spark keeps every point's
    distance to the nearest sample and hands on, for each cell of a grid, its farthest points, the next distance after
    theirs, and the cell's bounds. From these a task goes on sampling as long as no other point can be farther: the
    distances of the points handed on are exact, and those of the others are bounded by the cell. Then all distances are
    brought up to date. The samples are those of the plain method."""
    size = points.groupBy(by).agg(F.count("*").alias("_rows"))
    large = written(size.filter(F.col("_rows") > FPS_ROWS).select(by))
    small = points.join(large, by, "left_anti")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", rank int"

    def pick(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid", kind="stable").reset_index(drop=True)
        place = group[list(features)].to_numpy(np.float64)
        chosen, gap = [0], np.full(len(group), np.inf)
        while len(chosen) < min(n, len(group)):
            gap = np.minimum(gap, ((place - place[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(gap.argmax()))
        return group.iloc[chosen].assign(rank=range(len(chosen)))

    found = small.select(*points.columns).groupBy(by).applyInPandas(pick, schema)
    if large.isEmpty():
        return found
    chosen = _farthest(points.join(large, by, "left_semi"), n, features, by)
    return found.unionByName(points.join(chosen, [by, "pid"]).select(*points.columns, "rank"))


def _farthest(points: DataFrame, n: int, features: tuple[str, ...], by: str) -> DataFrame:
    """by, pid and rank of the samples of large groups."""
    kind = points.schema[by].dataType.simpleString()
    place = F.array(*[F.col(c).cast("double") for c in features]).alias("place")
    rows = points.select(by, F.col("pid").cast("long").alias("pid"), place)
    goals = rows.groupBy(by).agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("goal"))
    axes = range(min(3, len(features)))
    bounds = rows.groupBy(by).agg(*[f(F.element_at("place", k + 1)).alias(f"{m}{k}") for k in axes for m, f in (("low", F.min), ("high", F.max))])
    step = lambda k: F.when(F.col(f"high{k}") > F.col(f"low{k}"), F.least(F.lit(FPS_CELLS - 1), F.floor((F.element_at("place", k + 1) - F.col(f"low{k}")) / (F.col(f"high{k}") - F.col(f"low{k}")) * FPS_CELLS))).otherwise(0)
    cell = sum((step(k) * FPS_CELLS**k for k in axes), F.lit(0)).cast("int")
    rows = rows.join(bounds, by).select(by, "pid", "place", cell.alias("cell"), F.lit(float("inf")).alias("gap"))
    boxes = written(rows.groupBy(by, "cell").agg(*[F.array(*[f(F.element_at("place", k + 1)) for k in range(len(features))]).alias(m) for m, f in (("low", F.min), ("high", F.max))]))
    first = rows.groupBy(by).agg(F.min_by(F.struct("pid", "place"), "pid").alias("s")).select(by, "s.pid", "s.place", F.lit(0).alias("rank"))
    samples = written(first)
    fresh, rows = samples, written(rows)
    sampled = f"`{by}` {kind}, pid long, place array<double>, rank int"

    def go_on(key: tuple, front: pd.DataFrame) -> pd.DataFrame:
        at = front["place_no"].to_numpy()
        held, last = front[at <= FPS_FRONT], front[at > FPS_FRONT]
        place, gap, pid = np.stack(held["place"].to_list()), held["gap"].to_numpy().copy(), held["pid"].to_numpy()
        low, high, bound = np.stack(front["low"].to_list())[at > FPS_FRONT] if len(last) else None, None, None
        if len(last):
            high, bound = np.stack(last["high"].to_list()), last["gap"].to_numpy().copy()
        rank, goal, out = int(front["done"].iloc[0]), int(front["goal"].iloc[0]), []
        while rank + len(out) < goal:
            k = int(np.lexsort((pid, -gap))[0])
            most = bound.max() if len(last) else -1.0
            if most > gap[k] or most == gap[k] and out:  # right after bringing up to date, those handed on come first among equals
                break
            if gap[k] == 0:  # every place is taken: the plain method goes on with the first point
                lead = front["lead"].iloc[0]
                out += [(key[0], int(lead["pid"]), list(lead["place"]), r) for r in range(rank + len(out), goal)]
                break
            out.append((key[0], int(pid[k]), place[k].tolist(), rank + len(out)))
            gap = np.minimum(gap, ((place - place[k]) ** 2).sum(axis=1))
            if len(last):
                far = np.maximum(np.abs(place[k] - low), np.abs(high - place[k]))
                bound = np.minimum(bound, (far * far).sum(axis=1))
        return pd.DataFrame(out, columns=[by, "pid", "place", "rank"])

    while True:
        new = fresh.groupBy(by).agg(F.collect_list("place").alias("new"))  # at most n
        away = lambda x: F.aggregate(F.zip_with("place", x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        nearest = F.array_min(F.transform("new", away))
        rows = written(rows.join(new, by, "left").withColumn("gap", F.least("gap", F.coalesce(nearest, F.col("gap")))).drop("new"))
        count = samples.groupBy(by).agg(F.count("*").cast("int").alias("done"), F.min_by(F.struct("pid", "place"), "rank").alias("lead")).join(goals, by)
        todo = rows.join(samples.select(by, "pid"), [by, "pid"], "left_anti").join(count.filter("done < goal"), by)
        rank = Window.partitionBy(by, "cell").orderBy(F.desc("gap"), "pid")
        front = todo.withColumn("place_no", F.row_number().over(rank)).filter(F.col("place_no") <= FPS_FRONT + 1).join(boxes, [by, "cell"])
        fresh = written(front.groupBy(by).applyInPandas(go_on, sampled))
        if fresh.isEmpty():
            return samples.select(by, "pid", "rank")
        samples = written(samples.unionByName(fresh))


def select_queries(points: DataFrame, mode: str, n: int, by: str = "scene_id", **options) -> DataFrame:
    """Query points by one of the methods grid, fps, adaptive and adaptive_emb."""
    if mode == "adaptive_emb":
        return query_adaptive(principal_axes(points, **options), n, ("u", "v"), by=by).drop("u", "v")
    return {"grid": query_grid, "fps": query_fps, "adaptive": query_adaptive}[mode](points, n, by=by, **options)


def polar_mix(a: DataFrame, b: DataFrame, start: float, classes: tuple[int, ...], turns: tuple[float, ...] = (0.0, 2.0943951023931953, 4.1887902047863905), semantic: str = "sem_gt") -> DataFrame:
    """a with the points in a half circle from start replaced by b's there, and b's points of some classes at some turns."""
    yaw = F.pmod(F.atan2(F.col("y"), F.col("x")) - F.lit(float(start)), F.lit(2 * 3.141592653589793))
    half = yaw < 3.141592653589793
    pasted = b.filter(F.col(semantic).isin(*classes)).withColumn("turn", F.explode(F.array(*[F.lit(float(t)) for t in turns])))
    turned = {"x": F.col("x") * F.cos("turn") - F.col("y") * F.sin("turn"), "y": F.col("x") * F.sin("turn") + F.col("y") * F.cos("turn")}
    return a.filter(~half).unionByName(b.filter(half)).unionByName(pasted.withColumns(turned).drop("turn"))


def laser_mix(a: DataFrame, b: DataFrame, areas: int, low: float, high: float) -> DataFrame:
    """Even bands of inclination (degrees, clamped to low..high) from a, odd ones from b."""
    pitch = F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    inside = F.least(F.greatest(pitch, F.lit(float(low))), F.lit(float(high)))
    band = F.least(floor_long((inside - F.lit(float(low))) / F.lit((high - low) / areas)), F.lit(areas - 1).cast("long"))
    return a.filter(band % 2 == 0).unionByName(b.filter(band % 2 == 1))
