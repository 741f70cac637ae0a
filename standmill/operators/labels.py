"""Label engineering: offsets, visible shares, embeddings, nearest points, boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.functions.keys import floor_long
from standmill.operators.voxels import dense_ids
from standmill.sources.storage import written


def instance_labels(points: DataFrame, instance: str = "inst_gt", semantic: str = "sem_gt", ignore: int = -1, by: str = "scene_id") -> DataFrame:
    """Dense instance ids, and the class of each instance: that of its first point."""
    used = dense_ids(points.filter(F.col(instance) != ignore), by, instance)
    return used.groupBy(by, "dense_id").agg(F.min_by(semantic, "pid").alias("label"), F.count("*").alias("n_points"))


def vote_offsets(points: DataFrame, crop: DataFrame, instance: str = "inst_gt", by: str = "scene_id") -> DataFrame:
    """crop with the offset of each point to the middle of its instance's box over the whole scene; 0 for background."""
    boxes = points.filter(F.col(instance) > 0).groupBy(by, instance).agg(*[((F.min(a) + F.max(a)) / 2).alias(f"mid_{a}") for a in "xyz"])
    joined = crop.join(boxes, [by, instance], "left")
    return joined.withColumns({f"off{a}": F.coalesce(F.col(f"mid_{a}") - F.col(a), F.lit(0.0)) for a in "xyz"}).drop("mid_x", "mid_y", "mid_z")


def visible_ratio(points: DataFrame, crop: DataFrame, instance: str = "inst_gt", by: str = "scene_id") -> DataFrame:
    """Per instance of the crop the share of its points that lie in it."""
    whole = points.filter(F.col(instance) > 0).groupBy(by, instance).agg(F.count("*").alias("whole"))
    seen = crop.filter(F.col(instance) > 0).groupBy(by, instance).agg(F.count("*").alias("seen"))
    return seen.join(whole, [by, instance]).select(by, instance, (F.col("seen") / F.col("whole")).alias("ratio"))


def keep_whole_instances(points: DataFrame, crop: DataFrame, instance: str = "inst_gt", by: str = "scene_id") -> DataFrame:
    """The crop's background, and its instances that lie in it with all their points."""
    whole = visible_ratio(points, crop, instance, by).filter("ratio = 1").select(by, instance)
    return crop.filter(F.col(instance) > 0).join(whole, [by, instance], "left_semi").select(*crop.columns).unionByName(crop.filter(F.col(instance) <= 0))


def offset_quality(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Mean L1 error, and mean negative cosine, between predicted (px, py, pz) and true (offx, offy, offz) offsets."""
    error = sum((F.abs(F.col(f"p{a}") - F.col(f"off{a}")) for a in "xyz"), F.lit(0.0))
    dot = sum((F.col(f"p{a}") * F.col(f"off{a}") for a in "xyz"), F.lit(0.0))
    norm = lambda p: F.sqrt(sum((F.col(f"{p}{a}") * F.col(f"{p}{a}") for a in "xyz"), F.lit(0.0)))
    return points.groupBy(by).agg(F.avg(error).alias("l1"), F.avg(-dot / (norm("p") * norm("off") + F.lit(1e-8))).alias("direction"))


def _parts(column: str, size: int) -> list[Column]:
    return [F.element_at(column, i + 1).cast("double") for i in range(size)]


def embedding_mean_cov(emb: DataFrame, size: int, by: str = "scene_id", instance: str = "instance", column: str = "embedding") -> DataFrame:
    """Mean vector and sample covariance (row by row) of each instance; zeros for a single point."""
    p = _parts(column, size)
    cov = [F.coalesce(F.covar_samp(p[min(i, j)], p[max(i, j)]), F.lit(0.0)) for i in range(size) for j in range(size)]
    return emb.groupBy(by, instance).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in p]).alias("mean"), F.array(*cov).alias("cov"))


#: Centres push each other apart within this L1 distance; a centre looks for others along so many components first.
PUSH, PUSH_AXES = 3.0, 3


def embedding_cluster_stats(emb: DataFrame, size: int, by: str = "scene_id", instance: str = "instance", column: str = "embedding") -> DataFrame:
    """Per scene: pull (variance), push (distance) and size terms of the embedding clusters.

    The push term of two centres is 0 from PUSH on, so only centres in neighbouring cells of the first components meet; how
    many pairs there are in all follows from the number of centres."""
    p = _parts(column, size)
    means = written(emb.groupBy(by, instance).agg(F.array(*[F.avg(x) for x in p]).alias("mean")))
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
    gap = F.greatest(l1(F.array(*p), F.col("mean")) - 0.5, F.lit(0.0))
    pull = emb.join(means, [by, instance]).groupBy(by, instance).agg(F.avg(gap * gap).alias("v")).groupBy(by).agg(F.avg("v").alias("variance"))
    cells = [f"c{k}" for k in range(min(size, PUSH_AXES))]
    placed = means.withColumns({c: floor_long(F.element_at("mean", k + 1) / F.lit(PUSH)) for k, c in enumerate(cells)})
    a, b = placed.withColumnsRenamed({instance: "ia", "mean": "ma"}), placed.withColumnsRenamed({instance: "ib", "mean": "mb"})
    for c in cells:
        a = a.withColumn("d", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]))).withColumn(c, F.col(c) + F.col("d")).drop("d")
    near = F.greatest(PUSH - l1(F.col("ma"), F.col("mb")), F.lit(0.0))
    push = a.join(b, [by, *cells]).filter("ia <> ib").groupBy(by).agg(F.sum(near * near).alias("pushed"))
    zero = F.array(*[F.lit(0.0)] * size)
    small = means.groupBy(by).agg((F.avg(l1(F.col("mean"), zero)) * 0.001).alias("regular"), F.count("*").alias("k"))
    pairs = F.when(F.col("k") > 1, F.coalesce("pushed", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return pull.join(small, by).join(push, by, "left").select(by, "variance", pairs.alias("distance"), "regular")


def embedding_distance(emb: DataFrame, size: int, kind: str = "euclid", full: bool = False, by: str = "scene_id", instance: str = "instance", column: str = "embedding") -> DataFrame:
    """Closeness of each point to its instance's mean, scaled to [0, 1] within the instance (1 where all are alike).

    euclid: exp(-d); mahalanobis: exp(-d squared), with only the diagonal of the inverse covariance unless full."""
    p = F.array(*_parts(column, size))
    gap = F.zip_with(p, F.col("mean"), lambda u, v: u - v)
    if kind == "euclid":
        means = emb.groupBy(by, instance).agg(F.array(*[F.avg(x) for x in _parts(column, size)]).alias("mean"))
        joined = emb.join(means, [by, instance])
        score = F.exp(-F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d)))
    elif kind == "mahalanobis":
        stats = embedding_mean_cov(emb, size, by, instance, column)

        @F.pandas_udf("array<double>")
        def inverse(cov: pd.Series) -> pd.Series:
            flat = np.stack(cov.to_numpy()).reshape(-1, size, size) + 1e-6 * np.eye(size)
            found = np.linalg.inv(flat)
            return pd.Series(list((found if full else found * np.eye(size)).reshape(len(flat), -1)))

        joined = emb.join(stats.withColumn("inv", inverse("cov")), [by, instance])
        cell = lambda i, j: F.element_at("inv", i * size + j + 1) * F.element_at("gap", i + 1) * F.element_at("gap", j + 1)
        joined = joined.withColumn("gap", gap)
        square = sum((cell(i, j) for i in range(size) for j in range(size) if full or i == j), F.lit(0.0))
        score = F.exp(-square)
    else:
        raise ValueError(f"unknown kind {kind}")
    scored = joined.select(*emb.columns, score.alias("score"))
    span = scored.groupBy(by, instance).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return scored.join(span, [by, instance]).withColumn("score", scaled).drop("low", "high")


def _cells(df: DataFrame, cell: float, reach: int, axes: str = "xyz") -> DataFrame:
    """Rows copied to all cells within reach of their own."""
    out = df.withColumns({f"c{a}": floor_long(F.col(a) / F.lit(float(cell))) for a in axes})
    if reach:
        for a in axes:
            out = out.withColumn("d", F.explode(F.array(*[F.lit(k).cast("long") for k in range(-reach, reach + 1)]))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("d")).drop("d")
    return out


#: A pair of cells with more pairs of points goes on to smaller cells; queries of a cell that one task takes.
HEAVY, CELL_ROWS = 1 << 20, 1 << 16
#: A heavy pair is split at most so many times: by then its references are one place.
SPLITS = 40
_Q, _R = ["qx", "qy", "qz"], ["rx", "ry", "rz"]


def _boxes(points: DataFrame, width: float, by: str) -> DataFrame:
    """Occupied cells (cx, cy, cz) with the number and the bounds of their points."""
    bounds = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    return _cells(points, width, 0).groupBy(by, "cx", "cy", "cz").agg(F.count("*").alias("n"), *bounds)


def _coarser(boxes: DataFrame, by: str) -> DataFrame:
    """Cells of twice the width."""
    bounds = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    return boxes.groupBy(by, *[F.shiftright(f"c{a}", 1).alias(f"c{a}") for a in "xyz"]).agg(F.sum("n").alias("n"), *bounds)


def _side(boxes: DataFrame, side: str, by: str) -> DataFrame:
    """Cells under the names of one side of a pair, with the cell around each."""
    out = boxes.select(by, *[F.col(f"c{a}").alias(f"{side}{a}") for a in "xyz"], *[F.struct("n", *[f"{n}_{a}" for a in "xyz" for n in ("low", "high")]).alias(f"{side}_box")])
    return out.withColumns({f"up_{side}{a}": F.shiftright(f"{side}{a}", 1) for a in "xyz"})


def _pruned(pairs: DataFrame, by: str) -> DataFrame:
    """Pairs of cells but for those whose points are farther apart than some reference is from all the queries; u is that bound."""
    q, r = (lambda c: F.col(f"q_box.{c}")), (lambda c: F.col(f"r_box.{c}"))
    total = lambda parts: sum(parts, F.lit(0.0))
    gaps = [F.greatest(q(f"low_{a}") - r(f"high_{a}"), r(f"low_{a}") - q(f"high_{a}"), F.lit(0.0)) for a in "xyz"]
    spans = [F.greatest(F.abs(q(f"high_{a}") - r(f"low_{a}")), F.abs(r(f"high_{a}") - q(f"low_{a}"))) for a in "xyz"]
    pairs = pairs.withColumns({"near": total(g * g for g in gaps), "far": total(g * g for g in spans)})
    least = F.min(F.least("u", "far")).over(Window.partitionBy(by, *_Q))  # the candidates of one cell, which are few
    return pairs.withColumn("u", least).filter("near <= u").drop("near", "far")


def _descended(pairs: DataFrame, q: DataFrame, r: DataFrame, by: str) -> DataFrame:
    """The pairs of the cells within each pair's cells, pruned."""
    up = pairs.select(by, "u", *[F.col(c).alias(f"up_{c}") for c in _Q + _R])
    found = up.join(_side(q, "q", by), [by, *[f"up_{c}" for c in _Q]]).join(_side(r, "r", by), [by, *[f"up_{c}" for c in _R]])
    return _pruned(found.select(by, *_Q, *_R, "q_box", "r_box", "u"), by)


def nearest_label(queries: DataFrame, refs: DataFrame, value: str, cell: float, by: str = "scene_id") -> DataFrame:
    """Each query (by, pid, x, y, z) takes the value of the nearest reference of its scene (ties: lowest pid).

    Both sides are summed up in a pyramid of cells, from the given width up to a few cells a scene. From the top down, pairs of a
    query cell and a reference cell are kept only if the reference cell can hold a nearest one, by the bounds of the points in both;
    cells with too many points for a pair are split further. Points only meet in the pairs that are left: no round matches far
    queries with all references, and queries of a full cell are dealt to several tasks. Of references in one place only the lowest
    pid can win. A scene without references gives no rows."""
    first = F.min_by(F.struct(F.col("pid").alias("ref"), F.col(value).alias("value")), "pid").alias("v")
    refs = written(refs.groupBy(by, "x", "y", "z").agg(first).select(by, "v.ref", "x", "y", "z", "v.value"))
    queries = queries.select(by, "pid", "x", "y", "z")
    q0, r0 = written(_boxes(queries, cell, by)), written(_boxes(refs, cell, by))
    edges = q0.unionByName(r0).groupBy(by).agg(*[(F.max(f"c{a}") - F.min(f"c{a}")).alias(a) for a in "xyz"])
    widest = edges.agg(F.max(F.greatest("x", "y", "z"))).first()[0] or 0
    levels = [(q0, r0)]
    for _ in range(int(widest).bit_length() - 1):
        levels.append(tuple(_coarser(x, by) for x in levels[-1]))
    q, r = levels.pop()
    pairs = _side(q, "q", by).join(_side(r, "r", by), by).withColumn("u", F.lit(float("inf")))  # two cells along each axis, or three
    pairs = _pruned(pairs.select(by, *_Q, *_R, "q_box", "r_box", "u"), by)
    for k in range(len(levels) - 1, -1, -1):
        pairs = _descended(pairs, *levels[k], by)
        if k % 3 == 0:
            pairs = written(pairs)
    if not levels:
        pairs = written(pairs)
    found, width = None, float(cell)
    heavy = (F.col("q_box.n") * F.col("r_box.n") > HEAVY) & (F.col("r_box.n") > 1)
    for k in range(SPLITS + 1):
        more = pairs.filter(heavy if k < SPLITS else F.lit(False))
        last = more.isEmpty()
        one = _met(queries, refs, pairs if last else pairs.filter(~heavy), width, by)
        found = one if found is None else found.unionByName(one)
        if last:
            break
        width /= 2
        inside = lambda points, names: _cells(points, 2 * width, 0).join(more.select(by, *[F.col(c).alias(f"c{c[1]}") for c in names]).distinct(), [by, "cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")  # noqa: B023, E731
        pairs = written(_descended(more, _boxes(inside(queries, _Q), width, by), _boxes(inside(refs, _R), width, by), by))
    best = found.groupBy(by, "pid").agg(F.min_by("b", F.struct("b.square", "b.ref")).alias("b"))
    return best.select(by, "pid", "b.ref", F.col("b.value").alias(value))


def _met(queries: DataFrame, refs: DataFrame, pairs: DataFrame, width: float, by: str) -> DataFrame:
    """by, pid and b (ref, value, square): the best reference of each query among those of the cells paired with its own."""
    place = [by, "cx", "cy", "cz"]
    held = _cells(refs, width, 0).select(by, *[F.col(f"c{a}").alias(f"r{a}") for a in "xyz"], F.struct("ref", "value", "x", "y", "z").alias("r"))
    deal = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("q_box.n") / CELL_ROWS)))
    near = pairs.select(by, *_Q, *_R, deal.alias("part")).join(held, [by, *_R]).select(by, *[F.col(f"q{a}").alias(f"c{a}") for a in "xyz"], "part", "r")
    asked = _cells(queries, width, 0)
    full = pairs.filter(F.col("q_box.n") >= CELL_ROWS).select(by, *[F.col(f"q{a}").alias(f"c{a}") for a in "xyz"], F.floor(F.col("q_box.n") / CELL_ROWS).alias("parts")).distinct()
    if full.isEmpty():
        asked = asked.withColumn("part", F.lit(0).cast("long"))
    else:
        asked = asked.join(full, place, "left").withColumn("part", F.pmod(F.xxhash64("pid"), F.coalesce("parts", F.lit(0)) + 1)).drop("parts")
    square = sum(((F.col(a) - F.col(f"r.{a}")) * (F.col(a) - F.col(f"r.{a}")) for a in "xyz"), F.lit(0.0))
    met = asked.join(near, [*place, "part"]).select(by, "pid", F.struct("r.ref", "r.value", square.alias("square")).alias("b"))
    return met.groupBy(by, "pid").agg(F.min_by("b", F.struct("b.square", "b.ref")).alias("b"))


def inverse_labels(points: DataFrame, reduced: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The short cut of nearest_label: every point takes the value of its own voxel (the same keys on both sides)."""
    return points.join(reduced.select(*keys, value), keys)


def _in_box(grow: float = 0.0) -> Column:
    inside = F.lit(True)
    for a in "xyz":
        half = F.col(f"d{a}") / 2 + F.lit(float(grow))
        inside = inside & (F.col(a) >= F.col(f"b{a}") - half) & (F.col(a) <= F.col(f"b{a}") + half)
    return inside


def box_candidates(points: DataFrame, boxes: DataFrame, cell: float, grow: float = 0.0, by: str = "scene_id") -> DataFrame:
    """Points beside the boxes (by, box_id, cx.. dx..) whose cells they share: boxes are spread over the cells they touch."""
    spread = boxes.withColumnsRenamed({f"c{a}": f"b{a}" for a in "xyz"})
    for a in "xy":
        low = floor_long((F.col(f"b{a}") - F.col(f"d{a}") / 2 - grow) / F.lit(float(cell)))
        high = floor_long((F.col(f"b{a}") + F.col(f"d{a}") / 2 + grow) / F.lit(float(cell)))
        spread = spread.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
    return _cells(points, cell, 0, "xy").join(spread, [by, "cx", "cy"]).drop("cx", "cy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 5.0, by: str = "scene_id") -> DataFrame:
    """by, pid and box_id of every point in every box that holds it, faces included."""
    return box_candidates(points, boxes, cell, by=by).filter(_in_box()).select(by, "pid", "box_id")


def background_near_boxes(points: DataFrame, boxes: DataFrame, enlarge: float, cell: float = 5.0, by: str = "scene_id") -> DataFrame:
    """points without those that are outside every box but within one that is enlarged on each side."""
    flags = box_candidates(points, boxes, cell, enlarge, by).filter(_in_box(enlarge)).groupBy(by, "pid").agg(F.max(_in_box()).alias("inside"))
    return points.join(flags.filter(~F.col("inside")), [by, "pid"], "left_anti")


def remove_points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 5.0, by: str = "scene_id") -> DataFrame:
    return points.join(points_in_boxes(points, boxes, cell, by), [by, "pid"], "left_anti")


def match_one_to_many(queries: DataFrame, voxel_masks: DataFrame, keys: list[str], instance: str = "inst_gt") -> DataFrame:
    """Each query takes the (lowest) instance whose mask holds its voxel, else -1."""
    found = voxel_masks.groupBy(*keys).agg(F.min(instance).alias("gt_id"))
    return queries.join(found, keys, "left").withColumn("gt_id", F.coalesce("gt_id", F.lit(-1)))
