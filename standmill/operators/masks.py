"""Masks: scoring, suppression, voting and merging. Masks are long tables: mask_points (by, mask_id, pid, prob) and masks (by, mask_id, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standmill.operators.voxels import dense_ids
from standmill.sources.storage import written


def topk_masks(masks: DataFrame, k: int = 300, by: str = "scene_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "mask_id")
    return masks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def mask_quality(mask_points: DataFrame, masks: DataFrame, threshold: float = 0.01, by: str = "scene_id") -> DataFrame:
    """Scores times the mean probability over the points above a threshold."""
    on = F.when(F.col("prob") > threshold, F.col("prob"))
    mean = mask_points.groupBy(by, "mask_id").agg((F.coalesce(F.sum(on), F.lit(0.0)) / (F.count(on) + F.lit(1e-6))).alias("quality"))
    return masks.join(mean, [by, "mask_id"], "left").withColumn("score", F.col("score") * F.coalesce("quality", F.lit(0.0))).drop("quality")


def mask_overlap(mask_points: DataFrame, weighted: bool = False, by: str = "scene_id") -> DataFrame:
    """Pairs of masks of a scene that share points: intersection, areas, overlap and containment of each in the other.

    weighted: points count with the product of their probabilities in the intersection, with the probability in areas."""
    weight = F.col("prob") if weighted else F.lit(1.0)
    rows = mask_points.select(by, "mask_id", "pid", weight.alias("w"))
    area = rows.groupBy(by, "mask_id").agg(F.sum("w").alias("area"))
    a, b = rows.select(by, "pid", F.col("mask_id").alias("mask_a"), F.col("w").alias("wa")), rows.select(by, "pid", F.col("mask_id").alias("mask_b"), F.col("w").alias("wb"))
    inter = a.join(b, [by, "pid"]).filter("mask_a < mask_b").groupBy(by, "mask_a", "mask_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("inter"))
    sized = inter.join(area.withColumnsRenamed({"mask_id": "mask_a", "area": "area_a"}), [by, "mask_a"]).join(area.withColumnsRenamed({"mask_id": "mask_b", "area": "area_b"}), [by, "mask_b"])
    return sized.withColumns({"iou": F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")), "in_a": F.col("inter") / F.col("area_a"), "in_b": F.col("inter") / F.col("area_b")})


def matrix_nms(mask_points: DataFrame, masks: DataFrame, kernel: str = "linear", sigma: float = 2.0, nms_pre: int = -1, filter_thr: float = 0.0, max_num: int = -1, by: str = "scene_id") -> DataFrame:
    """Scores decayed by the overlap with better masks of the same label, sorted out by threshold and number.

    Only overlapping pairs are formed: a pair without overlap can only give a factor of at least 1 / f(comp), and the
    best mask gives one of at most that of no compensation, which the constant stands for."""
    if kernel not in ("linear", "gaussian"):
        raise ValueError(f"unknown kernel {kernel}")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "mask_id")
    ranked = masks.withColumn("rank", F.row_number().over(order))
    if nms_pre > 0:
        ranked = ranked.filter(F.col("rank") <= nms_pre)
    rows = mask_points.join(ranked.select(by, "mask_id", "rank", "label"), [by, "mask_id"])
    area = mask_points.groupBy(by, "mask_id").agg(F.sum("prob").alias("area")).join(ranked.select(by, "mask_id", "rank"), [by, "mask_id"]).drop("mask_id")
    better, worse = (rows.select(by, "pid", "label", F.col("rank").alias(f"r{s}"), F.col("prob").alias(f"p{s}")) for s in "ij")
    inter = better.join(worse, [by, "pid", "label"]).filter("ri < rj").groupBy(by, "ri", "rj").agg(F.sum(F.col("pi") * F.col("pj")).alias("inter"))
    pairs = inter.join(area.withColumnsRenamed({"rank": "ri", "area": "ai"}), [by, "ri"]).join(area.withColumnsRenamed({"rank": "rj", "area": "aj"}), [by, "rj"])
    pairs = pairs.select(by, "ri", "rj", (F.col("inter") / (F.col("ai") + F.col("aj") - F.col("inter") + F.lit(1e-6))).alias("iou"))
    comp = pairs.groupBy(by, F.col("rj").alias("ri")).agg(F.max("iou").alias("comp"))
    factors = pairs.join(comp, [by, "ri"], "left").withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    if kernel == "linear":
        factor, most = (1 - F.col("iou")) / (1 - F.col("comp") + F.lit(1e-6)), 1 / (1 + 1e-6)
    else:
        factor, most = F.exp(-F.lit(sigma) * F.col("iou") * F.col("iou")) / F.exp(-F.lit(sigma) * F.col("comp") * F.col("comp")), 1.0
    decay = factors.groupBy(by, F.col("rj").alias("rank")).agg(F.min(factor).alias("decay"))
    out = ranked.join(decay, [by, "rank"], "left").withColumn("score", F.col("score") * F.least(F.lit(most), F.coalesce("decay", F.lit(most)))).drop("rank", "decay")
    if filter_thr > 0:
        out = out.filter(F.col("score") >= filter_thr)
    return topk_masks(out, max_num, by) if max_num > 0 else out


def mask_filters(mask_points: DataFrame, masks: DataFrame, points: DataFrame, prob: float = 0.15, max_ground: float = 0.5, max_height: float = 5.0, min_points: int = 10, by: str = "scene_id") -> DataFrame:
    """Masks that are not mostly ground, do not begin far above the scene's highest ground, and have enough points."""
    held = mask_points.filter(F.col("prob") > prob).join(points.select(by, "pid", "z", "sem_pred"), [by, "pid"])
    facts = held.groupBy(by, "mask_id").agg((F.count_if(F.col("sem_pred") == 0) / F.count("*")).alias("ground"), F.min("z").alias("low"), F.count("*").alias("n_points"))
    top = points.filter("sem_pred = 0").groupBy(by).agg(F.max("z").alias("top"))
    joined = masks.join(facts, [by, "mask_id"]).join(top, by, "left")
    floating = F.coalesce(F.col("low") > F.col("top") + max_height, F.lit(False))
    return joined.filter((F.col("score") > 0) & (F.col("ground") <= max_ground) & ~floating & (F.col("n_points") > min_points)).select(*masks.columns, "n_points")


def edge_filter(mask_points: DataFrame, masks: DataFrame, points: DataFrame, centers: DataFrame, radius: float, margin: float = 0.5, min_score: float = 0.4, by: str = "scene_id") -> DataFrame:
    """Drops masks of a good score that reach beyond the radius less a margin from their centre (by, cx, cy)."""
    square = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    reach = mask_points.join(points.select(by, "pid", "x", "y"), [by, "pid"]).join(centers, by).groupBy(by, "mask_id").agg(F.max(square).alias("reach"))
    out = (F.col("score") > min_score) & (F.col("reach") > F.lit((radius - margin) ** 2))
    return masks.join(reach, [by, "mask_id"]).filter(~out).drop("reach")


def best_mask_per_point(mask_points: DataFrame, masks: DataFrame, by: str = "scene_id") -> DataFrame:
    """Per point the mask with the highest score above 0; ties go to the lower mask id."""
    scored = mask_points.join(masks.select(by, "mask_id", "score"), [by, "mask_id"]).filter("score > 0")
    return scored.groupBy(by, "pid").agg(F.max_by(F.struct("mask_id", "score"), F.struct(F.col("score"), -F.col("mask_id"))).alias("m")).select(by, "pid", "m.*")


def semantic_vote(votes: DataFrame, points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Per point the class with most votes; ties go to the lower class; -1 without votes."""
    counted = votes.groupBy(by, "pid", "class").agg(F.count("*").alias("n"))
    won = counted.groupBy(by, "pid").agg(F.max_by("class", F.struct(F.col("n"), -F.col("class"))).alias("sem_vote"))
    return points.select(by, "pid").join(won, [by, "pid"], "left").withColumn("sem_vote", F.coalesce("sem_vote", F.lit(-1)))


def clean_instances(points: DataFrame, min_points: int = 10, by: str = "scene_id") -> DataFrame:
    """-1 for the instance of ground points, and for instances of too few other points."""
    bare = points.withColumn("inst_pred", F.when(F.col("sem_pred") == 0, -1).otherwise(F.col("inst_pred")))
    large = bare.filter("inst_pred >= 0").groupBy(by, "inst_pred").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).withColumn("large", F.lit(True)).drop("n")
    return bare.join(large, [by, "inst_pred"], "left").withColumn("inst_pred", F.when(F.col("large"), F.col("inst_pred")).otherwise(-1)).drop("large")


def _decided_masks(mask_points: DataFrame, masks: DataFrame, threshold: float, by: str) -> DataFrame:
    """Masks with their rank and whether they are kept by the greedy rule.

    Of the masks that are not decided yet, those whose better overlapping masks all are get decided together: the share
    of their points that kept better masks cover decides. Rounds end when none is open; each cuts the lineage."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "mask_id")
    ranked = written(masks.withColumn("rank", F.row_number().over(order)))
    rows = written(mask_points.join(ranked.select(by, "mask_id", "rank"), [by, "mask_id"]).select(by, "mask_id", "rank", "pid"))
    sizes = rows.groupBy(by, "mask_id").agg(F.count("*").alias("size"))
    better, worse = (rows.select(by, "pid", F.col("mask_id").alias(f"mask_{s}"), F.col("rank").alias(f"rank_{s}")) for s in "ij")
    edges = written(better.join(worse, [by, "pid"]).filter("rank_i < rank_j").select(by, "mask_i", "mask_j").distinct())
    state = written(ranked.select(by, "mask_id", F.lit(None).cast("boolean").alias("kept")))
    while not state.filter("kept IS NULL").isEmpty():
        open_before = edges.join(state.filter("kept IS NULL").select(by, F.col("mask_id").alias("mask_i")), [by, "mask_i"], "left_semi").select(by, F.col("mask_j").alias("mask_id")).distinct()
        ready = state.filter("kept IS NULL").join(open_before, [by, "mask_id"], "left_anti").select(by, "mask_id")
        kept_rows = rows.join(state.filter("kept"), [by, "mask_id"], "left_semi").groupBy(by, "pid").agg(F.min("rank").alias("first"))
        share = rows.join(ready, [by, "mask_id"], "left_semi").join(kept_rows, [by, "pid"], "left").groupBy(by, "mask_id").agg(F.count_if(F.col("first") < F.col("rank")).alias("taken"))
        verdict = ready.join(share, [by, "mask_id"], "left").join(sizes, [by, "mask_id"], "left").select(by, "mask_id", (F.coalesce("taken", F.lit(0)) / F.coalesce("size", F.lit(1)) <= threshold).alias("now"))
        state = written(state.join(verdict, [by, "mask_id"], "left").select(by, "mask_id", F.coalesce("kept", "now").alias("kept")))
    return ranked.join(state, [by, "mask_id"])


def merge_masks_by_score(mask_points: DataFrame, masks: DataFrame, points: DataFrame, threshold: float = 0.3, by: str = "scene_id") -> DataFrame:
    """Greedy merge by falling score: a mask is skipped if kept better ones have taken more than a share of its points,
    else it writes all its points, over theirs. Points of no kept mask have -1 and score 0.

    Only masks that are the best of at least one point take part."""
    owners = best_mask_per_point(mask_points, masks, by).select(by, "mask_id").distinct()
    masks = masks.join(owners, [by, "mask_id"], "left_semi")
    mask_points = mask_points.join(owners, [by, "mask_id"], "left_semi")
    kept = _decided_masks(mask_points, masks, threshold, by).filter("kept").select(by, "mask_id", "rank", "score")
    last = mask_points.join(kept, [by, "mask_id"]).groupBy(by, "pid").agg(F.max_by(F.struct("mask_id", "score"), "rank").alias("m")).select(by, "pid", "m.*")
    joined = points.select(by, "pid").join(last, [by, "pid"], "left")
    return joined.select(by, "pid", F.coalesce("mask_id", F.lit(-1)).alias("inst_merged"), F.coalesce("score", F.lit(0.0)).alias("merged_score"))


def merge_masks_pairwise(mask_points: DataFrame, masks: DataFrame, threshold: float = 0.3, by: str = "scene_id") -> DataFrame:
    """Masks that stay when pairs are looked at in list order: of two of which one holds more than a share of the other the
    lower score goes (the later one on a tie), unless one of them has gone before.

    A mask goes at its first pair with a better one that is still there then, so its fate follows from those of better masks
    alone: each round decides, for all scenes at once, the masks whose better partners are all decided."""
    pairs = mask_overlap(mask_points, by=by).filter((F.col("in_a") > threshold) | (F.col("in_b") > threshold)).select(by, "mask_a", "mask_b")
    score = masks.select(by, "mask_id", "score")
    pairs = pairs.join(score.withColumnsRenamed({"mask_id": "mask_a", "score": "sa"}), [by, "mask_a"]).join(score.withColumnsRenamed({"mask_id": "mask_b", "score": "sb"}), [by, "mask_b"])
    first = F.col("sa") >= F.col("sb")
    worse, better = F.when(first, F.col("mask_b")).otherwise(F.col("mask_a")), F.when(first, F.col("mask_a")).otherwise(F.col("mask_b"))
    open_ = written(pairs.select(by, worse.alias("mask_id"), better.alias("better"), F.struct("mask_a", "mask_b").alias("turn")))
    # masks without a better partner stay; ``went`` is the pair at which a mask goes
    decided = open_.select(by, F.col("better").alias("mask_id")).distinct().join(open_.select(by, "mask_id").distinct(), [by, "mask_id"], "left_anti")
    decided = written(decided.withColumn("went", F.lit(None).cast(open_.schema["turn"].dataType)))
    gone = None
    while not open_.isEmpty():
        known = decided.select(by, F.col("mask_id").alias("better"), F.col("went").alias("better_went"), F.lit(True).alias("known"))
        met = open_.join(known, [by, "better"], "left")
        there = F.col("better_went").isNull() | (F.col("better_went") > F.col("turn"))
        fates = met.groupBy(by, "mask_id").agg(F.count_if(F.col("known").isNull()).alias("waiting"), F.min(F.when(there, F.col("turn"))).alias("went"))
        now = written(fates.filter("waiting = 0").select(by, "mask_id", "went"))
        decided = written(decided.unionByName(now))
        gone = now.filter("went IS NOT NULL") if gone is None else gone.unionByName(now.filter("went IS NOT NULL"))
        open_ = written(open_.join(now, [by, "mask_id"], "left_anti"))
    return masks if gone is None else masks.join(gone, [by, "mask_id"], "left_anti")


def connected(edges: DataFrame, nodes: DataFrame, by: str = "scene_id") -> DataFrame:
    """The smallest id that each node (by, id) is connected with, by passing on smallest ids until nothing changes.

    An id goes to a node's neighbours and to the nodes that name them, so whole groups are hung up at once: long chains take few rounds."""
    both = written(edges.select(by, "a", "b").union(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(nodes.select(by, F.col("id").alias("a"), F.col("id").alias("root")))
    while True:
        met = both.join(labels.select(by, F.col("a").alias("b"), F.col("root").alias("near")), [by, "b"]).join(labels, [by, "a"])
        near = met.select(by, F.explode(F.array("a", "root")).alias("a"), "near").groupBy(by, "a").agg(F.min("near").alias("near"))
        step = labels.join(near, [by, "a"], "left").withColumn("new", F.least("root", "near"))
        up = labels.select(by, F.col("a").alias("new"), F.col("root").alias("higher"))  # a label's own label halves the way
        after = written(step.join(up, [by, "new"], "left").select(by, "a", F.least("new", "higher").alias("root"), F.col("root").alias("old")))
        labels = after.select(by, "a", "root")
        if after.filter("root <> old").isEmpty():
            return labels.withColumnRenamed("a", "id")


def merge_masks_by_iou(mask_points: DataFrame, masks: DataFrame, threshold: float = 0.6, by: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Unites masks that overlap by more than the threshold, directly or through others: the united points, and the
    smallest mask id and best score of each union."""
    pairs = mask_overlap(mask_points, by=by).filter(F.col("iou") > threshold).select(by, F.col("mask_a").alias("a"), F.col("mask_b").alias("b"))
    root = connected(pairs, masks.select(by, F.col("mask_id").alias("id")), by)
    labelled = masks.join(root.withColumnRenamed("id", "mask_id"), [by, "mask_id"])
    merged = labelled.groupBy(by, F.col("root").alias("mask_id")).agg(F.max("score").alias("score"), F.count("*").alias("n_masks"))
    points = mask_points.join(labelled.select(by, "mask_id", "root"), [by, "mask_id"]).select(by, F.col("root").alias("mask_id"), "pid").distinct()
    return points, merged


def panoptic_map(mask_points: DataFrame, masks: DataFrame, points: DataFrame, n_stuff: int = 1, min_points: int = 10, by: str = "scene_id") -> DataFrame:
    """Per point the id of its best mask (compact, after the stuff ids), if the mask wins enough points; else its stuff class."""
    best = best_mask_per_point(mask_points, masks, by)
    large = best.groupBy(by, "mask_id").agg(F.count("*").alias("n")).filter(F.col("n") > min_points).select(by, "mask_id")
    numbered = dense_ids(best.join(large, [by, "mask_id"]).select(by, "pid", "mask_id"), by, "mask_id")
    joined = points.select(by, "pid", "sem_pred").join(numbered, [by, "pid"], "left")
    stuff = F.when(F.col("sem_pred") < n_stuff, F.col("sem_pred")).otherwise(0)
    return joined.select(by, "pid", F.coalesce(F.col("dense_id") + n_stuff, stuff).alias("panoptic"))


def relabel_instances(points: DataFrame, instance: str = "inst_pred", by: str = "scene_id") -> DataFrame:
    """Final ids from 0 in the order of the old ones; -1 stays."""
    return dense_ids(points, by, instance, name="final_id")


def sparse_match(costs: DataFrame, k: int, by: str = "scene_id") -> DataFrame:
    """Per truth the queries whose cost is strictly below its (k + 1)-th smallest; without so many all of them."""
    order = Window.partitionBy(by, "gt_id").orderBy("cost")
    limit = F.min(F.when(F.col("place") == k + 1, F.col("cost"))).over(Window.partitionBy(by, "gt_id"))
    ranked = costs.withColumn("place", F.row_number().over(order)).withColumn("limit", limit)
    return ranked.filter(F.col("limit").isNull() | (F.col("cost") < F.col("limit"))).drop("place", "limit")
