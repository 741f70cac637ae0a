"""Per-tree and per-scene metrics, and the evaluation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.functions.keys import half_even
from standmill.sources.storage import written
from standmill.operators.frames import binary_class

GROUND, WOOD, LEAF = 0, 1, 2


def exact_mean(column: str) -> Column:
    """The mean, by a decimal sum to nine places: it does not depend on the order of the rows."""
    return F.sum(F.col(column).cast("decimal(20,9)")).cast("double") / F.count(column)


def scene_stats(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Points, trees, assigned points, and points of each class."""
    tree = F.when(F.col("inst_pred") >= 0, F.col("inst_pred"))
    classes = [F.count_if(F.col("sem_pred") == k).alias(n) for n, k in (("ground", GROUND), ("wood", WOOD), ("leaf", LEAF))]
    return points.groupBy(by).agg(F.count("*").alias("n_original"), F.countDistinct(tree).alias("n_trees"), F.count(tree).alias("n_assigned"), *classes)


def tree_metrics(points: DataFrame, by: str = "scene_id", min_points: int = 10) -> DataFrame:
    """Size, crown, wood and leaf counts, score and place of every tree of at least min_points points.

    Unassigned points go before the shuffle. Ratios are null where they would be noise: under 20 wood points, no leaf, or over 300."""
    c = F.col
    trees = points.filter("inst_pred >= 0").groupBy(by, "inst_pred").agg(
        F.count("*").alias("n_points"), F.min("z").alias("z0"), F.max("z").alias("z1"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("width"),
        F.count_if(c("sem_pred") == WOOD).alias("wood_points"), F.count_if(c("sem_pred") == LEAF).alias("leaf_points"),
        exact_mean("score").alias("score"), exact_mean("x").alias("cx"), exact_mean("y").alias("cy"),
    )
    height = c("z1") - c("z0")
    ratio = c("leaf_points") / F.when((c("wood_points") >= 20) & (c("leaf_points") > 0), c("wood_points"))
    return trees.filter(c("n_points") >= min_points).select(
        by, c("inst_pred").alias("tree_id"), "n_points", half_even(height, 2).alias("height_m"), half_even(F.col("width"), 2).alias("crown_width_m"),
        F.when(height > 0.1, half_even(c("width") / height, 2)).alias("crown_ratio"), "wood_points", "leaf_points",
        F.when(ratio <= 300, half_even(ratio, 2)).alias("leaf_wood_ratio"), half_even(F.col("score"), 3).alias("mean_score"),
        half_even(F.col("cx"), 2).alias("center_x"), half_even(F.col("cy"), 2).alias("center_y"), half_even(F.col("z0"), 2).alias("base_z"),
    )


#: Buckets of a selection round, and rows of a bucket that are ranked.
BUCKETS, RANKED = 1024, 10_000


def exact_quantile(rows: DataFrame, value: Column, q: float, by: str = "scene_id") -> DataFrame:
    """by and quantile: the exact quantile of a group's values (nulls ignored), interpolated between two neighbours.

    Selection: each round counts the values of a narrowing range in buckets and goes on with the bucket of the wanted rank,
    until that is one value, lies between two buckets, or has few rows to rank. No task holds a group's values."""
    values = rows.select(by, value.cast("double").alias("v")).filter("v IS NOT NULL")
    at = F.col("n") - 1
    state = values.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.withColumns({"place": at * F.lit(float(q)), "before": F.lit(0).cast("long"), "inside": F.col("n")}).drop("n")
    state = written(state.withColumns({"k0": F.floor("place"), "k1": F.ceil("place")}))
    done = None
    while True:
        one = state.filter("low = high").select(by, "place", "k0", F.col("low").alias("v0"), F.col("low").alias("v1"))
        few = state.filter(f"low < high AND inside <= {RANKED}")
        order = Window.partitionBy(by).orderBy("v")
        ranked = values.join(few, by).filter("v >= low AND v <= high").withColumn("k", F.row_number().over(order) - 1 + F.col("before"))
        value_at = lambda k: F.max(F.when(F.col("k") == F.col(k), F.col("v")))
        ranked = ranked.groupBy(by).agg(F.first("place").alias("place"), F.first("k0").alias("k0"), value_at("k0").alias("v0"), value_at("k1").alias("v1"))
        now = one.unionByName(ranked)
        many = state.filter(f"low < high AND inside > {RANKED}")
        if many.isEmpty():
            done = now if done is None else done.unionByName(now)
            break
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)).alias("bucket")
        facts = [F.first(c).alias(c) for c in ("place", "k0", "k1", "before")]
        counted = values.join(many, by).filter("v >= low AND v <= high").groupBy(by, bucket).agg(F.count("*").alias("some"), F.min("v").alias("low"), F.max("v").alias("high"), *facts)
        along = Window.partitionBy(by).orderBy("bucket")  # BUCKETS rows a group
        counted = counted.withColumn("end", F.sum("some").over(along) + F.col("before")).withColumn("following", F.lead("low").over(along))
        hit = counted.filter("k0 < end AND k0 >= end - some")
        hit = written(hit.withColumn("between", F.col("k1") >= F.col("end")))  # the ranks are the last of a bucket and the first of the next one
        now = now.unionByName(hit.filter("between").select(by, "place", "k0", F.col("high").alias("v0"), F.col("following").alias("v1")))
        done = now if done is None else done.unionByName(now)
        state = hit.filter("NOT between").select(by, "low", "high", "place", (F.col("end") - F.col("some")).alias("before"), F.col("some").alias("inside"), "k0", "k1")
    share = F.col("place") - F.col("k0")
    return done.select(by, F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise((1 - share) * F.col("v0") + share * F.col("v1")).alias("quantile"))


def ground_height(points: DataFrame, by: str = "scene_id", approximate: bool = False) -> DataFrame:
    """The median height of ground points, or the lowest height of a scene without any."""
    ground = F.when(F.col("sem_pred") == GROUND, F.col("z"))
    if approximate:
        return points.groupBy(by).agg(F.coalesce(F.percentile_approx(ground, F.lit(0.5), F.lit(10000)), F.min("z")).alias("ground_z"))
    lowest = points.groupBy(by).agg(F.min("z").alias("lowest"))
    return lowest.join(exact_quantile(points, ground, 0.5, by), by, "left").select(by, F.coalesce("quantile", "lowest").alias("ground_z"))


def top_trees(trees: DataFrame, n: int, by: str = "scene_id") -> DataFrame:
    """The n tallest trees of each scene with their rank; ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc("height_m"), "tree_id")
    return trees.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def stand_summary(trees: DataFrame, by: str = "scene_id") -> DataFrame:
    """Number of trees, heights, mean ratio of leaf to wood, and the five tallest trees of each scene."""
    five = top_trees(trees, 5, by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "tree_id", "height_m", "crown_width_m"))).alias("tallest"))
    summary = trees.groupBy(by).agg(
        F.count("*").alias("n_trees"), half_even(F.min("height_m"), 1).alias("height_min"), half_even(F.max("height_m"), 1).alias("height_max"),
        half_even(F.avg("height_m"), 1).alias("height_mean"), half_even(F.avg("leaf_wood_ratio"), 2).alias("leaf_wood_ratio_mean"),
    )
    return summary.join(five, by)


def instance_boxes(points: DataFrame, by: str = "scene_id", instance: str = "inst_gt", care: Sequence[int] = (1,)) -> DataFrame:
    """Axis-aligned boxes of the instances that are not ground (class 1 each), of the classes that are cared for."""
    bounds = points.filter(F.col(instance) > 0).groupBy(by, F.col(instance).alias("box_id")).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    middle = [((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2).alias(f"c{a}") for a in "xyz"]
    return bounds.select(by, "box_id", *middle, *[(F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(f"d{a}") for a in "xyz"], F.lit(1).alias("label")).filter(F.col("label").isin(*care))


def semantic_confusion(points: DataFrame, truth: str = "sem_gt", predicted: str = "sem_pred") -> DataFrame:
    return points.groupBy(F.col(truth).alias("gt"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def class_iou(confusion: DataFrame) -> DataFrame:
    """Per class: points of truth and prediction, hits, and their overlap. The confusion table is classes squared."""
    c = F.col
    both = F.explode(F.array(F.struct(c("gt").alias("class"), c("n").alias("n_gt"), F.lit(0).cast("long").alias("n_pred")), F.struct(c("pred").alias("class"), F.lit(0).cast("long").alias("n_gt"), c("n").alias("n_pred"))))
    rows = confusion.select(both.alias("r"), F.when(c("gt") == c("pred"), c("n")).otherwise(0).alias("hit")).select("r.*", F.when(c("r.n_gt") > 0, c("hit")).otherwise(0).alias("hit"))
    found = rows.groupBy("class").agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("hit").alias("tp"))
    return found.withColumn("iou", c("tp") / (c("n_gt") + c("n_pred") - c("tp") + F.lit(1e-8)))


def mean_iou(per_class: DataFrame, unclassified: int = 0) -> DataFrame:
    """The mean over classes that occur in the truth, without the unclassified one."""
    used = per_class.filter((F.col("n_gt") > 0) & (F.col("class") != unclassified))
    return used.agg(F.count("*").alias("n_classes"), F.avg("iou").alias("miou"))


def instance_overlap(points: DataFrame, predicted: str = "pred", truth: str = "gt", by: str = "scene_id") -> DataFrame:
    """Points that a predicted and a true instance share, their sizes, and the overlap, for pairs that share any.

    Ids below 0 in either column do not count."""
    cell = points.groupBy(by, predicted, truth).agg(F.count("*").alias("n"))
    sizes = lambda c, n: cell.filter(F.col(c) >= 0).groupBy(by, c).agg(F.sum("n").alias(n))
    pairs = cell.filter((F.col(predicted) >= 0) & (F.col(truth) >= 0)).withColumnRenamed("n", "inter")
    out = pairs.join(sizes(predicted, "n_pred"), [by, predicted]).join(sizes(truth, "n_gt"), [by, truth])
    return out.withColumn("iou", F.col("inter") / (F.col("n_pred") + F.col("n_gt") - F.col("inter")))


def _of_things(points: DataFrame, instance: str, semantic: str, by: str) -> DataFrame:
    """Instances whose most frequent binary class is that of things; ties go to the smaller class."""
    counted = points.groupBy(by, instance, binary_class(F.col(semantic)).alias("b")).agg(F.count("*").alias("n"))
    return counted.groupBy(by, instance).agg(F.max_by("b", F.struct(F.col("n"), -F.col("b"))).alias("b")).filter("b = 2").select(by, instance)


def eval_instances(points: DataFrame, by: str = "scene_id", threshold: float = 0.5) -> DataFrame:
    """Per scene: true and false positives, instances, the sum of hit overlaps, and the two coverages.

    Points that are ground on both sides do not count. A prediction hits if its best overlap reaches the threshold; two
    may hit one instance. Coverage is null in a scene without predictions or truths."""
    kept = points.filter(~((F.col("sem_gt") == 0) & (F.col("sem_pred") == 0)))
    pred = _of_things(kept.filter("inst_pred >= 0"), "inst_pred", "sem_pred", by).withColumn("pred", F.col("inst_pred"))
    gt = _of_things(kept.filter("inst_gt > 0"), "inst_gt", "sem_gt", by).withColumn("gt", F.col("inst_gt"))
    cell = kept.groupBy(by, "inst_pred", "inst_gt").agg(F.count("*").alias("n"))
    n_pred = cell.groupBy(by, "inst_pred").agg(F.sum("n").alias("n_pred")).join(pred.drop("pred"), [by, "inst_pred"])
    n_gt = cell.groupBy(by, "inst_gt").agg(F.sum("n").alias("n_gt")).join(gt.drop("gt"), [by, "inst_gt"])
    pairs = cell.join(n_pred, [by, "inst_pred"]).join(n_gt, [by, "inst_gt"]).withColumn("iou", F.col("n") / (F.col("n_pred") + F.col("n_gt") - F.col("n")))
    best_pred = n_pred.join(pairs.groupBy(by, "inst_pred").agg(F.max("iou").alias("iou")), [by, "inst_pred"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    best_gt = n_gt.join(pairs.groupBy(by, "inst_gt").agg(F.max("iou").alias("iou")), [by, "inst_gt"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    hit = F.col("iou") >= threshold
    p = best_pred.groupBy(by).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"), F.sum(F.when(hit, F.col("iou")).otherwise(0.0)).alias("tp_iou"))
    g = best_gt.groupBy(by).agg(F.count("*").alias("n_gt"), F.avg("iou").alias("cov"), (F.sum(F.col("iou") * F.col("n_gt")) / F.sum("n_gt")).alias("wcov"))
    both = kept.select(by).distinct().join(p, by, "left").join(g, by, "left")
    recorded = F.col("tp").isNotNull() & F.col("cov").isNotNull()
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tp", "fp", "n_gt")} | {"tp_iou": F.coalesce("tp_iou", F.lit(0.0))}
    return both.withColumns({"cov": F.when(recorded, F.col("cov")), "wcov": F.when(recorded, F.col("wcov"))}).withColumns(zero).select(by, "tp", "fp", "n_gt", "tp_iou", "cov", "wcov")


def aggregate_eval(scenes: DataFrame) -> DataFrame:
    """Precision, recall, recognition, segmentation and panoptic quality, and mean coverages over all scenes."""
    eps = F.lit(1e-8)
    total = scenes.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "n_gt", "tp_iou")], F.avg("cov").alias("mucov"), F.avg("wcov").alias("mwcov"))
    total = total.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("n_gt") + eps), "sq": F.col("tp_iou") / (F.col("tp") + eps)})
    total = total.withColumn("rq", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)).withColumn("pq", F.col("sq") * F.col("rq"))
    return total.select(*[half_even(F.col(c), 4).alias(c) for c in ("precision", "recall", "rq", "sq", "pq", "mucov", "mwcov")])


def encode_gt_ids(points: DataFrame, valid: Sequence[int] = (1, 2), by: str = "scene_id") -> DataFrame:
    """1000 * class + instance where the instance's smallest class is valid, else 0."""
    first = points.groupBy(by, "inst_gt").agg(F.min("sem_gt").alias("class"))
    code = F.when(F.col("class").isin(*valid), F.col("class") * 1000 + F.col("inst_gt")).otherwise(0)
    return points.join(first, [by, "inst_gt"]).withColumn("gt_code", code).drop("class")


def mask_pair_scores(probabilities: DataFrame, truth: DataFrame, by: str = "scene_id") -> DataFrame:
    """Per pair of a predicted mask (by, mask_id, pid, prob) and a true one (by, gt_id, pid, visible share of it as
    ratio): overlap at probability 0.5, the same against the whole instance, and the dice and cross entropy costs."""
    log = lambda p: F.log(F.greatest(p, F.lit(1e-6)))
    p = F.col("prob")
    inter = probabilities.join(truth, [by, "pid"]).groupBy(by, "mask_id", "gt_id").agg(
        F.count_if(p >= 0.5).alias("inter"), F.sum("prob").alias("soft"), F.sum(-log(p) + log(1 - p)).alias("gain"), F.max("ratio").alias("ratio")
    )
    mine = probabilities.groupBy(by, "mask_id").agg(F.count_if(p >= 0.5).alias("n_pred"), F.sum("prob").alias("mass"), F.sum(-log(1 - p)).alias("off"), F.count("*").alias("n"))
    theirs = truth.groupBy(by, "gt_id").agg(F.count("*").alias("n_gt"))
    c = F.col
    return inter.join(mine, [by, "mask_id"]).join(theirs, [by, "gt_id"]).select(
        by, "mask_id", "gt_id", (c("inter") / (c("n_pred") + c("n_gt") - c("inter") + F.lit(1e-6))).alias("iou"),
        (c("inter") / (c("n_pred") + c("n_gt") / c("ratio") - c("inter") + F.lit(1e-6))).alias("iou_whole"),
        (1 - (2 * c("soft") + 1) / (c("mass") + c("n_gt") + 1)).alias("dice"), ((c("off") + c("gain")) / c("n")).alias("bce"),
    )


THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.25)


def average_precision(pred_masks: DataFrame, pred_points: DataFrame, truth: DataFrame, by: str = "scene_id", min_region: int = 100) -> DataFrame:
    """Average precision per class and threshold, with the best-F1 precision and recall.

    pred_masks: by, mask_id, label, score; pred_points: by, mask_id, pid; truth: by, pid, label, gt_id (0: void).
    Sizes and intersections are joined and counted by Spark. Predictions and truths meet within a scene only, so the small
    table of overlapping pairs is matched scene by scene; the curve comes from counts per score."""
    sizes = pred_points.groupBy(by, "mask_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_region)
    preds = pred_masks.join(sizes, [by, "mask_id"])
    hits = pred_points.join(truth, [by, "pid"])
    void = hits.filter("gt_id = 0").groupBy(by, "mask_id").agg(F.count("*").alias("void"))
    inter = hits.filter("gt_id > 0").groupBy(by, "mask_id", "gt_id", F.col("label").alias("gt_label")).agg(F.count("*").alias("inter"))
    gts = truth.filter("gt_id > 0").groupBy(by, "gt_id", "label").agg(F.count("*").alias("n_gt"))
    pairs = preds.join(void, [by, "mask_id"], "left").join(inter, [by, "mask_id"], "left").join(gts.withColumnRenamed("label", "gt_label"), [by, "gt_id", "gt_label"], "left")
    pairs = pairs.select(
        by, F.col("label").cast("int"), F.col("mask_id").cast("long"), F.col("score").cast("double"), F.col("n").cast("long"), F.coalesce("void", F.lit(0)).cast("long").alias("void"),
        F.coalesce("gt_id", F.lit(0)).cast("long").alias("gt_id"), F.coalesce("gt_label", F.lit(-1)).cast("int").alias("gt_label"),
        F.coalesce("inter", F.lit(0)).cast("long").alias("inter"), F.coalesce("n_gt", F.lit(0)).cast("long").alias("n_gt"),
    )

    def matched(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = [(int(key[1]), t, score, hit) for t in THRESHOLDS for score, hit in _matched(int(key[1]), t, group, min_region)]
        return pd.DataFrame(found, columns=["label", "threshold", "score", "hit"])

    calls = pairs.groupBy(by, "label").applyInPandas(matched, "label int, threshold double, score double, hit boolean")
    labels = preds.select(F.col("label").cast("int")).union(gts.select(F.col("label").cast("int"))).distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    truths = gts.groupBy(F.col("label").cast("int").alias("label")).agg(F.count_if(F.col("n_gt") >= min_region).alias("n_truths"))
    return labels.join(_curves(calls, truths), ["label", "threshold"], "left").join(truths, "label", "left").select(
        "label", "threshold", *[F.when(F.coalesce("n_truths", F.lit(0)) > 0, F.coalesce(c, F.lit(0.0))).alias(c) for c in ("ap", "precision", "recall")]
    )


def _curves(calls: DataFrame, truths: DataFrame, ranges: int | None = None) -> DataFrame:
    """Area under the precision-recall curve, and its point of best F1 (ties: the lowest score), per label and threshold.

    The curve has a point for each distinct score (all calls with at least it) and ends at precision 1 and recall 0. Each
    precision counts for half the recall between its two neighbours; the first point is its own neighbour. The scores are
    dealt into ranges of about equal size: sums run within a range, and what the ranges before it hold is added."""
    key = ["label", "threshold"]
    steps = calls.groupBy(*key, "score").agg(F.count_if("hit").alias("tp"), F.count("*").alias("n")).join(truths.filter("n_truths > 0"), "label")
    order = [F.col("label"), F.col("threshold"), F.desc("score")]
    steps = written((steps.repartitionByRange(ranges, *order) if ranges else steps.repartitionByRange(*order)).withColumn("range", F.spark_partition_id()))
    parts = steps.groupBy(*key, "range").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.max_by("tp", "score").alias("first"))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("tp", "n")})
    parts = parts.withColumn("tp_next", F.lead(F.col("tp_before") + F.col("first")).over(Window.partitionBy(*key).orderBy("range")))
    up = Window.partitionBy(*key, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*key, "range").orderBy(F.desc("score"))
    curve = steps.withColumns({"tp": F.sum("tp").over(up), "n": F.sum("n").over(up)}).join(parts.drop("tp", "n", "first"), [*key, "range"])
    curve = curve.withColumns({"tp": F.col("tp") + F.col("tp_before"), "n": F.col("n") + F.col("n_before")})
    curve = curve.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.col("tp") / F.col("n_truths")})
    # the neighbours: the next higher score, or the end of the curve, and the next lower one
    after = F.coalesce(F.lag("recall").over(along), F.col("tp_before") / F.col("n_truths"))
    lower = F.coalesce(F.lead("recall").over(along), F.col("tp_next") / F.col("n_truths"), F.col("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    curve = curve.withColumns({"area": F.col("precision") * (lower - after) / 2, "f1": f1})
    # the last point has precision 1 and half the recall of the highest score's point
    best = F.max_by(F.struct("precision", "recall"), F.struct(F.col("f1"), -F.col("score")))
    found = curve.groupBy(*key).agg(F.sum("area").alias("area"), F.max_by("recall", "score").alias("top"), best.alias("best"))
    return found.select(*key, (F.col("area") + F.col("top") / 2).alias("ap"), "best.precision", "best.recall")


def _matched(label: int, threshold: float, pairs: pd.DataFrame, min_region: int) -> list[tuple[float, bool]]:
    """What each prediction of a scene and class counts for: score and hit. pairs: a row for each prediction and truth that
    it overlaps (one with gt_id 0 if none). Greedy per truth; predictions that lie on ignored points count for nothing."""
    pairs = pairs.sort_values(["mask_id", "gt_id"])
    iou = pairs["inter"] / (pairs["n_gt"] + pairs["n"] - pairs["inter"])
    wide = (pairs["gt_id"] > 0) & (pairs["n_gt"] >= min_region) & (pairs["gt_label"] == label)
    points: list[tuple[float, bool]] = []
    taken: set[int] = set()  # the first prediction that a truth meets is used up; later ones of it stay free for other truths
    for _, own in pairs[wide & (iou > threshold)].groupby("gt_id", sort=True):
        free = own[~own["mask_id"].isin(taken)]
        if len(free):
            taken.add(int(free["mask_id"].iloc[0]))
            scores = sorted(free["score"])
            points += [(s, False) for s in scores[:-1]] + [(scores[-1], True)]
    reaching = set(pairs.loc[wide & (iou > threshold), "mask_id"])
    small = pairs["inter"].where((pairs["gt_id"] > 0) & (pairs["n_gt"] < min_region) & (pairs["gt_label"] == label), 0)
    for mask_id, own in pairs.assign(small=small).groupby("mask_id", sort=True):
        if mask_id not in reaching and (own["void"].iloc[0] + own["small"].sum()) / own["n"].iloc[0] <= threshold:
            points.append((float(own["score"].iloc[0]), False))
    return points


def summarize_ap(per_threshold: DataFrame) -> DataFrame:
    """Per class: AP over the thresholds but 0.25, AP50 and AP25, and precision and recall at 0.5."""
    at = lambda t, c: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col(c)))
    return per_threshold.groupBy("label").agg(F.avg(F.when(F.col("threshold") > 0.26, F.col("ap"))).alias("ap"), at(0.5, "ap").alias("ap50"), at(0.25, "ap").alias("ap25"), at(0.5, "precision").alias("precision50"), at(0.5, "recall").alias("recall50"))
