"""Operators that split what would be one large group, against plain restatements, with limits forced small."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from standmill.operators import labels, masks, metrics, predict, tiles, voxels
from standmill.streaming import status, tile_merge

POINT = "scene_id int, pid long, x double, y double, z double"


# nearest label


def plain_nearest(queries, refs):
    found = set()
    for scene, pid, x, y, z in queries:
        own = [((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c), ref, v) for s, ref, a, b, c, v in refs if s == scene]
        if own:
            _, ref, v = min(own)
            found.add((scene, pid, ref, v))
    return found


def nearest(spark, queries, refs, cell):
    q, r = spark.createDataFrame(queries, POINT), spark.createDataFrame(refs, POINT + ", sem int")
    rows = [tuple(x) for x in labels.nearest_label(q, r, "sem", cell).select("scene_id", "pid", "ref", "sem").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("heavy", [labels.HEAVY, 8])
def test_nearest_label_with_a_dense_cell_and_a_far_cluster(spark, monkeypatch, heavy):
    monkeypatch.setattr(labels, "HEAVY", heavy)
    monkeypatch.setattr(labels, "CELL_ROWS", 20)
    r = random.Random(heavy)
    dense = [(0, 1000 + k, r.gauss(3, 0.2), r.gauss(3, 0.2), r.gauss(1, 0.1), k % 3) for k in range(150)]
    wide = [(0, k, r.uniform(-40, 60), r.uniform(-40, 60), r.uniform(0, 20), k % 3) for k in range(120)]
    same = [(0, 3000 + k, 5.0, 5.0, 5.0, k % 3) for k in range(40)]  # many references in one place
    refs = dense + wide + same + [(1, 9, 0.0, 0.0, 0.0, 1), (2, 8, 1.0, 1.0, 1.0, 2), (2, 7, 1.0, 1.0, 3.0, 0)]
    queries = [(0, k, r.gauss(3, 0.3), r.gauss(3, 0.3), r.gauss(1, 0.2)) for k in range(200)]
    queries += [(0, 500 + k, 900 + r.random(), -700 + r.random(), 5.0) for k in range(60)]  # far from every reference
    queries += [(0, 700 + k, r.uniform(-50, 70), r.uniform(-50, 70), r.uniform(0, 25)) for k in range(60)]
    queries += [(1, 1, 77.0, 1.0, 1.0), (2, 2, 1.0, 1.0, 2.0), (3, 3, 1.0, 1.0, 1.0)]  # alone, a tie, and no reference
    assert nearest(spark, queries, refs, 2.0) == plain_nearest(queries, refs)


def test_far_queries_do_not_meet_all_references(spark):
    r = random.Random(1)
    refs = [(0, k, r.uniform(0, 64), r.uniform(0, 64), 0.0, 0) for k in range(3000)]
    q0 = labels._boxes(spark.createDataFrame([(0, 1, 5000.0, 30.0, 0.0)], POINT), 1.0, "scene_id")
    r0 = labels._boxes(spark.createDataFrame(refs, POINT + ", sem int").drop("sem"), 1.0, "scene_id")
    pairs = labels._side(q0, "q", "scene_id").join(labels._side(r0, "r", "scene_id"), "scene_id").withColumn("u", F.lit(float("inf")))
    assert labels._pruned(pairs, "scene_id").count() < 40 < r0.count()


def test_nearest_label_of_empty_tables(spark):
    assert nearest(spark, [], [(0, 1, 0.0, 0.0, 0.0, 1)], 1.0) == set() == nearest(spark, [(0, 1, 0.0, 0.0, 0.0)], [], 1.0)


# exact quantiles


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9])
def test_exact_quantile_is_that_of_percentile(spark, monkeypatch, q):
    monkeypatch.setattr(metrics, "RANKED", 5)
    monkeypatch.setattr(metrics, "BUCKETS", 4)
    r = random.Random(3)
    rows = [(0, r.choice([0.0, 0.1, 0.2, 1e9])) for _ in range(500)] + [(1, r.gauss(0, 1)) for _ in range(301)] + [(2, 7.5)] * 90
    rows += [(3, 1.0), (3, 2.0), (4, None), (5, None), (5, -3.0)] + [(6, 2.0**-k) for k in range(200)] + [(7, x) for x in (-1e308, 1e308, 0.0, 5.0, 6.0, 7.0, 8.0)]
    df = spark.createDataFrame(rows, "scene_id int, z double")
    wanted = {x.scene_id: x.q for x in df.groupBy("scene_id").agg(F.percentile("z", F.lit(q)).alias("q")).collect() if x.q is not None}
    found = {x.scene_id: x.quantile for x in metrics.exact_quantile(df, F.col("z"), q).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], rel=1e-12, abs=1e-12) for k in wanted)


def test_ground_height_without_ground_or_points(spark):
    rows = [(0, 1, 3.0), (0, 2, 1.0), (1, 0, 4.0), (1, 0, 5.0), (1, 2, 0.5)]
    df = spark.createDataFrame(rows, "scene_id int, sem_pred int, z double")
    assert {tuple(x) for x in metrics.ground_height(df).collect()} == {(0, 1.0), (1, 4.5)}
    assert metrics.ground_height(df.limit(0)).isEmpty()


# curves


@pytest.mark.parametrize("ranges", [2, 40])
def test_curves_over_score_ranges(spark, ranges):
    r = random.Random(ranges)
    calls = [(label, t, r.randrange(30) / 30, r.random() < 0.6) for label in (0, 1, 2) for t in (0.5, 0.25) for _ in range(60)]
    truths = [(0, 50), (1, 20), (2, 0)]
    found = metrics._curves(spark.createDataFrame(calls, "label int, threshold double, score double, hit boolean"), spark.createDataFrame(truths, "label int, n_truths long"), ranges)
    found = {(x.label, x.threshold): (x.ap, x.precision, x.recall) for x in found.collect()}
    assert found.keys() == {(label, t) for label in (0, 1) for t in (0.5, 0.25)}
    for (label, t), got in found.items():
        own = [(s, h) for a, b, s, h in calls if (a, b) == (label, t)]
        points = []  # from the lowest score up
        for s in sorted({s for s, _ in own}):
            over = [h for x, h in own if x >= s]
            points.append((sum(over) / len(over), sum(over) / dict(truths)[label]))
        precision, recall = [p for p, _ in points] + [1.0], [x for _, x in points] + [0.0]
        wide = [recall[0], *recall, 0.0]
        area = sum(p * (wide[k] - wide[k + 2]) / 2 for k, p in enumerate(precision))
        f1 = [2 * p * x / max(p + x, 1e-12) for p, x in points]
        assert got == pytest.approx((area, *points[f1.index(max(f1))]), abs=1e-9)


# adaptive tiles


def cloud(r, n):
    rows = [(0, k, r.uniform(0, 50), r.uniform(0, 50), 0.0) for k in range(n)] + [(0, 10_000 + k, r.gauss(11, 0.4), r.gauss(12, 0.4), 1.0) for k in range(n)]
    return rows + [(0, 20_000 + k, 30.0, 30.0, 2.0) for k in range(230)] + [(1, k, r.uniform(0, 30), r.uniform(0, 30), 0.0) for k in range(60)]


def test_no_adaptive_tile_is_above_the_cap(spark):
    points = spark.createDataFrame(cloud(random.Random(5), 900), POINT)
    made = predict.adaptive_tiles(points, 20.0, 1.0, 64, 1, levels=5).cache()
    sizes = made.groupBy("scene_id", "tile_id").count().collect()
    assert max(x["count"] for x in sizes) <= 64
    fixed = tiles.assign_tiles(points, 20.0, 1.0, 1).select("scene_id", "pid").distinct()
    assert made.select("scene_id", "pid").distinct().count() == fixed.count() == points.count()
    again = predict.adaptive_tiles(points.repartition(5), 20.0, 1.0, 64, 1, levels=5)
    key = lambda df: sorted(tuple(x) for x in df.select("scene_id", "pid", "tile_id", "path", "part").collect())
    assert key(made) == key(again)
    edges = made.filter("part = 0 AND length(path) = 2").limit(200).collect()
    assert all(len(set(x.path) - set("0123")) == 0 for x in edges)


def test_small_scenes_are_predicted_whole(spark):
    points = spark.createDataFrame(cloud(random.Random(5), 300), POINT)
    size = lambda xyz: (np.zeros(len(xyz)), np.full(len(xyz), -1), np.full(len(xyz), float(len(xyz))))
    found, failed = predict.segment_scenes(points, size, 20.0, 1.0, 100, 1)
    rows = found.collect()
    assert failed.isEmpty() and max(x.score for x in rows) <= 100
    assert {(x.tile_id, x.score) for x in rows if x.scene_id == 1} == {(0, 60.0)}
    assert {(x.scene_id, x.pid) for x in rows} == {(x.scene_id, x.pid) for x in points.collect()}


@pytest.mark.parametrize("group", [predict.GROUP_ROWS, 100])
def test_scenes_are_predicted_in_the_adaptive_tiles_and_written_once(spark, monkeypatch, group):
    """Tiles, and parts of too full ones in several groups, as adaptive_tiles() has them; only points and results are written."""
    monkeypatch.setattr(predict, "GROUP_ROWS", group)
    points = spark.createDataFrame(cloud(random.Random(6), 700), POINT)
    key = lambda df: sorted(tuple(x) for x in df.select("scene_id", "pid", "tile_id").collect())
    wanted = key(predict.adaptive_tiles(points.filter("scene_id = 0"), 20.0, 1.0, 64, 5, levels=2))
    tables, real = [], predict.written
    monkeypatch.setattr(predict, "written", lambda df: tables.append(df.columns) or real(df))
    high = lambda xyz: (xyz[:, 2], xyz[:, 2], xyz[:, 0] if (np.diff(xyz[:, 2]) >= 0).all() else xyz[:, 0, 0])
    found, failed = predict.segment_scenes(points, high, 20.0, 1.0, 64, 5, levels=2)
    assert failed.isEmpty() and key(found.filter("scene_id = 0")) == wanted
    assert found.filter("scene_id = 1").count() == 60 and found.join(points, ["scene_id", "pid"]).filter("score != x OR semantic_pred != z").isEmpty()
    assert [t for t in tables if "pid" in t] == [["scene_id", "pid", "x", "y", "z"], ["scene_id", "tile_id", "pid", "semantic_pred", "instance_pred", "score", "error"]]


def test_tiles_that_fail_are_told_apart_in_a_group(spark):
    points = spark.createDataFrame(cloud(random.Random(6), 700), POINT)

    def some(xyz):
        if xyz[0, 0] < 12:
            raise ValueError("no")
        return np.zeros(len(xyz)), np.zeros(len(xyz)), xyz[:, 0]

    made = predict.adaptive_tiles(points.filter("scene_id = 0"), 20.0, 1.0, 64, 5, levels=2)
    found, failed = predict.segment_scenes(points.filter("scene_id = 0"), some, 20.0, 1.0, 64, 5, levels=2)
    lost = {r.tile_id for r in made.groupBy("tile_id").agg(F.min_by("x", "pid").alias("x")).filter("x < 12").collect()}
    assert lost and {(r.tile_id, r.error) for r in failed.collect()} == {(t, "ValueError: no") for t in lost}
    assert {r.tile_id for r in found.collect()} == {r.tile_id for r in made.collect()} - lost


# tiles on a stream


def predictions(r):
    points = [(s, p) for s in range(4) for p in range(60)]
    rows = [(s, p, t, r.randrange(3), r.randrange(-1, 5), r.choice([-1.0, 0.2, 0.5, 0.5, 0.9])) for s in range(3) for t in range(4) for p in range(t * 10, t * 10 + 30)]
    return points, rows


PRED = "scene_id int, pid long, tile_id int, semantic_pred int, instance_pred int, score double"


@pytest.mark.parametrize("seed", [1])
def test_merged_batches_are_the_merge_of_all(spark, tmp_path, seed):
    r = random.Random(seed)
    points, rows = predictions(r)
    points, whole = spark.createDataFrame(points, "scene_id int, pid long"), spark.createDataFrame(rows, PRED)
    wanted = sorted(tuple(x) for x in tiles.merge_tile_predictions(whole, points).collect())
    expected = whole.filter("scene_id < 2").groupBy("scene_id").agg(F.count("*").alias("n_rows"))  # the third scene stays open
    r.shuffle(rows)  # tiles come in pieces, in any order
    cuts = [0, 40, 41, 150, 300, len(rows)]
    batches = [spark.createDataFrame(rows[a:b], PRED) for a, b in zip(cuts, cuts[1:])]
    store = tile_merge.TileMerge(spark, f"file://{tmp_path}/store", points, expected)
    for n, batch in enumerate(batches):
        store.upsert(batch, n)
        store.upsert(batch, n)  # replayed
        if n == 2:
            store = tile_merge.TileMerge(spark, f"file://{tmp_path}/store", points, expected)  # a new driver
            with pytest.MonkeyPatch.context() as broken:  # the next batch breaks off before it is in the ledger
                broken.setattr(store, "_merged", None)
                with pytest.raises(TypeError):
                    store.upsert(batches[3], 3)
            assert store.committed() == 2
    assert sorted(tuple(x) for x in store.result().collect()) == wanted
    done = {x.scene_id for x in store.finished().select("scene_id").distinct().collect()}
    assert done == {0, 1}
    assert {x.scene_id for x in store.winners().select("scene_id").distinct().collect()} == {2}  # finished scenes are not kept
    assert len(store._numbers("winners")) == 1 and len(store._numbers("ledger")) == 2
    store.upsert(batches[0].filter("scene_id = 0"), 99)  # rows of a finished scene
    assert sorted(tuple(x) for x in store.result().collect()) == wanted


def test_merge_without_batches(spark, tmp_path):
    points = spark.createDataFrame([(0, 1)], "scene_id int, pid long")
    store = tile_merge.TileMerge(spark, f"file://{tmp_path}/store", points)
    assert [tuple(x) for x in store.result().collect()] == [(0, 1, -1, -1, -1.0)]
    store.upsert(spark.createDataFrame([(None, 1, 0, 1, 1, 0.5), (0, None, 0, 1, 1, 0.5)], PRED), 0)
    assert [tuple(x) for x in store.result().collect()] == [(0, 1, -1, -1, -1.0)]


# masks in list order


@pytest.mark.parametrize("seed", [1, 2])
def test_pairwise_merge_is_that_of_the_list(spark, seed):
    r = random.Random(seed)
    held = {(s, m): {r.randrange(60) for _ in range(r.randint(1, 14))} for s in range(3) for m in range(40)}
    score = {k: r.choice([0.1, 0.4, 0.4, 0.7, 0.9]) for k in held}
    points = spark.createDataFrame([(s, m, p) for (s, m), own in held.items() for p in own], "scene_id int, mask_id int, pid long")
    listed = spark.createDataFrame([(s, m, 0, v) for (s, m), v in score.items()], "scene_id int, mask_id int, label int, score double")
    gone = set()
    for s in range(3):
        for a in range(40):
            for b in range(a + 1, 40):
                both = len(held[s, a] & held[s, b])
                if (both / len(held[s, a]) > 0.3 or both / len(held[s, b]) > 0.3) and not {(s, a), (s, b)} & gone:
                    gone.add((s, b) if score[s, a] >= score[s, b] else (s, a))
    assert {(x.scene_id, x.mask_id) for x in masks.merge_masks_pairwise(points, listed).collect()} == set(held) - gone
    assert masks.merge_masks_pairwise(points.limit(0), listed).count() == len(held)


def test_merge_by_overlap_unites_long_chains_in_few_rounds(spark, monkeypatch):
    """Neighbours in a chain share two of four points (an overlap of a third); the smallest id of scene 0 stands at the far end."""
    n, r = 60, random.Random(5)
    chains = {0: [*range(1, n), 0], 1: r.sample(range(n), n)}
    held = [(s, m, 2 * at + k) for s, chain in chains.items() for at, m in enumerate(chain) for k in range(4)] + [(1, 99, 5000)]
    score = {(s, m): ((m * 37) % 61) / 61 for s, m, _ in held}
    points = spark.createDataFrame(held, "scene_id int, mask_id int, pid long").withColumn("prob", F.lit(1.0))
    listed = spark.createDataFrame([(s, m, 0, v) for (s, m), v in score.items()], "scene_id int, mask_id int, label int, score double")
    rounds, written = [], masks.written
    monkeypatch.setattr(masks, "written", lambda df: rounds.append(1) or written(df))
    united, merged = masks.merge_masks_by_iou(points, listed, 0.3)
    best = {s: max(v for (t, m), v in score.items() if t == s and m != 99) for s in chains}
    assert sorted(map(tuple, merged.select("scene_id", "mask_id", "score", "n_masks").collect())) == [(0, 0, best[0], n), (1, 0, best[1], n), (1, 99, score[1, 99], 1)]
    assert sorted(map(tuple, united.select("scene_id", "mask_id", "pid").collect())) == sorted({(s, m if m == 99 else 0, p) for s, m, p in held})
    assert len(rounds) < 16
    assert masks.merge_masks_by_iou(points, listed, 0.4)[1].count() == 2 * n + 1  # nothing overlaps by more


# farthest points


def test_farthest_points_in_rounds_are_those_of_one_task(spark, monkeypatch):
    r = random.Random(8)
    rows = [(0, k, r.uniform(0, 90), r.gauss(0, 20), r.uniform(0, 9)) for k in range(700)]
    rows += [(1, k, float(r.randrange(7)), float(r.randrange(7)), 0.0) for k in range(400)]  # many ties, and fewer places than samples
    rows += [(2, k, 1.0, 1.0, 1.0) for k in range(120)] + [(3, k, float(k), 0.0, 0.0) for k in range(30)]
    points = spark.createDataFrame(rows, POINT).repartition(4)
    key = lambda df: sorted((x.scene_id, x["rank"], x.pid) for x in df.collect())
    plain = key(voxels.query_fps(points, 60))
    monkeypatch.setattr(voxels, "FPS_ROWS", 100)
    assert key(voxels.query_fps(points, 60)) == plain and len(plain) == 60 * 3 + 30


# pending requests on streams


def test_pending_requests_over_any_batches(spark, tmp_path):
    """Requests and reports come in turns: a finish before its request, one long after it, and one that never comes."""
    def put(name, schema, *batches):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    asked = put("asked", "task_id long", [(1,), (2,)], [(3,), (4,)], [(1,), (5,)])
    reports = put("reports", "task_id long, step string", [(3, "failed"), (1, "reading")], [(2, "completed"), (9, "completed")], [(4, "reading"), (5, "completed")])
    changes = status.pending_requests_stream(asked, reports)
    kept = []
    changes.writeStream.option("checkpointLocation", f"{tmp_path}/seen").foreachBatch(lambda df, n: kept.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
    found = spark.createDataFrame(kept, "task_id long, version int, pending boolean")
    assert {x.task_id for x in status.latest_pending(found).collect()} == {1, 4}
    assert (2, 1, True) in kept and (2, 2, False) in kept and len(kept) == len(set(kept))
