"""Rules held against plain restatements on small inputs, and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from standmill.functions import keys, text
from standmill.functions.keys import hash_order
from standmill.operators import frames, labels, lod, masks, metrics, predict, tiles, voxels
from standmill.plans.catalog import queries
from standmill.sources import files
from standmill.sources.fixtures import points

SF, QUERIES = "/root/testdata/sf0.001", queries()


def cloud(spark, n=400, scenes=2, seed=1, grid=100):
    r = random.Random(seed)
    rows = [(i, i % scenes, r.randrange(grid) / 10, r.randrange(grid) / 10, r.randrange(grid) / 10, r.randrange(3), r.randrange(6), r.randrange(3), r.randrange(-1, 6), r.random()) for i in range(n)]
    return spark.createDataFrame(rows, "pid long, scene_id int, x double, y double, z double, sem_gt int, inst_gt int, sem_pred int, inst_pred int, score double"), rows


def test_tiles_cover_every_point(spark):
    points, rows = cloud(spark)
    tiled = tiles.assign_tiles(points, 3.0, 0.5, 1)
    assert {r.pid for r in tiled.select("pid").collect()} == {r[0] for r in rows}


def test_merge_does_not_depend_on_order_or_partitions(spark):
    points, rows = cloud(spark)
    preds = spark.createDataFrame([(r[1], r[0], t, r[2 + 3], (r[0] + t) % 4 - 1, ((r[0] * 7 + t * 3) % 5) / 5 - 1.2 * (r[0] % 17 == 0)) for r in rows for t in range(3)], "scene_id int, pid long, tile_id int, semantic_pred int, instance_pred int, score double")
    one = sorted(map(tuple, tiles.merge_tile_predictions(preds, points).collect()))
    many = sorted(map(tuple, tiles.merge_tile_predictions(preds.repartition(64).orderBy(F.desc("score")), points.repartition(16)).collect()))
    assert one == many and len(one) == len(rows)
    assert all(r[2] == -1 and r[3] == -1 for r in one if r[4] == -1)


def overlapping_masks(spark, seed, scenes=2, n_masks=14, n_points=40):
    r = random.Random(seed)
    held = {(s, m): sorted(r.sample(range(n_points), r.randint(1, 12))) for s in range(scenes) for m in range(n_masks)}
    score = {k: r.randrange(1, 8) / 8 for k in held}  # ties
    rows = [(s, m, s * 1000 + p, r.random()) for (s, m), ps in held.items() for p in ps]
    mask_points = spark.createDataFrame(rows, "scene_id int, mask_id int, pid long, prob double")
    table = spark.createDataFrame([(s, m, 0, v) for (s, m), v in score.items()], "scene_id int, mask_id int, label int, score double")
    points = spark.createDataFrame([(s, s * 1000 + p) for s in range(scenes) for p in range(n_points)], "scene_id int, pid long")
    return held, score, rows, mask_points, table, points


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_merge(spark, seed):
    held, score, _, mask_points, table, points = overlapping_masks(spark, seed)
    wanted = {}
    for s in {k[0] for k in held}:
        order = sorted((m for (t, m) in held if t == s), key=lambda m: (-score[s, m], m))
        owner = {}
        for m in order:
            for p in held[s, m]:
                owner.setdefault(p, m)
        alive = [m for m in order if m in owner.values()]
        taken = set()
        for m in alive:
            ps = held[s, m]
            if sum(p in taken for p in ps) / len(ps) <= 0.3:
                taken |= set(ps)
                for p in ps:
                    wanted[s, s * 1000 + p] = (m, score[s, m])
    got = {(r.scene_id, r.pid): (r.inst_merged, r.merged_score) for r in masks.merge_masks_by_score(mask_points, table, points).collect()}
    assert len(got) == points.count()
    assert {k: v for k, v in got.items() if v[0] != -1} == wanted


@pytest.mark.parametrize("kernel", ["linear", "gaussian"])
def test_matrix_nms_against_the_dense_form(spark, kernel):
    held, score, rows, mask_points, table, _ = overlapping_masks(spark, 5, scenes=1)
    order = sorted((m for _, m in held), key=lambda m: (-score[0, m], m))
    dense = np.zeros((len(order), 40))
    for s, m, p, prob in rows:
        dense[order.index(m), p] = prob
    inter, area = dense @ dense.T, dense.sum(axis=1)
    iou = np.triu(inter / (area[:, None] + area[None, :] - inter + 1e-6), 1)
    comp = iou.max(axis=0)[:, None]
    decay = ((1 - iou) / (1 - comp + 1e-6) if kernel == "linear" else np.exp(-2 * iou**2) / np.exp(-2 * comp**2)).min(axis=0)
    got = {r.mask_id: r.score for r in masks.matrix_nms(mask_points, table, kernel).collect()}
    for k, m in enumerate(order):
        assert got[m] == pytest.approx(score[0, m] * decay[k], abs=1e-9)
        assert got[m] <= score[0, m] + 1e-12


def test_pairwise_merge_resolves_in_order(spark):
    held, score, _, mask_points, table, _ = overlapping_masks(spark, 7, scenes=1)
    gone = set()
    for a, b in itertools.combinations(sorted(m for _, m in held), 2):
        common = len(set(held[0, a]) & set(held[0, b]))
        if common and max(common / len(held[0, a]), common / len(held[0, b])) > 0.3 and a not in gone and b not in gone:
            gone.add(b if score[0, a] >= score[0, b] else a)
    assert {r.mask_id for r in masks.merge_masks_pairwise(mask_points, table).collect()} == {m for _, m in held} - gone


def test_nearest_label_meets_far_points(spark):
    refs = spark.createDataFrame([(0, 100, 0.0, 0.0, 0.0, 7), (0, 101, 500.0, 0.0, 0.0, 8)], "scene_id int, pid long, x double, y double, z double, v int")
    asked = spark.createDataFrame([(0, 1, 0.1, 0.0, 0.0), (0, 2, 240.0, 3.0, 0.0), (0, 3, 499.0, 90.0, 0.0), (0, 4, 250.0, 0.0, 0.0)], "scene_id int, pid long, x double, y double, z double")
    got = {r.pid: r.v for r in labels.nearest_label(asked, refs, "v", 1.0).collect()}
    assert got == {1: 7, 2: 7, 3: 8, 4: 7}
    narrow = {r.pid: r.v for r in labels.nearest_label(asked, refs, "v", 0.01).collect()}
    assert narrow == got


def test_farthest_points(spark):
    points, rows = cloud(spark, 60, 1)
    place = np.array([r[2:5] for r in rows])
    chosen = [0]
    while len(chosen) < 9:
        gap = np.min([((place - place[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(int(gap.argmax()))
    got = [r.pid for r in voxels.query_fps(points, 9).orderBy("rank").collect()]
    assert got == chosen


@pytest.mark.parametrize("mode", ["grid", "adaptive"])
def test_query_points_keep_the_budget(spark, mode):
    points, rows = cloud(spark, 300, 2)
    got = voxels.select_queries(points, mode, 40).groupBy("scene_id").count().collect()
    assert len(got) == 2 and all(10 < r["count"] <= 40 for r in got)


def adaptive_by_hand(rows, n):
    """Which pids stay of one scene's (pid, u, v, height): the highest of each cell, thinned along a Z-order curve."""
    u, v = (np.array([r[k] for r in rows]) for k in (1, 2))
    cell = max(np.sqrt(np.ptp(u) * np.ptp(v) / min(3 * n, len(rows))), 0.4)
    best = {}
    for pid, a, b, height in rows:
        key = int((a - u.min()) / cell), int((b - v.min()) / cell)
        best[key] = max(best.get(key, (-np.inf, 0)), (height, -pid))
    curve = lambda k: sum(((k[0] >> i & 1) << 2 * i) | ((k[1] >> i & 1) << 2 * i + 1) for i in range(16))
    order = [-best[k][1] for k in sorted(best, key=curve)]
    wanted, m = min(n, len(rows)), len(order)
    return {p for i, p in enumerate(order) if m <= wanted or i == 0 or i * wanted // m != (i - 1) * wanted // m}


def test_adaptive_queries_by_hand(spark):
    points, rows = cloud(spark, 300, 2)
    wanted = {(s, p) for s in (0, 1) for p in adaptive_by_hand([(r[0], *r[2:5]) for r in rows if r[1] == s], 40)}
    assert {(r.scene_id, r.pid) for r in voxels.select_queries(points, "adaptive", 40).collect()} == wanted


def test_adaptive_queries_on_embeddings_by_hand(spark):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(200, 5)) * (9, 5, 1, 0.5, 0.2)
    rows = [(i % 2, i, [float(x) for x in v], float(i % 17)) for i, v in enumerate(vectors)]
    points = spark.createDataFrame(rows, "scene_id int, pid long, embedding array<double>, z double")
    middle = vectors - vectors.mean(axis=0)
    axes = np.linalg.svd(middle)[2][:2]
    axes = axes * np.sign(axes[[0, 1], np.abs(axes).argmax(axis=1)])[:, None]
    at = middle @ axes.T
    wanted = {(s, p) for s in (0, 1) for p in adaptive_by_hand([(r[1], *at[r[1]], r[3]) for r in rows if r[0] == s], 20)}
    assert {(r.scene_id, r.pid) for r in voxels.select_queries(points, "adaptive_emb", 20).collect()} == wanted


def test_samplers(spark):
    points, rows = cloud(spark, 300, 2)
    assert voxels.sample_points(points, 50, 3).groupBy("scene_id").count().filter("count <> 50").isEmpty()
    assert sorted(map(tuple, voxels.sample_points(points, 50, 3).collect())) == sorted(map(tuple, voxels.sample_points(points.repartition(17), 50, 3).collect()))
    assert voxels.sample_with_replacement(points, 500, 3).count() == 1000
    assert voxels.voxel_to_budget(points, 20, 0.1).count() <= 20
    assert voxels.voxel_to_budget(points, 300, 0.1).count() == 300


def test_lod(spark):
    points, rows = cloud(spark, 2000, 2)
    samples, nodes = lod.build_lod(points, lod.octree_bounds(points, 100), 3, 50)
    table = nodes.collect()
    assert all(r["count"] <= 50 for r in table)
    assert {r.scene_id: r.total for r in table if r.node == "r"} == {0: 1000, 1: 1000}
    names = {(r.scene_id, r.node) for r in table}
    assert all((r.scene_id, f"{r.node}{c}") in names for r in table for c in r.children)
    held = {(r.scene_id, r.node): r.n for r in samples.groupBy("scene_id", "node").agg(F.count("*").alias("n")).collect()}
    assert held == {(r.scene_id, r.node): r["count"] for r in table}


def test_binary_nodes(spark, tmp_path):
    points, rows = cloud(spark, 2000, 2)
    bounds = lod.octree_bounds(points, 100)
    samples, nodes = lod.build_lod(points, bounds, 3, 50)
    made = lod.write_lod_binary(samples, nodes, points, bounds, str(tmp_path / "a"), 1_000).collect()
    assert len(made) > 20 and all(0 < r.n_bytes < 1_000 + 50 * 16 for r in made)
    kept = {f.name: f.stat().st_size for f in (tmp_path / "a" / "tiles").iterdir() if not f.name.endswith(".crc")}
    assert kept == {f"{r.scene}-{r.file:05d}.bin": r.n_bytes for r in made}
    place = {r[0]: r for r in rows}
    order = {r.pid: (r.order, r.pid) for r in points.select("pid", hash_order(F.col("pid")).alias("order")).collect()}
    wanted = {}
    for r in samples.collect():
        wanted.setdefault((r.scene_id, r.node), []).append(r.pid)
    for table in (spark.read.parquet(str(tmp_path / "a" / "nodes")).collect(),):
        laid = sorted((r.scene_id, r.node, r.file, r.start, r.n_bytes) for r in table)
        for (s, _, file, start, n), (t, _, file2, start2, _) in itertools.pairwise(laid):
            assert s != t or (file2, start2) in ((file, start + n), (file + 1, 0)) or (file2 > file and start2 == 0)
    found = {}
    for r in lod.read_lod_binary(spark, str(tmp_path / "a")).orderBy("place").collect():
        found.setdefault((r.scene_id, r.node), []).append((r.x, r.y, r.z, r.flag))
    as_float = lambda p: tuple(float(np.float32(v)) for v in place[p][2:5])
    flag = lambda p: 255 if place[p][8] >= 0 else 128 if place[p][7] == 0 else 0
    assert found == {k: [(*as_float(p), flag(p)) for p in sorted(v, key=order.get)] for k, v in wanted.items()}
    one = lod.read_lod_binary(spark, str(tmp_path / "a"), spark.createDataFrame([(1, "r")], "scene_id int, node string"))
    assert one.count() == 50 and {(r.scene_id, r.node) for r in one.collect()} == {(1, "r")}
    with pytest.raises(ValueError, match="no point"):
        lod.write_lod_binary(samples, nodes, points.filter("pid % 2 = 0"), bounds, str(tmp_path / "b"))
    assert not (tmp_path / "b" / "nodes").exists()
    none = points.filter("false")
    samples, nodes = lod.build_lod(none, lod.octree_bounds(none), 3, 50)
    assert lod.write_lod_binary(samples, nodes, none, lod.octree_bounds(none), str(tmp_path / "c")).isEmpty()
    assert lod.read_lod_binary(spark, str(tmp_path / "c")).isEmpty()


def test_patches_by_occupied_cells(spark):
    points, rows = cloud(spark, 1500, 3)
    share = 38 / (31 * 31 * 62)
    found = voxels.sample_patches(points, 3.0, 64, 5, least_points=None, annotated=0.0, occupied=share, enlarge=0.25, features=True).collect()
    order = {r.pid: (r.order, r.pid) for r in points.select("pid", hash_order(F.col("pid"), 5).alias("order")).collect()}
    late = 0
    for s in range(3):
        own = [r for r in rows if r[1] == s]
        high = [max(r[k] for r in own) for k in (2, 3, 4)]
        low = min(r[4] for r in own)
        centre = None
        for k, c in enumerate(sorted(own, key=lambda r: order[r[0]])[:10]):
            cells = set()
            for r in own:
                if abs(r[2] - c[2]) <= 1.51 and abs(r[3] - c[3]) <= 1.51:
                    v = [np.ceil((r[2] - (c[2] - 1.5)) / 3.0 * 31.0), np.ceil((r[3] - (c[3] - 1.5)) / 3.0 * 31.0), np.ceil((r[4] - low) / (high[2] - low) * 62.0)]
                    cells.add((v[0] * 31 + v[1]) * 62 + v[2])
            if len(cells) / (31 * 31 * 62) >= share:
                centre, late = c, late + (k > 0)
                break
        mine = [r for r in found if r.scene_id == s]
        if centre is None:
            assert not mine
            continue
        column = {r[0]: r for r in own if abs(r[2] - centre[2]) <= 1.75 and abs(r[3] - centre[3]) <= 1.75}
        assert sorted(r.draw for r in mine) == list(range(64))
        assert {r.pid for r in mine} <= set(column) and len({r.pid for r in mine}) == min(64, len(column))
        assert all(abs(r.nx - column[r.pid][2] / high[0]) < 1e-12 and abs(r.nz - column[r.pid][4] / high[2]) < 1e-12 and abs(r.x - (column[r.pid][2] - centre[2])) < 1e-12 for r in mine)
    assert found
    flat = points.withColumn("z", F.lit(0.0))
    one = voxels.sample_patches(flat, 3.0, 16, 5, least_points=None, annotated=0.0, occupied=1e-5, features=True)
    assert one.count() == 48 and one.filter("nz <> 0").isEmpty()
    assert voxels.sample_patches(points.filter("false"), 3.0, 16, least_points=None).isEmpty()


def test_lod_of_scenes_with_depths_of_their_own(spark):
    points, rows = cloud(spark, 3000, 2)
    points = points.filter("scene_id = 0 OR pid % 20 = 1")
    bounds = lod.octree_bounds(points, 100, 4)
    depth = {r.scene_id: r.depth for r in bounds.collect()}
    assert len(set(depth.values())) == 2
    samples, nodes = lod.build_lod(points, bounds, None, 30)
    keyed = lod.octree_keys(points, bounds, 4).select("scene_id", "pid", lod.key_name(F.col("oct_key"), 4).alias("leaf"), hash_order(F.col("pid")).alias("order")).collect()
    under = {}
    for r in keyed:
        for d in range(depth[r.scene_id] + 1):
            under.setdefault((r.scene_id, r.leaf[: d + 1]), []).append((r.order, r.pid))
    wanted = {(s, node, pid) for (s, node), own in under.items() for _, pid in sorted(own)[:30]}
    assert {(r.scene_id, r.node, r.pid) for r in samples.collect()} == wanted
    assert {(r.scene_id, r.node): r.total for r in nodes.collect()} == {k: len(v) for k, v in under.items()}


def test_places_in_buckets(spark):
    points, _ = cloud(spark, 6000, 2)
    order = [F.col("hash"), F.col("pid")]
    plain = points.withColumn("hash", hash_order(F.col("pid"), 3)).withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)) - 1)
    wanted = {(r.scene_id, r.pid): r.place for r in plain.collect()}
    assert {(r.scene_id, r.pid): r.place for r in voxels.shuffle_points(points, 3).collect()} == wanted
    for n in (10, 1500, 9000):  # within Spark's own rank limit, beyond it, and all
        assert {(r.scene_id, r.pid) for r in voxels.sample_points(points, n, 3).collect()} == {k for k, at in wanted.items() if at < n}
    assert voxels.sample_points(points, 1500, 3, 8.0).groupBy("scene_id").count().filter("count <> 1500").isEmpty()


def test_scene_arrays_in_several_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "BLOCK_RECORDS", 100)
    points, rows = cloud(spark, 1000, 2)
    named = points.select(F.concat(F.lit("s"), "scene_id").alias("name"), "pid", "x", "y", "z", F.col("pid").alias("instance"), F.col("pid").alias("semantic"))
    scenes = files.write_scene_bins(named, f"file://{tmp_path}")
    back = files.read_scene_bins(spark, f"file://{tmp_path}", scenes).orderBy("name", "row").collect()
    wanted = named.orderBy("name", "pid").collect()
    assert [(r.name, r.instance, r.semantic) for r in back] == [(r.name, r.pid, r.pid) for r in wanted]
    assert [r.x for r in back] == pytest.approx([r.x for r in wanted], rel=1e-6)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(f"s{s}_{k}.bin" for s in (0, 1) for k in files.ARRAYS)


def test_ascii_points_of_a_file_in_several_blocks(spark, tmp_path):
    rows = [(k, k * 7 % 1000) for k in range(2000)]
    text = f"ply\nformat ascii 1.0\nelement vertex {len(rows)}\nproperty float x\nproperty float y\nproperty float z\nproperty int c\nend_header\n" + "".join(f"{a} 0 0 {b}\n" for a, b in rows)
    (tmp_path / "a.ply").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back = files.read_ply(spark, f"file://{tmp_path}/a.ply").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.row, r.x, r.c) for r in back] == [(k, float(a), b) for k, (a, b) in enumerate(rows)]


@pytest.mark.parametrize(("budget", "grid"), [(300, 100), (1, 100)])
def test_voxel_budget_by_exact_bisection(spark, budget, grid):
    points, rows = cloud(spark, 1500, 2, grid=grid)
    cells = lambda size: {(r[1], *(int(v // size) for v in r[2:5])) for r in rows}
    low, high, best = 0.05, 5.0, None
    for _ in range(15):
        middle = (low + high) / 2
        low, high, best = (low, middle, middle) if len(cells(middle)) <= budget else (middle, high, best)
    found = voxels.voxel_to_budget(points, budget, 0.05)
    wanted = len(rows) if budget >= len(rows) else budget if best is None else len(cells(best))
    assert found.count() == wanted


def test_requests_hold_fields_notes_and_tasks(spark):
    tree = spark.createDataFrame([(0, 1, *[2.0] * 11)], "scene_id int, tree_id int, " + ", ".join(f"{f} double" for f in text.TREE_FIELDS if f != "tree_id"))
    asked = text.Instructions("A role.", "Numbers:", {"height_m": "from the ground"}, ("first", "second"), 40)
    made = text.tree_prompts(tree, instructions=asked).first()
    assert all(f'"{f}"' in made.user for f in text.TREE_FIELDS) and made.system == f"A role. {text.LANGUAGE['en']}"
    assert made.user.startswith("Numbers:\n{") and made.user.endswith("}\n\n- height_m: from the ground\n\n1. first\n2. second\n\nAt most 40 words.")
    assert text.tree_prompts(tree).first().user.endswith("}")


def test_leftover_query_has_every_point_and_the_classes_that_stay(spark):
    """The round before overrides where it has a class; points without one keep their own, and both parts are there."""
    given = {x.pid: x for x in points(spark, SF).collect()}
    found = QUERIES["p18_split_leftover"](spark, SF).collect()
    assert sorted(x.pid for x in found) == sorted(given)
    kept = 0
    for x in found:
        p, turn = given[x.pid], x.pid // 3
        sem = p.sem_pred if turn % 6 == 3 else turn % 3
        left = sem != 0 and p.inst_pred == -1
        assert (x.leftover, x.sem_pred, x.semantic_seg, x.tree_id) == (left, sem, *((p.sem_gt + 1, p.inst_gt) if left else (None, None)))
        kept += turn % 6 == 3 and sem != turn % 3
    assert kept and {x.leftover for x in found} == {True, False}


def test_leftover_loses_no_point_without_a_class(spark):
    given = spark.createDataFrame([(0, None, -1, 1, 2), (1, None, -1, 1, 2), (2, 1, None, 1, 2), (3, 0, 5, 1, 2)], "pid long, sem_pred int, inst_pred int, sem_gt int, inst_gt int")
    again, others = frames.split_leftover(given, spark.createDataFrame([(1, 2), (3, None)], "pid long, semantic_pred int"))
    assert [x.pid for x in again.collect()] == [1] and sorted(x.pid for x in others.collect()) == [0, 2, 3]


def test_scene_prompts_query_has_trees_of_all_scenes_and_scenes_without(spark):
    trees = {x.scene_id: x.n for x in metrics.tree_metrics(points(spark, SF)).groupBy("scene_id").agg(F.count("*").alias("n")).collect()}
    found = {x.scene_id: x.n_trees for x in QUERIES["f2_scene_prompts"](spark, SF).collect()}
    assert set(trees) == set(range(8)) and {s: n for s, n in found.items() if n} == trees
    assert {s for s, n in found.items() if n == 0} == set(range(8, 25))


def test_average_precision_on_plain_cases(spark):
    truth = spark.createDataFrame([(0, p, 0, 1 if p < 200 else 2) for p in range(400)], "scene_id int, pid long, label int, gt_id int")
    table = spark.createDataFrame([(0, 1, 0, 0.9), (0, 2, 0, 0.8)], "scene_id int, mask_id int, label int, score double")
    same = spark.createDataFrame([(0, 1 if p < 200 else 2, p) for p in range(400)], "scene_id int, mask_id int, pid long")
    row = metrics.summarize_ap(metrics.average_precision(table, same, truth)).collect()[0]
    assert (row.ap, row.ap50, row.ap25) == (1.0, 1.0, 1.0)
    off = spark.createDataFrame([(0, 1, p) for p in range(200)] + [(0, 2, p) for p in range(100, 300)], "scene_id int, mask_id int, pid long")
    row = metrics.summarize_ap(metrics.average_precision(table, off, truth)).collect()[0]
    assert row.ap50 == pytest.approx(0.5) and row.recall50 == pytest.approx(0.5)
    none = metrics.summarize_ap(metrics.average_precision(table.limit(0), same.limit(0), truth)).collect()[0]
    assert none.ap == 0.0


def test_a_prediction_is_used_once(spark):
    truth = spark.createDataFrame([(0, p, 0, 1 + p // 150) for p in range(300)], "scene_id int, pid long, label int, gt_id int")
    one = spark.createDataFrame([(0, 1, 0, 0.9)], "scene_id int, mask_id int, label int, score double")
    over = spark.createDataFrame([(0, 1, p) for p in range(300)], "scene_id int, mask_id int, pid long")
    found = {r.threshold: r for r in metrics.average_precision(one, over, truth).collect()}
    assert (found[0.25].recall, found[0.25].precision) == (0.5, 1.0) and found[0.55].recall == 0.0


def test_matching_by_hand(spark):
    """Random masks over a few truths, against a restatement with sets."""
    r = random.Random(8)
    for _ in range(3):
        truth = [(0, p, 0, r.choice([0, *[1 + p // 60] * 6])) for p in range(300)]
        masks_of = {m: {p for p in range(300) if p // 60 in (m % 5, (m + r.randrange(2)) % 5) and r.random() < 0.8} for m in range(1, 9)}
        scores = {m: r.randrange(10) / 10 for m in masks_of}
        gts = {g: {p for _, p, _, k in truth if k == g} for g in range(1, 6)}
        for threshold in (0.25, 0.5):
            used, hits, wrong, met = set(), [], [], set()
            for g, own in gts.items():
                near = [m for m, pts in masks_of.items() if len(pts & own) / len(pts | own) > threshold]
                met.update(near)
                best = None
                for m in near:
                    if m in used:
                        continue
                    if best is None:
                        best = scores[m]
                        used.add(m)
                    else:
                        wrong.append(min(best, scores[m]))
                        best = max(best, scores[m])
                hits += [best] if best is not None else []
            void = {p for _, p, _, k in truth if k == 0}
            wrong += [scores[m] for m, pts in masks_of.items() if m not in met and len(pts & void) / len(pts) <= threshold]
            cuts = sorted(set(hits + wrong))
            precision = [sum(h >= c for h in hits) / sum(x >= c for x in hits + wrong) for c in cuts] + [1.0]
            recall = [sum(h >= c for h in hits) / len(gts) for c in cuts] + [0.0]
            steps = [recall[0], *recall, 0.0]
            wanted = sum(p * (steps[k] - steps[k + 2]) / 2 for k, p in enumerate(precision))
            table = spark.createDataFrame([(0, m, 0, s) for m, s in scores.items()], "scene_id int, mask_id int, label int, score double")
            over = spark.createDataFrame([(0, m, p) for m, pts in masks_of.items() for p in pts], "scene_id int, mask_id int, pid long")
            got = metrics.average_precision(table, over, spark.createDataFrame(truth, "scene_id int, pid long, label int, gt_id int"), min_region=10)
            assert got.filter(F.col("threshold") == threshold).first().ap == pytest.approx(wanted)


def test_voxel_hashes_have_64_bits(spark):
    rows = [(k - 300, 7 * k - 900, k * k) for k in range(600)]
    found = spark.createDataFrame(rows, "x long, y long, z long").select("x", "y", "z", keys.fnv(F.col("x"), F.col("y"), F.col("z")).alias("h")).collect()
    for r in found:
        h = 2166136261
        for v in (r.x, r.y, r.z):
            h = (h ^ (v & (2**64 - 1))) * 16777619 & (2**64 - 1)
        assert r.h & (2**64 - 1) == h
    assert len({r.h for r in found}) == 600 and len({r.h >> 32 for r in found}) > 500


def test_the_predictor_runs_once_a_tile(spark, tmp_path):
    points, _ = cloud(spark, 200)

    def noted(xyz):
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        return np.zeros(len(xyz)), np.zeros(len(xyz)), np.zeros(len(xyz))

    good, bad = predict.segment(points.withColumn("tile_id", F.col("pid") % 3), noted)
    assert good.count() == 200 and bad.count() == 0 and len(list(tmp_path.iterdir())) == points.select("scene_id", F.col("pid") % 3).distinct().count()


def test_mahalanobis_diagonal_and_full(spark):
    r = np.random.default_rng(0)
    rows = [(0, i, i % 2, [float(v) for v in r.normal(size=3)]) for i in range(40)] + [(0, 99, 5, [1.0, 2.0, 3.0])]
    emb = spark.createDataFrame(rows, "scene_id int, pid long, instance int, embedding array<double>")
    for full in (False, True):
        got = {x.pid: x.score for x in labels.embedding_distance(emb, 3, "mahalanobis", full).collect()}
        assert got[99] == 1.0
        for k in (0, 1):
            own = np.array([v for _, _, i, v in rows if i == k])
            inv = np.linalg.inv(np.cov(own.T) + 1e-6 * np.eye(3))
            gap = own - own.mean(axis=0)
            square = np.einsum("ni,ij,nj->n", gap, inv if full else np.diag(np.diag(inv)), gap)
            s = np.exp(-square)
            wanted = (s - s.min()) / (s.max() - s.min())
            assert [got[p] for _, p, i, _ in rows if i == k] == pytest.approx(wanted.tolist(), abs=1e-6)


def test_empty_and_ground_only_scenes(spark):
    points, _ = cloud(spark, 30, 1)
    ground = points.withColumns({"sem_pred": F.lit(0), "inst_pred": F.lit(-1)})
    assert metrics.tree_metrics(ground).isEmpty()
    assert metrics.scene_stats(ground).collect()[0].n_trees == 0
    none = points.limit(0)
    assert tiles.assign_tiles(none, 10, 1).isEmpty()
    assert voxels.voxel_mean(none, 1.0).isEmpty()
    assert lod.octree_bounds(none).isEmpty()
    assert metrics.eval_instances(none).isEmpty()
    assert frames.elastic_distort(none, 1.0, 1.0).isEmpty()


def test_points_on_edges_and_negative_places(spark):
    points = spark.createDataFrame([(0, 0, -5.0, -5.0, -1.0), (1, 0, 0.0, 0.0, 0.0), (2, 0, 5.0, 5.0, 1.0)], "pid long, scene_id int, x double, y double, z double")
    got = {(r.pid, r.tile_id) for r in tiles.assign_tiles(points, 5.0, 0.0, 1).collect()}
    assert {p for p, _ in got} == {0, 1, 2} and len([1 for p, _ in got if p == 1]) == 4  # the middle point is on the corner of four tiles
    assert [tuple(r) for r in voxels.with_voxel(points, 2.0).select("vx", "vz").orderBy("pid").collect()] == [(-3, -1), (0, 0), (2, 0)]


def test_a_failing_tile_does_not_stop_the_others(spark):
    points, _ = cloud(spark, 40, 1)
    tiled = points.withColumn("tile_id", (F.col("pid") % 2).cast("int"))

    def predictor(xyz):
        if len(xyz) and xyz[0, 0] == first:
            raise RuntimeError("no")
        n = len(xyz)
        return np.zeros(n), np.zeros(n), np.ones(n)

    first = points.filter("pid = 0").first().x
    found, failed = predict.segment(tiled, predictor)
    assert {r.tile_id for r in failed.collect()} == {0} and {r.tile_id for r in found.collect()} == {1}


def test_elastic_noise_is_smooth_and_reproducible(spark):
    points, _ = cloud(spark, 50, 1)
    a = sorted(map(tuple, frames.elastic_distort(points, 3.0, 0.5, 1).select("pid", F.round("x", 6)).collect()))
    b = sorted(map(tuple, frames.elastic_distort(points.repartition(5), 3.0, 0.5, 1).select("pid", F.round("x", 6)).collect()))
    assert a == b
    moved = frames.elastic_distort(points, 3.0, 0.5, 1).join(points.select("pid", F.col("x").alias("old")), "pid").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
    assert 0 < moved < 1.5


@pytest.mark.parametrize("few", [frames.FEW_CELLS, 0])
def test_elastic_points_are_moved_by_a_row_each(spark, monkeypatch, few):
    """Every point goes through one join at most, the same with a broadcast and without, and ids of other scenes do not mix."""
    monkeypatch.setattr(frames, "FEW_CELLS", few)
    points, _ = cloud(spark, 60, 1)
    one, other = points.withColumn("scene_id", F.lit(0)), points.withColumn("scene_id", F.lit(1)).withColumn("ix", F.lit("own"))
    alone = {(r.pid, round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in frames.elastic_distort(one, 3.0, 0.5, 1).collect()}
    both = frames.elastic_distort(one.withColumn("ix", F.lit("own")).unionByName(other), 3.0, 0.5, 1)
    assert both.columns == other.columns and both.filter("ix = 'own'").count() == 120
    assert {(r.pid, round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in both.filter("scene_id = 0").collect()} == alone
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan and "Aggregate" not in plan
