"""Level-of-detail octrees."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standmill.functions.keys import hash_order
from standmill.operators.places import lowest_hashes
from standmill.sources.files import _open
from standmill.sources.storage import written

#: A point among a node's bytes, 16 of them.
RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("flag", "u1")])
FILE_BYTES = 64 << 20
#: Nodes are added up within those that share so many first characters of their names.
PREFIX = 5


def octree_bounds(points: DataFrame, budget: int = 50_000, max_depth: int = 8, by: str = "scene_id") -> DataFrame:
    """Each scene's cube (a little larger than its extent), and the first depth whose mean leaf is below the budget."""
    ends = points.groupBy(by).agg(F.count("*").alias("n_points"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    span = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"])
    depth = F.lit(max_depth)
    for d in range(max_depth, 0, -1):
        depth = F.when(F.col("n_points") / F.lit(float(8**d)) < budget, d).otherwise(depth)
    low = [((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 - F.col("span") / 2 - F.col("span") * F.lit(0.001)).alias(f"min_{a}") for a in "xyz"]
    return ends.withColumn("span", span).select(by, "n_points", *low, (F.col("span") * F.lit(1.002)).alias("size"), depth.alias("depth"))


def _digits(depth: int) -> Column:
    """The key of a point at a depth as one number, three bits a level, from its cell indices kx, ky, kz."""
    key = F.lit(0).cast("long")
    for level in range(depth):
        shift = depth - 1 - level
        bit = lambda a: F.shiftright(F.col(f"k{a}"), shift).bitwiseAND(F.lit(1).cast("long"))  # noqa: B023, E731
        key = key * 8 + bit("x") + 2 * bit("y") + 4 * bit("z")
    return key


def octree_keys(points: DataFrame, bounds: DataFrame, depth: int, by: str = "scene_id") -> DataFrame:
    """points with oct_key at a depth: x, y and z choose bits 0, 1 and 2 of each level's digit."""
    placed = points.join(bounds.select(by, "min_x", "min_y", "min_z", "size"), by)
    cell = lambda a: F.floor(F.least(F.greatest((F.col(a) - F.col(f"min_{a}")) / F.col("size"), F.lit(0.0)), F.lit(0.999999)) * F.lit(float(1 << depth))).cast("long")
    return placed.withColumns({f"k{a}": cell(a) for a in "xyz"}).withColumn("oct_key", _digits(depth)).drop("kx", "ky", "kz", "min_x", "min_y", "min_z", "size")


def key_name(key: Column, depth: int) -> Column:
    """'r' and the digits of a key."""
    digits = [F.shiftright(key, 3 * (depth - 1 - level)).bitwiseAND(F.lit(7).cast("long")).cast("string") for level in range(depth)]
    return F.concat(F.lit("r"), *digits)


def build_lod(points: DataFrame, bounds: DataFrame, depth: int | None, budget: int, seed: int = 0, by: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Sampled points of every node (by, node, pid) and the nodes (by, node, count, total, children).

    Leaves lie at the given depth, or without one at each scene's own depth in bounds. A leaf keeps the points that hash
    lowest, at most the budget; its parent those of its children's samples, and so on: since the order is one hash, each
    level follows from the level below. total counts all points below a node. Keys and levels are written, so the points
    are read once, however deep the tree is."""
    own = bounds.select(by, F.lit(depth).cast("int").alias("depth") if depth is not None else F.col("depth").cast("int").alias("depth"))
    depths = [depth] if depth is not None else [r.depth for r in own.select("depth").distinct().collect()]  # at most max_depth numbers
    deepest = max(depths, default=0)
    keyed = octree_keys(points, bounds, deepest, by).select(by, "pid", "oct_key").join(own, by)
    keyed = written(keyed.withColumn("oct_key", F.expr(f"shiftright(oct_key, 3 * ({deepest} - depth))")))
    samples, nodes, level, sums = None, None, None, None
    parent = F.shiftright("oct_key", 3)
    for d in range(deepest, -1, -1):
        if level is not None:
            level = level.withColumn("oct_key", parent)
            digit = F.col("oct_key").bitwiseAND(F.lit(7).cast("long"))
            sums = sums.groupBy(by, parent.alias("up")).agg(F.sum("total").alias("total"), F.sort_array(F.collect_set(digit)).alias("children")).withColumnRenamed("up", "oct_key")
        if d in depths:
            leaves = keyed.filter(F.col("depth") == d).select(by, "pid", "oct_key")
            counts = leaves.groupBy(by, "oct_key").agg(F.count("*").alias("total")).withColumn("children", F.array().cast("array<bigint>"))
            level, sums = (leaves, counts) if level is None else (level.unionByName(leaves), sums.unionByName(counts))
        level, sums = written(lowest_hashes(level, [by, "oct_key"], budget, seed)), written(sums)
        name = key_name(F.col("oct_key"), d).alias("node")
        named = level.select(by, name, "pid")
        found = level.groupBy(by, "oct_key").agg(F.count("*").alias("count")).join(sums, [by, "oct_key"]).select(by, name, "count", "total", "children")
        samples = named if samples is None else samples.unionByName(named)
        nodes = found if nodes is None else nodes.unionByName(found)
    return samples, nodes


def _coloured(points: DataFrame, by: str) -> DataFrame:
    from standmill.operators.frames import color_instances, palette_rgb

    return color_instances(points).select(by, "pid", *[F.col(a).cast("float") for a in "xyz"], palette_rgb(F.col("colour")).alias("rgb"), F.col("flag").cast("smallint").alias("flag"))


def write_lod(samples: DataFrame, nodes: DataFrame, points: DataFrame, path: str, by: str = "scene_id") -> None:
    """Node points (place, colour, flag) as Parquet in a folder for each scene and node, and the node table beside them."""
    samples.join(_coloured(points, by), [by, "pid"]).repartition(by, "node").write.partitionBy(by, "node").parquet(f"{path}/points")
    nodes.write.parquet(f"{path}/nodes")


def node_ranges(nodes: DataFrame, file_bytes: int = FILE_BYTES, by: str = "scene_id") -> DataFrame:
    """nodes with where their bytes lie: file (from 0 in each scene), start and n_bytes.

    Nodes follow each other by name, each before what is below it. A file takes the nodes that begin within its range of
    file_bytes, so it is larger than that by less than one node. Counts are added up by the beginnings of names first."""
    group, size = F.substring("node", 1, PREFIX), F.lit(RECORD.itemsize)
    earlier = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy(by, group.alias("_group")).agg(F.sum("count").alias("_n"))
    sums = sums.select(by, "_group", F.coalesce(F.sum("_n").over(earlier("_group", by)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("count").over(earlier("node", by, "_group")), F.lit(0))
    laid = nodes.withColumn("_group", group).join(sums, [by, "_group"]).withColumn("start", (F.col("_before") + inside) * size)
    laid = laid.withColumn("file", F.floor(F.col("start") / F.lit(file_bytes)).cast("long"))
    first = F.min("start").over(Window.partitionBy(by, "file"))
    return laid.withColumns({"start": F.col("start") - first, "n_bytes": F.col("count") * size}).drop("_before", "_group")


def _tile(path: str, scene: str, file: int) -> str:
    return f"{path}/tiles/{quote(scene, safe='')}-{file:05d}.bin"


def write_lod_binary(samples: DataFrame, nodes: DataFrame, points: DataFrame, bounds: DataFrame, path: str, file_bytes: int = FILE_BYTES, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """Writes node points as records of 16 bytes in files of about file_bytes, and as Parquet beside them the nodes with
    their ranges of bytes and the scenes' bounds. Returns the files and their sizes.

    A node's points come in hash order, so any beginning of its bytes is a smaller sample. Tasks write their files batch by
    batch under an attempt's name and move them when they are whole, so repeated tasks leave the same files. The table of
    nodes comes last: where it is, everything is. A sample without its point is an error. Empty tables give no files;
    places that are null become NaN."""
    ranges = written(node_ranges(nodes, file_bytes, by))
    rows = samples.join(_coloured(points, by), [by, "pid"]).join(ranges.select(by, "node", "file", "start"), [by, "node"])
    rows = rows.repartition(by, "file").sortWithinPartitions(by, "file", "start", hash_order(F.col("pid"), seed), "pid")
    rows = rows.select(F.col(by).cast("string").alias("scene"), "file", "x", "y", "z", "rgb.r", "rgb.g", "rgb.b", "flag")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, (system, place) = TaskContext.get(), _open(path)
        system.create_dir(f"{place}/tiles", recursive=True)
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}"
        open_file, out, size = None, None, 0

        def finished() -> pd.DataFrame:
            out.close()
            system.move(f"{_tile(place, *open_file)}.{attempt}", _tile(place, *open_file))
            return pd.DataFrame({"scene": [open_file[0]], "file": [open_file[1]], "n_bytes": [size]})

        for batch in batches:
            for found, part in batch.groupby(["scene", "file"], sort=False):
                if found != open_file:
                    if out is not None:
                        yield finished()
                    open_file, size = found, 0
                    out = system.open_output_stream(f"{_tile(place, *found)}.{attempt}")
                records = np.empty(len(part), RECORD)
                for name in RECORD.names:
                    records[name] = part[name]
                out.write(records.tobytes())
                size += records.nbytes
        if out is not None:
            yield finished()

    made = written(rows.mapInPandas(write, "scene string, file long, n_bytes long"))
    wanted = ranges.groupBy(F.col(by).cast("string").alias("scene"), "file").agg(F.sum("n_bytes").alias("wanted"))
    if not wanted.join(made, ["scene", "file"], "left").filter(~F.col("wanted").eqNullSafe(F.col("n_bytes"))).isEmpty():
        raise ValueError("some samples have no point")
    bounds.write.parquet(f"{path}/scenes")
    ranges.write.parquet(f"{path}/nodes")
    return made


def read_lod_binary(spark: SparkSession, path: str, wanted: DataFrame | None = None, by: str = "scene_id") -> DataFrame:
    """Points (by, node, place, x, y, z, r, g, b, flag) of the wanted nodes (by, node), or of all: only their ranges are read."""
    nodes = spark.read.parquet(f"{path}/nodes")
    if wanted is not None:
        nodes = nodes.join(wanted.select(by, "node"), [by, "node"], "left_semi")
    kind = nodes.schema[by].dataType.simpleString()
    nodes = nodes.select(F.col(by).alias("key"), F.col(by).cast("string").alias("scene"), "node", "file", "start", "n_bytes")
    nodes = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "node")  # a number: small rows, much to read

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = _open(path)
        for batch in batches:
            for key, scene, node, file, start, n_bytes in batch.itertuples(index=False):
                with system.open_input_file(_tile(place, scene, file)) as f:
                    f.seek(start)
                    records = np.frombuffer(f.read(n_bytes), dtype=RECORD)
                yield pd.DataFrame({"key": key, "node": node, "place": np.arange(len(records), dtype=np.int32)} | {c: records[c] for c in RECORD.names})

    return nodes.mapInPandas(read, f"key {kind}, node string, place int, x float, y float, z float, r short, g short, b short, flag short").withColumnRenamed("key", by)
