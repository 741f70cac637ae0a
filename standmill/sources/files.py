"""Point cloud files: PLY (ascii and binary), prepared scenes as raw arrays, split lists, inventories, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standmill.operators.places import placed
from standmill.sources.storage import written

#: Type names of PLY headers, as numpy and Spark types.
TYPES = {
    "char": ("i1", "byte"), "int8": ("i1", "byte"), "uchar": ("u1", "short"), "uint8": ("u1", "short"), "short": ("i2", "short"), "int16": ("i2", "short"),
    "ushort": ("u2", "int"), "uint16": ("u2", "int"), "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "long"), "uint32": ("u4", "long"),
    "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">"}
BLOCK_RECORDS = 1 << 18
HEADER_BYTES = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def _listed(path: str, suffix: str) -> list[str]:
    system, place = _open(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return sorted(scheme + i.path for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))


def ply_header(path: str) -> dict:
    """Format, number of points, properties (name, type) and length of a PLY file's header."""
    system, place = _open(path)
    with system.open_input_file(place) as f:
        start = f.read(HEADER_BYTES)
    end = start.find(b"end_header")
    if not start.startswith(b"ply") or end < 0:
        raise ValueError(f"{path} has no PLY header")
    size = start.index(b"\n", end) + 1
    form, n, element, properties = "", 0, "", []
    for words in (line.split() for line in start[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            n = int(words[2]) if element == "vertex" else n
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] not in TYPES:
                raise ValueError(f"{path}: unknown property type {words[1]}")
            properties.append((words[2], words[1]))
    missing = {"x", "y", "z"} - {name for name, _ in properties}
    if missing:
        raise ValueError(f"{path}: no property {', '.join(sorted(missing))}")
    if form not in (*ORDERS, "ascii"):
        raise ValueError(f"{path}: unknown format {form}")
    return {"path": path, "format": form, "n": n, "properties": properties, "size": size}


def read_ply(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of a PLY file, or of all below a folder, with file and row (place in the file).

    Headers are read on the driver; files that differ in properties raise an error. Binary records are read in blocks
    of a fixed number by the executors; ascii ones as lines. Only the wanted columns are kept."""
    heads = [ply_header(p) for p in _listed(path, ".ply")]
    if not heads:
        raise ValueError(f"no PLY file in {path}")
    first = heads[0]
    if any((h["format"], h["properties"]) != (first["format"], first["properties"]) for h in heads):
        raise ValueError(f"the PLY files in {path} differ in format or properties")
    kept = [(n, t) for n, t in first["properties"] if columns is None or n in columns]
    if first["format"] == "ascii":
        return _read_ascii(spark, heads, kept)
    record = np.dtype([(n, ORDERS[first["format"]] + TYPES[t][0]) for n, t in first["properties"]])
    blocks = spark.createDataFrame([(h["path"], h["size"], h["n"]) for h in heads], "file string, size long, n long")
    blocks = blocks.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(BLOCK_RECORDS).cast("long")))).filter("n > 0")
    blocks = blocks.repartition("file", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, n, start in batch[["file", "size", "n", "start"]].itertuples(index=False):
                system, place = _open(file)
                with system.open_input_file(place) as f:
                    f.seek(size + start * record.itemsize)
                    data = np.frombuffer(f.read(min(BLOCK_RECORDS, n - start) * record.itemsize), dtype=record)
                yield pd.DataFrame({"file": file, "row": np.arange(start, start + len(data))} | {c: data[c].astype(data[c].dtype.newbyteorder("=")) for c, _ in kept})

    return blocks.mapInPandas(read, "file string, row long, " + ", ".join(f"`{n}` {TYPES[t][1]}" for n, t in kept))


def _read_ascii(spark: SparkSession, heads: list[dict], kept: list[tuple[str, str]]) -> DataFrame:
    """Points are the lines behind the header; a line's number is its place in its block and the lines of the blocks before it."""
    names = [n for n, _ in heads[0]["properties"]]
    lines = spark.read.text([h["path"] for h in heads]).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    numbered = placed(lines, ["file"], F.col("block"), [F.col("at")], name="line")
    ends = numbered.filter("value = 'end_header'").groupBy("file").agg(F.min("line").alias("end"))
    counts = spark.createDataFrame([(h["path"].split("://")[-1], h["n"]) for h in heads], "tail string, n long")
    rows = numbered.join(ends, "file").withColumn("tail", F.concat(F.lit("/"), F.regexp_replace("file", "^[a-z0-9]+:/+", ""))).join(F.broadcast(counts), "tail")
    rows = rows.filter((F.col("line") > F.col("end")) & (F.col("line") <= F.col("end") + F.col("n")))
    part = F.split(F.trim("value"), r"\s+")
    return rows.select("file", (F.col("line") - F.col("end") - 1).cast("long").alias("row"), *[F.element_at(part, names.index(n) + 1).cast(TYPES[t][1]).alias(n) for n, t in kept])


#: Properties of a written prediction.
PREDICTION = [("x", "float"), ("y", "float"), ("z", "float"), ("semantic_pred", "int"), ("instance_pred", "int"), ("score", "float")]
TRUTH = [("semantic_gt", "int"), ("instance_gt", "int")]


def write_ply(df: DataFrame, path: str, parts: int = 8) -> DataFrame:
    """Writes predictions (pid, x, y, z, semantic_pred, instance_pred, score[, semantic_gt, instance_gt]) as PLY files.

    Each part holds a range of pids in order, with a header and count of its own. Returns the files and their counts.
    A part is written under its attempt's name and then moved, so that a repeated task leaves one file."""
    properties = PREDICTION + (TRUTH if "semantic_gt" in df.columns else [])
    record = np.dtype([(n, "<" + TYPES[t][0]) for n, t in properties])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        system, place = _open(path)
        system.create_dir(place, recursive=True)
        final, scratch = f"{place}/part-{task.partitionId():05d}.ply", f"{place}/.part-{task.partitionId():05d}-{task.attemptNumber()}"
        count = 0
        with system.open_output_stream(f"{scratch}.body") as body:
            for batch in batches:
                data = np.empty(len(batch), dtype=record)
                for n, _ in properties:
                    data[n] = batch[n]
                body.write(data.tobytes())
                count += len(batch)
        head = "".join([f"ply\nformat binary_little_endian 1.0\nelement vertex {count}\n", *[f"property {t} {n}\n" for n, t in properties], "end_header\n"])
        with system.open_output_stream(scratch) as out, system.open_input_stream(f"{scratch}.body") as body:
            out.write(head.encode())
            while chunk := body.read(1 << 22):
                out.write(chunk)
        system.delete_file(f"{scratch}.body")
        system.move(scratch, final)
        yield pd.DataFrame({"file": [final], "n_points": [count]})

    names = [n for n, _ in properties]
    return df.repartitionByRange(parts, "pid").sortWithinPartitions("pid").select(*names).mapInPandas(write, "file string, n_points long")


#: The three arrays of a scene, with their columns and types.
ARRAYS = {"points": (["x", "y", "z"], "<f4"), "instance_mask": (["instance"], "<i8"), "semantic_mask": (["semantic"], "<i8")}


def write_scene_bins(points: DataFrame, root: str) -> DataFrame:
    """Writes each scene (name, pid, x, y, z, instance, semantic) as three raw arrays; returns the scenes and their counts.

    Blocks of BLOCK_RECORDS points are written as pieces by tasks of their own. A last task for each scene joins its pieces
    through a small buffer, so no task holds a scene; files are written under an attempt's name and then moved."""
    blocks = placed(points, ["name"], F.shiftright(F.col("pid").cast("long"), 16), [F.col("pid")], name="at")
    blocks = blocks.withColumn("block", F.floor(F.col("at") / BLOCK_RECORDS).cast("long")).drop("at")

    def attempt() -> str:
        task = TaskContext.get()
        return f"{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}"

    def pieces(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, place = _open(root)
        system.create_dir(f"{place}/.pieces", recursive=True)
        rows = rows.sort_values("pid", kind="stable")
        for kind, (columns, dtype) in ARRAYS.items():
            final = f"{place}/.pieces/{key[0]}_{kind}-{key[1]}"
            with system.open_output_stream(f"{final}.{attempt()}") as f:
                f.write(np.ascontiguousarray(rows[columns].to_numpy(dtype)).tobytes())
            system.move(f"{final}.{attempt()}", final)
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "n": [len(rows)]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, n_blocks, n_points in batch.itertuples(index=False):
                system, place = _open(root)
                for kind in ARRAYS:
                    final = f"{place}/{name}_{kind}.bin"
                    with system.open_output_stream(f"{final}.{attempt()}") as out:
                        for block in range(n_blocks):
                            with system.open_input_stream(f"{place}/.pieces/{name}_{kind}-{block}") as body:
                                while chunk := body.read(1 << 22):
                                    out.write(chunk)
                    system.move(f"{final}.{attempt()}", final)
                yield pd.DataFrame({"name": [name], "n_points": [n_points]})

    done = written(blocks.groupBy("name", "block").applyInPandas(pieces, "name string, block long, n long"))
    scenes = done.groupBy("name").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_points"))
    made = written(scenes.mapInPandas(joined, "name string, n_points long"))
    system, place = _open(root)
    if system.get_file_info(f"{place}/.pieces").type == fs.FileType.Directory:
        system.delete_dir(f"{place}/.pieces")
    return made


def read_scene_bins(spark: SparkSession, root: str, scenes: DataFrame) -> DataFrame:
    """name, row, x, y, z, instance and semantic of the scenes (name, n_points), read in blocks of records."""
    blocks = scenes.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(BLOCK_RECORDS).cast("long")))).repartition("name", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, total, start in batch[["name", "n_points", "start"]].itertuples(index=False):
                n, found = min(BLOCK_RECORDS, total - start), {}
                system, place = _open(root)
                for kind, size, dtype in (("points", 12, "<f4"), ("instance_mask", 8, "<i8"), ("semantic_mask", 8, "<i8")):
                    with system.open_input_file(f"{place}/{name}_{kind}.bin") as f:
                        f.seek(start * size)
                        found[kind] = np.frombuffer(f.read(n * size), dtype=dtype)
                place3 = found["points"].reshape(-1, 3)
                yield pd.DataFrame({"name": name, "row": np.arange(start, start + n), "x": place3[:, 0], "y": place3[:, 1], "z": place3[:, 2], "instance": found["instance_mask"], "semantic": found["semantic_mask"]})

    return blocks.mapInPandas(read, "name string, row long, x float, y float, z float, instance long, semantic long")


def write_scene_parquet(points: DataFrame, path: str, by: str = "scene_id") -> None:
    """Appends the scenes that are not in the folder yet, a folder for each."""
    spark = points.sparkSession
    system, place = _open(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        points = points.join(spark.read.parquet(path).select(by).distinct(), by, "left_anti")
    points.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The names in a split list, one on a line, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def select_split(df: DataFrame, split: DataFrame) -> DataFrame:
    return df.join(split, "name", "left_semi")


def dataset_inventory(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = ("output", "result")) -> DataFrame:
    """Point cloud files below some folders: path, name, size, modified and type, each once, newest first; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length", "modificationTime")
    return inventory(files.withColumnsRenamed({"length": "size", "modificationTime": "modified"}), exclude)


def inventory(files: DataFrame, exclude: tuple[str, ...] = ("output", "result")) -> DataFrame:
    """The same for a listing (path, size, modified)."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    skipped = F.col("path").rlike("/(" + "|".join(map(re.escape, exclude)) + ")/") if exclude else F.lit(False)
    found = files.withColumn("type", kind).filter(F.col("type").isin("las", "laz", "ply") & ~skipped)
    return found.groupBy("path").agg(F.max("size").alias("size"), F.max("modified").alias("modified"), F.first("type").alias("type")).withColumn("name", F.substring_index("path", "/", -1))


def result_index(datasets: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    """Finished runs: what is there for each task, with the name of the dataset of the same id where the result has none.

    Runs without any file or final state are left out, and so are those still going on."""
    joined = results.join(status.select("task_id", "status"), "task_id", "full_outer").join(datasets.select("task_id", F.col("name").alias("dataset_name")), "task_id", "left")
    has = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_result", "has_viewer")}
    joined = joined.withColumns(has).withColumn("name", F.coalesce("name", "dataset_name"))
    known = F.col("has_result") | F.col("has_viewer") | F.col("status").isin("completed", "failed")
    return joined.filter(known & (F.coalesce("status", F.lit("completed")) != "processing")).select("task_id", "name", "has_result", "has_viewer", F.coalesce("status", F.lit("completed")).alias("status"))


def tree_point_store(points: DataFrame, by: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Assigned points in the order of trees (place as float, class within 0..2), and where each tree begins."""
    store = points.filter("inst_pred >= 0").select(by, F.col("inst_pred").alias("tree_id"), "pid", *[F.col(a).cast("float") for a in "xyz"], F.greatest(F.lit(0), F.least(F.lit(2), F.col("sem_pred"))).alias("class"))
    before = Window.partitionBy(by).orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)
    index = store.groupBy(by, "tree_id").agg(F.count("*").alias("n_points")).withColumn("offset", F.coalesce(F.sum("n_points").over(before), F.lit(0)))
    return store, index


def write_tree_store(points: DataFrame, path: str, by: str = "scene_id") -> None:
    """Writes the store sorted by tree, so that reading one tree touches few row groups."""
    store, index = tree_point_store(points, by)
    store.repartitionByRange(by, "tree_id").sortWithinPartitions(by, "tree_id", "pid").write.parquet(f"{path}/points")
    index.write.parquet(f"{path}/index")


def read_tree(spark: SparkSession, path: str, scene: int, tree: int, by: str = "scene_id") -> DataFrame:
    return spark.read.parquet(f"{path}/points").filter((F.col(by) == scene) & (F.col("tree_id") == tree))


def report_json(stats: DataFrame, trees: DataFrame, by: str = "scene_id") -> DataFrame:
    """One JSON text per scene: its statistics with its trees, tallest first."""
    order = F.struct((-F.col("height_m")).alias("key"), "tree_id", F.struct(*[c for c in trees.columns if c != by]).alias("tree"))
    nested = trees.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(order)), lambda t: t["tree"]).alias("trees"))
    joined = stats.join(nested, by, "left").withColumn("trees", F.coalesce("trees", F.array().cast(nested.schema["trees"].dataType)))
    return joined.select(by, F.to_json(F.struct(*joined.columns)).alias("report"))


def write_report_json(stats: DataFrame, trees: DataFrame, path: str, by: str = "scene_id") -> None:
    report_json(stats, trees, by).select("report").write.text(path)
