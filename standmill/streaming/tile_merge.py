"""Tiles merged as they come: an idempotent upsert into scene-partitioned Parquet, with a ledger of batches.

The winner of a point is a maximum over score and tile, so batches may cut and order the tiles as they like. After each
batch the scenes it touched have a new version of their winners and of their tiles' largest instance ids; the ledger, a small
table with a row for each scene, says which version counts, and is written last. A batch that is in the ledger is not done
again, and one that broke off is done over, onto the same folders. A scene of which all expected rows are in is finished: its
instance ids get their tiles' offsets, its rows move to the results, and its versions are deleted. What is kept between
batches is the winners of open scenes, on disk.

Defined results: rows of a finished scene that come again are ignored; a scene whose number of rows is not known stays open,
and its result is made when it is asked for; rows without a scene or a pid are ignored; no rows give no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from standmill.operators.tiles import running_offsets

_WON = ["tile_id", "semantic_pred", "instance_pred", "score"]


class TileMerge:
    """The store of a merge below ``path``, for points (by, pid) and expected (by, n_rows: the predictions that a scene will have)."""

    def __init__(self, spark: SparkSession, path: str, points: DataFrame, expected: DataFrame | None = None, by: str = "scene_id"):
        self.spark, self.path, self.by, self.points = spark, path, by, points.select(by, "pid")
        kind = points.schema[by].dataType.simpleString()
        self.kind = kind
        self.expected = expected.select(by, F.col("n_rows").cast("long").alias("expected")) if expected is not None else spark.createDataFrame([], f"{by} {kind}, expected long")
        self.won = f"{by} {kind}, pid long, tile_id int, semantic_pred int, instance_pred int, score double"
        self.tile = f"{by} {kind}, tile_id int, max_instance int"
        self.head = f"{by} {kind}, version long, n_rows long, finished boolean"
        self.final = f"{by} {kind}, pid long, sem_pred int, inst_pred long, score double"

    # files

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, name: str) -> None:
        fs, path = self._folder(name)
        fs.delete(path, True)

    def _numbers(self, name: str) -> list[int]:
        """The finished writes below a folder."""
        fs, path = self._folder(name)
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in found if n.isdigit() and fs.exists(self._folder(f"{name}/{n}/_SUCCESS")[1]))

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    # the ledger

    def committed(self) -> int:
        """The last batch that counts, or -1."""
        return max(self._numbers("ledger"), default=-1)

    def heads(self) -> DataFrame:
        last = self.committed()
        return self._read([f"ledger/{last}"] if last >= 0 else [], self.head)

    def _current(self, name: str, schema: str, heads: DataFrame) -> DataFrame:
        """Rows of the versions that count, of these scenes."""
        rows = self._read([f"{name}/{n}" for n in self._numbers(name)], schema).withColumn("version", F.regexp_extract(F.input_file_name(), rf"/{name}/(\d+)/", 1).cast("long"))
        return rows.join(heads.select(self.by, "version"), [self.by, "version"], "left_semi").drop("version")

    # batches

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Takes in one batch of predictions: by, pid, tile_id, semantic_pred, instance_pred, score."""
        if number <= self.committed():
            return
        by = self.by
        heads = self.heads()
        closed = heads.filter("finished").select(by)
        fresh = batch.filter(F.col(by).isNotNull() & F.col("pid").isNotNull()).join(closed, by, "left_anti").select(by, "pid", *[F.col(c).cast(t) for c, t in zip(_WON, ("int", "int", "int", "double"))])
        came = fresh.groupBy(by).agg(F.count("*").alias("came"))
        came.write.mode("overwrite").parquet(f"{self.path}/came/{number}")
        came = self._read([f"came/{number}"], f"{by} {self.kind}, came long")
        touched = heads.join(came, by, "left_semi")
        best = F.max_by(F.struct(*_WON), F.struct(F.col("score"), -F.col("tile_id"))).alias("w")
        won = self._current("winners", self.won, touched).unionByName(fresh.filter("score > -1")).groupBy(by, "pid").agg(best)
        won.select(by, "pid", "w.*").write.mode("overwrite").parquet(f"{self.path}/winners/{number}")
        most = fresh.groupBy(by, "tile_id").agg(F.max("instance_pred").alias("max_instance"))
        tiles = self._current("tiles", self.tile, touched).unionByName(most).groupBy(by, "tile_id").agg(F.max("max_instance").alias("max_instance"))
        tiles.write.mode("overwrite").parquet(f"{self.path}/tiles/{number}")
        n = F.coalesce("n_rows", F.lit(0)) + F.coalesce("came", F.lit(0))
        new = heads.join(came, by, "full").join(self.expected, by, "left").select(
            by, F.when(F.col("came").isNotNull(), F.lit(number)).otherwise(F.col("version")).cast("long").alias("version"), n.alias("n_rows"),
            (F.coalesce("finished", F.lit(False)) | F.coalesce(n >= F.col("expected"), F.lit(False))).alias("finished"),
        )
        new.write.mode("overwrite").parquet(f"{self.path}/next/{number}")
        new = self._read([f"next/{number}"], self.head)
        ready = new.filter(F.col("finished") & (F.col("version") == number))
        self._merged(ready, [number]).write.mode("overwrite").parquet(f"{self.path}/final/{number}")
        new.write.mode("overwrite").parquet(f"{self.path}/ledger/{number}")  # from here on the batch counts
        self._clear(number)

    def _clear(self, number: int) -> None:
        """Deletes what no reader of the ledger's last two entries needs."""
        used = self.heads().filter("NOT finished").select("version").distinct().collect()  # a row for each batch that is still the last of some scene
        used = {r.version for r in used}
        for name in ("winners", "tiles"):
            for n in self._numbers(name):
                if n not in used:
                    self._delete(f"{name}/{n}")
        for n in self._numbers("ledger")[:-2]:
            self._delete(f"ledger/{n}")
        for name in ("came", "next"):
            self._delete(f"{name}/{number}")

    def _merged(self, scenes: DataFrame, versions: list[int] | None = None) -> DataFrame:
        """The final rows of these scenes: every point of theirs, with its winner's prediction or -1."""
        by = self.by
        pick = lambda name, schema: self._read([f"{name}/{n}" for n in versions], schema).join(scenes.select(by), by, "left_semi") if versions else self._current(name, schema, scenes)
        offsets = running_offsets(pick("tiles", self.tile), by).select(by, "tile_id", "id_offset")
        won = pick("winners", self.won).join(offsets, [by, "tile_id"])
        instance = F.when(F.col("instance_pred") >= 0, F.col("instance_pred") + F.col("id_offset")).otherwise(-1)
        won = won.select(by, "pid", F.col("semantic_pred").alias("sem_pred"), instance.cast("long").alias("inst_pred"), "score")
        rows = self.points.join(scenes.select(by), by, "left_semi").join(won, [by, "pid"], "left")
        return rows.select(by, "pid", *[F.coalesce(F.col(c), F.lit(-1)).cast(t).alias(c) for c, t in (("sem_pred", "int"), ("inst_pred", "long"), ("score", "double"))])

    # results

    def finished(self) -> DataFrame:
        """by, pid, sem_pred, inst_pred and score of the points of finished scenes."""
        last = self.committed()
        return self._read([f"final/{n}" for n in self._numbers("final") if n <= last], self.final)

    def result(self) -> DataFrame:
        """The same of all points of all scenes: open ones as far as their tiles are in, and those without any as -1."""
        done = self.heads().filter("finished").select(self.by)
        others = self.points.select(self.by).distinct().join(done, self.by, "left_anti")
        scenes = others.join(self.heads().select(self.by, "version"), self.by, "left")
        return self.finished().unionByName(self._merged(scenes))

    def winners(self) -> DataFrame:
        """The winning predictions of open scenes so far, with the tiles' own instance ids."""
        return self._current("winners", self.won, self.heads().filter("NOT finished"))


def merge_tiles_streaming(preds: DataFrame, store: TileMerge, checkpoint: str) -> StreamingQuery:
    """Takes a stream of predictions into a store, as far as it goes now."""
    return preds.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.upsert).trigger(availableNow=True).start()
