"""Approximate nearest neighbours by largest inner product, from balanced posting lists.

Centres are the means of balanced leaves: a bounded sample of the vectors is halved at the median of a two-means direction
until there is a leaf for about LIST_ROWS vectors. Every vector is indexed: it goes to the list of its nearest centre and,
if it lies near a boundary, also to those up to ROWS_RATIO times as far (REPLICAS at most). A query goes to all
lists whose centres are at most QUERY_RATIO times as far as its nearest one, and on to farther ones until AT_LEAST * (k + 1)
vectors are at home there, so that k are always found; there is no cap on their number. Both find their
centres by a search of a graph of the centres, which tasks hold in memory (MAX_LISTS centres at most), and which goes on
until the farthest centre of its beam is outside the ratio. Within the lists all inner products are taken, in double precision.

The largest inner product is turned into a smallest distance for this: vectors get one more component, which makes all of them as
long as the longest, and queries a zero. Distances are squared. A list of more than PART_ROWS rows, or one that more than QUERY_ROWS queries
visit, is dealt to several tasks. Equal vectors are indexed and asked once: only the k + 1 smallest ids among them can be
in a result, so the others need not travel; every one of them is still a query if it was asked.

Defined results: null or zero vectors, those with a null or non-finite component, and rows without an id take no part; vectors are
compared with those of the same length; a row is not its own neighbour, but other rows of its id are; repeated rows are rows of
their own, and ask each for itself; ties go to the smaller id; fewer than k others give fewer rows, and none gives none; an
empty table gives an empty result; other columns are ignored. Recall falls where all distances are alike; the tests measure it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standmill.llm.common import scratch, written

#: Vectors of a list aimed at, lists at most, and vectors that centres are fitted on (about).
LIST_ROWS, MAX_LISTS, SAMPLE = 512, 4096, 32_768
#: How much farther (in squared distance) than its nearest centre those of a vector and of a query may be; copies of a vector at most.
ROWS_RATIO, QUERY_RATIO, REPLICAS = 1.05, 1.3, 8
#: Vectors at home in a query's lists, at least so many times what is looked for.
AT_LEAST = 4
#: Neighbours of a centre in the graph, and random ones besides; centres that a beam expands at once.
NEAR_LINKS, FAR_LINKS, STEP = 24, 8, 4
#: Rows and queries of a list that meet in one task; rows that look for centres together.
PART_ROWS, QUERY_ROWS, TOGETHER = 4096, 1024, 512


def balanced_centres(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Means of so many leaves of equal size (about)."""
    r = np.random.default_rng(seed)
    open_, centres = [(np.arange(len(sample)), lists)], []
    while open_:
        rows, share = open_.pop()
        if share == 1 or len(rows) < 2:
            centres.append(sample[rows].mean(axis=0))
            continue
        some = sample[rows[r.integers(0, len(rows), 256)]]
        pair = some[:2].copy()
        for _ in range(6):
            side = ((some - pair[1]) ** 2).sum(axis=1) < ((some - pair[0]) ** 2).sum(axis=1)
            pair = np.stack([some[m].mean(axis=0) if m.any() else pair[k] for k, m in enumerate((~side, side))])
        left = share // 2
        order = np.argsort(sample[rows] @ (pair[1] - pair[0]), kind="stable")
        cut = len(rows) * left // share
        open_ += [(rows[order[:cut]], left), (rows[order[cut:]], share - left)]
    return np.stack(centres)


class CentreGraph:
    """Centres, and for each the nearest and some random others."""

    def __init__(self, centres: np.ndarray, seed: int = 5):
        self.centres = centres.astype(np.float32)
        self.squares = (self.centres**2).sum(axis=1)
        n, r = len(centres), np.random.default_rng(seed)
        near = []
        for at in range(0, n, 512):
            gap = self.squares - 2 * self.centres[at : at + 512] @ self.centres.T
            gap[np.arange(len(gap)), np.arange(at, at + len(gap))] = np.inf
            near.append(np.argpartition(gap, min(NEAR_LINKS, n) - 1, axis=1)[:, :NEAR_LINKS])
        ring = np.empty(n, dtype=np.int64)
        order = r.permutation(n)
        ring[order] = np.roll(order, 1)  # links every centre with every other one over some steps
        self.links = np.concatenate([np.concatenate(near), ring[:, None], r.integers(0, n, (n, FAR_LINKS - 1))], axis=1)
        self.entries = r.choice(n, min(n, STEP), replace=False)

    def search(self, points: np.ndarray, ratio: float, most: int | None = None, homes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, centre), nearest first, for the centres within the ratio of the nearest, ``most`` of them at most, and for those
        before which fewer than ``least`` vectors are at home."""
        points = points.astype(np.float32)
        width, n = 16, len(self.centres)
        while True:
            beam, gap = self._beam(points, min(width, n))
            inside = gap <= np.maximum(gap[:, :1], 0) * ratio + 1e-6
            if homes is not None:
                inside |= np.cumsum(homes[beam], axis=1) - homes[beam] < least
            if width >= n or (most and width >= 2 * most) or not inside[:, -1].any():
                break
            width *= 4
        if most:
            inside[:, most:] = False
        row, at = np.nonzero(inside)
        return row, beam[row, at]

    def _beam(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centres that a best-first search with a beam of this width finds, for all points together."""
        rows, norm = np.arange(len(points))[:, None], (points**2).sum(axis=1)[:, None]
        seen = np.zeros((len(points), len(self.centres)), dtype=bool)
        beam, gap, done = np.zeros((len(points), 0), dtype=np.int64), np.zeros((len(points), 0), dtype=np.float32), np.zeros((len(points), 0), dtype=bool)
        new = np.repeat(self.entries[None, :], len(points), axis=0)
        while True:
            new = np.sort(new, axis=1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            away = norm + self.squares[new] - 2 * np.einsum("ijk,ik->ij", self.centres[new], points, optimize=True)
            away[~fresh] = np.inf
            beam, gap, done = np.concatenate([beam, new], axis=1), np.concatenate([gap, away], axis=1), np.concatenate([done, ~fresh], axis=1)
            best = np.argsort(gap, axis=1, kind="stable")[:, :width]
            beam, gap, done = (np.take_along_axis(x, best, axis=1) for x in (beam, gap, done))
            step = max(1, min(STEP, beam.shape[1]))
            following = np.argsort(done, axis=1, kind="stable")[:, :step]
            waiting = ~np.take_along_axis(done, following, axis=1)
            if not waiting.any():
                return beam, gap
            np.put_along_axis(done, following, True, axis=1)
            # rows that are ready look at a centre again, which changes nothing
            new = self.links[np.where(waiting, np.take_along_axis(beam, following, axis=1), beam[:, :1])].reshape(len(points), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.values if not column.offset else pa.concat_arrays([column]).flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.lit(True).alias("taking"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).select("vec_id", "v")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """uid, v and the k + 1 smallest ids of each group of equal vectors."""
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("uid"), "v", "ids")


class Index:
    """Graph of centres, and what turns inner products into distances."""

    def __init__(self, graph: CentreGraph, longest: float):
        self.graph, self.longest = graph, longest

    def placed(self, v: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes them as long as the longest."""
        rest = np.sqrt(np.maximum(self.longest**2 - (v**2).sum(axis=1), 0))
        return np.concatenate([v, rest[:, None]], axis=1) / self.longest

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Queries at the length of one, which changes none of their orders, with a zero."""
        return np.concatenate([v / np.sqrt((v**2).sum(axis=1))[:, None], np.zeros((len(v), 1))], axis=1)


def fit(vectors: DataFrame) -> Index | None:
    """An index of the column v, all of one length, from about SAMPLE of them (those of lowest hash)."""
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.count("*").alias("n"), F.max(squares).alias("longest")).first()
    if not facts.n:
        return None
    share = (1 << 30) if facts.n <= SAMPLE else int(SAMPLE / facts.n * (1 << 30)) + 1
    sample = vectors.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v").toArrow()
    sample = np.array(sample["v"].to_pylist(), dtype=np.float64) if len(sample) else np.array([vectors.select("v").first().v], dtype=np.float64)
    index = Index(CentreGraph(np.zeros((1, sample.shape[1] + 1))), math.sqrt(facts.longest))
    index.graph = CentreGraph(balanced_centres(index.placed(sample), max(1, min(MAX_LISTS, math.ceil(facts.n / LIST_ROWS), len(sample)))))
    return index


def _listed(rows: DataFrame, index, homes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Rows with each of their lists and whether it is the nearest; given how many vectors are at home in each list, those of queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part, held = batch.slice(at, TOGETHER), index.value
                v = np.array(part.column("v").to_pylist(), dtype=np.float64)
                found = held.graph.search(held.placed(v), ROWS_RATIO, REPLICAS) if homes is None else held.graph.search(held.asked(v), QUERY_RATIO, None, homes, least)
                copies = part.take(pa.array(found[0]))
                home = np.append(True, found[0][1:] != found[0][:-1])[: len(found[0])]
                yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(found[1].astype(np.int32)), pa.array(home)], [*copies.schema.names, "list", "home"])

    return rows.mapInArrow(work, rows.withColumns({"list": F.lit(0), "home": F.lit(True)}).schema)


def _met(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """For each query and part of a list it visits, the k + 1 best distinct vectors there: arrays of scores, uids and ids."""
    spark = postings.sparkSession
    held = postings.groupBy("list").agg(F.count("*").alias("rows"))
    coming = asked.groupBy("list").agg(F.count("*").alias("queries"))
    plan = held.join(coming, "list").collect()  # a row for each list, MAX_LISTS at most
    plan = [(r.list, math.ceil(r.rows / PART_ROWS), math.ceil(r.queries / QUERY_ROWS)) for r in plan]
    sizes = F.broadcast(spark.createDataFrame(plan, "list int, parts long, groups long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = ["list", "part", "group"]
    rows = postings.join(sizes, "list").select("list", F.pmod(F.xxhash64("uid"), "parts").alias("part"), every("groups").alias("group"), "uid", "v", "ids")
    queries = asked.join(sizes, "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("uid"), "groups").alias("group"), "uid", "v")

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(queries):
            v, first = np.array(rows["v"].tolist()), np.fromiter((x[0] for x in rows["ids"]), dtype=np.int64, count=len(rows))
            uids, ids = rows["uid"].to_numpy(np.int64), rows["ids"].to_numpy()
            q = np.array(queries["v"].tolist())
            products = q @ v.T
            for uid, one, scores in zip(queries["uid"].tolist(), q, products):
                if len(scores) > k + 1:  # all that tie with the last of the k + 1 best, but for rounding
                    last = np.partition(scores, -(k + 1))[-(k + 1)]
                    at = np.flatnonzero(scores >= last - 1e-12 * max(1.0, abs(last)))
                else:
                    at = np.arange(len(scores))
                exact = (v[at] * one).sum(axis=1)
                best = np.lexsort((first[at], -exact))[: k + 1]
                found.append((uid, exact[best], uids[at[best]], [list(x) for x in ids[at[best]]]))
        return pd.DataFrame(found, columns=["uid", "scores", "uids", "ids"])

    tasks = max(spark.sparkContext.defaultParallelism, min(4096, sum(b * c for _, b, c in plan)))
    pairs = rows.repartition(tasks, *place).groupBy(*place).cogroup(queries.repartition(tasks, *place).groupBy(*place))
    return pairs.applyInPandas(search, "uid long, scores array<double>, uids array<long>, ids array<array<long>>")


def _merged(met: DataFrame, k: int) -> DataFrame:
    """For each distinct query the k + 1 best rows, best first: vec_id, score, and whether the vector is the query's own."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        own = int(rows["uid"].iloc[0])
        groups = {u: (-s, i) for scores, uids, ids in zip(rows["scores"], rows["uids"], rows["ids"]) for s, u, i in zip(scores, uids, ids)}
        found = sorted((s, int(i), u == own) for u, (s, members) in groups.items() for i in members)[: k + 1]
        return pd.DataFrame({"uid": [own], "found": [[{"vec_id": i, "score": -float(s), "own": bool(o)} for s, i, o in found]]})

    return met.groupBy("uid").applyInPandas(best, "uid long, found array<struct<vec_id:long,score:double,own:boolean>>")


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score for the rows for which ``asked`` holds, a condition on ``vec_id``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    with scratch(spark) as keep:
        distinct = keep(distinct_vectors(rows, k).withColumn("n", F.size("v")))
        asking = keep(rows.filter(asked).join(distinct.select("v", "uid"), "v").select("vec_id", "uid"))
        found = None
        for (n,) in distinct.select("n").distinct().collect():
            own = distinct.filter(F.col("n") == n).select("uid", "v", "ids")
            index = spark.sparkContext.broadcast(fit(own))
            queries = own.select("uid", "v").join(asking.select("uid").distinct().hint("shuffle_hash"), "uid", "left_semi")
            postings = keep(_listed(own, index))
            homes = np.zeros(len(index.value.graph.centres), dtype=np.int64)
            for r in postings.filter("home").groupBy("list").count().collect():  # MAX_LISTS rows at most
                homes[r["list"]] = r["count"]
            one = keep(_merged(_met(postings, keep(_listed(queries, index, homes, AT_LEAST * (k + 1))), k), k))
            index.unpersist()
            found = one if found is None else found.unionByName(one)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        given = asking.join(found, "uid").select(F.col("vec_id").alias("query_id"), "found")
        mine = F.array_position(F.transform("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
        others = F.slice(F.filter("found", lambda x, i: i + 1 != mine), 1, k)
        return written(given.select("query_id", F.posexplode(others).alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "f.vec_id", "f.score"))
