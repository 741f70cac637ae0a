"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors are binarised by the sign of each component. A code is cut into segments; the index of a block of codes holds,
for each segment, the codes in order of that segment's value. A query looks up its own segment values first, then all
values at one bit's distance, and so on. After radius r every code within m * (r + 1) - 1 bits has been seen, m being
the number of segments: the search ends when the k-th best verified distance is within that. Ties go to the lower id.

Rows are dealt evenly into blocks of bounded size by a hash of the row; every query visits every block of codes of its
length once and brings back its k best there, and these are merged: no task holds more than one block, whatever its
values are. Pairs of a block and a part of the queries are spread over a stated number of tasks, as they are small but
slow.

Defined results: a null vector or id is neither a query nor found, and an empty vector likewise; codes are compared with
those of the same length, each length on its own; a row is not its own neighbour, nor are other rows of its id; fewer
than k other rows give fewer, and none gives no row; repeated ids are separate rows, and a repeated query id is asked
once for each different code of it; ties go to the lower id; an empty table gives an empty result; columns other than id
and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block, and queries that visit a block together, at most about so many.
BLOCK_ROWS, QUERY_ROWS = 1 << 14, 1 << 10
SEGMENT_BITS = 16


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code (array of 16-bit segment values): bit j of segment s is set where component 16 s + j is above 0."""
    v = F.col("v")
    bits = F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))
    starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(SEGMENT_BITS))
    code = F.transform(starts, lambda s: F.aggregate(F.reverse(F.slice(bits, s + 1, F.lit(SEGMENT_BITS))), F.lit(0), lambda a, b: a * 2 + b))
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return usable.select("id", code.alias("code"))


@lru_cache(maxsize=64)
def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of so many bits with radius bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], dtype=np.int64)


class BlockIndex:
    """Multi-index hash tables of one block of codes."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.orders = [np.argsort(codes[order][:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[order][:, s][o], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in enumerate(self.orders)]

    def search(self, query: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k nearest others, and the last radius."""
        seen = np.zeros(len(self.ids), dtype=bool)
        segments = len(code)
        at, distance = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for radius in range(SEGMENT_BITS + 1):
            new = []
            for s in range(segments):
                values = code[s] ^ flips(SEGMENT_BITS, radius)
                first, last = self.starts[s][values], self.starts[s][values + 1]
                first, count = first[last > first], (last - first)[last > first]
                if len(count):
                    place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    new.append(self.orders[s][place])
            if new:
                found = np.unique(np.concatenate(new))
                found = found[~seen[found]]
                seen[found] = True
                found = found[self.ids[found] != query]
                gap = np.bitwise_count(self.codes[found] ^ code).sum(axis=1).astype(np.int64)
                at, distance = np.append(at, found), np.append(distance, gap)
                best = np.lexsort((self.ids[at], distance))[:k]
                at, distance = at[best], distance[best]
            if len(at) == min(k, int((self.ids != query).sum())) and (not len(at) or distance[-1] <= segments * (radius + 1) - 1):
                break
        return self.ids[at], distance, radius


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance for the rows of queries (id, code) against those of codes."""
    spark = codes.sparkSession
    queries = queries.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).distinct()
    # a block's queries come in parts, each with the block's rows, so that several tasks share the work of a block
    sized = codes.groupBy(F.size("code").alias("n")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    asking = queries.groupBy(F.size("asked").alias("n")).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("parts"))
    plan = sized.join(asking, "n").collect()  # a row for each length of codes
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in plan], "n int, blocks long, parts long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = ["n", "block", "part"]
    row = F.xxhash64(F.monotonically_increasing_id())  # repeated rows go to different blocks
    held = codes.select(F.size("code").alias("n"), "id", "code", row.alias("row")).join(sizes, "n")
    held = held.select("n", "id", "code", F.pmod("row", "blocks").alias("block"), every("parts").alias("part"))
    asked = queries.withColumn("n", F.size("asked")).join(sizes, "n").withColumn("part", F.pmod(F.xxhash64("query_id", "asked"), "parts"))
    asked = asked.select("n", "query_id", "asked", every("blocks").alias("block"), "part")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids: list[int] = []
        own: list[np.ndarray] = []
        near, gaps = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if not (rows.empty or asked.empty):
            index = BlockIndex(rows["id"].to_numpy(np.int64), np.stack(rows["code"].to_list()).astype(np.int64))
            for q, c in zip(asked["query_id"].tolist(), asked["asked"]):
                at, distance, _ = index.search(q, np.asarray(c, dtype=np.int64), k)
                ids += [q] * len(at)
                own += [c] * len(at)
                near.append(at)
                gaps.append(distance)
        columns = {"query_id": pd.Series(ids, dtype="int64"), "asked": pd.Series(own, dtype=object)}
        return pd.DataFrame(columns | {"neighbour_id": np.concatenate(near), "distance": np.concatenate(gaps).astype("int32")})

    tasks = max(spark.sparkContext.defaultParallelism, min(4096, sum(r.blocks * r.parts for r in plan)))
    pairs = held.repartition(tasks, *place).groupBy(*place).cogroup(asked.repartition(tasks, *place).groupBy(*place))
    found = pairs.applyInPandas(search, "query_id long, asked array<int>, neighbour_id long, distance int")
    order = Window.partitionBy("query_id", "asked").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(q.b, c.b), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
