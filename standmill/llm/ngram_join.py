"""N-gram Jaccard join: documents whose sets of word shingles overlap by a stated share, and the groups they form.

1. Every text becomes a set of hashed shingles. Equal sets are joined first, by a hash of the whole set; from here on
   sets, which are numbered, stand for their documents.
2. Half of the hash range is enough to find partners: of n shingles a linked set lacks at most n - ceil(0.75 n), so it
   shares some in that half (small sets, and those of which the half holds too little, use the whole range). Hashes are
   dealt into buckets, whose number grows with the corpus, and each bucket tells which hashes occur in one set only.
   Hashes that very many sets hold are dealt by set into several parts of a bucket.
3. Hashes are ordered: those of one set only, then by how many sets hold them (in powers of two), then by value. Linked
   sets share one of their first n - ceil(0.75 n) + 1 hashes. Most sets hold enough hashes of their own and have no
   partner; the others enter inverted lists with their first hashes.
4. T-occurrence search: a document asks for members of its lists that reach the required overlap with it. The members
   that come together for a query are indexed by the query's shingles; the short inverted lists are merged by a heap,
   the long ones (as many as DivideSkip allows) only probed by binary search for the documents that can still reach it.
5. Every list first asks with a few of its documents only, which joins nearly all of its linked members into groups.
   Then the documents of lists that still hold different groups are searched against each other in bounded blocks, so
   that no link between groups is lost and no pairs are formed.

No list, bucket or group is collected in one place without bound: lists are joined by shuffles, the members of a query
are dealt over many tasks, and the edges of a hub are joined by a broadcast of the few hubs.

Defined results: words are maximal runs of other than ASCII white space, with A-Z lowered; a text of fewer words than a
shingle has one shingle, all of them; a null text or one without words has none and is linked with nothing; repeated
ids give a row each and count as one document, so that links of all its texts join one group; a null id is never a
group's id and stays alone; very long texts count whole; an overlap of exactly the share links; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import scratch, slices, written

#: Words of a shingle; the overlap that links is NUMERATOR / DENOMINATOR of the union at least.
WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
#: Sets with fewer shingles use the whole hash range.
SMALL = 96
#: Hashes in a bucket, about; and members that are searched together for a query, at most about.
BUCKET_HASHES, MEMBERS = 1 << 20, 1024
#: Documents that each list asks with in a first round, and such rounds; hashes in a block of a family, about.
QUERIES, ROUNDS, BLOCK_HASHES = 3, 1, 1 << 18
#: Sets, and hashes, in a key group, and edges in a file between the rounds of components(), about.
GROUP_SETS, GROUP_HASHES, FILE_EDGES = 16_384, 1 << 22, 1 << 20
#: A hash is looked at as a frequent one if so many sets of a slice hold it, and this share of them; it is if HOT do.
FREQUENT, FREQUENT_SHARE, HOT = 4, 1 / 256, 1 << 20
#: A vertex is a hub from so many edges on, and from this share of all edges on (so there are few of them).
HUB_EDGES, HUB_SHARE = 1024, 1 / 4096
#: Text bytes that are hashed at a time.
CHUNK_BYTES = 1 << 20
ENTRY = ("hash", "id", "n", "whole", "most", "most_low", "own")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER] | np.uint64(1)
_PLACE = np.array([pow(0x5851F42D4C957F2D, k, 1 << 64) for k in range(256)], dtype=np.uint64)
_STEP = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers for places in words of up to n bytes."""
    out = _PLACE
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(0x5851F42D4C957F2D, len(out), 1 << 64))])
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of texts that lie one after the other."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = bounds[:-1][(bounds[:-1] < bounds[1:])]
    begins[at] = inside[at]  # a text's first byte begins a word even if the last text ended in one
    places = np.flatnonzero(inside)
    starts = np.flatnonzero(begins[places])
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(places)))
    within = np.arange(len(places)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE[data[places]] * _powers(int(lengths.max()))[within], starts)
    return _mix(sums + lengths.astype(np.uint64)), np.searchsorted(bounds, places[starts], side="right") - 1


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    bounds = np.cumsum([0, *map(len, texts)])
    words, text = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    n = max(0, len(words) - WORDS + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        grams += words[k : k + n] * _STEP[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(edges, edges[1:]):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix(np.array([(words[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batches, text):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(text).to_pylist()]
        found: list[np.ndarray] = []
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_BYTES or i == len(texts) - 1:
                found += shingle_sets(texts[start : i + 1])
                start, size = i + 1, 0
        yield part, found


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set."""
    return tuple(int(_mix(hashes * np.uint64(m) + np.uint64(len(hashes))).sum(dtype=np.uint64).astype(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def needed(n: int) -> int:
    """The overlap that a set of n has with a linked one at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


def whole_range(hashes: np.ndarray) -> bool:
    n = len(hashes)
    return n < SMALL or int(np.searchsorted(hashes, np.uint64(1 << 63))) <= n - needed(n)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n (size of the set), n_low (of it in the lower half of the hash range), whole, k1
    and k2, the set's key, and on one row of a slice ``common``: the hashes that many sets of the slice hold."""
    names = ["doc_id", "t", "n", "n_low", "whole", "k1", "k2", "common"]

    def common(keys: list[tuple[int, int]], sets: list[np.ndarray]) -> list[dict]:
        each = list(dict(zip(keys, sets)).values())
        hashes, count = np.unique(np.concatenate(each), return_counts=True)
        held = np.flatnonzero(count >= max(FREQUENT, FREQUENT_SHARE * len(each)))
        return [{"hash": h, "c": c} for h, c in zip(hashes[held].astype(np.int64).tolist(), count[held].tolist())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            keys = [set_key(s) for s in sets]
            low = [int(np.searchsorted(s, np.uint64(1 << 63))) for s in sets]
            arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.int64()), pa.array([whole_range(s) for s in sets])]
            arrays += [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            arrays.append(pa.array([common(keys, sets), *[None] * (len(sets) - 1)], pa.list_(pa.struct([("hash", pa.int64()), ("c", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *arrays], names)

    schema = "doc_id long, t long, n long, n_low long, whole boolean, k1 long, k2 long, common array<struct<hash: long, c: long>>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(work, schema)


def distinct_sets(found: DataFrame) -> DataFrame:
    """The sets (k1, k2, n, n_low, whole) with a number, id, that is unique once this is written, and the least (doc_id, t)
    of the documents that have them."""
    own = [F.first(c).alias(c) for c in ("n", "n_low", "whole")]
    sets = found.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("least"), *own)
    return sets.select("k1", "k2", "n", "n_low", "whole", "least.*").withColumn("id", F.monotonically_increasing_id())


def hot_hashes(found: DataFrame) -> dict[int, int]:
    """Hashes that HOT sets hold, and how many do (of those that are seen). As each is in a share of the sets of slices,
    their number is a bounded multiple of the mean size of a set."""
    counts = found.filter("common IS NOT NULL").select(F.explode("common").alias("x")).groupBy(F.col("x.hash").alias("hash")).agg(F.sum("x.c").alias("c"))
    return {r.hash & (2**64 - 1): r.c for r in counts.filter(F.col("c") >= HOT).collect()}


def _buckets(docs: DataFrame, bits: int, hot: dict[int, int]) -> DataFrame:
    """Rows (bucket, part, keys, counts, hashes) of the sets that a task sees, each once: 32 bits of every hash that counts.
    Part 0 holds all but hot hashes; these are dealt by their sets into further parts, about HOT in one."""
    frequent = np.array(sorted(hot), dtype=np.uint64)
    deals = np.array([-(-hot[h] // HOT) for h in sorted(hot)], dtype=np.int64)

    def parts(flat: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(frequent):
            return np.zeros(len(flat), dtype=np.int64)
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        return np.where(frequent[at] == flat, 1 + np.mod(key, deals[at]), 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batches):
            keys, used = [], []
            for s in sets:
                key = set_key(s) if len(s) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    used.append(s if whole_range(s) else s[: int(np.searchsorted(s, np.uint64(1 << 63)))])
            if not keys:
                continue
            pairs = np.array(keys, dtype="<i8")
            flat = np.concatenate(used)
            owner = np.repeat(np.arange(len(used)), list(map(len, used)))
            part = parts(flat, pairs[owner, 0])
            bucket = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), dtype=np.int64)
            order = np.lexsort((part, bucket)) if len(frequent) else np.argsort(bucket, kind="stable")
            flat, owner, part, bucket = flat[order], owner[order], part[order], bucket[order]
            short = ((flat << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            rows = []
            edges = np.flatnonzero(np.diff(bucket) | np.diff(part)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(flat)]):
                if b > a:
                    own, counts = np.unique(owner[a:b], return_counts=True)
                    rows.append((int(bucket[a]), int(part[a]), pairs[own].tobytes(), counts.astype("<u4").tobytes(), short[a:b].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "part", "keys", "counts", "hashes"])

    return docs.select("text").mapInArrow(work, "bucket long, part long, keys binary, counts binary, hashes binary")


def _shared(buckets: DataFrame, groups: int, bits: int, hot: dict[int, int]) -> DataFrame:
    """Rows (grp, bucket, keys, counts, hashes, levels): of the sets of a key group and a bucket, the hashes that other sets
    hold too, and of each the logarithm of how many do."""
    code = lambda h: (h >> (64 - bits) if bits else 0, ((h << bits) & (2**64 - 1)) >> 32)  # noqa: E731  bucket and 32 bits
    counts_of: dict[int, dict[int, int]] = {}
    for h, c in hot.items():
        counts_of.setdefault(code(h)[0], {})[code(h)[1]] = c

    def work(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, dtype="<i8").reshape(-1, 2) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        hashes = np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("hashes").to_pylist()])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        again = np.zeros(len(keys), dtype=bool)
        again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)  # the same set from another task
        owner = np.repeat(np.arange(len(keys)), counts)
        kept = ~again[owner]
        owner, hashes = owner[kept], hashes[kept]
        order = np.argsort(hashes, kind="stable")
        _, run, sizes = np.unique(hashes[order], return_inverse=True, return_counts=True)
        size = np.empty(len(hashes), dtype=np.int64)
        size[order] = sizes[run]
        if table.column("part")[0].as_py():  # hot hashes: a part of their sets
            known = counts_of[table.column("bucket")[0].as_py()]
            size = np.array([known[h] for h in hashes.tolist()], dtype=np.int64)
        held = size > 1
        owner, hashes, level = owner[held], hashes[held], np.ceil(np.log2(size[held])).astype(np.uint8)
        group = np.mod(keys[:, 0], groups)[owner]
        order = np.lexsort((owner, group))
        owner, hashes, level, group = owner[order], hashes[order], level[order], group[order]
        edges = np.searchsorted(group, np.arange(groups + 1)).tolist()
        bucket, rows = table.column("bucket")[0].as_py(), []
        for g, (first, last) in enumerate(zip(edges, edges[1:])):
            if last > first:
                own, count = np.unique(owner[first:last], return_counts=True)
                rows.append((g, bucket, keys[own].astype("<i8").tobytes(), count.astype("<u4").tobytes(), hashes[first:last].astype("<u4").tobytes(), level[first:last].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["grp", "bucket", "keys", "counts", "hashes", "levels"])

    return buckets.groupBy("bucket", "part").applyInArrow(work, "grp long, bucket long, keys binary, counts binary, hashes binary, levels binary")


def postings(docs: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """List entries (hash, id, n, whole, most, most_low, own): the first hashes of every set that can have a partner.

    most: the largest overlap that a whole-range set can have with another one; most_low: that any set can have with any;
    own: thousandths of the set that no other set holds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // 12 // BUCKET_HASHES).bit_length())
    hot = hot_hashes(found)
    total = sets.agg(F.count("*").alias("sets"), F.sum("n").alias("hashes")).first()
    groups = max(1, -(-total.sets // GROUP_SETS), -(-(total.hashes or 0) // GROUP_HASHES))
    sets = sets.select("k1", "k2", "id", "n", "n_low", "whole").withColumn("grp", F.pmod("k1", F.lit(groups).cast("long")))
    half = 1 << (bits - 1) if bits else 0

    def first_hashes(n: int, n_low: int, whole: bool, code: np.ndarray, level: np.ndarray) -> tuple[list[int], int, int]:
        code = code[np.lexsort((code, level))]
        low = code < (np.int64(half) << np.int64(32)) if bits else code < (1 << 31)
        lacking = n - needed(n)
        first = code[low][: max(0, min(lacking + 1, n_low) - (n_low - int(low.sum())))]
        if whole:
            first = np.union1d(first, code[: max(0, lacking + 1 - (n - len(code)))])
        most_low = n - n_low + int(low.sum())
        return first.tolist(), len(code) if whole else most_low, most_low  # upper hashes of a whole-range set meet those of such sets only

    def work(own: pa.Table, parts: pa.Table) -> pa.Table:
        codes, levels, keys = [], [], []
        for p in parts.to_pylist():
            k, c = np.frombuffer(p["keys"], dtype="<i8").reshape(-1, 2), np.frombuffer(p["counts"], dtype="<u4").astype(np.int64)
            keys.append(np.repeat(k, c, axis=0))
            codes.append((np.int64(p["bucket"]) << np.int64(32)) | np.frombuffer(p["hashes"], dtype="<u4").astype(np.int64))
            levels.append(np.frombuffer(p["levels"], dtype=np.uint8))
        rows: list[tuple[int, ...]] = []
        if keys:
            key, code, level = np.concatenate(keys), np.concatenate(codes), np.concatenate(levels)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, code, level = key[order], code[order], level[order]
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            place = {tuple(key[a].tolist()): (a, z) for a, z in zip(edges, edges[1:])}
            for k1, k2, i, n, n_low, whole in zip(*(own.column(c).to_pylist() for c in ("k1", "k2", "id", "n", "n_low", "whole"))):
                a, z = place.get((k1, k2), (0, 0))
                if z > a:
                    first, most, most_low = first_hashes(n, n_low, whole, code[a:z], level[a:z])
                    rows += [(c, i, n, int(whole), most, most_low, 1000 * (n - most) // n) for c in first]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(ENTRY))], names=list(ENTRY))

    shared = _shared(_buckets(docs, bits, hot), groups, bits, hot)
    return sets.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(work, ", ".join(f"{c} long" for c in ENTRY))


def _may_link(a: str, b: str) -> "F.Column":
    """Whether sizes, and numbers of shared hashes, allow a link of two entries."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(a, "n") + c(b, "n")
    overlap = F.ceil(total * NUMERATOR / (NUMERATOR + DENOMINATOR))
    most = F.when(c(a, "whole") + c(b, "whole") == 2, F.least(c(a, "most"), c(b, "most"))).otherwise(F.least(c(a, "most_low"), c(b, "most_low")))
    return (DENOMINATOR * F.least(c(a, "n"), c(b, "n")) >= NUMERATOR * F.greatest(c(a, "n"), c(b, "n"))) & (most >= overlap)


class Index:
    """Inverted lists of the hashes of some sets."""

    def __init__(self, members: list[np.ndarray]):
        self.members = members
        self.sizes = np.fromiter(map(len, members), dtype=np.int64, count=len(members))
        flat = np.concatenate(members) if members else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.entries = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.hashes, starts = np.unique(flat[order], return_index=True)
        self.edges = np.append(starts, len(flat))

    def overlaps(self, query: np.ndarray) -> list[tuple[int, int]]:
        """T-occurrence search by DivideSkip: numbers of the members that link with the query, and their overlaps."""
        if not len(self.hashes) or not len(query):
            return []
        at = np.minimum(np.searchsorted(self.hashes, query), len(self.hashes) - 1)
        there = self.hashes[at] == query
        length = np.where(there, self.edges[at + 1] - self.edges[at], 0)
        least = needed(len(query))
        long = min(least - 1, int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)))  # lists that are only probed
        by_length = np.argsort(length, kind="stable")
        short, probed = by_length[: len(query) - long], np.sort(query[by_length[len(query) - long :]])
        lists = [self.entries[self.edges[k] : self.edges[k + 1]].tolist() for k in at[short[length[short] > 0]].tolist()]
        required = -(-NUMERATOR * (len(query) + self.sizes) // (NUMERATOR + DENOMINATOR))
        out, current, count = [], -1, 0
        for m in chain(heapq.merge(*lists), (-2,)):
            if m == current:
                count += 1
                continue
            if current >= 0 and count + long >= required[current]:
                own = self.members[current]
                total = count + int((own[np.minimum(np.searchsorted(own, probed), len(own) - 1)] == probed).sum())
                if DENOMINATOR * total >= NUMERATOR * (len(query) + len(own) - total):
                    out.append((current, total))
            current, count = m, 1
        return out


def links(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (query, id) of sets those that link. The members of a query are dealt over parts."""
    sized = pairs.groupBy("query").agg(F.ceil(F.count("*") / MEMBERS).cast("long").alias("parts"))
    nothing = F.lit(0).cast("long")
    asked = sized.select(F.col("query").alias("id"), F.col("query").alias("block"), F.explode(F.sequence(nothing, F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"))
    members = pairs.join(sized, "query").select("id", F.col("query").alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(False).alias("asks"))
    return search(docs, sets, members.unionByName(asked).select("id", "block", nothing.alias("row"), "part", "asks", F.col("asks").cast("long").alias("component")))


def family_links(docs: DataFrame, sets: DataFrame, state: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All links between sets of different components that share a list (entries hash, id, n, component).

    Lists that share documents make a family, each document being in one. Of a family the documents outside its largest
    component ask, in blocks, all its documents, in blocks: no pairs are formed, and blocks are bounded by their hashes."""
    # sets are numbered from 0, hashes of lists are 0 or more: a hash stands in the graph as a negative number
    family = components(state.select(F.col("id").alias("a"), (-1 - F.col("hash")).alias("b")), write).filter("id >= 0").withColumnRenamed("component", "block")
    members = write(state.groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("component")).join(family, "id"))
    count = members.groupBy("block", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK_HASHES).cast("long")
    sized = count.groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("main"), blocks(F.sum("n")).alias("parts"), F.greatest(blocks(F.sum("n") - F.max_by("n", F.struct("c", "component"))), F.lit(1)).alias("rows"))
    placed = members.join(sized, "block")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    asked = placed.filter("component <> main").select("id", "block", deal("rows").alias("row"), every("parts").alias("part"), F.lit(True).alias("asks"), "component")
    held = placed.select("id", "block", every("rows").alias("row"), deal("parts").alias("part"), F.lit(False).alias("asks"), "component")
    return search(docs, sets, asked.unionByName(held))


def search(docs: DataFrame, sets: DataFrame, visits: DataFrame) -> DataFrame:
    """Pairs (query, id) that link, of those that meet in a place (block, row, part) and differ in component.

    visits: id, block, row, part, asks (as a query or as a member) and component."""
    visits = visits.groupBy("id").agg(F.collect_list(F.struct("block", "row", "part", "asks", "component")).alias("visits"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a repeated row is sent once
        for part, found in _sets(batches):
            rows = []
            for number, k1, k2, visit, s in zip(*(part.column(c).to_pylist() for c in ("id", "k1", "k2", "visits")), found):
                if number in done or set_key(s) != (k1, k2):
                    continue
                done.add(number)
                packed = _packed(s)
                for v in visit:
                    rows.append((v["block"], v["row"], v["part"], v["asks"], number, v["component"], packed))
                    if len(rows) > 1024:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    wanted = sets.select("id", "k1", "k2", "doc_id", "t").join(visits, "id")
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text").join(wanted.hint("shuffle_hash"), ["doc_id", "t"])
    routed = texts.select("id", "k1", "k2", "visits", "text").mapInArrow(spread, "block long, row long, part long, asks boolean, id long, component long, hashes binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, queries, members = None, {}, {}

        def finish() -> Iterator[pa.RecordBatch]:
            ids = list(members)
            index, pairs = Index([members[i][1] for i in ids]), []
            for q, (component, hashes) in queries.items():
                pairs += [(q, ids[m]) for m, _ in index.overlaps(hashes) if ids[m] != q and members[ids[m]][0] != component]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["query", "id"])

        for batch in batches:
            for block, row, part, asks, doc_id, component, hashes in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if (block, row, part) != place:
                    yield from finish()
                    place, queries, members = (block, row, part), {}, {}
                (queries if asks else members)[doc_id] = (component, _unpacked(hashes))
        yield from finish()

    place = ["block", "row", "part"]
    return routed.repartition(*place).sortWithinPartitions(*place).mapInArrow(meet, "query long, id long").distinct()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "row", "part", "asks", "id", "component", "hashes"])


def _packed(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (hashes >> np.uint64(32)).astype("<u4").tobytes() + ((hashes >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, dtype="<u4", count=n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(data, dtype="<u2", offset=4 * n).astype(np.uint64)


def _with_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b) with the m of a. Edges of hubs (more than limit edges, so few vertices) meet a broadcast, not one task."""
    hubs = least.filter(F.col("c") > limit).select("a", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    others = marked.filter("hub IS NULL").select("a", "b").join(least.filter(F.col("c") <= limit).select("a", "m"), "a")
    return marked.filter("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")).unionByName(others)


def components(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and component (the smallest id) of every vertex with an edge (a, b).

    Edges are reduced to a forest within each partition; then neighbours are hung to the smallest larger-side and to the
    smallest smaller-side neighbour (large star, small star), and so on until nothing changes. Between rounds edges stand in
    partitions of about FILE_EDGES."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(p, p)
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        for i in range(0, len(pairs), 10_000):
            part = pairs[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["a", "b"])

    trees = lambda e: e.mapInArrow(forest, "a long, b long")
    edges = write(trees(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    count, before = edges.count(), None
    while True:
        limit, files = max(HUB_EDGES, int(HUB_SHARE * 2 * count)), max(1, -(-count // FILE_EDGES))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
        large = write(_with_least(both, least, limit).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        hung = _with_least(large, least, limit).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write(trees(hung.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().coalesce(files)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        count, before = state[0], tuple(state)


def set_links(docs: DataFrame, found: DataFrame, sets: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (query, id) between different sets, enough of them to join every group: links within a group that others
    join already are not looked for."""
    spark = docs.sparkSession
    entries = write(postings(docs, found, sets))
    lists = entries.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1")
    entries = write(entries.join(lists.select("hash"), "hash"))
    linked = spark.createDataFrame([], "query long, id long")
    group = spark.createDataFrame([], "id long, component long")
    for turn in range(ROUNDS + 1):
        state = entries.join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = state.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hash")
        state = write(state.join(mixed, "hash"))
        if state.isEmpty():
            break
        if turn < ROUNDS:  # some documents of each list ask, first those with the least of their own: near the middle of their copies
            own = F.struct(*ENTRY[1:], "component")
            asks = [F.min_by(own, F.struct(F.lit(0) if turn or k else F.col("own"), F.xxhash64("id", F.lit(QUERIES * turn + k)))) for k in range(QUERIES)]
            chosen = state.groupBy("hash").agg(F.array_distinct(F.array(*asks)).alias("asks")).select("hash", F.explode("asks").alias("ask")).select("hash", "ask.*")
            meet = (F.col("q.hash") == F.col("m.hash")) & (F.col("q.id") != F.col("m.id")) & (F.col("q.component") != F.col("m.component")) & _may_link("q", "m")
            pairs = write(chosen.alias("q").join(state.alias("m"), meet).select(F.col("q.id").alias("query"), F.col("m.id").alias("id")).distinct())
            new = links(docs, sets, pairs)
        else:
            new = family_links(docs, sets, state, write)
        linked = linked.union(write(new))
        if turn < ROUNDS:
            group = write(components(linked.select(F.col("query").alias("a"), F.col("id").alias("b")), write))
    return linked


def repeated_ids(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of one id: a document with several texts joins them."""
    own = found.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "k1", "k2").distinct().join(sets.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    least = own.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b <> most").select("doc_id", "b")
    return own.join(least, "doc_id").select(F.col("id").alias("a"), "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(documents(docs))
    sets = written(distinct_sets(found))
    with scratch(docs.sparkSession) as write:
        edges = set_links(docs, found, sets, write).select(F.col("query").alias("a"), F.col("id").alias("b")).union(repeated_ids(found, sets))
        group = written(components(edges, write))
    placed = sets.join(group, "id", "left").select("k1", "k2", "doc_id", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = placed.join(least, "component").select("k1", "k2", "component_id")
    linked = found.filter("n > 0 AND doc_id IS NOT NULL").join(of_set, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
