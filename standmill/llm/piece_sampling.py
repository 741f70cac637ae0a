"""Subword sampling by merge-dropout over a sentencepiece BPE model, and lossless decoding.

Encoding works through the agenda of merges of every pre-token: best score first, leftmost first. Each candidate merge
is skipped where its keyed hash (seed, document, pre-token's number in it, place) falls below the dropout rate, so every
occurrence is sampled on its own, and a seed gives the same segmentation on every machine. What is cached is the same for
all occurrences of a pre-token: a tree of the merges that come next, kept or skipped, with the ids at its leaves.
Occurrences walk down these trees together, as arrays; paths that are not there yet are found by the agenda and added.

Without dropout the ids are those of the library, but for a space mark U+2581 in a text, which is encoded as bytes here
so that decoding gives it back.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; very long texts count
whole; of merges of equal score the leftmost is first; every row gives a row, with repeated ids too (rows of one id and
text are cut alike); an empty table gives an empty result; a column named ``ids`` of the input is not carried on.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import slices
from standmill.llm.token_counts import PRETOKEN, processor

#: A worker's cache is emptied between slices beyond so many pre-tokens, or nodes and leaves of their trees.
CACHE, NODES = 150_000, 3_000_000
_SLOTS = 19  # bits of the table of merges
_MIX, _NEVER = np.uint64(0x9E3779B97F4A7C15), 1 << 30
#: Longer pre-tokens go through the agenda one by one.
LONG = 128
#: Numbers of words, the candidate merge that is best for each, and whether it is skipped.
Note = Callable[[np.ndarray, np.ndarray, np.ndarray], None]
#: Occurrences that walk down the trees together.
TOGETHER = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Merges:
    """The model's merges as arrays: symbols are piece ids; characters that are no piece get numbers above those."""

    def __init__(self, model: str):
        sp = processor(model)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {sp.id_to_piece(i): i for i in usual}
        symbol = dict(text)
        for c in sorted({c for p in text for c in p}):
            symbol.setdefault(c, len(symbol) + n)
        self.n, self.pieces = n, n + len(symbol)
        pairs = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in text.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        order = sorted(usual, key=lambda i: -sp.get_score(i))
        self.rank = np.full(self.pieces, 1 << 30, dtype=np.int64)
        scores = sorted({sp.get_score(i) for i in usual}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        for i in order:
            self.rank[i] = place[sp.get_score(i)]
        self.keys, self.made = np.full(1 << _SLOTS, -1, dtype=np.int64), np.full(1 << _SLOTS, -1, dtype=np.int32)
        for entry in [(a * self.pieces + b, made) for a, b, made in pairs]:
            slot = int(self._slot(np.array([entry[0]]), 0)[0])
            while self.keys[slot] != -1:  # the newcomer takes the place, the other one goes to its other place
                entry, other = (int(self.keys[slot]), int(self.made[slot])), entry
                self.keys[slot], self.made[slot] = other
                places = [int(self._slot(np.array([entry[0]]), k)[0]) for k in (0, 1)]
                slot = places[1] if slot == places[0] else places[0]
            self.keys[slot], self.made[slot] = entry
        self.pairs, self.ranks = {a * self.pieces + b: made for a, b, made in pairs}, self.rank.tolist()  # the same for one merge at a time
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.char[0x20], self.char[0x2581] = symbol["▁"], -1
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])

    @staticmethod
    def _slot(key: np.ndarray, choice: int) -> np.ndarray:
        return ((key.astype(np.uint64) * (_MIX, np.uint64(0xD6E8FEB86659FD93))[choice]) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair merges to, or -1: it is in one of two places of the table."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.pieces + right)
        one, two = self._slot(key, 0), self._slot(key, 1)
        return np.where(self.keys[one] == key, self.made[one], np.where(self.keys[two] == key, self.made[two], -1))

    @staticmethod
    def place(first: np.ndarray, second: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number of the candidate merge of [first, second) and [second, end)."""
        return ((first.astype(np.uint64) << np.uint64(42)) + (second.astype(np.uint64) << np.uint64(21)) + end.astype(np.uint64)) * _MIX

    @staticmethod
    def dropped(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
        """Which candidate merges are skipped."""
        return mix(key + place) < np.uint64(min(2**64 - 1, int(dropout * 2.0**64)))

    def keys_of(self, words: list[str], variants: np.ndarray, seed: int) -> np.ndarray:
        crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
        return mix(mix(crc + (variants.astype(np.uint64) << np.uint64(32))) + np.uint64((seed * int(_MIX)) & (2**64 - 1)))

    def segment(self, words: list[str], variants: np.ndarray, seed: int, dropout: float) -> list[bytes]:
        """The ids of each word under its variant, as little-endian 32-bit integers."""
        return self.segment_keyed(words, self.keys_of(words, variants, seed), dropout)

    def segment_keyed(self, words: list[str], keys: np.ndarray, dropout: float, note: Note | None = None) -> list[bytes]:
        """The ids of each word under its key; note gets the merges of each as they are decided, but for those of long words."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = [b""] * len(words)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(group) or not lengths[group[0]]:
                continue
            if lengths[group[0]] > LONG:
                for i in group.tolist():
                    out[i] = self._bytes(words[i], *self._agenda(words[i], keys[i : i + 1], dropout))
                continue
            for at in np.split(group, range(8192, len(group), 8192)):
                self._together([words[i] for i in at.tolist()], at, keys[at], dropout, out, note)
        return out

    def _together(self, words: list[str], at: np.ndarray, keys: np.ndarray, dropout: float, out: list[bytes], note: Note | None) -> None:
        """The agendas of words of one length, a merge of each word at a time: rows stay equally long."""
        n, size = len(words), len(words[0])
        symbol = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size)]
        start = np.broadcast_to(np.arange(size + 1, dtype=np.int32), (n, size + 1)).copy()

        def candidates(left, right):
            made = self.lookup(left, right)
            return made, np.where(made >= 0, self.rank[made], _NEVER).astype(np.int32)

        made, rank = candidates(symbol[:, :-1], symbol[:, 1:])
        row = np.arange(n)
        while n:
            width = symbol.shape[1]
            j = rank.argmin(axis=1) if width > 1 else np.zeros(n, dtype=np.int64)  # leftmost of the best
            live = rank[row, j] < _NEVER if width > 1 else np.zeros(n, dtype=bool)
            look = np.flatnonzero(live) if dropout > 0 else row[:0]
            while len(look):  # a skipped candidate gives way to the next one
                place = self.place(start[look, j[look]], start[look, j[look] + 1], start[look, j[look] + 2])
                drop = self.dropped(keys[look], place, dropout)
                if note:
                    note(at[look], place, drop)
                look = look[drop]
                rank[look, j[look]] = _NEVER
                j[look] = rank[look].argmin(axis=1)
                live[look] = rank[look, j[look]] < _NEVER
                look = look[live[look]]
            if not live.all():
                flat = symbol[~live].astype("<i4").tobytes()
                for k, i in enumerate(at[~live].tolist()):
                    out[i] = flat[4 * width * k : 4 * width * (k + 1)]
                odd = np.flatnonzero(~live & ((symbol < 0) | (symbol >= self.n)).any(axis=1))
                for r in odd.tolist():
                    out[at[r]] = self._bytes(words[r], symbol[r].tolist(), start[r].tolist())
                words = [w for w, yes in zip(words, live.tolist()) if yes]
                at, keys, symbol, start, made, rank, j = (x[live] for x in (at, keys, symbol, start, made, rank, j))
                n = len(at)
                row = np.arange(n)
                if not n:
                    break
            merged = made[row, j]
            shift = lambda x, k: np.where(np.arange(x.shape[1] - 1) < k[:, None], x[:, :-1], x[:, 1:])  # noqa: E731  without column k
            symbol, start, made, rank = shift(symbol, j + 1), shift(start, j + 1), shift(made, j), shift(rank, j)
            symbol[row, j] = merged
            for side in (j - 1, j):  # the pairs that the new symbol is in
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                if len(ok):
                    k = side[ok]
                    made[ok, k], rank[ok, k] = candidates(symbol[ok, k], symbol[ok, k + 1])

    def _agenda(self, word: str, key: np.ndarray, dropout: float) -> tuple[list[int], list[int]]:
        """Symbols and starts of one long word, by a heap of candidate merges; plain integers, as candidates come one by one."""
        size, pieces, made_of, rank, own = len(word), self.pieces, self.pairs, self.ranks, int(key[0])
        symbol = self.char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tolist()
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []
        least, whole, factor = min(2**64 - 1, int(dropout * 2.0**64)), 2**64 - 1, int(_MIX)

        def offer(i: int) -> None:
            k = end[i]
            if k >= size or symbol[i] < 0 or symbol[k] < 0:
                return
            made = made_of.get(symbol[i] * pieces + symbol[k])
            if made is None:
                return
            if least:  # as in dropped(key, place(i, k, end[k]))
                x = (own + ((i << 42) + (k << 21) + end[k]) * factor) & whole
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
                if x ^ (x >> 31) < least:
                    return
            heapq.heappush(heap, (rank[made], i, end[k], made))

        for i in range(size):
            offer(i)
        gone = [False] * size
        while heap:
            _, i, last, made = heapq.heappop(heap)
            k = end[i]
            if gone[i] or k >= size or end[k] != last or made_of.get(symbol[i] * pieces + symbol[k]) != made:
                continue
            symbol[i], end[i], gone[k] = made, last, True
            if last < size:
                before[last] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        kept = [i for i in range(size) if not gone[i]]
        return [symbol[i] for i in kept], kept

    def _bytes(self, word: str, symbols: list[int], starts: list[int]) -> bytes:
        """The ids, with characters without a piece as byte pieces."""
        ids = chain.from_iterable((s,) if 0 <= s < self.n else [self.byte[x] for x in word[p].encode("utf-8", "surrogatepass")] for s, p in zip(symbols, starts))
        return np.array(list(ids), dtype="<i4").tobytes()


@lru_cache(maxsize=2)
def merges(model: str) -> Merges:
    return Merges(model)


class Encoder:
    """Segments texts, with a bounded cache of the trees of pre-tokens.

    An edge has a number: 2 n and 2 n + 1 are what follows node n when its merge is kept or skipped; a pre-token has a
    node without a merge, whose first edge leads to its tree. An edge leads to a node, to leaf k (-2 - k), or is unknown (-1)."""

    def __init__(self, model: str, seed: int, dropout: float, entries: int = CACHE):
        self.table, self.seed, self.dropout, self.entries = merges(model), seed, dropout, entries
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes, self.leaves = 0, 0
        self.place, self.next = np.empty(1 << 16, dtype=np.uint64), np.empty(1 << 17, dtype=np.int32)
        self.pool, self.bounds = np.empty(1 << 16, dtype="<i4"), np.zeros(1 << 16, dtype=np.int64)  # ids of leaf k: pool[bounds[k] : bounds[k + 1]]

    @staticmethod
    def _room(x: np.ndarray, size: int) -> np.ndarray:
        return x if size <= len(x) else np.concatenate([x, np.zeros(max(size - len(x), len(x)), dtype=x.dtype)])

    def _new(self, count: int) -> np.ndarray:
        first, self.nodes = self.nodes, self.nodes + count
        self.place, self.next = self._room(self.place, self.nodes), self._room(self.next, 2 * self.nodes)
        self.next[2 * first : 2 * self.nodes] = -1
        return np.arange(first, self.nodes)

    def _add(self, found: list[bytes]) -> np.ndarray:
        """New leaves with these ids."""
        ends = self.bounds[self.leaves] + np.cumsum([len(x) // 4 for x in found])
        self.bounds = self._room(self.bounds, self.leaves + len(found) + 1)
        self.bounds[self.leaves + 1 : self.leaves + len(found) + 1] = ends
        self.pool = self._room(self.pool, int(ends[-1]))
        self.pool[self.bounds[self.leaves] : ends[-1]] = np.frombuffer(b"".join(found), dtype="<i4")
        first, self.leaves = self.leaves, self.leaves + len(found)
        return np.arange(first, self.leaves)

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        """Adds the paths of occurrences that end at different unknown edges."""
        edge = 2 * np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

        def note(at: np.ndarray, place: np.ndarray, drop: np.ndarray) -> None:
            node = self.next[edge[at]].astype(np.int64)
            new = np.flatnonzero(node == -1)
            node[new] = self._new(len(new))
            self.place[node[new]] = place[new]
            self.next[edge[at[new]]] = node[new]
            edge[at] = 2 * node + drop

        self.next[edge] = -2 - self._add(self.table.segment_keyed(words, keys, self.dropout, note))

    def _walk(self, edge: np.ndarray, keys: np.ndarray, leaf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Leads the rows' edges on to leaves; gives the rows that end at unknown edges."""
        unknown = []
        for i in range(0, len(rows), TOGETHER):
            at = rows[i : i + TOGETHER]
            e, key = edge[at], keys[at]
            while len(at):
                node = self.next[e]
                inner = node >= 0
                if not inner.all():
                    out = ~inner
                    ended, last = at[out], node[out]
                    leaf[ended] = -2 - last
                    stop = last == -1
                    unknown.append(ended[stop])
                    edge[unknown[-1]] = e[out][stop]
                    at, key, node = at[inner], key[inner], node[inner]
                e = 2 * node.astype(np.int64) + self.table.dropped(key, self.place[node], self.dropout)
        return np.concatenate(unknown) if unknown else rows[:0]

    def encode(self, doc_ids: list, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.entries or self.nodes + self.leaves > NODES or len(self.pool) > 8 * NODES:
            self._empty()
        words = [PRETOKEN.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(sizes) - sizes
        own = mix(np.array([(d or 0) & (2**64 - 1) for d in doc_ids], dtype=np.uint64) + np.uint64((self.seed * int(_MIX) + 1) & (2**64 - 1)))
        number = (np.arange(sizes.sum()) - np.repeat(first, sizes)).astype(np.uint64)
        keys = mix(np.repeat(own, sizes) + number * _MIX)  # of every occurrence
        flat = list(chain.from_iterable(words))
        fresh = [w for w in set(flat).difference(self.known)]
        self.known.update(zip(fresh, self._new(len(fresh)).tolist()))
        edge = 2 * np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        leaf = np.empty(len(flat), dtype=np.int64)
        long = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) > LONG
        if long.any():
            at = np.flatnonzero(long)
            leaf[at] = self._add(self.table.segment_keyed([flat[i] for i in at.tolist()], keys[at], self.dropout))
        rest = np.flatnonzero(~long)
        while len(rest := self._walk(edge, keys, leaf, rest)):
            one = rest[np.unique(edge[rest], return_index=True)[1]]
            for i in range(0, len(one), 100_000):
                part = one[i : i + 100_000]
                self._learn([flat[k] for k in part.tolist()], keys[part])
        start, many = self.bounds[leaf], self.bounds[leaf + 1] - self.bounds[leaf]
        ids = self.pool[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
        ends = np.concatenate([[0], np.cumsum(many)])
        return [ids[a:b] for a, b in zip(ends[first].tolist(), ends[first + sizes].tolist())]


def encode(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1, keep_text: bool = False) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs; keep_text adds the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, seed, dropout)
        for part in slices(batches):
            ids = encoder.encode(part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()])
            bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))]
            yield pa.RecordBatch.from_arrays(arrays + [part.column("text")] * keep_text, ["doc_id", "ids"] + ["text"] * keep_text)

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(work, "doc_id long, ids array<int>" + ", text string" * keep_text)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text that the ids stand for; null ids give an empty text. A column of that name is replaced."""
    kept = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.array(merges(model).bytes_of, pa.binary())
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids = part.column("ids")
                first, last = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
                own = parts.take(ids.values.slice(first, last - first))  # of these rows only
                joined = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, first), own), b"")
                texts = pc.utf8_slice_codeunits(joined.cast(pa.string()), 1)  # without the space in front
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return kept.mapInArrow(work, schema)


def segmentations(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """Per document: tokens, a hash of the ids, and whether they decode to the text."""
    found = decode(encode(docs, model, seed, dropout, keep_text=True), model)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("lossless"))
