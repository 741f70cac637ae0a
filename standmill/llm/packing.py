"""Best-fit packing of documents into token sequences of bounded length.

Documents become ids (through a bounded cache of pre-tokens, exactly as the tokenizer gives them) and an end id; only
longer ones are cut. Pieces are dealt in turn, by their number in the task that makes them and not by their values, into
shards of about equal size, whose number grows with the corpus, and each shard is packed by best-two-fit: a sequence is filled greedily with the longest piece that fits; if a gap is left,
its smallest piece is exchanged for the two unpacked pieces that fill the widened gap best, if they fill it better. A
shard leaves at most a sequence or so unfilled.

Defined results: a null or empty text is a document of the end id alone; a very long one is cut into pieces, of which
all but the last are full; repeated ids and rows are packed as separate documents, over all shards; pieces of one length
are interchangeable, so which of them stands where is arbitrary; an empty table gives an empty result; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import slices

#: Text bytes for a shard, about: some thousands of sequences.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 200_000
#: Entries of one of the two halves of a worker's cache of pre-tokens.
CACHE = 200_000


def _members(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_SPACES = re.escape("".join(chr(c) for c in range(0x180) if chr(c).isspace() and not 0x1C <= c <= 0x1F))
#: The tokenizer's pre-tokens, for the Latin letters below U+0180; other texts go through the tokenizer whole.
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_members('L')}]+|[{_members('N')}]|[^{_SPACES}{_members('L')}{_members('N')}]+")
_WHOLE = re.compile(r"[^\x00-ſ]|[İŉ]|<\|")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        size = self.library.get_vocab_size()
        self.last = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes pre-tokens together, apart by spaces; the id of an end of word closes each."""
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # never seen; exact all the same
                self.young.update((w, np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()) for w in part)
                continue
            flat, ends = ids.tobytes(), (ends * 4).tolist()
            self.young.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        words = [None if _WHOLE.search(t or "") else _PRETOKEN.findall((t or "").lower()) for t in texts]
        missing = set(chain.from_iterable(ws for ws in words if ws)).difference(self.young)
        self.young.update((w, self.old[w]) for w in missing.intersection(self.old))
        self._learn(list(missing.difference(self.old)))
        get = self.young.__getitem__
        return [
            np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if ws is None else b"".join(map(get, ws))
            for t, ws in zip(texts, words)
        ]


def pieces(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, with_ids: bool = False, shards: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces, and the shard that each is dealt to; with_ids
    adds the ids as an array."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        context = TaskContext.get()
        turn = 0x9E3779B1 * (context.partitionId() if context else 0)  # tasks begin with different shards
        for part in slices(batches):
            out, ids = [], []
            for doc_id, flat in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                flat += end
                for k, at in enumerate(range(0, len(flat), 4 * length)):
                    own = flat[at : at + 4 * length]
                    out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), turn % shards))
                    turn += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "shard"] + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each length; equal lengths are interchangeable and taken in order."""
    count = np.bincount(lengths, minlength=capacity + 1)
    there = sum(1 << int(n) for n in np.flatnonzero(count))  # lengths that are left, as bits

    def take(n: int) -> None:
        nonlocal there
        count[n] -= 1
        if not count[n]:
            there &= ~(1 << n)

    sequences: list[list[int]] = []
    while there:
        gap, own = capacity, []
        while (n := (there & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            take(n)
            own.append(n)
            gap -= n
        if gap and there and len(own) > 1:
            smallest = own[-1]
            wide = gap + smallest
            left = np.flatnonzero(count[:wide])
            if len(left):
                at = np.searchsorted(left, wide - left, side="right") - 1
                at = np.where((at >= 0) & (left[at] == left) & (count[left] < 2), at - 1, at)
                both = np.where(at >= 0, left + left[at], 0)
                k = int(both.argmax())
                if both[k] > smallest:
                    own.pop()
                    count[smallest] += 1
                    there |= 1 << smallest
                    for n in (int(left[k]), int(left[at[k]])):
                        take(n)
                        own.append(n)
        sequences.append(own)
    flat = np.array([n for own in sequences for n in own], dtype=np.int64)
    number = np.repeat(np.arange(len(sequences)), [len(own) for own in sequences])
    offset = np.concatenate([np.cumsum([0, *own[:-1]]) for own in sequences]) if sequences else np.empty(0, dtype=np.int64)
    mine, theirs = np.argsort(lengths, kind="stable"), np.argsort(flat, kind="stable")
    out = np.empty((2, len(lengths)), dtype=np.int64)
    out[0, mine], out[1, mine] = number[theirs], offset[theirs]
    return out[0], out[1]


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, shard, ...), and drops the shard."""

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable")
        sequence, offset = best_two_fit(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset).drop(columns="shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "shard") + ", sequence_id long, offset long"
    return cut.groupBy("shard").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    shards = max(1, -(-(size.bytes or 0) // SHARD_BYTES), -(-size.rows // SHARD_ROWS))
    return pack(pieces(docs, path, capacity, shards=shards), capacity)
