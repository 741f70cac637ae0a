"""Token counts of a sentencepiece BPE model without materialising ids.

No piece of such a model holds a space mark after another character, nor a line feed, so merges never cross the place
before a run of spaces or around a line feed: a text's count is the sum over its pre-tokens. Every distinct pre-token is
counted once and joined to the per-document frequencies. The most frequent pre-tokens (a bounded number; long ones go by a
digest of 128 bits) are joined by a broadcast dictionary; all others meet their counts in one shuffle on the pre-token, in which
no key is frequent, and go back to their documents as sums. Each task finds its frequent ones by a summary of bounded size
that misses none which makes up more than one in SUMMARY of the task's pre-tokens, whatever the texts' and pre-tokens' lengths are:
so, but for more than FREQUENT of such, no key of the shuffle makes up more than that of all.

Defined results: a null text counts as empty and has no tokens; very long texts count whole; every row gives a row, with repeated ids too; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import slices

#: A pre-token: spaces and what follows them up to the next space or line feed; or a line feed.
PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
#: The dictionary that is broadcast has at most so many pre-tokens; those of more characters stand in it as digests.
FREQUENT, FREQUENT_CHARS = 400_000, 64
#: Pre-tokens in a task's summary of frequent ones.
SUMMARY = 1 << 17


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the model puts before it; a space mark in it is as good as a space."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def piece_counts(model: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. One without a space in front is counted behind a line feed: a space mark and a byte."""
    bare = [t[0] != " " for t in tokens]
    ids = processor(model).encode(["\n" + t if b else t[1:] if len(t) > 1 else "\n" for t, b in zip(tokens, bare)], num_threads=1)
    return [len(x) - 2 if b else len(x) if len(t) > 1 else 1 for x, t, b in zip(ids, tokens, bare)]


def key_of(token: str) -> str:
    """What a pre-token goes by in the dictionary: itself, or a digest, which begins as no longer pre-token does."""
    return token if len(token) <= FREQUENT_CHARS else "\n" + hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def summarised(counts: dict[str, int], most: int) -> dict[str, int]:
    """At most so many of the counts, all lessened by the largest one that is left out (a Misra-Gries summary)."""
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    least = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return {t: n - least for t, n in counts.items() if n > least}


def frequent_pretokens(docs: DataFrame, model: str) -> dict[str, int]:
    """Piece counts of the pre-tokens that are frequent in the corpus, by their keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        pieces: dict[str, int] = {}
        for part in slices(batches):
            own: Counter[str] = Counter()
            for text in part.column("text").to_pylist():
                own.update(pretokens(text or ""))
            long = [t for t in own if len(t) > FREQUENT_CHARS]
            if long:  # their texts don't leave the task, their pieces do
                keys = [key_of(t) for t in long]
                fresh = [(k, t) for k, t in zip(keys, long) if k not in pieces]
                pieces.update(zip([k for k, _ in fresh], piece_counts(model, [t for _, t in fresh])))
                for k, t in zip(keys, long):
                    own[k] = own.pop(t)
            found.update(own)
            if len(found) > 2 * SUMMARY:
                found = Counter(summarised(found, SUMMARY))
                pieces = {k: n for k, n in pieces.items() if k in found}
        kept = summarised(found, SUMMARY)
        arrays = [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64()), pa.array([pieces.get(t) for t in kept], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["pretoken", "n", "pieces"])

    counted = docs.select("text").mapInArrow(work, "pretoken string, n long, pieces long").groupBy("pretoken").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces"))
    rows = counted.orderBy(F.desc("n"), "pretoken").limit(FREQUENT).select("pretoken", "pieces").collect()
    short = [r.pretoken for r in rows if r.pieces is None]
    return {r.pretoken: r.pieces for r in rows if r.pieces is not None} | dict(zip(short, piece_counts(model, short)))


def pretoken_frequencies(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """Rows (row, pretoken, n): how often a document holds each distinct pre-token that is not known.

    A document's own row, with doc_id, n_bytes and in n the pieces of its known pre-tokens, goes under a key that no
    pre-token can be. ``row`` numbers the documents: repeated ids stay apart."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = shared.value, TaskContext.get().partitionId() << 33
        for part in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                text, row, n = text or "", row + 1, 0
                for token, k in Counter(pretokens(text)).items():
                    c = pieces.get(token if len(token) <= FREQUENT_CHARS else key_of(token))
                    if c is None:
                        out.append((row, None, None, token, k))
                    else:
                        n += c * k
                out.append((row, doc_id, len(text.encode("utf-8", "surrogatepass")), f"\n{row}", n))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "doc_id", "n_bytes", "pretoken", "n"])

    return docs.mapInArrow(work, "row long, doc_id long, n_bytes long, pretoken string, n long")


def with_pieces(frequencies: DataFrame, model: str) -> DataFrame:
    """Replaces n by n times the pieces of the pre-token: rows of a pre-token meet in order, so that it is counted once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = "", 0
        for batch in batches:
            encoded = batch.column("pretoken").dictionary_encode()
            tokens = encoded.dictionary.to_pylist()
            own = np.array([t[0] == "\n" and len(t) > 1 for t in tokens], dtype=bool)
            counts = np.ones(len(tokens), dtype=np.int64)
            if tokens and tokens[0] == last:
                counts[0] = pieces
            new = [i for i, t in enumerate(tokens) if not own[i] and not (i == 0 and t == last)]
            counts[new] = piece_counts(model, [tokens[i] for i in new]) if new else 0
            if tokens:
                last, pieces = tokens[-1], int(counts[-1])
            n = batch.column("n").to_numpy() * counts[encoded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["row", "doc_id", "n_bytes", "n"])

    return frequencies.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(work, "row long, doc_id long, n_bytes long, n long")


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = with_pieces(pretoken_frequencies(docs, frequent_pretokens(docs, model)), model)
    total = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
