"""Collocations against a plain count, on odd rows, and with many small tries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from standmill.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in count.items() if len(p) > 2 and a >= 10}
    found = []
    for (lang, *words), a in candidates.items():
        longer = [b for (other, *w), b in candidates.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[(lang, *words[:k])], count[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), left, right))
    rank, out = collections.Counter(), set()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= collocations.TOP:
            out.add((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def given(df):
    rows = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n=400):
    r = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "a b", "x" * 90, "x" * 91, "\x01odd", "z-1", "\x00"] + [f"w{k}" for k in range(25)]
    gaps = [" ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r", "\x0b", "? "]
    text = lambda: "".join(r.choice(words[: r.choice((4, 12, 37))]) + r.choice(gaps) for _ in range(r.randint(0, 60)))
    rows = [(k, text(), r.choice(["en", "de", None, "und", "", "a b\nc"])) for k in range(n)]
    return rows + [(None, None, "en"), (1, "", None), (2, " .\n", "en"), (3, "new york city " * 2000, "en"), (3, "new york city " * 2000, "en"), (4, "q" * 70_000 + " " + "q" * 70_000, "en")]


@pytest.mark.parametrize("shard", [collocations.SHARD_KEYS, 50])
def test_against_a_plain_count(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_KEYS", shard)
    if shard == 50:  # many tries, in several batches, and filters that let much through
        monkeypatch.setattr(collocations, "BATCH_KEYS", 400)
        monkeypatch.setattr(collocations, "FILTER_BITS", 10)
    rows = made(shard)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("word", "h", "n", "phrase", "a", "rank", "score")}).repartition(3)
    assert given(collocations.collocations(docs)) == plain(rows)


def test_more_tries_read_the_texts_no_more_often(spark, monkeypatch):
    rows = made(3, 150)

    def reads():
        seen = spark.sparkContext.accumulator(0)

        def work(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        docs = spark.createDataFrame(rows, SCHEMA)
        return given(collocations.collocations(docs.mapInArrow(work, docs.schema))), seen.value

    found, often = reads()
    monkeypatch.setattr(collocations, "SHARD_KEYS", 100)
    monkeypatch.setattr(collocations, "BATCH_KEYS", 200)  # ten batches and more
    assert reads() == (found, often) and found == plain(rows)


def test_noted_phrases_are_summed_exactly_whatever_their_hashes():
    """Two phrases of one hash stay two, and those of several slices are one."""
    h = np.array([5, 1 << 63, 5, 5], dtype=np.uint64)
    words = np.array([[1, 2, 2, 1], [2, 1, 1, 2], [0, 2, 0, 0]])
    held = [(h, np.zeros(4, dtype=np.int32), words, ["en"], pa.array(["a", "b"], pa.large_string())), (h[:1], np.ones(1, dtype=np.int32), words[:, :1], ["de", "en"], pa.array(["b", "a"], pa.large_string()))]
    rows = [collocations.Noted(r) for b in collocations._summed(held, 2, 1, 1) for r in b.to_pylist()]
    assert [r.shard for r in rows] == [0, 1]
    got = collections.Counter()
    for r in rows:
        assert r.phrases(np.arange(len(r.n))).type == pa.string()
        for lang, phrase, n in zip(r.lang, r.phrases(np.arange(len(r.n))).to_pylist(), r.n):
            got[r.langs[lang], phrase] += n
    assert got == {("en", "a b"): 2, ("en", "b a"): 2, ("en", "b a b"): 1}


def test_only_the_first_of_a_language_stay(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP", 7)
    rows = made(9)
    assert given(collocations.collocations(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "one two three", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, SCHEMA)).isEmpty()


def test_large_counts_stay_exact(spark):
    words = spark.createDataFrame([("en", "a", 3 * 10**12), ("en", "b", 10**13 + 1), ("en", None, 10**14)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "a b", 2 * 10**12 + 7)], "lang string, phrase string, a long")
    (row,) = collocations._scored(words, phrases).collect()
    assert row.score == 1000000 * (2 * 10**12 + 7) ** 2 // (3 * 10**12 * (10**13 + 1))


def test_double_arrays_hold_every_key():
    r = np.random.default_rng(1)
    numbers = np.unique(r.zipf(1.3, (4000, 4)) % 70_000 + 1, axis=0)
    length = np.where(r.random(len(numbers)) < 0.5, 3, 4)
    numbers[length == 3, 3] = 0
    numbers, first = np.unique(numbers, axis=0, return_index=True)
    length = (numbers > 0).sum(axis=1)
    base, check, ends = collocations.double_array(collocations.digits(numbers).reshape(len(numbers), -1).astype(np.uint8), 3 * length)
    assert len(np.unique(ends)) == len(numbers)
    trie = collocations.Trie(base.tobytes(), check.tobytes(), ends.tobytes(), [])
    state = np.zeros(len(numbers), dtype=np.int64)
    for k in range(4):
        state = np.where(k < length, trie.advance(state, numbers[:, k]), state)
    assert (state == ends).all()
    other = np.setdiff1d(r.integers(1, 70_000, 5000), numbers[:, 0])
    assert (trie.advance(np.zeros(len(other), dtype=np.int64), other) == -1).all()
