"""Phrase collocation mining by broadcast double-array tries.

Candidates are Apriori-safe: a phrase can only occur LEAST times if its words and its shorter parts do. Level by level,
tasks tally 64-bit hashes of the phrases whose parts have passed (of words, the words themselves), and the hashes with
LEAST or more go on. A hash is shared by phrases only by chance, and then its tally is too high: no phrase is lost, and
texts of phrases are only shuffled for hashes that passed. These candidates are dealt by their hash into tries of about
SHARD_KEYS phrases, which tasks build as double arrays over the bytes of word numbers.

What the tries count is read from the texts once: tasks note the phrases that pass all filters, as numbers of words and each with
its occurrences among some millions of places, and deal them by ranges of their hashes (pieces of a trie's). Candidates come from
these notes, of which one task has nearly all of a piece, and a bounded batch of tries at a time is broadcast and counts its own part
of them: NumPy moves the states of many phrases along the trie together, one level at a time; the occurrences are added up at the
states that are reached, and the counts of all tasks are summed.

The filters between levels are bitmaps of bounded size (2^FILTER_BITS bits at most): if hashes that passed outgrow them,
they let more through, and the tallies still decide. Hot phrases are one row a task in every shuffle.

Defined results: a null text is empty and a null language ``und`` (also a language of that name); an empty text or table
has no phrase; very long texts, words and languages count whole; repeated rows count each; ties in score go to the higher
count, then to the phrase that comes first in byte order, and ties between cuts to the earlier cut; all columns other than
text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standmill.llm.common import scratch, slices, written

#: Occurrences that a phrase needs, words that it may have, phrases given for each language.
LEAST, WORDS, TOP = 10, 3, 2000
#: A shorter phrase goes if a longer candidate around it has at least so many hundredths of its count.
COVERED = 50
#: Longer words (in bytes) are hashed by a digest.
LONG_WORD = 40
#: Bits of a filter at most (as a power of two); phrases of a trie; phrases in tries that are broadcast together.
FILTER_BITS, SHARD_KEYS, BATCH_KEYS = 27, 1 << 18, 1 << 21
#: Different hashes that a task gathers before it hands them on.
GATHERED = 1 << 21
#: Occurrences of phrases that a task gathers before it writes them with their numbers; such rows for each task that counts them.
NOTED, COUNTED = 1 << 21, 1 << 23
#: Pieces that the notes are dealt to at least.
PIECES = 32
#: Counts that a task hands on together.
BLOCK = 1 << 12
#: Bytes of a word's number in a trie: a trie has at most 4 * SHARD_KEYS different words, languages included.
DIGITS = 3

_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_POWERS = np.cumprod(np.full(LONG_WORD + 1, 0x9FB21C651E98DF25, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


class Places:
    """The words of a slice of texts: numbers of the slice's different words in order, and hashes of words and phrases."""

    def __init__(self, part: pa.RecordBatch):
        texts = pc.fill_null(part.column("text"), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held and offsets[-1] > offsets[0] else np.empty(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[raw]
        inside = kind == 0
        # a word's start and end, next to a byte of no word or to the end of a text
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        size = ends - starts
        row = np.searchsorted(offsets[1:], starts, side="right")
        breaks = np.flatnonzero(kind == _BREAK)
        piece = np.searchsorted(breaks, starts)
        #: whether a word and its next one are in the same piece
        self.joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        coded = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
        self.known, self.word = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
        self.langs: list[str] = langs.dictionary.to_pylist()
        self.lang = np.asarray(langs.indices, dtype=np.int64)[row]

    def hashes(self, words: int = WORDS) -> list[np.ndarray]:
        """Hashes of the phrases of 1 to so many words that begin at each word; a phrase that crosses a break has one of no use."""
        if not len(self.word):
            return [np.empty(0, dtype=np.uint64)] * words
        found = [_mixed(word_hashes(self.known)[self.word] + seeds(self.langs)[self.lang])]
        for k in range(1, words):
            found.append(_joined(found[-1][:-1], found[0][k:]))
        return found

    def whole(self, words: int) -> np.ndarray:
        """Whether a phrase of so many words begins at each word (but the last ones) and lies in one piece."""
        n = max(len(self.word) - words + 1, 0)
        ok = np.ones(n, dtype=bool)
        for k in range(words - 1):
            ok &= self.joined[k : k + n]
        return ok


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def word_hashes(known: pa.LargeStringArray) -> np.ndarray:
    ends = np.frombuffer(known.buffers()[1], dtype=np.int64)[known.offset : known.offset + len(known) + 1]
    data, size = np.frombuffer(known.buffers()[2], dtype=np.uint8), np.diff(ends)
    short = np.where(size > LONG_WORD, 0, size)
    first = np.cumsum(short) - short
    place = np.arange(short.sum()) - np.repeat(first, short)
    values = (data[np.repeat(ends[:-1], short) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    sums = np.append(np.uint64(0), np.cumsum(values))  # sums are modulo 2^64
    found = sums[first + short] - sums[first]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        found[k] = _number(data[ends[k] : ends[k + 1]].tobytes())
    return _mixed(found)


def seeds(langs: list[str]) -> np.ndarray:
    return np.array([_number(x.encode("utf-8", "surrogatepass")) for x in langs], dtype=np.uint64)


def _joined(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed(phrases * _ODD[0] + words)


class Filter:
    """A bitmap of hashes: some that are not in it may pass, none that is in it fails."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64((1 << bits) - 1), words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hash_filter(hashes: DataFrame) -> Filter:
    """A filter of the column h; about 16 bits a hash, within FILTER_BITS."""
    bits = min(FILTER_BITS, max(10, math.ceil(math.log2(16 * hashes.count() + 1))))
    place = f"h & {(1 << bits) - 1}L"
    found = hashes.groupBy(F.expr(f"shiftright({place}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({place} & 63 AS INT)))").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[np.asarray(found["at"])] = np.asarray(found["word"]).view(np.uint64)
    return Filter(bits, words)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def double_array(table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base and check of the trie of different keys in byte order (rows of bytes, filled up with zeros, and their lengths), and the
    state at the end of each. State ROOT is the start; state t follows s on byte c if t = base[s] + c and check[t] = s."""
    differ = table[1:] != table[:-1]
    shared = np.append(0, np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1]), np.minimum(length[1:], length[:-1])))
    number = len(table)
    # nodes, level by level: a key has a node of its own where it leaves the key before
    at, end, parents, symbols, made = np.zeros(number, dtype=np.int64), np.zeros(number, dtype=np.int64), [], [], 1
    for depth in range(table.shape[1]):
        new = np.flatnonzero((shared <= depth) & (length > depth))
        parents.append(at[new])
        symbols.append(table[new, depth])
        own = np.zeros(number, dtype=np.int64)
        own[new] = made + np.arange(len(new))
        lead = np.zeros(number, dtype=np.int64)
        lead[new] = new
        at = own[np.maximum.accumulate(lead)]
        end[length == depth + 1] = at[length == depth + 1]
        made += len(new)
    parent, symbol = np.concatenate(parents), np.concatenate(symbols).astype(np.int64)
    order = np.argsort(parent, kind="stable")
    parent, symbol, child = parent[order], symbol[order], order + 1
    owner, first, count = np.unique(parent, return_index=True, return_counts=True)
    # families of children find places with no one in them: the large ones first, then single children fill the gaps
    room = np.random.default_rng(number)
    size, start = int(1.25 * made) + 512, np.zeros(len(owner), dtype=np.int64)
    taken = np.zeros(size, dtype=bool)
    open_ = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
    tries = 0
    while len(open_):
        now = open_[: max(1, int(np.searchsorted(-count[open_], -(count[open_[0]] // 2), side="right")))][: max(1, size // 512)]
        offer = room.integers(0, size - 256, len(now))
        slot = np.repeat(offer, count[now]) + symbol[spans(first[now], count[now])]
        good = ~taken[slot]
        once = np.zeros(len(slot), dtype=bool)
        once[np.unique(slot, return_index=True)[1]] = True
        fits = np.logical_and.reduceat(good & once, np.cumsum(count[now]) - count[now])
        start[now[fits]] = offer[fits]
        taken[slot[np.repeat(fits, count[now])]] = True
        open_ = np.concatenate([now[~fits], open_[len(now) :]])
        tries = 0 if fits.any() else tries + 1
        if tries == 24:
            tries, size = 0, size + size // 4 + 256
            taken = np.append(taken, np.zeros(size - len(taken), dtype=bool))
    single = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    if len(free) < len(single):
        free = np.append(free, np.arange(size, size + len(single) - len(free)))
    start[single] = free - symbol[first[single]]
    slots = np.zeros(made, dtype=np.int64)
    slots[0] = ROOT
    slots[child] = np.repeat(start, count) + symbol + 256
    base, check = np.zeros(max(size, int(slots.max())) + 513, dtype=np.int32), np.full(max(size, int(slots.max())) + 513, -1, dtype=np.int32)
    base[slots[owner]] = start + 256
    check[slots[child]] = slots[parent]
    return base, check, slots[end].astype(np.int32)


ROOT = 0


def digits(numbers: np.ndarray) -> np.ndarray:
    """The bytes of each number, highest first."""
    return np.stack([numbers >> 8 * k & 255 for k in range(DIGITS - 1, -1, -1)], axis=-1)


class Trie:
    """A double array of phrases, as strings of its own numbers of words; a language is the word before its phrases."""

    def __init__(self, base: bytes, check: bytes, ends: bytes, words: list[str]):
        self.base, self.check, self.ends = (np.frombuffer(x, dtype=np.int32) for x in (base, check, ends))
        self.numbers = {w: k for k, w in enumerate(words, 1)}

    def advance(self, state: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The states after one more word each, -1 where there is none; all move together, a level at a time."""
        found = np.full(len(state), -1, dtype=np.int64)
        at = np.flatnonzero((state >= 0) & (numbers > 0))
        state, numbers = state[at], numbers[at]
        for shift in range(8 * DIGITS - 8, -1, -8):
            following = self.base.take(state) + (numbers >> shift & 255)
            alive = np.flatnonzero(self.check.take(following) == state)
            at, state, numbers = at.take(alive), following.take(alive), numbers.take(alive)
        found[at] = state
        return found

    def count(self, noted: "Noted", counts: np.ndarray) -> None:
        """Adds the occurrences of phrases to the counts of the states that they end in."""
        langs = np.array([self.numbers.get("\n" + x, 0) for x in noted.langs], dtype=np.int64)
        number = np.array([0, *[self.numbers.get(w, 0) for w in noted.known.to_pylist()]], dtype=np.int64)
        state = self.advance(np.zeros(len(langs), dtype=np.int64), langs)[noted.lang]
        for word in noted.words:
            at = np.flatnonzero(word)
            state[at] = self.advance(state[at], number[word[at]])
        alive = np.flatnonzero(state >= 0)
        np.add.at(counts, state[alive], noted.n[alive])


def _words(docs: DataFrame) -> DataFrame:
    """lang, word, its hash, and its occurrences, in parts; a null word stands for all words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Places(part)
            _, first, n = np.unique(s.lang * max(len(s.known), 1) + s.word, return_index=True, return_counts=True)
            word = s.known.take(pa.array(s.word[first])).cast(pa.string())
            lang = pa.array(s.langs, pa.string()).take(pa.array(s.lang[first]))
            hashes = s.hashes(1)[0][first].view(np.int64)
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(hashes), pa.array(n.astype(np.int64))], ["lang", "word", "h", "n"])
            n = np.bincount(s.lang, minlength=len(s.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s.langs, pa.string()), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n)], ["lang", "word", "h", "n"])

    return docs.mapInArrow(work, "lang string, word string, h long, n long").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def _passing(hashes: list[np.ndarray], filters: list[Filter], s: Places, words: int) -> np.ndarray:
    """Places of phrases of so many words whose parts pass the filters of their lengths."""
    at = np.flatnonzero(s.whole(words))
    for k, passes in enumerate(filters[: words], 1):
        for first in range(words - k + 1):
            at = at[passes(hashes[k - 1][at + first])]
    return at


def _tallies(docs: DataFrame, words: int, filters) -> DataFrame:
    """h and n: how often hashes of phrases of so many words occur (LEAST times or more) whose parts pass the filters."""

    def summed(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(h)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        return every[first], np.add.reduceat(np.concatenate(n)[order], first) if len(first) else np.empty(0, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, held = [], [], 0
        for part in slices(batches):
            s = Places(part)
            hashes = s.hashes(words)
            one = np.sort(hashes[-1][_passing(hashes, filters.value, s, words)])
            h.append(one)
            n.append(np.ones(len(one), dtype=np.int64))
            held += len(one)
            if held > 2 * GATHERED:
                one, many = summed(h, n)
                h, n, held = [one], [many], len(one)
                if held > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(many)], ["h", "n"])
                    h, n, held = [], [], 0
        if held:
            one, many = summed(h, n)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(many)], ["h", "n"])

    return docs.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).select("h")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes as hold them all; every array has a number at least."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()))).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // size}").astype(np.int64)


class Noted:
    """A row of the noted phrases: their languages and words by number (words from 1; 0 is none), and their occurrences."""

    FIELDS = [f"word{k}" for k in range(1, WORDS + 1)]
    SCHEMA = "batch int, shard int, piece int, size int, langs array<string>, known string, lang binary, n binary, " + ", ".join(f"{f} binary" for f in FIELDS)

    def __init__(self, row: dict):
        size = row["size"]
        self.shard, self.piece, self.langs, self.known = row["shard"], row["piece"], row["langs"], pa.array(row["known"].split("\n"), pa.large_string())
        self.lang, self.n, *self.words = (_unpacked(row[f], size) for f in ("lang", "n", *self.FIELDS))

    def hashes(self) -> np.ndarray:
        own, added = word_hashes(self.known), seeds(self.langs)[self.lang]
        found = _mixed(own[self.words[0] - 1] + added)
        for word in self.words[1:]:
            at = np.flatnonzero(word)
            found[at] = _joined(found[at], _mixed(own[word[at] - 1] + added[at]))
        return found

    def phrases(self, at: np.ndarray) -> pa.Array:
        """The texts of these phrases."""
        parts = [self.known.take(pa.array(word[at] - 1, mask=word[at] == 0)) for word in self.words]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Noted]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Noted({name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)})


def _noted(docs: DataFrame, shards: int, parts: int, together: int, filters) -> DataFrame:
    """The phrases of 2 or more words that pass the filters, with their occurrences among about NOTED places: a row for each piece
    of the hashes, which belongs to a trie (shard) and its batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            s = Places(part)
            hashes = s.hashes()
            h, lang, words = [], [], []
            for k in range(2, WORDS + 1):
                at = _passing(hashes, filters.value, s, k)
                h.append(hashes[k - 1][at])
                lang.append(s.lang[at])
                words.append(np.stack([s.word[at + j] + 1 if j < k else np.zeros(len(at), dtype=np.int64) for j in range(WORDS)]))
            h, lang, words = np.concatenate(h), np.concatenate(lang), np.concatenate(words, axis=1)
            if len(h):
                own, words = _renumbered(words, len(s.known))
                held.append((h, lang.astype(np.int32), words, s.langs, s.known.take(pa.array(own))))
                size += len(h)
            if size >= NOTED:
                yield from _summed(held, shards, parts, together)
                held, size = [], 0
        if held:
            yield from _summed(held, shards, parts, together)

    return docs.mapInArrow(work, Noted.SCHEMA).repartition(shards * parts, "piece")


def _renumbered(words: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of so many words are in use, and the words by their numbers (from 1) among those."""
    used = np.zeros(known + 1, dtype=bool)
    used[words] = True
    used[0] = False
    own = np.flatnonzero(used)
    number = np.zeros(known + 1, dtype=np.int32)
    number[own] = np.arange(1, len(own) + 1)
    return own - 1, number[words]


def _summed(held: list[tuple], shards: int, parts: int, together: int) -> Iterator[pa.RecordBatch]:
    """Rows of the phrases of several slices: hashes, languages and words by number, and the slices' languages and words."""
    langs = {x: k for k, x in enumerate(dict.fromkeys(x for one in held for x in one[3]))}
    coded = pa.chunked_array([one[4] for one in held]).combine_chunks().dictionary_encode()
    known, number = coded.dictionary, np.asarray(coded.indices, dtype=np.int64) + 1
    first = np.cumsum([0, *[len(one[4]) for one in held]])
    words = np.concatenate([np.append(0, number[low:high])[one[2]] for one, low, high in zip(held, first, first[1:])], axis=1)
    lang = np.concatenate([np.array([langs[x] for x in one[3]], dtype=np.int64)[one[1]] for one in held])
    h = np.concatenate([one[0] for one in held])
    order = np.argsort(h)
    h, lang, words = h[order], lang[order], words[:, order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1]) | (words[:, 1:] != words[:, :-1]).any(axis=0)))
    n = np.diff(np.append(new, len(h)))
    h, lang, words = h[new], lang[new], words[:, new]
    piece = ((h >> np.uint64(32)) * np.uint64(shards * parts) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    edges = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    names = pa.array([list(langs)], pa.list_(pa.string()))
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(h)]):
        own, renumbered = _renumbered(words[:, low:high], len(known))
        text = pa.array(["\n".join(known.take(pa.array(own)).to_pylist())], pa.string())  # a word holds no line's end
        numbers = [pa.array([_packed(x)], pa.binary()) for x in (lang[low:high], n[low:high], *renumbered)]
        shard = int(piece[low]) // parts
        places = [pa.array([int(x)], pa.int32()) for x in (shard // together, shard, piece[low], high - low)]
        yield pa.RecordBatch.from_arrays([*places, names, text, *numbers], ["batch", "shard", "piece", "size", "langs", "known", "lang", "n", *Noted.FIELDS])


class Seen:
    """Hashes that have been seen: many in order, and the last few in an order of their own."""

    def __init__(self):
        self.held = [np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)]

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes (in order) are the first of their kind; from now on they have been seen."""
        found = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        for held in self.held:
            if len(held):
                found &= held[np.minimum(np.searchsorted(held, hashes), len(held) - 1)] != hashes
        many, few = self.held
        few = np.sort(np.concatenate([few, hashes[found]]))
        self.held = [many, few] if 8 * len(few) < len(many) else [np.sort(np.concatenate([many, few])), few[:0]]
        return found


def _candidates(noted: DataFrame) -> DataFrame:
    """h, lang and phrase of all noted phrases; the same one may come from several tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Seen] = {}
        for row in _rows(batches):
            h = row.hashes()
            new = np.flatnonzero(seen.setdefault(row.piece, Seen()).new(h))
            columns = [pa.array(h[new].view(np.int64)), pa.array(row.langs, pa.string()).take(pa.array(row.lang[new])), row.phrases(new)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "phrase"])

    return noted.mapInArrow(work, "h long, lang string, phrase string")


def _trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The trie of one shard: a row with its arrays, its words by number, and its phrases in the order of their keys."""
    split = [["\n" + lang, *phrase.split(" ")] for lang, phrase in zip(rows["lang"], rows["phrase"])]
    often = Counter(w for words in split for w in words)
    words = sorted(often, key=lambda w: (-often[w], w))  # words of many phrases next to each other: families are denser
    number = {w: k for k, w in enumerate(words, 1)}
    numbers = np.zeros((len(split), WORDS + 1), dtype=np.int64)
    length = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    numbers[np.arange(WORDS + 1) < length[:, None]] = [number[w] for words in split for w in words]
    order = np.lexsort(numbers.T[::-1])
    base, check, ends = double_array(digits(numbers[order]).reshape(len(split), -1).astype(np.uint8), DIGITS * length[order])
    arrays = {"base": [base.tobytes()], "check": [check.tobytes()], "ends": [ends.tobytes()], "words": [words]}
    phrases = {"langs": [rows["lang"].to_numpy()[order].tolist()], "phrases": [rows["phrase"].to_numpy()[order].tolist()]}
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])]} | arrays | phrases)


def _counts(noted: DataFrame, tries) -> DataFrame:
    """shard, place (of a phrase in it) and a: how often these tries' phrases are noted, if LEAST times or more.

    Tasks hand on blocks of counts; those of a block meet in order and are added up one by one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Trie(*arrays) for k, arrays in tries.value.items()}
        counts = {k: np.zeros(len(trie.base), dtype=np.int64) for k, trie in held.items()}
        for row in _rows(batches):
            if row.shard in held:  # else none of its phrases is a candidate
                held[row.shard].count(row, counts[row.shard])
        for shard, trie in held.items():
            n = counts[shard][trie.ends]
            for block in range(0, len(n), BLOCK):
                own = n[block : block + BLOCK]
                if own.any():  # four bytes a count, if they hold them
                    data = own.astype(np.int32 if own.max() < 1 << 31 else np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "size": pa.array([len(own)], pa.int32()), "counts": pa.array([data], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, np.empty(0, dtype=np.int64)
        for batch in batches:
            for shard, block, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (shard, block):
                    if place:
                        yield told(place, total)
                    place, total = (shard, block), np.zeros(size, dtype=np.int64)
                total += np.frombuffer(data, dtype=np.int32 if len(data) == 4 * size else np.int64)
        if place:
            yield told(place, total)

    def told(place: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total >= LEAST)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place[0], dtype=np.int32)), pa.array((place[1] + some).astype(np.int32)), pa.array(total[some])], ["shard", "place", "a"])

    parts = noted.mapInArrow(work, "shard int, block int, size int, counts binary")
    return parts.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(summed, "shard int, place int, a long")


def _scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """l, r and score of the lowest-scoring cut of every phrase; phrases that a longer one covers are left out."""
    facts = words.filter("word IS NOT NULL").select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        phrases.filter(F.size(F.split("phrase", " ")) < WORDS).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    w = F.split("phrase", " ")
    joined = lambda first, n: F.array_join(F.slice(w, first, n), " ")
    cut = lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("head"), joined(k + 1, F.size(w) - k).alias("rest"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(facts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(facts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")
    longer = phrases.filter(F.size(w) == WORDS).select("lang", "a", F.explode(F.array(joined(F.lit(1), F.lit(WORDS - 1)), joined(F.lit(2), F.lit(WORDS - 1)))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    return best.join(around, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * around < {COVERED} * a")


def _first(scored: DataFrame) -> DataFrame:
    """The first TOP of each language. A coarse histogram of scores leaves out, before the ranking, what cannot be among them."""
    step = F.shiftright(F.col("score"), 10)
    levels = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("some"))  # a language has about 1,000 at most
    above = F.sum("some").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    lowest = levels.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < TOP).groupBy("lang").agg(F.min("step").alias("lowest"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.join(lowest, "lang").filter(step >= F.col("lowest")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def phrase_counts(docs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of the words with LEAST occurrences, a null word for all words of a language, and (lang, phrase, a) of the
    phrases with as many. ``keep`` writes a table and reads it again."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    words = keep(_words(docs).filter(f"n >= {LEAST} OR word IS NULL"))
    filters = [hash_filter(words.filter("word IS NOT NULL").select("h"))]
    passed = None
    for k in range(2, WORDS + 1):
        shared = sc.broadcast(filters)
        level = keep(_tallies(docs, k, shared))
        shared.unpersist()
        filters = [*filters, hash_filter(level)]
        passed = level if passed is None else passed.unionByName(level)
    shards, together = math.ceil(passed.count() / SHARD_KEYS), max(BATCH_KEYS // SHARD_KEYS, 1)
    parts = math.ceil(PIECES / max(shards, 1))
    if not shards:
        return words, spark.createDataFrame([], "lang string, phrase string, a long")
    shared = sc.broadcast(filters)
    noted = keep(_noted(docs, shards, parts, together, shared), "batch")
    shared.unpersist()
    once = _candidates(noted).repartition("h").dropDuplicates(["h", "lang", "phrase"])  # before the join, by the same shuffle
    found = keep(once.join(passed.hint("shuffle_hash"), "h", "left_semi"))
    own = F.expr(f"CAST(shiftright(shiftrightunsigned(h, 32) * {shards * parts}L, 32) div {parts} AS INT)")  # as in _summed
    schema = "shard int, base binary, check binary, ends binary, words array<string>, langs array<string>, phrases array<string>"
    tries = keep(found.select(own.alias("shard"), "lang", "phrase").groupBy("shard").applyInPandas(_trie, schema))
    rows = {r.batch: r.rows for r in noted.groupBy("batch").agg(F.sum("size").alias("rows")).collect()}
    counted = None
    for number, some in sorted(rows.items()):  # each batch of tries counts what was noted for it
        low = number * together
        batch = tries.filter(f"shard >= {low} AND shard < {low + together}").select("shard", "base", "check", "ends", "words").collect()
        sent = sc.broadcast({r.shard: (bytes(r.base), bytes(r.check), bytes(r.ends), r.words) for r in batch})
        del batch
        given = noted.filter(f"batch = {number}").coalesce(max(sc.defaultParallelism, math.ceil(some / COUNTED)))
        one = keep(_counts(given, sent))
        sent.unpersist()
        counted = one if counted is None else counted.unionByName(one)
    phrases = tries.select("shard", F.posexplode(F.arrays_zip("langs", "phrases")).alias("place", "p")).join(counted, ["shard", "place"])
    return words, keep(phrases.select(F.col("p.langs").alias("lang"), F.col("p.phrases").alias("phrase"), "a"))


def collocations(docs: DataFrame) -> DataFrame:
    """The contract's rows: each language's first TOP phrases."""
    with scratch(docs.sparkSession) as keep:
        words, phrases = phrase_counts(docs, keep)
        found = _first(keep(_scored(words, phrases)))
        total = words.filter("word IS NULL").select("lang", F.col("n").alias("n"))
        found = found.join(total, "lang")
        return written(found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
),
p AS (SELECT row, lang, generate_subscripts(pieces, 1) AS piece, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
w AS (SELECT row, lang, piece, generate_subscripts(w, 1) AS pos, unnest(w) AS a FROM p),
x AS (SELECT lang, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM w WINDOW q AS (PARTITION BY row, piece ORDER BY pos)),
g AS (
  SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM x GROUP BY lang, a
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM x WHERE b IS NOT NULL GROUP BY lang, a, b
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM x WHERE c IS NOT NULL GROUP BY lang, a, b, c
),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= 10),
cuts AS (
  SELECT key, lang, phrase, k, f, cut, lang || chr(10) || array_to_string(w[1 : cut], ' ') AS head, lang || chr(10) || array_to_string(w[cut + 1 :], ' ') AS rest
  FROM h, (VALUES (1), (2)) AS u(cut) WHERE cut < k
),
scored AS (
  SELECT x.key, x.lang, x.phrase, x.f AS a, cut, l.f AS l, r.f AS r, (1000000 * CAST(x.f AS HUGEINT) * x.f) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts x JOIN h l ON l.key = x.head JOIN h r ON r.key = x.rest
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, cut) = 1),
longer AS (
  SELECT key, max(f) AS around FROM (
    SELECT lang || chr(10) || array_to_string(w[1 : 2], ' ') AS key, f FROM h WHERE k = 3 UNION ALL SELECT lang || chr(10) || array_to_string(w[2 : 3], ' '), f FROM h WHERE k = 3
  ) GROUP BY key
),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.key = b.key WHERE o.around IS NULL OR 100 * o.around < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
