"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows is learned from. A text's terms are its whole lower-case words and, with STEM_WEIGHT times the
weight, their beginnings of STEM characters (inflected forms share them); in scripts that are written without spaces, all
pairs of neighbouring characters. Every character of the whole text counts. A text becomes its TF-IDF vector, of length 1, over all terms of the
examples, with document frequencies counted over all documents; no term is picked or left out for its label. The
examples' vectors form a block-max inverted index: the short lists of rare terms are summed up, frequent terms have rows in
blocks of examples and the largest weight of each in each block, and blocks whose sums and largest weights together stay
below the k-th best cosine are not opened. Several texts are searched together, in single precision within stated errors;
what may be among the k nearest is then counted exactly, each text on its own, so the k nearest are exact. Their
labels vote with weights that fall with distance, against a prior. Votes are calibrated by a rising step function,
fitted to the examples' own votes with each left out in turn; the neighbours are returned as evidence.

Scale: EXAMPLES rows at most come to the driver, as Arrow columns, and the index is broadcast; its size follows the sample. The
driver holds postings alone: tables by blocks are made where the index is searched, in tasks, the examples' own votes
included. Counting and scoring are one narrow pass each over all documents.

Defined results: a null or empty text, or one without any term of the examples, has the rate of toxic examples among such
texts as its score; with no usable labels, or no document that has one, the score is 0; several labels of one id count as
the highest; of several texts of a labelled id the least in order is learned from; null labels and ids are not learned
from; very long texts count whole; equally near examples, and copies of them, come in the order of the index, which does
not depend on partitions; every row gives a row, with repeated ids too; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names, unless they are asked to be kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standmill.llm.common import add_by_slices, carried, held_out, map_slices, slices

#: Labelled rows that are learned from, at most.
EXAMPLES = 2_000
#: Characters of a word's beginning, and its weight beside the whole word.
STEM, STEM_WEIGHT = 4, 4
#: Examples in a block, neighbours, and weight of the prior.
BLOCK, NEIGHBOURS, PRIOR_WEIGHT = 64, 15, 0.1
#: Terms (those of most examples, and of a share of them at least) whose postings are kept as whole rows of a block.
ROWS, ROW_SHARE = 512, 1 / 32
#: Blocks that are opened at first (then those whose bounds still reach), and examples (evenly chosen) that votes are calibrated with.
FIRST_OPENED, CALIBRATION = 8, 2_000
#: Share of the uncalibrated vote in a score: it keeps the order within a step.
RAW_SHARE = 0.02
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
#: Texts that are searched together, and a bound of the relative error of sums of ROWS products without negative ones in
#: single precision (twice over: ROWS * 2 ** -24 is 3.1e-5).
TOGETHER, MARGIN = 64, 1e-4
#: Unlike signs beyond ASCII, at most, that are taken out of a text one by one.
SIGNS = 32
#: For ASCII: a lower-case letter, digit or underscore, or else a space.
_SPACED = "".join(chr(c).lower() if chr(c).isalnum() or chr(c) == "_" else " " for c in range(128))
_SPACED_BYTES, _ASCII_BYTES = _SPACED.encode() + bytes(range(128, 256)), bytes(range(128))
#: Thai to Lao, Myanmar, Khmer, kana, and Han characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def words(text: str) -> tuple[list[str], list[str]]:
    """The lower-case words of a text (what ``_WORD`` finds), and the pairs of unspaced characters, with repeats."""
    if text.isascii():
        return text.translate(_SPACED).split(), []
    text = text.lower()
    coded = text.encode("utf-8", "surrogatepass")
    others = coded.translate(None, _ASCII_BYTES).decode("utf-8", "surrogatepass")  # the characters beyond ASCII
    pairs: list[str] = []
    if _UNSPACED.search(others):
        pairs = [run[k : k + 2] for run in _UNSPACED.findall(text) for k in range(max(1, len(run) - 1))]
        return _WORD.findall(_UNSPACED.sub(" ", text)), pairs
    signs = [c for c in set(others) if not c.isalnum()]
    if len(signs) > SIGNS:
        return _WORD.findall(text), pairs
    text = coded.translate(_SPACED_BYTES).decode("utf-8", "surrogatepass")
    for c in signs:
        text = text.replace(c, " ")
    return text.split(), pairs


def term_counts(text: str | None) -> dict[str, int]:
    """Weighted numbers of the text's terms. A whole word is a term of its own if it is longer than its beginning."""
    found_words, pairs = words(text or "")
    found = {t: STEM_WEIGHT * n for t, n in Counter(pairs).items()}
    for word, n in Counter(found_words).items():
        if len(word) > STEM:
            found[word] = n
            word = word[:STEM]
        found[word] = found.get(word, 0) + STEM_WEIGHT * n
    return found


class Numbers:
    """The numbers of the known terms of texts."""

    def __init__(self, known: dict[str, int]) -> None:
        self.short = {t: n for t, n in known.items() if len(t) <= STEM}
        # of a known word: 2 ** 32 times its number plus that of its beginning, both counted from 1, with 0 for what is no term of its own
        self.both = {t: n + 1 if len(t) <= STEM else (n + 1 << 32) + self.short.get(t[:STEM], -1) + 1 for t, n in known.items()}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the whole words, and of their beginnings and the pairs of a text, with repeats; -1 where a term is not
        known, and for whole words that are no terms of their own."""
        found, pairs = words(text or "")
        both = np.fromiter(map(self.both.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        unknown = np.flatnonzero(both < 0)
        begun = [found[k][:STEM] for k in unknown.tolist()]
        both[unknown] = np.fromiter(map(self.short.get, begun, repeat(-1)), dtype=np.int64, count=len(begun)) + 1
        beginning = (both & 0xFFFFFFFF) - 1
        if pairs:
            beginning = np.append(beginning, np.fromiter(map(self.short.get, pairs, repeat(-1)), dtype=np.int64, count=len(pairs)))
        return (both >> 32) - 1, beginning


@dataclass
class Index:
    """Block-max inverted index of the examples' vectors."""

    known: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    held: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))  # postings of each term; they stand in the order of terms and examples
    examples: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    numbers: Numbers | None = None  # Made by ``open``, as are the next eight
    first: np.ndarray | None = None  # posting of a term
    row: np.ndarray | None = None  # of a term in a block's rows, or -1: its postings are in a list
    rows: np.ndarray | None = None  # blocks x rows x BLOCK, single precision
    most: np.ndarray | None = None  # rows x blocks, single precision
    edges: np.ndarray | None = None  # of the examples in the next two
    terms: np.ndarray | None = None  # of one example after the other, in order
    theirs: np.ndarray | None = None  # weights of these terms
    dense: np.ndarray | None = None  # room for a vector
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))  # votes, and how often they were right
    prior: float = 0.0  # of examples with terms
    empty: float = 0.0  # of examples without

    def __getstate__(self) -> dict:
        return self.__dict__ | dict.fromkeys(("numbers", "first", "row", "rows", "most", "edges", "terms", "theirs", "dense"))

    def open(self) -> None:
        """Makes the tables by blocks and by examples from the postings."""
        terms, blocks = len(self.held), -(-len(self.ids) // BLOCK)
        self.numbers = Numbers(self.known)
        self.first = np.cumsum(self.held) - self.held
        by_count = np.argsort(-self.held, kind="stable")[:ROWS]
        by_count = by_count[self.held[by_count] >= max(1, ROW_SHARE * len(self.ids))]
        self.row = np.full(terms, -1)
        self.row[by_count] = np.arange(len(by_count))
        self.rows = np.zeros((blocks, len(by_count), BLOCK), dtype=np.float32)
        row = np.repeat(self.row, self.held)
        kept = row >= 0
        self.rows[self.examples[kept] // BLOCK, row[kept], self.examples[kept] % BLOCK] = self.weights[kept]
        self.most = np.ascontiguousarray(self.rows.max(axis=2).T)
        order = np.argsort(self.examples, kind="stable")
        self.edges = np.searchsorted(self.examples[order], np.arange(len(self.ids) + 1))
        self.terms, self.theirs = np.repeat(np.arange(terms, dtype=np.int32), self.held)[order], self.weights[order]
        self.dense = np.zeros(terms)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's known terms, in order, and their weights; both empty where no term weighs anything."""
        if self.numbers is None:
            self.open()
        whole, beginning = self.numbers.of(text)
        found = np.concatenate([2 * whole, 2 * beginning + 1])  # negative: not known
        found.sort()
        found = found[np.searchsorted(found, 0) :]
        at = found >> 1
        edges = np.flatnonzero(np.diff(at, prepend=-1))
        return self.weighted(at[edges], np.add.reduceat(np.where(found & 1, float(STEM_WEIGHT), 1.0), edges)) if len(edges) else (at, np.empty(0))

    def weighted(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of terms, given by their numbers in order, that are there so many times."""
        weight = number * self.idf[at]
        length = math.sqrt(float(weight @ weight))
        return (at, weight / length) if length else (at[:0], weight[:0])

    def listed(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over the postings of these terms for all examples."""
        count = self.held[at]
        ends = np.cumsum(count)
        place = np.repeat(self.first[at] - ends + count, count)
        place += np.arange(len(place))
        return np.bincount(self.examples[place], self.weights[place] * np.repeat(weight, count), self.most.shape[1] * BLOCK)

    def cosines(self, at: np.ndarray, weight: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Cosines of a vector with some examples, which do not depend on what else is asked for."""
        self.dense[at] = weight
        parts = [slice(*e) for e in zip(self.edges[examples].tolist(), self.edges[examples + 1].tolist())]
        terms, weights = (np.concatenate([values[p] for p in parts]) for values in (self.terms, self.theirs))
        starts = np.cumsum([0] + [p.stop - p.start for p in parts[:-1]])
        found = np.round(np.add.reduceat(self.dense[terms] * weights, starts), 12)
        self.dense[at] = 0
        return found

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of these (TOGETHER at most) the numbers and cosines of the k nearest examples with a cosine above 0; ties
        go to the lower number."""
        if self.most is None:
            self.open()
        sums = np.empty((len(vectors), self.most.shape[1], BLOCK), dtype=np.float32)
        inside = np.zeros((len(vectors), self.most.shape[0]), dtype=np.float32)
        for n, (at, weight) in enumerate(vectors):
            row = self.row[at]
            kept = row >= 0
            inside[n, row[kept]] = weight[kept]
            sums[n] = self.listed(at[~kept], weight[~kept]).reshape(-1, BLOCK)
        bound = (sums.max(axis=2) + inside @ self.most) * (1 + MARGIN)
        found, opened = np.zeros_like(sums), np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(opened, np.argsort(-bound, axis=1)[:, :FIRST_OPENED], True, axis=1)

        def open_blocks(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(axis=0)):
                of = np.flatnonzero(which[:, b])
                found[of, b] = sums[of, b] + inside[of] @ self.rows[b]

        def reached(cosines: np.ndarray) -> np.ndarray:
            """What the k-th best of a row's cosines is at least."""
            best = np.partition(cosines.reshape(len(vectors), -1), -k, axis=1)[:, -k:][:, :1]
            return np.maximum(0, best * (1 - MARGIN) - 1e-9)

        open_blocks(opened)
        open_blocks(~opened & (bound >= reached(found[opened])))  # as many at first for each vector
        least = reached(found)
        for (at, weight), row, limit in zip(vectors, found.reshape(len(vectors), -1), least[:, 0]):
            best = np.flatnonzero((row >= limit) & (row > 0))
            score = self.cosines(at, weight, best) if len(best) else np.empty(0)
            kept = np.lexsort((best, -score))[:k]
            kept = kept[score[kept] > 0]
            yield best[kept], score[kept]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float, list[int]]]:
        """For each vector the neighbours' vote, weighted by closeness, and their numbers; an example of each may be left out."""
        for start in range(0, len(vectors), TOGETHER):
            found = self.nearest(vectors[start : start + TOGETHER], NEIGHBOURS + (without is not None))
            for n, (best, cosine) in enumerate(found, start):
                kept = best != (-1 if without is None else without[n])
                best, close = best[kept][:NEIGHBOURS], cosine[kept][:NEIGHBOURS] ** 2
                yield (float(close @ self.labels[best]) + PRIOR_WEIGHT * self.prior) / (float(close.sum()) + PRIOR_WEIGHT), best.tolist()

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int]]]:
        """For each text the calibrated vote, and the neighbours' ids."""
        for start in range(0, len(texts), TOGETHER):
            vectors = list(map(self.vector, texts[start : start + TOGETHER]))
            found = self.votes([v for v in vectors if len(v[0])])
            for at, _ in vectors:
                if not len(at):
                    yield self.empty, []
                    continue
                vote, best = next(found)
                rate = float(np.interp(vote, *self.steps))
                yield min(1.0, max(0.0, (1 - RAW_SHARE) * rate + RAW_SHARE * vote)), self.ids[best].tolist()


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of votes that is nearest to the labels, as points to interpolate between."""
    order = np.lexsort((labels, votes))
    parts: list[list[float]] = []  # sum of labels, rows, sum of votes
    for x, y in zip(votes[order].tolist(), labels[order].tolist()):
        parts.append([y, 1, x])
        while len(parts) > 1 and parts[-2][0] * parts[-1][1] >= parts[-1][0] * parts[-2][1]:
            last = parts.pop()
            parts[-1] = [a + b for a, b in zip(parts[-1], last)]
    return np.array([p[2] / p[1] for p in parts]), np.array([p[0] / p[1] for p in parts])


def build_index(known: dict[str, int], idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Index:
    """The index before its votes are calibrated. rows: id, label, and numbers (in order) and counts of the terms of each example."""
    index = Index(known=known, idf=idf)
    vectors = [(i, y, *index.weighted(at, number)) for i, y, at, number in rows]
    bare = [y for _, y, at, _ in vectors if not len(at)]
    index.empty = sum(bare) / (len(bare) + 1)
    vectors = [v for v in vectors if len(v[2])]
    if not vectors:
        return index
    # examples that share their heaviest frequent term, and then their heaviest one, stand together: the bounds of blocks are tight
    index.held = np.bincount(np.concatenate([at for _, _, at, _ in vectors]), minlength=len(known)).astype(np.int32)
    frequent = index.held >= np.sort(index.held)[::-1][: max(1, len(known) // 50)][-1]
    lead = lambda at, w: (int(at[np.argmax(np.where(frequent[at], w, -1))]), int(at[np.argmax(w)]))
    vectors.sort(key=lambda v: (*lead(v[2], v[3]), v[0]))
    index.ids, index.labels = np.array([v[0] for v in vectors]), np.array([float(v[1]) for v in vectors])
    index.prior = float((index.labels.sum() + 1) / (len(vectors) + 2))
    order = np.argsort(np.concatenate([v[2] for v in vectors]), kind="stable")
    index.examples = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[2]) for v in vectors])[order]
    index.weights = np.concatenate([v[3] for v in vectors])[order]
    return index


def calibrate(spark: SparkSession, index: Index) -> None:
    """Fits the steps to the examples' own votes, each left out in turn, which tasks count."""
    if not len(index.ids):
        return
    shared = spark.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        if index.most is None:
            index.open()
        for part in batches:
            numbers = part.column("id").to_pylist()
            own = [slice(index.edges[n], index.edges[n + 1]) for n in numbers]
            votes = [v for v, _ in index.votes([(index.terms[o], index.theirs[o]) for o in own], numbers)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(votes, pa.float64())], ["id", "vote"])

    tried = spark.range(0, len(index.ids), max(1, -(-len(index.ids) // CALIBRATION)))
    found = tried.mapInArrow(work, "id long, vote double").toArrow()  # CALIBRATION rows at most
    index.steps = isotonic(found["vote"].to_numpy(), index.labels[found["id"].to_numpy()])


def sample(labels: DataFrame) -> DataFrame:
    """The bounded sample that is learned from: doc_id and toxic of the labelled rows whose ids hash lowest."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)


def example_counts(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The terms of the sampled examples (EXAMPLES rows at most) with their numbers; and each one's id, label, and numbers (in
    order) and counts of its terms."""
    picked = [(r.doc_id, r.toxic) for r in sample(labels).collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int"))
    examples = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [term_counts(t) for t in part.column("text").to_pylist()]
        arrays = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *arrays], ["doc_id", "toxic", "terms", "counts"])

    rows = map_slices(examples, counted, "doc_id long, toxic int, terms array<string>, counts array<long>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return {}, []
    terms, counts = (rows[c].chunk(0) for c in ("terms", "counts"))
    coded = terms.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    edges = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy()))
    at, number = rank[coded.indices.to_numpy()], counts.flatten().to_numpy().astype(np.float64)
    sorted_at = np.lexsort((at, np.repeat(np.arange(len(edges) - 1), np.diff(edges))))
    parts = [(at[o], number[o]) for o in np.split(sorted_at, edges[1:-1])]
    return {names[k]: i for i, k in enumerate(order)}, [(i, y, *p) for i, y, p in zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), parts)]


def document_frequencies(docs: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each known term is, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, rows = Numbers(shared.value), 0
        sums = np.zeros(len(shared.value) + 1, dtype=np.int64)  # the last: terms that are not known
        for part in slices(batches):
            rows += part.num_rows
            for text in part.column("text").to_pylist():
                sums[np.concatenate(numbers.of(text))] += 1  # once for a repeated term
        at = np.flatnonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], rows))], ["term", "n"])

    out = np.zeros(len(known) + 1, dtype=np.int64)
    found = docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a known term
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known, rows = example_counts(docs, labels)
    if not known:
        return build_index(known, np.empty(0), rows)
    n, total = document_frequencies(docs, known)
    index = build_index(known, np.maximum(0.0, np.log((total + 1) / (n + 0.5))), rows)
    calibrate(docs.sparkSession, index)
    return index


def score(docs: DataFrame, index: Index, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and neighbours (the evidence) for every row of docs; with carry, also text and
    ``kept``, a struct of all other columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        found = list(shared.value.scores(part.column("text").to_pylist()))
        return [pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.list_(pa.int64()))]

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"), *[carried(docs)] * carry)
    out = add_by_slices(picked, work, "score double, neighbours array<bigint>").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return out.select("doc_id", "held_out", "score", "predicted", "neighbours", *["text", "kept"] * carry)
