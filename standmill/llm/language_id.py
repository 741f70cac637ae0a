"""Language ID with a string kernel.

The kernel of two texts is the number of n-grams (n = 1 to 3, letters folded to lower case, anything else a gap) that
both hold, over the root of the product of how many each holds: a blended-spectrum presence kernel. N-grams of other
than one letter are hashed to a fixed number of places. A bounded, balanced sample of labelled texts gives landmarks
(the Nystroem map is the kernel to the landmarks times the inverse root of their own kernel matrix) and the training
set of one-versus-rest kernel ridge regressions. A batch of texts is scored by three matrix products.

Every language is learned: the sample has at most SAMPLE rows in all, shared evenly, but LEAST_TEXTS of each language
where it has them, and the landmarks grow with the number of languages.

Defined results: a null text, or one without letters, is ``und`` with score 0; a null id or language is not learned
from; of several texts of one id and language the least in order is learned from; with no labelled row at all every text
is ``und``; equally likely languages give the first in order; very long texts count whole; every row gives a row, with
repeated ids too; an empty table gives an empty result; columns other than doc_id, text and lang are ignored, whatever
their names, unless they are asked to be carried on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standmill.llm.common import add_by_slices, carried, held_out, map_slices

#: Places for n-grams.
PLACES = 8192
#: Bounds of the sample: labelled texts per language, in all, and of each language where SAMPLE does not give more.
TEXTS_PER_LANGUAGE, SAMPLE, LEAST_TEXTS = 256, 16_384, 8
#: Landmarks, and of each language where these do not give more.
LANDMARKS, LEAST_LANDMARKS = 192, 3
RIDGE, SHARPNESS = 1e-2, 6.0
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """A number for each code point: 0 if it is no letter, else one that its lower case has too."""
    code = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            code[c] = ord(x.lower()[0])
    return code


_CODE: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """The folded letters of a text, with 0 for anything else."""
    global _CODE
    if _CODE is None:
        _CODE = _letters()
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _place(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def presence(text: str | None) -> np.ndarray | None:
    """Which places the n-grams of the whole text take; None without letters."""
    code = letters(text or "")
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]])
    code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # one gap in a row
    found = np.zeros(PLACES, dtype=bool)
    two = code[:-1] * np.int64(0x110000) + code[1:]
    three = two[:-1] * np.int64(1_000_003) + code[2:]
    for grams in (code[code != 0], two, three):
        found[_place(grams)] = True
    return found


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # places x landmarks, each column of length 1
    weights: np.ndarray  # landmarks x languages: the Nystroem map and the regressions

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Texts x languages, each row a distribution."""
        rows = found.astype(np.float32)
        rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        raw = (rows @ self.landmarks) @ self.weights
        raw = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        return raw / raw.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame) -> DataFrame:
    """The bounded sample: of each language the ids that hash lowest, with a text each as packed presence bits."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    )
    ids = usable.select("doc_id", "lang").distinct().withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("size"))
    each = min(TEXTS_PER_LANGUAGE, max(LEAST_TEXTS, SAMPLE // max(1, sizes.count())))
    # the lowest are almost surely below this share of the range, so that few rows of a language meet in one task
    low = ids.join(F.broadcast(sizes), "lang").filter(F.col("place") <= F.lit(2.0**63) * 4 * each / F.col("size"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    picked = low.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("doc_id", "lang")
    one = usable.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bits = [presence(t) for t in part.column("text").to_pylist()]
        packed = pa.array([None if b is None else np.packbits(b).tobytes() for b in bits], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), packed], ["doc_id", "lang", "bits"])

    return map_slices(one.select("doc_id", "lang", "text"), work, "doc_id long, lang string, bits binary").filter("bits IS NOT NULL")


def fit(docs: DataFrame) -> Model | None:
    """Learns from the sample (rows of 1 KB, one an id and language); None without any."""
    rows = sorted((r.lang, r.doc_id, bytes(r.bits)) for r in training_rows(docs).collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    found = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, :PLACES].astype(np.float64)
    found /= np.sqrt(found.sum(axis=1, keepdims=True))
    place = {name: k for k, name in enumerate(languages)}
    label = np.array([place[r[0]] for r in rows])
    turn = np.arange(len(label)) - np.searchsorted(label, label)  # rows are in order of languages
    picked = np.lexsort((label, turn))[: max(LANDMARKS, LEAST_LANDMARKS * len(languages))]  # languages in turn
    marks = found[picked]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = found @ marks.T @ root
    weight = 1 / np.bincount(label)[label] / len(languages)
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    scaled = features * weight[:, None]
    solved = np.linalg.solve(scaled.T @ features + RIDGE / len(picked) * np.eye(len(picked)), scaled.T @ target)
    return Model(languages, marks.T.astype(np.float32).copy(), (root @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; with carry, also text and ``kept``, a struct of all
    other columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        model, n = shared.value, part.num_rows
        names, scores = [UNDETERMINED] * n, [0.0] * n
        texts = part.column("text").to_pylist() if model is not None else []
        for start in range(0, len(texts), 256):
            found = [(i, b) for i in range(start, min(n, start + 256)) if (b := presence(texts[i])) is not None]
            if found:
                got = model.scores(np.array([b for _, b in found]))
                for (i, _), k, s in zip(found, got.argmax(axis=1).tolist(), got.max(axis=1).tolist()):
                    names[i], scores[i] = model.languages[k], min(1.0, float(s))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"), *[carried(docs)] * carry)
    out = add_by_slices(picked, work, "lang_pred string, score double")
    return out.select("doc_id", "held_out", "lang_pred", "score", *["text", "kept"] * carry)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from docs (doc_id, text, lang) and predicts every row."""
    return predict(docs, fit(docs))
