"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one bit for each failed rule;
policies are versioned masks over these bits, applied later without touching the texts, and ablations (what a policy
would keep without one of its rules) come from one aggregation over the distinct masks.

Defined results: a null text counts as empty; empty texts have no words and fail ``few_words``; very long texts
count whole; repeated rows and repeated ids give a row each; an empty table gives an empty ledger; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import map_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 8

#: Bits of the ledger.
RULES = {
    "few_words": 1,
    "repeated_windows": 2,
    "symbols": 4,
    "upper_case": 8,
    "duplicate_lines": 16,
    "long_words": 32,
    "exclamations": 64,
    "few_letters": 128,
}
#: Policies by (name, version): the document is kept if none of these bits is set.
POLICIES = {
    ("base", 1): RULES["few_words"] | RULES["repeated_windows"],
    ("standard", 1): RULES["few_words"] | RULES["repeated_windows"] | RULES["symbols"] | RULES["upper_case"],
    ("strict", 1): sum(RULES.values()),
}

_SPACE, _SYMBOL, _UPPER, _LOWER, _EXCLAMATION = 1, 2, 3, 4, 5
_CLASSES = np.zeros(256, dtype=np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASSES[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
_CLASSES[ord("A") : ord("Z") + 1] = _UPPER
_CLASSES[ord("a") : ord("z") + 1] = _LOWER
_CLASSES[ord("!")] = _EXCLAMATION

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclamations")
_MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES)


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of 8 words found twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    grams = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + grams[i : i + n].astype(np.uint64)
    if len(np.unique(mixed)) == n:  # different hashes: no window is repeated
        return 0
    for step in (1, 2, 4):  # exact: ids of pairs, then of pairs of pairs, then of whole windows
        grams = grams - grams.min()
        _, grams = np.unique(grams[:-step] * (int(grams.max()) + 1) + grams[step:], return_inverse=True)
    found = np.bincount(grams)[grams] > 1
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    kinds = np.bincount(_CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=6)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), len(text) - int(kinds[_SPACE]), int(kinds[_SYMBOL]), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), int(kinds[_UPPER]), int(kinds[_LOWER]), int(kinds[_EXCLAMATION]),
    )


def measure(docs: DataFrame) -> DataFrame:
    """One row of measurements for every row of docs (doc_id, text)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_measure(t) for t in part.column("text").to_pylist()]
        columns = list(zip(*rows)) or [[] for _ in MEASURES]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, _MEASURED)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that the document fails."""
    c = F.col
    rules = {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 2 * c("n_words"),
        "upper_case": c("n_upper") > 2 * c("n_lower"),
        "duplicate_lines": 100 * c("n_dup_lines") > 40 * c("n_lines"),
        "long_words": c("word_chars") > 12 * c("n_words"),
        "exclamations": 2 * c("n_exclamations") > c("n_words"),
        "few_letters": 2 * (c("n_upper") + c("n_lower")) < c("word_chars"),
    }
    bits = sum((F.when(rule, F.lit(RULES[name])).otherwise(F.lit(0)) for name, rule in rules.items()), F.lit(0))
    return measure(docs).withColumn("failed", bits.cast("long"))


def apply_policy(book: DataFrame, name: str, version: int = 1) -> DataFrame:
    """Adds ``kept``: none of the policy's bits has failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[name, version])) == 0)


def ablations(book: DataFrame, name: str, version: int = 1) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy without it would keep."""
    mask = POLICIES[name, version]
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))  # 2^rules rows at most
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("bit")) for k, v in RULES.items() if v & mask]))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def quality(docs: DataFrame) -> DataFrame:
    """The contract's row for every document, under the standard policy."""
    base = POLICIES["base", 1]
    return apply_policy(ledger(docs), "standard").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed",
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM m),
g AS (
  SELECT doc_id, pos, word,
    lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS d, lead(word, 4) OVER p AS e,
    lead(word, 5) OVER p AS f, lead(word, 6) OVER p AS g, lead(word, 7) OVER p AS h
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e, f, g, h) AS n FROM g WHERE h IS NOT NULL),
s AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM r, range(8) AS t(k) WHERE n > 1 GROUP BY doc_id),
t AS (
  SELECT m.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
    length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM m LEFT JOIN s USING (doc_id)
),
u AS (
  SELECT *, CAST(
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN n_upper > 2 * n_lower THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_exclamations > n_words THEN 64 ELSE 0 END + CASE WHEN 2 * (n_upper + n_lower) < word_chars THEN 128 ELSE 0 END
  AS BIGINT) AS failed FROM t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 15) = 0 AS kept, failed FROM u
"""
