"""Personal data by bootstrapped contextual extraction.

Four base expressions find emails, IP addresses, card numbers and phone numbers. These seed a bootstrap. A pattern is a
context: the two words on one side of an identifier, with digits folded. Patterns and instances (the distinct texts of
base spans, which are the seeds, and of identifier-like tokens outside them) form a graph that Spark scores in a few
rounds: a pattern is as reliable as its instances are on average, a seed is certain, and any other instance is as
reliable as the best pattern it is met by. All scores start from seeds, so what no chain of contexts links to a seed
stays at 0. Reliable patterns with enough distinct instances then mark the other identifiers beside them in the texts.
The base spans always stay, and no other span may overlap them. Frequent trusted patterns are broadcast; mentions of
others are joined with the table of all trusted patterns. Patterns are 64-bit hashes of whole words, but that of a word
longer than LONGEST the LONGEST characters beside the identifier count.

Defined results: a null text counts as empty and has no spans; very long texts and tokens count whole; of a pattern's
instances repeated ones count once, so copies of a text add nothing; of equally frequent trusted patterns those with the
lower hash are broadcast, which changes no result; every row gives a row, with repeated ids too (their added spans are
found in each text itself); an empty table, or one without base spans, adds no spans; columns other than doc_id and text
are ignored, whatever their names, and mask() carries them on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standmill.llm.common import add_by_slices, carried, map_slices, restored, written

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that the method adds.
ADDED = "id"
#: A pattern is trusted from this reliability on, with so many distinct instances; rounds of scoring.
RELIABLE, SUPPORT, ROUNDS = 0.9, 5, 8
#: So many trusted patterns (those with most instances) are broadcast.
PATTERNS = 10_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL_CHARS, _TOKEN_CHARS = frozenset(_ALNUM + "._%+-"), frozenset(_ALNUM + "._@/+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An identifier-like token: a long run of letters, digits and joining marks that has a digit; quotes and the like stay outside.
_TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._@/+-]*[A-Za-z0-9])?")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONGEST = 1024


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: every @ is looked at once, its local part reaches back to the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (in code points) of each kind, leftmost and not overlapping within a kind."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = list(_emails(text))
    if _DIGIT.search(text):
        spans["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans["card"].append(m.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return spans


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Contexts:
    """The patterns that meet parts of a text: two words to the left, two words to the right; a side with fewer has none."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def of(self, start: int, end: int) -> list[int]:
        i, j = bisect_left(self.starts, start), bisect_right(self.ends, end)
        left = [(max(a, b - LONGEST), b) for a, b in ((self.starts[k], min(self.ends[k], start)) for k in range(max(0, i - 2), i))]
        right = [(a, min(b, a + LONGEST)) for a, b in ((max(self.starts[k], end), self.ends[k]) for k in range(j, min(j + 2, len(self.ends))))]
        return [_hash(" ".join(re.sub(r"[0-9]+", "9", self.text[a:b].lower()) for a, b in side)) for side in (left, right) if len(side) == 2]


def mentions(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every identifier-like token with a digit and six characters at least."""
    done = 0
    while (digit := _DIGIT.search(text, done)) is not None:
        start = at = digit.start()
        while start > done and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        m = _TOKEN.search(text, start)
        start, done = m.start(), max(m.end(), at + 1)
        if m.end() - start >= 6 and m.end() > at:
            yield start, m.end()


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    return not any(a < end and start < b for a, b in taken)


def graph(docs: DataFrame) -> DataFrame:
    """Edges (pattern, instance, seed): the instance is a hash of its text; all base spans are seeds."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[int, int], bool] = {}
        for text in part.column("text").to_pylist():
            taken = [s for spans in base_spans(text or "").values() for s in spans]
            others = [m for m in mentions(text or "") if _free(*m, taken)]
            contexts = Contexts(text) if taken or others else None
            for seed, own in ((True, taken), (False, others)):
                for start, end in own:
                    instance = _hash(text[start:end])
                    for pattern in contexts.of(start, end):
                        key = (pattern, instance)
                        found[key] = found.get(key, False) or seed
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array(list(found.values()), pa.bool_())], ["pattern", "instance", "seed"])

    edges = map_slices(docs.select(F.col("text").cast("string")), work, "pattern long, instance long, seed boolean")
    return edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


class Trusted(list):
    """The trusted patterns with most instances, and where there are more of them the table of all."""

    every: DataFrame | None = None


def trusted_patterns(edges: DataFrame) -> Trusted:
    """The reliable patterns, by a few rounds over the graph.

    The first reliability of a pattern is the share of seeds among its distinct instances; each round gives it the mean
    of its instances' reliability: 1 for seeds, and for others the best one of their other patterns, so that no pattern
    raises itself."""
    edges = written(edges)
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("sure"))
    edges = written(edges.join(seeds, "instance").select("pattern", "instance", "sure"))  # a text that is a seed anywhere
    score = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.col("sure").cast("double")).alias("score")))
    for _ in range(ROUNDS):
        order = Window.partitionBy("instance").orderBy(F.desc("score"), "pattern")
        two = edges.filter("NOT sure").join(score, "pattern").withColumn("place", F.row_number().over(order)).filter("place <= 2")
        first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
        best = two.groupBy("instance").agg(first("pattern").alias("top"), first("score").alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
        others = F.when(F.col("pattern") == F.col("top"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best"))
        trust = F.when(F.col("sure"), 1.0).otherwise(others)
        score = written(edges.join(best, "instance", "left").groupBy("pattern").agg(F.count("*").alias("n"), F.avg(trust).alias("score")))
    good = score.filter((F.col("score") >= RELIABLE) & (F.col("n") >= SUPPORT))
    most = [r.pattern for r in good.orderBy(F.desc("n"), "pattern").limit(PATTERNS + 1).select("pattern").collect()]
    trusted = Trusted(most[:PATTERNS])
    if len(most) > PATTERNS:
        trusted.every = good.select("pattern")
    return trusted


def with_rare(docs: DataFrame, trusted: list[int], text: "F.Column", columns: list) -> DataFrame:
    """The columns of docs, and ``_rare``: the trusted patterns of each text that are not broadcast, by a join with the table of all."""
    if getattr(trusted, "every", None) is None:
        return docs.select(*columns, F.lit(None).cast("array<bigint>").alias("_rare"))
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(trusted))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, int], None] = {}
        for own in part.column("text").to_pylist():
            met = list(mentions(own or ""))
            if met:
                key, contexts = hashlib.md5(own.encode(), usedforsecurity=False).hexdigest(), Contexts(own)
                for start, end in met:
                    patterns = contexts.of(start, end)
                    if shared.value.isdisjoint(patterns):
                        found.update(((key, p), None) for p in patterns)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64())], ["_key", "pattern"])

    pairs = map_slices(docs.select(text.alias("text")), work, "_key string, pattern long").distinct()
    rare = pairs.join(trusted.every, "pattern").groupBy("_key").agg(F.collect_set("pattern").alias("_rare"))
    return docs.select(*columns, F.md5(text.cast("binary")).alias("_key")).join(rare, "_key", "left").drop("_key")


def all_spans(text: str, trusted: frozenset[int], rare: list[int] | None = None) -> dict[str, list[tuple[int, int]]]:
    """The base spans, and what trusted patterns add outside them."""
    spans = base_spans(text)
    if trusted:
        taken = contexts = None
        added, more = [], frozenset(rare or ())
        for start, end in mentions(text):
            contexts = contexts or Contexts(text)
            patterns = contexts.of(start, end)
            if not (trusted.isdisjoint(patterns) and more.isdisjoint(patterns)):
                taken = [s for own in spans.values() for s in own] if taken is None else taken
                if _free(start, end, taken):
                    added.append((start, end))
        spans[ADDED] = added
    return spans


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans.get(k, ())))


def find(docs: DataFrame, trusted: list[int]) -> DataFrame:
    """The contract's row for every row of docs: counts of base spans, their hash, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(trusted))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, rare in zip(part.column("text").to_pylist(), part.column("_rare").to_pylist()):
            spans = all_spans(text or "", shared.value, rare)
            base = _joined(spans, KINDS)
            rows.append((*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans, (*KINDS, ADDED))))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    text = F.col("text").cast("string")
    picked = with_rare(docs, trusted, text, [F.col("doc_id").cast("long"), text.alias("text")])
    return map_slices(picked, work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, trusted_patterns(graph(docs)))


def mask(docs: DataFrame, trusted: list[int]) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(trusted))

    def masked(text: str | None, rare: list[int] | None) -> str | None:
        if not text:
            return text
        spans = sorted((a, -b, k) for k, own in all_spans(text, shared.value, rare).items() for a, b in own)
        out, done = [], 0
        for a, b, kind in spans:
            if a >= done:
                out += [text[done:a], f"<{kind.upper()}>"]
            done = max(done, -b)
        return "".join([*out, text[done:]])

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(list(map(masked, part.column("text").to_pylist(), part.column("_rare").to_pylist())), pa.string())]

    picked = with_rare(docs, trusted, F.col("text"), [F.col("text"), carried(docs)])
    return restored(add_by_slices(picked, work, "masked string").select(F.col("masked").alias("text"), "kept"), docs)
