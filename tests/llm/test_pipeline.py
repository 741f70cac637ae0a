"""The pipeline, stage by stage, against plain restatements of what each must keep."""

import collections
import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_groups, check_packed, plain_kernel_model, plain_spans, plain_toxicity

from standmill.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against a plain restatement that calls none of the operators, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF)))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [k.collect() for k in kept]
    ids = [{r.doc_id for r in own} for own in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in rows[0]}
    names, scores = plain_kernel_model([(r.doc_id, r.text, r.lang) for r in rows[0] if r.lang and letters[r.doc_id] and not held(r.doc_id)])
    likely = {r.doc_id: scores(r.text).max() for r in rows[0] if letters[r.doc_id]}
    sure = {i for i, p in likely.items() if abs(p - corpus_pipeline.LEAST_LANGUAGE_SCORE) > 2e-3}
    assert ids[1] & sure == {i for i in sure if likely[i] >= corpus_pipeline.LEAST_LANGUAGE_SCORE} and ids[1] <= set(likely)

    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    marked = plain_toxicity([(r.doc_id, r.text or "") for r in rows[1]], labels)
    plain = {i for i, (p, cosines, _) in marked.items() if len({round(c, 8) for c in cosines}) == len(cosines) and abs(p - 0.3) > 1e-5}  # without ties
    assert len(plain) > len(marked) / 2 and ids[2] & plain == {i for i in plain if marked[i][0] < 0.3}

    groups = collections.defaultdict(set)
    for i, (_, component) in brute_groups([(r.doc_id, r.text) for r in rows[2]]).items():
        groups[component].add(i)
    assert ids[3] == {min(g) for g in groups.values()}

    before = {r.doc_id: r for r in rows[3]}
    assert ids[4] == ids[3] and len(rows[4]) == len(rows[3])
    for r in rows[4]:
        old = before[r.doc_id]
        assert tuple(r)[: columns.index("text")] == tuple(old)[: columns.index("text")]
        spans = sorted((a, -b, kind) for kind, own in plain_spans(old.text or "").items() for a, b in own)
        wanted, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                wanted += re.escape(old.text[at:a]).replace("\\ ", " ") + f"<{kind.upper()}>"
            at = max(at, -b)
        wanted += re.escape((old.text or "")[at:]).replace("\\ ", " ")
        if "<ID>" in (r.text or ""):
            continue  # spans that the method adds have tests of their own
        assert re.fullmatch(wanted, r.text or "")
    check_packed(rows[5], [(r.doc_id, r.text) for r in rows[4]])


def test_columns_of_any_name_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in ("score", "held_out", "neighbours", "predicted", "lang_pred", "kept", "t", "k1", "component_id", "_rare", "_key", "shard", "count")})
    own = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = written(stage(spark, own, SF))
        assert own.columns == odd.columns
    assert own.filter("score <> concat('score ', doc_id) OR kept <> concat('kept ', doc_id)").isEmpty() and own.count() > 0
    assert corpus_pipeline.pack(spark, own, SF).count() >= own.count()


def test_one_row_stays_of_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (3, "other words altogether in this one here"), (None, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.keep_one_of_group(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def test_the_least_text_stays_of_one_id(spark):
    texts = [(1, "b a"), (1, "a b"), (1, "c c"), (2, None), (2, "x"), (3, "y")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, kept long")
    found = corpus_pipeline.keep_one_of_group(spark, docs.repartition(5), SF).collect()
    assert sorted((r.doc_id, r.text, r.kept) for r in found) == [(1, "a b", 1), (2, None, 3), (3, "y", 5)]


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.isEmpty()
