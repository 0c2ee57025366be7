from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import topk
from flowloom.llm.common import stage
from flowloom.llm.suffix_dedup import PASSAGE
from tests.llm.test_near_and_exact_copies import slow_components, slow_fingerprint, slow_removal

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score string"


def slow_top(rows, k):
    ok = [(i, np.array([int(np.floor(256 * float(x))) for x in v], object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            scores = sorted((-int((a * b).sum()) if len(a) else 0, i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, pivots", [(4096, 64), (7, 3)])
def test_top_k_equals_brute_force(spark, block_rows, pivots):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * r.choice([0.1, 1, 3])]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)] + [(i, [0.0] * 6) for i in range(500, 520)]
    rows += [(601, None), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (603, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(3)
    vectors = topk.quantise(df)
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block_rows=block_rows, n_pivots=pivots)
    assert sorted(map(tuple, got.collect())) == slow_top(rows, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_small_tables(spark):
    one = topk.quantise(spark.createDataFrame([(50, [1.0, 2.0], "x"), (51, [1.0, -2.0], "x")], VECTORS))
    assert [tuple(r) for r in topk.top_k(one, one.filter("vec_id = 50")).collect()] == [(50, 1, 51, 256 * 256 * (1 - 4))]
    none = one.limit(0)
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(one, none).count() == 0


@pytest.mark.parametrize("spread, most", [(0.05, 0.25), (4.0, 1.05)])
def test_search_skips_what_cannot_win(spark, spread, most):
    """Of clusters, few products are worked out; of vectors without any, each pair at most once."""
    r = np.random.default_rng(1)
    data = np.vstack([c + r.normal(size=(100, 16)) * spread for c in np.eye(16) * 4])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    df = topk.quantise(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS))
    scored = spark.sparkContext.accumulator(0)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), block_rows=25, n_pivots=16, scored=scored)
    assert sorted(map(tuple, got.collect())) == slow_top(rows, 5)
    assert 0 < scored.value <= most * len(rows) * len(rows) / 50


def test_top_k_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], i, i, "x") for i in range(60)]
    df = topk.quantise(spark.createDataFrame([(i, v) for i, v, *_ in rows], "vec_id long, embedding array<float>"))
    clash = df.withColumn("block", F.lit(1)).withColumn("part", F.lit("x")).withColumn("score", F.lit(0)).withColumn("id", F.lit(9))
    got = topk.top_k(clash, clash.filter("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == slow_top([r[:2] for r in rows], 5)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = stage(f(spark, docs, SF), name)
        kept.append((name, before, docs))
    assert [n for n, _, _ in kept] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "bpe_token_ids"]
    for _, before, after in kept[:-1]:
        assert after.columns == before.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    # near-duplicates: one of each component of what came in
    _, before, after = kept[1]
    rows = before.collect()
    roots = slow_components([slow_fingerprint(r.text) for r in rows])
    least = {}
    for r, c in zip(rows, roots):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert ids(after) == sorted(least.values())
    # repeated strings: what the bytes rule leaves, but for cut characters
    _, before, after = kept[2]
    rows = before.collect()
    want = {r.doc_id: x for r, x in zip(rows, slow_removal([r.text.encode() for r in rows], PASSAGE))}
    passages = Counter()
    for r in after.collect():
        assert 0 <= len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1]) <= 6 * want[r.doc_id][2]
        words = r.text.split()
        passages.update({" ".join(words[i : i + 51]) for i in range(len(words) - 50)})
    assert max(passages.values()) == 1  # no passage of 51 words is in two documents
    # mixing repeats documents twice at most; token ids go on from there
    _, before, after = kept[3]
    assert set(ids(after)) <= set(ids(before)) and max(map(ids(after).count, ids(after))) <= 2
    assert ids(kept[4][2]) == ids(after)


def test_pipeline_runs_on_nothing_and_on_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "a " * 60 + "b c d " * 30, None, "s", 1), (2, "a " * 60 + "b c d " * 30, None, "s", 1)], docs.schema))
    for table in (docs.limit(0), odd):
        for name, f in corpus_pipeline.STAGES:
            table = stage(f(spark, table, SF), name)
        table.count()
