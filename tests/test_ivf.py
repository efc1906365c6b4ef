"""The inverted-file index: recall of the approximate mode, the exact mode against brute force, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import ivf
from quern.plans import load


def test_exact_mode_equals_brute_force_and_skips_lists(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16)) * 3
    m = middles[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[3].tolist()) for i in range(30)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [1.0])]
    df = spark.createDataFrame(rows + odd, "chunk_id bigint, embedding array<double>")
    index = ivf.build(df, f"{tmp_path}/i", lists=12)
    assert spark.read.parquet(f"{tmp_path}/i").count() == len(rows)
    asked = df.where("chunk_id % 40 = 0 OR chunk_id > 1999").withColumnRenamed("chunk_id", "query_id")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    read = []
    inner = ivf._pass
    monkeypatch.setattr(ivf, "_pass", lambda *a: read.append(int(a[5].sum())) or inner(*a))
    got = {}
    for r in ivf.search(spark, index, asked, k=10, probes=2, exact=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.similarity))
    ids = sorted(unit)
    for q in [i for i, _ in rows if i % 40 == 0]:
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in ids)[:10]
        assert [(a, b) for a, b, _ in sorted(got.pop(q))] == [(n, i) for n, (_, i) in enumerate(best, 1)], q
    assert not got and sum(read) < 0.6 * len(index.radius) * len([1 for i, _ in rows if i % 40 == 0])


def test_recall_of_the_nearest_lists(spark):
    d, q = "/root/testdata/sf0.01", load().QUERIES
    found, truth = (q[n](spark, d).withColumnRenamed("chunk_id", "key") for n in ("ret_ivf_topk", "ret_vector_topk_batch"))
    shares = ivf.recall(found, truth).agg(F.avg("recall").alias("mean"), F.count("*").alias("n")).first()
    assert shares.n == 5 and shares.mean >= 0.9


def test_no_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id bigint, embedding array<double>")
    index = ivf.build(empty, f"{tmp_path}/i")
    assert ivf.search(spark, index, empty.withColumnRenamed("chunk_id", "query_id"), exact=True).count() == 0
