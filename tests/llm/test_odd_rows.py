"""Rows that a part of an operator once got wrong: ties at a bound, borders of blocks, ids with line ends, names with dots."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, secrets, warc


def test_equally_frequent_words_fill_the_dictionary(spark):
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "abcdefg"]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(8)] + [(9, " ".join(words[:3]))], "doc_id bigint, text string")
    own = lambda most: [w for w in secrets.dictionary(docs, most=most) if w not in secrets.RANK]
    assert own(70) == sorted(words) and own(69) == sorted(words)[:69] and own(5) == sorted(words)[:5] and own(0) == []


def test_roles_are_learned_alike_from_any_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(c, i, f"{'User' if i % 3 else 'Bot'}: line {rng.integers(9)}", str(rng.choice(["user", "assistant"]))) for c in range(3) for i in range([300, 90, 1][c])]
    df = spark.createDataFrame([*rows, (None, 1, "x", "user"), (5, None, "y", "user")], "conv_id bigint, turn bigint, text string, role string")
    pairs = {}
    for c in range(3):
        own = [r[3] for r in rows if r[0] == c]
        for a, b in zip(own, own[1:], strict=False):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    models = []
    for parts, block in ((1, 4096), (4, 7), (9, 64)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        models.append(chat.fit(df, block=block))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for m in models:
        assert np.array_equal(m.step, models[0].step) and np.array_equal(m.start, models[0].start)
        for (a, b), n in pairs.items():
            total = sum(k for (x, _), k in pairs.items() if x == a)
            assert np.isclose(np.exp(m.step[m.roles.index(a), m.roles.index(b)]), (n + 1) / (total + len(m.roles)))


def test_ids_with_line_ends_stay_ids(spark, tmp_path):
    ids = ["a\r\nContent-Length: 1", "b>\r\n\r\nWARC/1.1", "é %41 <x>", "", None, "plain"]
    pages = spark.createDataFrame([(i, "http://x/", f"text {n}") for n, i in enumerate(ids)] + [("zz", "http://y/", "text 5")], "page_id string, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {(i, "response", None) for i in ids} | {("zz", "revisit", "plain")}


def test_the_pipeline_takes_any_column_name(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("score", F.lit("own")).withColumn("kept", F.lit(True)).withColumn("rank", F.lit(None).cast("int"))
    docs.unionByName(docs.limit(5)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == before.columns and 0 < now.count() <= before.count(), n
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_the_pipeline_of_no_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
