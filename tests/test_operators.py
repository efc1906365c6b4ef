"""Golden fixtures for operators that SQL can't express, and their edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scoring, text, vector
from quern.operators import chunking, dedup, evidence, experiments, graph, retrieval, scorers, structured, tables
from quern.sources import readers
from quern.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_shingles_of_short_texts(spark):
    assert one(spark, text.shingles(text.tokens(F.col("t")), 3), t="A b") == ["a b"]
    assert one(spark, text.shingles(text.tokens(F.col("t")), 3), t="") == []
    assert one(spark, text.shingles(text.tokens(F.col("t")), 2), t="a b a b É") == ["a b", "b a", "b é"]


def test_mentions_and_markers(spark):
    assert one(spark, text.numbers(F.col("t")), t="EIP-1559, eip 20 and Eip1559; EIPx") == [20, 1559]
    assert one(spark, text.markers(F.col("t")), t="a [1] b [2, 3] c [x]") == [1, 2, 3]
    assert one(spark, text.number_list(F.col("t")), t="1559, 20 x 7") == [1559, 20, 7]


def test_dates_sort_whatever_their_form(spark):
    forms = {"2021-08-05": "2021-08-05", "8/5/2021": "2021-08-05", "August 5, 2021": "2021-08-05", "Aug 2021": "2021-08-01", "Q3 2021": "2021-07-01", "2021": "2021-01-01", "soon": None}
    for t, day in forms.items():
        assert str(one(spark, text.date_key(F.col("t")), t=t)) == str(day)


def test_cosine_of_zero_vectors_is_null(spark):
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), a=1) is None
    assert one(spark, vector.hamming(F.lit(5), F.lit(6)), a=1) == 2


def test_budget_prefix_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 50), (2, 60), (3, 1)], "rank int, token_count int")
    assert [r["rank"] for r in retrieval.budget_prefix(hits, 100).collect()] == [1]
    assert [r["rank"] for r in retrieval.budget_prefix(hits, 110).collect()] == [1, 2]


def test_fusion_of_one_leg_and_ties(spark):
    legs = "chunk_id string, rank int"
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], legs), spark.createDataFrame([("z", 1), ("y", 2)], legs)
    assert [r.chunk_id for r in retrieval.fuse(a, b).collect()] == ["y", "x", "z"]
    assert [r.chunk_id for r in retrieval.fuse(a, b.limit(0)).collect()] == ["x", "y"]


def test_closure_of_a_cycle_and_a_diamond(spark):
    e = spark.createDataFrame([(1, 2, "R"), (2, 3, "R"), (3, 1, "R"), (1, 4, "R"), (4, 3, "R")], "src bigint, dst bigint, type string")
    roots = spark.createDataFrame([(1,)], "root bigint")
    assert {(r.id, r.depth) for r in graph.closure(e, roots).collect()} == {(2, 1), (4, 1), (3, 2), (1, 3)}
    assert graph.shortest_path(e, 1, 3).first().path == [1, 2, 3]
    assert graph.shortest_path(e, 4, 99).count() == 0
    assert graph.closure(e.limit(0), roots).count() == 0
    c = e.withColumn("confidence", F.when(F.col("src") == 1, 0.8).otherwise(0.9))
    assert {(r.id, r.confidence) for r in graph.bounded_search(c, 1).collect()} == {(2, 0.8), (4, 0.8), (3, 0.72)}


def test_similarity_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 40, 12).tolist() for _ in range(6)]
    rows = [(i, " ".join(f"w{x}" for x in (base[i % 6] if i % 4 else base[i % 6][:-1] + [99 + i]))) for i in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: frozenset(tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)) for i, t in rows if t}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    links = {i: sum(1 for s in rep if s != sets[i] and len(s & sets[i]) / len(s | sets[i]) >= 0.7) for i in sets}
    got = {r.doc_id: (r.class_id, r.links) for r in dedup.links_per_document(df).collect()}
    assert got == {i: (rep[sets[i]], links[i]) for i in sets}


def test_packing_keeps_every_line_and_the_limit(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e\nf\n\ng h i j k l m"), (2, ""), (3, None)], "document_id bigint, text string")
    rows = chunking.packed(docs, 4).orderBy("document_id", "chunk_index").collect()
    assert [(r.content, r.token_count) for r in rows] == [("a b c", 3), ("d e\nf\n", 3), ("g h i j k l m", 7)]


def test_markdown_speakers_and_code(spark):
    docs = spark.createDataFrame([(1, "# A\ntext\n## B\nmore")], "document_id bigint, text string")
    rows = chunking.exploded(docs, chunking.markdown_sections, "level int, name string, body string, start int, end int").collect()
    assert [(r.level, r.name, r.body) for r in rows] == [(1, "A", "text"), (2, "B", "more")]
    assert chunking.speaker_segments("**Ann** [01:02]: hi\n**Bob**: yo") == [("Ann", "01:02", "hi"), ("Bob", None, "yo")]
    assert chunking.speaker_segments("Ann: hi\nmore\nBob Lee: yo") == [("Ann", None, "hi\nmore"), ("Bob Lee", None, "yo")]
    assert chunking.code_units("func (a *T) Run() {}\npub fn go() {}\nclass X:\n    def f(self):") == [("func", "Run", 1), ("fn", "go", 2), ("class", "X", 3), ("def", "f", 4)]


def test_scores_of_empty_and_bad_texts(spark):
    assert one(spark, scoring.text_quality(F.col("t")), t="") == 0.0
    good = "This is a normal sentence about nothing much. It has some words and stops here."
    assert one(spark, scoring.text_quality(F.col("t")), t=good) > one(spark, scoring.text_quality(F.col("t")), t="|||| lIl1 @@@@@@ ....... ||||")
    assert [one(spark, scoring.support_level(F.col("e"), F.col("c")), e=e, c=c) for e, c in ((0.7, 0.0), (0.71, 0.0), (0.4, 0.0), (0.9, 0.71))] == ["partial", "strong", "weak", "contradiction"]


def test_isotonic_is_monotone(spark):
    points = spark.createDataFrame([(x / 30, float(y)) for x, y in enumerate([3, 2, 1] * 10)], "predicted double, actual double")
    values = [r.value for r in experiments.isotonic(points).orderBy("boundary").collect()]
    assert values == sorted(values) and experiments.isotonic(points.limit(19)).count() == 0


def test_allocation():
    assert experiments.allocate(4) == (5, 2000, False) and experiments.allocate(5) == (4, 1600, True) and experiments.allocate(3, 19, 7900) == (1, 500, True)


def test_upsert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2)], "id bigint, content string, owner string, v int")
    path = f"{tmp_path}/t"
    for _ in range(2):
        readers.upsert_table(spark, path, rows, "id", ["content", "v"], "v")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "b", "y", 2)]
    readers.upsert_table(spark, path, rows.limit(1).withColumn("content", F.lit("c")).withColumn("owner", F.lit("z")), "id", ["content"], "v")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "c", "y", 2)]


def test_drifted_spans(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, "changed")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 0, 1)], "doc_id bigint, start int, end int").withColumn("span_hash", F.sha2(F.lit("hello"), 256))
    assert sorted(r.doc_id for r in evidence.drifted(spans, texts, "doc_id").collect()) == [2, 3]


def test_structured_outputs(spark):
    nodes, edges = spark.createDataFrame([(1, "root")], "id bigint, kind string"), spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    assert [json.loads(r.element)["data"]["id"] for r in structured.dependency_json(nodes, edges).collect()] == ["1", "1-2"]
    rows = structured.positions(spark.createDataFrame([(1, "The benefit of that is cheaper data for everyone. A risk that fees rise for small users remains.")], "id bigint, text string"), "id").collect()
    assert {r.side for r in rows} == {"pro", "con"}


def test_stand_in_scorers(spark):
    df = spark.createDataFrame([("a b", "b a"), ("a", None), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(scorers.scored()(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.0]
    v = df.select(scorers.hashed_embedding(8)(F.col("x")).alias("v")).first().v
    assert len(v) == 8 and np.linalg.norm(v) in (pytest.approx(1.0), 0.0)


def test_sources(spark, tmp_path):
    (tmp_path / "eip-20.md").write_text("---\nEIP: 20\ntitle: Token: Standard\nrequires: [1, 2]\n---\n# Body\ntext")
    (tmp_path / "eip-7.md").write_text("no front matter")
    rows = {r.number: r for r in readers.proposals(spark, str(tmp_path)).collect()}
    assert rows[20].title == "Token: Standard" and rows[20].requires == [1, 2] and rows[20].body.startswith("# Body")
    assert rows[7].title is None and rows[7].requires == [] and rows[7].body == "no front matter"
    sub = tmp_path / "specs" / "fast"
    sub.mkdir(parents=True)
    (sub / "peer_das.md").write_text("x" * 60)
    got = readers.specs(spark, str(tmp_path / "specs")).select("title", readers.forks(F.col("path")).alias("fork"), readers.forks(F.lit("/a/_features/x1/b.md")).alias("feature")).first()
    assert tuple(got) == ("Peer Das", "fast", "feature-x1")
    (tmp_path / "qa.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "qa.jsonl"), "q string").count() == 2


def test_stale_entries_at_an_injected_time(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-09 00:00:01",)], "t string")
    assert tables.stale(rows, "2024-01-10 00:00:00", 24, "t").count() == 1


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"{tmp_path}/events"
    events.repartition(3).write.parquet(src)
    schema = events.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    stream = streams.read_events(spark, src, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_upserts(stream, f"{tmp_path}/out", f"{tmp_path}/c1", "event_id", ["value"], "ts")
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    counts = streams.collected(streams.windowed_counts(stream, "ts", "event_type"), "counts", f"{tmp_path}/c2", "complete")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    got = {r.event_id: (r.failures, r.open) for r in streams.collected(streams.breaker(stream), "breaker", f"{tmp_path}/c3").collect()}
    batch = experiments.breaker(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    assert got == {r.event_id: (r.failures, r.open) for r in batch.collect()}


def test_citations_are_inserted_behind_their_sentences(spark):
    entries = spark.createDataFrame([(1, 0, "One is one.", 2), (1, 0, "One is one.", 1), (1, 1, "Two!", None)], "answer_id bigint, n int, sentence string, marker int")
    assert evidence.insert_citations(entries).first().text == "One is one. [1, 2] Two!"


def test_sentences_of_texts_without_a_stop(spark):
    assert one(spark, text.sentences(F.col("t")), t="x " * 100_000) == []
    assert one(spark, text.sentences(F.col("t")), t="..A b. C!? d") == ["A b.", "C!?"]


def test_signatures_of_documents_equal_their_definition(spark, sf_dir):
    """Every document has both, texts without a word too."""
    import hashlib

    from quern.operators import dedup as D
    from quern.plans import load

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(10**9, ""), (10**9 + 1, None), (10**9 + 2, "two Words"), (10**9 + 3, "many words " * 20000), (10**9 + 4, ""), (10**9 + 4, "beside an empty text")]
    rows = docs.limit(12).collect() + [*odd]
    from quern.functions import text as T

    small = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    words = {}
    for i, w in small.select("doc_id", T.tokens("text")).collect():
        words.setdefault(i, []).append(w or [])
    least = {(r.doc_id, r.i): r.value for r in D.minhash(small).collect()}
    bits = {r.doc_id: r.simhash % (1 << 64) for r in D.simhash(small).collect()}
    assert len(least) == 128 * len(words) and set(bits) == set(words)
    for i, texts in words.items():
        shingles = {" ".join(w[j : j + 3]) for w in texts for j in range(max(1, len(w) - 2)) if w}
        hashes = [int(hashlib.md5(s.encode()).hexdigest(), 16) % (2**64 - 1) for s in shingles]
        for j, (a, b) in enumerate(D.parameters()):
            assert least[i, j] == min(((a * h + b) % D.PRIME for h in hashes), default=D.MAX_HASH)
        tokens = [int(hashlib.sha256(x.encode()).hexdigest()[-16:], 16) for w in texts for x in w]
        assert bits[i] == sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in tokens) > 0)
    queries = load().QUERIES
    assert queries["dup_minhash_documents"](spark, sf_dir).count() == 128 * docs.count()
    assert queries["dup_simhash_documents"](spark, sf_dir).count() == docs.count()


def test_turns_are_packed_up_to_the_limit(spark):
    """No chunk is above the limit, oversized turns are cut into windows, and neighbours are only parted if they don't fit."""
    sizes = {1: [300, 300, 400], 2: [512, 1, 511, 1], 3: [10, 1100, 20], 4: [0, 0], None: [513]}
    rows = [(i, j, "w " * n) for i, ns in sizes.items() for j, n in enumerate(ns)]
    got = {}
    for r in chunking.packed_turns(spark.createDataFrame(rows, "document_id int, turn int, text string").repartition(3)).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.turns, r.token_count, r.first_turn, r.last_turn))
    assert got == {
        1: [(0, 1, 300, 0, 0), (1, 1, 300, 1, 1), (2, 1, 400, 2, 2)],
        2: [(0, 1, 512, 0, 0), (1, 2, 512, 1, 2), (2, 1, 1, 3, 3)],
        3: [(0, 1, 10, 0, 0), (1, 1, 462, 1, 1), (2, 1, 462, 1, 1), (3, 1, 176, 1, 1), (4, 1, 20, 2, 2)],
        4: [(0, 2, 0, 0, 1)],
        None: [(0, 1, 462, 0, 0), (1, 1, 51, 0, 0)],
    }
