"""What SQL can't express: storage, injected functions, sessions on the driver, signatures against brute force, and texts that the tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import augmented, chunkers, decisions, dedup, generation, located, skew, sync
from quern.sources import parsing, storage


def test_tables_are_made_filled_and_laid_out(spark, tmp_path):
    root = str(tmp_path / "store")
    assert set(storage.create_tables(spark, root)) == set(storage.SCHEMAS) - set(storage.LINES) and storage.create_tables(spark, root) == []
    storage.append(spark.createDataFrame([("c1", "d1", "text"), ("c2", "d2", "more")], "chunk_id string, document_id string, content string"), root, "chunks")
    storage.rebuilt(spark, root, "chunks", "document_id", 2)
    assert {r.chunk_id for r in storage.load(spark, root, "chunks").collect()} == {"c1", "c2"}
    assert storage.load(spark, root, "experiments").count() == 0
    for status, at in (("active", "1"), ("stopped", "2")):
        storage.append(spark.createDataFrame([("e", status, at)], "experiment string, status string, changed string"), root, "experiments")
    assert [r.status for r in storage.latest(storage.load(spark, root, "experiments"), ["experiment"], "changed").collect()] == ["stopped"]
    storage.append(spark.createDataFrame([("all", 0.1, 0.2), ("all", 0.9, 0.8)], "kind string, boundary double, value double"), root, "calibration")
    knots = storage.load(spark, root, "calibration").select("boundary", "value")
    found = decisions.calibrated(spark.createDataFrame([(0.5,), (0.0,), (None,)], "predicted double"), knots).collect()
    assert [r.calibrated for r in found] == [pytest.approx(0.5), 0.2, None]
    storage.dropped(spark, root, "chunks")
    assert storage.load(spark, root, "chunks").count() == 0


def test_requests_are_tried_again(spark):
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if url == "flaky" and calls.count("flaky") < 3:
            return 429, {"Retry-After": "7"}, None
        if url == "down":
            raise OSError("no route")
        return 200, {}, url.upper()

    rows = {r.url: r for r in parsing.fetched(spark, ["ok", "flaky", "down"], fetch, wait=waits.append).collect()}
    assert (rows["ok"].attempts, rows["flaky"].attempts, rows["down"].attempts) == (1, 3, 3)
    assert rows["flaky"].body == "FLAKY" and rows["down"].status is None and waits == [7.0, 7.0, 1.0, 2.0]


def test_sources_fail_alone():
    def broken():
        raise ValueError("x")

    runs = sync.run_sources({"a": lambda: 3, "b": broken, "c": lambda: 1}, cycles=2)
    assert [r["synced"] for r in runs] == [3, 0, 1] * 2 and [bool(r["error"]) for r in runs] == [False, True, False] * 2


def test_modes_fall_back_and_refuse():
    assert augmented.agent_retrieval("graph", {"vector": lambda: 7}) == 7
    for mode, legs in (("odd", {"vector": int}), ("hybrid", {})):
        with pytest.raises(ValueError):
            augmented.agent_retrieval(mode, legs)
    with pytest.raises(ValueError, match="400"):
        generation.query("odd", {})
    with pytest.raises(RuntimeError, match="501"):
        generation.query("validated", {}, has_nli=False)
    with pytest.raises(RuntimeError, match="503"):
        generation.query("graph", {}, has_graph=False)
    assert generation.layout([1, 2], True)["root_nodes"] == ["eip-1", "eip-2"]
    with pytest.raises(ValueError):
        generation.search(None, [], 51)


def test_agent_sessions():
    replies = iter(["think: first", "RETRIEVE: blobs", "ANSWER: done"])
    got = decisions.react("q", lambda steps: next(replies), lambda q: [{"id": q}])
    assert got["answer"] == "done" and got["found"] == [{"id": "blobs"}] and [s["action"] for s in got["steps"]] == ["think", "retrieve", "answer"]
    got = decisions.react("q", lambda steps: "RETRIEVE: x", lambda q: [{"id": 1}], lambda found: json.dumps({"sufficient": True, "confidence": 0.9}))
    assert got["reason"] == "sufficient"
    assert decisions.react("q", lambda steps: "RETRIEVE: x", lambda q: [])["reason"] == "failures"
    assert "budget" in decisions.react("q", lambda steps: "hm", lambda q: [])["reason"]


def test_pair_rule_equals_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [base, base, base.replace("seven", "other"), base + " more", "quite another text with its own words entirely", "", None, "quite another text with its own words entirely now"]
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else "t") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    index = dedup.signatures(docs)
    signs = {r.doc_id: r for r in index.collect()}
    expected = {}
    for a in signs:
        for b in signs:
            if a < b:
                m = dedup.estimate(signs[a].minhash, signs[b].minhash)
                s = 1 - bin((signs[a].simhash ^ signs[b].simhash) & (2**64 - 1)).count("1") / 64
                if m >= 0.7 or s >= 0.85:
                    expected[a, b] = ("minhash", m) if m >= 0.7 else ("simhash", s)
    for block in (2048, 2):
        got = {(r.a, r.b): (r.method, r.similarity) for r in dedup.duplicate_pairs(index, block=block).collect()}
        # a copy shares the pairs of the first of its class
        first = {1: 0, 6: 5}
        for (a, b), (method, value) in expected.items():
            if first.get(b) != a:
                a, b = sorted((first.get(a, a), first.get(b, b)))
            assert got[a, b][0] == method and got[a, b][1] == pytest.approx(value)
        assert len(got) <= len(expected)
    known = dedup.signatures(docs.where("doc_id < 4"))
    again = {r.doc_id: (r.minhash, r.simhash) for r in dedup.signatures(docs, known=known).collect()}
    assert again == {i: (r.minhash, r.simhash) for i, r in signs.items()}
    crossed = dedup.duplicate_pairs(index.join(docs.select("doc_id", "source"), "doc_id"), source="source").collect()
    assert all((r.a + r.b) % 2 for r in crossed) and (0, 1) in {(r.a, r.b) for r in crossed}


def test_hot_keys_lose_no_pair(spark):
    rows = spark.createDataFrame([(0, i) for i in range(300)] + [(1, 5)], "k int, v int")
    for block in (2000, 37):
        found = skew.pairs_within(rows, "k", block).where("a_v < b_v")
        assert found.count() == 300 * 299 // 2 and found.distinct().count() == 300 * 299 // 2


def test_odd_texts_are_chunked(spark):
    long = "A sentence of six words here. " * 40
    parts = chunkers.split_paper("first\n\n" + long + "\n\nlast", 20, 5, special=True)
    assert all(chunkers.count(p) <= 20 for p in parts) and parts[-1].endswith("last") and "first" in parts[0]
    assert chunkers.split_paper("word " * 100, 20, 5) and chunkers.split_paper("  \n ", 20) == []
    assert [b - a for a, b, _ in chunkers.windows("a b c d e f g", 3, 2)] == [3, 3, 3, 1]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, text string")
    assert {r.id for r in chunkers.markdown(rows, "id").collect()} == {3}
    assert located.candidate_spans(rows, "id").count() == 3
    assert parsing.api_rows(rows, "id").count() == parsing.rpc_methods(rows.withColumn("namespace", F.lit("n")), "id").count() == 0
    bad = spark.createDataFrame([("p", "a: [1\n b: }")], "path string, text string")
    assert parsing.api_rows(bad).count() == 0
    assert parsing.arxiv_query("x", ["cs.CR", "cs.DC"]) == "all:x AND (cat:cs.CR OR cat:cs.DC)"


def test_answers_are_extracted(spark):
    asked = spark.createDataFrame([(1, "<context>\n[1] DOC-1\nIt is so. More.\n\n---\n\n[2] DOC-2, Sec\nAnd so!\n</context>"), (2, None)], "id int, prompt string")
    got = {r.id: r.response for r in generation.completed(asked).collect()}
    assert got == {1: "It is so [1]. And so [2].", 2: "The context doesn't say."}


def test_aliases_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, 5, "EIP-5 (the cap), also known as it. EIP-6 (other)"), (2, 5, None)], "id int, number int, text string")
    assert [(r.alias, r.kind) for r in located.aliases(rows, "id").collect()] == [("the cap", "eip_parenthetical")]
    assert [(r.other, r.context) for r in located.other_references(rows, "id").collect()] == [(6, "other")]


def test_links_across_sources_keep_every_member(spark):
    """Equal texts of one source are one class whose members share its links; texts of one source are never linked."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    near = base.replace("seven", "other")
    rows = [(1, base, "s"), (2, base, "s"), (3, near, "t"), (4, base, "t"), (5, near, "s"), (6, "", "s"), (7, None, "t"), (8, "quite another text with words of its own", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    index = dedup.signatures(docs).join(docs.select("doc_id", "source"), "doc_id")
    signs = {r.doc_id: r for r in index.collect()}
    for block in (2000, 2):
        members, links = dedup.duplicate_classes(index, source="source", block=block)
        rep = {r.doc_id: r.rep for r in members.collect()}
        assert set(rep) == set(signs) and rep[2] == 1 and rep[4] == 4
        linked = {(r.a, r.b) for r in links.collect()}
        got = {(a, b) for a in rep for b in rep if a < b and tuple(sorted((rep[a], rep[b]))) in linked}
        alike = lambda a, b: dedup.estimate(a.minhash, b.minhash) >= 0.7 or bin((a.simhash ^ b.simhash) & (2**64 - 1)).count("1") <= 9
        assert got == {(a, b) for a in signs for b in signs if a < b and signs[a].source != signs[b].source and alike(signs[a], signs[b])}
    empty = dedup.duplicate_classes(index.limit(0), source="source")
    assert [df.count() for df in empty] == [0, 0]


def test_values_that_differ_in_few_bits_agree_under_a_mask():
    import random

    rng = random.Random(2)
    for n in (1, 10**5, 10**8):
        t = dedup.agreeing(n, 9)
        masks = dedup.bit_masks(9, t)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), 9):
                y ^= 1 << bit
            assert any((x ^ y) & m & (2**64 - 1) == 0 for m in masks)
    assert [dedup.agreeing(n, 9) for n in (1, 10**4, 10**6, 10**8, 10**12)] == [1, 2, 3, 5, 5]
