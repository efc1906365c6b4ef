"""Nearest neighbours, near duplicates, repeated passages, transcripts, archives and the pipeline against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, graph, neardup, nearest, repeats, warc

# -- nearest neighbours


def brute_nearest(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for i, a in fine:
        if i % 5 == 0:
            near = sorted((-(a * b).sum(), j) for j, b in fine if j != i and len(a) == len(b))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(120)]  # a very common vector, its copies tied
    rows += [(600, None), (605, [0.0] * 8), (610, [1.0, None] * 4), (615, [float("nan")] * 8), (620, [float("inf")] * 8), (625, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows], "vec_id bigint, embedding array<float>, score double, rank int")
    asked = df.where("vec_id % 5 = 0")
    for cells in ({}, {"query_cell": 40, "candidate_cell": 100, "tile": 16}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(df, asked, k=20, **cells).collect())
        expected = brute_nearest(rows, 20)
        assert [g[:3] for g in got] == [e[:3] for e in expected]
        assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-12)
    assert nearest.nearest(df.limit(0), asked.limit(0)).count() == 0


def test_repeated_rows_and_huge_components(spark):
    rng = np.random.default_rng(16)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.choice([-160, -3, 0, 150, 152])).tolist()) for i in range(200)]
    rows += [rows[7]] * 500 + [(5, rows[9][1]), (300, [1e160] * 8), (301, [1e160] * 8), (305, [1e200, -1e200] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for cells in ({}, {"query_cell": 30, "candidate_cell": 60, "tile": 16}):
        got = nearest.nearest(df, df.where("vec_id % 5 = 0"), k=20, **cells).collect()
        expected = {}
        for i, a in {(i, tuple(a)) for i, a in rows if i % 5 == 0}:
            with np.errstate(all="ignore"):
                scored = [(float(np.cumsum(np.array(a) * b)[-1]), j) for j, b in rows if j != i]
            scored = sorted((-s if s == s else np.inf, j) for s, j in scored)[:20]
            expected.setdefault(i, []).append([(r, j, -s) for r, (s, j) in enumerate(scored, 1)])
        for i, lists in expected.items():
            own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == i)
            assert own == sorted(x for part in lists for x in part), i


def test_bounds_hold_their_products():
    rng = np.random.default_rng(7)
    a, b = (nearest.Quantised(np.arange(50), rng.normal(size=(50, 16)) * scale) for scale in (1, 1e6))
    exact = a.vectors @ b.vectors.T
    middle = (a.codes @ b.codes.T).astype(float) * a.scale[:, None] * b.scale[None, :]
    assert (abs(exact - middle) <= a.error[:, None] * b.length + a.near_length[:, None] * b.error + 1e-9 * a.length[:, None] * b.length).all()


# -- near duplicates


def brute_groups(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        if i is not None:
            sets.setdefault(i, s)
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", "   ", "one", "ONE", "one two", "one two three", "É a", "é a", "x " * 30000]
    base = rng.choices(words, k=60)
    for _ in range(120):  # a large group of near copies about the threshold
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(60):
        t = rng.choices(words, k=rng.randint(3, 80))
        texts += [" ".join(t), " ".join(t[: rng.randint(1, len(t))]), " ".join(t).upper() + "\n"]
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark, copies):
    rows = [(i, t, 0, True) for i, t in copies] + [(None, copies[12][1], 1, False), (11, copies[11][1], 2, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, kept boolean")
    for width in (4, 5):
        expected = brute_groups(copies, width, 80)
        for few in (1_000_000, 0):
            got = neardup.near_duplicates(df, width=width, most_broadcast=few).collect()
            assert len(got) == len(rows)
            for r in got:
                if r.doc_id is None:
                    assert r.component_id is None and r.kept
                else:
                    assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_lose_no_link(spark, copies):
    shingles = neardup.Shingles(5)
    rows = [(7, i, s.tobytes()) for i, t in copies if len(s := shingles(t))]
    sets = spark.createDataFrame(rows, "cluster bigint, rep bigint, shingles binary")
    expected = {i: c for i, (n, c) in brute_groups(copies, 5, 80).items() if n}
    for block in (1_000_000, 700):
        found = {r.node: r.component for r in graph.components(neardup.confirmed_links(sets, 80, block)).collect()}
        assert {i: found.get(i, i) for i in expected} == expected
    reps = spark.createDataFrame([(i, len(s), neardup.sketch(s).tobytes()) for i, t in copies if len(s := shingles(t))], "rep bigint, n bigint, sig binary")
    for tile in (4096, 16):
        linked = {r.node: r.component for r in graph.components(neardup.candidate_links(reps, 0.8, tile=tile)).collect()}
        assert all(linked.get(i, i) == linked.get(c, c) for i, c in expected.items())


def test_estimates_come_near():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.6, 0.8, 0.95):
        whole = neardup.mix(rng.integers(0, 2**62, 2000).astype(np.uint64))
        a, b = whole[: int(1000 * (1 + share))], whole[int(1000 * (1 - share)) :][: int(1000 * (1 + share))]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimate(np.array([(neardup.sketch(a) == neardup.sketch(b)).sum()]))[0] - true) < 0.18


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1001: 1000}
    star = spark.createDataFrame([(500, i) for i in range(0, 400)] + [(600, i) for i in range(700, 900)] + [(399, 450)], "a bigint, b bigint")
    for hub in (1000, 10):
        found = {r.node: r.component for r in graph.components(star, hub=hub).collect()}
        assert found == {i: 0 for i in (*range(1, 400), 450, 500)} | {i: 600 for i in range(700, 900)}
    assert graph.components(links.limit(0)).count() == 0


# -- repeated passages


def brute_spans(rows, least):
    where = {}
    for i, t in rows:
        w = repeats.split(t)
        for j in range(len(w) - least + 1):
            where.setdefault(tuple(w[j : j + least]), set()).add(i)
    out = set()
    for i, t in rows:
        w = repeats.split(t)
        covered = sorted({p for j in range(len(w) - least + 1) if len(where[tuple(w[j : j + least])]) > 1 for p in range(j, j + least)})
        runs = np.split(np.array(covered), np.flatnonzero(np.diff(covered) > 1) + 1) if covered else []
        out |= {(i, int(r[0]), len(r)) for r in runs}
    return out


def test_repeated_spans_equal_brute_force(spark, monkeypatch):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefg", k=3)) for _ in range(200)]
    shared = [rng.choices(words, k=n) for n in (49, 50, 51, 70, 200)]
    texts = [None, "", "short", "same " * 300]
    for n in range(60):
        t = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            t += s[a:] + rng.choices(words, k=rng.randint(0, 5))
        texts.append(" ".join(t))
    texts += [" ".join(shared[3])] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, texts[-1], 1, "x"), (4, texts[4], 1, "x")], "doc_id bigint, text string, pos int, kind string")
    for flush, hot in ((1_000_000, 4096), (50, 4096), (50, 0), (1_000_000, 12)):
        monkeypatch.setattr(repeats, "FLUSH", flush)
        monkeypatch.setattr(repeats, "HOT", hot)
        assert {tuple(r) for r in repeats.repeated_spans(df, least=50).collect()} == brute_spans(rows, 50)
    assert {tuple(r) for r in repeats.repeated_spans(df, least=30, prefix=10).collect()} == brute_spans(rows, 30)
    assert repeats.repeated_spans(df.limit(0)).count() == 0


def test_a_repeated_line_is_one_row_of_its_key():
    """A text of one repeated line, and repeated rows of it, don't pile up on a key."""
    h = repeats.WordHashes()(repeats.split("a b c d e f g h i j k l m n o p q r s t u v w x y z " * 200))
    at = repeats.minimisers(h, 20, 50)
    out = repeats._settled(np.tile(repeats.rolling(h, 20)[at].view(np.int64), 3), np.repeat([7, 7, 8], len(at)), np.tile(at, 3))
    assert len(out["key"]) <= 3 * len(set(repeats.rolling(h, 20)[at].tolist()))


def test_cut_spans():
    assert repeats.cut_spans("a b\nc  d e", [(1, 2)]) == "a \n  d e" and repeats.cut_spans(None, [(0, 1)]) is None


# -- transcripts


def test_blocks_equal_decoding_the_whole(spark):
    rng = random.Random(11)
    rows = [(c, p, rng.choice(["User: hi", "assistant: " + "word " * rng.randint(1, 300), "go on", "", None, "Really?", "system: be brief", "- a\n- b"]), "x", "y") for c in (1, 2) for p in range(60)]
    df = spark.createDataFrame(rows + rows[:1] + [(None, None, "Human: lost", "x", "y")], "conv_id bigint, turn bigint, text string, role string, rendered string")
    model = chat.default_model()
    whole = sorted(map(str, chat.assign_roles(df, model).collect()))
    assert len(whole) == 121
    assert sorted(map(str, chat.assign_roles(df, model, block=7).collect())) == whole
    for c in (1, 2):
        texts = [t for cc, _, t, *_ in rows if cc == c]
        best = chat.viterbi(model.emissions(texts), model.start, model.step)
        got = [r.role for r in chat.assign_roles(df, model, block=7).where(f"conv = {c}").orderBy("pos").collect()]
        assert got == [model.roles[s] for s in best]
    assert chat.assign_roles(df.limit(0), model).count() == 0


def test_lines_anywhere_are_decoded(spark):
    """Negative positions, many lines of one position, repeated rows, lines without an id or a position."""
    texts = ["User: hi", "ok", "assistant: yes", "more words here", "Really?"]
    rows = [(1, p, texts[p % 5]) for p in range(-9, 9)] + [(2, 3, f"line {i}") for i in range(300)] + [(1, 0, texts[0])] * 500
    rows += [(None, p, "User: a") for p in range(40)] + [(3, None, f"go {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    model = chat.default_model()
    for block in (4096, 4):
        got = chat.assign_roles(df, model, block=block).collect()
        assert len(got) == len(set(rows))
        own = sorted((r.pos, r.role, r.starts_turn) for r in got if r.conv == 1)
        best = chat.viterbi(model.emissions([texts[p % 5] for p in range(-9, 9)]), model.start, model.step)
        assert [r for _, r, _ in own] == [model.roles[s] for s in best]
        assert all(r.starts_turn for r in got if r.conv is None or r.pos is None)
        best = chat.viterbi(model.emissions(sorted(f"line {i}" for i in range(300))), model.start, model.step)
        assert [r.role for r in sorted((r for r in got if r.conv == 2), key=lambda r: r.text)] == [model.roles[s] for s in best]
    assert chat.fit(df.withColumn("role", F.lit("user"))).roles == ["user"]


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(12)
    e, start, step = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    score = lambda s: start[s[0]] + sum(e[i, x] for i, x in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:], strict=False))
    assert tuple(chat.viterbi(e, start, step)) == max(itertools.product(range(3), repeat=5), key=score)


def test_transcripts_are_parsed(spark):
    text = "**User**: What is two and two?\nAssistant: Four.\nIt is even.\n\nHuman: Thanks"
    rows = chat.parse_transcripts(spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")).orderBy("pos").collect()
    assert "".join(r.rendered for r in rows) == "<|user|>\nWhat is two and two?\n<|assistant|>\nFour.\nIt is even.\n<|user|>\nThanks\n"


def test_roles_on_held_out_conversations(spark):
    d = "/root/testdata/sf0.01"
    roles = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    found = chat.op9_chat_roles(spark, d)
    assert found.count() == roles.count()
    assert found.where("held_out").join(roles, ["conv_id", "turn"]).agg(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).first()[0] > 0.9


# -- archives


def test_archives_round_trip(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = ["<p>a</p>", None, "", "é\r\n\r\n", "\r\n", inner, "x" + inner * 40, "<p>a</p>", "long " * 20000, inner, "WARC/1.1\r\n", "a\nWARC/1.1\r\n\r\n"]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nWARC-Type: x", p, "y") for i, p in enumerate(pages)], "page_id bigint, url string, html string, digest string")
    first = {}
    for i, p in enumerate(pages):
        first.setdefault(p or "", i)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for n, size in enumerate(("128m", "1500", "700")):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = f"{tmp_path}/{n}"
            warc.write_warc(df.coalesce(2), path)
            got = {int(r.page_id): r for r in warc.read_warc(spark, path).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert set(got) == set(range(len(pages)))
        for i, p in enumerate(pages):
            data, r = (p or "").encode(), got[i]
            assert r.payload_bytes == len(data) and r.digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            if first[p or ""] == i:
                assert (r.record_type, r.refers_to) == ("response", None) and r.sha1 == r.digest and bytes(r.payload) == data
            else:
                assert (r.record_type, r.refers_to) == ("revisit", str(first[p or ""]))
    warc.write_warc(df, f"{tmp_path}/big", min_bytes=20)
    assert {int(r.page_id) for r in warc.read_warc(spark, f"{tmp_path}/big").where("record_type = 'revisit'").collect()} == {9}
    warc.write_warc(df.limit(0), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_long_headers_are_read(spark, tmp_path):
    """A url may be longer than a split, and the records behind it are read too."""
    pages = [("http://a/" + "u" * n, f"<p>{i}</p>") for i, n in enumerate((5, 200_000, 10, 70_000, 3, 65_536, 1))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    warc.write_warc(df.coalesce(1), f"{tmp_path}/long")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "50000", "7000"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {int(r.page_id): bytes(r.payload).decode() for r in warc.read_warc(spark, f"{tmp_path}/long").collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {i: html for i, (_, html) in enumerate(pages)}
    # empty payloads whose headers are cut
    pages = [("http://a/" + "u" * (300 * i), "") for i in range(5)]
    warc.write_warc(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").coalesce(1), f"{tmp_path}/empty", min_bytes=1)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        assert {(int(r.page_id), r.sha1, bytes(r.payload)) for r in warc.read_warc(spark, f"{tmp_path}/empty").collect()} == {(i, warc.sha1_base32(b""), b"") for i in range(5)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # a header whose lines begin in three splits
    (tmp_path / "three").mkdir()
    more = "".join(f"X-{j}: {'y' * 600}\r\n" for j in range(4))
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\n{more}WARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 3\r\n\r\n{i}\n.\r\n\r\n"
    (tmp_path / "three/x.warc").write_text("".join(map(record, range(6))), newline="")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert {r.page_id for r in warc.read_warc(spark, f"{tmp_path}/three").collect()} == set("012345")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_null_and_empty_ids_are_told_apart(spark, tmp_path):
    spark.createDataFrame([("", "u", "a"), (None, "u", "b"), ("x", "u", "a"), (None, None, "a")], "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.op10_warc(spark, str(tmp_path)).collect())
    assert got == [("", "response", "None"), ("None", "response", "None"), ("None", "response", "None"), ("x", "revisit", "")]


def test_broken_chains_end(spark, tmp_path):
    """Nothing behind a gap in the chain is believed, nor a record that the file's end cuts."""
    record = lambda i, body, n=None: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) if n is None else n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc").write_text(record(1, "one") + "junk" + record(2, "two"), newline="")
    (tmp_path / "a/y.warc").write_text(record(3, "three") + record(4, "four", 4000), newline="")
    assert [r.page_id for r in warc.read_warc(spark, f"{tmp_path}/a").orderBy("page_id").collect()] == ["1", "3"]


# -- the pipeline


def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline as p
    from quern.llm import decontaminate, secrets, toxicity
    from quern.llm.common import bucket

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    seen = bucket("doc_id", 3) != 1
    model = toxicity.train(docs.where(seen), labels.where(seen), docs)
    left = {i: r.text for i, r in rows.items() if model.score(r.text)[0] < 0.7}
    groups = brute_groups(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    left = {i: t for i, t in left.items() if not matcher.find(t)}
    rank = secrets.dictionary(spark.createDataFrame([(t,) for t in left.values()], "text string"))  # that of the stage's own texts
    left = {i: secrets.redacted(t, secrets.scan(t, rank=rank)) for i, t in left.items()}
    got, out = {}, docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns, name
    assert {r.doc_id: r.text for r in out.collect()} == left
    pieces = p.run(spark, d).collect()
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.start + r.length <= r.doc_tokens
    assert set(got) == set(left) and all(got[r.doc_id] == r.doc_tokens for r in pieces)


def test_rows_that_share_an_id_are_one_document(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(None, "a b c d e f g", None, None, None), (2, "other words here entirely, yes really so", "en", "s", 3), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r.doc_id) for r in p.drop_near_duplicates(spark, docs, "").collect()) == ["1", "2", "3", "None"]
