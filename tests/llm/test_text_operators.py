"""Language ID, toxicity, decontamination, packing and secrets on small fixtures and against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, packing, secrets, toxicity

ODD = "doc_id bigint, text string, score string, b string, predicted int"


def odd_docs(spark, texts):
    """Rows with extra columns whose names clash with results, nulls and repeated rows."""
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)] + [(None, "null id", None, None, None), (0, texts[0], "x", None, 1)]
    return spark.createDataFrame(rows, ODD)


# -- language ID


def brute_code_length(samples, text, order=3):
    """PPM straight from its definition, with dictionaries."""
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    for t in samples:
        data = b"\n" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, b"\n" * order + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            c = counts.get(data[i - k : i])
            if not c:
                continue
            total, q = sum(c.values()), len(c)
            if data[i] in c:
                bits -= np.log2(c[data[i]] / (total + q))
                break
            bits -= np.log2(q / (total + q))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition():
    samples = {"aa": [b"the cat sat on the mat", b"a hat"], "bb": [b"le chat est ici", "été".encode()]}
    model = langid.fit(samples)
    for text in (b"the chat", b"zzz", "été à la mer".encode(), b"\x00\xff", b"t"):
        for j, lang in enumerate(model.langs):
            assert model.code_lengths(text)[j] == pytest.approx(brute_code_length(samples[lang], text))


def test_pieces_of_a_text_add_up(monkeypatch):
    model = langid.fit({"aa": [b"the cat sat on the mat"], "bb": ["le chat est ici, été".encode()]})
    text = "the chat est à la mer and on ".encode() * 40
    whole = model.code_lengths(text)
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert model.code_lengths(text) == pytest.approx(whole)


def test_language_id_cases(spark):
    texts = ["the cat and the dog and the house", None, "", "123 456 !?", "der Hund und die Katze " * 2000, "the cat"]
    docs = odd_docs(spark, texts)
    train = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("no language", None), (None, "en")])], "doc_id bigint, text string, lang string, source string")
    model = langid.train(train)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[0, texts[0]][0] == "en" and got[4, texts[4]][0] == "de"
    assert got[1, None] == got[2, ""] == got[3, texts[3]] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_every_language_fills_its_bound_from_many_rows(spark, monkeypatch):
    learned = {}
    monkeypatch.setattr(langid, "fit", lambda samples, order: learned.update(samples))
    rows = [(i, "x" * (400_000 if i < 4 else 50), "long") for i in range(15)]  # a few texts hold nearly all bytes
    rows += [(100 + i, f"{i:05d} " * 2, "many") for i in range(3000)] + [(None, f"null {i:05d}", "null") for i in range(3000)]
    rows += [(None, "copy", "copies")] * 3000 + [(1, "few", "few"), (2, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = {}
    for _, t, name in rows:
        held.setdefault(name, []).append(t)
    for bound in (1 << 10, 1 << 13, 1 << 18):
        learned.clear()
        langid.train(docs.repartition(3), max_bytes_per_lang=bound)
        assert {name: sum(map(len, x)) for name, x in learned.items()} == {name: min(bound, sum(map(len, x))) for name, x in held.items() if name != "none"}
        assert len(learned["long"]) >= 4
        first = {name: list(x) for name, x in learned.items()}
        langid.train(docs.repartition(7, "text"), max_bytes_per_lang=bound)
        assert first == learned


def test_language_id_is_right_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = langid.op1_language_id(spark, sf_dir)
    assert found.count() == docs.count()
    right = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9


# -- toxicity


def test_block_max_index_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.sqrt((w * w).sum()) if len(w) else w))
    index, dense = toxicity.BlockMaxIndex.build(vectors, 60), np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:80]:
        if len(t):
            found, sims = index.nearest(t, w, 15)
            exact = dense[:, t] @ w
            best = np.lexsort((np.arange(700), -np.round(exact, 12)))[:15]
            best = best[exact[best] > 0]
            assert found.tolist() == best.tolist()
            assert sims == pytest.approx(exact[best])


def test_toxicity_cases(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choices(["sun", "tree", "river", "stone", "cloud", "bird"], k=30)) for _ in range(120)]
    bad = [t + " vile filth vile" for t in plain[:60]]
    docs = spark.createDataFrame(list(enumerate(plain + bad)) + [(None, "vile filth")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 120), 1) for i in range(180)] + [(3, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, labels, docs)
    found = {(r.doc_id, r.text): r.score for r in toxicity.score(odd_docs(spark, ["river vile bird filth", "sun tree", None, "", "x " * 50000]), model).select("doc_id", "text", "score").collect()}
    assert found[0, "river vile bird filth"] >= 0.7 > found[1, "sun tree"]
    assert found[2, None] == found[3, ""] < 0.7
    assert all(0 <= s <= 1 for s in found.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    one_class = toxicity.train(docs, labels.where("toxic = 0"), docs)
    assert {r.score for r in toxicity.score(docs, one_class).collect()} == {0.0}


def test_toxicity_terms_are_not_cut_by_rank(spark):
    """Few toxic examples of one kind count beside many of another that has thousands of words of its own."""
    rng = random.Random(9)
    plain = [" ".join(rng.choices(["sun", "tree", "river", "stone", "cloud", "bird"], k=30)) for _ in range(120)]
    many = " ".join("".join(rng.choices("abcdefghij", k=4)) + "q" for _ in range(5000))
    texts = plain + [t + " " + many for t in plain[:30]] + [t + " vile filth vile" for t in plain[30:45]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i >= 120)) for i in range(165)], "doc_id bigint, toxic int"), docs)
    assert len(model.vocabulary) > 4096 and "vile" in model.vocabulary.number
    assert model.score("river vile bird filth")[0] >= 0.7 > model.score("river bird")[0]


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.op2_toxicity(spark, d)
    assert found.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert sum(caught) >= 0.8 * len(caught) and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


# -- decontamination


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(60):
        p, t = ("".join(rng.choices("ab ", k=rng.randint(1, n))) for n in (80, 120))
        assert min(decontaminate.myers(p, t)) == edit_distance_inside(p, t) or min(decontaminate.myers(p, t)) >= len(p) == edit_distance_inside(p, t)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["short", None, ""]
    items.append(items[0])

    def damaged(t, edits):
        t = list(t)
        for _ in range(edits):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yy"])
        return "".join(t)

    texts = [None, "", "clean text", "short"]
    for x in items[:12]:
        for edits in (0, 1, 4, 9, 30):
            texts.append(" ".join(word() for _ in range(20)) + "\n" + damaged(x, edits).upper() + " " + word())
    docs, bench = odd_docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    expected = {}
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            if t and x and len(x) >= 20:
                distance = edit_distance_inside(x, decontaminate.normal(t))
                if distance <= decontaminate.budget(len(x), 0.05, 8):
                    expected[i, j] = distance
    assert got == expected and len(expected) > 20
    kept = [r.doc_id for r in decontaminate.clean(docs, bench).collect()]
    assert sorted(i for i in kept if i) == [i for i in range(1, len(texts)) if i not in {d for d, _ in expected}]
    assert decontaminate.contaminated(docs, bench, block_chars=300).count() == decontaminate.contaminated(docs, bench).count()
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_are_found_on_word_borders(spark, tmp_path):
    items = ["What is 2+2?", "red fox", " ", "", None, "a question that is longer than that"]
    texts = ["So: what\nis 2+2? Four", "A Red Fox.", "hundred fox", "red foxes, then red fox", "red  fox", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, 0, 4, 16), (1, 1, 0, 2, 9), (3, 1, 0, 16, 23)}
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {2, 4, 5, 6}


def test_contamination_spans_are_places_in_the_text():
    item = "the quick brown fox jumps over the lazy dog again and again"
    text = "Intro İ.\nThe quick  brown fox jumps over the lazy dog again and again. End"
    ((_, distance, start, end),) = decontaminate.Matcher([item]).find(text)
    assert distance == 1 and text[start:end].lower() == "the quick  brown fox jumps over the lazy dog again and again"


# -- packing


def one_by_one(lengths, window):
    """Best-fit decreasing, piece by piece."""
    room, out = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [(r, j) for j, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(window - n)
            out += 1
    return out, sorted(room)


def test_best_fit_equals_packing_one_by_one():
    rng = random.Random(4)
    for window in (16, 64):
        for _ in range(40):
            lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            room = {}
            for length, rank, count, first, per, offset in packing.best_fit(histogram, window).tolist():
                for j in range(count):
                    room.setdefault(first + j // per, []).append((offset + j % per * length, length))
            ends = []
            for pieces in room.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                ends.append(window - at)
            assert (len(room), sorted(ends)) == one_by_one(lengths, window)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, world! It's 2024.", None, "", "word " * 9000, "a b\x01c <|endoftext|> déjà vu", "same", "same"]
    pieces = packing.pack(odd_docs(spark, texts), window=512).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i)
        once = own[:: 2 if i == 0 else 1]  # the first row is repeated
        assert [s for s, *_ in once] == [0, *np.cumsum([n for _, n, *_ in once])[:-1].tolist()]
        for start, n, crc, total in once:
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) and total == len(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(odd_docs(spark, texts).limit(0)).count() == 0


# -- secrets


def test_secret_patterns():
    scan = lambda t: [(t[a:b], k) for a, b, k in secrets.scan(t) if k != "guess"]
    assert scan('x PassWord" = "abc12' + "3 y") == [('PassWord" = "abc123', "assign")]
    assert scan("token=abc12") == scan("token=") == scan(None) == scan("") == []
    assert scan("token=abc token=abcdef") == [("token=abcdef", "assign")]
    assert scan("AKIA" + "A" * 15) == [] and scan("xAKIA" + "A" * 16) == [("AKIA" + "A" * 16, "access")]
    assert scan("g" + "a1" * 12) == [("a1" * 12, "hex")] and scan("a1" * 11 + "a") == []
    assert scan("api_key: " + "ab" * 12) == [("api_key: " + "ab" * 12, "assign"), ("ab" * 12, "hex")]


def test_guess_costs_order_values():
    cost = lambda v: secrets.guess_cost(v)[0]
    assert cost("password") < cost("p4ssw0rd") < cost("xK9$vQ2!mZ7@")
    assert cost("qwertyuiop") < cost("qpwoeiruty") and cost("aaaaaaaaaa") < cost("ahfkwnbzpq")
    assert cost("abcdefghij") < cost("jfbdahgice") and cost("19991231") < 8
    assert [w for *_, w in secrets.guess_cost("dragon1987")[1]] == ["word", "date"]
    assert cost("x9" * 500) < 10 < 100 < cost("".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400)))
    brute = lambda v: len(v) * np.log10(max(10, secrets._alphabet(v)))
    assert all(cost(v) <= brute(v) + 1e-9 for v in ("a", "zq7", "Summer2024!", "kjhsdf87234"))


def test_long_values_cost_their_guesses():
    rng = random.Random(8)
    bits = [*secrets.COMMON[:30], "P4ssword", "19991231", "2024-01-02", "abcdef", "fedcba", "qwerty", "zxcvb", "----", "xyxyxy", "aaa", "Q", "7", "$", "kf", "é"]
    seen = set()
    for _ in range(4000):
        value = "".join(rng.choices(bits, k=rng.randint(1, 6)))[: rng.randint(1, 40)]
        cheap = secrets.guessable(value, 10.0)
        assert cheap == (secrets.guess_cost(value)[0] < 10.0), value
        seen.add(cheap)
    assert len(seen) == 2
    for n in (128, 129, 5000, 200_000):  # no bound on the length changes a result
        assert [secrets.scan(word + c * n) for word, c in (("token ", "-"), ("token ", "qw"))] == [[], []]
        assert not secrets.guessable("T7#kd!92xQ" + "-" * n, 10.0)
    assert secrets.guessable("password" * 60, 20.0) and not secrets.guessable("-=" * 5000 + "T7#kd!9", 10.0)
    assert [k for *_, k in secrets.scan("token " + "h7#Kd!92xZ" * 30000)] == ["guess"]


def every_segmentation(value, rank):
    """The least cost over all segmentations, from the definition."""
    import itertools
    import math

    def price(a, b):
        """Cheapest guesses of value[a:b] as one part, brute force apart."""
        v, low, out = value[a:b], value[a:b].lower(), []
        n = len(v)
        exact, alike = rank.get(low), rank.get(low.translate(secrets.LOOKALIKES))
        if 3 <= n <= 20 and (exact or alike):
            upper = sum(c.isupper() for c in v)
            out.append(math.log10(exact or alike) + (not exact) + (0 if not upper else 0.3 if upper in (1, n) else 1.5))
        m = secrets.DATE.match(value, a)
        if m and m.end() == b:
            out.append(math.log10(365 * 120) if n > 4 else math.log10(120))
        for unit in range(1, n // 2 + 1):
            if n % unit == 0 and v == v[:unit] * (n // unit) and n >= 3 and not value.startswith(v[:unit], b):
                out.append(unit * math.log10(max(10, secrets._alphabet(v[:unit]))) + math.log10(n // unit))
        longest = lambda fits: not (b < len(value) and fits(b))
        for step in (-1, 1):
            fits = lambda j: ord(value[j].lower()) - ord(value[j - 1].lower()) == step  # noqa: B023, E731
            if n >= 3 and all(fits(j) for j in range(a + 1, b)) and longest(fits):
                out.append(math.log10(26 * n))
        fits = lambda j: secrets._adjacent(value[j - 1].lower(), value[j].lower())
        if n >= 4 and all(fits(j) for j in range(a + 1, b)) and longest(fits):
            out.append(math.log10(47) + 0.5 * n)
        return max(0.05, min(out)) if out else None

    n, per = len(value), math.log10(max(10, secrets._alphabet(value)))
    parts = {(a, b): price(a, b) for a in range(n) for b in range(a + 1, n + 1)}
    best = math.inf
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
        ends, total = [0, *cuts, n], 0.0
        for a, b in zip(ends, ends[1:], strict=False):
            one = parts[a, b]
            total += (b - a) * per if one is None else min(one, (b - a) * per)
        best = min(best, total + math.log10(math.factorial(len(ends) - 1)))
    return best


def test_guess_costs_equal_every_segmentation():
    rng = random.Random(21)
    bits = [*secrets.COMMON[:12], "Adm1n", "1999", "12/2024", "abc", "fed", "qwer", "----", "xyxy", "aaa", "Q", "7", "$", "kf"]
    rank = secrets.RANK | {"river": 300, "stone": 301}
    for _ in range(120):
        value = "".join(rng.choices([*bits, "river", "st0ne"], k=rng.randint(1, 4)))[: rng.randint(1, 11)]
        assert secrets.guess_cost(value, rank)[0] == pytest.approx(every_segmentation(value, rank)), value


def test_a_value_and_its_extension_follow_one_rule():
    for value in ("password", "T7#kd!92xQ", "Password1" * 3, "----", "correcthorse", "zq7"):
        for more in ("", "-" * 200, "0" * 200):
            v = value + more
            cost = secrets.guess_cost(v)[0]
            assert [secrets.guessable(v, b) for b in (cost - 1e-6, cost + 1e-6)] == [False, True]


def test_the_dictionary_is_the_corpus_own(spark):
    prose = ["der wichtige Schritt und the important step", "the important thing is wichtige Arbeit"] * 10
    hidden = ["the password is kqzvhwjxbn for all", "x token: kqzvhwjxbn"] * 10
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*prose, *hidden, None, "", "rare wonderful"])], "doc_id bigint, text string, w int")
    rank = secrets.dictionary(docs)
    assert {"important", "wichtige", "schritt"} <= set(rank) and not {"kqzvhwjxbn", "wonderful", "is"} & set(rank)
    assert secrets.dictionary(docs.limit(0)) == secrets.RANK and len(secrets.dictionary(docs, most=2)) <= len(secrets.RANK) + 2
    assert secrets.scan("the secret is important", rank=rank) == [] and secrets.scan("the password is kqzvhwjxbn", rank=rank) == [(16, 26, "guess")]


def test_secret_digests_follow_the_contract(spark, tmp_path):
    import hashlib
    import re

    pieces = ["password: hunter22", "Token='ab.c=d_e' ", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15, "deadbeef" * 3, "deadbeef" * 2, "api_key=" + "0af1" * 7, "pwd is T7#kd!92xQ", "é\n", "secret=abc", "nothing here ", "API-KEY => abcdefgh"]
    rng = random.Random(5)
    texts = [None, "", "x" * 100_000 + " token: abcdef"] + ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(60)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[7])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op8_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end(), 0) for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", t or "") if len(m[1]) >= 6]
        spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[0], s[2]))
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in spans)
        r = by_id[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for *_, k in spans) for j in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess")] == [x for x in text.split(",") if x]
        assert len(r.spans.split(",") if r.spans else []) == sum((r.n_assign, r.n_access, r.n_hex, r.n_guess))


def test_values_behind_two_credential_words():
    guess = lambda t: [t[a:b] for a, b, k in secrets.scan(t) if k == "guess"]
    assert guess("Your secret password: T7#kd!92xQ") == guess("secret password token: T7#kd!92xQ") == ["T7#kd!92xQ"]
    assert guess("auth token: h7#Kd!92xZ and pwd=aaaaaaaa, pass Zx9$kQ2!mZ7@") == ["h7#Kd!92xZ", "Zx9$kQ2!mZ7@"]
    assert guess("password is kqzvhwjxbnrtgfm") == ["kqzvhwjxbnrtgfm"] and guess("password is passwordadmin") == []
    assert guess("token " * 20000) == guess("password " * 20000) == guess("pwd=" * 500) == []


def test_secrets_in_rows(spark):
    texts = ["password: Zx9$kQ2!mZ7@vT", "the secret is safe with me", None, "", "password" + " " * 50000 + "x", "my token " * 20000]
    rows = secrets.find_secrets(odd_docs(spark, texts)).collect()
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in rows}
    assert (10, 24, "guess") in found[0] and not found[1] and not found[2] and not found[3] and not found[4] and not found[5]
    assert secrets.find_secrets(odd_docs(spark, texts).limit(0)).count() == 0
