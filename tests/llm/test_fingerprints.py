"""Edit embedding: walks against their definition step by step, likeness of edited texts, and the query's rows against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from quern.llm import fingerprints as fp

DOCS = "doc_id bigint, text string, fingerprint string, part int"


def stepwise(text, number):
    """Every character that walk `number` puts out, one step at a time: it goes on behind the step before the phase that the table names."""
    table = fp._shared()[0][number]
    out, phase, step = [], 0, 0
    for c in text:
        ahead = table[ord(c) % 256][phase]
        out.append(c)
        step += 1
        while step % fp.PERIOD != ahead:
            out.append(c)
            step += 1
        phase = ahead
    return out


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_samples_are_those_of_the_steps(monkeypatch, piece):
    monkeypatch.setattr(fp, "PIECE", piece)
    rng = random.Random(piece)
    for text in ("", "a", "aaaa", "".join(rng.choice("abcdé 中😀") for _ in range(150))):
        for w in range(fp.WALKS):
            said = stepwise(text, w)
            walk = fp.Walk(w).feed(fp.codes_of(text))
            assert walk.end == len(said)
            expected = [((ord(said[s]) * 2654435761) % (1 << 32)) >> 28 for s in fp._shared()[1] if s < len(said)]
            assert (np.concatenate(walk.symbols).tolist() if walk.symbols else []) == expected


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    means = []
    for edits in (0, 2, 20, 200):
        found = []
        for _ in range(12):
            text = [rng.choice("etaoin shrdlu") for _ in range(2000)]
            changed = list(text)
            for _ in range(edits):
                p = rng.randrange(len(changed))
                changed[p : p + 1] = rng.choice([[], ["x"], [changed[p], "y"]])
            found.append(fp.likeness(fp.fingerprint("".join(text)), fp.fingerprint("".join(changed))))
        assert all(0 <= x <= 1 for x in found)
        means.append(float(np.mean(found)))
    assert means[0] == 1 and means[1] > 0.9 and means[1] > means[2] > means[3]
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint("abc")) == 0


def test_rows_equal_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc d") for _ in range(rng.choice([0, 1, 2, 5, 300])))) for i in rng.sample(range(1000), 120)]
    rows += [(2000, None), (2001, "x" * 70_000), (2002, "x" * 70_000), (-5, "é😀" * 9)]
    for part in (rows, rows[:1], []):
        df = spark.createDataFrame([(*r, "clash", 3) for r in part], DOCS)
        got = {r.id: r for r in fp.fingerprints(df).collect()}
        order = sorted(part, reverse=True)
        assert len(got) == len(part)
        for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
            text, following, r = text or "", following or "", got[i]
            third = len(text) // 3
            changed = text[: len(text) - third] + following[:third]
            own, other = fp.fingerprint(text), fp.fingerprint(changed)
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).digest(), own, other)
            assert (r.near_edited, r.near_next) == (fp.likeness(own, other), fp.likeness(own, fp.fingerprint(following)))


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(7, "same"), (7, "same"), (None, "other"), (7, "more"), (None, "other")], "doc_id bigint, text string")
    got = fp.fingerprints(df).collect()
    assert sorted((r.id is None, r.n_chars) for r in got) == [(False, 4)] * 3 + [(True, 5)] * 2
    assert len({r.fingerprint for r in got}) == 3


def test_bands_find_what_all_pairs_find(spark):
    """Groups by bands equal those of all pairs; copies, near copies, short and empty texts; any block size."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([40, 200, 900]))) for _ in range(14)]
    rows = list(enumerate(texts))
    for t in texts[:8]:
        for _ in range(4):
            changed = list(t)
            for _ in range(2):
                p = rng.randrange(len(changed))
                changed[p : p + 1] = rng.choice([[], ["z"], [changed[p], "y"]])
            rows.append((len(rows), "".join(changed)))
    rows += [(100, texts[2]), (101, ""), (102, None), (103, "short"), (104, "short"), (105, "shorter"), (None, texts[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    prints = {i: fp.fingerprint(t or "") for i, t in rows if i is not None}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if prints[a] == prints[b] or (min(len(dict(rows)[a] or ""), len(dict(rows)[b] or "")) > 60 and fp.likeness(prints[a], prints[b]) >= 0.8):
                    if least[b] < least[a]:
                        least[a], changed = least[b], True
    many = fp._Many(list(prints.values()))
    for j, x in enumerate(prints.values()):
        assert many.to(j) == pytest.approx([fp.likeness(x, y) for y in prints.values()])
    for tile in (512, 4):
        got = {r.id: r.class_id for r in fp.near_groups(df, tile=tile).collect()}
        assert got == least | {None: None}
    assert len(set(least.values())) < len(least) - 25
    assert fp.near_groups(df.limit(0)).count() == 0
