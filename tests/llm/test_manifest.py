"""Merkle manifest against a plain recursion: small and large buckets, null groups and ids, repeated rows, odd runs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm.manifest import FIELDS, leaf, manifest, op13_manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root of nodes and each node's siblings, as (left, right) by level."""
    paths, groups = [[] for _ in nodes], [[j] for j in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for j in range(0, len(nodes), 2):
            pair = nodes[j : j + 2]
            up.append(sha(*pair))
            for k, members in enumerate(groups[j : j + 2]):
                for m in members:
                    paths[m].append(("", pair[1]) if k == 0 and len(pair) == 2 else (pair[0], "") if k else ("", ""))
            joined.append(sum(groups[j : j + 2], []))
        nodes, groups = up, joined
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    order = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    langs = {}
    for values in order:
        langs.setdefault(values[2], []).append(values)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in names:
        langs[lang].sort(key=lambda v: (v[0] is not None, v[0] or 0, brute_leaf(v)))
        inner[lang] = tree([brute_leaf(v) for v in langs[lang]])
    root, outer = tree([inner[x][0] for x in names])
    out = []
    for lang, above in zip(names, outer, strict=True):
        for v, path in zip(langs[lang], inner[lang][1], strict=True):
            changed = v[0] is not None and zlib.crc32(str(v[0]).encode()) % 7 == 0 and v[3] is not None
            fold = brute_leaf((*v[:3], v[3] + 1, v[4]) if changed else v)
            for left, right in path + above:
                fold = sha(left, fold, right)
            out.append((v[0], brute_leaf(v), inner[lang][0], root, sha(*(a + b for a, b in path + above)), fold))
    return sorted(out, key=repr)


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice([None, "", "aé b", "x" * 300, f"t{i}"]), rng.choice(["en"] * 6 + ["de", "fr", "", None, "é"]), rng.choice(["s", None]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[: n // 5] + [rows[0]] * 5


@pytest.mark.parametrize(("n", "depth"), [(1, 2), (2, 12), (60, 1), (90, 2), (130, 12)])
def test_equals_brute_force(spark, n, depth):
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", leaf string, rank int").repartition(3)
    tampered = leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    got = manifest(docs, FIELDS, "lang", "doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered), depth)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_untampered_rows_fold_to_the_root(spark):
    docs = spark.createDataFrame(rows_of(50, 5), DOCS)
    assert all(r.folded_root == r.root for r in manifest(docs, FIELDS, "lang", "doc_id", depth=3).collect())


def test_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("b", 1.5), ("a", None), ("a", 2.5)], "name string, v double")
    got = manifest(docs, ["name", "v"], "name", "name").collect()
    assert sorted(r.id for r in got) == ["a", "a", "b"] and len({r.root for r in got}) == 1
    assert manifest(docs.limit(0), ["name", "v"], "name", "name").count() == 0


def test_query_shows_what_was_tampered_with(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None}
    assert {r.doc_id for r in op13_manifest(spark, sf_dir).collect() if not r.verified} == changed
