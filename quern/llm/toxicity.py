"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

The examples are a bounded, documented sample: of each class the ``max_examples`` labelled rows with the smallest id
hashes. Terms are lower-cased word runs and their stems (the first four to eight characters); the vocabulary holds the terms whose presence depends on the label among the
examples (chi-square at least ``min_chi2``, odds at least ``min_odds`` to one either way), however many they are; the cosine is over these
terms alone, as over all terms the topic decides which examples are near and most toxic texts are missed. Document frequencies of these terms and the number of documents are counted over the whole corpus.

A text's vector has weights (1 + ln tf) * idf, normalised. The index keeps, for each term, its postings by blocks of
example numbers with the largest weight of each block; blocks are visited in the order of their upper bounds until no
bound can beat the k-th best similarity, so the k nearest are exact. Ties go to the smaller example number.
Votes are weighted by a power of the similarity and by the class's sampling rate and shrunk towards the base rate; an isotonic fit on leave-one-out
votes of the examples (copies of an example's vector left out with it) turns them into calibrated scores.

Cases: null and empty texts, and texts without any term of the vocabulary, get the calibrated score of an empty
vote; an id with several rows is one example, that of its smallest text; equal examples are numbered by id, whatever their labels;
without labelled rows of both classes every score is the base rate (0 without any); conflicting labels of one
id count as the larger; null labels and ids teach nothing; repeated rows are scored alike. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, arrow_map, bucket, plain, values, written

_WORDS = re.compile(r"\w+")
BLOCK = 128


STEMS = range(4, 9)


def terms(text: str | None) -> list[str]:
    """A text's words, and the stems (prefixes, marked by a star) of its longer ones."""
    found = words(text)
    return found + [w[:n] + "*" for w in found for n in STEMS if len(w) > n]


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Vocabulary:
    """Numbers of the chosen terms. Most words share no beginning with any, which one lookup tells."""

    def __init__(self, chosen: list[str]):
        self.number = {t: j for j, t in enumerate(chosen)}
        self.begins = {t.rstrip("*")[: STEMS[0]] for t in chosen}

    def __len__(self) -> int:
        return len(self.number)

    def of(self, text: str | None) -> list[int]:
        """The numbers of a text's terms, repeated as often as they occur."""
        number, begins, first, out = self.number, self.begins, STEMS[0], []
        for w in words(text):
            if w[:first] in begins:
                if w in number:
                    out.append(number[w])
                out += [number[s] for n in STEMS if len(w) > n and (s := w[:n] + "*") in number]
        return out


@dataclass
class BlockMaxIndex:
    """Postings by term and block of example numbers, each with the block's largest weight."""

    n: int
    start: np.ndarray  # of the postings of term t in block b, at t * blocks + b
    example: np.ndarray
    weight: np.ndarray
    largest: np.ndarray  # by term and block

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> BlockMaxIndex:
        blocks = max(1, -(-len(vectors) // BLOCK))
        t = np.concatenate([v[0] for v in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        w = np.concatenate([v[1] for v in vectors] or [np.empty(0)])
        e = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        cell = t * blocks + e // BLOCK
        order = np.lexsort((e, cell))
        largest = np.zeros(terms * blocks)
        np.maximum.at(largest, cell, w)
        start = np.searchsorted(cell[order], np.arange(terms * blocks + 1))
        return cls(len(vectors), start, e[order], w[order], largest.reshape(terms, blocks))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, exactly."""
        blocks = self.largest.shape[1]
        bound = weights @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        found, sims, least, at, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 4
        while at < len(order) and bound[order[at]] > 0 and (len(found) < k or bound[order[at]] >= least - 1e-12):
            few = order[at : at + step]
            at, step = at + step, step * 2
            cells = (terms[:, None] * blocks + few[None, :]).ravel()
            lengths = self.start[cells + 1] - self.start[cells]
            total = int(lengths.sum())
            if not total:
                continue
            ends = np.cumsum(lengths)
            where = np.arange(total) + np.repeat(self.start[cells] - (ends - lengths), lengths)
            scores = np.bincount(self.example[where], self.weight[where] * np.repeat(np.repeat(weights, len(few)), lengths), self.n)
            hits = np.flatnonzero(scores)
            found, sims = np.concatenate((found, hits)), np.concatenate((sims, scores[hits]))
            best = np.lexsort((found, -np.round(sims, 12)))[:k]
            found, sims = found[best], sims[best]
            least = sims[-1] if len(sims) == k else 0.0
        return found, sims


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    class_weight: tuple[float, float]
    base: float
    k: int
    shrink: float
    power: float = 1.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[t] for t in terms], float))) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        toxic, weight = self.labels[found] == 1, sims**self.power
        up, down = self.class_weight[1] * weight[toxic].sum(), self.class_weight[0] * weight[~toxic].sum()
        return float((up + self.shrink * self.base) / (up + down + self.shrink))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Calibrated score, and the evidence: the nearest examples' numbers and similarities."""
        counts = Counter(self.vocabulary.of(text))
        if counts:
            found, sims = self.index.nearest(*self.vector(counts), self.k)
        else:
            found, sims = np.empty(0, np.int64), np.empty(0)
        return self.calibrated(self.vote(found, sims)), found.tolist(), sims.tolist()

    def calibrated(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.steps), 0, 1))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; equal votes are pooled first. Returns the knots of a monotone step-wise linear map."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least x, largest x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        if blocks and blocks[-1][3] == a:
            last = blocks[-1]
            last[0], last[1] = (last[0] * last[1] + b * c) / (last[1] + c), last[1] + c
        else:
            blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, v, _, hi = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + m * v) / (last[1] + v), last[1] + v, hi
    xs = [q for b in blocks for q in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [q for b in blocks for q in ((b[0], b[0]) if b[3] > b[2] else (b[0],))]
    return np.array(xs), np.array(ys)


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, max_examples: int = 4000, min_chi2: float = 20.0, min_odds: float = 3.0, k: int = 15, shrink: float = 0.5, power: float = 3.0) -> ToxicityModel:
    """docs and labels: (doc_id, text) and (doc_id, toxic) to learn from; corpus: (text) for document frequencies."""
    spark = docs.sparkSession
    known = plain(labels, "doc_id", "toxic").toDF("i", "y").where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg((F.max("y") > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ranked = known.withColumn("r", F.xxhash64("i"))
    picks = [ranked.where(F.col("y") == y).orderBy("r", "i").limit(max_examples) for y in (0, 1)]
    picked = written(picks[0].unionAll(picks[1]).select("i", "y"))  # at most twice max_examples rows, so it can be broadcast
    texts = plain(docs, "doc_id", "text").toDF("i", "t")
    # an example is one row however often its id is repeated
    examples = written(texts.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min("t").alias("t")))

    chosen = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = chosen.get(0, 0), chosen.get(1, 0)
    base = totals.get(1, 0) / max(1, totals.get(0, 0) + totals.get(1, 0))
    empty = BlockMaxIndex.build([], 0)
    if not n0 or not n1:
        return ToxicityModel(Vocabulary([]), np.empty(0), empty, np.empty(0, int), (1.0, 1.0), base, k, shrink, power, (np.array([0.0]), np.array([base])))

    # terms that depend on the label
    by_term = arrow_iter(examples.select("y", "t"), _term_counts, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    num = n * F.pow(a * (n1 - b) - b * (n0 - a), F.lit(2.0))
    chi2 = num / (float(n0) * float(n1) * (a + b) * (n - a - b + 1e-9))
    odds = ((b + 0.5) / (n1 + 1.0)) / ((a + 0.5) / (n0 + 1.0))
    strong = by_term.withColumn("c", chi2).withColumn("o", odds).where((F.col("c") >= min_chi2) & ((F.col("o") >= min_odds) | (F.col("o") <= 1 / min_odds)))
    vocabulary = Vocabulary(sorted(r.term for r in strong.select("term").collect()))

    # their document frequencies over all documents
    sent = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for t in values(batch.column(0)):
                table.update(set(sent.value.of(t)))
        yield {"term": [-1, *table], "df": [n, *table.values()]}

    counted = {r.term: r.df for r in arrow_iter(plain(corpus, "text"), frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    df = np.array([counted.get(j, 0) for j in range(len(vocabulary))], float)
    idf = np.log((1 + counted.get(-1, 0)) / (1 + df)) + 1

    # the examples' vectors; a bounded number of short lists
    rows = arrow_map(examples, lambda batch: _example_terms(batch, sent.value), "i string, y int, terms array<int>, n array<int>").collect()
    weights = (totals.get(0, 0) / n0, totals.get(1, 0) / n1)
    model = ToxicityModel(vocabulary, idf, empty, np.empty(0, int), weights, base, k, shrink, power)
    pairs = [(r.y, model.vector(dict(zip(r.terms, r.n, strict=True)))) for r in sorted(rows, key=lambda r: (r.terms, r.n, r.i))]
    model.labels = np.array([y for y, _ in pairs])
    model.index = BlockMaxIndex.build([v for _, v in pairs], len(vocabulary))

    # leave-one-out votes; an example and its copies don't vote on themselves
    votes, memo = [], {}
    for j, (y, (terms, w)) in enumerate(pairs):
        key = (y, terms.tobytes(), w.tobytes())
        if key not in memo:
            if len(terms):
                found, sims = model.index.nearest(terms, w, k + 1)
                if len(own := np.flatnonzero(found == j)):
                    found, sims = np.delete(found, own), np.delete(sims, own)
                else:
                    same = np.flatnonzero((sims > 1 - 1e-9) & (model.labels[found] == y))[:1]
                    found, sims = np.delete(found, same), np.delete(sims, same)
            else:
                found, sims = np.empty(0, np.int64), np.empty(0)
            memo[key] = model.vote(found[:k], sims[:k])
        votes.append(memo[key])
    model.steps = _isotonic(np.array(votes), model.labels.astype(float), np.array([weights[y] for y in model.labels]))
    return model


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Documents of either class that hold a term, summed within the task before the shuffle."""
    both = (Counter(), Counter())
    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
            both[y].update(set(terms(t)))
    seen = list(both[0].keys() | both[1].keys())
    yield {"term": seen, "a": [both[0][t] for t in seen], "b": [both[1][t] for t in seen]}


def _example_terms(batch: pa.RecordBatch, vocabulary: Vocabulary) -> dict:
    found, counts = [], []
    for t in values(batch.column("t")):
        c = Counter(vocabulary.of(t))
        found.append(sorted(c))
        counts.append([c[x] for x in sorted(c)])
    return {"i": batch.column("i").cast(pa.string()), "y": batch.column("y"), "terms": found, "n": counts}


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score, predicted-free evidence columns: examples (numbers) and similarities of the voters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "score double, examples array<int>, similarities array<double>"
    kept = [c for c in docs.columns if c not in ("score", "examples", "similarities")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[docs[f"`{c}`"] for c in kept]).schema] + [added])

    def step(batch: pa.RecordBatch) -> dict:
        m = sent.value
        got = [m.score(t) for t in values(batch.column(text))]
        return {c: batch.column(c) for c in batch.schema.names} | {"score": [x[0] for x in got], "examples": [x[1] for x in got], "similarities": [x[2] for x in got]}

    return arrow_map(docs.select(*[docs[f"`{c}`"] for c in kept]), step, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from labels of rows whose id bucket (of 3) isn't 1."""
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    seen = bucket("doc_id", 3) != 1
    model = train(docs.where(seen), labels.where(seen), docs)
    scored = score(docs, model)
    return scored.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
