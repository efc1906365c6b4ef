"""A stored positional index: postings by term in blocks of document numbers, with what bounds a block's scores.

Rows are (bucket, term, block, n, most, least, gaps, words, counts, positions): the documents of one term whose numbers share their upper bits, as gaps between numbers,
their words, how often the term occurs in each and where, as gaps again. A term of many documents has many rows, dealt over tasks; a query reads the folders of its terms'
buckets, and positions only for phrases. `most` (the largest count) and `least` (the fewest words) bound every BM25 score in the block, so the k best are found by
scoring the blocks of the highest bounds first, and then those that may still hold a better one.

Terms are the lower-cased words of quern.functions.text.tokens. Texts without words have no postings, but count as documents. Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions import text as T
from quern.operators.retrieval import DIGITS
from quern.scratch import discard, written

BUCKETS = 64
BLOCK_BITS = 12  # document numbers of a block
MOST_WORDS = 1 << 21  # of a block of several documents


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(block: int, first_no: int, keys: pa.Array, words: pa.ListArray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one block: of its documents, then of its terms."""
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int32)

    def rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    yield rows(len(keys), {"no": pa.array(first_no + np.arange(len(keys))), "key": keys, "length": pa.array(lengths)})
    flat = words.flatten()
    if not len(flat):
        return
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")  # within a term by document, then by position
    code, doc = codes[order], np.repeat(np.arange(len(keys), dtype=np.int32), lengths)[order]
    pos = (np.arange(len(codes), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32))[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)  # of a term in a document
    counts = np.diff(np.append(first, len(code))).astype(np.int32)
    at = np.where(new, pos, pos - np.concatenate(([0], pos[:-1]))).astype(np.int32)
    own, held = code[first], doc[first]
    start = np.concatenate(([True], own[1:] != own[:-1]))
    head = np.flatnonzero(start)  # of a term
    edges = np.append(head, len(own)).astype(np.int32)
    gaps = np.where(start, held, held - np.concatenate(([0], held[:-1]))).astype(np.int32)
    of = lambda values, ends=edges: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    columns = {
        "term": coded.dictionary.take(pa.array(own[head])), "block": pa.array(np.full(len(head), block)), "n": pa.array(np.diff(edges)), "most": pa.array(np.maximum.reduceat(counts, head)),
        "least": pa.array(np.minimum.reduceat(lengths[held], head)), "gaps": of(gaps), "words": of(lengths[held]), "counts": of(counts), "positions": of(at, np.append(first[head], len(at)).astype(np.int32)),
    }
    yield rows(len(head), columns)


def build(chunks: DataFrame, path: str, key: str = "chunk_id", text: str = "content") -> None:
    """Writes the index of chunks: folders docs (no, key, words) and postings.

    A task numbers its documents and makes whole blocks of them, so no word is shuffled; a block ends early at MOST_WORDS.
    """
    kind = chunks.schema[key].dataType.simpleString()
    layout = f"no bigint, key {kind}, length int, term string, block bigint, n int, most int, least int, gaps array<int>, words array<int>, counts array<int>, positions array<int>"
    schema = to_arrow_schema(StructType.fromDDL(layout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, used = TaskContext.get().partitionId() << (33 - BLOCK_BITS), [], [0, 0]

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, used
            if held:
                yield from _block(block, block << BLOCK_BITS, *(pa.concat_arrays([b.column(j) for b in held]) for j in (0, 1)), schema)
            block, held, used = block + 1, [], [0, 0]

        for batch in batches:
            sums = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            first = 0
            while first < batch.num_rows:
                before = sums[first - 1] if first else 0
                fit = int(np.searchsorted(sums, before + MOST_WORDS - used[1], "right")) - first
                take = min(max(fit, 0 if held else 1), (1 << BLOCK_BITS) - used[0], batch.num_rows - first)
                if take:
                    held.append(batch.slice(first, take))
                    used = [used[0] + take, used[1] + int(sums[first + take - 1] - before)]
                    first += take
                if first < batch.num_rows:
                    yield from made()
        yield from made()

    tokens = F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>"))
    both = written(chunks.select(F.col(key).alias("key"), tokens.alias("w")).mapInArrow(run, layout))
    both.where("term IS NULL").select("no", "key", F.col("length").alias("words")).write.parquet(f"{path}/docs")
    rows = both.where("term IS NOT NULL").select(_bucket(F.col("term")).alias("bucket"), "term", "block", "n", "most", "least", "gaps", "words", "counts", "positions")
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    discard(both)


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/docs")


def blocks(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The rows of the terms: only their buckets' folders are read."""
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).collect()]
    schema = "term string, block bigint, n int, most int, least int, gaps array<int>, words array<int>, counts array<int>, positions array<int>, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _running(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of gaps, anew for each run of the lengths."""
    sums = np.cumsum(gaps.astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return sums - np.repeat(sums[starts] - gaps[starts], lengths)


def postings(rows: DataFrame, positions: bool = False) -> DataFrame:
    """(term, no, words, count, positions) of blocks, a row for each document; positions are null unless they are wanted."""
    columns = ["term", "block", "n", "gaps", "words", "counts"] + ["positions"] * positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            gaps, words, counts = (batch.column(c).flatten().to_numpy() for c in ("gaps", "words", "counts"))
            no = (np.repeat(batch.column("block").to_numpy(), n) << BLOCK_BITS) + _running(gaps, n)
            if positions:
                at = _running(batch.column("positions").flatten().to_numpy(), counts).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(at))
            else:
                lists = pa.nulls(len(no), pa.list_(pa.int32()))
            term = batch.column("term").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([term, pa.array(no), pa.array(words), pa.array(counts), lists], names=["term", "no", "words", "count", "positions"])

    return rows.select(*columns).mapInArrow(run, "term string, no bigint, words int, count int, positions array<int>")


def _terms(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def _keyed(hits: DataFrame, path: str) -> DataFrame:
    return hits.join(_docs(hits.sparkSession, path).select("no", "key"), "no").drop("no")


def all_terms(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key, score) of the documents that hold all words of the query, by their number per word of the document."""
    terms = _terms(query)
    met = postings(blocks(spark, path, terms)).groupBy("no").agg(F.count("*").alias("n"), F.sum("count").alias("c"), F.first("words").alias("w"))
    return _keyed(met.where(F.col("n") == len(terms)).select("no", F.round(F.col("c") / F.col("w"), DIGITS).alias("score")), path)


def phrase(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key, n) of the documents that hold the query's words next to one another, and how often."""
    words = query.lower().split()
    terms = sorted(set(words))
    met = postings(blocks(spark, path, terms), positions=True).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m")).where(F.size("m") == len(terms))
    # a word's positions, less its place in the phrase (given as an array, as a lambda's second parameter would be an index)
    starts = reduce(F.array_intersect, [F.zip_with(F.col("m")[w], F.array_repeat(F.lit(i), F.size(F.col("m")[w])), lambda p, i: p - i) for i, w in enumerate(words)])
    return _keyed(met.select("no", F.size(starts).alias("n")).where("n > 0"), path)


def bm25_topk(spark: SparkSession, path: str, query: str, k: int = 20, k1: float = 1.2, b: float = 0.75, first_blocks: int = 8) -> DataFrame:
    """(key, score): the k best of the documents that hold all words of the query.

    The first_blocks blocks of the highest bounds are scored for a threshold; then all blocks whose bound reaches it, so the result is exact.
    """
    terms = _terms(query)
    stats = _docs(spark, path).agg(F.count("*").alias("n"), F.avg("words").alias("avg")).first()
    rows = blocks(spark, path, terms)
    df = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    if len(df) < len(terms):
        return _keyed(spark.createDataFrame([], "no bigint, score double"), path)
    idf = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), F.lit(float(np.log(1 + (stats.n - d + 0.5) / (d + 0.5)))))])
    part = lambda tf, w: idf[F.col("term")] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * w / float(stats.avg or 1)))
    bounds = written(rows.groupBy("block").agg(F.sum(part(F.col("most").cast("double"), F.col("least"))).alias("bound"), F.count("*").alias("t")).where(F.col("t") == len(terms)).select("block", "bound"))

    def best(chosen: DataFrame) -> DataFrame:
        met = postings(rows.join(chosen, "block", "left_semi")).groupBy("no").agg(F.count("*").alias("t"), F.sum(part(F.col("count").cast("double"), F.col("words"))).alias("s"))
        return met.where(F.col("t") == len(terms)).select("no", F.round("s", DIGITS).alias("score"))

    top = best(bounds.orderBy(F.desc("bound"), "block").limit(first_blocks)).orderBy(F.desc("score")).limit(k).collect()
    threshold = min(r.score for r in top) if len(top) == k else float("-inf")
    # scores are rounded, so a bound counts from just below the threshold on
    hits = _keyed(best(bounds.where(F.col("bound") >= threshold - 10.0**-DIGITS)).where(F.col("score") >= threshold), path)
    return hits.orderBy(F.desc("score"), "key").limit(k)
