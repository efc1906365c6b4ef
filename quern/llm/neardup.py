"""Near-duplicate groups by HyperMinHash, confirmed on whole shingle sets.

1. A text's set holds the hashes of its distinct runs of ``width`` words (of the whole sequence, if shorter). Texts with
   equal sets form a class, represented by its smallest id; later steps see representatives only.
2. A sketch has ``BANDS * ROWS`` registers, one for each bucket of hashes (by their first bits). A register holds, of the smallest
   hash in its bucket, the leading-zero count (6 bits) behind the bucket's bits and the next 10 bits. An empty bucket takes the
   register of the first filled one in an order of its own. ROWS compressed registers packed in a long form a band key.
3. Representatives that share a band key form a bucket; buckets with the same members are one. A bucket's
   members are linked where the collision-corrected estimate from their sketches comes near the threshold
   (``margin`` below it, over four standard deviations; any estimate will do for sets of up to ``SMALL`` shingles, which fill few
   buckets), and only a spanning star of each linked part leaves the task.
4. Components of these links are clusters of candidates. Each cluster's whole sets meet in one task, and pairs
   are confirmed exactly by counting common shingles through an inverted index. Again only spanning stars leave.
5. Components of the confirmed links are the groups.

Within a bucket or cluster a member is compared with all others at once, and members are taken up until only the largest
linked part has untried ones: links among that part can't change the result, and links of all others are known.
So a large group of near copies costs few comparisons, and no link that joins two parts is lost. Larger buckets and
clusters are dealt as pairs of blocks (tiles), so that every pair still meets somewhere.

At similarity 0.8 the probability that two texts share no band is about (1 - 0.8**4)**32, 5e-8.

Cases: null or empty texts have no shingles and are never linked; ties and copies share a class; rows with null ids
are counted but not linked (component null, kept true); repeated rows are one document; no rows give no rows.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, arrow_iter, arrow_map, flat, mix, plain, rolling, sorted_groups, written
from quern.llm.graph import components

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
SMALL = 64  # shingles of a set whose estimate isn't used
_BITS = REGISTERS.bit_length() - 1
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS)
#: for each bucket the order in which it looks for a filled one
_ORDER = np.argsort(mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
_BANDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
#: chance that two different minima agree in a register: equal leading zeros (about 1/3), then 10 equal bits
COLLISION = 2.0**-10 / 3


class Shingles:
    """The sorted set of hashes of a text's runs of width words; words lie between ASCII white space, A-Z in lower case."""

    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = self.words(words)
        k = min(self.width, len(h))
        return np.unique(mix(rolling(h, k) + np.uint64(k)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty: exponent and leading mantissa bits of each bucket's smallest hash."""
    shingles = np.sort(shingles)
    first = np.searchsorted(shingles, _STARTS)
    filled = np.diff(np.append(first, len(shingles))) > 0
    least = shingles[np.minimum(first, len(shingles) - 1)] << np.uint64(_BITS)
    # a double's exponent is 63 less the leading zeros, its mantissa the bits behind the first one
    out = ((least.astype(np.float64).view(np.uint64) >> np.uint64(42)) & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimate(matches: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance agreement."""
    return (matches / REGISTERS - COLLISION) / (1 - COLLISION)


def linked_parts(n: int, linked_to: Callable[[int], np.ndarray]) -> np.ndarray:
    """Part (its smallest member) of each of n members; linked_to gives a member's links to all as booleans."""
    part = np.arange(n)
    tried = np.zeros(n, bool)
    while True:
        open_ = ~tried & (part != np.bincount(part).argmax())
        if tried.any() and not open_.any():
            return part
        x = int(open_.argmax()) if open_.any() else 0
        tried[x] = True
        there = linked_to(x)
        there[x] = True
        parts = np.unique(part[there])
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]


def _stars(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member to the smallest id of its part."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    other = least[part]
    keep = ids != other
    return ids[keep], other[keep]


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles = Shingles(width)
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig.append(sketch(s).tobytes() if len(s) else None)
            yield {"doc_id": batch.column(0), "n": n, "h1": h1, "h2": h2, "sig": sig}

    return arrow_iter(docs, run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def _bands(batch: pa.RecordBatch) -> dict:
    sigs = flat(batch.column("sig"), "u2")[0].reshape(-1, BANDS, ROWS)
    keys = mix(np.ascontiguousarray(sigs).view(np.uint64).reshape(-1, BANDS) ^ _BANDS).view(np.int64)
    return {"key": keys.ravel(), "rep": np.repeat(batch.column("rep").to_numpy(), BANDS)}


def _blocks(size: str, least: int, more: int) -> F.Column:
    """Blocks of a group: 16 at most, as each row goes to as many tiles, but for blocks of at least least and at most more times that."""
    return F.ceil(F.col(size) / F.greatest(F.least(F.col(size) / 16, F.lit(float(least * more))), F.lit(float(least))))


def _tiles(rows: DataFrame, blocks: str, member: str) -> DataFrame:
    """Rows dealt to the pairs of blocks (i, j) of their group; groups of one block have the one tile (0, 0)."""
    out = rows.withColumn("b", F.expr(f"CAST(pmod(xxhash64({member}), {blocks}) AS INT)"))
    out = out.withColumn("other", F.explode(F.expr(f"sequence(0, CAST({blocks} AS INT) - 1)")))
    return out.withColumn("i", F.least("b", "other")).withColumn("j", F.greatest("b", "other")).drop("b", "other")


def candidate_links(reps: DataFrame, threshold: float, margin: float = 0.18, tile: int = 512) -> DataFrame:
    """Spanning links (a, b) of representatives (rep, n, sig) whose sketches are near; tile: members a block, see _blocks."""
    light = arrow_map(reps.select("rep", "sig"), _bands, "key bigint, rep bigint")
    buckets = light.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    alike = buckets.groupBy("size", "x", "least", "most").agg(F.min("key").alias("key"))  # one of the buckets with the same members
    members = written(light.join(alike.select("key", _blocks("size", tile, 16).alias("blocks")), "key"))
    rows = _tiles(members.join(reps.select("rep", "n", "sig"), "rep"), "blocks", "rep").select("key", "i", "j", "rep", "n", "sig")
    need = int(np.ceil(REGISTERS * ((threshold - margin) * (1 - COLLISION) + COLLISION)))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cuts in sorted_groups(batches, ["key", "i", "j"]):
            ids, sizes, sigs = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), flat(batch.column("sig"), "u2")[0].reshape(-1, REGISTERS)
            a, b = [], []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end - start > 1:
                    s, n = sigs[start:end], sizes[start:end]
                    part = linked_parts(end - start, lambda x: (((s == s[x]).sum(axis=1) >= need) | (np.minimum(n, n[x]) <= SMALL)) & (np.minimum(n, n[x]) >= (threshold - 1e-9) * np.maximum(n, n[x])))  # noqa: B023
                    p, q = _stars(ids[start:end], part)
                    a.append(p)
                    b.append(q)
            if a:
                yield {"a": np.concatenate(a), "b": np.concatenate(b)}

    return arrow_iter(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), link, "a bigint, b bigint")


def common(sets: np.ndarray, cuts: np.ndarray) -> Callable[[int], np.ndarray]:
    """For packed sets: a function from a set's number to its numbers of common members with all sets."""
    n = len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    order = np.argsort(sets, kind="stable")
    ordered, owners = sets[order], owner[order]
    first = np.searchsorted(ordered, sets, "left")
    last = np.searchsorted(ordered, sets, "right")

    def overlaps(x: int) -> np.ndarray:
        lo, hi = first[cuts[x] : cuts[x + 1]], last[cuts[x] : cuts[x + 1]]
        lengths = hi - lo
        ends = np.cumsum(lengths)
        return np.bincount(owners[np.arange(ends[-1]) + np.repeat(lo - (ends - lengths), lengths)], minlength=n)

    return overlaps


def confirmed_links(sets: DataFrame, percent: int, block: int = 20_000) -> DataFrame:
    """Spanning links of (cluster, rep, shingles) whose similarity reaches percent / 100; block: shingles a block, see _blocks."""
    sizes = sets.groupBy("cluster").agg(F.sum(F.octet_length("shingles") / 8).alias("total")).select("cluster", _blocks("total", block, 200).alias("blocks"))
    rows = _tiles(sets.join(sizes, "cluster"), "blocks", "rep").select("cluster", "i", "j", "rep", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, cuts in sorted_groups(batches, ["cluster", "i", "j"]):
            ids = batch.column("rep").to_numpy()
            values, offsets = flat(batch.column("shingles"), "u8")
            a, b = [], []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end - start < 2:
                    continue
                own = offsets[start : end + 1] - offsets[start]
                overlaps, n = common(values[offsets[start] : offsets[end]], own), np.diff(own)

                def linked_to(x: int, overlaps=overlaps, n=n) -> np.ndarray:
                    both = overlaps(x)
                    return 100 * both >= percent * (n + n[x] - both)

                p, q = _stars(ids[start:end], linked_parts(end - start, linked_to))
                a.append(p)
                b.append(q)
            if a:
                yield {"a": np.concatenate(a), "b": np.concatenate(b)}

    return arrow_iter(rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    base = plain(docs, id_col, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketches = written(_sketched(base, width))
    # a class's row comes with its sketch, so that neither copies nor repeated rows go further
    classes = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    classes = written(classes.select("h1", "h2", "n", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig")))
    clusters = written(_with_least(components(candidate_links(classes.select("rep", "n", "sig"), percent / 100))))

    # whole sets of the clusters' members; their ids are broadcast only where there are few, else the texts are shuffled
    few = clusters.count() <= most_broadcast
    inside = base.join(F.broadcast(clusters) if few else clusters, base["doc_id"] == clusters["node"]).select("component", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingles = Shingles(width)
        for batch in batches:
            yield {"cluster": batch.column(0), "rep": batch.column(1), "shingles": [shingles(t.as_py()).tobytes() for t in batch.column(2)]}

    found = written(arrow_iter(inside, sets, "cluster bigint, rep bigint, shingles binary").where(F.octet_length("shingles") > 0))
    groups = components(confirmed_links(found, percent))
    out = sketches.select("doc_id", "n", "h1", "h2").join(classes.drop("sig"), ["h1", "h2", "n"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _with_least(found: DataFrame) -> DataFrame:
    """The smallest node of each component too."""
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
