"""Point-in-time feature join: for each question (key, time) the best version of the key that was known and valid then.

A version can be used from the later of its event and its arrival up to, not including, its expiry. Start and expiry are edits of the
set of active versions of a key. All edits and questions are sorted by key and time over the cluster (Spark's range partitioning) and
cut into blocks of bounded size, so that a hot key spans many tasks. In a block a persistent ordered tree holds the active versions by
rank: each edit copies the path to one leaf and makes a new root, a question binary-searches the root of its time and reads its maximum.

Versions that cross a block's border: one that ends in a block without starting there is active from the block's first root on. One that
covers a whole block is always active there, so only the best of these matters: the best version from each first to each last block is put
into O(log blocks) dyadic runs of blocks, and a block's best is that of the runs around it. No version is
copied to all the blocks that it covers, and nothing but Spark's own range sample goes to the driver.

Rank: latest event, then earliest arrival, then largest id, then latest expiry, then largest features. Versions of a key that are active in exactly the same
time are reduced to the best one before the sort, and equal questions are asked once.

Cases: versions with a null key, event, arrival or expiry, or that expire before they start, are never used; questions with a null key or
time have no version; null ids rank below others; repeated questions each get their answer; repeated versions count once; empty tables on
either side give questions without versions, or no rows. Further columns of questions are carried along, whatever their names; those of versions are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, plain, sorted_groups, written

INSERT, DELETE, ASK = 0, 1, 2
_BLOCK_BITS = 20  # blocks of a task
_LEVELS = 52  # of dyadic runs


class Roots:
    """A persistent ordered tree over ranks 0 to size - 1: an edit copies one path and gives a new root; older roots stay as they are.

    Node 0 is the tree without active ranks.
    """

    def __init__(self, size: int):
        self.depth = max(size - 1, 0).bit_length()
        self.low, self.high, self.most = [0], [0], [-1]

    def _node(self, low: int, high: int, most: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.most.append(most)
        return len(self.most) - 1

    def edit(self, root: int, rank: int, active: bool) -> int:
        """The root with rank switched on or off."""
        low, high, most = self.low, self.high, self.most
        path, node = [], root
        for bit in range(self.depth - 1, -1, -1):
            path.append(node)
            node = high[node] if rank >> bit & 1 else low[node]
        node = self._node(0, 0, rank) if active else 0
        for bit in range(self.depth):
            old = path.pop()
            below, above = (low[old], node) if rank >> bit & 1 else (node, high[old])
            node = self._node(below, above, most[above or below]) if below or above else 0
        return node

    def maximum(self, root: int) -> int:
        """The largest active rank, or -1."""
        return self.most[root]


def _edits(versions: DataFrame) -> DataFrame:
    """Two edits for each interval (key, start, expiry), with the best version that has it."""
    start = F.greatest("event", "arrival")
    used = versions.where("key IS NOT NULL AND event IS NOT NULL AND arrival IS NOT NULL AND expiry IS NOT NULL").withColumn("start", start).where("start < expiry")
    features = [c for c in versions.columns if c.startswith("_f")]
    best = F.max(F.struct("event", (-F.col("arrival")).alias("early"), "id", "expiry", *features)).alias("best")
    once = used.groupBy("key", "start", "expiry").agg(best)
    edits = F.array(F.struct(F.col("start").alias("time"), F.lit(INSERT).alias("kind")), F.struct(F.col("expiry").alias("time"), F.lit(DELETE).alias("kind")))
    return once.select("key", "start", "expiry", "best", F.inline(edits)).select("key", "time", "kind", "start", "expiry", "best")


def _answered(run: pa.RecordBatch) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Of the sorted edits and questions of a key in a block: each question's row and its winner's row (or None), and the rows of versions that stay open and that were open before."""
    kind, time = run.column("kind").to_numpy(), run.column("time").to_numpy()
    rows, asked = np.flatnonzero(kind < ASK), np.flatnonzero(kind == ASK)
    if not len(rows):
        return [None] * len(asked), asked, rows, rows
    spans = np.stack([run.column(c).take(pa.array(rows)).to_numpy() for c in ("start", "expiry")], axis=1)
    _, first, version = np.unique(spans, axis=0, return_index=True, return_inverse=True)
    version = version.reshape(-1)
    best = run.column("best").take(pa.array(rows[first]))
    order = pc.sort_indices(pa.table(dict(zip((f.name for f in best.type), best.flatten(), strict=True))), sort_keys=[(c, "ascending") for c in ("event", "early", "id", "expiry")], null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    inserted, deleted = (np.bincount(version[kind[rows] == k], minlength=len(order)) > 0 for k in (INSERT, DELETE))
    tree, root = Roots(len(order)), 0
    for r in rank[deleted & ~inserted].tolist():
        root = tree.edit(root, r, True)
    roots = [root]
    for r, k in zip(rank[version].tolist(), kind[rows].tolist(), strict=True):
        roots.append(tree.edit(roots[-1], r, k == INSERT))
    at = np.searchsorted(time[rows], time[asked], side="right")
    tops = [tree.maximum(roots[j]) for j in at.tolist()]
    winners = [int(rows[first[order[top]]]) if top >= 0 else None for top in tops]
    return winners, asked, rows[first[inserted & ~deleted]], rows[first[deleted & ~inserted]]


def _answers(edits: DataFrame, asks: DataFrame, block: int) -> DataFrame:
    """(key, time, best) of each question."""
    nothing = [F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in ("start", "expiry", "best")]
    line = edits.unionByName(asks.select("key", "time", F.lit(ASK).alias("kind"), *nothing))
    order = ["key", "time", "kind", "start", "expiry"]
    placed = line.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("bigint"))
    schema = f"what string, block bigint, key {edits.schema['key'].dataType.simpleString()}, time bigint, start bigint, expiry bigint, best {edits.schema['best'].dataType.simpleString()}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for number, whole in enumerate(_blocks(batches, block)):
            name = (whole.column("task")[0].as_py() << _BLOCK_BITS) + number
            for rows, cuts in sorted_groups(iter([whole]), ["key"]):
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    run = rows.slice(a, b - a)
                    winners, asked, opened, closed = _answered(run)
                    at = pa.array(np.concatenate([asked, opened, closed]).astype(np.int64))
                    what = ["ask"] * len(asked) + ["open"] * len(opened) + ["close"] * len(closed)
                    best = run.column("best").take(pa.array([*winners, *opened.tolist(), *closed.tolist()], pa.int64()))
                    if what:
                        yield {"what": what, "block": [name] * len(what), "best": best} | {c: run.column(c).take(at) for c in ("key", "time", "start", "expiry")}

    found = written(arrow_iter(placed, scan, schema))
    ends = found.where("what = 'close'").select("key", "start", "expiry", F.col("block").alias("last"))
    crossing = found.where("what = 'open'").join(ends.hint("merge"), ["key", "start", "expiry"])
    # the dyadic runs of the blocks strictly between a version's first and its last
    def runs_of(level: F.Column) -> F.Column:
        a, b = F.call_function("shiftright", F.col("block"), level) + 1, F.call_function("shiftright", F.col("last"), level)
        odd = lambda taken, place: F.when((a < b) & taken, F.struct(level.alias("level"), place.alias("place")))
        return F.array(odd(a % 2 == 1, a), odd(b % 2 == 1, b - 1))

    runs = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), runs_of)), lambda x: x.isNotNull())
    longest = crossing.where("last > block + 1").groupBy("block", "last").agg(F.max("best").alias("best"))
    held = longest.select("best", F.inline(runs)).groupBy("level", "place").agg(F.max("best").alias("best"))
    asked = found.where("what = 'ask'").select("block", "key", "time", "best")
    around = asked.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("level")).withColumn("place", F.expr("shiftright(block, level)"))
    carried = around.join(held.hint("merge"), ["level", "place"]).groupBy("block").agg(F.max("best").alias("held"))
    return asked.join(carried.hint("merge"), "block", "left").select("key", "time", F.greatest("best", "held").alias("best"))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least block rows, but for a task's last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= block:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def point_in_time(versions: DataFrame, asks: DataFrame, key: str = "source", event: str = "event", arrival: str = "arrival", expiry: str = "expiry", ident: str = "doc_id", features: tuple[str, ...] = (), ask_key: str = "source", ask_time: str = "t", into: str = "version", block: int = 50_000) -> DataFrame:
    """Every row of asks with a struct `into` (id, event, arrival, expiry and, if any are named, features of the version; null without one). Times are whole numbers."""
    feature_names = [f"_f{j}" for j in range(len(features))]
    given = plain(versions, key, event, arrival, expiry, ident, *features).toDF("key", "event", "arrival", "expiry", "id", *feature_names)
    given = given.withColumns({c: F.col(c).cast("bigint") for c in ("event", "arrival", "expiry")})
    names = [f"_c{j}" for j in range(len(asks.columns))]
    own = asks.toDF(*names)
    k, t = F.col(names[asks.columns.index(ask_key)]), F.col(names[asks.columns.index(ask_time)]).cast("bigint")
    wanted = own.select(k.alias("key"), t.alias("time")).where("key IS NOT NULL AND time IS NOT NULL").distinct()
    won = _answers(_edits(given), wanted, block).where("best IS NOT NULL").withColumnsRenamed({"key": "_key", "time": "_time"})
    joined = own.join(won.hint("merge"), (k == F.col("_key")) & (t == F.col("_time")), "left")
    own_features = [F.struct(*[F.col(f"best.{f}").alias(name) for f, name in zip(feature_names, features, strict=True)]).alias("features")] if features else []
    out = F.struct(F.col("best.id").alias("id"), F.col("best.event").alias("event"), (-F.col("best.early")).alias("arrival"), F.col("best.expiry").alias("expiry"), *own_features)
    return joined.select(*names, F.when(F.col("best").isNotNull(), out)).toDF(*asks.columns, into)


def _drawn(ident: F.Column, part: int) -> F.Column:
    """The part-th group of eight digits of the id's sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(ident.cast("string"), 256), 1 + 8 * part, 8), 16, 10).cast("bigint")


def op11_point_in_time(spark, sf_dir: str) -> DataFrame:
    """Every label with its source's best version at its time; an id that several documents share asks about the smallest of their sources."""
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "n_chars", "lang")
    event = _drawn(F.col("doc_id"), 0) % 20000
    versions = docs.select("doc_id", "source", "n_chars", "lang", event.alias("event"), (event - 60 + _drawn(F.col("doc_id"), 1) % 300).alias("arrival"), (event + _drawn(F.col("doc_id"), 2) % 900).alias("expiry"))
    labels = plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    asks = labels.join(docs.groupBy("doc_id").agg(F.min("source").alias("source")).hint("merge"), "doc_id", "left").select("doc_id", "source", (_drawn(F.col("doc_id"), 3) % 20000).alias("t"))
    found = point_in_time(versions, asks, features=("n_chars", "lang"))
    age = F.col("t") - F.col("version.event")
    status = F.when(F.col("version").isNull(), "none").when(age > 60, "stale").otherwise("fresh")
    fresh = lambda c: F.when(status == "fresh", F.col(f"version.features.{c}")).alias(c)
    return found.select("doc_id", "t", F.col("version.id").alias("version_id"), age.alias("age"), status.alias("status"), fresh("n_chars"), fresh("lang"))
