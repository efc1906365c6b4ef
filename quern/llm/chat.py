"""Transcript parsing: a hidden Markov model recovers who speaks each line, then turns are rendered canonically.

Observations of a line are its speaker marker (if any), its length and a few line features; hidden states are the
roles. Start, transition and emission probabilities are counted (with add-one smoothing) over all lines of known role,
by aggregation, and frozen; without such lines a default model reads markers only. Viterbi gives the most likely roles.

Lines are sorted by conversation, position and text over all tasks (by ranges, so a long conversation spans several) and decoded
in blocks of at most ``block`` lines, so that none, however long, must fit a task. Conversations of several blocks take two
passes: each block is first reduced to its best score from any entering to any leaving role, a conversation's
few such tables give the roles at its block ends, and the blocks are then decoded between these. That equals decoding the
whole at once. Ties go to the role that sorts first.

Rendering: a turn is a run of lines of one role (a marker starts a new one); its first line is headed by ``<|role|>``,
markers are cut, and the lines' renderings joined in order are the canonical transcript.

Cases: null and empty texts are empty lines; repeated rows (same conversation, position and text) are one line; lines
of one position are ordered by text, positions may be negative; a line with a null id or position is a conversation of its own; no rows
give no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, bucket, plain, sorted_groups, to_arrow, written

# fixed values: names of speakers by class
SPEAKERS = {1: "user human customer question q me client caller", 2: "assistant ai bot agent answer a model chatbot", 3: "system instructions instruction context developer"}
_CLASS = {name: c for c, names in SPEAKERS.items() for name in names.split()}
MARKER = re.compile(r"^[ \t]*(?:\*\*|#{1,4} ?|\[|<\|?)?(" + "|".join(sorted(_CLASS, key=lambda n: -len(n))) + r")(?:\*\*|\]|\|?>)?[ \t]*(?::(?:\*\*)?|(?<=\|)>|(?<=[\]>])|-(?=[ \t]))[ \t]*", re.I | re.A)
SIZES = (5, 14, 2, 2)  # values of each feature: marker, length, question, structure
_LIST = re.compile(r"^(?:[-*] |\d+[.)] |```|\|)", re.M)


def features(text: str | None) -> tuple[int, int, int, int]:
    t = text or ""
    m = MARKER.match(t)
    return (_CLASS[m[1].lower()] if m else 0, min(13, len(t.split()).bit_length()), int(t.rstrip().endswith("?")), int(bool(_LIST.search(t))))


@dataclass
class RoleModel:
    roles: list[str]
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def emissions(self, texts: list[str | None]) -> np.ndarray:
        values = np.array([features(t) for t in texts]).reshape(-1, len(SIZES))
        return sum(self.emit[f][:, values[:, f]] for f in range(len(SIZES))).T


def default_model() -> RoleModel:
    """Reads markers; a line without one goes on in the same role."""
    roles = ["assistant", "system", "user"]
    emit = [np.log(np.full((3, n), 1 / n)) for n in SIZES]
    own = {"assistant": 2, "system": 3, "user": 1}
    for j, r in enumerate(roles):
        emit[0][j] = np.log(0.02)
        emit[0][j, [0, own[r]]] = np.log([0.54, 0.4])
    return RoleModel(roles, np.log([0.2, 0.3, 0.5]), np.log([[0.6, 0.05, 0.35], [0.1, 0.5, 0.4], [0.4, 0.05, 0.55]]), emit)


def _blocks(lines: DataFrame, block: int, *more: str) -> DataFrame:
    """lines with the numbers of their blocks, written; numbers ascend with the order of lines."""
    order = ["conv", "pos", "text", *more]
    rows = lines.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", block bigint"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        at, now, size = TaskContext.get().partitionId() << 32, None, block
        for batch in batches:
            numbers = []
            for c in batch.column("conv").to_pylist():
                if c != now or size == block:
                    at, now, size = at + 1, c, 0
                size += 1
                numbers.append(at)
            yield {c: batch.column(c) for c in batch.schema.names} | {"block": numbers}

    return written(arrow_iter(rows, number, schema))


def _sorted(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.repartition("block").sortWithinPartitions("block", "pos", "text", *more)


PLACED = "conv IS NOT NULL AND pos IS NOT NULL"


def _lines(rows: DataFrame, conv: str, pos: str, text: str, *more: str) -> DataFrame:
    base = plain(rows, conv, pos, text, *more).toDF("conv", "pos", "text", *more)
    return base.withColumn("pos", F.col("pos").cast("bigint")).distinct()


def fit(rows: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text", role: str = "role", block: int = 4096) -> RoleModel:
    """Counts over all lines whose role isn't null and all pairs of neighbouring ones, however they are dealt to blocks; lines without id or position stand by themselves."""
    lines = _lines(rows, conv, pos, text, role).withColumnRenamed(role, "role").where("role IS NOT NULL")
    placed = _blocks(lines.where(PLACED), block, "role")
    # the role that each block's first line follows: one row a block
    lasts = placed.groupBy("conv", "block").agg(F.max(F.struct("pos", "text", "role"))["role"].alias("last"))
    ahead = lasts.select("block", F.lag("last").over(W.partitionBy("conv").orderBy("block")).alias("before"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table: dict[tuple, int] = {}
        for batch, cuts in sorted_groups(batches, ["block"]):
            roles, before = batch.column("role").to_pylist(), batch.column("before").to_pylist()
            first = set(cuts.tolist())
            for i, (r, t) in enumerate(zip(roles, batch.column("text"), strict=True)):
                keys = [("emit", r, str(f), str(v)) for f, v in enumerate(features(t.as_py()))]
                if i not in first:
                    keys.append(("step", roles[i - 1], r, ""))
                else:
                    keys.append(("start", r, "", "") if before[i] is None else ("step", before[i], r, ""))
                for k in keys:
                    table[k] = table.get(k, 0) + 1
        if table:
            kind, a, b, c = zip(*table, strict=True)
            yield {"kind": kind, "a": a, "b": b, "c": c, "n": list(table.values())}

    grouped = _sorted(placed.join(ahead, "block", "left").select("block", "pos", "text", "role", "before"), "role")
    alone = lines.where(f"NOT ({PLACED})").select(F.monotonically_increasing_id().alias("block"), "pos", "text", "role", F.lit(None).cast("string").alias("before"))
    each = [arrow_iter(x, count, "kind string, a string, b string, c string, n bigint") for x in (grouped, alone)]
    counted = each[0].unionAll(each[1]).groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    roles = sorted({r.a for r in counted if r.kind == "emit"})
    if not roles:
        return default_model()
    at = {r: j for j, r in enumerate(roles)}
    start, step, emit = np.ones(len(roles)), np.ones((len(roles), len(roles))), [np.ones((len(roles), n)) for n in SIZES]
    for r in counted:
        if r.kind == "start":
            start[at[r.a]] += r.n
        elif r.kind == "step":
            step[at[r.a], at[r.b]] += r.n
        else:
            emit[int(r.b)][at[r.a], int(r.c)] += r.n
    return RoleModel(roles, np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def viterbi(emissions: np.ndarray, start: np.ndarray, step: np.ndarray, last: int | None = None) -> np.ndarray:
    """The most likely states; start: log scores of the first state; last: the final state, if it is known."""
    n, back, score = len(emissions), np.zeros(emissions.shape, np.int64), start + emissions[0]
    for i in range(1, n):
        through = score[:, None] + step
        back[i] = through.argmax(axis=0)
        score = through.max(axis=0) + emissions[i]
    state = int(score.argmax()) if last is None else last
    out = np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        out[i] = state
        state = back[i, state]
    return out


def assign_roles(rows: DataFrame, model: RoleModel, conv: str = "conv_id", pos: str = "turn", text: str = "text", block: int = 4096) -> DataFrame:
    """conv, pos, text, role, starts_turn and rendered for every line."""
    lines = _lines(rows, conv, pos, text)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    blocks = _blocks(lines.where(PLACED), block)
    numbers = written(blocks.groupBy("conv", "block").agg(F.count("*").alias("n")))
    many = numbers.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
    long = written(numbers.join(many, "conv", "left_semi").select("block"))
    conv_type = lines.schema["conv"].dataType.simpleString()
    ends_schema = "block bigint, enter int, leave int"
    placed = blocks.withColumn("enter", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int"))
    if not long.isEmpty():
        tables = arrow_iter(_sorted(blocks.join(long, "block", "left_semi")), lambda b: _tables(b, sent.value), f"conv {conv_type}, block bigint, table array<double>")
        schema = to_arrow(ends_schema)
        states = len(model.roles)

        def link(group: pa.Table) -> pa.Table:
            """Roles at the block ends of one conversation."""
            order = np.argsort(group.column("block").to_numpy())
            tables = [np.array(group.column("table")[int(i)].as_py()).reshape(states + 1, states) for i in order]
            score, back = tables[0][states], []
            for t in tables[1:]:
                through = score[:, None] + t[:states]
                back.append(through.argmax(axis=0))
                score = through.max(axis=0)
            leave = [int(score.argmax())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave.reverse()
            return pa.table([pa.array(group.column("block").to_numpy()[order], pa.int64()), pa.array([-1, *leave[:-1]], pa.int32()), pa.array(leave, pa.int32())], schema=schema)

        ends = written(written(tables).groupBy("conv").applyInArrow(link, ends_schema))
        placed = blocks.join(ends, "block", "left")  # a row for each block of a long conversation; the others have none
    columns, schema = ("block", "conv", "pos", "text", "enter", "leave"), f"conv {conv_type}, pos bigint, text string, role string, starts_turn boolean, rendered string"
    alone = lines.where(f"NOT ({PLACED})").select(F.monotonically_increasing_id().alias("block"), "conv", "pos", "text", F.lit(None).cast("int").alias("enter"), F.lit(None).cast("int").alias("leave"))
    return arrow_iter(_sorted(placed.select(*columns)), lambda b: _decoded(b, sent.value), schema).unionAll(arrow_iter(alone, lambda b: _decoded(b, sent.value), schema))


def _tables(batches: Iterator[pa.RecordBatch], model: RoleModel) -> Iterator[dict]:
    """Each block's best scores: rows for each entering role (the previous line's) and one for a conversation's start."""
    for batch, cuts in sorted_groups(batches, ["block"]):
        texts, out = batch.column("text").to_pylist(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            e = model.emissions(texts[a:b])
            score = np.vstack([model.step, model.start]) + e[0]
            for row in e[1:]:
                score = (score[:, :, None] + model.step[None]).max(axis=1) + row
            out.append(score.ravel().tolist())
        at = pa.array(cuts[:-1])
        yield {"conv": batch.column("conv").take(at), "block": batch.column("block").take(at), "table": out}


def _decoded(batches: Iterator[pa.RecordBatch], model: RoleModel) -> Iterator[dict]:
    for batch, cuts in sorted_groups(batches, ["block"]):
        texts, enter, leave = (batch.column(c).to_pylist() for c in ("text", "enter", "leave"))
        roles, starts, rendered = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            before = enter[a] if enter[a] is not None and enter[a] >= 0 else None
            states = viterbi(model.emissions(texts[a:b]), model.start if before is None else model.step[before], model.step, leave[a])
            for t, s in zip(texts[a:b], states.tolist(), strict=True):
                m = MARKER.match(t or "")
                first = s != before or m is not None
                body = (t or "")[m.end() :] if m else t or ""
                roles.append(model.roles[s])
                starts.append(first)
                rendered.append((f"<|{model.roles[s]}|>\n" if first else "") + body.strip() + "\n")
                before = s
        yield {"conv": batch.column("conv"), "pos": batch.column("pos"), "text": batch.column("text"), "role": roles, "starts_turn": starts, "rendered": rendered}


def parse_transcripts(rows: DataFrame, model: RoleModel | None = None, id_col: str = "id", text: str = "text") -> DataFrame:
    """Whole transcripts, one text each, cut into lines and decoded."""
    base = plain(rows, id_col, text).toDF("id", "text")
    lines = base.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("turn", "text")).where("trim(text) <> ''")
    return assign_roles(lines, model or default_model(), "id", "turn", "text")


def op9_chat_roles(spark, sf_dir: str) -> DataFrame:
    """Roles of all turns of all conversations, learned from those whose id bucket (of 2) is 0; roles are no input of a prediction."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = fit(rows.where(bucket("conv_id", 2) == 0))
    out = assign_roles(rows.select("conv_id", "turn", "text"), model)
    return out.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), (bucket("conv", 2) == 1).alias("held_out"), F.col("role").alias("role_pred"), "starts_turn", "rendered")
