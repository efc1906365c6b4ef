"""Decisions over logs: calibration by knots, breakers, gates, experiments, budgets, agent control, ensembles of answers.

What depends on all earlier rows of a key in a way that sums can't express (a breaker's state, a budget that skips what doesn't fit)
is a fold over sorted rows, streamed through Arrow batches; all else is expressions and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.operators.automata import breaker, scanned
from quern.operators.isotonic import interpolated

MOST_KNOTS = 1_000_000  # that are broadcast; beyond that rows and knots are sorted together


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], schema: str) -> DataFrame:
    """rows (sorted by order within key) with the columns of schema, which step yields for each row; start makes a key's state, which step changes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now != (row[key],):
                    now, state = (row[key],), start()
                out.append(step(state, row))
            parts = zip(*out, strict=True) if out else [()] * len(target)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, f.type) for c, f in zip(parts, target, strict=True)]], [*batch.schema.names, *target.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, {schema}")


# -- calibration


def calibrated(rows: DataFrame, knots: DataFrame, column: str = "predicted") -> DataFrame:
    """rows with calibrated: the line between the knots (boundary, value) around a prediction, the outer values beyond them; unchanged without knots."""
    if knots.limit(MOST_KNOTS + 1).count() > MOST_KNOTS:
        return interpolated(rows, knots, column)
    found = [(r.boundary, r.value) for r in knots.select("boundary", "value").orderBy("boundary", "value").collect()]
    sent = rows.sparkSession.sparkContext.broadcast(tuple(map(np.array, zip(*found, strict=True))) if found else None)
    return _interpolated(rows, lambda kind: sent.value, column, None)


def calibrated_by_type(rows: DataFrame, knots: DataFrame, column: str = "predicted", kind: str = "kind") -> DataFrame:
    """As calibrated, with knots (kind, boundary, value) of each type; those of the null type where a type has none."""
    if knots.limit(MOST_KNOTS + 1).count() > MOST_KNOTS:
        return interpolated(rows, knots, column, kind)
    by_kind: dict = {}
    for r in knots.orderBy("boundary", "value").collect():
        by_kind.setdefault(r.kind, []).append((r.boundary, r.value))
    sent = rows.sparkSession.sparkContext.broadcast({k: tuple(map(np.array, zip(*v, strict=True))) for k, v in by_kind.items()})
    return _interpolated(rows, lambda k: sent.value.get(k, sent.value.get(None)), column, kind)


def _interpolated(rows: DataFrame, knots_of: Callable, column: str, kind: str | None) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", calibrated double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(kind).to_pylist() if kind else [None] * batch.num_rows
            out = []
            for x, k in zip(batch.column(column).to_pylist(), kinds, strict=True):
                found = knots_of(k)
                out.append(x if x is None or found is None else float(np.interp(x, *found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "calibrated"])

    return rows.mapInArrow(run, schema)


# -- breakers

# fixed values: what is advised for each reason
ADVICE = {
    "low_evidence": "Try a more specific query or add relevant keywords",
    "no_relevant_results": "Reformulate query; this topic may not be covered",
    "conflicting_sources": "Ask about a specific aspect to resolve ambiguity",
}


def breaker_decision(score: Column, sufficient: Column, hits: Column, best: Column, conflicts: Column, evidence: float = 0.4, relevance: float = 0.5, least: int = 2) -> Column:
    """(allow, reason, reasons, gap, advice): every reason in order, the primary one with the largest gap (the first of equals). Null inputs give no reason."""
    rules = ((score < evidence, "low_evidence", evidence - score), (~sufficient, "no_relevant_results", F.lit(0.3)), (hits < least, "no_relevant_results", F.lit(0.5)), (best < relevance, "no_relevant_results", relevance - best), (conflicts, "conflicting_sources", F.lit(0.2)))
    found = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.round(gap, 6).alias("gap"), F.lit(-n).alias("n"), F.lit(reason).alias("reason"))) for n, (hit, reason, gap) in enumerate(rules)]))
    first = F.array_max(found)
    advice = reduce(lambda out, kv: F.when(first["reason"] == kv[0], kv[1]).otherwise(out), ADVICE.items(), F.lit(None).cast("string"))
    return F.struct((F.size(found) == 0).alias("allow"), first["reason"].alias("reason"), F.size(found).alias("reasons"), first["gap"].alias("gap"), advice.alias("advice"))


def breaker_states(log: DataFrame, key: str, order: list[str], op: str = "op", most: int = 3, block: int = 4096) -> DataFrame:
    """log with state, failures and trips behind each operation: pass and fail (checks), success, failure, half_open, reset. A key's log may span many tasks."""
    out = scanned(log, key, order, op, breaker(most), ["failures", "trips"], block=block)
    return out.withColumns({c: F.col(c).cast("int") for c in ("failures", "trips")})


# -- gates

# fixed values: what a metric may lose (or gain, where lower is better)
THRESHOLDS = {"accuracy": 0.02, "recall_at_k": 0.03, "citation_accuracy": 0.05, "latency_p50_ms": 0.20, "latency_p99_ms": 0.30, "cost_per_query": 0.15}
LOWER = ("latency_p50_ms", "latency_p99_ms", "cost_per_query")


def snapshots(results: DataFrame) -> DataFrame:
    """Snapshots of evaluation outputs: recall at 10 before recall at k (a zero counts as none), no count as 0."""
    names = results.columns
    get = lambda c, kind="double": F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
    recall = F.coalesce(F.nullif(get("recall_at_10"), F.lit(0.0)), get("recall_at_k"))
    cols = {"accuracy": get("accuracy"), "recall_at_k": recall, **{c: get(c) for c in THRESHOLDS if c not in ("accuracy", "recall_at_k")}, "eval_count": F.coalesce(get("eval_count", "int"), F.lit(0))}
    return results.select("version", *[v.alias(k) for k, v in cols.items()])


def gate(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """A row for each row of current: passed, regressions, improvements (names in order) and warnings against the baseline of its key.

    A change is relative to the baseline, its sign such that worse is more; improvements are beyond half a threshold. Without a
    baseline the gate passes with a warning; so does one of fewer than 20 evaluations.
    """
    then = baseline.select(F.col(key), F.struct(*THRESHOLDS).alias("_then"))
    change = {}
    for m, limit in THRESHOLDS.items():
        a, b = F.col(m), F.col("_then")[m]
        diff = F.when(b == 0, 0.0).otherwise((a - b) / b if m in LOWER else (b - a) / b)
        change[m] = (diff, limit)
    pick = lambda test: F.array_compact(F.array(*[F.when(test(x, limit), F.lit(m)) for m, (x, limit) in change.items()]))
    worse, better = pick(lambda x, limit: x > limit), pick(lambda x, limit: x < -limit * 0.5)
    none = F.col("_then").isNull()
    empty = F.array().cast("array<string>")
    warn = F.when(none, F.array(F.lit("no_baseline"))).when(F.col("eval_count") < 20, F.array(F.lit("low_eval_count"))).otherwise(empty)
    out = current.join(then, key, "left")
    return out.select(key, (none | (F.size(worse) == 0)).alias("passed"), F.when(none, empty).otherwise(worse).alias("regressions"), F.when(none, empty).otherwise(better).alias("improvements"), warn.alias("warnings"))


def replaced_baseline(current: DataFrame, baseline: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The next baselines: a snapshot takes its key's place unless it regresses (with force always)."""
    checked = gate(current, baseline, key).select(key, (F.col("passed") | F.lit(force)).alias("_ok"))
    taken = current.join(checked.where("_ok").select(key), key, "left_semi")
    return taken.unionByName(baseline.join(taken.select(key), key, "left_anti"), allowMissingColumns=True)


def deployable(current: DataFrame, baseline: DataFrame, key: str, tests: Column, override: Column, least: int = 50) -> DataFrame:
    """(key, allowed, blockers) of the current snapshots: failed tests, too few evaluations and regressions stand in the way, unless overridden. tests and override are expressions over them."""
    checked = gate(current, baseline, key).select(key, "regressions")
    few = F.concat(F.lit("Insufficient eval count ("), F.col("eval_count").cast("string"), F.lit(f" < {least})"))
    found = F.concat(F.array_compact(F.array(F.when(~tests, "Tests failed"), F.when(F.col("eval_count") < least, few))), F.transform("regressions", lambda r: F.concat(F.lit("Regression: "), r)))
    rows = current.join(checked, key).select(key, override.alias("_o"), found.alias("_b"))
    return rows.select(key, (F.col("_o") | (F.size("_b") == 0)).alias("allowed"), F.when(F.col("_o"), F.array(F.lit("Manual override enabled"))).otherwise(F.col("_b")).alias("blockers"))


# -- experiments


def normalised(variants: DataFrame, experiment: str = "experiment", order: str = "place") -> DataFrame:
    """Variants with weights that sum to 1 in each experiment, and the upper ends of their shares in order."""
    upto = W.partitionBy(experiment).orderBy(order)
    share = F.col("weight") / F.sum("weight").over(W.partitionBy(experiment))
    out = variants.withColumn("weight", share)
    return out.withColumn("upper", F.round(F.sum("weight").over(upto), 9))


def experiment_id(name: Column, created: Column) -> Column:
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("_"), F.date_format(created, "yyyyMMddHHmmss"))


def assigned(keys: DataFrame, variants: DataFrame, status: DataFrame, at: Column, experiment: str = "experiment") -> DataFrame:
    """keys (experiment, and what at needs) with the first variant whose share ends beyond at (in [0, 1)), the last one by default; only where the experiment's last status is active."""
    live = status.groupBy(experiment).agg(F.max_by("status", "changed").alias("_s")).where("_s = 'active'").select(experiment)
    shares = normalised(variants, experiment).groupBy(experiment).agg(F.array_sort(F.collect_list(F.struct("place", "upper", "variant"))).alias("_v"))
    hit = F.filter("_v", lambda v: v["upper"] > F.col("_at"))
    rows = keys.join(live, experiment, "left_semi").join(shares, experiment).withColumn("_at", at)
    return rows.withColumn("variant", F.when(F.size(hit) > 0, hit[0]["variant"]).otherwise(F.element_at("_v", -1)["variant"])).drop("_v", "_at")


def random_share(seed: int) -> Column:
    """A place in [0, 1) for random and weighted assignment."""
    return F.rand(seed)


# -- budgets


def recorded(requests: DataFrame, key: str, order: list[str], chunks: str = "chunks", tokens: str = "tokens", most_chunks: int = 20, most_tokens: int = 8000) -> DataFrame:
    """requests with accepted and what is used behind each: a request that would overflow either bound is refused whole, later ones may still fit."""

    def step(used: list[int], row: dict) -> tuple:
        fits = used[0] + row[chunks] <= most_chunks and used[1] + row[tokens] <= most_tokens
        if fits:
            used[0] += row[chunks]
            used[1] += row[tokens]
        return fits, used[0], used[1]

    return folded(requests, key, order, lambda: [0, 0], step, "accepted boolean, used_chunks int, used_tokens int")


def allocation(used_chunks: Column, used_tokens: Column, index: Column, parts: Column, per: int = 5, most_chunks: int = 20, most_tokens: int = 8000, reserve: int = 2000) -> Column:
    """A sub-question's share of what is left: (max_chunks, max_tokens, limited, exhausted, for_synthesis)."""
    left, room, open_ = most_chunks - used_chunks, most_tokens - used_tokens, F.greatest(F.lit(1), parts - index)
    done = (left <= 0) | (room <= 0)
    chunks = F.greatest(F.lit(1), F.least(F.lit(per), F.floor(left / open_))).cast("int")
    limited = done | (chunks < per) | (left < most_chunks // 2)
    return F.struct(F.when(done, 0).otherwise(chunks).alias("max_chunks"), F.when(done, 0).otherwise(F.greatest(F.lit(500), F.floor(room / open_))).cast("int").alias("max_tokens"), limited.alias("limited"), done.alias("exhausted"), F.greatest(F.lit(0), room - reserve).cast("int").alias("for_synthesis"))


def expanded(share: Column, quality: Column, left: Column, threshold: float = 0.7) -> Column:
    """Half as many chunks again, as far as there are some left, where a retrieval's quality is below the threshold."""
    return F.when((quality < threshold) & (left > 0), F.least(share + F.floor(share / 2), left)).otherwise(share).cast("int")


def fair_share(parts: Column, per: int = 5, most_chunks: int = 20, most_tokens: int = 8000, reserve: int = 2000) -> Column:
    """(chunks, tokens) of each of parts sub-questions before any is asked; all of it for none."""
    return F.struct(F.when(parts <= 0, per).otherwise(F.least(F.floor(most_chunks / parts), F.lit(per))).cast("int").alias("chunks"), F.when(parts <= 0, most_tokens).otherwise(F.floor((most_tokens - reserve) / parts)).cast("int").alias("tokens"))


# -- agent control

ACTIONS = ("answer", "retrieve", "think")


def action(reply: Column) -> Column:
    """(action, input) of a model's reply: by its beginning, else by the first line that begins with an action, else the whole as a thought."""
    upper = F.upper(reply)
    start, at_line = None, None
    lines = F.split(reply, "\n")
    known = lambda s: reduce(lambda a, b: a | b, [F.startswith(s, F.lit(a.upper() + ":")) for a in ACTIONS])
    line = F.try_element_at(F.filter(lines, lambda x: known(F.upper(F.trim(x)))), F.lit(1))
    for name in ACTIONS:
        n = len(name) + 1
        own = F.struct(F.lit(name).alias("action"), F.trim(F.substring(reply, n + 1, 1 << 30)).alias("input"))
        other = F.struct(F.lit(name).alias("action"), F.trim(F.substring(line, n + 1, 1 << 30)).alias("input"))
        hit, later = F.startswith(upper, F.lit(name.upper() + ":")), F.startswith(F.upper(F.trim(line)), F.lit(name.upper() + ":"))
        start = F.when(hit, own) if start is None else start.when(hit, own)
        at_line = F.when(later, other) if at_line is None else at_line.when(later, other)
    return F.coalesce(start, at_line, F.struct(F.lit("think").alias("action"), reply.alias("input")))


def reflection(reply: Column) -> Column:
    """(sufficient, missing, confidence, reasoning, parsed) of a reply in JSON, fenced or not; insufficient with confidence 0 where it can't be read."""
    body = F.trim(reply)
    fenced = F.regexp_replace(F.try_element_at(F.split(body, "```"), F.lit(2)), "^json", "")
    text = F.trim(F.when(F.startswith(body, F.lit("```")), fenced).otherwise(body))
    data = F.from_json(text, "sufficient boolean, missing_info array<string>, confidence double, reasoning string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fine = data.isNotNull() & data["_bad"].isNull()
    return F.struct(
        F.when(fine, F.coalesce(data["sufficient"], F.lit(False))).otherwise(False).alias("sufficient"),
        F.when(fine, F.coalesce(data["missing_info"], F.array().cast("array<string>"))).otherwise(F.array(F.lit("Unable to parse reflection response"))).alias("missing"),
        F.when(fine, F.coalesce(data["confidence"], F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(fine, F.coalesce(data["reasoning"], F.lit(""))).otherwise("Parse error").alias("reasoning"),
        fine.alias("parsed"),
    )


def follow_ups(missing: Column) -> Column:
    """Queries for the first three things that are missing."""

    def one(m: Column) -> Column:
        low = F.lower(m)
        detail = F.contains(low, F.lit("specific")) | F.contains(low, F.lit("detail"))
        return F.when(detail, F.concat(F.lit("What are the specific details of "), m, F.lit("?"))).when(F.contains(low, F.lit("example")), F.concat(F.lit("Show examples of "), m)).when(F.contains(low, F.lit("how")), m).otherwise(F.concat(F.lit("Explain "), m))

    return F.transform(F.slice(missing, 1, 3), one)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def alternative_query(query: Column) -> Column:
    """A shorter or differently opened query."""
    words = _words(query)
    asks = F.exists(words, lambda w: F.lower(w).isin("how", "what", "why", "when"))
    return F.when(F.size(words) > 5, F.array_join(F.slice(words, 1, 5), " ")).when(asks, F.concat(F.lit("explain "), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "))).otherwise(F.concat(F.lit("details about "), query))


def different_query(query: Column) -> Column:
    """A query without its proposal names, or of three words, or an overview."""
    low = F.lower(query)
    bare = F.replace(F.replace(low, F.lit("eip-"), F.lit("EIP ")), F.lit("eip "), F.lit(""))
    return F.when(F.contains(low, F.lit("eip")), bare).when(F.size(_words(query)) > 3, F.array_join(F.slice(_words(query), 1, 3), " ")).otherwise(F.concat(F.lit("overview of "), query))


def backtracking(attempts: DataFrame, key: str, order: list[str], query: str = "query", useful: str = "useful", hits: str = "hits", budget: str = "budget", failed: int = 3, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """(key, backtrack, reason, alternative) from each key's attempts: the first that holds of failures, a repeated query, few hits, no budget.

    A session's last attempts decide; its last query is compared with all earlier ones by their words.
    """
    last = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = attempts.withColumn("_n", F.row_number().over(last)).withColumn("_w", F.array_distinct(_words(F.lower(query))))
    ends = rows.where("_n = 1").select(key, F.col("_w").alias("_l"), F.col(query).alias("_q"), F.col(budget).alias("_b"))
    both = rows.join(ends, key)
    union = F.size(F.array_union("_w", "_l"))
    alike = (F.col("_n") > 1) & (F.size("_w") > 0) & (F.size("_l") > 0) & (F.size(F.array_intersect("_w", "_l")) / union > threshold)
    seen = both.groupBy(key).agg(F.count("*").alias("_c"), F.count_if((F.col("_n") <= failed) & ~F.col(useful)).alias("_f"), F.bool_or(alike).alias("_a"), F.count_if((F.col("_n") <= 3) & F.col(useful)).alias("_u"), F.avg(F.when(F.col("_n") <= 3, F.col(hits))).alias("_h"), F.first("_q").alias("_q"), F.first("_b").alias("_b"))
    failing, few = (F.col("_c") >= failed) & (F.col("_f") == failed), (F.col("_c") >= 3) & ((F.col("_u") == 0) | (F.col("_h") < least))
    reason = F.when(failing, "failures").when(F.col("_a"), "circular").when(few, "diminishing").when(F.col("_b") <= 1, "budget").otherwise("none")
    return seen.select(key, (reason != "none").alias("backtrack"), reason.alias("reason"), F.when(reason == "failures", alternative_query(F.col("_q"))).when(reason == "circular", different_query(F.col("_q"))).alias("alternative"))


# -- ensembles

# fixed values: technical terms of good answers
TERMS = ("eip", "gas", "block", "transaction", "validator", "beacon", "blob", "calldata", "consensus", "execution")
STRUCTURE = ("\n\n", "\n1.", "\n- ", "First,", "Second,", "Additionally")


def answer_quality(response: Column) -> Column:
    """0.2 below 50 characters; else 0.5 and parts for length, structure, technical terms and citations, at most 1."""
    n, low = F.size(_words(response)), F.lower(response)
    score = 0.5 + F.when(n.between(100, 1500), 0.15).when(n > 50, 0.1).otherwise(0.0)
    score = score + F.when(reduce(lambda a, b: a | b, [F.contains(response, F.lit(m)) for m in STRUCTURE]), 0.1).otherwise(0.0)
    score = score + F.least(reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in TERMS]) * 0.02, F.lit(0.15))
    score = score + F.when(response.rlike(r"\[\d+\]|\[Source:"), 0.1).otherwise(0.0)
    return F.when(F.coalesce(F.length(F.trim(response)), F.lit(0)) < 50, 0.2).otherwise(F.least(score, F.lit(1.0)))


def best_answer(runs: DataFrame, key: str, order: str = "model") -> DataFrame:
    """(key, response, model, confidence, strategy, cost) from runs (model, response, error, quality, cost): the best that came through; ties to the first model."""
    fine = runs.where("error IS NULL AND coalesce(response, '') <> ''").withColumn("_s", F.round(F.coalesce("quality", answer_quality(F.col("response"))), 6))
    best = fine.groupBy(key).agg(F.count("*").alias("_n"), F.sum("cost").alias("_c"), F.min_by(F.struct("response", "model", "_s", "quality"), F.struct(-F.col("_s"), F.col(order))).alias("_b"))
    one = F.col("_n") == 1
    out = runs.select(key).distinct().join(best, key, "left")
    sure = F.when(one, F.coalesce(F.nullif(F.col("_b.quality"), F.lit(0.0)), F.lit(0.7))).otherwise(F.col("_b._s"))
    return out.select(key, F.coalesce("_b.response", F.lit("Unable to generate response - all models failed.")).alias("response"), F.col("_b.model").alias("model"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.when(one, "single").otherwise("best").alias("strategy"), F.round(F.coalesce("_c", F.lit(0.0)), 6).alias("cost"))


def cascade(runs: DataFrame, key: str, place: str = "place", threshold: float = 0.7) -> DataFrame:
    """(key, model, quality, cost, latency): the first run in order without an error that meets the threshold, else the last one; costs add up over those tried."""
    upto = W.partitionBy(key).orderBy(place)
    fine = runs.withColumn("_ok", F.col("error").isNull()).withColumn("quality", F.when(F.col("_ok"), F.round(F.coalesce("quality", answer_quality(F.col("response"))), 6)))
    spent = fine.withColumn("_c", F.sum(F.when(F.col("_ok"), F.col("cost")).otherwise(0.0)).over(upto)).withColumn("_l", F.sum(F.when(F.col("_ok"), F.col("latency")).otherwise(0.0)).over(upto))
    met = F.coalesce(F.col("quality") >= threshold, F.lit(False))
    pick = spent.groupBy(key).agg(F.coalesce(F.min_by(F.struct("model", "quality", "_c", "_l"), F.when(met, F.col(place))), F.max_by(F.struct("model", "quality", "_c", "_l"), place)).alias("p"))
    return pick.select(key, "p.model", "p.quality", F.round("p._c", 6).alias("cost"), F.round("p._l", 6).alias("latency"))


def merged_confidence(runs: DataFrame, key: str) -> DataFrame:
    """(key, merge, vote): what an answer merged from a key's runs (the mean quality and 0.1, at most 1) and one by votes (0.85) is trusted."""
    score = F.coalesce(F.nullif(F.col("quality"), F.lit(0.0)), answer_quality(F.col("response")))
    return runs.where("error IS NULL AND coalesce(response, '') <> ''").groupBy(key).agg(F.round(F.least(F.avg(score) + 0.1, F.lit(1.0)), 6).alias("merge"), F.lit(0.85).alias("vote"))


def react(question: str, think: Callable[[list[dict]], str], retrieve: Callable[[str], list[dict]], reflect: Callable[[list[dict]], str] | None = None, most_steps: int = 10, most_retrievals: int = 5) -> dict:
    """One agent session on the driver: think, retrieve or answer until an answer, a sufficient reflection or the budget's end; the models are functions."""
    import json

    steps, found, retrievals = [], [], 0
    for _ in range(most_steps):
        reply = think(steps)
        name = next((a for a in ACTIONS if reply.upper().startswith(a.upper() + ":")), "think")
        text = reply[len(name) + 1 :].strip() if reply.upper().startswith(name.upper() + ":") else reply
        steps.append({"action": name, "input": text, "hits": 0})
        if name == "answer":
            return {"answer": text, "steps": steps, "found": found, "reason": "answered"}
        if name == "retrieve":
            if retrievals >= most_retrievals:
                break
            retrievals += 1
            hits = retrieve(text)
            found += [h for h in hits if h not in found]
            steps[-1]["hits"] = len(hits)
            if reflect is not None and (said := json.loads(reflect(found))).get("sufficient") and said.get("confidence", 0.5) >= 0.7:
                return {"answer": None, "steps": steps, "found": found, "reason": "sufficient"}
            last = [s for s in steps if s["action"] == "retrieve"][-3:]
            if len(last) == 3 and not any(s["hits"] for s in last):
                return {"answer": None, "steps": steps, "found": found, "reason": "failures"}
    return {"answer": None, "steps": steps, "found": found, "reason": f"budget for {question!r} used"}
