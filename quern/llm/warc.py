"""WARC archives: writing with revisit records, and reading splittably with boundary-chain verification.

Writing. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the smallest id becomes a response
record and the others revisit it. Spark's own text writer writes the records (any shared file system, committed
per task), since a record is its header, payload and two line ends; a folder of archives is the result.

Reading. Files are split like any text, at line feeds. Lines carry no offsets; their byte lengths, summed over each
split and then over the splits of a file, give them. A task reports each line that looks like the start of a record,
with the offset of the record that would follow it, and hashes the payload if its split holds all of it. A header that its
split cuts is completed from the following splits' lines up to the first blank one, however long it is, and a payload that crosses splits in a second pass
that only runs if there is one. A payload may hold header text too, so candidates are verified by the chain from the file's first
byte: each split's chains are followed within one task, which leaves one exit per candidate, and pointer jumping
over the few candidates that some exit hits decides which of them the file's start reaches. All else is rejected.

Joins of tables that grow with the archive are sort-merge joins; only a counted number of repeated payloads and of crossing records is broadcast.

Cases: null payloads are empty; empty payloads are equal payloads too; repeated rows of the smallest id are all
responses; null ids are written without an id and never referred to, an empty id is one like others; truncated records at the end of a file are rejected; an empty folder
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import arrow_iter, arrow_map, discard, new_scratch, plain, written

MAGIC = b"WARC/1."
GAP = "\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(ident) -> str:
    """An id as a URN: what isn't a letter, a digit or one of -._~ is escaped, so no id can end a header line."""
    return f"<urn:page:{quote(str(ident), safe='', errors='surrogatepass')}>"


def planned(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, most_broadcast: int = 20_000) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    base = plain(pages, id_col, url, payload).toDF("page_id", "url", "payload").withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    keyed = base.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    again = keyed.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    again = written(again)
    # few repeated payloads are broadcast; beyond that the pages are shuffled by digest
    joined = keyed.join(F.broadcast(again) if again.count() <= most_broadcast else again.hint("merge"), ["digest", "bytes"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Writes a folder of uncompressed archives."""

    def records(batch: pa.RecordBatch) -> dict:
        out = []
        for ident, target, text, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            revisit = refers is not None
            head = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if revisit else 'response'}",
                *([] if ident is None else [f"WARC-Record-ID: {urn(ident)}"]),
                f"WARC-Target-URI: {' '.join((target or '').split())}",
                "WARC-Date: 1970-01-01T00:00:00Z",
                f"WARC-Payload-Digest: sha1:{sha1_base32(data)}",
                f"X-Payload-Length: {len(data)}",
            ]
            if revisit:
                head += [f"WARC-Refers-To: {urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(data)}"]
            # the writer adds the record's last line feed
            out.append("\r\n".join(head) + GAP + ("" if revisit else text) + GAP[:-1])
        return {"value": out}

    rows = planned(pages, id_col, url, payload, min_bytes)
    arrow_map(rows, records, "value string").write.option("lineSep", "\n").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): lines in order within each split, without their line feed."""
    rows = spark.read.schema("value string").option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def parse_headers(block: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """(offset, fields) of each header that ends at block's end, which is before a blank line; names in lower case.

    A header starts at any line feed, its fields at the next line end after that. Fields are read once, from the last to the first,
    up to the first that isn't one, as no header reaches over it.
    """
    fields, end = {}, len(block)
    while end >= 0:
        gap = block.rfind(b"\r\n", 0, end)
        begin = gap + 2 if gap >= 0 else 0
        if fields.get("content-length", "").isdecimal() and len(fields["content-length"]) < 16 and "warc-type" in fields:
            at = begin if block.startswith(MAGIC, begin) else block.find(b"\n" + MAGIC, begin, end) + 1
            while at >= begin and at + len(MAGIC) <= end and block.startswith(MAGIC, at):
                yield at, fields
                at = block.find(b"\n" + MAGIC, at, end) + 1 or len(block)
        name, colon, value = block[begin:end].partition(b":")
        if not colon or not name or name != name.strip():
            return
        # the last of equal names holds, and it is read first
        fields.setdefault(name.decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
        end = gap


# kind: c a candidate, o the headers that the split's end cuts (at: the first one, raw: all from there),
# l a split (length: its bytes, raw: its lines up to the first blank one, body: the end of that, null without one)
SCANNED = "kind string, file string, split bigint, at bigint, body bigint, length bigint, page string, type string, refers string, digest string, bytes bigint, sha1 string, raw binary, payload binary"
_NAMES = [c.split()[0] for c in SCANNED.split(", ")]


def _row(kind: str, file: str, split: int, **more) -> tuple:
    values = {"kind": kind, "file": file, "split": split} | more
    return tuple(values.get(n) for n in _NAMES)


def _fields(f: dict[str, str]) -> dict:
    """A candidate's columns from its header."""
    ident = lambda k: unquote(f[k][len("<urn:page:") : -1], errors="surrogatepass") if f.get(k, "").startswith("<urn:page:") else None
    size = f.get("x-payload-length", "")
    return {"length": int(f["content-length"]), "page": ident("warc-record-id"), "type": f["warc-type"], "refers": ident("warc-refers-to"), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"), "bytes": int(size) if size.isdecimal() else None}


class _Split:
    """The scan of one split, line by line."""

    def __init__(self, file: str, split: int, payloads: bool):
        self.file, self.split, self.payloads = file, split, payloads
        self.at, self.lead, self.lead_end = 0, bytearray(), None
        self.leading = split > 0
        self.open_at, self.open = 0, bytearray()  # all lines from the first open header on
        self.waiting: list[tuple[int, dict]] = []  # candidates whose payload isn't complete: end and columns
        self.buffer, self.buffer_at = bytearray(), 0
        self.rows: list[tuple] = []

    def line(self, value: bytes) -> None:
        start, self.at = self.at, self.at + len(value) + 1
        if self.waiting:
            self.buffer += value
            self.buffer += b"\n"
            self._finish()
        if self.leading:
            self.lead += value
            self.lead += b"\n"
            if value == b"\r":
                self.leading, self.lead_end = False, self.at
        if value == b"\r":
            if self.open:
                for offset, fields in parse_headers(bytes(self.open[:-1]).removesuffix(b"\r")):
                    self._candidate(self.open_at + offset, _fields(fields))
                self.open = bytearray()
        elif self.open or value.startswith(MAGIC):
            if not self.open:
                self.open_at = start
            self.open += value
            self.open += b"\n"

    def _candidate(self, begin: int, fields: dict) -> None:
        columns = {"at": begin, "body": self.at} | fields
        if not self.waiting:
            self.buffer, self.buffer_at = bytearray(), self.at
        self.waiting.append((self.at + fields["length"], columns))
        self._finish()

    def _finish(self) -> None:
        still = []
        for end, columns in self.waiting:
            if end <= self.at:
                payload = bytes(self.buffer[columns["body"] - self.buffer_at : end - self.buffer_at])
                self.rows.append(_row("c", self.file, self.split, **columns, sha1=sha1_base32(payload), payload=payload if self.payloads else None))
            else:
                still.append((end, columns))
        self.waiting = still

    def end(self) -> None:
        self.rows += [_row("c", self.file, self.split, **columns) for _, columns in self.waiting]
        if self.open:
            self.rows.append(_row("o", self.file, self.split, at=self.open_at, raw=bytes(self.open)))
        self.rows.append(_row("l", self.file, self.split, length=self.at, raw=bytes(self.lead), body=self.lead_end))
        self.waiting, self.buffer = [], bytearray()

    def taken(self) -> dict:
        rows, self.rows = self.rows, []
        return dict(zip(_NAMES, map(list, zip(*rows, strict=True)), strict=True))


def _scan(lines: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = None
        for batch in batches:
            for f, s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now is None or (now.file, now.split) != (f, s):
                    if now is not None:
                        now.end()
                        yield now.taken()
                    now = _Split(f, s, payloads)
                now.line(v.as_py())
            if now is not None and now.rows:
                yield now.taken()
        if now is not None:
            now.end()
            yield now.taken()

    return arrow_iter(lines, run, SCANNED)


def verified(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, split, at, next; offsets in the file) the (file, at) that each file's first byte reaches.

    Chains are followed within each split first; pointer jumping then runs over the candidates that an exit hits.
    """
    keys = candidates.select("file", "split", "at", "next")

    def exits(group: pa.Table) -> pa.Table:
        at, nxt = group.column("at").to_numpy(), group.column("next").to_numpy()
        order = np.argsort(at, kind="stable")
        at, nxt = at[order], nxt[order]
        out = nxt.copy()
        where = np.searchsorted(at, nxt)
        inside = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == nxt)
        for j in range(len(at) - 1, -1, -1):  # successors lie behind, so they are settled first
            if inside[j]:
                out[j] = out[where[j]]
        return pa.table({"file": pa.repeat(group.column("file")[0], len(at)), "split": pa.repeat(group.column("split")[0], len(at)), "at": at, "exit": out})

    ends = written(keys.groupBy("file", "split").applyInArrow(exits, "file string, split bigint, at bigint, exit bigint"))
    start = ends.where("at = 0").select("file", "at")
    hit = ends.select("file", F.col("exit").alias("at")).distinct().join(ends.select("file", "at").hint("merge"), ["file", "at"], "left_semi")
    entries = hit.unionByName(start).distinct().join(ends.select("file", "at", "exit").hint("merge"), ["file", "at"])
    jumps, reached = written(entries.select("file", "at", F.col("exit").alias("to"))), written(start)
    first_jumps, known = jumps, jumps.select("file", "at")
    n, before = reached.count(), 0
    while n != before:
        # after r rounds jumps lead 2**r entries ahead and reached holds the first 2**r entries of each file
        ahead = reached.join(jumps.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at")).join(known.hint("merge"), ["file", "at"], "left_semi")
        reached, last = written(reached.unionByName(ahead).distinct()), reached
        discard(last)
        n, before = reached.count(), n
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps, last = written(jumps.join(further.hint("merge"), ["file", "to"]).select("file", "at", F.col("beyond").alias("to"))), jumps
        if last is not first_jumps:
            discard(last)
    marked = keys.join(reached.withColumn("entry", F.lit(True)).hint("merge"), ["file", "at"], "left")

    def follow(group: pa.Table) -> pa.Table:
        """The chain from the entry of a split."""
        group = group.take(pa.array(np.argsort(group.column("at").to_numpy(), kind="stable")))
        at, nxt = group.column("at").to_numpy(), group.column("next").to_numpy()
        good = np.array([bool(x) for x in group.column("entry").to_pylist()])
        where = np.searchsorted(at, nxt)
        for j in range(len(at)):
            if good[j] and where[j] < len(at) and at[where[j]] == nxt[j]:
                good[where[j]] = True
        return group.select(["file", "at"]).filter(pa.array(good))

    return marked.groupBy("file", "split").applyInArrow(follow, "file string, at bigint")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id (text), record_type, refers_to, digest (stated), payload_bytes (stated), sha1 and payload (null without payloads) of the verified records."""
    lines = _lines(spark, path)
    scanned = written(_scan(lines, payloads))
    order = W.partitionBy("file").orderBy("split")  # a row for each split of a file
    sizes = scanned.where("kind = 'l'").select("file", "split", "length", F.col("body").isNotNull().cast("int").alias("blank"))
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # splits of a run follow one with a blank line, and the last one has the next; a header that a split cuts goes on in the run behind that split
    splits = written(sizes.select("file", "split", before("length").alias("base"), F.sum("length").over(W.partitionBy("file")).alias("size"), before("blank").alias("run"), "blank"))
    placed = scanned.where("kind <> 'l'").join(splits.hint("merge"), ["file", "split"])
    whole = placed.where("kind = 'c'").drop("run", "blank")
    opened = placed.where("kind = 'o'").select("file", "split", "at", "raw", "base", "size", (F.col("run") + F.col("blank")).alias("run"))
    leads = scanned.where("kind = 'l'").select("file", "split", "raw").join(splits.select("file", "split", "run", "blank").hint("merge"), ["file", "split"])
    leads = leads.select("file", "run", F.struct("split", "blank", "raw").alias("lead"))
    ahead = opened.join(leads.hint("merge"), ["file", "run"]).where("lead.split > split").groupBy("file", "split").agg(*[F.first(c).alias(c) for c in ("at", "raw", "base", "size")], F.sort_array(F.collect_list("lead")).alias("leads"))

    def complete(batch: pa.RecordBatch) -> dict:
        """Headers that a split's end cuts, with the following splits' lines up to the first blank one."""
        out = {n: [] for n in [*_NAMES, "base", "size"]}
        for r in batch.to_pylist():
            leads = r.pop("leads")
            if not leads[-1]["blank"]:
                continue
            block = b"".join([r["raw"], *(x["raw"] for x in leads)])
            for offset, fields in parse_headers(block.removesuffix(b"\r\n").removesuffix(b"\n").removesuffix(b"\r")):
                row = r | _fields(fields) | {"kind": "c", "at": r["at"] + offset, "body": r["at"] + len(block), "raw": None}
                for n, values in out.items():
                    values.append(row.get(n))
        return out

    cut = arrow_map(ahead, complete, SCANNED + ", base bigint, size bigint").select(*whole.columns)
    moved = whole.unionByName(cut).withColumn("at", F.col("at") + F.col("base")).withColumn("body", F.col("body") + F.col("base"))
    found = written(moved.withColumn("next", F.col("body") + F.col("length") + len(GAP)).where("next <= size").drop("kind", "raw", "base", "size"))
    records = found.join(verified(found).hint("merge"), ["file", "at"])
    # an empty payload behind a header that a split cuts has been read already
    empty = F.col("sha1").isNull() & (F.col("length") == 0)
    records = records.withColumn("payload", F.when(empty & F.lit(payloads), F.lit(b"")).otherwise(F.col("payload"))).withColumn("sha1", F.when(empty, F.lit(sha1_base32(b""))).otherwise(F.col("sha1")))
    crossing = written(records.where("sha1 IS NULL").select("file", "at", "body", "length"))
    if not crossing.isEmpty():
        late = _crossing(lines, splits, crossing, payloads)
        records = records.join(late.hint("merge"), ["file", "at"], "left").withColumn("sha1", F.coalesce("sha1", "late")).withColumn("payload", F.coalesce("payload", "whole"))
    return records.select(F.col("page").alias("page_id"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "digest", F.col("bytes").alias("payload_bytes"), "sha1", "payload")


def _crossing(lines: DataFrame, splits: DataFrame, records: DataFrame, payloads: bool, most_broadcast: int = 200_000) -> DataFrame:
    """(file, at, late, whole) of records whose payload crosses splits: at most one for each split's end."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, at = None, 0
        for batch in batches:
            files, places, values, offsets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), []
            for f, s, v in zip(files, places, values, strict=True):
                if (f, s) != now:
                    now, at = (f, s), 0
                offsets.append(at)
                at += len(v.as_buffer()) + 1
            yield {"file": files, "split": places, "begin": offsets, "value": values}

    # the splits that each payload touches: a file's splits and payload ends in one order give the number of the split at each of these
    places = splits.select("file", F.col("base").alias("place"), F.lit(1).alias("is_split"), "split", F.lit(None).cast("struct<at:bigint,body:bigint,length:bigint>").alias("record"))
    marks = [records.select("file", place.alias("place"), F.lit(0).alias("is_split"), F.lit(None).cast("bigint").alias("split"), F.struct("at", "body", "length").alias("record")) for place in (F.col("body"), F.col("body") + F.col("length") - 1)]
    upto = W.partitionBy("file").orderBy("place", F.desc("is_split")).rowsBetween(W.unboundedPreceding, 0)
    numbered = places.unionByName(marks[0]).unionByName(marks[1]).withColumn("no", F.sum("is_split").over(upto))
    touched = numbered.where("is_split = 0").groupBy("file", "record").agg(F.min("no").alias("low"), F.max("no").alias("high"))
    touched = touched.select("file", "record.*", F.explode(F.sequence("low", "high")).alias("no"))
    # by (file, split): its base and the payloads that touch it, a few beside those that lie over all of it
    wanted = written(touched.join(numbered.where("is_split = 1").select("file", "no", "split", F.col("place").alias("base")).hint("merge"), ["file", "no"]).drop("no"))
    small = wanted.count() <= most_broadcast
    pieces = arrow_iter(lines, number, "file string, split bigint, begin bigint, value binary")
    pieces = pieces.join(F.broadcast(wanted) if small else wanted.hint("merge"), ["file", "split"]).select("file", "at", "body", "length", (F.col("begin") + F.col("base")).alias("begin"), F.concat("value", F.lit(b"\n")).alias("value"))
    hit = pieces.where((F.col("begin") < F.col("body") + F.col("length")) & (F.col("begin") + F.octet_length("value") > F.col("body")))
    gathered = hit.groupBy("file", "at", "body", "length").agg(F.sort_array(F.collect_list(F.struct("begin", "value"))).alias("parts"))

    def join(batch: pa.RecordBatch) -> dict:
        late, whole = [], []
        for r in batch.to_pylist():
            data = b"".join(p["value"] for p in r["parts"])
            skip = r["body"] - r["parts"][0]["begin"]
            data = data[skip : skip + r["length"]]
            late.append(sha1_base32(data))
            whole.append(data if payloads else None)
        return {"file": batch.column("file"), "at": batch.column("at"), "late": late, "whole": whole}

    return arrow_map(gathered, join, "file string, at bigint, late string, whole binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back and reports each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_scratch(spark)
    write_warc(pages, path)
    records = read_warc(spark, path, payloads=False)
    kind = pages.schema["page_id"].dataType
    # a response's digest is taken from the payload that was read, a revisit's from its record
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", F.when(F.col("record_type") == "response", F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
