"""The paged source against a local service whose pages are turns of conversations: batches, streams with restarts, errors in between."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quern.sources.paged import Ids, PagedSource, requested

SCHEMA = "id bigint, conv_id bigint, turn int, role string, text string"


@pytest.fixture
def service(spark, sf_dir):
    """Rows newest first; every fourth request fails first."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", "text").collect()
    rows = [{"id": 3 * i + 1, "conv_id": r.conv_id, "turn": int(r.turn), "role": r.role, "text": r.text} for i, r in enumerate(turns)]
    state = {"shown": len(rows), "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            state["asked"].append(self.path)
            if len(state["asked"]) % 4 == 0:
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            before = int(q["before"][0]) if "before" in q else 1 << 60
            own = [r for r in rows[: state["shown"]] if r["id"] < before]
            body = json.dumps(own[::-1][: int(q["size"][0])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    yield f"http://127.0.0.1:{server.server_port}/turns", rows, state
    server.shutdown()


def options(url, span=97):
    return {"url": url, "size": "20", "span": str(span), "wait": "0", "tries": "5"}


def test_a_batch_has_every_row_once(spark, service):
    url, rows, state = service
    df = spark.read.format("quern_pages").schema(SCHEMA).options(**options(url)).load()
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r.values()) for r in rows)
    state["asked"].clear()
    assert spark.read.format("quern_pages").schema(SCHEMA).options(**options(url), first=str(rows[-5]["id"])).load().count() == 5
    assert len(state["asked"]) < 6  # pages behind the range aren't asked for


def test_restarts_lose_and_repeat_nothing(spark, service, tmp_path):
    url, rows, state = service
    for shown in (0, 50, 50, 120, len(rows)):
        state["shown"] = shown
        stream = spark.readStream.format("quern_pages").schema(SCHEMA).options(**options(url)).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        found = sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()) if shown else []
        assert found == [r["id"] for r in rows[:shown]]


def test_pages_stop_at_the_range_and_errors_end(service):
    from quern.sources.paged import Batch

    url, rows, state = service
    reader = Batch([], options(url))
    assert len(list(reader.rows(Ids(rows[10]["id"], rows[12]["id"])))) == 3
    assert list(reader.rows(Ids(0, -1))) == []
    with pytest.raises(OSError):
        requested(url.replace("127.0.0.1", "127.0.0.1:1").rsplit(":", 1)[0], tries=2, wait=0)
