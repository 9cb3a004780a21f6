"""The durable source, the sink, typed state and forgetting."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tripwatch.config import Settings
from tripwatch.functions.terms import XSD
from tripwatch.operators import forgetting
from tripwatch.operators.fold import step
from tripwatch.plans import replay
from tripwatch.sources.long_poll import LongPollSource
from tripwatch.sources.statements import numbered, triplified


class Server:
    """Answers GET from a list and keeps what is posted."""

    def __init__(self, answers=()):
        self.answers, self.posted, self.polls = list(answers), [], []
        own = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                own.polls.append((self.headers.get("X-Key"), json.loads(body or b"null")))
                status, text = own.answers.pop(0) if own.answers else (204, "")
                self.send_response(status)
                self.end_headers()
                if status == 200:
                    self.wfile.write(text.encode())

            def do_POST(self):
                own.posted.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
                self.send_response(200)
                self.end_headers()

            def log_message(self, *a):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


def message(i):
    return (200, json.dumps({"handleRequestId": i}))


def reader(server, log, **more):
    return LongPollSource({"endpoint": server.url, "log": str(log), "request_delay": "0", "retry_delay": "0", **more}).simpleStreamReader(None)


def test_lost_reader_loses_and_doubles_nothing(tmp_path):
    server = Server([message(1), (202, ""), message(2), (204, ""), message(3)])
    first = reader(server, tmp_path)
    rows, _ = first.read(first.initialOffset())
    assert len(list(rows)) == 2
    # lost before Spark wrote the offset: a new reader begins at 0, and the endpoint will not say 1 and 2 again
    second = reader(server, tmp_path, return_receipt="true")
    rows, end = second.read(second.initialOffset())
    assert [json.loads(v)["handleRequestId"] for _, v in rows] == [1, 2, 3] and end == {"seq": 3}
    # lost after the offset was written and before the commit: the batch is read again
    third = reader(server, tmp_path, return_receipt="true")
    assert [s for s, _ in third.readBetweenOffsets({"seq": 0}, end)] == [0, 1, 2] and server.posted == []
    third.commit(end)
    assert [p["handleRequestId"] for p in server.posted] == [1, 2, 3]
    assert list(third.readBetweenOffsets({"seq": 0}, end)) == [] and third.read(end)[1] == end


def test_errors_fail_the_query_unless_continuous(tmp_path):
    server = Server([(500, "")] * 3 + [(200, "no json")] * 3 + [message(1)])
    with pytest.raises(ConnectionError):
        reader(server, tmp_path / "a", retries="2").read({"seq": 0})
    rows, _ = reader(server, tmp_path / "b", retries="5").read({"seq": 0})
    assert [s for s, _ in rows] == [0]
    server.http.shutdown()
    server.http.server_close()
    rows, end = reader(server, tmp_path / "c", continuous="true").read({"seq": 4})
    assert list(rows) == [] and end == {"seq": 4}
    with pytest.raises(ValueError, match="log"):
        LongPollSource({"endpoint": "x"}).simpleStreamReader(None)


def test_headers_body_and_hooks(tmp_path):
    class Own(LongPollSource):
        def receipt(self, message):
            return {"seen": message["handleRequestId"]}

    server = Server([message(7)])
    own = Own({"endpoint": server.url, "log": str(tmp_path), "request_delay": "0", "return_receipt": "true", "headers": '{"X-Key": "k"}', "body": '{"q": 1}'}).simpleStreamReader(None)
    _, end = own.read({"seq": 0})
    own.commit(end)
    assert server.polls[0] == ("k", {"q": 1}) and server.posted == [{"seen": 7}]


def test_source_in_a_query(spark, tmp_path):
    spark.dataSource.register(LongPollSource)
    server = Server([message(i) for i in range(5)])
    stream = spark.readStream.format("long_poll").options(endpoint=server.url, log=str(tmp_path / "log"), request_delay="0", batch="2").load()
    query = stream.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(json.loads(r.value)["handleRequestId"] for r in spark.table("polled").collect()) == [0, 1, 2, 3, 4]


def test_sink_posts_a_failed_batch_once(spark, tmp_path):
    from tripwatch.streaming.sink import BindingSetSink

    spark.dataSource.register(BindingSetSink)
    server, flag = Server(), str(tmp_path / "failed")
    spark.range(40).selectExpr("id", "if(id = 3, null, concat('r-', id)) as report").repartition(4).write.parquet(str(tmp_path / "in"))

    def fails_once(batches):
        import os

        for pdf in batches:
            yield pdf
            if (pdf.id == 17).any() and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("lost")

    def start():
        rows = spark.readStream.schema("id long, report string").parquet(str(tmp_path / "in")).mapInPandas(fails_once, "id long, report string")
        q = rows.writeStream.format("binding_sets").options(endpoint=server.url, staging=str(tmp_path / "staging"), piece="15", checkpointLocation=str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        start()
    assert server.posted == []
    start()
    assert sorted(b["id"] for p in server.posted for b in p["bindingSet"]) == list(range(40))
    assert [p["piece"] for p in server.posted] == [0, 1, 2] and {p["batch"] for p in server.posted} == {0}
    assert [f.name for f in (tmp_path / "staging").iterdir()] == [f"posted-{0:020d}"]
    from tripwatch.streaming.sink import BindingSetWriter, Staged

    BindingSetWriter({"endpoint": server.url, "staging": str(tmp_path / "staging")}).commit([Staged("rows-x", 3)], 0)  # the batch is known
    assert len(server.posted) == 3


def test_typed_state_goes_on_from_a_table(spark, sf_dir, tmp_path):
    from tripwatch.streaming import keyed

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    settings = Settings(grace_period=20, samplesize=8, samplegap=2, resamples=50, pattern_decay=30, pattern_threshold=3)
    try:
        statements = triplified(numbered(spark.read.parquet(f"{sf_dir}/events.parquet")))
        whole = replay.replayed(statements, settings)
        table = keyed.states(statements.where("seq <= 90"), settings)
        table.write.parquet(str(tmp_path / "states"))
        later = replay.messages(statements.where("seq > 90"))
        for part, cond in (("a", "seq <= 130"), ("b", "seq > 130")):
            later.where(cond).coalesce(1).write.parquet(str(tmp_path / "in" / part))
            stream = spark.readStream.schema(later.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            found = keyed.detected(stream, settings, spark.read.parquet(str(tmp_path / "states")))
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(spark.read.schema(whole.schema).parquet(str(tmp_path / "out"))) == plain(whole.where("seq > 90"))


def test_lifetimes_equal_the_fold(spark):
    """Two statements of each relation, so that new ones become candidates, in random messages."""
    import numpy as np

    rng = np.random.default_rng(4)
    s = Settings(pattern_decay=6, pattern_threshold=3)
    rows, state, lives = [], None, {}
    for t in range(1, 120):
        names = ["r0", *(f"r{i}" for i in range(1, 7) if rng.random() < (0.8 if (t // 15) % 2 == i % 2 else 0.05))]
        own = [(2 * i + k, "A", n, "literal", v, XSD + d, None, None, "s") for i, n in enumerate(names) for k, (v, d) in enumerate((("1", "integer"), ("x", "string")))]
        state, found, code = step(state, "g", t, own, s)
        assert code in (None, 0)
        rows += [("g", t, n) for n in names]
        for ap in state["aps"]:
            if ap["dtype"] == XSD + "integer":
                old = lives.setdefault((ap["relation"], ap["id"]), {"born": t, "promoted": None})
                if ap["status"] == "nominal" and old["promoted"] is None:
                    old["promoted"] = t
                old |= {"freq": ap["freq"], "last": t}
    observed = spark.createDataFrame(rows, "graph_id string, t long, ap string")
    got = {(r.ap, r.born): (r.promoted, r.deleted, r.freq) for r in forgetting.lifetimes(observed, 6, 3).collect() if r.born != r.deleted}
    want = {(n, x["born"]): (x["promoted"], None if x["last"] == 119 else x["last"] + 1, 0 if x["last"] != 119 else x["freq"]) for (n, _), x in lives.items()}
    assert len(want) > 10 and got == want
    assert forgetting.lifetimes(observed.where("t < 0"), 6, 3).count() == 0
    assert forgetting.lifetimes(observed, -1, 3).where(F.col("deleted").isNotNull()).count() == 0
