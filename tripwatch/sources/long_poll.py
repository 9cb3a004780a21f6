"""A streaming data source that polls an HTTP endpoint for JSON messages.

    spark.dataSource.register(LongPollSource)
    spark.readStream.format("long_poll").option("endpoint", url).option("log", folder).load()   # seq bigint, value string

Status 200 is a message, 202 asks to poll again at once, 204 means there is none now, 400 and above is an error, and so are no
connection and a message that isn't JSON: these are tried again `retries` times, `retry_delay` seconds apart, and then the query
fails; with `continuous` it goes on with an empty batch instead.

A message is in the log, a folder of one query that outlives the reader, before its offset is told to Spark. A new reader
gives what the log holds from its offset on before it polls, so a message is neither lost nor given twice. When Spark
has committed a batch, its messages leave the log and receipts are sent.

Options: endpoint, log, retries, retry_delay, request_delay (between polls), continuous, batch, return_receipt, headers, body
(JSON texts). An endpoint with ways of its own is a subclass that overrides headers(), body() or receipt().
"""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from typing import Any

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .files import Folder


class LongPollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "long_poll"

    def schema(self) -> str:
        return "seq bigint, value string"

    def headers(self) -> dict[str, str]:
        """Sent with each poll and receipt."""
        return json.loads(self.options.get("headers", "{}"))

    def body(self) -> Any:
        """Sent with each poll as JSON; none if null."""
        return json.loads(self.options.get("body", "null"))

    def receipt(self, message: dict) -> Any:
        """What a message is answered with."""
        return {"handleRequestId": message.get("handleRequestId"), "bindingSet": []}

    def simpleStreamReader(self, schema):
        return LongPollReader(self)


class LongPollReader(SimpleDataSourceStreamReader):
    def __init__(self, source: LongPollSource):
        options = source.options
        self.source, self.endpoint = source, options.get("endpoint", "http://127.0.0.1:8000")
        self.retries, self.retry_delay, self.request_delay = int(options.get("retries", 3)), float(options.get("retry_delay", 30)), float(options.get("request_delay", 0.5))
        self.most, self.receipts, self.continuous = int(options.get("batch", 1000)), options.get("return_receipt", "false") == "true", options.get("continuous", "false") == "true"
        if "log" not in options:
            raise ValueError("long_poll needs the option log, a folder that outlives the reader")
        self.log = Folder(options["log"])

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _request(self, body: Any, method: str) -> tuple[int, str]:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.endpoint, data, {"Content-Type": "application/json"} | self.source.headers(), method=method)
        with urllib.request.urlopen(request, timeout=60) as got:
            return got.status, got.read().decode()

    def _poll(self) -> str | None:
        """The next message, or none for now."""
        failed = 0
        while True:
            try:
                status, text = self._request(self.source.body(), "GET")
                if status == 200:
                    json.loads(text)
                    return text
                if status == 204:
                    return None
            except (urllib.error.URLError, OSError, ValueError) as e:
                failed += 1
                if self.continuous:
                    time.sleep(self.request_delay)
                    return None
                if failed > self.retries:
                    raise ConnectionError(f"{self.endpoint}: {failed} times without a message: {e}") from e
                time.sleep(self.retry_delay)

    def _logged(self, start: int) -> list[tuple[int, str]]:
        seqs = [s for s in (int(n) for n in self.log.names()) if s >= start]
        return [(s, self.log.read(f"{s:020d}").decode()) for s in seqs]

    def read(self, start: dict):
        rows = self._logged(start["seq"])[: self.most]
        seq = start["seq"] + len(rows)
        while len(rows) < self.most and (text := self._poll()) is not None:  # after what the log has
            self.log.write(f"{seq:020d}", iter([text.encode()]))
            rows.append((seq, text))
            seq += 1
            time.sleep(self.request_delay)
        return iter(rows), {"seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for r in self._logged(start["seq"]) if r[0] < end["seq"]])

    def commit(self, end: dict) -> None:
        for seq in [s for s in (int(n) for n in self.log.names()) if s < end["seq"]]:
            if self.receipts:
                try:
                    self._request(self.source.receipt(json.loads(self.log.read(f"{seq:020d}"))), "POST")
                except (urllib.error.URLError, OSError, ValueError):
                    logging.getLogger(__name__).warning("no receipt for message %d", seq)
            self.log.remove(f"{seq:020d}")
