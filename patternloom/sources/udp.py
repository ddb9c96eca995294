"""A stream of UDP datagrams as a Python data source: one datagram, one line.

Each reader holds one port for the time of a batch. Datagrams can't be read again, so use it where a log
daemon can't write files or a queue.
"""

from __future__ import annotations

import socket
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class UdpSource(DataSource):
    """``value, peer``. Options: host, port (514), maxBytes (4095), waitMs (500: the longest time for a batch)."""

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return "value string, peer string"

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.address = (options.get("host", "0.0.0.0"), int(options.get("port", 514)))
        self.size, self.wait = int(options.get("maxbytes", options.get("maxBytes", 4095))), int(options.get("waitms", options.get("waitMs", 500))) / 1000
        self.kept: dict[int, list[tuple[str, str]]] = {}
        self.socket: socket.socket | None = None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
        rows, until = [], time.monotonic() + self.wait
        while (left := until - time.monotonic()) > 0:
            self.socket.settimeout(left)
            try:
                data, peer = self.socket.recvfrom(self.size)
            except TimeoutError:
                break
            rows.append((data.decode("utf-8", "replace").rstrip("\n"), peer[0]))
        at = start["at"]
        self.kept[at] = rows
        return iter(rows), {"at": at + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.kept.get(start["at"], [])[: end["at"] - start["at"]])

    def commit(self, end: dict) -> None:
        for at in [a for a in self.kept if a < end["at"]]:
            del self.kept[at]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpSource)
