"""Assembled series to a remote-write endpoint.

``series.write.format("remote_write").option("address", ...).mode("append").save()``, or the same
with ``writeStream``. Each task sends its own rows, a bounded number of samples per request, so
the number of partitions is the number of connections. Series of many samples should come as
``sample_pieces(series)``, as they do from the stream's sink: Spark hands rows to Python 10,000 at a time. A failed request fails the task; Spark's
retry may then send samples twice, which the protocol allows.
"""

from __future__ import annotations

import base64
import importlib
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

# Tasks get this module's code with the job, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The protocol's path, headers and only success status.
WRITE_PATH = "/api/v1/write"
HEADERS = {
    "Content-Type": "application/x-protobuf",
    "Content-Encoding": "snappy",
    "X-Prometheus-Remote-Write-Version": "0.1.0",
    "User-Agent": "meterloom",
}
SUCCESS_STATUS = 204
TIMEOUT_SECONDS = 5.0

# Samples per request unless told otherwise.
MAX_SAMPLES = 524_288

# Samples of a row that goes to Python, and those that are encoded at a time: they bound a task's memory, not its result.
PIECE_SAMPLES = 256
WINDOW_SAMPLES = 65_536

PAYLOAD_SCHEMA = "payload binary, n_series int, n_samples bigint, last_ms bigint"

# (url, headers, body, timeout) -> HTTP status
Post = Callable[[str, dict, bytes, float], int]


def sample_pieces(series: DataFrame, size: int = PIECE_SAMPLES) -> DataFrame:
    """``labels, samples, more``: each series in rows of up to ``size`` samples that follow each other; ``more`` tells that
    the next row goes on with it. Narrow: no shuffle."""
    last = F.greatest(F.ceil(F.size("samples") / size) - 1, F.lit(0))
    cut = lambda i: F.slice("samples", (i * size + 1).cast("int"), size)
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.struct(cut(i).alias("samples"), (i < last).alias("more")))
    return series.where("samples is not null").select("labels", F.inline(pieces))


def remote_write_payloads(series: DataFrame, *, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """One row per request: the compressed body with what it holds. Narrow: no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _requests(batches, max_samples):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r.body], pa.binary()),
                    pa.array([r.n_series], pa.int32()),
                    pa.array([r.n_samples], pa.int64()),
                    pa.array([r.last_ms], pa.int64()),
                ],
                names=["payload", "n_series", "n_samples", "last_ms"],
            )

    return sample_pieces(series).mapInArrow(encode, PAYLOAD_SCHEMA)


@dataclass
class _Request:
    body: bytes
    n_series: int
    n_samples: int
    last_ms: int


def _requests(batches: Iterator[pa.RecordBatch], max_samples: int) -> Iterator[_Request]:
    parts: list[bytes] = []
    n_samples, last_ms = 0, None

    def close() -> _Request:
        return _Request(pa.compress(b"".join(parts), codec="snappy", asbytes=True), len(parts), n_samples, last_ms)

    for message, n, newest in _messages(batches, max_samples):
        if parts and n_samples + n > max_samples:
            yield close()
            parts, n_samples, last_ms = [], 0, None
        parts.append(message)
        n_samples += n
        last_ms = newest if last_ms is None else max(last_ms, newest)
    if parts:
        yield close()


def _series_messages(batch: pa.RecordBatch, max_samples: int = MAX_SAMPLES) -> Iterator[tuple[bytes, int, int]]:
    return _messages(iter([batch]), max_samples)


def _messages(batches: Iterator[pa.RecordBatch], max_samples: int) -> Iterator[tuple[bytes, int, int]]:
    """Protobuf message, sample count and newest instant of each series with samples.

    A series of more than ``max_samples`` is several messages with the same labels, in the order of its samples.
    Rows that tell of ``more`` are one series with the next row, in whichever batch that is.
    """
    head, body, n, newest, goes_on = b"", [], 0, None, False
    for batch in batches:
        samples = batch.column("samples")
        offsets, flat = np.asarray(samples.offsets), samples.values
        more = batch.column("more").to_pylist() if "more" in batch.schema.names else [False] * batch.num_rows
        first = until = 0  # the window: samples that are encoded
        for i, labels in enumerate(batch.column("labels").to_pylist()):
            lo, end = int(offsets[i]), int(offsets[i + 1])
            if not goes_on and lo < end:
                head = b"".join(_field(1, _field(1, p["name"].encode()) + _field(2, _text(p["value"]))) for p in labels)
            while lo < end:
                if lo >= until:
                    first, until = lo, min(lo + WINDOW_SAMPLES, len(flat))
                    stamps, values = (flat.field(c).slice(first, until - first).to_numpy(zero_copy_only=False) for c in ("timestamp", "value"))
                    stamps, values = stamps.astype(np.int64), values.astype(np.float64)
                    buffer, starts = _sample_messages(stamps, values)
                hi = min(end, until, lo + max_samples - n)
                body.append(buffer[starts[lo - first] : starts[hi - first]].tobytes())
                latest = int(stamps[lo - first : hi - first].max())
                newest = latest if newest is None else max(newest, latest)
                n, lo = n + hi - lo, hi
                if n == max_samples:
                    yield _field(1, head + b"".join(body)), n, newest
                    body, n, newest = [], 0, None
            goes_on = more[i]
            if n and not goes_on:
                yield _field(1, head + b"".join(body)), n, newest
                body, n, newest = [], 0, None


def _text(value: str | None) -> bytes:
    return b"null" if value is None else value.encode()


def _field(number: int, body: bytes) -> bytes:
    """A length-delimited field."""
    size, length = bytearray([number << 3 | 2]), len(body)
    while length > 127:
        size.append(length & 127 | 128)
        length >>= 7
    size.append(length)
    return bytes(size) + body


def _sample_messages(stamps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All samples as ``samples`` fields in one buffer, with the start of each and the end."""
    n, raw = len(stamps), stamps.view(np.uint64)
    width = np.ones(n, np.int64)
    for k in range(1, 10):
        width += raw >= np.uint64(1 << 7 * k)
    grid = np.zeros((n, 22), np.uint8)
    grid[:, 0] = 2 << 3 | 2
    grid[:, 1] = 10 + width
    grid[:, 2] = 1 << 3 | 1
    grid[:, 3:11] = values.astype("<f8").view(np.uint8).reshape(n, 8)
    grid[:, 11] = 2 << 3
    for k in range(10):
        more = np.where(k < width - 1, 128, 0).astype(np.uint8)
        grid[:, 12 + k] = (raw >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    kept = np.arange(22) < (12 + width)[:, None]
    return grid[kept], np.concatenate([[0], np.cumsum(12 + width)])


def auth_headers(options: dict) -> dict:
    """Headers for ``auth`` = ``none``, ``basic`` (username, password) or ``bearer`` (token)."""
    kind = options.get("auth", "none")
    if kind == "none":
        return {}
    if kind == "basic":
        pair = f"{options['username']}:{options['password']}".encode()
        return {"Authorization": "Basic " + base64.b64encode(pair).decode()}
    if kind == "bearer":
        return {"Authorization": "Bearer " + options["token"]}
    raise ValueError(f"unknown auth {kind!r}")


def http_post(url: str, headers: dict, body: bytes, timeout: float) -> int:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.status
    except urllib.error.HTTPError as e:
        return e.code


@dataclass
class Sent(WriterCommitMessage):
    requests: int
    samples: int


class _Sender:
    """Sends a task's rows; shared by the batch and the stream writer."""

    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in dict(options).items()}
        if not options.get("address"):
            raise ValueError("option address is needed")
        self.url = options["address"].rstrip("/") + WRITE_PATH
        self.headers = {**HEADERS, **auth_headers(options)}
        self.timeout = float(options.get("timeout", TIMEOUT_SECONDS))
        self.max_samples = int(options.get("max_samples", MAX_SAMPLES))
        self.post = options.get("post")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        post = http_post
        if self.post:
            module, _, name = self.post.partition(":")
            post = getattr(importlib.import_module(module), name)
        requests = samples = 0
        for r in _requests(iterator, self.max_samples):
            status = post(self.url, self.headers, r.body, self.timeout)
            if status != SUCCESS_STATUS:
                raise RuntimeError(f"remote write failed with status {status}")
            requests, samples = requests + 1, samples + r.n_samples
        return Sent(requests, samples)


class _BatchWriter(_Sender, DataSourceArrowWriter):
    pass


class _StreamWriter(_Sender, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId) -> None:  # noqa: N803
        pass

    def abort(self, messages, batchId) -> None:  # noqa: N803
        pass


class RemoteWriteDataSource(DataSource):
    """Options: ``address``, ``auth`` and its fields, ``timeout``, ``max_samples``.

    ``post`` names another sender as ``module:function``.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_write"

    def writer(self, schema, overwrite):
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the ``remote_write`` format known to a session."""
    spark.dataSource.register(RemoteWriteDataSource)
