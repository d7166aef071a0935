"""Remote-write payloads back to rows, to check what was encoded."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _write_request():
    """The message class, declared from its public description."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = {"string": 9, "double": 1, "int64": 3, "message": 11}
    shape = {
        "Label": [("name", 1, "string", None), ("value", 2, "string", None)],
        "Sample": [("value", 1, "double", None), ("timestamp", 2, "int64", None)],
        "TimeSeries": [("labels", 1, "message", "Label"), ("samples", 2, "message", "Sample")],
        "WriteRequest": [("timeseries", 1, "message", "TimeSeries")],
    }
    file = descriptor_pb2.FileDescriptorProto(name="remote.proto", package="remote", syntax="proto3")
    for name, fields in shape.items():
        message = file.message_type.add(name=name)
        for field, number, kind, of in fields:
            f = message.field.add(name=field, number=number, type=kinds[kind], label=3 if of else 1)
            if of:
                f.type_name = f".remote.{of}"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("remote.WriteRequest"))


def decoded_series(payloads: DataFrame) -> DataFrame:
    """One row per encoded series: its labels as text, sample count, first and last ms, total cents."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request = _write_request()
        for frame in frames:
            rows = []
            for body in frame["payload"]:
                # The raw block format starts with the length of the content as a varint.
                size = shift = 0
                for byte in bytes(body):
                    size |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                content = pa.decompress(bytes(body), decompressed_size=size, codec="snappy", asbytes=True)
                for ts in request.FromString(content).timeseries:
                    stamps = np.fromiter((s.timestamp for s in ts.samples), np.int64, len(ts.samples))
                    values = np.fromiter((s.value for s in ts.samples), np.float64, len(ts.samples))
                    # only finite values have cents
                    cents = int(np.rint(100 * values[np.isfinite(values)]).sum())
                    name = ",".join(f"{p.name}={p.value}" for p in ts.labels)
                    rows.append((name, len(stamps), int(stamps.min()), int(stamps.max()), cents))
            yield pd.DataFrame(rows, columns=["series", "n", "first_ms", "last_ms", "cents"])

    schema = "series string, n bigint, first_ms bigint, last_ms bigint, cents bigint"
    return payloads.select("payload").mapInPandas(decode, schema)
