"""safetensors files as a Spark data source: an 8-byte header length, a JSON header, raw tensors."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}


def header(path: str) -> tuple[dict, int]:
    with open(path, "rb") as f:
        n = struct.unpack("<Q", f.read(8))[0]
        return json.loads(f.read(n)), 8 + n


def load(path: str, name: str) -> np.ndarray:
    """One tensor as float32."""
    head, start = header(path)
    entry = head[name]
    a, b = entry["data_offsets"]
    with open(path, "rb") as f:
        f.seek(start + a)
        x = np.frombuffer(f.read(b - a), KINDS[entry["dtype"]])
    if entry["dtype"] == "BF16":
        x = (x.astype(np.uint32) << 16).view(np.float32)
    return x.astype(np.float32).reshape(entry["shape"])


def save(path: str, tensors: dict[str, np.ndarray]) -> None:
    """Write float32 tensors."""
    head, at = {}, 0
    for name, x in tensors.items():
        head[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + 4 * x.size]}
        at += 4 * x.size
    raw = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw + b"".join(np.asarray(x, "<f4").tobytes() for x in tensors.values()))


class SafetensorsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(name) for name in header(self.path)[0] if name != "__metadata__"] or [InputPartition(None)]

    def read(self, part):
        if part.value is not None:
            kind = header(self.path)[0][part.value]["dtype"]
            x = load(self.path, part.value)
            yield (part.value, kind, list(x.shape), x.ravel().tolist())


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "name string, dtype string, shape array<bigint>, data array<float>"

    def reader(self, schema) -> DataSourceReader:
        return SafetensorsReader(self.options["path"])
