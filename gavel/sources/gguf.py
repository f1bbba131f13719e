"""GGUF files: parsing, writing, and a Spark data source.

``spark.read.format("gguf").option("view", ...)`` has three views: metadata
(key, value_type, value, item count), tensors (name, shape, type, offset, sizes)
and rows (tensor, row_id, packed), which is split by ranges of rows so that a
large tensor is read by many tasks. Paths must be visible to the workers.

``df.write.format("gguf").option("type", ...).save(path)`` writes rows (tensor, row_id, values). Each task quantizes its rows into a part of its own
beside the target; the commit checks that the parts hold every row of every tensor once, lays them out behind one header, a megabyte at a
time, and renames the file; an abort, or a failed commit, leaves no file. write_tensors() sorts a table first, so that parts are long runs.
"""

from __future__ import annotations

import json
import mmap
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gavel.functions.geometry import BY_CODE, BY_NAME, BlockType

MAGIC = b"GGUF"
#: Value kinds by code: name and struct format; strings and arrays are read on their own.
KINDS = {0: ("uint8", "B"), 1: ("int8", "b"), 2: ("uint16", "H"), 3: ("int16", "h"), 4: ("uint32", "I"), 5: ("int32", "i"), 6: ("float32", "f"), 7: ("bool", "?"), 8: ("string", ""), 9: ("array", ""), 10: ("uint64", "Q"), 11: ("int64", "q"), 12: ("float64", "d")}
CODES = {name: code for code, (name, _) in KINDS.items()}
#: Bytes of packed rows that one partition reads.
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Tensor:
    """shape[0] is the fastest axis; offset counts from the start of the data."""

    name: str
    shape: tuple[int, ...]
    code: int
    offset: int

    @property
    def kind(self) -> BlockType | None:
        return BY_CODE.get(self.code)

    @property
    def elements(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) if self.shape else 1

    @property
    def rows(self) -> int:
        return self.elements // self.shape[0] if self.shape and self.shape[0] else 0

    @property
    def size(self) -> int | None:
        return self.rows * self.kind.row_bytes(self.shape[0]) if self.kind and self.shape else None


class GgufError(ValueError):
    pass


class GgufFile:
    """Header of a file, and its bytes by memory map."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""
        self.at = 0
        if self._take(4) != MAGIC:
            raise GgufError("not a GGUF file")
        self.version = self._number("I")
        if self.version not in (2, 3):
            raise GgufError(f"GGUF version {self.version} is not known")
        tensors, keys = self._number("Q"), self._number("Q")
        self.metadata: dict[str, tuple[str, object]] = {}
        for _ in range(keys):
            key = self._string()
            self.metadata[key] = self._value(self._number("I"))
        self.tensors: list[Tensor] = []
        for _ in range(tensors):
            name = self._string()
            shape = tuple(self._number("Q") for _ in range(self._number("I")))
            self.tensors.append(Tensor(name, shape, self._number("I"), self._number("Q")))
        step = int(self.get("general.alignment", 32))
        self.start = -(-self.at // step) * step
        ends = [self.start + t.offset + t.size for t in self.tensors if t.size is not None]
        if max(ends, default=0) > len(self.data):
            raise GgufError(f"truncated: {max(ends)} bytes are needed, {len(self.data)} are there")

    def _take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise GgufError("truncated header")
        self.at += n
        return out

    def _number(self, form: str):
        return struct.unpack("<" + form, self._take(struct.calcsize("<" + form)))[0]

    def _string(self) -> str:
        return self._take(self._number("Q")).decode("utf-8", "replace")

    def _value(self, code: int, nested: bool = False) -> tuple[str, object]:
        if code not in KINDS:
            raise GgufError(f"value type {code} is not known")
        name, form = KINDS[code]
        if name == "string":
            return name, self._string()
        if name != "array":
            return name, self._number(form)
        if nested:
            raise GgufError("arrays of arrays are not supported")
        item, n = self._number("I"), self._number("Q")
        if n > (1 << 31) - 1:
            raise GgufError("array too long")
        if item in KINDS and KINDS[item][1]:
            size = struct.calcsize("<" + KINDS[item][1])
            return f"array[{KINDS[item][0]}]", list(struct.unpack(f"<{n}{KINDS[item][1]}", self._take(n * size)))
        return f"array[{KINDS.get(item, ('?',))[0]}]", [self._value(item, True)[1] for _ in range(n)]

    def get(self, key: str, default=None):
        """The value, or the default where the key is missing."""
        return self.metadata[key][1] if key in self.metadata else default

    def text(self, key: str, default: str = "") -> str:
        """The default also where the value is no string."""
        value = self.get(key)
        return value if isinstance(value, str) else default

    def tensor(self, name: str) -> Tensor:
        for t in self.tensors:
            if t.name == name:
                return t
        raise KeyError(name)

    def raw(self, t: Tensor, first: int = 0, rows: int | None = None) -> bytes:
        """Packed bytes of some rows of a tensor."""
        if t.kind is None or not t.shape:
            raise GgufError(f"{t.name}: type {t.code} can't be read")
        width = t.kind.row_bytes(t.shape[0])
        rows = t.rows - first if rows is None else rows
        at = self.start + t.offset + first * width
        return bytes(self.data[at : at + rows * width])

    def values(self, name: str) -> np.ndarray:
        """A tensor decoded, slowest axis first."""
        from gavel.functions.quant import decode

        t = self.tensor(name)
        return decode(t.kind.name, self.raw(t)).reshape(t.shape[::-1])

    def weight(self, name: str) -> np.ndarray:
        """A tensor that must have two axes: out x in."""
        if len(self.tensor(name).shape) != 2:
            raise GgufError(f"{name} has no two axes")
        return self.values(name)


def header_bytes(metadata: dict[str, tuple[str, object]], tensors: list[tuple[str, tuple[int, ...], str, int]], alignment: int = 32) -> bytes:
    """Header and fill of version 3; tensors as (name, shape, type, bytes), in the order of the data."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind: str, v) -> bytes:
        if kind == "string":
            return text(v)
        if kind.startswith("array["):
            item = kind[6:-1]
            return struct.pack("<IQ", CODES[item], len(v)) + b"".join(value(item, x) for x in v)
        return struct.pack("<" + KINDS[CODES[kind]][1], v)

    head = MAGIC + struct.pack("<IQQ", 3, len(tensors), len(metadata))
    for key, (kind, v) in metadata.items():
        head += text(key) + struct.pack("<I", CODES["array" if kind.startswith("array[") else kind]) + value(kind, v)
    at = 0
    for name, shape, kind, size in tensors:
        head += text(name) + struct.pack("<I", len(shape)) + struct.pack(f"<{len(shape)}Q", *shape) + struct.pack("<IQ", BY_NAME[kind].code, at)
        at += size + -size % alignment
    return head + b"\0" * (-len(head) % alignment)


def write_gguf(path: str, metadata: dict[str, tuple[str, object]], tensors: list[tuple[str, tuple[int, ...], str, bytes]], alignment: int = 32) -> None:
    """Write version 3: metadata as key -> (type name, value), tensors as (name, shape, type, packed bytes)."""
    with open(path, "wb") as f:
        f.write(header_bytes(metadata, [(*t[:3], len(t[3])) for t in tensors], alignment))
        for *_, raw in tensors:
            f.write(raw + b"\0" * (-len(raw) % alignment))


def local_path(path: str) -> str:
    """A path that open() takes: file: URIs and plain paths, of a folder that driver and executors share."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


@dataclass(frozen=True)
class Run:
    """Consecutive rows of a tensor in a part."""

    tensor: str
    first: int
    rows: int
    cols: int
    kind: str
    part: str
    offset: int
    size: int


@dataclass
class _Runs(WriterCommitMessage):
    runs: list[Run]


class GgufWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.target = local_path(options["path"])
        if os.path.exists(self.target) and not overwrite:
            raise GgufError(f"{self.target} exists")
        self.kind, self.name = options.get("type", "F32"), options.get("tensor")
        if self.kind.upper() not in BY_NAME:
            raise GgufError(f"type {self.kind} is not known")
        self.metadata = {k: tuple(v) for k, v in json.loads(options.get("metadata", "{}")).items()}
        self.folder = f"{self.target}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from gavel.functions.quant import encode
        from gavel.operators.convert import output_type

        os.makedirs(self.folder, exist_ok=True)
        part, runs, at = f"{self.folder}/{uuid.uuid4().hex}", [], 0
        with open(part, "wb") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                names = batch.column("tensor").to_pylist() if "tensor" in batch.schema.names else [self.name] * batch.num_rows
                ids, values = batch.column("row_id").to_pylist(), batch.column("values")
                flat, lengths = values.flatten(), values.value_lengths().to_pylist()
                if None in names or None in ids or None in lengths or flat.null_count:
                    raise GgufError("a name, row or value is null")
                x, ends = flat.to_numpy(zero_copy_only=False).astype(np.float32), np.cumsum([0, *lengths])
                i = 0
                while i < batch.num_rows:
                    j = i + 1
                    while j < batch.num_rows and names[j] == names[i] and ids[j] == ids[j - 1] + 1 and lengths[j] == lengths[i]:
                        j += 1
                    kind = output_type(names[i], (1, lengths[i]), self.kind)
                    raw = encode(kind, x[ends[i] : ends[j]])
                    f.write(raw)
                    last = runs[-1] if runs else None
                    if last and (last.tensor, last.first + last.rows, last.cols) == (names[i], ids[i], lengths[i]):
                        runs[-1] = Run(last.tensor, last.first, last.rows + j - i, last.cols, kind, part, last.offset, last.size + len(raw))
                    else:
                        runs.append(Run(names[i], ids[i], j - i, lengths[i], kind, part, at, len(raw)))
                    at += len(raw)
                    i = j
        return _Runs(runs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            self._lay_out([r for m in messages if m for r in m.runs])
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _lay_out(self, runs: list[Run], alignment: int = 32) -> None:
        by_tensor: dict[str, list[Run]] = {}
        for r in sorted(runs, key=lambda r: (r.tensor, r.first)):
            by_tensor.setdefault(r.tensor, []).append(r)
        tensors = []
        for name, own in by_tensor.items():
            n = 0
            for r in own:
                if r.first != n:
                    raise GgufError(f"{name}: row {min(n, r.first)} is {'missing' if r.first > n else 'there twice'}")
                if r.cols != own[0].cols:
                    raise GgufError(f"{name}: rows of {own[0].cols} and of {r.cols} values")
                n += r.rows
            vector = n == 1 and name.endswith("norm.weight")
            tensors.append((name, (own[0].cols,) if vector else (own[0].cols, n), own[0].kind, sum(r.size for r in own)))
        new = f"{self.folder}/file"
        os.makedirs(self.folder, exist_ok=True)
        with open(new, "wb") as out:
            out.write(header_bytes(self.metadata, tensors, alignment))
            for (_, _, _, size), own in zip(tensors, by_tensor.values(), strict=True):
                for r in own:
                    with open(r.part, "rb") as part:
                        part.seek(r.offset)
                        left = r.size
                        while left:
                            piece = part.read(min(left, 1 << 20))
                            if not piece:
                                raise GgufError(f"{r.part} is too short")
                            out.write(piece)
                            left -= len(piece)
                out.write(b"\0" * (-size % alignment))
        os.replace(new, self.target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def write_tensors(df: DataFrame, path: str, kind: str = "Q8_0", metadata: dict[str, tuple[str, object]] | None = None) -> None:
    """Write rows (tensor, row_id, values) as a GGUF file: sorted by ranges, so that each task quantizes long runs of rows and no task gathers a tensor."""
    from gavel.sources import register

    register(df.sparkSession)
    rows = df.select("tensor", "row_id", "values").repartitionByRange("tensor", "row_id").sortWithinPartitions("tensor", "row_id")
    rows.write.format("gguf").mode("overwrite").option("path", path).option("type", kind).option("metadata", json.dumps(metadata or {})).save()


class _Rows(InputPartition):
    def __init__(self, tensor: str, first: int, rows: int):
        super().__init__((tensor, first, rows))
        self.tensor, self.first, self.rows = tensor, first, rows


class GgufReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.view, self.only = local_path(options["path"]), options.get("view", "tensors"), options.get("tensor")

    def partitions(self):
        file = GgufFile(self.path)  # a broken file fails here, before any task
        if self.view != "rows":
            return [InputPartition(self.view)]
        out = []
        for t in file.tensors:
            if t.kind is None or len(t.shape) != 2 or (self.only and t.name != self.only):
                continue
            step = max(1, PARTITION_BYTES // max(1, t.kind.row_bytes(t.shape[0])))
            out += [_Rows(t.name, i, min(step, t.rows - i)) for i in range(0, t.rows, step)]
        return out

    def read(self, part):
        file = GgufFile(self.path)
        if isinstance(part, _Rows):
            t = file.tensor(part.tensor)
            width = t.kind.row_bytes(t.shape[0])
            raw = file.raw(t, part.first, part.rows)
            for i in range(part.rows):
                yield (t.name, t.kind.name, part.first + i, raw[i * width : (i + 1) * width])
        elif self.view == "metadata":
            for key, (kind, v) in file.metadata.items():
                yield (key, kind, json.dumps(v, ensure_ascii=False) if isinstance(v, list) else str(v), len(v) if isinstance(v, list) else 1)
        else:
            for t in file.tensors:
                yield (t.name, list(t.shape), t.kind.name if t.kind else None, t.offset, t.elements, t.rows, t.size)


class GgufSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return {
            "metadata": "key string, value_type string, value string, items bigint",
            "rows": "tensor string, type string, row_id int, packed binary",
        }.get(self.options.get("view", "tensors"), "name string, shape array<bigint>, type string, data_offset bigint, n_elements bigint, n_rows bigint, n_bytes bigint")

    def reader(self, schema) -> DataSourceReader:
        return GgufReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GgufWriter:
        return GgufWriter(dict(self.options), overwrite)
