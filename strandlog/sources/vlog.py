"""The binary value log as a Spark data source, short name ``vlog``.

A record is a header of five unsigned 32-bit numbers (index, term, voted_for, key_size, value_size), the padded key and
the value. Option ``layout``: 'stored' is little endian with that header; 'demo' is big endian with key_size and
value_size only. Both ways go by Arrow batches. Writing gives a file per task in task order, and beside each a hidden file with
the places of records about every ``SPLIT`` bytes (option ``splitEvery``). Reading gives a partition per file, or with option ``splitBytes`` per about that
many bytes of a file that has such places; ``index_splits`` makes them for files that come from elsewhere, a task per file.
The driver reads no log. Records that end after the file are dropped when option ``truncated`` is 'drop', else they raise an error.

Defined cases: null keys and values are written as empty ones; keys are padded on writing; an empty folder gives no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The two headers.
STORED, DEMO = struct.Struct("<5I"), struct.Struct(">2I")
KEY_WIDTH = 10
SCHEMA = "file string, file_offset long, idx long, term long, voted_for long, key_size long, value_size long, key string, value string"


#: Bytes that a reader holds at once besides a record that is longer, and bytes between the places where a file may be split.
CHUNK, SPLIT = 4 << 20, 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


class Bytes:
    """Reads of a file at growing places, through one bounded buffer."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.buffer = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.buffer)):
            self.buffer = self.file.read_at(max(n, min(CHUNK, self.size - start)), start)
            self.at = start
        return self.buffer[start - self.at : start - self.at + n]


def zigzag(n: int) -> bytes:
    """A signed number as a varint whose lowest bit is the sign."""
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def unzigzag(raw: bytes) -> int:
    n = shift = 0
    for b in raw:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return (n >> 1) ^ -(n & 1)
    raise ValueError("the varint doesn't end")


def pack(idx: int, term: int, voted_for: int, key: str | None, value: str | None, demo: bool = False) -> bytes:
    k = (key or "")[:KEY_WIDTH].rjust(KEY_WIDTH, "0").encode()
    v = (value or "").encode()
    head = DEMO.pack(len(k), len(v)) if demo else STORED.pack(idx, term, voted_for, len(k), len(v))
    return head + k + v


def chunks(path: str, demo: bool, start: int, end: int, drop: bool) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Records that begin in [start, end), by chunks: place of the chunk, its bytes, the places of its records in it (and of its end), key sizes."""
    head = DEMO if demo else STORED
    sizes = struct.Struct(head.format[0] + "2I").unpack_from
    before = head.size - 8
    where, name = filesystem(path)
    with where.open_input_file(name) as file:
        total, at, need = file.size(), start, CHUNK
        while at < min(end, total):
            buffer = file.read_at(min(need, total - at), at)
            last, offsets, keys, p = len(buffer), [], [], 0
            while at + p < end and p + head.size <= last:
                k, v = sizes(buffer, p + before)
                stop = p + head.size + k + v
                if stop > last:
                    break
                offsets.append(p)
                keys.append(k)
                p = stop
            if offsets:
                yield at, buffer, np.array([*offsets, p], dtype=np.int64), np.array(keys, dtype=np.int64)
                at, need = at + p, CHUNK
            elif at + last < total:
                need = 2 * need if last < head.size else max(2 * need, head.size + sum(sizes(buffer, before)))
            elif drop:
                return
            else:
                raise ValueError(f"{path}: the record at {at} ends after the file")


def _texts(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """The stretches of n bytes from ``start`` on, which don't overlap, as texts."""
    mark = np.zeros(len(raw) + 1, dtype=np.int8)
    mark[start] += 1
    mark[start + n] -= 1
    flat = raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    out = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(flat)])
    out.validate(full=True)
    return out


def records(path: str, demo: bool, start: int, end: int, drop: bool) -> Iterator[pa.RecordBatch]:
    """Records that begin in [start, end) as batches of ``SCHEMA``."""
    head = DEMO if demo else STORED
    file = path.rsplit("/", 1)[-1]
    for at, buffer, places, k in chunks(path, demo, start, end, drop):
        raw, offsets, n = np.frombuffer(buffer, dtype=np.uint8), places[:-1], len(k)
        v = np.diff(places) - head.size - k
        if demo:
            fields = [np.zeros(n, dtype=np.int64)] * 3
        else:
            header = raw[offsets[:, None] + np.arange(12)].view("<u4").astype(np.int64)
            fields = [header[:, i] for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(file, n), *(pa.array(x) for x in (offsets + at, *fields, k, v)), _texts(raw, offsets + head.size, k), _texts(raw, offsets + head.size + k, v)],
            names=["file", "file_offset", "idx", "term", "voted_for", "key_size", "value_size", "key", "value"])


def encoded(batch: pa.RecordBatch, demo: bool) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a batch of records, and where each ends."""
    n, names = len(batch), batch.schema.names
    text = lambda c: pc.fill_null(batch.column(c).cast(pa.string()), "") if c in names else pa.repeat("", n)
    number = lambda c: pc.fill_null(batch.column(c).cast(pa.int64()), 0).to_numpy() if c in names else np.zeros(n, dtype=np.int64)
    key = pc.utf8_lpad(pc.utf8_slice_codeunits(text("key"), 0, KEY_WIDTH), KEY_WIDTH, "0").cast(pa.binary())
    value = text("value").cast(pa.binary())
    sizes = [pc.binary_length(key).to_numpy(), pc.binary_length(value).to_numpy()]
    header = np.column_stack(sizes if demo else [number("idx"), number("term"), number("voted_for"), *sizes])
    head = pa.Array.from_buffers(pa.binary(4 * header.shape[1]), n, [None, pa.py_buffer(header.astype(">u4" if demo else "<u4"))]).cast(pa.binary())
    whole = pc.binary_join_element_wise(head, key, value, b"")
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int32)[1 : n + 1].astype(np.int64)
    return whole.buffers()[2].slice(0, int(ends[-1])) if n else pa.py_buffer(b""), ends


def record(f: Bytes, at: int, demo: bool) -> tuple[str, str]:
    """Key and value of the record at a place."""
    head = DEMO if demo else STORED
    k, v = head.unpack(f.get(at, head.size))[-2:]
    body = f.get(at + head.size, k + v)
    return body[:k].decode(), body[k:].decode()


def read_at(path: str, offset: int, demo: bool = False) -> tuple[str, str] | None:
    """Key and value of the record at an offset; None for offset -1."""
    if offset == -1:
        return None
    where, name = filesystem(path)
    with where.open_input_file(name) as file:
        return record(Bytes(file), offset, demo)


def dereferenced(index: DataFrame, path: str, demo: bool = False) -> DataFrame:
    """``index``, with columns file and file_offset, and the record at each: stored_key, stored_value; null for offset -1 or null.

    Offsets are sorted into ranges, so that a task reads forward through its part of the files, and one file may be read by many tasks.
    """
    root = path.rstrip("/")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, bytes_ = None, None
        for b in batches:
            keys, values = [], []
            for name, at in zip(b.column("file").to_pylist(), b.column("file_offset").to_pylist()):
                if name is None or at is None or at < 0:
                    keys.append(None)
                    values.append(None)
                    continue
                if name != opened:
                    where, file = filesystem(f"{root}/{name}")
                    opened, bytes_ = name, Bytes(where.open_input_file(file))
                key, value = record(bytes_, at, demo)
                keys.append(key)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string()), pa.array(values, pa.string())], names=[*b.schema.names, "stored_key", "stored_value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.repartitionByRange("file", "file_offset").sortWithinPartitions("file", "file_offset").mapInArrow(fetch, f"{schema}, stored_key string, stored_value string")


def log_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the log files at a path, by name."""
    scheme = path[: path.index("://") + 3] if "://" in path else "file:" if path.startswith("file:") else ""
    where, name = filesystem(path)
    info = where.get_file_info(name)
    files = [info] if info.is_file else where.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted((scheme + x.path, x.size) for x in files if x.is_file and x.base_name[0] not in "_.")


def _splits_name(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_{name}.splits"


def split_places(ends: np.ndarray, last: int, every: int = SPLIT) -> tuple[list[int], int]:
    """Of the ends of records those that are the first beyond another ``every`` bytes after ``last``."""
    out = []
    while len(ends) and (i := int(np.searchsorted(ends, last + every))) < len(ends):
        last = int(ends[i])
        out.append(last)
    return out, last


def _write_splits(where: fs.FileSystem, name: str, places: list[int]) -> None:
    with where.open_output_stream(name) as f:
        f.write(np.array(places, dtype="<i8").tobytes())


def index_splits(spark: SparkSession, path: str, demo: bool = False) -> int:
    """Makes the split places of all files at a path, a task per file; how many files there are."""
    files = [f for f, _ in log_files(path)]
    if not files:
        return 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                places, last = [], 0
                for at, _, offsets, _ in chunks(file, demo, 0, 1 << 62, True):
                    more, last = split_places(offsets[1:] + at, last)
                    places += more
                _write_splits(*filesystem(_splits_name(file)), places)
            yield b

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file").mapInArrow(walk, "file string").count()


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.demo = options.get("layout", "stored") == "demo"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 0)))
        self.drop = options.get("truncated", "error") == "drop"

    def partitions(self) -> list[Piece]:
        out = []
        for path, size in log_files(self.root):
            starts = [0]
            if self.split and size > self.split:
                where, name = filesystem(_splits_name(path))
                if where.get_file_info(name).is_file:
                    with where.open_input_file(name) as f:
                        places = np.frombuffer(f.read(), dtype="<i8").tolist()
                    for at in places:
                        if at >= starts[-1] + self.split and at < size:
                            starts.append(at)
            out += [Piece(path, a, b) for a, b in zip(starts, [*starts[1:], size])]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        yield from records(piece.path, self.demo, piece.start, piece.end, self.drop)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    splits: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.root = options["path"]
        self.demo = options.get("layout", "stored") == "demo"
        self.every = int(options.get("splitevery", options.get("splitEvery", SPLIT)))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, root = filesystem(self.root)
        where.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.vlog"
        temporary = f"{root}/_{name}.{uuid.uuid4().hex}"  # each attempt has its own
        places, last, at = [], 0, 0
        with where.open_output_stream(temporary, buffer_size=CHUNK) as f:
            for b in batches:
                data, ends = encoded(b, self.demo)
                f.write(data)
                more, last = split_places(ends + at, last, self.every)
                places += more
                at += data.size
        return Written(temporary, f"{root}/{name}", [x for x in places if x < at])

    def commit(self, messages: list) -> None:
        where, root = filesystem(self.root)
        if self.overwrite:
            for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.is_file and (x.base_name.endswith(".vlog") or x.base_name.endswith(".vlog.splits")) and not (x.base_name.startswith("_") and x.base_name.endswith(".vlog")):
                    where.delete_file(x.path)
        for m in messages:
            if m:
                if m.splits:
                    _write_splits(where, _splits_name(m.final), m.splits)
                where.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        where, _ = filesystem(self.root)
        for m in messages:
            if m and where.get_file_info(m.temporary).is_file:
                where.delete_file(m.temporary)


class ValueLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ValueLog)
