"""The protobuf network format (.net) as a Python data source, and its writer.

A file is a label of 65536 bytes, a header message and the points. The newer form has
the points' sizes in the header, so that byte ranges can be cut at points and read in
parallel; the older one has a little-endian size before each point.

`spark.dataSource.register(NetSource)`, then
`spark.read.format("planisphere_net").load(path)` gives a row for each point, measures
as an array, from files of the local machine. `read_net` reads through Spark itself, so
from any store that Spark can open, in pieces: Spark reads splits of the files, a task a
file cuts them at points, a window of bounded size after another, and windows are then
decoded in parallel.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.staging import discard, stage

LABEL_BYTES = 65536
#: Field numbers and names of the format, fixed values.
HEADER = {1: "networkId", 2: "targetName", 3: "created", 4: "lastModified", 5: "description", 6: "userName"}
POINT = {
    1: ("id", "string"), 2: ("type", "int"), 3: ("chooserName", "string"), 4: ("datetime", "string"), 5: ("editLock", "int"), 6: ("ignore", "int"),
    7: ("jigsawRejected", "int"), 8: ("referenceIndex", "int"), 9: ("aprioriSurfPointSource", "int"), 10: ("aprioriSurfPointSourceFile", "string"),
    11: ("aprioriRadiusSource", "int"), 12: ("aprioriRadiusSourceFile", "string"), 16: ("aprioriX", "double"), 17: ("aprioriY", "double"),
    18: ("aprioriZ", "double"), 19: ("aprioriCovar", "doubles"), 20: ("adjustedX", "double"), 21: ("adjustedY", "double"), 22: ("adjustedZ", "double"), 23: ("adjustedCovar", "doubles"),
}
MEASURE = {
    1: ("serialnumber", "string"), 2: ("measure_type", "int"), 3: ("sample", "double"), 4: ("line", "double"), 5: ("sampleResidual", "double"), 6: ("lineResidual", "double"),
    7: ("measure_chooserName", "string"), 8: ("measure_datetime", "string"), 9: ("measure_editLock", "int"), 10: ("measure_ignore", "int"), 11: ("measure_jigsawRejected", "int"),
    12: ("diameter", "double"), 13: ("apriorisample", "double"), 14: ("aprioriline", "double"), 15: ("samplesigma", "double"), 16: ("linesigma", "double"),
}
MEASURES, LOGS = 25, 17
_SQL = {"string": "string", "int": "int", "double": "double", "doubles": "array<double>"}
_MEASURE_SQL = ",".join(f"{n}:{_SQL[k]}" for n, k in MEASURE.values()) + ",measure_logType:array<int>,measure_logValue:array<double>"
SCHEMA = "point_idx long, " + ", ".join(f"{n} {_SQL[k]}" for n, k in POINT.values()) + f", measures array<struct<{_MEASURE_SQL}>>"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: ints, eight or four bytes, or bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            if at + size > len(raw):
                raise ValueError("a field exceeds its message")
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _value(kind: str, v):
    if kind == "string":
        return v.decode("utf-8", "replace")
    if kind == "int":
        return v - (1 << 64) if v >= 1 << 63 else v
    if kind == "double":
        return struct.unpack("<d", v)[0]
    return list(struct.unpack(f"<{len(v) // 8}d", v))


def _record(raw: bytes, names: dict) -> tuple[dict, list]:
    """The named fields of a message and the others; the loop of `fields`, with bytes below 128 taken at once."""
    out, rest, at, end = {n: [] if k == "doubles" else None for n, k in names.values()}, [], 0, len(raw)
    while at < end:
        tag, at = (raw[at], at + 1) if raw[at] < 128 else _varint(raw, at)
        wire, number = tag & 7, tag >> 3
        if wire == 0:
            v, at = (raw[at], at + 1) if raw[at] < 128 else _varint(raw, at)
        elif wire == 1:
            v, at = raw[at : at + 8], at + 8
        elif wire == 2:
            size, at = (raw[at], at + 1) if raw[at] < 128 else _varint(raw, at)
            if at + size > end:
                raise ValueError("a field exceeds its message")
            v, at = raw[at : at + size], at + size
        elif wire == 5:
            v, at = raw[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        if number not in names:
            rest.append((number, v))
            continue
        name, kind = names[number]
        if kind == "doubles" and len(v) == 8 and out[name]:
            out[name] += _value(kind, v)
        else:
            out[name] = _value(kind, v)
    return out, rest


def point(raw: bytes) -> dict:
    out, rest = _record(raw, POINT)
    out["measures"] = []
    for number, v in rest:
        if number == MEASURES:
            m, logs = _record(v, MEASURE)
            both = [dict(fields(x)) for n, x in logs if n == LOGS]
            m["measure_logType"] = [b.get(1, 0) for b in both]
            m["measure_logValue"] = [struct.unpack("<d", b[2])[0] if 2 in b else 0.0 for b in both]
            m["serialnumber"] = m["serialnumber"] or None
            m["measure_type"] = m["measure_type"] or 0
            out["measures"].append(m)
    return out | {"type": out["type"] or 0}


def extent(label: bytes) -> dict[str, int]:
    """The places that a file's label names."""
    if len(label) < LABEL_BYTES:
        raise ValueError("smaller than its label")
    label, number = label[:LABEL_BYTES].decode("latin-1"), {}
    for key in ("HeaderStartByte", "HeaderBytes", "PointsStartByte", "PointsBytes"):
        m = re.search(rf"\b{key}\s*=\s*(-?\d+)", label)
        if not m:
            raise ValueError(f"label without {key}")
        number[key] = int(m[1])
    if min(number.values()) < 0:
        raise ValueError("offsets exceed the file")
    return number


def header_of(raw: bytes) -> tuple[dict, list[int] | None]:
    """The header message's texts and, in the newer form, the sizes of the points."""
    header, sizes = {}, None
    for n, v in fields(raw):
        if n in HEADER and isinstance(v, bytes):
            header[HEADER[n]] = v.decode("utf-8", "replace")
        elif n == 7 and isinstance(v, bytes):
            sizes, at = [], 0
            while at < len(v):
                one, at = _varint(v, at)
                sizes.append(one)
    return header, sizes


def layout(raw: bytes) -> dict:
    """header, start, size and (in the newer form) sizes of the points of a whole file."""
    at = extent(raw)
    start, size, head = at["PointsStartByte"], at["PointsBytes"], at["HeaderStartByte"]
    if head + at["HeaderBytes"] > len(raw) or start + size > len(raw):
        raise ValueError("offsets exceed the file")
    header, sizes = header_of(raw[head : head + at["HeaderBytes"]])
    return {"header": header, "start": start, "size": size, "sizes": sizes}


def spans(raw: bytes, lay: dict) -> list[tuple[int, int]]:
    """(start, size) of every point."""
    at, end, out = lay["start"], lay["start"] + lay["size"], []
    for size in lay["sizes"] or []:
        out.append((at, size))
        at += size
    while lay["sizes"] is None and at + 4 <= end:
        size = struct.unpack_from("<I", raw, at)[0]
        out.append((at + 4, size))
        at += 4 + size
    if at > end:
        raise ValueError("a point exceeds the points' block")
    return out


class _Range(InputPartition):
    def __init__(self, path: str, first: int, todo: list[tuple[int, int]]):
        self.path, self.first, self.todo = path, first, todo


class _Reader(DataSourceReader):
    """Of a local file only the label, the header and, in the older form, the sizes before the points are read on the driver."""

    def __init__(self, path: str, per: int):
        self.path, self.per = path.removeprefix("file://"), per

    def _spans(self) -> list[tuple[int, int]]:
        with open(self.path, "rb") as f:
            at = extent(f.read(LABEL_BYTES))
            f.seek(at["HeaderStartByte"])
            _, sizes = header_of(f.read(at["HeaderBytes"]))
            place, end, out = at["PointsStartByte"], at["PointsStartByte"] + at["PointsBytes"], []
            if sizes is not None:
                for size in sizes:
                    out.append((place, size))
                    place += size
                return out
            while place + 4 <= end:
                f.seek(place)
                size = struct.unpack("<I", f.read(4))[0]
                out.append((place + 4, size))
                place += 4 + size
        if place > end:
            raise ValueError("a point exceeds the points' block")
        return out

    def partitions(self) -> list[_Range]:
        todo = self._spans()
        return [_Range(self.path, k, todo[k : k + self.per]) for k in range(0, len(todo), self.per)] or [_Range(self.path, 0, [])]

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            for k, (start, size) in enumerate(part.todo):
                f.seek(start)
                p = point(f.read(size))
                yield (part.first + k, *(p[n] for n, _ in POINT.values()), [tuple(m[f] for f in m) for m in p["measures"]])


class NetSource(DataSource):
    """Option points: how many points make a partition (default 50000)."""

    @classmethod
    def name(cls) -> str:
        return "planisphere_net"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("points", 50_000)))


#: Files of a stream's batch for each task.
FILES = 4
#: Bytes of a chunk of a file, and of a window of whole points.
CHUNK = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, block, rel, data: the lines of each split put together again, in pieces of about CHUNK bytes."""

    def piece(key, rel, lines):
        return pa.record_batch([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([rel], pa.int64()), pa.array([b"".join(lines)], pa.binary())], names=["path", "block", "rel", "data"])

    key, rel, size, lines = None, 0, 0, []
    for batch in batches:
        for path, block, line in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if lines and ((path, block) != key or size >= CHUNK):
                yield piece(key, rel, lines)
                rel, size, lines = rel + size, 0, []
            if (path, block) != key:
                key, rel = (path, block), 0
            lines += [line, b"\n"]
            size += len(line) + 1
    if lines:
        yield piece(key, rel, lines)


class _Cutter:
    """Cuts a file's bytes, as they come, into windows of whole points."""

    def __init__(self):
        self.held, self.at, self.sizes, self.pending, self.todo, self.first = bytearray(), None, None, None, None, 0

    def _ready(self) -> bool:
        """Label and header are read, and what stands before the points is gone."""
        if self.at is None and len(self.held) >= LABEL_BYTES:
            self.at = extent(bytes(self.held[:LABEL_BYTES]))
        if self.at is None:
            return False
        head, start = self.at["HeaderStartByte"], self.at["PointsStartByte"]
        if self.todo is None and len(self.held) >= max(start, head + self.at["HeaderBytes"]):
            _, sizes = header_of(bytes(self.held[head : head + self.at["HeaderBytes"]]))
            self.sizes, self.todo = (iter(sizes) if sizes is not None else None), self.at["PointsBytes"]
            del self.held[:start]
        return self.todo is not None

    def feed(self, data: bytes) -> Iterator[tuple[int, list[int], list[int], bytes]]:
        """(first point, starts, sizes, raw) of each window that is complete."""
        self.held += data
        if not self._ready():
            return
        pad, used, starts, sizes = (0 if self.sizes is not None else 4), 0, [], []
        while self.todo > 0:
            if self.sizes is not None:
                self.pending = size = next(self.sizes, None) if self.pending is None else self.pending
                if size is None:
                    raise ValueError("fewer sizes than points")
            elif self.todo < 4:
                self.todo = 0
                break
            elif used + 4 > len(self.held):
                break
            else:
                size = struct.unpack_from("<I", self.held, used)[0]
            if pad + size > self.todo:
                raise ValueError("a point exceeds the points' block")
            if used + pad + size > len(self.held):
                break
            starts.append(used + pad)
            sizes.append(size)
            used, self.todo, self.pending = used + pad + size, self.todo - pad - size, None
            if used >= CHUNK:
                yield self._window(starts, sizes, used)
                used, starts, sizes = 0, [], []
        if starts:
            yield self._window(starts, sizes, used)

    def _window(self, starts: list[int], sizes: list[int], used: int) -> tuple[int, list[int], list[int], bytes]:
        out = (self.first, starts, sizes, bytes(self.held[:used]))
        self.first += len(starts)
        del self.held[:used]
        return out

    def finish(self) -> None:
        if self.todo is None:
            raise ValueError("smaller than its label" if self.at is None else "offsets exceed the file")
        if self.todo > 0 and self.todo >= (0 if self.sizes is not None else 4):
            raise ValueError("offsets exceed the file")


_WINDOW = "path string, first long, starts array<long>, sizes array<long>, raw binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of whole points from chunks in the order of path and offset."""
    ints, now, cutter = pa.list_(pa.int64()), None, None
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(2)):
            if path != now:
                if cutter:
                    cutter.finish()
                now, cutter = path, _Cutter()
            for first, starts, sizes, raw in cutter.feed(data.as_py()):
                yield pa.record_batch([pa.array([path], pa.string()), pa.array([first], pa.int64()), pa.array([starts], ints), pa.array([sizes], ints), pa.array([raw], pa.binary())], names=["path", "first", "starts", "sizes", "raw"])
    if cutter:
        cutter.finish()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block, rel, data: the bytes of all files of a path, read in splits by Spark.

    The text reader with a line break as its only separator loses no byte: each line is followed by one again.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    return text.mapInArrow(_chunks, "path string, block long, rel long, data binary")


def file_chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, data of `_pieces` as a staged table: a split's place follows from the lengths of those before it."""
    pieces = stage(_pieces(spark, path), "chunks")
    per = pieces.groupBy("path", "block").agg(F.sum(F.length("data")).alias("n"))
    ahead = per.select("path", "block", (F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).alias("ahead"))  # a row a split
    return pieces.join(ahead, ["path", "block"]).select("path", (F.col("ahead") + F.col("rel")).alias("offset"), "data")


_PLACED = "ahead long, first long, starts array<long>, sizes array<long>, raw binary"
#: Windows of a file that one task reads, so that all tasks have some: one task cuts a file.
WINDOWS = 8


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Windows of whole points of all files of a path; ahead: the points of the files before, first: those of the file before the window.

    Pieces of a file are in order by split and place in it, so its bytes are sent once, to be cut, and written once.
    """
    pieces = _pieces(spark, path).repartition("path").sortWithinPartitions("path", "block", "rel").select("path", F.lit(0).alias("at"), "data")
    windows = stage(pieces.mapInArrow(_windows, _WINDOW), "windows", WINDOWS)
    counts = windows.groupBy("path").agg(F.sum(F.size("starts")).alias("n"))
    before = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("ahead"))  # a row a file
    return windows.join(F.broadcast(before), "path").select("ahead", "first", "starts", "sizes", "raw")


def dealt(windows: DataFrame) -> DataFrame:
    """Windows spread over all tasks, for those that come from one task and are not staged in files of a few."""
    return windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ahead", "first")


def _columns(points: list[dict], base: int, arrow: pa.Schema) -> pa.RecordBatch:
    """Decoded points as a batch, each field of points and measures a column at once."""
    each, kind = [m for p in points for m in p["measures"]], arrow.field("measures").type.value_type
    inner = pa.StructArray.from_arrays([pa.array([m[f.name] for m in each], f.type) for f in kind], fields=list(kind))
    ends = pa.array(accumulate((len(p["measures"]) for p in points), initial=0), pa.int32())
    made = {"point_idx": pa.array(range(base, base + len(points)), pa.int64()), "measures": pa.ListArray.from_arrays(ends, inner, type=arrow.field("measures").type)}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array([p[f.name] for p in points], f.type) for f in arrow], schema=arrow)


def decoded(windows: DataFrame) -> DataFrame:
    """The points of windows, a table or a stream of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = windows.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def each(batches):
        for batch in batches:
            for ahead, first, starts, sizes, raw in zip(*(batch.column(k) for k in range(5))):
                data, base = raw.as_py(), ahead.as_py() + first.as_py()
                yield _columns([point(data[a : a + n]) for a, n in zip(starts.as_py(), sizes.as_py())], base, arrow)

    return windows.mapInArrow(each, schema)


def read_net(spark: SparkSession, path: str) -> DataFrame:
    """The points of the .net files of a path that Spark can read; point_idx counts on from file to file, in the order of their paths."""
    return decoded(_placed(spark, path))


def cut_net(spark: SparkSession, path: str, out: str, windows_per_file: int = 64) -> None:
    """Cut .net files into a folder of windows of whole points (about a megabyte each), for `stream_net`. Written once, or not at all."""
    _placed(spark, path).write.mode("errorifexists").option("maxRecordsPerFile", windows_per_file).parquet(out)


def files_for_all(spark: SparkSession) -> int:
    """Files of a batch that all tasks decode, a few each: of a batch of one file all tasks but one wait."""
    return FILES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def stream_net(spark: SparkSession, cut: str, files_at_once: int = 1) -> DataFrame:
    """The points of a folder that `cut_net` made, as a stream of bounded batches.

    A batch is `files_at_once` files (`files_for_all` gives every task some), so at most that many times `windows_per_file` windows. The query's checkpoint tells which
    files were read: a query that was stopped goes on with the next one, and each point comes once.
    """
    return decoded(spark.readStream.schema(_PLACED).option("maxFilesPerTrigger", files_at_once).parquet(cut))


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The header of the first file of a path; only its first chunks come to the driver."""
    chunks = file_chunks(spark, path)
    first = chunks.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no file at {path}")
    own = chunks.where(F.col("path") == first)
    upto = lambda n: b"".join(bytes(r.data) for r in own.where(F.col("offset") < n).orderBy("offset").collect())
    at = extent(upto(LABEL_BYTES))
    raw = upto(at["HeaderStartByte"] + at["HeaderBytes"])
    if len(raw) < at["HeaderStartByte"] + at["HeaderBytes"]:
        raise ValueError("offsets exceed the file")
    return header_of(raw[at["HeaderStartByte"] : at["HeaderStartByte"] + at["HeaderBytes"]])[0]


def _tag(number: int, kind: int) -> bytes:
    return _put(number << 3 | kind)


def _put(v: int) -> bytes:
    v, out = v & (1 << 64) - 1, bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _message(record: dict, names: dict) -> bytes:
    out = b""
    for number, (name, kind) in names.items():
        v = record.get(name)
        if v is None or v == [] or v == "":
            continue
        if kind == "int":
            out += _tag(number, 0) + _put(int(v))
        elif kind == "double":
            out += _tag(number, 1) + struct.pack("<d", v)
        else:
            raw = v.encode() if kind == "string" else struct.pack(f"<{len(v)}d", *v)
            out += _tag(number, 2) + _put(len(raw)) + raw
    return out


def encode_point(p: dict) -> bytes:
    out = _message(p, POINT)
    for m in p.get("measures") or []:
        raw = _message(m, MEASURE)
        for t, v in zip(m.get("measure_logType") or [], m.get("measure_logValue") or []):
            log = _tag(1, 0) + _put(t) + _tag(2, 1) + struct.pack("<d", v)
            raw += _tag(LOGS, 2) + _put(len(log)) + log
        out += _tag(MEASURES, 2) + _put(len(raw)) + raw
    return out


def _messages(columns: dict[str, list], names: dict, n: int) -> list[bytes]:
    """`_message` of each of n records whose fields are columns."""
    parts = []
    for number, (name, kind) in names.items():
        values = columns.get(name)
        if values is None:
            continue
        if kind == "int":
            tag = _tag(number, 0)
            parts.append([b"" if v is None else tag + _put(int(v)) for v in values])
        elif kind == "double":
            tag, pack = _tag(number, 1), struct.Struct("<d").pack
            parts.append([b"" if v is None else tag + pack(v) for v in values])
        else:
            tag = _tag(number, 2)
            raw = [(v.encode() if kind == "string" else struct.pack(f"<{len(v)}d", *v)) if v else b"" for v in values]
            parts.append([tag + _put(len(r)) + r if r else b"" for r in raw])
    return [b"".join(p) for p in zip(*parts)] if parts else [b""] * n


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    """`encode_point` of each row of a batch, a column at once."""
    held = {name: batch.column(name).to_pylist() for name, _ in POINT.values() if name in batch.schema.names}
    out = _messages(held, POINT, batch.num_rows)
    if "measures" not in batch.schema.names:
        return out
    lists = batch.column("measures")
    if not isinstance(lists, pa.ListArray):
        return [encode_point(row) for row in batch.to_pylist()]
    each = lists.flatten()
    fields_ = {f.name: c.to_pylist() for f, c in zip(each.type, each.flatten())}
    raw = _messages(fields_, MEASURE, len(each))
    if "measure_logType" in fields_ and "measure_logValue" in fields_:
        for k, (types, values) in enumerate(zip(fields_["measure_logType"], fields_["measure_logValue"])):
            for t, v in zip(types or [], values or []):
                log = _tag(1, 0) + _put(t) + _tag(2, 1) + struct.pack("<d", v)
                raw[k] += _tag(LOGS, 2) + _put(len(log)) + log
    tag, at = _tag(MEASURES, 2), 0
    raw = [tag + _put(len(r)) + r for r in raw]
    for k, n in enumerate(lists.value_lengths().to_pylist()):
        out[k] += b"".join(raw[at : at + (n or 0)])
        at += n or 0
    return out


#: Bytes of encoded points that a task holds at once.
BLOB = 1 << 22


def _posix(path: str) -> str:
    """The path of a file that driver and executors can open in place."""
    plain = re.sub(r"^file:(//(?=/))?", "", path)
    if "://" in plain:
        raise ValueError(f"{path}: one .net file is written in place by many tasks, which needs a folder that all machines mount")
    return plain


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, rel, n, data: the partition's points, encoded, in blobs of about BLOB bytes."""
    from pyspark import TaskContext

    part, rel, n, held = TaskContext.get().partitionId(), 0, 0, bytearray()

    def blob() -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int64()), pa.array([rel], pa.int64()), pa.array([n], pa.int64()), pa.array([bytes(held)], pa.binary())], names=["part", "rel", "n", "data"])

    for batch in batches:
        for raw in _encoded(batch):
            held += struct.pack("<I", len(raw)) + raw
            n += 1
            if len(held) >= BLOB:
                yield blob()
                rel, n, held = rel + len(held), 0, bytearray()
    if held:
        yield blob()


def write_net(points: DataFrame, path: str, header: dict[str, str]) -> int:
    """One .net file from rows of SCHEMA, in the older form; returns the number of points.

    Tasks encode ranges of points; the sizes of their parts, a row each, give every blob its place in the file, and tasks write
    the blobs there, all at once. A task that runs again writes the same bytes to the same place. The driver writes label and
    header, which need counts alone. `path` is in a folder that all machines mount.
    """
    target = _posix(path)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or small rows would be put together in a few
    ranged = points.repartitionByRange(tasks, "point_idx").sortWithinPartitions("point_idx")
    blobs = stage(ranged.mapInArrow(_blobs, "part long, rel long, n long, data binary"), "blobs")
    sizes = blobs.groupBy("part").agg(F.sum(F.length("data")).alias("size"), F.sum("n").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ahead = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))  # a row a partition
    head = b"".join(_tag(n, 2) + _put(len(v.encode())) + v.encode() for n, name in HEADER.items() if (v := header.get(name)))
    head += _tag(7, 0) + _put(total.n)
    start = LABEL_BYTES + len(head)
    label = f"Object = ProtoBuffer\n  HeaderStartByte = {LABEL_BYTES}\n  HeaderBytes = {len(head)}\n  PointsStartByte = {start}\n  PointsBytes = {total['size']}\nEnd_Object\nEnd\n".encode()
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target, "wb") as f:
        f.write(label.ljust(LABEL_BYTES) + head)
        f.truncate(start + total["size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(target, "r+b") as f:
            for batch in batches:
                for at, data in zip(*(batch.column(c) for c in ("at", "data"))):
                    f.seek(at.as_py())
                    f.write(data.as_py())
            os.fsync(f.fileno())
        yield pa.record_batch([pa.array([1], pa.int64())], names=["done"])

    placed = blobs.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("rel") + start).alias("at"), "data")
    placed.mapInArrow(place, "done long").agg(F.sum("done")).collect()
    discard(blobs)
    return total.n
