"""Where keyframes lie, from the indexes of media containers: a data source that reads nothing but the index, and the times it gives.

The source flattens an index to rows; what they mean is left to joins and windows. MP4: the video track's `scale`, its `run`s of sample durations (a samples of b ticks) and its `sync` samples (a, from 1). Matroska: `scale` (nanoseconds a tick)
and the `cue`s of the video track (a ticks; all cues where no track is told to be video). AVI: the first video stream's `rate` (a frames in b seconds) and the `frame`s that the index flags as keyframes (a, from 0, of all video chunks). A file that is none of them, is cut short or has no index gives one row `none`. `read` is the number of bytes that were read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, container string, kind string, ord long, a long, b long, read long"
#: Fixed values of the formats: element ids of Matroska, with their length marker.
EBML, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_AT = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, SCALE, TRACKS, TRACK, TRACK_NUMBER, TRACK_TYPE, VIDEO = 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 1
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0x1F43B675
#: Fixed values of AVI: the flag of a keyframe, the chunks that are video, the most frames a second that are believed.
KEYFRAME_FLAG, VIDEO_CHUNKS, MOST_RATE = 0x10, (b"dc", b"db"), 1000
MOST_INDEX = 256 << 20


class _Counted:
    """Ranges of a file, and how many bytes of it were read."""

    def __init__(self, file: BinaryIO):
        self.file, self.read = file, 0

    def at(self, offset: int, size: int) -> bytes:
        if size > MOST_INDEX:
            raise ValueError("index too large")
        self.file.seek(offset)
        out = self.file.read(size)
        self.read += len(out)
        return out


def _box(head: bytes) -> tuple[bytes, int, int]:
    """Kind, length of the header and length of the whole box that a header of 16 bytes tells of."""
    size, kind = struct.unpack_from(">I4s", head)
    return (kind, 16, struct.unpack_from(">Q", head, 8)[0]) if size == 1 else (kind, 8, size)


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Boxes of a body, as kind and body; a box that does not fit ends it."""
    at = 0
    while at + 8 <= len(data):
        kind, head, size = _box(data[at : at + 16].ljust(16, b"\0"))
        if size < head or at + size > len(data):
            return
        yield kind, data[at + head : at + size]
        at += size


def _within(data: bytes, *kinds: bytes) -> bytes | None:
    """The first box down a path of kinds."""
    for kind in kinds:
        data = next((body for k, body in _boxes(data) if k == kind), None)
        if data is None:
            return None
    return data


def _table(data: bytes | None, columns: int) -> np.ndarray:
    """The entries of a counted table of 32-bit numbers, as many as are there."""
    if data is None or len(data) < 8:
        return np.zeros((0, columns), np.int64)
    n = min(struct.unpack_from(">I", data, 4)[0], (len(data) - 8) // (4 * columns))
    return np.frombuffer(data, ">u4", n * columns, 8).astype(np.int64).reshape(n, columns)


def _mp4(file: _Counted) -> list[tuple[str, np.ndarray]]:
    """Rows of the first video track: box after box is skipped by its length until the movie's own."""
    at = 0
    while len(head := file.at(at, 16)) >= 8:
        kind, skip, size = _box(head.ljust(16, b"\0"))
        if size < skip:
            return []
        if kind == b"moov":
            movie = file.at(at + skip, size - skip)
            break
        at += size
    else:
        return []
    for kind, track in _boxes(movie):
        media = _within(track, b"mdia") if kind == b"trak" else None
        handler, header = (_within(media, k) if media else None for k in (b"hdlr", b"mdhd"))
        if handler is None or handler[8:12] != b"vide" or header is None or len(header) < 24:
            continue
        samples = _within(media, b"minf", b"stbl")
        if samples is None:
            continue
        scale = struct.unpack_from(">I", header, 20 if header[0] == 1 else 12)[0]
        return [("scale", np.array([[scale, 0]])), ("run", _table(_within(samples, b"stts"), 2)), ("sync", np.pad(_table(_within(samples, b"stss"), 1), ((0, 0), (0, 1))))]
    return []


def _number(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """A number of variable length and where it ends; the first byte's leading zeros tell the length. With its marker it is an id."""
    zeros = 8 - data[at].bit_length()
    if zeros > 7 or at + zeros >= len(data):
        raise ValueError("no number")
    value = int.from_bytes(data[at : at + zeros + 1], "big")
    return (value if marker else value & ((1 << (7 * (zeros + 1))) - 1)), at + zeros + 1


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Elements of a body, as id and body; what is cut short ends it."""
    at = 0
    while at + 2 <= len(data):
        try:
            name, at = _number(data, at, True)
            size, at = _number(data, at, False)
        except (ValueError, IndexError):
            return
        yield name, data[at : at + size]
        at += size


def _first(data: bytes, name: int) -> bytes | None:
    return next((body for k, body in _elements(data) if k == name), None)


def _element_at(file: _Counted, at: int) -> tuple[int, int, int]:
    """Id, start and length of the body of the element at a place."""
    head = file.at(at, 16)
    name, p = _number(head, 0, True)
    size, p = _number(head, p, False)
    return name, at + p, size


def _matroska(file: _Counted) -> list[tuple[str, np.ndarray]]:
    """Rows of the cues: headers in front of the first cluster tell where tracks and cues lie."""
    _, start, size = _element_at(file, 0)
    name, begin, length = _element_at(file, start + size)
    if name != SEGMENT:
        return []
    parts: dict[int, bytes] = {}
    places: dict[int, int] = {}
    at, end = begin, begin + length
    while at < end and not ({CUES} <= parts.keys() | places.keys() and {TRACKS} <= parts.keys() | places.keys() and INFO in parts):
        try:
            name, body, size = _element_at(file, at)
        except (ValueError, IndexError):
            break
        if name == CLUSTER:
            break
        if name in (INFO, TRACKS, CUES):
            parts[name] = file.at(body, size)
        if name == SEEK_HEAD:
            for _, seek in ((k, v) for k, v in _elements(file.at(body, size)) if k == SEEK):
                target, place = _first(seek, SEEK_ID), _first(seek, SEEK_AT)
                if target is not None and place is not None:
                    places[int.from_bytes(target, "big")] = begin + int.from_bytes(place, "big")
        at = body + size
    for wanted in (INFO, TRACKS, CUES):
        if wanted not in parts and wanted in places:
            name, body, size = _element_at(file, places[wanted])
            if name == wanted:
                parts[wanted] = file.at(body, size)
    if CUES not in parts:
        return []
    scale = _first(parts.get(INFO, b""), SCALE)
    video = None
    for kind, track in _elements(parts.get(TRACKS, b"")):
        number, type_ = _first(track, TRACK_NUMBER), _first(track, TRACK_TYPE)
        if kind == TRACK and number is not None and type_ is not None and int.from_bytes(type_, "big") == VIDEO:
            video = int.from_bytes(number, "big")
            break
    times = []
    for kind, cue in _elements(parts[CUES]):
        time = _first(cue, CUE_TIME) if kind == CUE else None
        of = {int.from_bytes(_first(place, CUE_TRACK) or b"", "big") for k, place in _elements(cue) if k == CUE_PLACE}
        if time is not None and (video is None or video in of):
            times.append((int.from_bytes(time, "big"), 0))
    return [("scale", np.array([[int.from_bytes(scale, "big") if scale else 1_000_000, 0]])), ("cue", np.array(times, np.int64).reshape(-1, 2))]


def _riff(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of a body, as name and body, a list by the name of its type; what is cut short ends it."""
    at = 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        yield (body[:4], body[4:]) if name == b"LIST" else (name, body)
        at += 8 + size + size % 2


def _avi(file: _Counted) -> list[tuple[str, np.ndarray]]:
    """Rows of the stream headers and the index: chunk after chunk is skipped by its length until both are there."""
    at, rate, index = 12, None, None
    while (rate is None or index is None) and len(head := file.at(at, 12)) >= 8:
        name, size = struct.unpack_from("<4sI", head)
        if name == b"LIST" and head[8:] == b"hdrl":
            headers = (body for kind, stream in _riff(file.at(at + 12, size - 4)) if kind == b"strl" for k, body in _riff(stream) if k == b"strh" and len(body) >= 32)
            rate = next((struct.unpack_from("<II", h, 20) for h in headers if h[:4] == b"vids"), rate)
        elif name == b"idx1":
            index = file.at(at + 8, size)
        at += 8 + size + size % 2
    if rate is None or index is None:
        return []
    scale, per = rate
    if not 0 < per <= MOST_RATE * scale:
        return []
    entries = np.frombuffer(index, [("stream", "S2"), ("kind", "S2"), ("flags", "<u4"), ("place", "<u4"), ("size", "<u4")], len(index) // 16)
    video = entries[np.isin(entries["kind"], VIDEO_CHUNKS)]
    return [("rate", np.array([[per, scale]])), ("frame", np.pad(np.flatnonzero(video["flags"] & KEYFRAME_FLAG)[:, None], ((0, 0), (0, 1))))]


def _read(file: BinaryIO) -> tuple[str, list[tuple[str, np.ndarray]], int]:
    """Container, parts of the index and number of bytes read of one file."""
    counted, container, parts = _Counted(file), "unknown", []
    try:
        head = counted.at(0, 16)
        if head[:4] == EBML.to_bytes(4, "big"):
            container, parts = "matroska", _matroska(counted)
        elif head[4:8] in (b"ftyp", b"moov", b"free", b"skip", b"mdat"):
            container, parts = "mp4", _mp4(counted)
        elif head[:4] == b"RIFF" and head[8:12] == b"AVI ":
            container, parts = "avi", _avi(counted)
    except (ValueError, IndexError, struct.error):
        parts = []
    return container, parts or [("none", np.zeros((1, 2), np.int64))], counted.read


def _batch(paths: list[str | None], found: list[tuple[str, list[tuple[str, np.ndarray]], int]]) -> pa.RecordBatch:
    """The rows of the indexes of many files: one batch, as a batch a file costs more than reading its index."""
    file_of = np.array([k for k, (_, parts, _) in enumerate(found) for _ in parts], np.int64)
    rows = [x for _, parts, _ in found for _, x in parts]
    n = np.array([len(x) for x in rows], np.int64)
    both = np.concatenate([np.zeros((0, 2), np.int64), *rows])
    part, of = np.repeat(np.arange(len(n)), n), np.repeat(file_of, n)
    order = np.arange(len(both)) - (np.cumsum(n) - n)[part]
    text = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
    read = np.array([r for _, _, r in found], np.int64)[of]
    columns = [text(paths, of), text([c for c, _, _ in found], of), text([k for _, parts, _ in found for k, _ in parts], part), pa.array(order), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(read, pa.int64())]
    return pa.record_batch(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def index_rows(path: str, file: BinaryIO) -> pa.RecordBatch:
    """The rows of one file's index."""
    return _batch([path], [_read(file)])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.per = options["path"], int(options.get("filesPerPartition", "32"))

    def partitions(self) -> list[_Files]:
        system, folder = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)
        info = system.get_file_info(folder)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(folder, recursive=True))
        paths = sorted(f.path for f in found if f.is_file)
        return [_Files(paths[k : k + self.per]) for k in range(0, len(paths), self.per)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        for path in partition.paths:
            with system.open_input_file(path) as file:
                yield index_rows(path, file)


class ContainerIndex(DataSource):
    """Format `container_index`: the index rows of all files under a path, which workers can open (local or shared, or a store that Arrow knows), filesPerPartition of them a task. Only names are listed on the driver."""

    @classmethod
    def name(cls) -> str:
        return "container_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def index_of(files: DataFrame) -> DataFrame:
    """Index rows of files that are at hand as (path, content); content of null is no container."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(batch.column("path").to_pylist(), [_read(BytesIO(content or b"")) for content in batch.column("content").to_pylist()])

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def keyframe_times(index: DataFrame) -> DataFrame:
    """path, t_ms of all keyframes that indexes tell of, repeats included.

    A sync sample lies in the last run that begins at or before it; runs become places by prefix sums. Samples beyond the last run, and files without a scale above 0, give nothing."""
    scale = index.where("kind = 'scale' AND a > 0").select("path", F.col("a").alias("scale"))
    w = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    runs = index.where("kind = 'run' AND a > 0").select("path", "a", "b", F.sum("a").over(w).alias("upto"), F.sum(F.col("a") * F.col("b")).over(w).alias("ticks"))
    begins = runs.select("path", (F.col("upto") - F.col("a")).alias("at"), F.struct("a", "b", (F.col("upto") - F.col("a")).alias("first"), (F.col("ticks") - F.col("a") * F.col("b")).alias("ticks")).alias("run"))
    syncs = index.where("kind = 'sync' AND a > 0").select("path", (F.col("a") - 1).alias("at"), F.lit(None).cast("struct<a:bigint,b:bigint,first:bigint,ticks:bigint>").alias("run"))
    both = begins.withColumn("sync", F.lit(0)).unionByName(syncs.withColumn("sync", F.lit(1)))
    placed = both.withColumn("run", F.last("run", ignorenulls=True).over(W.partitionBy("path").orderBy("at", "sync"))).where("sync = 1 AND at < run.first + run.a")
    mp4 = placed.select("path", (F.col("run.ticks") + (F.col("at") - F.col("run.first")) * F.col("run.b")).alias("ticks")).join(scale, "path").select("path", F.expr("(ticks * 1000) div scale").alias("t_ms"))
    cues = index.where("kind = 'cue'").select("path", F.col("a").alias("ticks")).join(scale, "path").select("path", F.expr("(ticks * scale) div 1000000").alias("t_ms"))
    rate = index.where("kind = 'rate'").select("path", F.col("a").alias("rate"), F.col("b").alias("scale"))
    frames = index.where("kind = 'frame'").select("path", "a").join(rate, "path").select("path", F.expr("(a * 1000 * scale) div rate").alias("t_ms"))
    return mp4.unionByName(cues).unionByName(frames)
