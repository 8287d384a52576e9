"""Planted files of both containers, with their index behind a large body."""

import random
import struct

from spanloom.sources import container_index as C


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def track(handler, scale, runs, syncs, version=0):
    header = bytes([version, 0, 0, 0]) + (bytes(16) if version else bytes(8)) + struct.pack(">I", scale) + bytes(12)
    tables = box(b"stts", bytes(4), struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)) + box(b"stss", bytes(4), struct.pack(">I", len(syncs)), *(struct.pack(">I", s) for s in syncs))
    return box(b"trak", box(b"tkhd", bytes(8)), box(b"mdia", box(b"mdhd", header), box(b"hdlr", bytes(8), handler, bytes(4)), box(b"minf", box(b"stbl", tables))))


def mp4(body, *tracks, wide=False):
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(body), wide=wide) + box(b"moov", box(b"mvhd", bytes(4)), *tracks)


def element(name, body):
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + (0x01 << 56 | len(body)).to_bytes(8, "big") + body


def number(x):
    return x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")


def matroska(body, cues, scale=1_000_000, tracks=((1, 2), (2, 1)), seek=True):
    info = element(C.INFO, element(C.SCALE, number(scale)))
    kinds = element(C.TRACKS, b"".join(element(C.TRACK, element(C.TRACK_NUMBER, number(n)) + element(C.TRACK_TYPE, number(t))) for n, t in tracks))
    index = element(C.CUES, b"".join(element(C.CUE, element(C.CUE_TIME, number(t)) + b"".join(element(C.CUE_PLACE, element(C.CUE_TRACK, number(n))) for n in on)) for t, on in cues))
    cluster = element(C.CLUSTER, bytes(body))

    def head(place):
        return element(C.SEEK_HEAD, element(C.SEEK, element(C.SEEK_ID, C.CUES.to_bytes(4, "big")) + element(C.SEEK_AT, place.to_bytes(8, "big"))) if seek else b"")

    front = len(head(0)) + len(info) + len(kinds) + len(cluster)
    return element(C.EBML, b"\x42\x86\x81\x01") + element(C.SEGMENT, head(front) + info + kinds + cluster + index)


def chunk(name, *parts):
    body = b"".join(parts)
    return struct.pack("<4sI", name, len(body)) + body + bytes(len(body) % 2)


def avi(body, streams, entries, index=True):
    """streams: (type, scale, rate); entries: (name, is a keyframe)."""
    lists = [chunk(b"LIST", b"strl", chunk(b"strn", b"odd"), chunk(b"strh", kind, bytes(16), struct.pack("<II", scale, rate), bytes(20))) for kind, scale, rate in streams]
    whole = chunk(b"LIST", b"hdrl", chunk(b"avih", bytes(56)), *lists) + chunk(b"LIST", b"movi", bytes(body))
    if index:
        whole += chunk(b"idx1", *(struct.pack("<4sIII", n, 0x10 if key else 0, 4, 9) for n, key in entries))
    return b"RIFF" + struct.pack("<I", len(whole) + 4) + b"AVI " + whole


def plain(runs, syncs, scale):
    starts, now = [], 0
    for n, d in runs:
        for _ in range(n):
            starts.append(now)
            now += d
    return sorted(starts[s - 1] * 1000 // scale for s in syncs if 0 < s <= len(starts))


def test_planted_files(spark, tmp_path):
    r = random.Random(2)
    runs = [(r.randrange(0, 40), r.randrange(0, 3000)) for _ in range(30)]
    total = sum(n for n, _ in runs)
    syncs = sorted(r.sample(range(1, total + 1), 50)) + [total + 5]
    sound, film = track(b"soun", 48_000, [(5, 1)], [1, 2]), track(b"vide", 90_000, runs, syncs)
    chunks = [(r.choice([b"00dc", b"00db", b"01wb", b"ix00", b"02dc"]), r.random() < 0.3) for _ in range(150)]
    video = [key for name, key in chunks if name[2:] in (b"dc", b"db")]
    files = {
        "a.mp4": mp4(1 << 20, sound, film), "wide.mp4": mp4(1 << 20, film, wide=True), "v1.mp4": mp4(10, track(b"vide", 600, [(3, 20)], [1, 3], 1)), "sound.mp4": mp4(10, sound), "cut.mp4": mp4(1 << 20, film)[:-9000],
        "b.mkv": matroska(1 << 20, [(5, [2]), (7, [1]), (9, [1, 2])], 2_000_000), "none.mkv": matroska(10, [(5, [1]), (3, [7])], tracks=[(1, 2)]), "noseek.mkv": matroska(100, [(5, [2])], seek=False), "c.avi": avi((1 << 20) + 1, [(b"auds", 1, 8), (b"vids", 1001, 30_000)], chunks), "noindex.avi": avi(99, [(b"vids", 1, 25)], [], False), "sound.avi": avi(9, [(b"auds", 1, 25)], chunks), "fast.avi": avi(9, [(b"vids", 1, 1001)], chunks), "still.avi": avi(9, [(b"vids", 1, 0)], chunks), "cut.avi": avi(9, [(b"vids", 1, 25)], [(b"00dc", True)] * 2)[:-7],
        "text": b"no container at all", "empty": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(C.ContainerIndex)
    index = spark.read.format("container_index").option("filesPerPartition", "3").load(str(tmp_path))
    rows = index.collect()
    assert index.rdd.getNumPartitions() == 6
    at = {name: sorted(x.t_ms for x in C.keyframe_times(index).collect() if x.path.endswith(f"/{name}")) for name in files}
    want = plain(runs, syncs, 90_000)
    assert at == {"a.mp4": want, "wide.mp4": want, "v1.mp4": [0, 66], "sound.mp4": [], "cut.mp4": [], "b.mkv": [10, 18], "none.mkv": [3, 5], "noseek.mkv": [], "c.avi": [k * 1000 * 1001 // 30_000 for k, key in enumerate(video) if key], "noindex.avi": [], "sound.avi": [], "fast.avi": [], "still.avi": [], "cut.avi": [0], "text": [], "empty": []}
    read = {x.path.rsplit("/", 1)[1]: x.read for x in rows}
    assert all(read[n] < 4000 for n in ("a.mp4", "wide.mp4", "b.mkv", "c.avi"))
    assert {x.path.rsplit("/", 1)[1] for x in rows if x.kind == "none"} == {"sound.mp4", "cut.mp4", "noseek.mkv", "noindex.avi", "sound.avi", "fast.avi", "still.avi", "text", "empty"}
    again = C.index_of(spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()] + [("null", None)], "path string, content binary"))
    assert sorted((x.kind, x.ord, x.a, x.b) for x in again.where("path <> 'null'").collect()) == sorted((x.kind, x.ord, x.a, x.b) for x in rows)


def test_one_batch_for_many_files():
    """Rows of many files, also of broken ones, are those of each file, made at once."""
    import io
    import struct

    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    stbl = box(b"stts", struct.pack(">6I", 0, 2, 3, 10, 4, 20)) + box(b"stss", struct.pack(">4I", 0, 2, 1, 5))
    media = box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">I", 90) + bytes(12)) + box(b"hdlr", bytes(8) + b"vide") + box(b"minf", box(b"stbl", stbl)))
    files = [box(b"ftyp", b"isom") + box(b"moov", box(b"trak", media)), b"", b"nothing at all here"]
    both = C._batch(["a", "b", "c"], [C._read(io.BytesIO(f)) for f in files]).to_pylist()
    assert both == [r for p, f in zip("abc", files, strict=True) for r in C.index_rows(p, io.BytesIO(f)).to_pylist()]
    assert [(r["path"], r["kind"], r["ord"], r["a"], r["b"]) for r in both] == [("a", "scale", 0, 90, 0), ("a", "run", 0, 3, 10), ("a", "run", 1, 4, 20), ("a", "sync", 0, 1, 0), ("a", "sync", 1, 5, 0), ("b", "none", 0, 0, 0), ("c", "none", 0, 0, 0)]
