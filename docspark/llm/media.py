"""ISO media containers: writing samples into one, and reading its index without decoding payloads.

``read_index`` walks the nested boxes of a file (sizes of 32 and 64 bits and "to the end"; movie fragments too), decodes the sample tables
(stts, stsc, stsz, stco, co64, stss, or a fragment's trun) and gives for every track codec, time scale, duration, number of samples, bytes of media and
the byte range of each keyframe.  It never looks into a payload.  A track without a sync table has only keyframes, as the format has it.

Null contents give no tracks and the error ``null``; bytes that are not a container, one cut short, or one whose tables contradict each other (a count that the file cannot hold, a fragment of
a track that it does not describe, places beyond 63 bits) give the tracks read so far and an error text, never an exception.  Every row gives a row, repeated ones too, and an empty table an empty
one; columns other than id and content are not read, whatever their names.  Everything is done inside the task that holds the row; memory is a small multiple of one file: a table is refused where its
count exceeds what the file's bytes can hold, and samples of no bytes count against the file's length too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import computed

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex", b"edts", b"dinf", b"udta"}
UNIT = 64
RATE = 8000
KEY_EVERY = 16

TRACKS = "array<struct<track:long,kind:string,codec:string,timescale:long,duration:long,samples:long,media_bytes:long,keyframes:array<struct<start:long,end:long>>>>"


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first and last byte of the content of every box between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("box header cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}, {end - start} are left")
        yield kind, body, start + size
        start += size
    if start != end:
        raise ValueError(f"{end - start} bytes after the last box")


def _table(data: bytes, at: int, end: int, fields: str) -> list[tuple]:
    """The entries of a full box: version and flags, a count, then entries of equal size."""
    n = _read(data, ">I", at + 4, end)[0]
    size = struct.calcsize(">" + fields)
    if at + 8 + n * size > end:
        raise ValueError("table cut short")
    return list(struct.iter_unpack(">" + fields, data[at + 8 : at + 8 + n * size]))


def read_index(data: bytes) -> tuple[list[dict], str | None]:
    """The tracks of a container, and what was wrong with it if anything."""
    tracks: list[dict] = []
    try:
        _walk(data, tracks)
        error = None if tracks else "no track"
    except (ValueError, struct.error, IndexError) as e:
        error = str(e) or type(e).__name__
    finished = []
    for t in tracks:
        try:
            finished.append(_finished(t))
        except ValueError as e:
            error = error or str(e)
    return finished, error


def _walk(data: bytes, tracks: list[dict]) -> None:
    """All boxes in the order of the file; the nested ones wait on a stack, so depth costs no recursion."""
    at: dict = {}
    open_ = [boxes(data, 0, len(data))]
    while open_:
        if (found := next(open_[-1], None)) is None:
            open_.pop()
            continue
        kind, a, z = found
        t = tracks[-1] if tracks else {}
        if kind == b"moof":
            at = {"moof": a - 8}
        if kind == b"trak":
            tracks.append({"ranges": [], "sync": None})
        if kind in NESTED:
            open_.append(boxes(data, a, z))
        elif kind == b"tkhd":
            t["track"] = _read(data, ">I", a + (20 if _read(data, ">B", a, z)[0] else 12), z)[0]
        elif kind == b"mdhd":
            long = _read(data, ">B", a, z)[0]
            t["timescale"], t["duration"] = _read(data, ">IQ" if long else ">II", a + (20 if long else 12), z)
        elif kind == b"hdlr":
            t["kind"] = data[a + 8 : min(a + 12, z)].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : min(a + 16, z)].decode("latin-1")
        elif kind == b"stts":
            t["times"] = _table(data, a, z, "II")
        elif kind == b"stsc":
            t["chunks"] = _table(data, a, z, "III")
        elif kind == b"stss":
            t["sync"] = [x for (x,) in _table(data, a, z, "I")]
        elif kind in (b"stco", b"co64"):
            t["offsets"] = [x for (x,) in _table(data, a, z, "I" if kind == b"stco" else "Q")]
        elif kind == b"stsz":
            size, n = _read(data, ">II", a + 4, z)
            if n * max(size, 1) > len(data):
                raise ValueError(f"{n} samples of {size} bytes in a file of {len(data)}")
            t["sizes"] = [size] * n if size else [x for (x,) in _table(data, a + 4, z, "I")]
        elif kind == b"tfhd":
            _fragment_header(data, a, z, at)
        elif kind == b"trun":
            _fragment_run(data, a, z, tracks, at)


def _read(data: bytes, form: str, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise ValueError("box cut short")
    return struct.unpack_from(form, data, at)


def _fragment_header(data: bytes, a: int, z: int, at: dict) -> None:
    flags, track = _read(data, ">II", a, z)
    a += 8
    at |= {"track": track, "base": at.get("moof", 0), "size": 0, "time": 0, "flags": 0}
    for flag, name, form in ((1, "base", ">Q"), (2, "", ">I"), (8, "time", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & flag:
            at[name], a = _read(data, form, a, z)[0], a + struct.calcsize(form)


def _fragment_run(data: bytes, a: int, z: int, tracks: list[dict], at: dict) -> None:
    if "track" not in at:
        raise ValueError("a fragment's run without a header")
    of_track = [t for t in tracks if t.get("track") == at["track"]]
    if not of_track:
        raise ValueError(f"a fragment of track {at['track']}, which is not described")
    flags, n = _read(data, ">II", a, z)
    flags, a = flags & 0xFFFFFF, a + 8
    fields = [flag for flag in (0x100, 0x200, 0x400, 0x800) if flags & flag]
    place = at["base"]
    if flags & 1:
        place, a = at["base"] + _read(data, ">i", a, z)[0], a + 4
    first = None
    if flags & 4:
        first, a = _read(data, ">I", a, z)[0], a + 4
    if a + 4 * n * len(fields) > z or n * max(1, 0 if 0x200 in fields else at["size"]) > len(data):
        raise ValueError(f"a run of {n} samples cut short")
    for i in range(n):
        given = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, a), strict=True))
        a += 4 * len(fields)
        size, sample = given.get(0x200, at["size"]), given.get(0x400, first if i == 0 and first is not None else at["flags"])
        of_track[0]["ranges"].append((place, place + size, not sample & 0x10000))
        of_track[0]["fragment_time"] = of_track[0].get("fragment_time", 0) + given.get(0x100, at["time"])
        place += size


def _finished(t: dict) -> dict:
    """Place every sample: chunk by chunk, each with the number of samples that holds for it."""
    ranges, sizes = [], t.get("sizes", [])
    runs, sync, n, run = t.get("chunks", []), None if t["sync"] is None else set(t["sync"]), 0, 0
    for k, offset in enumerate(t.get("offsets", []), 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= k:
            run += 1
        for _ in range(min(runs[run][1], len(sizes) - n) if runs else 0):
            n += 1
            ranges.append((offset, offset + sizes[n - 1], sync is None or n in sync))
            offset += sizes[n - 1]
    ranges += t["ranges"]
    if any(a < 0 or b >= 1 << 63 for a, b, _ in ranges):
        raise ValueError("samples at places that no file has")
    duration = t.get("duration", 0) or sum(n * d for n, d in t.get("times", []))
    duration = min(duration + t.get("fragment_time", 0), (1 << 63) - 1)  # a column of 64 bits
    return {
        "track": t.get("track"), "kind": t.get("kind"), "codec": t.get("codec"), "timescale": t.get("timescale"), "duration": duration,
        "samples": len(ranges), "media_bytes": sum(b - a for a, b, _ in ranges), "keyframes": [(a, b) for a, b, key in ranges if key], "ranges": ranges,
    }


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes, *, unit: int = UNIT, rate: int = RATE, key_every: int = KEY_EVERY) -> bytes:
    """A container with one track of unsigned 8-bit samples; ``unit`` bytes make a stored sample, every ``key_every``-th a keyframe, as many make a chunk."""
    n, wide = len(payload) // unit, len(payload) >= 1 << 31
    chunk = unit * key_every
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    form = ">%dQ" if wide else ">%dI"

    def index(media: int) -> bytes:
        full, rest = divmod(n, key_every)
        runs = [(1, key_every, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
        offsets = range(media, media + len(payload), chunk)
        keys = range(1, n + 1, key_every)
        entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, unit)), _full(b"stss", struct.pack(">I", len(keys)), struct.pack(">%dI" % len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)), _full(b"stsz", struct.pack(">II", unit, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), struct.pack(form % len(offsets), *offsets)),
        )
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        times = struct.pack(">QQIQ", 0, 0, rate, len(payload))
        mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), _box(b"minf", _full(b"smhd", bytes(4)), data, stbl))
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return kind + index(len(kind) + len(index(0)) + head) + _box(b"mdat", payload)


def index_media(files: DataFrame, *, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """id_col, tracks array<struct<.., keyframes array<struct<start, end>>>>, error of every row."""

    def of(content: bytes | None) -> tuple[list[dict], str | None]:
        tracks, error = ([], "null") if content is None else read_index(content)
        return [{k: v for k, v in t.items() if k != "ranges"} | {"keyframes": [{"start": a, "end": b} for a, b in t["keyframes"]]} for t in tracks], error

    return computed(files.select(id_col, F.col(content_col).alias("_content")), ["_content"], f"tracks {TRACKS}, error string", lambda: of)


def text_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, content: every text (null: empty), padded with bytes 0 to a positive multiple of 64, as a container."""
    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    return computed(rows, ["_text"], "content binary", lambda: lambda text: (container(text_payload(text)),))


def stored_digests(files: DataFrame, *, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Digests of containers by their own index: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is put together from the byte ranges of the first track's samples.  ``feature`` is
    ``kind/codec timescale duration samples keyframes first-range last-range crc-of-ranges``.
    """

    def of(data: bytes) -> tuple:
        tracks, error = read_index(data)
        if error:
            raise ValueError(error)
        t = tracks[0]
        payload = b"".join([data[a:b] for a, b, _ in t["ranges"]])
        keys = [f"{a}-{b}" for a, b in t["keyframes"]]
        feature = f"{t['kind']}/{t['codec'].strip()} {t['timescale']} {t['duration']} {t['samples']} {len(keys)} {keys[0]} {keys[-1]} {zlib.crc32(','.join(keys).encode()):08x}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    rows = files.select(id_col, F.col(content_col).alias("_content"))
    return computed(rows, ["_content"], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", lambda: of)
