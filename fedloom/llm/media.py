"""Media columns: ISO base media containers (MP4 family).

Reader: nested boxes are walked by their headers, sample tables are decoded, and codec, duration and the
byte ranges of keyframes are stored. Payload bytes are never decoded; only ranges are sliced out on request.
Writer: stores bytes losslessly as a track of raw 8-bit samples, one access unit for each FRAME bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import text_array

FRAME = 576
RATE = 8000
FRAMES_IN_CHUNK = 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class MediaError(ValueError):
    """A container that breaks off or contradicts itself."""


def _box(kind: bytes, *body: bytes) -> bytes:
    n = 8 + sum(map(len, body))
    if n >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, n + 8) + b"".join(body)
    return struct.pack(">I4s", n, kind) + b"".join(body)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
_HDLR = _box(b"hdlr", bytes(8), b"soun", bytes(12), b"samples\0")
_SMHD = _box(b"smhd", bytes(8))
_DINF = _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1))))
_STSD = _box(b"stsd", struct.pack(">II", 0, 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def pad(raw: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 up to a positive multiple of unit."""
    n = max(1, -(-len(raw) // unit)) * unit
    return raw + b"\xff" * (n - len(raw))


def write_media(payload: bytes, frame: int = FRAME) -> bytes:
    """A container with payload as raw samples; its length is a positive multiple of frame. Every access unit is a keyframe."""
    units, rest = divmod(len(payload), frame)
    if rest or not units:
        raise ValueError("the payload isn't a positive multiple of the frame")
    ticks = len(payload)
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(_FTYP) + head
    full, last = divmod(units, FRAMES_IN_CHUNK)
    runs = ([(1, FRAMES_IN_CHUNK)] if full else []) + ([(full + 1, last)] if last else [])
    stsc = b"".join(struct.pack(">III", first, n, 1) for first, n in runs)
    chunks = full + bool(last)
    step = FRAMES_IN_CHUNK * frame
    wide = at + len(payload) >= 1 << 32
    places = struct.pack(f">{chunks}{'Q' if wide else 'I'}", *range(at, at + chunks * step, step))
    stbl = _box(
        b"stbl",
        _STSD,
        _box(b"stts", struct.pack(">IIII", 0, 1, units, frame)),
        _box(b"stsc", struct.pack(">II", 0, len(runs)), stsc),
        _box(b"stsz", struct.pack(">III", 0, frame, units)),
        _box(b"co64" if wide else b"stco", struct.pack(">II", 0, chunks), places),
    )
    long = ticks >= 1 << 32
    mdhd = struct.pack(">IQQIQI", 1 << 24, 0, 0, RATE, ticks, 0x55C40000) if long else struct.pack(">IIIIII", 0, 0, 0, RATE, ticks, 0x55C40000)
    short = min(ticks, (1 << 32) - 1)
    trak = _box(
        b"trak",
        _box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, short), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), _UNITY, bytes(8)),
        _box(b"mdia", _box(b"mdhd", mdhd), _HDLR, _box(b"minf", _SMHD, _DINF, stbl)),
    )
    mvhd = _box(b"mvhd", struct.pack(">IIIIIIH", 0, 0, 0, RATE, short, 0x10000, 256), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
    return b"".join((_FTYP, struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if head == 16 else struct.pack(">I4s", len(payload) + 8, b"mdat"), payload, _box(b"moov", mvhd, trak)))


def walk(raw, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of every box, containers before what they hold."""
    end = len(raw) if end is None else end
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} bytes behind the last box at {start}")
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"box at {start} breaks off")
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} at {start} claims {size} bytes")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(raw, start + head, start + size, here)
        start += size


def _table(raw, at: int, end: int, fmt: str) -> list[tuple]:
    n = struct.unpack_from(">I", raw, at + 4)[0]
    size = struct.calcsize(fmt)
    if at + 8 + n * size > end:
        raise MediaError(f"table at {at} claims {n} entries")
    return list(struct.iter_unpack(fmt, raw[at + 8 : at + 8 + n * size]))


def read_media(raw: bytes) -> list[dict]:
    """A dict for each track: codec, timescale, duration (ticks), channels, bits, samples, chunks and keyframes (offset, bytes).

    Adjacent samples are returned as they lie; nothing of mdat is read. Malformed input raises MediaError.
    """
    tracks: list[dict] = []
    for path, at, end in walk(raw):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        try:
            if kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", raw, at + 20) if raw[at] == 1 else struct.unpack_from(">II", raw, at + 12)
            elif kind == b"hdlr":
                t["handler"] = bytes(raw[at + 8 : at + 12])
            elif kind == b"stsd":
                t["codec"] = bytes(raw[at + 12 : at + 16]).decode("latin-1")
                if t.get("handler") == b"soun":
                    t["channels"], t["bits"] = struct.unpack_from(">HH", raw, at + 32)
            elif kind == b"stts":
                t["stts"] = _table(raw, at, end, ">II")
            elif kind == b"stsc":
                t["stsc"] = _table(raw, at, end, ">III")
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", raw, at + 4)
                t["sizes"] = (size, n) if size else [x[0] for x in struct.iter_unpack(">I", raw[at + 12 : at + 12 + 4 * n])]
                if not size and at + 12 + 4 * n > end:
                    raise MediaError("sample sizes break off")
            elif kind in (b"stco", b"co64"):
                t["places"] = [x[0] for x in _table(raw, at, end, ">I" if kind == b"stco" else ">Q")]
            elif kind == b"stss":
                t["sync"] = {x[0] for x in _table(raw, at, end, ">I")}
        except struct.error as e:
            raise MediaError(f"box {kind!r} breaks off") from e
    return [_laid_out(t, len(raw)) for t in tracks]


def _laid_out(t: dict, length: int) -> dict:
    sizes, places, stsc = t.get("sizes", []), t.get("places", []), t.get("stsc", [])
    fixed, total = sizes if isinstance(sizes, tuple) else (0, len(sizes))
    chunks: list[tuple[int, int]] = []
    keys: list[tuple[int, int]] = []
    sync = t.get("sync")
    sample = 0
    for k, (first, per, _) in enumerate(stsc):
        stop = stsc[k + 1][0] if k + 1 < len(stsc) else len(places) + 1
        for c in range(first, stop):
            n = min(per, total - sample)
            if n <= 0:
                break
            if not 0 < c <= len(places):
                raise MediaError("a chunk has no place")
            at = places[c - 1]
            if fixed:
                size = fixed * n
                if sync is None:
                    keys += zip(range(at, at + size, fixed), [fixed] * n, strict=True)
                else:
                    keys += [(at + i * fixed, fixed) for i in range(n) if sample + i + 1 in sync]
            else:
                size = 0
                for i in range(n):
                    if sync is None or sample + i + 1 in sync:
                        keys.append((at + size, sizes[sample + i]))
                    size += sizes[sample + i]
            if at + size > length:
                raise MediaError("a chunk lies behind the end")
            chunks.append((at, size))
            sample += n
    if sample != total:
        raise MediaError(f"{total} samples, {sample} of them in chunks")
    return {
        "codec": t.get("codec", ""), "timescale": t.get("timescale", 0), "duration": t.get("duration", 0), "channels": t.get("channels", 0),
        "bits": t.get("bits", 0), "samples": total, "ticks": sum(n * d for n, d in t.get("stts", [])), "chunks": chunks, "keyframes": keys,
    }


def payload_of(raw: bytes, track: dict) -> bytes:
    """A track's stored bytes, in order, as its sample tables place them."""
    return b"".join(raw[at : at + n] for at, n in track["chunks"])


def feature_of(track: dict) -> str:
    keys = track["keyframes"]
    ms = track["duration"] * 1000 // track["timescale"] if track["timescale"] else 0
    edge = f"{keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]}" if keys else "-"
    return f"codec={track['codec'].strip()};channels={track['channels']};bits={track['bits']};rate={track['timescale']};duration_ms={ms};samples={track['samples']};keyframes={len(keys)};ranges={edge}"


def media_column(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata of a binary column: track, codec, duration_ms, samples, keyframes (array of struct<offset, bytes>) and error.

    A row for each track; one with error set for bytes that can't be read, null bytes included. Columns
    besides media and keep aren't read.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "track int, codec string, duration_ms bigint, samples bigint, keyframes array<struct<offset:bigint,bytes:bigint>>, error string"])

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "track", "codec", "duration_ms", "samples", "keyframes", "error")}
            for i, raw in enumerate(batch.column(len(names)).to_pylist()):
                try:
                    found, error = read_media(raw or b""), None if raw else "no bytes"
                except MediaError as e:
                    found, error = [], str(e)
                for k, t in enumerate(found):
                    ms = t["duration"] * 1000 // t["timescale"] if t["timescale"] else 0
                    for c, v in zip(rows, (i, k, t["codec"], ms, t["samples"], [{"offset": a, "bytes": b} for a, b in t["keyframes"]], None), strict=True):
                        rows[c].append(v)
                if not found:
                    for c, v in zip(rows, (i, None, None, None, None, None, error or "no track"), strict=True):
                        rows[c].append(v)
            take = pa.array(rows["at"], pa.int64())
            pair = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(take) for i in range(len(names))]
                + [pa.array(rows["track"], pa.int32()), pa.array(rows["codec"], pa.string()), pa.array(rows["duration_ms"], pa.int64()), pa.array(rows["samples"], pa.int64()), pa.array(rows["keyframes"], pair), pa.array(rows["error"], pa.string())],
                names=names + list(rows)[1:],
            )

    return df.select(*[f"`{n}`" for n in names], f"`{media}`").mapInArrow(run, schema)


_OUT = [
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
]


def store_text(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """Store each text's padded UTF-8 bytes in a container and read them back through its sample tables.

    Null and empty texts are stored as one frame of bytes 255. Each row stands for itself, so repeated rows
    give repeated results and equal texts equal ones; other columns aren't read. One pass, no shuffle; one
    text and its container are in memory at a time, besides the batch. with_media adds the container.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    out = _OUT + ([("media", pa.binary())] if with_media else [])
    sql = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {sql[t]}" for n, t in out)])

    def run(batches):
        for batch in batches:
            texts = text_array(batch.column(len(names)))
            raw = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
            for lo in range(0, len(raw), 128):
                cols: list[list] = [[] for _ in out]
                for x in raw.slice(lo, 128):
                    body = x.as_py()
                    media = write_media(pad(body))
                    track = read_media(media)[0]
                    back = payload_of(media, track)
                    row = (len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(track), media)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, 128) for i in range(len(names))] + [pa.array(c, t) for c, (_, t) in zip(cols, out, strict=True)],
                    names=names + [n for n, _ in out],
                )

    return df.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, schema)
