"""ISO media containers (ISO/IEC 14496-12): writing one audio track, walking boxes, reading sample tables.

A reader never decodes a payload: it walks the nested boxes, decodes the sample tables of each
track and gives codec, duration and the byte ranges of the sync samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.session import materialize, ship

#: Bytes of one access unit; 8-bit mono samples at ``RATE`` a second.
UNIT, RATE = 192, 8000
#: Units in a chunk of the track, and units from one sync sample to the next.
PER_CHUNK, SYNC = 64, 25
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_track(payload: bytes) -> bytes:
    """A file with one track that holds ``payload``, of a positive multiple of ``UNIT`` bytes, unchanged."""
    n, extra = divmod(len(payload), UNIT)
    if extra or not n:
        raise ValueError("the payload isn't a positive multiple of the unit")
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    sync = np.arange(1, n + 1, SYNC, dtype=">u4")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks + bool(rest), dtype=np.int64) * (UNIT * PER_CHUNK)
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        table = [
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, k, 1) for first, k in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(">I", len(offsets)), offsets.astype(">u8").tobytes()),
        ]
        long = struct.pack(">QQIQ", 0, 0, RATE, n * UNIT)
        media = _box(
            b"mdia",
            struct.pack(">I4sI", 44, b"mdhd", 1 << 24), long, struct.pack(">HH", 0x55C4, 0),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *table)),
        )
        head = struct.pack(">I4sI", 120, b"mvhd", 1 << 24) + long + struct.pack(">IH", 0x10000, 0x100) + bytes(10) + matrix + bytes(24) + struct.pack(">I", 2)
        track = struct.pack(">I4sI", 104, b"tkhd", 1 << 24 | 7) + struct.pack(">QQIIQ", 0, 0, 1, 0, n * UNIT) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x100, 0) + matrix + bytes(8)
        return _box(b"moov", head, _box(b"trak", track, media))

    front = len(ftyp) + len(moov(0))
    return b"".join([ftyp, moov(front + (8 if len(payload) < 2**32 - 8 else 16)), _box(b"mdat", payload)])


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first byte of the body, end) of each box, parents first. A box beyond its parent raises ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{path or 'file'}: {end - start} bytes are left, too few for a box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"{path or 'file'}: a long size is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if kind == b"uuid":
            body += 16
        if stop > end or stop < body:
            raise ValueError(f"{path}/{kind.decode('latin-1')}: its size doesn't fit")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, name)
        start = stop


def _entries(data: bytes, body: int, stop: int, width: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    if stop - body < skip + 4:
        raise ValueError("a table is cut off")
    (n,) = struct.unpack_from(">I", data, body + skip)
    first = body + skip + 4
    if first + n * width * np.dtype(kind).itemsize > stop:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, first).astype(np.int64).reshape(n, width)


def tracks(data: bytes) -> list[dict]:
    """Of each track: handler, codec, timescale, duration, sample offsets, sizes and sync sample numbers (from 0).

    Without ``stss`` each sample is a sync sample, as the format says. ValueError if the boxes
    or tables contradict each other, and for movie fragments, whose samples aren't decoded.
    """
    found: list[dict] = []
    for name, body, stop in walk(data):
        kind = name.rpartition("/")[2]
        if kind == "moof":
            raise ValueError("movie fragments aren't decoded")
        if kind == "trak":
            found.append({})
        elif found and "/trak/" in name:
            t = found[-1]
            if kind == "mdhd":
                if stop - body < 20 or data[body] and stop - body < 32:
                    raise ValueError("mdhd is cut off")
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, body + 20) if data[body] else struct.unpack_from(">II", data, body + 12)
            elif kind == "hdlr":
                t["handler"] = data[body + 8 : body + 12].decode("latin-1")
            elif kind == "stsd":
                t["codec"] = data[body + 12 : body + 16].decode("latin-1")
            elif kind in ("stts", "stsc"):
                t[kind] = _entries(data, body, stop, 2 if kind == "stts" else 3)
            elif kind in ("stco", "stss"):
                t[kind] = _entries(data, body, stop, 1)[:, 0]
            elif kind == "co64":
                t["stco"] = _entries(data, body, stop, 1, ">u8")[:, 0]
            elif kind == "stsz":
                if stop - body < 12:
                    raise ValueError("stsz is cut off")
                size, n = struct.unpack_from(">II", data, body + 4)
                t["sizes"] = np.full(n, size, np.int64) if size and n <= len(data) else _entries(data, body, stop, 1, skip=8)[:, 0]
    for t in found:
        if missing := {"sizes", "stco", "stsc", "stts"} - t.keys():
            raise ValueError(f"a track lacks {', '.join(sorted(missing))}")
        n, first, stsc = len(t["sizes"]), t["stco"], t["stsc"]
        starts = np.append(stsc[:, 0] - 1, len(first))
        per = np.repeat(stsc[:, 1], np.diff(starts)) if len(stsc) and (np.diff(starts) >= 0).all() and starts[0] == 0 else np.zeros(0, np.int64)
        if per.sum() != n or len(per) != len(first) or t["stts"][:, 0].sum() != n:
            raise ValueError("the sample tables disagree on the number of samples")
        chunk = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(t["sizes"]) - t["sizes"]
        t["offsets"] = first[chunk] + before - before[np.cumsum(per) - per][chunk] if n else np.zeros(0, np.int64)
        if n and (t["offsets"].min() < 0 or (t["offsets"] + t["sizes"]).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        t["sync"] = t["stss"] - 1 if "stss" in t else np.arange(n)
        if len(t["sync"]) and (t["sync"].min() < 0 or t["sync"].max() >= n):
            raise ValueError("a sync sample doesn't exist")
    return found


def payload_of(data: bytes, track: dict) -> bytes:
    """All bytes of a track's samples, in order; runs of adjacent samples are copied at once."""
    at, size = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    breaks = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    first, last = np.append(0, breaks), np.append(breaks, len(at)) - 1
    return b"".join(data[a:b] for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist()))


def describe(data: bytes | None) -> dict:
    """The media columns of one file: a dict for the schema ``MEDIA``.

    A null file gives nulls; a malformed one gives its fault in ``error`` and nulls else.
    """
    if data is None:
        return {}
    try:
        found = tracks(data)
    except (ValueError, struct.error) as e:
        return {"error": str(e)}
    return {
        "tracks": [
            {
                "handler": t.get("handler"), "codec": t.get("codec"), "timescale": t.get("timescale"), "duration": t.get("duration"), "n_samples": len(t["sizes"]),
                "keyframes": [{"first": a, "size": s} for a, s in zip(t["offsets"][t["sync"]].tolist(), t["sizes"][t["sync"]].tolist())],
            }
            for t in found
        ]
    }


MEDIA = "struct<tracks:array<struct<handler:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<first:long,size:long>>>>,error:string>"


def media_columns(df: DataFrame, column: str, into: str = "media_info") -> DataFrame:
    """Add the struct ``MEDIA`` read from the containers in a binary column."""

    @F.pandas_udf(MEDIA)
    def info(files):
        import pandas as pd

        found = [describe(None if x is None else bytes(x)) for x in files]
        return pd.DataFrame({"tracks": [d.get("tracks") for d in found], "error": [d.get("error") for d in found]})

    ship(df.sparkSession)
    return df.withColumn(into, info(F.col(column)))


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, files = [], []
    for text in batch.column("text").to_pylist():
        raw = (text or "").encode()
        sizes.append(len(raw))
        files.append(write_track(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for file in batch.column("media").to_pylist():
        (t,) = tracks(file)
        payload = payload_of(file, t)
        ranges = np.stack([t["offsets"][t["sync"]], t["sizes"][t["sync"]]], 1).astype("<i8")
        rows.append((
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(),
            f"{t['codec'].strip()}/{t['timescale']}/{t['duration']}/{len(t['sync'])}/{zlib.crc32(ranges.tobytes()):08x}",
        ))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", *names])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a track of its UTF-8 bytes, padded with blanks to a whole unit.

    Rows with null or equal doc_id stay rows of their own; other columns are ignored.
    """
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _store, "doc_id long, n_bytes long, media binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store the texts as containers in the shared folder and describe what is read back.

    ``feature``: codec, timescale, duration, number of sync samples and the CRC of their byte ranges.
    """
    stored = materialize(store_texts(docs), "media")
    return map_batches(stored, _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
