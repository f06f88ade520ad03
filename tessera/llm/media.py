"""Media columns: bytes as 8-bit PCM in Matroska files, and packet tables parsed from such files.

Nulls: a null payload is stored as an empty one; a null file gives no packets.
Malformed files: ``packet_table`` gives one row with ``error`` set and all else null.
Repeated rows, ties: rows are independent. A text of any length is one file, read
and written in one piece. An empty table gives an empty result. Extra columns are
not read, or kept where a column is added; one of that name is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, texts_of

# Fixed values of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
TIMESTAMP_SCALE, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
MASTERS = {SEGMENT, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, INFO}

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
PAD = b"\xff"


class Malformed(ValueError):
    pass


@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    size: int
    keyframe: bool
    lace: int
    cued: bool = False


# -- writing ---------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones pattern of each width is left out as it means unknown."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lace header and frames of one block; NO_LACING takes one frame."""
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for before, now in zip(sizes, sizes[1:-1]):
            step = now - before
            width = next(w for w in range(1, 9) if abs(step) < 1 << 7 * w - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_matroska(payload: bytes, per_block: int = 8, per_cluster: int = 256, kind: int = EBML_LACING) -> bytes:
    """payload as mono 8-bit PCM: frames of 576 samples, laced into blocks, in clusters that cues point to."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">f", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    tracks = element(TRACKS, element(TRACK_ENTRY, entry + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), per_cluster):
        own = frames[first : first + per_cluster]
        parts = [_uint(CLUSTER_TIME, first * FRAME_MS)]
        for k in range(0, len(own), per_block):
            group = own[k : k + per_block]
            how = kind if len(group) > 1 else NO_LACING
            parts.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", k * FRAME_MS, 0x80 | how << 1) + lace(group, how)))
        cluster = element(CLUSTER, b"".join(parts))
        where = _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at)
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, where)))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    head = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(body))


# -- reading ---------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are set)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"cut short at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    plain = value & (1 << 7 * width) - 1
    return value if keep_marker else plain, at + width, plain == (1 << 7 * width) - 1


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of each element; an unknown size reaches to the parent's end."""
    at = start
    while at < end:
        number, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        stop = end if unknown else at + size
        if stop > end:
            raise Malformed(f"element {number:x} passes its parent's end")
        yield number, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block whose header ends before ``at``."""
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Malformed(f"empty lace at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise Malformed("uneven fixed lace")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end:
                size += (byte := data[at])
                at += 1
                if byte != 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            before = at
            value, at, _ = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("lace sizes pass the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse_matroska(data: bytes) -> list[Packet]:
    """All packets in file order; ``cued`` marks the first packet of a cluster that a cue names."""
    packets: list[Packet] = []
    cues: set[int] = set()
    firsts: dict[int, int] = {}
    durations: dict[int, int] = {}
    scale = 1_000_000

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, time: int, key: bool | None) -> None:
        track, at, _ = read_vint(data, a)
        if at + 3 > b:
            raise Malformed(f"short block at {a}")
        offset, flags = struct.unpack_from(">hB", data, at)
        step = durations.get(track, 0) // scale
        for k, (start, size) in enumerate(unlace(data, at + 3, b, flags >> 1 & 3)):
            packets.append(Packet(track, time + offset + k * step, start, size, bool(flags & 0x80) if key is None else key, k))

    def cluster(a: int, b: int, segment: int) -> int:
        """Reads until b or an element that can't stand in a cluster; returns where it stopped."""
        time, first, at = 0, len(packets), a
        while at < b:
            begin = at
            number, at, _ = read_vint(data, at, keep_marker=True)
            if number in (CLUSTER, CUES, TRACKS, INFO):
                return begin
            size, at, unknown = read_vint(data, at)
            stop = b if unknown else at + size
            if stop > b:
                raise Malformed(f"element {number:x} passes its cluster")
            if number == CLUSTER_TIME:
                time = uint(at, stop)
            elif number == SIMPLE_BLOCK:
                block(at, stop, time, None)
            elif number == BLOCK_GROUP:
                inner = list(elements(data, at, stop))
                for n, x, y in inner:
                    if n == BLOCK:
                        block(x, y, time, not any(m == 0xFB for m, _, _ in inner))
            at = stop
        if len(packets) > first:
            firsts[segment] = first
        return at

    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    for number, a, b in top[1:]:
        if number != SEGMENT:
            continue
        at = a
        while at < b:
            begin = at
            number, at, _ = read_vint(data, at, keep_marker=True)
            size, at, unknown = read_vint(data, at)
            stop = b if unknown else at + size
            if stop > b:
                raise Malformed(f"element {number:x} passes its segment")
            if number == CLUSTER:
                at = cluster(at, stop, begin - a) if unknown else (cluster(at, stop, begin - a), stop)[1]
                continue
            if number == INFO:
                scale = next((uint(x, y) for n, x, y in elements(data, at, stop) if n == TIMESTAMP_SCALE), scale) or scale
            elif number == TRACKS:
                for n, x, y in elements(data, at, stop):
                    if n == TRACK_ENTRY:
                        own = {m: uint(c, d) for m, c, d in elements(data, x, y) if m in (TRACK_NUMBER, DEFAULT_DURATION)}
                        durations[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
            elif number == CUES:
                for n, x, y in elements(data, at, stop):
                    for m, c, d in elements(data, x, y) if n == CUE_POINT else ():
                        if m == CUE_POSITIONS:
                            cues |= {uint(e, f) for k, e, f in elements(data, c, d) if k == CUE_CLUSTER}
            at = stop
    for where, first in firsts.items():
        packets[first].cued = where in cues
    return packets


# -- operators -------------------------------------------------------------


def padded(text: str) -> tuple[int, bytes]:
    """(unpadded length, payload): UTF-8 filled with bytes 255 up to a positive multiple of 576."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + PAD * ((FRAME - len(raw) % FRAME) if len(raw) % FRAME or not raw else 0)


def feature(packets: list[Packet], samples: bytes) -> str:
    """Counts of packets and cues, and integer moments of the samples about 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(packets)};cues={sum(p.cued for p in packets)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def store_text(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Adds a binary column with the Matroska file of each text."""
    from tessera.llm.common import ship

    ship(df.sparkSession)

    @F.arrow_udf("binary")
    def encode(a: pa.Array) -> pa.Array:
        return pa.array([write_matroska(padded(t or "")[1]) for t in a.to_pylist()], pa.binary())

    return df.withColumn(into, encode(df[text]))


PACKETS = "track long, timestamp long, start long, size long, keyframe boolean, lace int, cued boolean, error string"


def packet_table(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per packet of each Matroska file: track, time, byte range."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, data in zip(column(batch, key).to_pylist(), column(batch, media).to_pylist()):
            if data is None:
                continue
            try:
                out += [(k, p.track, p.timestamp, p.start, p.size, p.keyframe, p.lace, p.cued, None) for p in parse_matroska(data)]
            except Malformed as e:
                out.append((k, *[None] * 7, str(e)))
        names = [key, "track", "timestamp", "start", "size", "keyframe", "lace", "cued", "error"]
        types = [column(batch, key).type, *[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
        cols = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return map_batches(df.select(key, media), parse, f"`{key}` {kind}, {PACKETS}")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(text: str) -> tuple:
    """The digest columns of one text, from its stored form read back through the packet table."""
    n, payload = padded(text)
    stored = write_matroska(payload)
    packets = parse_matroska(stored)
    back = b"".join(stored[p.start : p.start + p.size] for p in packets)
    return n, len(back), sha256(back).hexdigest(), crc32(back[-32:]), len(stored), sha256(stored).hexdigest(), feature(packets, back)


def media_digest(df: DataFrame) -> DataFrame:
    """doc_id and the round trip's digests of each text; null and empty texts are one padded frame."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(round_trip, texts_of(batch, "text"))))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names)

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, DIGEST)
