"""PNG: 8-bit grey, RGB, and both with alpha, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """height x width (grey) or height x width x 3 (RGB) bytes."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, 1 + pixels[0].size), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows without the filter that the first byte of each names."""
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] - 1), np.uint8)
    for y, (kind, *_), raw in zip(range(len(rows)), rows, rows[:, 1:]):
        above = out[y]
        if kind == 0:
            out[y + 1] = raw
        elif kind == 1:
            # Sums of a sample's own column, as bytes that wrap.
            for c in range(step):
                out[y + 1, c::step] = np.cumsum(raw[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = raw + above
        elif kind in (3, 4):
            own, up = [0] * step + raw.tolist(), [0] * step + above.tolist()
            for x in range(step, len(own)):
                a, b, c = own[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
                own[x] = own[x] + guess & 255
            out[y + 1] = own[step:]
        else:
            raise ValueError("unknown filter")
    return out[1:]


def read(data: bytes) -> tuple[str, np.ndarray]:
    """("L", height x width) or ("RGB", height x width x 3); alpha is dropped."""
    if data[:8] != MAGIC:
        raise ValueError("no PNG")
    at, body, head = 8, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        raw = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw)
        elif kind == b"IDAT":
            body.append(raw)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("unsupported PNG")
    w, h, _, colour, *_ = head
    samples = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("broken PNG") from e
    if len(raw) != h * (1 + w * samples):
        raise ValueError("PNG cut short")
    pixels = _unfilter(np.frombuffer(raw, np.uint8).reshape(h, -1), samples).reshape(h, w, samples)
    return ("RGB", np.ascontiguousarray(pixels[..., :3])) if samples > 2 else ("L", np.ascontiguousarray(pixels[..., 0]))
