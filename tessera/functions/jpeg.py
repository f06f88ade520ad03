"""Baseline JPEG streams: header parsing and entropy decoding of one file, as plain functions for Arrow maps.

Sizes and rules are those of a baseline decoder: 8-bit samples, one to three
components with ids 1 to 3, luma factors 1 or 2, chroma factors 1. What breaks a
rule raises Invalid with the reason; state never outlives a file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tessera.schema import MAX_DECODED, MAX_FILE, ZIGZAG

SKIPPED = {*range(0xE0, 0xF0), 0xFE, *range(0xF0, 0xFE), 0xDC, 0xDE, 0xDF}
SOI, SOF0, SOF2, DHT, SOS, DQT, DRI = 0xD8, 0xC0, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD


class Invalid(ValueError):
    pass


@dataclass
class Header:
    width: int = 0
    height: int = 0
    restart_interval: int = 0
    spectral: tuple[int, int, int, int] = (0, 0, 0, 0)
    comps: list[dict] = field(default_factory=list)
    qt: dict[int, list[int]] = field(default_factory=dict)
    dc: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)
    ac: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)
    data_start: int = 0
    warnings: int = 0

    @property
    def max_h(self) -> int:
        return max(c["h"] for c in self.comps)

    @property
    def max_v(self) -> int:
        return max(c["v"] for c in self.comps)

    def geometry(self) -> dict[str, int]:
        w, h = (self.width + 7) // 8, (self.height + 7) // 8
        return {
            "mcu_w": w, "mcu_h": h, "mcu_w_real": -(-w // self.max_h) * self.max_h, "mcu_h_real": -(-h // self.max_v) * self.max_v,
            "max_h": self.max_h, "max_v": self.max_v, "bmp_padding": self.width % 4,
        }

    @property
    def decoded_bytes(self) -> int:
        """What the decoded blocks take in 16-bit samples, by the factors of the last component."""
        g, last = self.geometry(), self.comps[-1]
        blocks = (g["mcu_h"] + last["v"]) * g["mcu_w_real"] + g["mcu_w"] + last["h"]
        return 2 * 64 * blocks * len(self.comps)


class Cursor:
    """A place in the bytes; reads past the end are invalid."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise Invalid("ends before the scan")
        self.at += 1
        return self.data[self.at - 1]

    def short(self) -> int:
        return self.byte() << 8 | self.byte()

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Invalid("ends before the scan")
        self.at += n
        return self.data[self.at - n : self.at]


_MARKER = re.compile(rb"\xff+([^\xff])", re.S)


def markers(data: bytes) -> list[tuple[int, int, int, int]]:
    """(code, offset, length, stray bytes before) of each segment up to the scan; raises Invalid for no image."""
    if data[:2] != b"\xff\xd8":
        raise Invalid("no start of image")
    out, at = [(SOI, 0, 2, 0)], 2
    while True:
        m = _MARKER.search(data, at)
        if not m:
            raise Invalid("ends before the scan")
        code, begin = m[1][0], m.end()
        if code not in SKIPPED and code not in (DQT, DRI, SOF0, DHT, SOS):
            raise Invalid("progressive images aren't supported" if code == SOF2 else f"unhandled marker {code:02x}")
        if begin + 2 > len(data):
            raise Invalid("ends before the scan")
        length = int.from_bytes(data[begin : begin + 2], "big")
        if length < 2:
            raise Invalid(f"segment {code:02x} shorter than its length")
        out.append((code, begin - 2, length, m.start() - at))
        if code == SOS:
            return out
        # A skipped segment may reach past the end; then the next search ends the file.
        at = min(len(data), begin + length)


def _dqt(c: Cursor, h: Header, length: int) -> None:
    left = length - 2
    while left > 0:
        info = c.byte()
        if info & 15 > 3:
            raise Invalid("quantization table id over 3")
        wide = 2 if info >> 4 else 1
        raw = np.frombuffer(c.take(64 * wide), ">u2" if wide == 2 else "u1")
        table = np.zeros(64, int)
        table[list(ZIGZAG)] = raw
        h.qt[info & 15] = table.tolist()
        left -= 1 + 64 * wide
    if left:
        raise Invalid("quantization segment of wrong length")


def _dri(c: Cursor, h: Header, length: int) -> None:
    if length != 4:
        raise Invalid("restart segment of wrong length")
    h.restart_interval = c.short()


def _sof(c: Cursor, h: Header, length: int) -> None:
    if h.comps:
        raise Invalid("second frame")
    precision, h.height, h.width, n = c.byte(), c.short(), c.short(), c.byte()
    if precision != 8:
        raise Invalid("precision isn't 8")
    if not h.width or not h.height:
        raise Invalid("empty frame")
    if not 1 <= n <= 3:
        raise Invalid("component count")
    for k in range(n):
        cid, factors, tq = c.byte(), c.byte(), c.byte()
        if not 1 <= cid <= 3:
            raise Invalid("component id")
        fh, fv = factors >> 4, factors & 15
        if fh not in ((1, 2) if cid == 1 else (1,)) or fv not in ((1, 2) if cid == 1 else (1,)):
            raise Invalid("sampling factors")
        if any(x["id"] == cid for x in h.comps):
            raise Invalid("component id")
        h.comps.append({"id": cid, "h": fh, "v": fv, "tq": tq, "td": 0, "ta": 0})
    if length != 8 + 3 * n:
        raise Invalid("frame segment of wrong length")
    if n == 1:
        # A scan of one component isn't interleaved.
        h.comps[0] |= {"h": 1, "v": 1}


def _dht(c: Cursor, h: Header, length: int) -> None:
    left = length - 2
    while left > 0:
        info = c.byte()
        if info & 15 > 1:
            raise Invalid("Huffman table id over 1")
        counts = list(c.take(16))
        if sum(counts) > 256:
            raise Invalid("Huffman table of over 256 symbols")
        symbols = list(c.take(sum(counts)))
        (h.ac if info >> 4 else h.dc)[info & 15] = (counts, symbols)
        left -= 17 + sum(counts)
    if left:
        raise Invalid("Huffman segment of wrong length")


def _sos(c: Cursor, h: Header, length: int) -> None:
    if not h.comps:
        raise Invalid("scan before frame")
    n = c.byte()
    if n != len(h.comps):
        raise Invalid("scan component count")
    for _ in range(n):
        cid, tables = c.byte(), c.byte()
        own = next((x for x in h.comps if x["id"] == cid), None)
        if own is None:
            raise Invalid("scan component id")
        own |= {"td": tables >> 4, "ta": tables & 15}
    ss, se, approx = c.byte(), c.byte(), c.byte()
    h.spectral = (ss, se, approx >> 4, approx & 15)
    if (ss, se) != (0, 63):
        raise Invalid("spectral selection")
    if approx:
        raise Invalid("successive approximation")
    if length != 6 + 2 * n:
        raise Invalid("scan segment of wrong length")
    h.data_start = c.at


def parse_header(data: bytes) -> Header:
    if not data:
        raise Invalid("empty file")
    h = Header()
    parsers = {DQT: _dqt, DRI: _dri, SOF0: _sof, DHT: _dht, SOS: _sos}
    for code, offset, length, stray in markers(data):
        h.warnings += bool(stray)
        if code in parsers:
            c = Cursor(data)
            c.at = offset + 4
            parsers[code](c, h, length)
    return h


def gated_header(data: bytes) -> Header:
    """The header of a file within the limits on its bytes and on its decoded size."""
    if len(data) > MAX_FILE:
        raise Invalid("file over the limit")
    h = parse_header(data)
    if h.decoded_bytes > MAX_DECODED:
        raise Invalid("decoded size over the limit")
    return h


# -- entropy decoding --------------------------------------------------------


def canonical(counts: Sequence[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol in order: counts up within a length, doubles from length to length."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        out += [(code + k, length) for k in range(n)]
        code = code + n << 1
    return out


#: What a window begins with: a value, one whose bits reach past the window, zeros without a value, the end, or no code.
VALUE, LONG, ZEROS, END, WRONG, OVER = range(6)
NONE = (0, WRONG, 0, 0)


@lru_cache(maxsize=32)
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...], kind: int) -> list[tuple[int, int, int, int]]:
    """For each 16-bit window of DC (kind 0) or AC codes: bits taken, what it is, zeros before it, and the value or the size of one.

    Code and magnitude are told in one step where both fit into the window. Files that share their tables share these, and equal
    entries are one object.
    """
    windows = np.arange(1 << 16)
    out = np.zeros((1 << 16, 4), np.int64)
    out[:] = NONE
    for (code, length), symbol in zip(canonical(counts), symbols):
        first = code << 16 - length
        if first + (1 << 16 - length) > 1 << 16:
            raise Invalid("Huffman codes overflow")
        own = slice(first, first + (1 << 16 - length))
        run, size = (symbol >> 4, symbol & 15) if kind else (0, symbol)
        if symbol == 255:
            continue
        if size > (10 if kind else 11):
            out[own] = (length, OVER, 0, 0)
        elif kind and not size:
            out[own] = (length, ZEROS, 16 if symbol == 0xF0 else run, 0) if symbol else (length, END, 0, 0)
        elif length + size > 16:
            out[own] = (length, LONG, run, size)
        else:
            bits = windows[own] >> 16 - length - size & (1 << size) - 1
            out[own] = (length + size, VALUE, run, 0)
            out[own, 3] = np.where(bits >> max(0, size - 1), bits, bits - (1 << size) + 1) if size else 0
    packed = (out + [0, 0, 0, 1 << 15]) @ [1 << 32, 1 << 28, 1 << 20, 1]
    _, at, which = np.unique(packed, return_index=True, return_inverse=True)
    entries = [tuple(row) for row in out[at].tolist()]
    return [entries[k] for k in which.tolist()]


_RESTART = re.compile(rb"\xff+([\xd0-\xd7])")
_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")


def segments(data: bytes, start: int) -> list[bytes]:
    """The restart segments of the scan without stuffing."""
    end = _END.search(data, start)
    scan = data[start : end.start()] if end else data[start:]
    parts = _RESTART.split(scan)[::2]
    return [re.sub(rb"\xff+\x00", b"\xff", p) for p in parts]


def read_block(raw: bytes, pos: int, dc: list, ac: list, places: list[int], values: list[int]) -> int:
    """Decodes the block that begins at bit ``pos`` of raw, which ends with eight spare bytes: its places and values are appended, the bit after it returned."""
    k = 0
    base = pos & ~7
    window = int.from_bytes(raw[base >> 3 : (base >> 3) + 8].ljust(8, b"\0"), "big")
    table = dc
    while k < 64:
        # The window holds 64 bits from the byte at base.
        if pos - base > 32:
            base = pos & ~7
            window = int.from_bytes(raw[base >> 3 : (base >> 3) + 8].ljust(8, b"\0"), "big")
        bits, what, run, value = table[window >> 48 - pos + base & 0xFFFF]
        pos += bits
        if what == VALUE:
            k += run
        elif what == END:
            break
        elif what == LONG:
            k += run
            size, value = value, window >> 64 - (pos - base) - value & (1 << value) - 1
            pos += size
            if not value >> size - 1:
                value -= (1 << size) - 1
        elif what == ZEROS:
            k += run
            if k > (64 if run == 16 else 63):
                raise Invalid("zero run past the block")
            continue
        elif what == OVER:
            raise Invalid("DC size over 11" if table is dc else "AC size over 10")
        else:
            raise Invalid("unknown code")
        if k > 63:
            raise Invalid("zero run past the block")
        places.append(k)
        values.append(value)
        k += 1
        table = ac
    return pos


def scan_shape(h: Header) -> list[tuple[int, int, int, list, list]]:
    """Component, row and column within a unit, and the code tables, of a unit's blocks in order."""
    for c in h.comps:
        if c["tq"] not in h.qt:
            raise Invalid("missing quantization table")
        if c["td"] not in h.dc or c["ta"] not in h.ac:
            raise Invalid("missing Huffman table")
    luts = {(kind, k): _lookup(*map(tuple, t), kind) for kind, tables in enumerate((h.dc, h.ac)) for k, t in tables.items()}
    return [(k, y, x, luts[0, c["td"]], luts[1, c["ta"]]) for k, c in enumerate(h.comps) for y in range(c["v"]) for x in range(c["h"])]


def block_keys(h: Header, blocks: np.ndarray) -> np.ndarray:
    """brow, bcol, comp, scan_idx, restart_seg of blocks by their number in the scan."""
    g = h.geometry()
    unit = np.array([(k, y, x) for k, c in enumerate(h.comps) for y in range(c["v"]) for x in range(c["h"])])
    # A block's number within its component's blocks of a unit.
    nth = np.array([(unit[:j, 0] == u[0]).sum() for j, u in enumerate(unit)])
    sizes = np.bincount(unit[:, 0])
    across = g["mcu_w_real"] // h.max_h
    mcu, at = np.divmod(blocks, len(unit))
    comp, y, x = unit[at].T
    seg = mcu // h.restart_interval if h.restart_interval else np.zeros_like(mcu)
    return np.stack([mcu // across * h.max_v + y, mcu % across * h.max_h + x, comp, mcu * sizes[comp] + nth[at], seg], axis=1).astype(np.int32)


def block_count(h: Header) -> int:
    g = h.geometry()
    return g["mcu_w_real"] // h.max_h * (g["mcu_h_real"] // h.max_v) * sum(c["h"] * c["v"] for c in h.comps)


def scan_parts(data: bytes, h: Header) -> list[bytes]:
    """The bytes that are decoded on their own: restart segments, or the whole scan; markers without an interval are dropped."""
    parts = segments(data, h.data_start)
    return parts if h.restart_interval else [b"".join(parts)]


def decode_scan(data: bytes, h: Header, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients in stream order with DC as differences, keys as of block_keys) of all restart segments, or of one."""
    shape, total, parts = scan_shape(h), block_count(h), scan_parts(data, h)
    per = h.restart_interval * len(shape) or total
    first, last = (0, total) if only is None else (only * per, min(total, (only + 1) * per))
    rows: list[int] = []
    places: list[int] = []
    values: list[int] = []
    for at in range(first, last):
        seg, within = divmod(at, per)
        if not within:
            if seg >= len(parts):
                raise Invalid("scan cut short")
            raw, bits, pos = parts[seg] + b"\0" * 8, 8 * len(parts[seg]), 0
        _, _, _, dc, ac = shape[at % len(shape)]
        pos = read_block(raw, pos, dc, ac, places, values)
        rows += [at - first] * (len(places) - len(rows))
        if pos > bits:
            raise Invalid("scan cut short")
    out = np.zeros((last - first, 64), np.int32)
    out[rows, places] = values
    return out, block_keys(h, np.arange(first, last))


# -- parallel decoding within a scan -----------------------------------------


class Guess:
    """Blocks decoded from a bit where a block may or may not begin, as far as asked; wrong codes are passed a bit at a time."""

    def __init__(self, raw: bytes, start: int, shape: list[tuple]):
        self.raw, self.bits, self.shape = raw + b"\0" * 8, 8 * len(raw), shape
        self.pos, self.phase = start, 0
        self.found: list[tuple[int, int, list[int], list[int]]] = []
        self.begins: set[tuple[int, int]] = set()
        tables = [(id(dc), id(ac)) for *_, dc, ac in shape]
        turns = [tables[k:] + tables[:k] for k in range(len(shape))]
        #: Phases from which the same tables follow decode alike.
        self.alike = [turns.index(t) for t in turns]

    def state(self) -> tuple[int, int]:
        return self.pos, self.alike[self.phase]

    def step(self) -> bool:
        if self.pos >= self.bits:
            return False
        begin, places, values = self.state(), [], []
        *_, dc, ac = self.shape[self.phase]
        try:
            after = read_block(self.raw, self.pos, dc, ac, places, values)
        except Invalid:
            self.pos, self.phase = self.pos + 1, 0
            return True
        if after > self.bits:
            return False
        self.begins.add(begin)
        self.found.append((*begin, places, values))
        self.pos, self.phase = after, (self.phase + 1) % len(self.shape)
        return True


def decode_piece(data: bytes, h: Header, piece: int, pieces: int) -> tuple[list[tuple[int, list[int]]], int]:
    """(bit and coefficients of blocks, the bit up to which they count) of one of equal pieces of a scan without restarts.

    A piece goes on into the next until it stands where a decoder that began there stands too: from then on both decode alike.
    """
    raw, shape = scan_parts(data, h)[0], scan_shape(h)
    edge = lambda k: 8 * (len(raw) * k // pieces)
    own, other = Guess(raw, edge(piece), shape), Guess(raw, edge(piece + 1), shape)
    until = 8 * len(raw)
    while True:
        if piece + 1 < pieces and own.pos >= edge(piece + 1):
            while other.pos < own.pos and other.step():
                pass
            if own.state() in other.begins or own.state() == other.state():
                until = own.pos
                break
        if not own.step():
            break
    out = []
    for pos, _, places, values in own.found:
        if pos < until:
            block = [0] * 64
            for k, v in zip(places, values):
                block[k] = v
            out.append((pos, block))
    return out, until


def decode_image(data: bytes) -> tuple[Header, np.ndarray, int]:
    """(header, height x width x 3 bytes, number of blocks): all steps fused for one file."""
    from tessera.functions.pixels import np_dezigzag, np_idct, np_rgb, np_wrap16

    h = gated_header(data)
    g = h.geometry()
    zz, keys = decode_scan(data, h)
    rows, cols = g["mcu_h_real"], g["mcu_w_real"]
    planes = np.zeros((3, rows * 8, cols * 8), np.int32)
    for k, c in enumerate(h.comps):
        own = keys[:, 2] == k
        diffs, seg = zz[own], keys[own, 4]
        dc = np.cumsum(diffs[:, 0])
        # Predictors start anew with each restart segment.
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        before = np.where(first > 0, dc[first - 1], 0)
        diffs[:, 0] = np_wrap16(dc - np.repeat(before, np.diff(np.append(first, len(seg)))))
        samples = np_idct(np_wrap16(np_dezigzag(diffs) * np.array(h.qt[c["tq"]])))
        up_v, up_h = (1, 1) if len(h.comps) == 1 else (h.max_v // c["v"], h.max_h // c["h"])
        brow, bcol = keys[own, 0] // up_v, keys[own, 1] // up_h
        tiles = np.zeros((rows // up_v, cols // up_h, 8, 8), np.int32)
        tiles[brow, bcol] = samples
        plane = tiles.transpose(0, 2, 1, 3).reshape(rows // up_v * 8, cols // up_h * 8)
        planes[c["id"] - 1 if len(h.comps) > 1 else 0] = plane.repeat(up_v, 0).repeat(up_h, 1)
    rgb = np_rgb(*planes)[: h.height, : h.width]
    return h, np.ascontiguousarray(rgb), len(zz)
